"""weft: web-search indexing, ranking and corpus processing as Spark DataFrame plans."""
