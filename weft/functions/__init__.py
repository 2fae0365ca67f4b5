"""Part of weft; see the README for the map of modules."""
