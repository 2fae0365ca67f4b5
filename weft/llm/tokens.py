"""Token counts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

from functools import lru_cache

VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """The encoder for a file of ranks; a bare name is looked up among the installed public tokenizers."""
    import base64
    import os

    import public_tokenizers
    import tiktoken

    path = vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of a text; null has none."""
    return 0 if not text else len(encoder(vocabulary).encode_ordinary(text))
