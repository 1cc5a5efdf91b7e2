"""Sizes of texts in tokens of a public tokenizer, and hashed vectors of their tokens."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: Vocabulary used where no other is named; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# End of fixed value.

#: Counters of a hashed token vector.
HASHED = 1024


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER):
    """The tokenizer of a rank file; read once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, path: str = TOKENIZER) -> np.ndarray:
    """Tokens of the whole text; null and empty texts have none. No string is a special token."""
    return np.array(encoder(path).encode_ordinary(text), "i8") if text else np.empty(0, "i8")


def hashed_vector(ids: np.ndarray) -> np.ndarray:
    """Unit vector of damped token counts, hashed into HASHED counters."""
    v = np.log1p(np.bincount((ids * 2654435761 >> 7) % HASHED, minlength=HASHED))
    n = np.sqrt(v @ v)
    return v / n if n else v
