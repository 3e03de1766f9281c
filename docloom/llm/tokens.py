"""Token counts of a public byte-pair tokenizer; its file is a parameter and is never copied."""

from __future__ import annotations

import base64
from functools import cache

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split rule that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file; read once in a process. The file has to be there on every executor."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = VOCABULARY) -> int:
    return len(encoding(path).encode_ordinary(text))
