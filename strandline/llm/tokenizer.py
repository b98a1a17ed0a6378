"""Token counts of a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Folder of the vocabulary files, reachable from all executors.
TOKENIZER_DIR = os.environ.get("STRANDLINE_TOKENIZERS", "/opt/tokenizers")
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that goes with the rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a rank file, loaded once per worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text; 0 for null and ''.  Special-token strings are ordinary text."""
    encode = encoder(path).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]
