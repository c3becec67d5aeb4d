"""Token ids of a public byte-level BPE vocabulary.

The ids are those of the ``tokenizers`` file. For speed, texts are encoded by
``tiktoken`` from the same vocabulary as ranks; the two libraries class every
code point alike (compared for all of them), and a text on which the first
gives up goes to the second.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(paths: tuple[str, str]):
    """A function from a text to its ids (uint32), made once per worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(paths[0])
    exact.encode_special_tokens = True
    with open(paths[1], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except Exception:  # its regular expressions give up on some very long runs
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode
