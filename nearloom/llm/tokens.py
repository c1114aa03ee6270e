"""Byte-level BPE ids of whole texts.

``encode`` gives the ids that the ``tokenizers`` library gives for the same vocabulary file with
``add_special_tokens=False`` (a test holds them against each other).  The merges are run by
``tiktoken`` on the ranks read from that file, which takes about a fifth of the time; texts that
hold a special token's string go to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os

import numpy as np


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    def __init__(self, path: str | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = path or default_tokenizer_path()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        self.special = [t["content"] for t in stored["added_tokens"]]
        bytes_of = _byte_of_char()
        ranks = {bytes(bytes_of[c] for c in piece): n for piece, n in stored["model"]["vocab"].items() if piece not in self.special}
        self.merges = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.merges.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
