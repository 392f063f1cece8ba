"""Token ids of public tokenizers inside tasks.

The ids are by definition those of the ``tokenizers`` library with the given
vocabulary file.  ``tiktoken`` over the same vocabulary gives the same ids in a
third of the time where both pattern engines agree on letters and white space,
so texts of Latin letters and common punctuation go that way; any other text,
and any that spells a special token, is encoded by ``tokenizers`` itself.
``tests/llm/test_packing.py`` holds the two against each other.
"""

from __future__ import annotations

import array
import base64
import os
import re
from functools import lru_cache

#: What sends a text to ``tokenizers``: other alphabets, odd controls, the special token.
OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ‐-‧€]|<\\|endoftext\\|>")


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """Path, without ending, of an installed public vocabulary (.json and .tiktoken)."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json").removesuffix(".json")


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(f"{path}.json")
        with open(f"{path}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def slow(self, text: str) -> bytes:
        """The ids by ``tokenizers``."""
        return array.array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text; an empty text has none."""
        if OTHER.search(text):
            return self.slow(text)
        return array.array("I", self.fast.encode_ordinary(text)).tobytes()

    def count(self, text: str) -> int:
        """How many ids a text has."""
        if OTHER.search(text):
            return len(self.model.encode(text, add_special_tokens=False).ids)
        return len(self.fast.encode_ordinary(text))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker process."""
    return Encoder(path)
