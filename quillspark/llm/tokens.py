"""Byte-level BPE ids, as the ``tokenizers`` library gives them for a vocabulary file.

The merges of a byte-level BPE are ranked by id, so the same ids come from ``tiktoken`` over the vocabulary's
own ranks, at several times the speed. A probe compares the two when a worker loads the file; where they
differ, or where tiktoken refuses a text (its regular expression gives up on some enormous runs of white
space), the ``tokenizers`` library itself encodes.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: The published splitting pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBE = ["", " ", "a  b\n\n c\t", "It's 12,345 naïve — «ñ» 日本語 🙂", "x" * 40 + "  \n ", "<|endoftext|> a<|endoftext|>b", "  z\x00\x7f"]
_loaded: dict[str, "ByteBpe"] = {}


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level BPE writes a printable byte as itself and the n-th of the others as code point 256 + n."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(path)
        self.size = self._slow.get_vocab_size()
        self._fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        try:
            import tiktoken

            special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
            table = _byte_of_symbol()
            ranks = {bytes(table[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
            fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            if all(fast.encode(t, allowed_special="all") == self._reference(t) for t in _PROBE):
                self._fast = fast
        except (ImportError, KeyError, ValueError):
            self._fast = None

    def _reference(self, text: str) -> list[int]:
        return self._slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self._fast is not None:
            try:
                return self._fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
            except BaseException as e:  # a panic of the native code is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self._reference(text), np.uint32)


def load(path: str) -> ByteBpe:
    """One tokenizer for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else pieces of ``capacity`` of which the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]
