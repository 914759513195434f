"""Byte-pair vocabularies read from public tokenizer files (never trained, never copied)."""

from __future__ import annotations

import functools
import json

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def default_path(name: str) -> str:
    """Where the installed tokenizer package keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, other bytes take the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Vocabulary:
    """Ids of the bytes, merges by pair, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, letters = whole["model"], byte_letters()
        ids = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.byte_ids = np.array([ids[c] for c in letters], np.int32)
        self.last_byte_ids = np.array([ids[c + self.end] for c in letters], np.int32)
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(max(ids.values()), *self.special.values()) + 1
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a.removesuffix(self.end) + b if self.end else a + b] for a, b in merges], np.int32)
        #: (left << 20 | right) → rank
        self.ranks = dict(zip(((self.left << 20) | self.right).tolist(), range(len(merges)), strict=True))
        byte = {c: bytes([b]) for b, c in enumerate(letters)}
        table = [b""] * self.size
        for token, i in ids.items():
            table[i] = b"".join(byte[c] for c in token.removesuffix(self.end))
        for token, i in self.special.items():
            table[i] = token.encode()
        self.bytes = table

    @functools.cached_property
    def sorted_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pair keys in order, and their ranks."""
        keys = (self.left << 20) | self.right
        order = np.argsort(keys)
        return keys[order], order.astype(np.int64)

    @functools.cached_property
    def flat_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all ids end to end, and where each begins and how long it is."""
        lens = np.array([len(b) for b in self.bytes], np.int64)
        return np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(lens) - lens, lens


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """A vocabulary, read once in each worker."""
    return Vocabulary(path)
