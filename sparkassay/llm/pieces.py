"""A SentencePiece BPE model file: its pieces, scores and switches, read without the library."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NO_RANK = np.int32(2**31 - 1)


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message; nested messages stay bytes."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            size = varint()
            value = data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


class PieceModel:
    """Vocabulary of a BPE model with identity normalisation and byte fallback.

    Only pieces that a merge can make take part; pairs whose joined string is a piece get that piece's rank
    (equal scores share a rank, so the leftmost goes first among them, as in the library).
    """

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.dummy_prefix, tidy, charsmap, kind, self.byte_fallback = True, True, b"", 1, False
        self.unk_surface = " ⁇ "
        for number, value in _fields(data):
            if number == 1:
                got = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(_fields(value))
                self.pieces.append(got[1].decode())
                scores.append(struct.unpack("<f", got[2])[0])
                self.kinds.append(got[3])
            elif number == 2:
                got = dict(_fields(value))
                kind, self.byte_fallback = got.get(3, 1), bool(got.get(35, 0))
                self.unk_surface = got.get(44, self.unk_surface.encode()).decode()
            elif number == 3:
                got = dict(_fields(value))
                charsmap, self.dummy_prefix, tidy = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1))
        if kind != 2 or charsmap or tidy or not self.byte_fallback or not self.dummy_prefix or {USER, UNUSED} & {*self.kinds}:
            raise ValueError("only BPE models with identity normalisation, a dummy prefix and byte fallback are supported")
        if any(p.lstrip(SPACE).find(SPACE) >= 0 for p, k in zip(self.pieces, self.kinds) if k == NORMAL):
            raise ValueError("a piece holds a space after other characters, so units can't be cut at spaces")
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = np.array([self.pieces.index(f"<0x{b:02X}>") for b in range(256)], np.int32)
        _, dense = np.unique(-np.array(scores), return_inverse=True)
        self.rank = dense.astype(np.int32)
        #: id of each code point's own piece, or -1
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.char_id[32] = self.char_id[ord(SPACE)]
        self.size = len(self.pieces)
        keys, made = [], []
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    made.append(i)
        self.pairs = dict(zip(keys, made))
        # open addressing: a quarter full at most, so that nearly all look-ups end at the first slot
        self._bits = max(12, (4 * len(keys)).bit_length())
        self.slot_keys = np.full(1 << self._bits, -1, np.int64)
        self.slot_made = np.full(1 << self._bits, -1, np.int32)
        for k, i in self.pairs.items():
            at = int(self._slot(np.array([k], np.int64))[0])
            while self.slot_keys[at] >= 0:
                at = (at + 1) & ((1 << self._bits) - 1)
            self.slot_keys[at], self.slot_made[at] = k, i
        texts = [b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        for b, i in enumerate(self.byte_ids):
            texts[i] = bytes([b])
        texts[self.unknown] = self.unk_surface.encode()
        self.text_offs = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id) of what each pair merges to; NO_RANK where it doesn't. Negative symbols merge with nothing."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        found = self.slot_keys[at]
        made = np.where(found == keys, self.slot_made[at], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self._bits) - 1)
            found = self.slot_keys[at[todo]]
            hit = found == keys[todo]
            made[todo[hit]] = self.slot_made[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return np.where(made >= 0, self.rank[made], NO_RANK), made


@lru_cache(maxsize=2)
def load(data: bytes) -> PieceModel:
    return PieceModel(data)
