"""Tokenize texts piece by piece: the ids of equal pieces are computed once per Python worker and kept in a bounded table."""
from __future__ import annotations

import struct
from collections.abc import Callable

#: Pieces whose ids a worker keeps; the table is emptied when it is full, which only costs time.
KEPT_PIECES = 400_000
#: Tables of this worker by tokenizer file; a worker serves many tasks.
TABLES: dict[tuple, IdTable] = {}


class IdTable(dict):
    """Little-endian unsigned 32-bit ids of pieces. `encode` gives the id lists of many pieces, `encode_one` the packed ids of one."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]] | None = None, encode_one: Callable[[IdTable, str], bytes] | None = None):
        super().__init__()
        self.encode, self.encode_one = encode, encode_one

    def __missing__(self, piece: str) -> bytes:
        found = self.encode_one(self, piece)
        if len(self) >= KEPT_PIECES:
            self.clear()
        self[piece] = found
        return found

    def learn(self, pieces: set) -> None:
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > KEPT_PIECES:
            self.clear()
            new = list(pieces)
        for piece, ids in zip(new, self.encode(new) if new else [], strict=True):
            self[piece] = packed(ids)

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        if self.encode:
            self.learn({p for t in texts for p in t})
        return [b"".join(map(self.__getitem__, t)) for t in texts]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def table_of(key: tuple, make: Callable[[], IdTable]) -> IdTable:
    if key not in TABLES:
        TABLES[key] = make()
    return TABLES[key]
