"""Opaque cursors: an offset that belongs to one query and knows the index it was made on."""

from __future__ import annotations

import base64
import binascii
from dataclasses import dataclass

VERSION, MAX_OFFSET = 2, 10**8
_OFFSET_BASIS, _PRIME = 0xCBF29CE484222325, 0x100000001B3


class BadCursor(ValueError):
    """The cursor is malformed or of another query."""


def fingerprint(*fields: str | None) -> str:
    """FNV-1a over the fields, each with its length before it, so that none can run into the next."""
    h = _OFFSET_BASIS
    for value in fields:
        data = b"\xff" if value is None else value.encode()
        for byte in len(data).to_bytes(8, "little") + bytes([value is None]) + data:
            h = ((h ^ byte) * _PRIME) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


@dataclass(frozen=True)
class Cursor:
    offset: int
    fingerprint: str
    generation: int

    def encode(self) -> str:
        return base64.urlsafe_b64encode(f"{VERSION}:{self.offset}:{self.fingerprint}:{self.generation}".encode()).decode()

    @classmethod
    def decode(cls, text: str, expected: str) -> Cursor:
        try:
            version, offset, print_, generation = base64.urlsafe_b64decode(text.encode()).decode().split(":")
            cursor = cls(int(offset), print_, int(generation))
        except (ValueError, binascii.Error, UnicodeError):
            raise BadCursor("not a cursor") from None
        if version != str(VERSION) or not 0 <= cursor.offset <= MAX_OFFSET:
            raise BadCursor("not a cursor")
        if print_ != expected:
            raise BadCursor("this cursor belongs to another query")
        return cursor


def next_cursor(offset: int, taken: int, total: int, print_: str, generation: int) -> str | None:
    """The cursor behind a page; none behind the last one or an empty one."""
    consumed = offset + taken
    return Cursor(consumed, print_, generation).encode() if taken and consumed < total else None
