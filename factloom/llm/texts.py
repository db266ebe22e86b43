"""Texts as bytes inside workers: one translation table maps what separates, then bytes are split at spaces."""

from __future__ import annotations

from collections.abc import Iterator

#: A text is taken apart in pieces of about so many bytes, so that one very long text never is one list of words.
PIECE = 1 << 22


def ascii_table(change: dict[int, int]) -> bytes:
    """A table for bytes.translate that lower-cases A-Z and changes the given bytes; bytes of other characters stay."""
    return bytes(change.get(c, c + 32 if 0x41 <= c <= 0x5A else c) for c in range(256))


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """text cut at spaces, each piece not much longer than size unless a word is."""
    at = 0
    while len(text) - at > size:
        end = text.find(b" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:] if at else text
