"""Exact byte-level BPE with a bounded memo of chunks, over the tokenizers library.

Pre-tokenisation of the byte-level models starts a new piece at every single space that stands between two
non-space characters, and makes a single line feed between such characters a piece of its own. A run of letters
is one piece, a run of other symbols after it the next. Whatever stands between such places is therefore encoded
independently, so a chunk's ids can be reused.
"""

from __future__ import annotations

import os
import re

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
#: Chunks in one generation of a worker's memos; two generations are kept, and what is used again survives.
MEMO = 700_000

_safe = re.compile(r"(?<=\S)(?= \S)")
_made: dict = {}
#: White space but space and line feed (there is none beyond U+3000), and what two of those make.
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_OTHER_ASCII = [c for c in _OTHER if c.isascii()]
_DOUBLE = ("  ", "\n\n", " \n", "\n ")


def _single_blanks(text: str) -> bool:
    """All white space of a text (not empty) is single spaces and line feeds between other characters."""
    if text[0] in " \n" or text[-1] in " \n":
        return False
    for blank in _OTHER_ASCII if text.isascii() else _OTHER:
        if blank in text:
            return False
    for blanks in _DOUBLE:
        if blanks in text:
            return False
    return True


class _Memo(dict):
    """piece → bytes of its ids, with or without a space before it."""

    def __init__(self, owner: Encoder, space: bool):
        super().__init__()
        self.owner, self.space, self.old = owner, space, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.owner.chunk(piece, self)
        if len(self) >= self.owner.memo:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """encode(text) → uint16 or uint32 ids, equal to Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str | None = None, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo = memo
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}
        self.first, self.later = _Memo(self, False), _Memo(self, True)
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def chunk(self, piece: str, memo: _Memo) -> bytes:
        if piece.isalpha():
            shown = (" " * memo.space + piece).encode().decode("latin-1").translate(self.letters)
            return np.array([t.id for t in self.model.tokenize(shown)], dtype=self.dtype).tobytes()
        if piece[-1:] in ".,;:" and (word := piece[:-1]).isalpha():
            return memo[word] + self.first[piece[-1]] if len(piece) > 1 else self.whole(" " * memo.space + piece)
        return self.whole(" " * memo.space + piece)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, self.dtype)
        if not _single_blanks(text):
            return np.frombuffer(b"".join([self.first[c] if c[0] != " " else self.later[c[1:]] for c in _safe.split(text)]), self.dtype)
        first, later, out = self.first, self.later.__getitem__, []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(first[head])
            out += map(later, rest)
            out.append(self.newline)
        out.pop()
        return np.frombuffer(b"".join(out), self.dtype)


def encoder(path: str | None = None) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
