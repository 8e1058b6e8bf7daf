"""Whole texts to token ids with public tokenizer files, remembering the ids of each piece.

Both vocabularies cut a text into pieces (runs of letters, of digits, of other marks, of white space) before
they merge, and merge each piece by itself, so ids of a text are those of its pieces in a row. Here texts are cut
by an expression of Python's that gives the same pieces, and each distinct piece goes to the library's merges once. Where the two
could differ (numbers that are no decimal digits, rarer white space and controls, unassigned
characters, unnormalised text, texts that spell a special token) the library encodes the whole text.
"""

from __future__ import annotations

import array
import os
import re
import sys
import unicodedata
from functools import lru_cache

#: Pieces remembered; beyond, the older half is forgotten unless it is asked for again. Longer ones are made each time.
MOST_PIECES, LONGEST = 700_000, 100


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_CONTRACTED = "'(?:[sdmt]|ll|ve|re)"


def _patterns(spaced: bool) -> tuple[re.Pattern, re.Pattern]:
    """Pieces of Latin-1 texts, and of any texts. With `spaced`, a space belongs to the piece after it and white space
    is a piece; else white space only parts pieces, and each digit is a piece."""
    if spaced:
        latin = rf" [{_LATIN}]+|[{_LATIN}]+|{_CONTRACTED}| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+"
        other = rf" ?[^\W\d_]+|{_CONTRACTED}| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
    else:
        latin = rf"[{_LATIN}]+|{_CONTRACTED}|[0-9]|[^ \t\n\r\f0-9{_LATIN}]+"
        other = rf"[^\W\d_]+|{_CONTRACTED}|\d|(?:[^ \t\n\r\f\w]|_)+"
    return re.compile(latin), re.compile(other)


def _odd(c: str) -> bool:
    """Whether expressions of Python's and the library's may put a character into different classes."""
    if c.isspace():
        return c not in " \t\n\r\f"
    return c in "\x1c\x1d\x1e\x1f" or unicodedata.category(c) in ("No", "Nl", "Cn", "Co", "Cs")


class _Uncertain(Exception):
    pass


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Pieces(dict):
    """Packed ids of a piece, made when first asked for."""

    def __init__(self, merges):
        super().__init__()
        self.merges, self.old = merges, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if not piece.isascii():
                if not piece.strip().isalpha() and any(map(_odd, piece)):
                    raise _Uncertain
                mapped = piece.encode().decode("latin-1").translate(_LETTERS)
            elif piece[0] == " " and piece[1:].isalnum():
                mapped = "Ġ" + piece[1:]
            elif piece.isalnum():
                mapped = piece
            elif any(map(_odd, piece)):
                raise _Uncertain
            else:
                mapped = piece.translate(_LETTERS)
            ids = packed([t.id for t in self.merges(mapped)])
        if len(piece) < LONGEST:
            if 2 * len(self) >= MOST_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lowers = self.tokenizer.normalizer is not None
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        latin, other = _patterns(spaced=not self.lowers)
        self.latin, self.other = latin.findall, other.findall
        self.ids = _Pieces(self.tokenizer.model.tokenize)

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; null: none."""
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return self.whole(text)
        pieces, body = self.latin, text
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pieces = self.other
                if self.lowers and ("Σ" in text or not unicodedata.is_normalized("NFC", text)):
                    return self.whole(text)
        if self.lowers:
            body = text.lower()
        try:
            return b"".join(map(self.ids.__getitem__, pieces(body)))
        except _Uncertain:
            return self.whole(text)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
