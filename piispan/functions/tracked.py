"""Text that remembers which characters of the original each of its characters comes from.

A transform is a list of edits (start, end, replacement). Unchanged characters keep their place; a replacement
of the same length may map character by character; any other maps to the whole interval that it replaces. So the map is
built in time linear in the text for each transform that changes something, and no alignment is needed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable


class Tracked:
    __slots__ = ("hi", "lo", "original", "text")

    def __init__(self, text: str):
        self.original, self.text = text, text
        self.lo: list[int] | None = None  # None: as in the original
        self.hi: list[int] | None = None

    def copy(self) -> Tracked:
        t = Tracked(self.original)
        t.text, t.lo, t.hi = self.text, self.lo, self.hi
        return t

    def span(self, start: int, end: int) -> tuple[int, int]:
        """What [start, end) covers in the original."""
        if self.lo is None:
            return start, end
        if not self.lo:
            return 0, 0
        if start >= end:
            at = self.lo[start] if start < len(self.lo) else self.hi[-1]
            return at, at
        return min(self.lo[start:end]), max(self.hi[start:end])

    def offsets(self) -> list[int]:
        """For each character, where in the original it begins."""
        return list(range(len(self.text))) if self.lo is None else list(self.lo)

    def edit(self, edits: Iterable[tuple[int, int, str]], aligned: bool = False) -> bool:
        """Applies edits in ascending order that don't overlap; True if the text changed."""
        edits = [(a, b, r) for a, b, r in edits if self.text[a:b] != r]
        if not edits:
            return False
        if self.lo is None:
            self.lo, self.hi = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        parts, lo, hi, at = [], [], [], 0
        for a, b, r in edits:
            parts += [self.text[at:a], r]
            lo += self.lo[at:a]
            hi += self.hi[at:a]
            if aligned and len(r) == b - a:
                lo += self.lo[a:b]
                hi += self.hi[a:b]
            else:
                if b > a:
                    x, y = min(self.lo[a:b]), max(self.hi[a:b])
                else:
                    x = y = self.lo[a] if a < len(self.lo) else (self.hi[-1] if self.hi else 0)
                lo += [x] * len(r)
                hi += [y] * len(r)
            at = b
        parts.append(self.text[at:])
        lo += self.lo[at:]
        hi += self.hi[at:]
        self.text, self.lo, self.hi = "".join(parts), lo, hi
        return True

    def sub(self, pattern: re.Pattern, replacement: str | Callable[[re.Match], str], aligned: bool = False) -> bool:
        if not pattern.search(self.text):
            return False
        make = replacement if callable(replacement) else (lambda m: m.expand(replacement)) if "\\" in replacement else (lambda m: replacement)
        return self.edit([(*m.span(), make(m)) for m in pattern.finditer(self.text)], aligned)

    def translate(self, table: dict[int, str]) -> bool:
        """One character for one character."""
        new = self.text.translate(table)
        return self.edit([(i, i + 1, y) for i, (x, y) in enumerate(zip(self.text, new, strict=True)) if x != y], True) if new != self.text else False

    def nfkc(self) -> bool:
        """NFKC by clusters of a character and the combining ones after it; where clusters interact, by words."""
        if unicodedata.is_normalized("NFKC", self.text):
            return False
        whole = unicodedata.normalize("NFKC", self.text)
        for pieces in (_clusters(self.text), re.findall(r"\s+|\S+", self.text)):
            new = [unicodedata.normalize("NFKC", p) for p in pieces]
            if "".join(new) == whole:
                break
        else:
            pieces, new = [self.text], [whole]
        at, edits = 0, []
        for p, r in zip(pieces, new, strict=True):
            edits.append((at, at + len(p), r))
            at += len(p)
        return self.edit(edits)


def _clusters(text: str) -> list[str]:
    out: list[str] = []
    for c in text:
        if out and unicodedata.combining(c):
            out[-1] += c
        else:
            out.append(c)
    return out
