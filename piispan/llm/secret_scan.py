"""Secret scan with a worklist of decoded layers.

The base patterns run over the whole text. Then every token that may be percent-encoded, Unicode-
or entity-escaped, or base64 is decoded; base64 that holds gzip, zlib or bzip2 data is unpacked. Each decoded
token is a new layer on the worklist, and so is the whole text with all tokens of one coding decoded in place,
which shows secrets that are encoded in part. Layers are scanned by the same patterns and searched for tokens again, until no
layer is new; a layer with the same content and place as an earlier one is not taken again, so cycles end.
Each character of a layer remembers where in the text it comes from, so a secret's span covers
the encoded characters.

Base64 may follow other characters of its alphabet (a path, a name) or be wrapped over lines: every run is decoded from its
first four characters on, joined over line ends too, and compressed data is sought at each group; all members are unpacked.
Bytes that are no UTF-8 are replaced, and the rest is scanned.

Unpacked data are a stream, of any size: windows of it, which overlap and end outside of runs that may be base64, are layers one
after another, all in the place of the whole token; a window like an earlier one is not taken again, so what unpacks to endless
repetition costs its unpacking alone. A place in a layer is two 32-bit numbers a character, or two numbers in all within
unpacked data.

Defined results: a null or empty text has no spans; base64 is put in place of its token only if three quarters of it
are text, and of unpacked data their beginning and end are put there; within unpacked data, a single run of base64 of
more than `LONGEST_RUN` characters is taken in parts; repeated rows have equal results; extra columns are ignored; an
empty table gives an empty result. Time is linear in a text and in what it unpacks to, for each layer.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piispan.llm.common import narrow, sliced

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18
#: Unpacked data: characters in a window, in its overlap with the next, in the longest base64 run that is kept whole; bytes put in place of a token.
WINDOW, OVERLAP, LONGEST_RUN, IN_PLACE = 1 << 20, 4096, 16 << 20, 32 << 10
#: Bytes unpacked at a time, read at a time, and enough of them to tell packed data from chance.
_CHUNK, _SLICE, _SURE = 1 << 20, 1 << 16, 256

_LINK, _QUOTED = re.compile(r"[^\s\"'<>]+"), re.compile(r"[^\s\"']+")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_NEXT_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+)(={0,2})")
_OUTSIDE = re.compile(r"[^A-Za-z0-9+/_=\s-]")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]")
_ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f\udc80-\udcff]")
_BAD = re.compile(r"[\udc80-\udcff]")
_PERCENTS = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_MANY_SPACES = re.compile(r"\x20{64,}")

Span = tuple[str, int, int]
def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # a match of [0-9a-f]+ is a maximal run, so those of 16 or more are the matches that pass
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


class _Layer:
    """Decoded text; character i comes from [lo[i], hi[i]) of the original; None: from its own place; numbers: all from one place."""

    __slots__ = ("hi", "lo", "text")

    def __init__(self, text: str, lo, hi):
        self.text, self.lo, self.hi = text, lo, hi

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.lo is None:
            return a, b
        if isinstance(self.lo, int):
            return self.lo, self.hi
        return int(self.lo[a]), int(self.hi[b - 1])  # places rise with the text

    def child(self, parts: list[tuple]) -> _Layer:
        """A layer of parts (text, lo, hi) whose places are in this one's text."""
        text = "".join(p[0] for p in parts)
        if isinstance(self.lo, int) or not text:
            return _Layer(text, self.lo, self.hi)
        lo, hi = (np.concatenate([np.broadcast_to(np.asarray(p[k], np.int32), len(p[0])) for p in parts]) for k in (1, 2))
        return _Layer(text, lo, hi) if self.lo is None else _Layer(text, self.lo[lo], self.hi[hi - 1])

    def alone(self, text: str, a: int, b: int) -> _Layer:
        """A layer of any text that comes from [a, b) of this one's."""
        return _Layer(text, *self.span(a, b))


def _same(text: str, a: int, b: int) -> tuple:
    return text[a:b], np.arange(a, b, dtype=np.int32), np.arange(a + 1, b + 1, dtype=np.int32)


def _decompressor(raw: bytes):
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 2 and int.from_bytes(raw[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    return bz2.BZ2Decompressor() if raw[:3] == b"BZh" else None


def _inflated(source: Iterable[bytes], ended: list[int]) -> Iterator[bytes]:
    """What all members of gzip, zlib or bzip2 data hold, in pieces; stops where the data end or are damaged. `ended` gets a member's size."""
    source, raw, d, size = iter(source), b"", None, 0
    while True:
        if d is None:
            while len(raw) < 3 and (more := next(source, None)) is not None:
                raw += more
            if (d := _decompressor(raw)) is None:
                return
        try:
            out = d.decompress(raw, _CHUNK)
        except (zlib.error, OSError, EOFError):
            return
        size += len(out)
        if out:
            yield out
        if d.eof:
            ended.append(size)
            raw, d, size = d.unused_data, None, 0
            continue
        raw = getattr(d, "unconsumed_tail", b"")
        if not raw and len(out) < _CHUNK and (raw := next(source, b"")) == b"":
            return


def _unpacked(raw: bytes) -> Callable[[], Iterator[bytes]] | None:
    """A maker of the stream that `raw` unpacks to, with what is packed in it unpacked too; None unless a member is whole or gives a fair beginning."""
    make, best, seen = (lambda: (raw[i : i + _SLICE] for i in range(0, len(raw), _SLICE))), None, set()
    while True:
        ended: list[int] = []
        head = b""
        for piece in _inflated(make(), ended):
            head += piece[:_SURE]
            if len(head) >= _SURE:
                break
        if not head or (len(head) < _SURE and not ended):
            return best
        make = best = lambda inner=make: _inflated(inner(), [])
        if head in seen or _decompressor(head) is None:  # data that unpack to themselves are a cycle
            return best
        seen.add(head)


class _Ends:
    """A stream that remembers its beginning and its end."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.first, self.last = chunks, b"", b""

    def __iter__(self) -> Iterator[bytes]:
        for x in self.chunks:
            room = IN_PLACE - len(self.first)
            self.first += x[:room]
            self.last = (self.last + x[max(0, room) :])[-IN_PLACE:]
            yield x

    def text(self) -> str:
        return _BAD.sub("�", (self.first + self.last).decode("utf-8", "surrogateescape"))


def _windows(chunks: Iterable[bytes]) -> Iterator[str]:
    """A stream as overlapping texts; none ends within what may be base64, if that is not too long."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for chunk in chunks:
        held += _MANY_SPACES.sub(" " * 64, decoder.decode(chunk))
        if len(held) < WINDOW:
            continue
        m = _OUTSIDE.search(held[::-1])
        end = len(held) - m.start() if m else 0
        if end <= OVERLAP:
            if len(held) < LONGEST_RUN:
                continue
            end = len(held)
        yield held[:end]
        held = held[end - OVERLAP :]
    yield held + decoder.decode(b"", True)


def _percent(text: str, a: int, b: int) -> list[tuple]:
    """Decoded parts of text[a:b] with the characters that they come from."""
    parts = []
    for m in _PERCENTS.finditer(text, a, b):
        parts.append(_same(text, a, m.start()))
        raw, i = unquote_to_bytes(m[0]), 0
        while i < len(raw):
            size = 1 if raw[i] < 0x80 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4
            parts.append((raw[i : i + size].decode("utf-8", "replace"), m.start() + 3 * i, min(m.end(), m.start() + 3 * (i + size))))
            i += size
        a = m.end()
    return [*parts, _same(text, a, b)]


def _unescape(text: str, a: int, b: int) -> list[tuple]:
    parts, high = [], None
    for m in _ESCAPE.finditer(text, a, b):
        parts.append(_same(text, a, m.start()))
        code = int(m[4]) if m[4] else int(next(x for x in (m[1], m[2], m[3], m[5]) if x), 16)
        a = m.end()
        if m[1] and 0xD800 <= code < 0xDC00:
            high = (code, m.start(), a)
            continue
        if m[1] and 0xDC00 <= code < 0xE000 and high and high[2] == m.start():
            parts.append((chr(0x10000 + ((high[0] - 0xD800) << 10) + code - 0xDC00), high[1], a))
        elif code < 0x110000 and not 0xD800 <= code < 0xE000 and code:
            parts.append((chr(code), m.start(), a))
        high = None
    return [*parts, _same(text, a, b)]


def _wrapped_runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of base64 over lines; a line shorter than the one before is the last (a first line may hold more than data)."""
    at = 0
    while m := _BASE64.search(text, at):
        at = end = m.end()
        if text[m.end() - 1] == "=":
            continue
        sizes = [len(m[0])]
        while n := _NEXT_LINE.match(text, end):
            end = n.end()
            sizes.append(len(n[1]))
            if n[2]:
                break
            if sizes[-1] < sizes[-2]:
                more = _NEXT_LINE.match(text, end) if len(sizes) == 2 else None
                if more is None or len(more[1]) != sizes[-1]:
                    break
        if len(sizes) > 1:
            at = end
            yield m.start(), end


def _tokens(text: str) -> Iterator[tuple[int, int, str]]:
    """Places and codings of what may be encoded."""
    for coding, signs, widest, least in (("percent", ("%",), _LINK, _PERCENTS), ("escape", ("\\", "&#"), _QUOTED, _ESCAPE)):
        if any(x in text for x in signs) and least.search(text):
            yield from ((*m.span(), coding) for m in widest.finditer(text) if least.search(text, *m.span()))
    yield from ((*m.span(), "base64") for m in _BASE64.finditer(text))
    if "\n" in text:
        yield from ((a, b, "wrapped") for a, b in _wrapped_runs(text))


def _from_base64(layer: _Layer, a: int, b: int) -> Iterator[_Layer | list[tuple]]:
    """Layers of a run of base64; at last the parts that can stand in its place, none if nothing in it is text.

    Characters come from the group of four; those of unpacked data from all that follows its first group.
    """
    text = layer.text
    run = np.frombuffer(text[a:b].encode(), np.uint8)
    kept = (run > 32) & (run != 61)
    at, body = a + np.flatnonzero(kept), run[kept].tobytes().translate(_STANDARD)
    best, odd = [], 1 / 4
    for k in range(4):
        part = body[k : len(body) - ((len(body) - k) % 4 == 1)]
        if len(part) < 2:
            continue
        raw = base64.b64decode(part + b"=" * (-len(part) % 4))
        for m in _PACKED.finditer(raw):
            if m.start() % 3 == 0 and (make := _unpacked(memoryview(raw)[m.start() :])) is not None:
                first = int(at[k + m.start() // 3 * 4])
                ends = _Ends(make())
                yield from (layer.alone(x, first, b) for x in _windows(ends))
                best, odd = [_same(text, a, first), (ends.text(), first, b)], -1
        decoded = raw.decode("utf-8", "surrogateescape")
        share = len(_ODD.findall(decoded)) / len(decoded)
        if share >= odd and not base_spans(decoded) and next(_tokens(decoded), None) is None:
            continue
        code = np.frombuffer(decoded.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.where((code < 0x80) | ((code >= 0xDC80) & (code <= 0xDCFF)), 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4)))
        end = np.cumsum(size)
        parts = [(_BAD.sub("�", decoded), at[k + (end - size) * 4 // 3], at[k + np.minimum(len(part), -(-end * 4 // 3)) - 1] + 1)]
        yield layer.child(parts)
        if share < odd:
            best, odd = [_same(text, a, int(at[k])), *parts], share
    yield best


def _layers(layer: _Layer) -> Iterator[_Layer]:
    """Each layer under one: its tokens alone, then the whole text with the tokens of one coding in place."""
    text, runs = layer.text, {"base64": [], "wrapped": []}
    for a, b, coding in _tokens(text):
        if coding in _DECODE:
            yield layer.child(_DECODE[coding](text, a, b))
            continue
        for found in _from_base64(layer, a, b):
            if isinstance(found, _Layer):
                yield found
            elif found:
                runs[coding].append((a, b, found))
    for places in runs.values():
        whole, at = [], 0
        for a, b, parts in places:
            whole += [_same(text, at, a), *parts]
            at = b
        if whole:
            yield layer.child([*whole, _same(text, at, len(text))])
    for coding, least in (("percent", _PERCENTS), ("escape", _ESCAPE)):
        if least.search(text):
            yield layer.child(_DECODE[coding](text, 0, len(text)))


_DECODE = {"percent": _percent, "escape": _unescape}
_STANDARD = bytes.maketrans(b"-_", b"+/")


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans (base ones and those of decoded layers); by start, then kind."""
    if not text:
        return [], []
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    found, seen = set(base), set()
    work = [_layers(_Layer(text, None, None))]  # the worklist: layers not yet taken, made when their turn comes
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        mark = (xxhash.xxh3_128_digest(layer.text.encode("utf-8", "surrogatepass")), *layer.span(0, len(layer.text)))
        if mark in seen or layer.text == text:
            continue
        seen.add(mark)
        found.update((k, *layer.span(a, b)) for k, a, b in base_spans(layer.text))
        work.append(_layers(layer))
    return base, sorted(found, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans as one mark."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, a, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], f"[SECRET:{kind}]"]
        at = b
    return "".join(out) + text[at:]


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans as arrays of (kind, start, end), for each row of `docs`."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            results = [scan(t) for t in batch["text"].to_pylist()]
            as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([as_rows(b) for b, _ in results], kind), pa.array([as_rows(s) for _, s in results], kind)], names=["doc_id", "base", "spans"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    return narrow(docs, "doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {spans}, spans {spans}")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns; secrets in `text` become marks, and `n_chars`, if any, is counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            i = batch.schema.get_field_index("text")
            texts = [t and ((spans := scan(t)[1]) and redact(t, spans) or t) for t in batch["text"].to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
