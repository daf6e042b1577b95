"""Secret scans with a recursive decoding worklist.

Every text is scanned as it stands, and then its encoded stretches are unwrapped: percent and Unicode escapes,
base64 (also wrapped over lines) and compressed data. What comes out is a layer of its own: it is scanned, and its
own encoded stretches join the worklist, until nothing new comes out. Layers already seen (by digest and place)
are not taken up again, so cycles end. Each layer carries, for each of its characters, the code points of the text
that it stems from, so a find in any layer maps to a span of the text.

Escapes within escapes are peeled one level at a time for `PEELS` levels, and besides in one pass to their fixpoint,
whose result doesn't depend on the order of peeling. So the work grows with a text's length, however deep it nests.
Bytes that are no UTF-8 become the replacement character and what stands around them is scanned. Compressed data
is unpacked as a stream, all members of it, and cut short data as far as it goes. A layer of more than
`BLOCK` characters is scanned in blocks that overlap by `OVERLAP`, so memory is bounded and no layer is left out;
only what a single find or nested stretch has beyond its block isn't seen.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex")
#: Characters of an unpacked layer that are scanned at once, how many of them two blocks share, and bytes unpacked at once.
BLOCK, OVERLAP, CHUNK = 1 << 24, 1 << 20, 1 << 20
#: Levels of escapes that are also scanned one by one.
PEELS = 3

NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A stretch long enough to hold a hex find or base64 worth unwrapping.
LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: The longest stretch in the characters of either alphabet, and its parts in one alphabet alone.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
ALPHABETS = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
#: Base64 over several lines: each break may have blanks around it.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Characters of which finds, base64 and escapes consist, with blanks: what is decoded elsewhere can't add to such a stretch.
STRETCH = re.compile(r"""[A-Za-z0-9+/_.=\-"':\x20\t\r\n%\\]+""")
ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
HEX_DIGITS = frozenset(map(ord, "0123456789abcdefABCDEF"))
#: Digits and marks of the escapes that a hex digit may end.
FORMS = ((2, (ord("%"),)), (2, (ord("\\"), ord("x"))), (4, (ord("\\"), ord("u"))), (8, (ord("\\"), ord("U"))))
#: Added to a byte that a percent escape stands for, as long as it isn't part of a character.
BYTE = 1 << 24


@dataclass
class Layer:
    """Decoded text; starts and ends give each character's span in the original, or one span for all. The original itself has none.

    `peels` counts the levels of escapes taken off since the layer came out of something else; `last` marks a fixpoint.
    """

    text: str
    starts: array | int | None
    ends: array | int | None
    peels: int = 0
    last: bool = False

    def span(self, a: int, b: int) -> tuple[int, int]:
        if isinstance(self.starts, int):
            return self.starts, self.ends
        starts, ends = self.each(a, b)
        return min(starts), max(ends)

    def each(self, a: int, b: int) -> tuple[Sequence[int], Sequence[int]]:
        """Starts and ends of some characters, one by one."""
        if self.starts is None:
            return range(a, b), range(a + 1, b + 1)
        if isinstance(self.starts, int):
            return [self.starts] * (b - a), [self.ends] * (b - a)
        return self.starts[a:b], self.ends[a:b]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the finds in one text, by start and then kind as listed."""
    found = []
    lower = text.lower()
    if any(n in lower for n in NAMES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    for run in LONG.finditer(text):
        if run.end() - run.start() >= 32:
            found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, run.start(), run.end()) if m.end() - m.start() >= 32]
    return in_order(found)


def in_order(spans) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# --- compressed data ----------------------------------------------------------------------------------------

PACKERS = (
    (b"\x1f\x8b", lambda: zlib.decompressobj(31), zlib.error),
    (b"\x78", zlib.decompressobj, zlib.error),
    (b"BZh", bz2.BZ2Decompressor, OSError),
    (b"\xfd7zXZ", lzma.LZMADecompressor, lzma.LZMAError),
)


def _members(chunks: Iterator[bytes], magic: bytes, make, problem: type[Exception]) -> Iterator[bytes]:
    """What packed data unpacks to, member after member, up to its end or its first fault."""
    unpack, full = make(), False
    for given in chunks:
        while given or full or not getattr(unpack, "needs_input", True):
            try:
                out = unpack.decompress(given, CHUNK)
            except (problem, EOFError):
                return
            if out:
                yield out
            full = len(out) == CHUNK
            if unpack.eof:
                given = unpack.unused_data.lstrip(b"\0")
                if given and not given.startswith(magic[: len(given)]):
                    return
                unpack, full = make(), False
            else:
                given = getattr(unpack, "unconsumed_tail", b"")


def opened(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Raw bytes, through as many compressed layers as there are."""
    first = next(chunks, b"")
    for magic, make, problem in PACKERS:
        if first.startswith(magic):
            inner = _members(chain([first], chunks), magic, make, problem)
            head = next(inner, b"")
            if head:
                return opened(chain([head], inner))
    return chain([first], chunks)


def _blocks(data: bytes, block: int, overlap: int) -> Iterator[str]:
    """The text that raw bytes unpack to, in overlapping blocks."""
    if data.startswith(b"x"):
        # Plain text may look like the start of packed data.
        try:
            yield data.decode("utf-8")
        except UnicodeDecodeError:
            pass
    decode, held = codecs.getincrementaldecoder("utf-8")("replace").decode, ""
    for part in opened(iter([data])):
        held += decode(part)
        while len(held) >= block:
            yield held[:block]
            held = held[block - overlap :]
    held += decode(b"", True)
    if held:
        yield held


# --- escapes ------------------------------------------------------------------------------------------------


class _Stack:
    """Characters with their source positions. A hex digit that ends an escape turns it into what it stands for."""

    def __init__(self):
        self.values: list[int] = []
        self.starts, self.ends = array("q"), array("q")

    def push(self, value: int, start: int, end: int) -> None:
        self.values.append(value)
        self.starts.append(start)
        self.ends.append(end)

    def keep(self, layer: Layer, a: int, b: int) -> None:
        """Characters of a layer as they are."""
        starts, ends = layer.each(a, b)
        self.values.extend(map(ord, layer.text[a:b]))
        self.starts.extend(starts)
        self.ends.extend(ends)

    def replace(self, n: int, value: int) -> None:
        """The last n become one; of a pair of surrogates, the second joins the first."""
        start, end = self.starts[-n], self.ends[-1]
        del self.values[-n:], self.starts[-n:], self.ends[-n:]
        if 0xDC00 <= value < 0xE000 and self.values and 0xD800 <= self.values[-1] < 0xDC00:
            value, start = 0x10000 + (self.values[-1] - 0xD800 << 10) + value - 0xDC00, self.starts[-1]
            del self.values[-1:], self.starts[-1:], self.ends[-1:]
        self.push(value, start, end)

    def settle(self) -> None:
        """Replaces escapes for as long as the last character ends one."""
        values = self.values
        while values and values[-1] in HEX_DIGITS:
            for digits, mark in FORMS:
                at = len(values) - digits - len(mark)
                if at >= 0 and tuple(values[at : at + len(mark)]) == mark and all(v in HEX_DIGITS for v in values[-digits:]):
                    value = int("".join(map(chr, values[-digits:])), 16)
                    self.replace(digits + len(mark), value + BYTE if len(mark) == 1 and value > 127 else min(value, 0x110000))
                    break
            else:
                return

    def layer_of(self, peels: int, last: bool) -> Layer:
        """The layer with bytes joined to characters; what is none becomes the replacement character."""
        text, starts, ends, values, i = [], array("q"), array("q"), self.values, 0
        while i < len(values):
            value, n = values[i], 1
            if value >= BYTE:
                n = 2 if value - BYTE < 0xE0 else 3 if value - BYTE < 0xF0 else 4
                part = values[i : i + n]
                try:
                    c = bytes(v - BYTE for v in part).decode("utf-8") if min(part) >= BYTE else "�"
                except (UnicodeDecodeError, ValueError):
                    c = "�"
                n = n if c != "�" else 1
            else:
                c = chr(value) if value < 0xD800 or 0xE000 <= value < 0x110000 else "�"
            text.append(c)
            starts.append(self.starts[i])
            ends.append(self.ends[i + n - 1])
            i += n
        return Layer("".join(text), starts, ends, peels, last)


def _peeled(layer: Layer, start: int, end: int) -> Layer:
    """A stretch with one level of its escapes taken off."""
    stack, at = _Stack(), start
    for m in ESCAPE.finditer(layer.text, start, end):
        stack.keep(layer, at, m.start())
        stack.push(0, *layer.span(m.start(), m.end()))
        value = int(m.group(m.lastindex), 16)
        stack.replace(1, value + BYTE if m.lastindex == 1 and value > 127 else min(value, 0x110000))
        at = m.end()
    stack.keep(layer, at, end)
    return stack.layer_of(layer.peels + 1, False)


def _settled(layer: Layer, start: int, end: int) -> Layer:
    """A stretch with all its escapes taken off, those that come out of others too."""
    stack = _Stack()
    for c, a, b in zip(layer.text[start:end], *layer.each(start, end), strict=True):
        value = ord(c)
        stack.push(value, a, b)
        if value in HEX_DIGITS:
            stack.settle()
    return stack.layer_of(0, True)


# --- the worklist -------------------------------------------------------------------------------------------


def _decoded(stretch: str, block: int, overlap: int) -> Iterator[str]:
    """Texts that a stretch of base64 in either alphabet unwraps to."""
    code = stretch.rstrip("=")
    code = code[:-1] if len(code) % 4 == 1 else code
    try:
        data = base64.b64decode((code + "=" * (-len(code) % 4)).translate(_URLSAFE), validate=True)
    except (binascii.Error, ValueError):
        return
    yield from _blocks(data, block, overlap)


_URLSAFE = str.maketrans("-_", "+/")


def _wrapped(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of base64 over lines of one length, with and without a shorter last one."""
    if "\n" not in text:
        return
    for whole in WRAPPED.finditer(text):
        lines = [m.span() for m in LINE.finditer(text, *whole.span())]
        i = 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and lines[j][1] - lines[j][0] == lines[i][1] - lines[i][0]:
                j += 1
            if lines[i][1] - lines[i][0] >= 16:
                if j > i + 1:
                    yield lines[i][0], lines[j - 1][1]
                if j < len(lines) and lines[j][1] - lines[j][0] < lines[i][1] - lines[i][0]:
                    yield lines[i][0], lines[j][1]
            i = j


def inner_layers(layer: Layer, block: int = BLOCK, overlap: int = OVERLAP) -> Iterator[Layer]:
    """The layers directly below one: its stretches with escapes taken off, and what its base64 unwraps to."""
    text = layer.text
    if not layer.last and layer.peels < PEELS and ("%" in text or "\\" in text):
        for m in STRETCH.finditer(text):
            if ESCAPE.search(text, *m.span()):
                yield _peeled(layer, *m.span())
                if not layer.peels:
                    yield _settled(layer, *m.span())
    places: dict[tuple[int, int], None] = {}
    for run in LONG.finditer(text):
        for whole in BASE64.finditer(text, run.start(), run.end()):
            # Whole first; then in each alphabet alone, where the other's characters only adjoin it.
            places |= dict.fromkeys([whole.span(), *(m.span() for p in ALPHABETS for m in p.finditer(text, *whole.span()))])
    if places:
        places |= dict.fromkeys(_wrapped(text))
    for a, b in places:
        code = text[a:b]
        for found in _decoded("".join(code.split()) if "\n" in code else code, block, overlap):
            yield Layer(found, *layer.span(a, b))


def scan(text: str, block: int = BLOCK, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans of a text, and all spans: those and what its layers hold, mapped back."""
    base = base_spans(text)
    if not ("%" in text or "\\" in text or LONG.search(text)):
        return base, base
    found, seen = set(base), set()
    work = [inner_layers(Layer(text, None, None), block, overlap)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        key = hashlib.blake2b(f"{layer.span(0, len(layer.text))}:{layer.text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        found.update((*layer.span(a, b), kind) for a, b, kind in base_spans(layer.text))
        work.append(inner_layers(layer, block, overlap))
    return base, in_order(found)


SCHEMA = "doc_id long, base array<struct<start:long,end:long,kind:string>>, spans array<struct<start:long,end:long,kind:string>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def scan_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Base spans and all spans of every document, in code points with the end exclusive.

    One row per input row. A null text is empty and has no spans; a null doc_id stays null; repeated rows are
    scanned alike; texts of any length are scanned whole; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t or "") for t in batch.column(1).to_pylist()]
            columns = [pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in f[i]] for f in found], SPAN) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "base", "spans"])

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, SCHEMA)


def joined(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda k: k == kind


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.col("base.kind"), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
