"""Packing of tokenised documents into fixed windows by minimum bin slack.

Each task tokenises its own part of the table as a stream and packs it locally, so nothing is shuffled and
memory is bounded by the pool of pending remainders. Windows that one document fills alone are emitted at
once. Of the remainders, the longest opens a window; a bitset subset-sum over the multiset of the other
lengths finds the sum closest to the room left, and backtracking gives how many of each length to take.
Where the best sum leaves slack, the next remainder is cut to fill it.
"""

from __future__ import annotations

import functools
import re
import struct
import sys
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 2048
END_ID = 1
#: Remainders held before packing starts, and those kept back so that late windows still have a choice.
POOL, KEEP = 1024, 256
#: Distinct words whose ids a worker remembers.
MEMO = 500_000
#: Longer texts are tokenised in parts cut where the tokenizer itself always cuts.
PART = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
DIGEST = [x.split()[0] for x in SCHEMA.split(", ")][:-1]


# --- subset sums ---------------------------------------------------------------------------------------


def closest_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of each length whose sum comes closest to `room` without passing it.

    Bit s of a bitset says that sum s can be reached. Multiplicities enter in binary parts, and the search
    stops once `room` itself is reached; the recorded bitsets are then walked backwards.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    trail: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, part = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(part, left)
            trail.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    goal, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(trail):
        if not before >> goal & 1:
            chosen[length] += take
            goal -= length * take
    return dict(chosen)


class Packer:
    """Packs one task's pieces. A piece is (document, start, ids as bytes); `emit` gets placed pieces."""

    def __init__(self, emit: Callable[[tuple, int, bytes, int, int], None], first_sequence: int, window: int = WINDOW):
        self.emit, self.next, self.window = emit, first_sequence, window
        self.pool: dict[int, list[tuple[tuple, int, bytes]]] = defaultdict(list)
        self.held = 0

    def add(self, doc: tuple, ids: bytes) -> None:
        size = self.window * 4
        at = 0
        while len(ids) - at >= size:
            self.emit(doc, at // 4, ids[at : at + size], self.next, 0)
            self.next, at = self.next + 1, at + size
        if at < len(ids):
            self.hold(doc, at // 4, ids[at:])
        if self.held >= POOL:
            while self.held > KEEP:
                self.fill(self.window)

    def hold(self, doc: tuple, start: int, ids: bytes) -> None:
        self.pool[len(ids) // 4].append((doc, start, ids))
        self.held += 1

    def take(self, length: int) -> tuple[tuple, int, bytes]:
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.held -= 1
        return piece

    def fill(self, room: int) -> None:
        """One window of `room` tokens, filled to the brim as long as the pool has that many."""
        placed = [self.cut(room)]
        left = room - len(placed[0][2]) // 4
        if left:
            chosen = closest_multiset({k: len(v) for k, v in self.pool.items()}, left)
            for length, count in sorted(chosen.items(), reverse=True):
                placed += [self.take(length) for _ in range(count)]
                left -= length * count
        while left and self.held:
            placed.append(self.cut(left))
            left -= len(placed[-1][2]) // 4
        offset = 0
        for doc, start, ids in placed:
            self.emit(doc, start, ids, self.next, offset)
            offset += len(ids) // 4
        self.next += 1

    def cut(self, room: int) -> tuple[tuple, int, bytes]:
        """The longest remainder, or its first `room` tokens; the rest goes back to the pool."""
        doc, start, ids = self.take(max(self.pool))
        if len(ids) > room * 4:
            self.hold(doc, start + room, ids[room * 4 :])
            ids = ids[: room * 4]
        return doc, start, ids

    def close(self) -> None:
        """Packs what is left; the last tokens go to sequences of a power of two, which need no padding."""
        total = sum(k * len(v) for k, v in self.pool.items())
        while total:
            room = self.window if total >= self.window else 1 << (total.bit_length() - 1)
            self.fill(room)
            total -= room


# --- tokenisation --------------------------------------------------------------------------------------


@functools.cache
def odd_characters() -> frozenset[str]:
    """Characters that `re` classes unlike the tokenizer's own pattern: numbers that are no decimal digits, and \\x1c-\\x1f."""
    return frozenset(map(chr, range(0x1C, 0x20))) | {c for c in map(chr, range(0x80, sys.maxunicode)) if unicodedata.category(c) in ("Nl", "No")}


class Memo(dict):
    """Ids of what stands between two spaces, with its leading space if there is one; computed once for each."""

    def __init__(self, ids: Ids, lead: str):
        super().__init__()
        self.ids, self.lead = ids, lead

    def __missing__(self, chunk: str) -> bytes:
        found = self[chunk] = self.ids.chunk(self.lead + chunk)
        return found


class Ids:
    """Ids of whole texts, as little-endian unsigned 32-bit, equal to the tokenizer's own for each text.

    Byte-level BPE first cuts a text into words by a pattern; ids of a word don't depend on its
    neighbours. What stands between spaces and line ends is looked up in a bounded memo, and only new words are
    encoded. Texts with characters on which the pattern isn't certain, and texts holding one of the
    special tokens, are encoded whole by the tokenizer.
    """

    SPLIT = re.compile(r" ?[^\W\d_]+| ?\d+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    SPACES = frozenset(c for c in map(chr, range(sys.maxunicode)) if c.isspace() and c not in " \n")
    RUNS = "  ", "\n\n", " \n", "\n "
    JOINT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")

    def __init__(self, path: str, ranks_path: str | None = None):
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.odd = odd_characters()
        self.watched = self.odd | self.SPACES
        self.encode = lambda word: self.whole.encode(word, add_special_tokens=False).ids
        if ranks_path:
            import base64

            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self.encode = tiktoken.Encoding("same", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.forget()

    def forget(self) -> None:
        self.first, self.spaced, self.single = Memo(self, ""), Memo(self, " "), {}

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, text: str) -> bytes:
        """Ids of a chunk: of each of its words by the pattern."""
        if text.isalpha() or text[:1] == " " and text[1:].isalpha():
            return self.pack(self.encode(text))
        out = []
        for word in self.SPLIT.findall(text):
            known = self.single.get(word)
            if known is None:
                bare = word[1:] if word[:1] == " " else word
                known = (self.spaced if bare is not word else self.first)[bare] if bare.isalpha() else self.pack(self.encode(word))
                if len(word) < 8:
                    self.single[word] = known
            out.append(known)
        return b"".join(out)

    def plain(self, text: str, even: bool) -> bytes:
        """Ids of a text on which the pattern is certain. A space or line end between two other characters is a sure cut."""
        if not text:
            return b""
        if not even or any(r in text for r in self.RUNS) or text[0].isspace() or text[-1].isspace():
            return b"".join(map(self.first.__getitem__, self.SPLIT.findall(text)))
        out: list[bytes] = []
        first, spaced, end = self.first, self.spaced.__getitem__, self.first["\n"]
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out += (end, first[head]) if out else (first[head],)
            out += map(spaced, rest)
        return b"".join(out)

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.first) + len(self.spaced) + len(self.single) > MEMO:
            self.forget()
        out = []
        for text in texts:
            even = self.watched.isdisjoint(text)
            if (even or self.odd.isdisjoint(text)) and not any(s in text for s in self.special):
                out.append(self.plain(text, even))
            else:
                out.append(self.pack(self.whole.encode(text, add_special_tokens=False).ids))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            if len(texts[at]) > PART and not any(s in texts[at] for s in self.special) and self.odd.isdisjoint(texts[at]):
                out.append(b"".join(self.batch([p])[0] for p in self.parts(texts[at])))
                at += 1
                continue
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= PART):
                size, to = size + len(texts[to]), to + 1
            out += self.batch(texts[at:to])
            at = to
        return out

    def parts(self, text: str) -> Iterator[str]:
        """Parts of a long text, cut before a space between two letters."""
        at = 0
        while len(text) - at > PART:
            joint = self.JOINT.search(text, at + PART)
            if not joint:
                break
            yield text[at : joint.start()]
            at = joint.start()
        yield text[at:]


@functools.lru_cache(maxsize=2)
def ids_of(path: str, ranks_path: str | None) -> Ids:
    return Ids(path, ranks_path)


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, *, with_ids: bool = False, window: int = WINDOW, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs every document into sequences of at most `window` tokens; one row per piece.

    `tokenizer` is a tokenizers file; `ranks` optionally names the same vocabulary as merge ranks, which
    encodes new words faster. A null text is empty and has the end id alone; a null doc_id stays null.
    Repeated rows are packed once each, a text of any length is tokenised whole, an empty table gives no
    rows, and other columns are ignored. `sequence_id` is unique: a task's number in the high bits.
    """
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer, ranks)
        rows: list[list] = [[] for _ in range(8)]

        def emit(document: tuple, start: int, piece: bytes, sequence: int, offset: int) -> None:
            for column, value in zip(rows, (document[0], start, len(piece) // 4, zlib.crc32(piece), document[1], sequence, offset, piece if with_ids else None), strict=True):
                column.append(value)

        def drain() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)][: 8 if with_ids else 7], names=[*DIGEST, "ids"][: 8 if with_ids else 7])
            for column in rows:
                column.clear()
            return out

        packer = Packer(emit, TaskContext.get().partitionId() << 33, window)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                names, texts = (batch.column(c).slice(at, 256).to_pylist() for c in (0, 1))
                for name, found in zip(names, ids([t or "" for t in texts]), strict=True):
                    whole = found + end
                    packer.add((name, len(whole) // 4), whole)
                if len(rows[0]) > 4096:
                    yield drain()
        packer.close()
        yield drain()
        ids.forget()  # a worker goes on to other stages

    return docs.select(F.col(doc).cast("long"), F.col(text)).mapInArrow(run, SCHEMA if with_ids else SCHEMA.rpartition(", ")[0])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
