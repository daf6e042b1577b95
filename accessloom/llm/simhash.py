"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most d bits differ in at most d bytes, so
they share at least 8 - d positional bytes: the guaranteed minimum. The index lists, for a position and its byte, the
fingerprints that have it. A pair's first shared position is one of the first d + 1, so only these are posted. Within
a list the tally of shared positional bytes is counted for every pair; pairs that reach the minimum are verified by
their differing bits.

A list of more than `LIST` members is split by a further position and its byte, beyond those it is named by, and so on
until the minimum is reached; then by half bytes in the same way, of which the rest of two linked fingerprints must
share as many as there are bits to differ. No list is compared by another rule, and no link is lost. A list split to the
end holds fingerprints that differ in `distance` half bytes at most, so at most 65,536 for four bits.

Equal fingerprints enter once. A list emits a spanning forest of its links and never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alike
from .common import aside, table, written
from .components import components
from .groups import forest, run_bounds, whole_runs

BYTES, DISTANCE = 8, 4
WIDTH, SEED = 4, 42
#: Members from which on a list is split further, and members up to which lists are compared side by side.
LIST, SHORT = 1024, 16
#: Shingles hashed at a time.
CHUNK = 1 << 16
KEY = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | bytes, width: int = WIDTH) -> int:
    """A bit is set if it is set in over half of the shingles' hashes. Bytes are taken as they are, UTF-8 or not."""
    words = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    words = words.lower().split()  # bytes: only A-Z, and only ASCII white space
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    total, counts, digest = 0, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    while part := [digest(s, SEED) for _, s in zip(range(CHUNK), shingles)]:
        hashes = np.array(part, dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = WIDTH) -> DataFrame:
    """The columns `keep` and `fp`, the fingerprint as a signed 64-bit value. A null text has fingerprint zero."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.large_binary())  # Spark doesn't check that strings are UTF-8
            found = np.array([fingerprint(t.as_py() or b"", width) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, F.col(text).alias("_text_")).mapInArrow(run, schema)


def _free_halves() -> np.ndarray:
    """Numbers of the half bytes outside of a mask of bytes, ascending, for each mask."""
    out = np.zeros((256, 2 * BYTES), np.int64)
    for mask in range(256):
        free = [2 * b + h for b in range(BYTES) if not mask >> b & 1 for h in (0, 1)]
        out[mask, : len(free)] = free
    return out


def _posted(batches: Iterator[pa.RecordBatch], level: int, distance: int) -> Iterator[pa.RecordBatch]:
    """(list, named, last, fp): each row's postings one level further down.

    `named` are the bytes that the list is named by and `last` the last place of the current kind. The list of the n-th
    place is sought among the first distance + n, as the first n shared ones of two linked fingerprints lie there.
    """
    whole, free = BYTES - distance, _free_halves()
    for batch in batches:
        lists, named, last, fps = (batch.column(c).to_numpy().astype(np.int64) for c in ("list", "named", "last", "fp"))
        out = []
        n = level if level < whole else level - whole
        for at in range(distance + n + 1):
            some = last < at
            if level < whole:
                place, bits = np.full(some.sum(), at), 8
            else:
                place, bits = free[named[some], at], 4
            value = fps[some] >> place * bits & (1 << bits) - 1
            key = (lists[some].view(np.uint64) * KEY ^ (place << 8 | value).astype(np.uint64)) * KEY
            out.append((key ^ key >> np.uint64(29), named[some] | (1 << place if level < whole else 0), np.full(some.sum(), -1 if level == whole - 1 else at), fps[some]))
        columns = [np.concatenate(c).astype(np.uint64).view(np.int64) if i == 0 else np.concatenate(c).astype(np.int64) for i, c in enumerate(zip(*out, strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["list", "named", "last", "fp"])


POSTING = "list long, named long, last long, fp long"


def tallies(differing: np.ndarray) -> np.ndarray:
    """Number of shared positional bytes, from the differing bits: bytes that are zero."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return np.bitwise_count(~((differing & low) + low | differing | low))


def _linked(a: np.ndarray, b: np.ndarray, need: int, distance: int) -> tuple[np.ndarray, ...]:
    """Places of the pairs whose tally reaches the minimum and whose differing bits are few enough."""
    differing = a ^ b
    counted = np.nonzero(tallies(differing) >= need)
    near = np.bitwise_count(differing[counted]) <= distance
    return tuple(c[near] for c in counted)


def _verified(batches: Iterator[pa.RecordBatch], need: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that span each list's links; rows come sorted by list."""
    for rows in whole_runs(batches):
        lists, fps = rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(np.int64).view(np.uint64)
        starts, lengths = run_bounds(lists)
        short = np.repeat(lengths <= SHORT, lengths)
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for step in range(1, min(SHORT, len(fps))):
            at = np.flatnonzero((lists[:-step] == lists[step:]) & short[:-step])
            (near,) = _linked(fps[at], fps[at + step], need, distance)
            a.append(fps[at[near]])
            b.append(fps[at[near] + step])
        for start, length in zip(starts[lengths > SHORT], lengths[lengths > SHORT], strict=True):
            members = fps[start : start + length]
            found = [_linked(members[i : i + 64, None], members[None, i:], need, distance) for i in range(0, length, 64)]
            x = np.concatenate([f[0] + i * 64 for i, f in enumerate(found)])
            y = np.concatenate([f[1] + i * 64 for i, f in enumerate(found)])
            root = forest(length, x, y)
            child = np.flatnonzero(root != np.arange(length))
            a.append(members[child])
            b.append(members[root[child]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (a, b)], names=["a", "b"])


def links(distinct: DataFrame, distance: int = DISTANCE, largest: int = LIST) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints `fp` linked at up to `distance` bits, directly or by others."""
    if not 0 < distance < BYTES:
        raise ValueError("the index needs a positional byte that all links share, and a bit that may differ")
    need, levels = BYTES - distance, BYTES
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.select(F.lit(0).cast("long").alias("list"), F.lit(0).cast("long").alias("named"), F.lit(-1).cast("long").alias("last"), "fp")
    edges = []
    for level in range(levels):
        # Each fingerprint becomes many postings, so these are dealt by a number that isn't set by the fingerprints' few bytes.
        posted = written(rows.repartition(parts).mapInArrow(lambda b, level=level: _posted(b, level, distance), POSTING), "postings")
        crowded = written(posted.groupBy("list").count().where(F.col("count") > (largest if level < levels - 1 else 1 << 62)).select("list"), "crowded")
        split = not crowded.isEmpty()
        whole = posted.join(crowded, "list", "left_anti") if split else posted
        dealt = whole.select("list", "fp").repartition(parts, "list").sortWithinPartitions("list", "fp")
        edges.append(written(dealt.mapInArrow(lambda b: _verified(b, need, distance), "a long, b long").distinct(), "links"))
        if not split:
            break
        rows = posted.join(crowded, "list", "left_semi")
    return reduce(DataFrame.union, edges)


def _classes(distinct: DataFrame, distance: int) -> DataFrame:
    """(fp, first, component) of distinct fingerprints."""
    members = components(links(distinct, distance))
    return distinct.join(members, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): each row's fingerprint and the smallest doc_id reachable by links, its own included.

    One row per input row. Null and empty texts have fingerprint zero and link like any other; null doc_ids take part
    and get the component of their fingerprint (null only if all its doc_ids are null); repeated rows share it; texts of
    any length are read whole, by their bytes where these aren't UTF-8; an empty table gives no rows; other columns are ignored.
    """
    marked = written(fingerprints(docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")), ["doc_id"], width=width), "fingerprints")
    classes = written(_classes(written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct"), distance), "classes")
    # Written, so that a component or fingerprint with many members can be split in the joins.
    least = written(classes.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    named = classes.join(least, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def rows_of_first(docs: DataFrame, named: DataFrame, classes: DataFrame) -> DataFrame:
    """The row of `docs` at each class's `first`, once; `named` is docs with its places."""
    kept = written(classes.select(F.col("first._doc_").alias("_d"), F.col("first._hash_").alias("_t")), "kept")
    stay = named.join(kept.hint("shuffle_hash"), F.col("_doc_").eqNullSafe(F.col("_d")) & (F.col("_hash_") == F.col("_t")), "left_semi")
    once = stay.groupBy("_doc_", "_hash_").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_whole_"))
    return once.select("_whole_.*")


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, distance: int = DISTANCE, similarity: tuple[int, int] | None = None) -> DataFrame:
    """One row of each group of near-duplicates: the smallest doc_id (null last), of several rows the first by the text's hash and then by all columns.

    `similarity` links by the Jaccard similarity of shingle sets, so many of so many, instead of by `distance`: links at
    that distance are then candidates, which are verified on the sets, and as such texts may differ in more bits than the positional bytes
    can vouch for, the others are sought as told in `alike`. Null and empty texts are alike;
    texts of any length are read whole; an empty table gives no rows; other columns pass through, whatever their names.
    """
    docs, back = aside(docs, "_hash_", "_doc_", "_d", "_t", "_whole_")
    named = docs.withColumn("_hash_", F.xxhash64(text)).withColumn("_doc_", F.col(doc).cast("long"))
    if similarity:
        return back(rows_of_first(docs, named, alike.classes(docs, named, text, width, similarity, distance=distance)))
    light = fingerprints(named.select("_doc_", "_hash_", F.col(text).alias("text")), ["_doc_", "_hash_"], width=width)
    marked = written(light, "fingerprints")
    place = F.struct(F.col("_doc_").isNull().alias("unnamed"), "_doc_", "_hash_")
    distinct = written(marked.groupBy("fp").agg(F.min(place).alias("first")), "distinct")
    return back(rows_of_first(docs, named, _classes(distinct, distance).groupBy("component").agg(F.min("first").alias("first"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
