"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its `PREFIX` nearest reference points (pivots), nearest first; near-duplicates have nearly the
same. A pair is a candidate if the two share at least `SHARED` of these pivots and each one's nearest is among the other's;
candidates are verified by cosine in double precision.

The inverted lists hold the vectors that have a pivot among their nearest. A pair's first shared pivot (by number) is one
of the first `PREFIX - SHARED + 1` of both, so only these are listed. A list of more than `BLOCK` vectors is split by a
further pivot, up to `SHARED` of them; lists that are still larger are dealt as pairs of blocks, so no task holds a whole
large list. Within a list shared pivots are counted for every pair, on bits, and a pair counts only in the list that is
named by its first shared pivots. So no list of pairs is kept: each list adds up link counts and a spanning forest. Lists
carry ids and pivots; a vector is fetched once for each block it is in. Equal vectors enter once, with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, written
from .components import components
from .groups import forest, run_bounds, whole_runs

#: Pivots, nearest ones that describe a vector, and how many a pair must share.
PIVOTS, PREFIX, SHARED = 128, 7, 3
#: Pivots are taken from this many vectors (those whose hash comes first), none nearer than APART to another: pivots
#: within one cluster would rank at random for its members.
SAMPLE, APART = 1024, 0.6
COSINE = 0.98
#: Members of a list that are compared at once.
BLOCK = 1024


def _valid(vector: str, label: str) -> F.Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(label).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Directions; scaled by the largest component first, so that squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def spread(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Up to `pivots` directions of the sample, in its order, each below APART to those before; if few are, the rest fill up."""
    chosen, rest = np.zeros((0, sample.shape[1])), []
    for v in sample:
        if len(chosen) < pivots:
            if (chosen @ v < APART).all():
                chosen = np.vstack([chosen, v])
            else:
                rest.append(v)
    return np.vstack([chosen, *rest[: max(0, PREFIX - len(chosen))]])


def described(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each vector's nearest pivots, nearest first."""
    return np.argsort(-(_unit(vectors) @ pivots.T), axis=1, kind="stable")[:, :prefix]


def _described(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], prefix: int) -> Iterator[pa.RecordBatch]:
    """(label, dim, rep, near): each vector's nearest pivots, a byte each."""
    for batch in batches:
        dims = pc.list_value_length(batch.column("vector")).to_numpy()
        for dim in np.unique(dims):
            rows = batch.filter(pa.array(dims == dim))
            points = pivots[int(dim)]
            near = described(_matrix(rows.column("vector")), points, min(prefix, len(points)))
            packed = pa.array([p.tobytes() for p in near.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("label"), pa.array(dims[dims == dim], pa.int32()), rows.column("rep"), packed], names=["label", "dim", "rep", "near"])


def _posted(batches: Iterator[pa.RecordBatch], level: int, shared: int) -> Iterator[pa.RecordBatch]:
    """Each row's postings one level further down. `named` holds the pivots of a list, plus one, in base 257; `last` is the place of the last in the row's own."""
    for batch in batches:
        label, dim, rep, near = (batch.column(c) for c in ("label", "dim", "rep", "near"))
        named, last = (batch.column(c).to_numpy() for c in ("named", "last"))
        widths = pc.binary_length(near).to_numpy()
        for width in np.unique(widths):
            mine = np.flatnonzero(widths == width)
            sets = np.sort(np.frombuffer(b"".join(near.take(pa.array(mine)).to_pylist()), np.uint8).reshape(len(mine), width), axis=1).astype(np.int64)
            need = min(shared, int(width))
            for at in range(width - need + level + 1 if level < need else 0):
                some = np.flatnonzero(last[mine] < at)
                take = pa.array(mine[some])
                key = named[mine[some]] * 257 + sets[some, at] + 1
                yield pa.RecordBatch.from_arrays([label.take(take), dim.take(take), rep.take(take), near.take(take), pa.array(key), pa.array(np.full(len(some), at))], names=["label", "dim", "rep", "near", "named", "last"])


POSTING = "label string, dim int, rep long, near binary, named long, last long"


def _bits(numbers: np.ndarray) -> np.ndarray:
    """Rows of small numbers as sets: four words of 64 bits."""
    out = np.zeros((len(numbers), 4), np.uint64)
    for column in numbers.T.astype(np.int64):
        out[np.arange(len(numbers)), column >> 6] |= np.uint64(1) << (column & 63).astype(np.uint64)
    return out


def _names(named: int) -> list[int]:
    out = []
    while named:
        named, pivot = divmod(named, 257)
        out.append(pivot - 1)
    return out[::-1]


def _candidates(a: np.ndarray, b: np.ndarray, nearest_a: np.ndarray, nearest_b: np.ndarray, names: list[int], need: int) -> np.ndarray:
    """Of all pairs of a with b: those that share enough pivots, hold each other's nearest, and whose first shared pivots name the list."""
    own = _bits(np.array([names]))[0]
    upto = _bits(np.arange(names[-1] + 1)[None, :])[0]
    count, good = np.zeros((len(a), len(b)), np.uint8), np.ones((len(a), len(b)), bool)
    holds, held = np.zeros_like(good), np.zeros_like(good)
    for w in range(4):
        both = a[:, w, None] & b[None, :, w]
        count += np.bitwise_count(both)
        good &= (both & upto[w]) == own[w]
        holds |= (nearest_a[:, w, None] & b[None, :, w]) != 0
        held |= (a[:, w, None] & nearest_b[None, :, w]) != 0
    return good & holds & held & (count >= need)


def _verified(batches: Iterator[pa.RecordBatch], cosine: float, shared: int) -> Iterator[pa.RecordBatch]:
    """(rep, n, root): of each list's (or pair of blocks') links, a member's number of them, copies counted, and a member it is linked to.

    Rows come sorted by task; of two blocks those with `side` 0 are compared with those with 1, and within a list or block all.
    """
    for rows in whole_runs(batches, "task"):
        column = rows.column("task")
        tasks = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
        codes = tasks.indices.to_numpy(zero_copy_only=False)
        starts, lengths = run_bounds(codes)
        reps, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        sides, lists = rows.column("side").to_numpy(), rows.column("named").to_numpy()
        vectors, nears = rows.column("vector"), rows.column("near")
        out: list[list[np.ndarray]] = [[], [], []]
        for start, length in zip(starts[lengths > 1], lengths[lengths > 1], strict=True):
            here = slice(start, start + length)
            near = np.frombuffer(b"".join(nears.slice(start, length).to_pylist()), np.uint8).reshape(length, -1)
            sets, nearest, side = _bits(near), _bits(near[:, :1]), sides[here]
            unit, names, need = None, _names(int(lists[start])), min(shared, near.shape[1])
            counts, x, y = np.zeros(length, np.int64), [], []
            for at in range(0, length, 256):
                part = slice(at, min(at + 256, length))
                linked = _candidates(sets[part], sets, nearest[part], nearest, names, need)
                if side.any():
                    linked &= side[part, None] != side[None, :]
                linked[np.arange(part.stop - at), np.arange(at, part.stop)] = False
                if not linked.any():
                    continue
                unit = _unit(_matrix(vectors.slice(start, length))) if unit is None else unit
                linked &= unit[part] @ unit.T >= cosine
                counts[part] = linked @ copies[here]
                i, j = np.nonzero(linked)
                x.append(i + at)
                y.append(j)
            if not x:
                continue
            roots = forest(length, np.concatenate(x), np.concatenate(y))
            some = counts > 0
            out[0].append(reps[here][some])
            out[1].append(counts[some])
            out[2].append(reps[here][roots[some]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["rep", "n", "root"])


def near_vectors(rows: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", pivots: int = PIVOTS, prefix: int = PREFIX, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row; only vectors of equal label and dimension are compared.

    Vectors that are null, zero, or hold null or non-finite components, and those with a null label, link with
    nothing. Repeated rows link with each other; with a null key a row counts as a link but names no component. An empty
    table gives no rows; other columns are ignored. The pivots are a bounded sample, up to 256; every vector is indexed.
    """
    if pivots > 256 or not 0 < shared <= 7:
        raise ValueError("at most 256 pivots, of which up to 7 must be shared")
    base = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("string").alias("label"))
    valid = base.where(_valid("vector", "label"))
    whole = valid.groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    # A representative is named by a hash of what it stands for, so null and repeated ids do no harm.
    whole = written(whole.withColumn("rep", F.xxhash64("label", "vector")), "vectors")
    drawn = Window.partitionBy("dim").orderBy(F.xxhash64("vector", F.lit("pivot")), "rep")
    sample = whole.withColumn("dim", F.size("vector")).withColumn("_n", F.row_number().over(drawn)).where(F.col("_n") <= SAMPLE).select("dim", "vector").collect()
    points = {dim: spread(_unit(np.array([r["vector"] for r in sample if r["dim"] == dim])), pivots) for dim in {r["dim"] for r in sample}}
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    root = [F.lit(0).cast("long").alias("named"), F.lit(-1).cast("long").alias("last")]
    listed = written(whole.mapInArrow(lambda b: _described(b, points, prefix), "label string, dim int, rep long, near binary"), "described").select("*", *root)
    lists, dealt = ["named", "label", "dim"], []
    for level in range(shared):
        posted = written(listed.mapInArrow(lambda b, level=level: _posted(b, level, shared), POSTING), "postings")
        sizes = cut(posted.groupBy(*lists).agg(F.count("*").alias("size")).where("size > 1"))
        small = posted.join(sizes.where(F.col("size") <= block), lists)
        dealt.append(small.select("rep", "near", "named", F.concat_ws(":", *lists[:1], "dim", "label").alias("task"), F.lit(0).cast("long").alias("side")))
        crowded = sizes.where(F.col("size") > block)
        if crowded.isEmpty():
            break
        if level < shared - 1:
            # Vectors of few dimensions may have fewer pivots than a list can be split by; such lists are dealt as they are.
            shallow = F.octet_length("near") <= level + 1
            listed = posted.join(crowded.drop("size"), lists, "left_semi").where(~shallow)
        else:
            shallow = F.lit(True)
        listed_large = posted.where(shallow).join(crowded, lists)
        listed_large = listed_large.withColumn("_blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("_mine", F.pmod("rep", "_blocks").cast("int"))
        others = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least(o, F.col("_mine")).alias("x"), F.greatest(o, F.col("_mine")).alias("y"), F.when(F.col("_mine") > o, 1).otherwise(0).alias("side")))
        pairs = listed_large.withColumn("_p", F.explode(others))
        dealt.append(pairs.select("rep", "near", "named", F.concat_ws(":", "named", "dim", "_p.x", "_p.y", "label").alias("task"), F.col("_p.side").cast("long").alias("side")))
    tasks = reduce(DataFrame.union, dealt).join(whole.select("rep", "copies", "vector"), "rep")
    tasks = tasks.select("task", "named", "rep", "copies", "vector", "near", "side").repartition(parts, "task").sortWithinPartitions("task", "rep")
    found = written(tasks.mapInArrow(lambda b: _verified(b, cosine, shared), "rep long, n long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    members = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = whole.select("rep", "copies", "first").join(members, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    # Cut, so that a component with many members can be split in the join.
    least = cut(classes.groupBy("component").agg(F.min("first").alias("component_id")))
    named = classes.join(least, "component").join(counts, "rep", "left").select("rep", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    marked = base.select("vec_id", F.when(_valid("vector", "label"), F.xxhash64("label", "vector")).alias("rep"))
    out = marked.join(named, "rep", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
