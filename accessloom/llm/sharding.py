"""Sharding by extendible hashing.

A directory maps hash prefixes to shards. A bucket splits on the next bit of the hash only while its bytes
exceed the limit, so each shard ends at the shallowest prefix that fits, and shards differ in depth.

The buckets' sizes come from one histogram at a depth somewhat beyond the even one, rolled up to every
shallower depth; documents in cells that are still too large take part in another round over further bits.
The hash is of (doc_id, text). Rows equal in both can't be told apart by it, so beyond its 64 bits the path
goes on with a hash of the row's place in the table. A document larger than the limit is a shard of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, cut, table, written

LIMIT = 64 << 20
#: Bits of the first histogram beyond log2(total / limit), and bits that each further round adds.
EXTRA, STEP = 4, 8
BITS = 128


def _prefix(depth: int) -> Column:
    """The first `depth` bits of the path, as a string of 0 and 1."""
    return F.substring("_path", 1, depth)


def _path() -> Column:
    bits = lambda h: F.lpad(F.bin(h), 64, "0")
    return F.concat(bits(F.col("_h")), bits(F.xxhash64(F.col("_at"))))


def directory(rows: DataFrame, limit: int, total: int) -> DataFrame:
    """Shards (shard, depth, shard_bytes, shard_docs) of rows with `_h`, `_at` and `bytes`, none beyond the limit unless its rows agree in all bits."""
    depth, low = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + EXTRA), 0
    left, found = rows.withColumn("_path", _path()), []
    while True:
        cells = left.groupBy(_prefix(depth).alias("cell")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        levels = cells.select(F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("depth"), "cell", "b", "n")
        sums = levels.groupBy("depth", F.expr("substring(cell, 1, depth)").alias("shard")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        # A prefix is a shard if it fits and the prefix one bit shorter doesn't; at the last bit there is no other choice.
        parents = sums.select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("_parent"), (F.col("shard_bytes") > limit).alias("_split"))
        sums = sums.withColumn("_parent", F.expr("substring(shard, 1, depth - 1)")).join(parents, ["depth", "_parent"], "left")
        top = (F.col("depth") == low) if low == 0 else F.lit(False)
        over = sums.where(F.coalesce("_split", top) | ((F.col("depth") == low) & F.lit(low > 0)))
        over = cut(over.select("shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | F.lit(depth == BITS)
        found.append(over.where(fits & ((F.col("depth") > low) | F.lit(low == 0))))
        heavy = over.where((F.col("depth") == depth) & ~fits).select(F.col("shard").alias("_heavy"))
        if heavy.isEmpty():
            break
        left = cut(left.join(heavy, _prefix(depth) == F.col("_heavy"), "left_semi"))
        low, depth = depth, min(BITS, depth + STEP)
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out


def _marked(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.withColumns({"bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "_h": F.xxhash64(doc, text), "_at": F.monotonically_increasing_id()})


def _placed(rows: DataFrame, marks: DataFrame, limit: int) -> DataFrame:
    """Rows with shard, depth and shard_bytes, by the directory of `marks` (the same rows, narrow, at a cut point)."""
    fitting = marks.where(F.col("bytes") <= limit)
    shards = cut(directory(fitting, limit, fitting.agg(F.sum("bytes")).head()[0] or 0)).select("shard", "depth", "shard_bytes")
    depths = [r[0] for r in shards.select("depth").distinct().orderBy("depth").collect()]
    rows = rows.withColumn("_path", _path())
    tries = F.array(*[_prefix(d) for d in depths]) if depths else F.array(F.lit(""))
    small = rows.where(F.col("bytes") <= limit).withColumn("shard", F.explode(tries)).join(shards, "shard")
    alone = rows.where(F.col("bytes") > limit).withColumns({"shard": F.concat(F.lit("alone-"), "_path"), "depth": F.lit(BITS), "shard_bytes": F.col("bytes")})
    return small.unionByName(alone).drop("_path", "_h", "_at")


def shard(docs: DataFrame, limit: int = LIMIT, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes): the shard (a hash prefix) of every row; one row per input row.

    Nulls: a null text has no bytes; null doc_ids hash by their text. Repeated rows may part ways, which leaves the
    shards' sizes as they are; which of them goes where is a tie that their places in the table settle. A text longer than
    the limit has a shard to itself. An empty table gives no rows. Other columns aren't returned; `write` keeps them.
    """
    marks = cut(_marked(docs, doc, text).select(F.col(doc).alias("doc_id"), "bytes", "_h", "_at"))
    return _placed(marks, marks, limit).select("doc_id", "bytes", "shard", "depth", "shard_bytes")


def write(docs: DataFrame, path: str, limit: int = LIMIT, doc: str = "doc_id", text: str = "text") -> None:
    """Writes every row with all its columns into its shard's folder, each by one task: none is larger than the limit.

    Marked rows are written before, so that a row has the same place for the directory as when it is dealt. Columns named
    bytes, shard, depth and shard_bytes are left out.
    """
    docs, back = aside(docs.drop("bytes", "shard", "depth", "shard_bytes"), "_h", "_at", "_path")
    whole = written(_marked(docs, doc, text), "marked")
    marks = whole.select("bytes", "_h", "_at")
    back(_placed(whole, marks, limit).drop("bytes", "depth", "shard_bytes")).repartition("shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
