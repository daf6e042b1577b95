"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch holds the k smallest distinct hashes of a text's five-word shingles, ascending. Sketches merge by
taking the k smallest of both, so a text's parts, or a group's texts, can be sketched apart. Two sketches
estimate resemblance and containment of the shingle sets, one sketch their number; below k shingles all of
these are exact.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import aside, table, text_or_empty

K = 256
WIDTH = 5
#: Bytes by which texts are weighed for being dealt.
PORTION = 4096
SPACE = r"[\x20\x09-\x0D]+"


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all shingles of lower-cased words; a text of fewer words is one shingle, one of none has none."""
    words = F.transform(F.array_remove(F.split(F.lower(text), SPACE), ""), lambda w: F.xxhash64(w))
    each = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
    # Bound as a lambda's variable, the words are computed once and not for every shingle.
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, each(w)).otherwise(F.array().cast("array<bigint>"))), 0)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The bottom-k sketch of a text; null is an empty text."""
    return bottom_k(shingle_hashes(F.coalesce(text, F.lit("")), width), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of both shingle sets."""
    return bottom_k(F.concat(a, b), k)


def _common(a: Column, b: Column, k: int) -> Column:
    """Number of hashes of the union's sketch that are in both sets."""
    return F.size(F.array_intersect(F.array_intersect(a, b), merge(a, b, k)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all; 1 for two empty sets."""
    union = F.size(merge(a, b, k))
    return F.when(union == 0, F.lit(1.0)).otherwise(_common(a, b, k) / union)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: k - 1 over the share of the hash range up to the k-th."""
    part = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that are in b; 1 for an empty a."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def encoded(a: Column) -> Column:
    """A sketch as text: its hashes, eight bytes each, in base64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def decoded(a: Column) -> Column:
    digits = F.hex(F.unbase64(a))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 16).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substr(digits, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))


def merge_groups(sketches: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key's rows. The k smallest are ranked before and after the shuffle, so no group meets whole."""
    each = sketches.select(key, F.explode(column).alias("_h")).distinct()
    ranked = each.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_h"))).where(F.col("_n") <= k)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("_h")).alias(column))


def _bucket(value: Column, splits: list[int]) -> Column:
    """Number of splits below the value, found in two steps of about sqrt(n) comparisons."""
    if not splits:
        return F.lit(0)
    step = math.isqrt(len(splits)) + 1
    blocks = [splits[i : i + step] for i in range(0, len(splits), step)]
    fine = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    block = F.size(F.filter(F.array(*[F.lit(b[-1]) for b in blocks]), lambda s: s < value))
    return F.least(block * step + F.size(F.filter(F.coalesce(F.get(fine, block), F.array().cast("array<bigint>")), lambda s: s < value)), F.lit(len(splits)))


def dealt_apart(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n shuffle partitions that goes there by its hash, so that as many ranges don't meet by chance."""
    number = F.col("id").cast("int")
    found = dict(spark.range(32 * n).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("at")).agg(F.min(number)).collect())
    return [found.get(i, -1 - i) for i in range(n)]


def with_next(docs: DataFrame, add: dict[str, Column], following: dict[str, str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds to each document the text of the next one in descending doc_id (`next_text`; after the last: the first).

    `add` are columns computed from a row with its next text; `following` maps new names to columns whose
    value in the next row they take. Documents are dealt by ranges of doc_id of about as many bytes each, in one shuffle
    of the texts: each range gets, besides its own, a copy of the first row of the range that follows. The ranges' ends and
    first rows are the only values brought to the driver or broadcast, as many as there are shuffle partitions.

    Ties in doc_id are ordered by text, and null doc_ids come last. Null texts are taken as they are; texts may be empty
    or of any length; of repeated rows each is the next of the one before; an empty table gives no rows; columns pass
    through, whatever their names, but for those added.
    """
    spark = docs.sparkSession
    docs, back = aside(docs.drop("next_text", *add, *following), "_b", "_d", "_to", "_guest", "_first")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fractions = [i / n for i in range(1, n)]
    # A text counts once for each PORTION of its bytes.
    weighed = docs.select(doc, F.explode(F.array_repeat(F.lit(0), (F.coalesce(F.octet_length(text), F.lit(0)) / PORTION).cast("int") + 1)))
    ends = weighed.agg(F.percentile_approx(doc, fractions, 20 * n)).head()[0] if fractions else None
    splits = sorted(set(ends or []))
    keys = dealt_apart(spark, n)
    own = F.when(F.col(doc).isNull(), F.lit(0)).otherwise(_bucket(F.col(doc), splits))
    firsts = sorted((r[0], r[1]) for r in docs.select(doc, own.alias("_b")).groupBy("_b").agg(F.max(doc)).collect())
    assert bisect_left(splits, 1 << 63) == len(splits)
    guests = [(first, firsts[i + 1][0] if i + 1 < len(firsts) else firsts[0][0]) for i, (_, first) in enumerate(firsts)]
    guests = spark.createDataFrame(guests, "_first bigint, _to int")
    dealt = docs.join(F.broadcast(guests), F.col(doc).eqNullSafe(F.col("_first")), "left").drop("_first")
    mine = F.struct(own.alias("b"), F.lit(False).alias("guest"))
    dealt = dealt.withColumn("_d", F.explode(F.when(F.col("_to").isNull(), F.array(mine)).otherwise(F.array(mine, F.struct(F.col("_to").alias("b"), F.lit(True).alias("guest"))))))
    dealt = dealt.withColumns({"_b": F.element_at(F.array(*map(F.lit, keys)), F.col("_d.b") + 1), "_guest": F.col("_d.guest")}).drop("_d", "_to")
    order = Window.partitionBy("_b").orderBy("_guest", F.col(doc).desc_nulls_last(), text)
    dealt = dealt.withColumn("next_text", F.lead(text).over(order)).withColumns(add)
    return back(dealt.withColumns({k: F.lead(v).over(order) for k, v in following.items()}).where(~F.col("_guest")).drop("_b", "_guest"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third (in code points, rounded down) replaced by as much of the following text's start."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    changed = edited(F.col("text"), F.coalesce(F.col("next_text"), F.lit("")))
    add = {"edited": changed, "sketch": sketch(F.col("text"))}
    found = with_next(docs, add, {"next_sketch": "sketch"}).withColumn("edited_sketch", sketch(F.col("edited")))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        encoded(F.col("sketch")).alias("fingerprint"),
        encoded(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
