"""Line deduplication over the whole corpus by a deletion-neighbourhood join.

Lines are compared by their lower-cased words. Of equal lines the earliest stays. Lines of at least `least` words are
also compared within one edit (a word put in, left out or replaced): every line is expanded into its variants with one
word left out, each a hashed key; lines within one edit meet in a variant, the edit distance is verified on their words,
and the earliest stays. `least` is part of what counts as a repeat: five words, as one edit in a shorter line leaves
less than 80 % of it (any two lines of one word are within one edit).

A key knows which word was left out. Lines of one length that lose the same word to the same key differ in just
that word; a line that equals another's variant is that line less a word. So each line is only paired with the
earliest of its key, and a line that thousands share costs no pairs. Variants are emitted for those lines that can
have a partner: within one edit, two lines have the first or the last half of the shorter one in common. Only these are read
a second time with their words: a sieve of their hashes, of which an unasked line passes one in sixteen at most, goes to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, cut, give_back, table, written

#: Words from which lines are compared within one edit; in shorter ones one edit changes more than a fifth.
LEAST = 5
PLACE = ["doc", "text_hash", "line"]
#: Bits of a sieve for each line asked for, at least, and the power of two of pieces it is made in.
SIEVE, PIECES = 16, 6


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(words: list[str], seed: int = 0) -> int:
    return _signed(xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"), seed))


def _wide(line: str) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return _signed(digest >> 64), _signed(digest & (1 << 64) - 1)


def halves(words: list[str]) -> list[int]:
    """Keys of which two lines within one edit share one: the first and last floor(m / 2) words, for m the line's length and one less."""
    n = len(words)
    return [_hash([side, str(m), *(words[:m] if side == "<" else words[n - m :])]) for m in {n // 2, (n - 1) // 2} for side in "<>"]


def variants(words: list[str]) -> list[tuple[int, int]]:
    """(key, place left out) of the line less each of its words, and of the line itself with place -1."""
    return [(_hash(words), -1), *((_hash(words[:i] + words[i + 1 :]), i) for i in range(len(words)))]


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one word put in, left out or replaced turns a into b, or they are equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    most = min(len(a), len(b))
    start = next((i for i in range(most) if a[i] != b[i]), most)
    end = next((i for i in range(most - start) if a[-1 - i] != b[-1 - i]), most - start)
    return max(len(a), len(b)) - start - end <= 1


def _keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.withColumn("text_hash", F.xxhash64(text)).withColumn("doc", F.col(doc).cast("long"))


def _sieve(asked: DataFrame) -> tuple[int, bytes]:
    """(b, bits): one of 2^b bits is set for the first b bits of each h1 asked for, so a line whose bit isn't set isn't asked for."""
    b = max(2 * PIECES, (SIEVE * asked.count()).bit_length())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - b)
            of = at >> np.uint64(b - PIECES)
            for piece in np.unique(of).tolist():
                bits = held.setdefault(piece, np.zeros(1 << b - PIECES, bool))
                bits[(at[of == piece] & np.uint64((1 << b - PIECES) - 1)).astype(np.int64)] = True
        packed = [np.packbits(x, bitorder="little").tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], names=["piece", "bits"])

    dealt = asked.select("h1").repartition(F.shiftrightunsigned("h1", 64 - PIECES))
    size = (1 << b - PIECES) // 8
    out = bytearray(size << PIECES)
    for row in dealt.mapInArrow(pieces, "piece int, bits binary").collect():
        out[row.piece * size : (row.piece + 1) * size] = row.bits
    return b, bytes(out)


def _hashed(batches: Iterator[pa.RecordBatch], least: int, sieve: tuple[int, bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each line with words: its hash and place, with the keys of its halves; with a sieve, for each line of `least` words that it holds, with its words."""
    texts = sieve is not None
    b, bits = sieve or (0, b"")
    for batch in batches:
        docs, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(0, len(docs), 256):
            out: list[list] = [[] for _ in range(6)]
            for doc, text_hash, text in zip(docs[at : at + 256], hashes[at : at + 256], batch.column(2).slice(at, 256).to_pylist(), strict=True):
                for number, line in enumerate((text or "").split("\n")):
                    words = line.lower().split()
                    if words and (not texts or len(words) >= least):
                        joined = " ".join(words)
                        h1, h2 = _wide(joined)
                        if texts:
                            bit = (h1 & (1 << 64) - 1) >> 64 - b
                            if not bits[bit >> 3] >> (bit & 7) & 1:
                                continue
                        last = joined if texts else halves(words) if len(words) >= least else []
                        for column, value in zip(out, (h1, h2, doc, text_hash, number, last), strict=True):
                            column.append(value)
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.string() if texts else pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["h1", "h2", *PLACE, "words" if texts else "halves"])
    give_back()


def _place() -> F.Column:
    """Earliest first: by doc_id (null last), then the text's hash, then the line's number."""
    return F.struct(F.col("doc").isNull().alias("unnamed"), *PLACE)


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            keys, places, ranks = [], [], []
            for rank, line in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for key, place in variants(line.split(" ")):
                    keys.append(key)
                    places.append(place)
                    ranks.append(rank)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(ranks, pa.int64())], names=["key", "out", "rank"])
    give_back()


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [within_one(a.split(" "), b.split(" ")) for a, b in zip(batch.column("words").to_pylist(), batch.column("other").to_pylist(), strict=True)]
        yield batch.select(["h1", "h2"]).filter(pa.array(near, pa.bool_()))


def near_lines(docs: DataFrame, distinct: DataFrame, least: int) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line within one edit."""
    keys = distinct.select("h1", F.explode("halves").alias("half"))
    met = keys.groupBy("half").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x != y").select("half")
    some = keys.join(met, "half").select("h1").distinct()
    asked = written(distinct.select("h1", "h2", "first.*").drop("unnamed").join(some, "h1"), "asked")
    sieve = _sieve(asked)
    spelled = docs.select("doc", "text_hash", "_text_").mapInArrow(lambda b: _hashed(b, least, sieve), "h1 long, h2 long, doc long, text_hash long, line int, words string")
    same = [spelled[c].eqNullSafe(asked[c]) if c == "doc" else spelled[c] == asked[c] for c in ("h1", "h2", *PLACE)]
    lines = spelled.join(asked.hint("shuffle_hash"), same).select(asked["h1"], asked["h2"], asked["doc"], asked["text_hash"], asked["line"], "words").dropDuplicates(["h1", "h2"])
    order = [F.col("doc").asc_nulls_last(), F.col("text_hash"), F.col("line")]
    lines = written(lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), "lines")
    each = written(lines.select("rank", "words").mapInArrow(_expanded, "key long, out int, rank long"), "variants")
    first = each.groupBy("key", "out").agg(F.min("rank").alias("same"), F.count("*").alias("n"))
    by_key = first.groupBy("key").agg(F.min(F.when(F.col("out") < 0, F.col("same"))).alias("whole"), F.min(F.when(F.col("out") >= 0, F.col("same"))).alias("longer"), F.sum("n").alias("n")).where("n > 1").drop("n")
    pairs = each.join(by_key, "key").join(first.drop("n"), ["key", "out"])
    earlier = F.filter(F.array(F.when(F.col("out") < 0, F.col("longer")).otherwise(F.col("same")), F.when(F.col("out") >= 0, F.col("whole"))), lambda r: r < F.col("rank"))
    pairs = pairs.select("rank", F.explode(earlier).alias("partner")).distinct()
    partner = lines.select(F.col("rank").alias("partner"), F.col("words").alias("other"))
    spelled_out = pairs.join(lines.select("rank", "h1", "h2", "words"), "rank").join(partner, "partner").select("h1", "h2", "words", "other")
    return spelled_out.mapInArrow(_checked, "h1 long, h2 long").distinct()


def _whole(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Rows with their keys: doc_id, the text's hash, and a hash of all columns."""
    return docs.withColumns({"_doc_": F.col(doc).cast("long"), "_hash_": F.xxhash64(text), "_all_": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])})


def _once(joined: DataFrame, own: list[F.Column]) -> DataFrame:
    """Leaves the kept lines to one of each set of rows equal in doc_id and text. Rows equal throughout are counted, not gathered."""
    plain = joined.where(F.col("_least_").isNull()).select(*own, "_kept_")
    rows = written(joined.where(F.col("_least_").isNotNull()).select(*own, "_kept_", "_all_", "_least_"), "repeated-rows")
    none = F.lit(None).cast("array<int>")
    others = rows.where("_all_ != _least_").select(*own, none.alias("_kept_"))
    alike = rows.where("_all_ = _least_").groupBy(*own, "_kept_").agg(F.count("*").cast("int").alias("_n_"))
    first = alike.withColumn("_i_", F.explode(F.sequence(F.lit(1), F.col("_n_")))).select(*own, F.when(F.col("_i_") == 1, F.col("_kept_")).alias("_kept_"))
    return plain.unionByName(others).unionByName(first)


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Every row with its repeated lines taken out of the text; adds n_lines and n_dropped (lines with words).

    Earliest is by doc_id, then the text's hash, then position. Lines without words stay. Of a text whose lines are all
    repeats, nothing stays: it is empty. A null text stays null and has no lines; null doc_ids come last. Of rows equal in
    doc_id and text the first by a hash of all columns keeps the lines, and the others lose theirs. Lines and texts may be
    of any length; an empty table gives no rows; other columns pass through, whatever their names (n_lines and n_dropped
    are replaced).
    """
    base, back = aside(docs.drop("n_lines", "n_dropped"), "_doc_", "_text_", "_hash_", "_all_", "_of_", "_in_", "_kept_", "_least_", "_n_", "_i_")
    keyed = _keyed(base.select(F.col(doc).alias("_doc_"), F.col(text).alias("_text_")), "_doc_", "_text_")
    hashed = keyed.select("doc", "text_hash", "_text_").mapInArrow(lambda b: _hashed(b, least), "h1 long, h2 long, doc long, text_hash long, line int, halves array<long>")
    distinct = written(hashed.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.first("halves").alias("halves")), "distinct-lines")
    dropped = cut(near_lines(keyed, distinct, least))
    kept = distinct.join(dropped, ["h1", "h2"], "left_anti").select("first.*")
    kept = kept.groupBy(F.col("doc").alias("_of_"), F.col("text_hash").alias("_in_")).agg(F.collect_list("line").alias("_kept_"))
    again = cut(_whole(base, doc, text).groupBy("_doc_", "_hash_").agg(F.count("*").alias("n"), F.min("_all_").alias("_least_")).where("n > 1").drop("n"))
    repeats = not again.isEmpty()
    if repeats:
        kept = kept.join(again, F.col("_of_").eqNullSafe(F.col("_doc_")) & (F.col("_in_") == F.col("_hash_")), "left").drop("_doc_", "_hash_")
    kept = written(kept, "kept-lines")
    names = base.columns
    at = names.index(text)
    whole = _whole(base, doc, text)
    joined = whole.join(kept.hint("shuffle_hash"), F.col("_doc_").eqNullSafe(F.col("_of_")) & (F.col("_hash_") == F.col("_in_")), "left")
    own = [F.col(f"`{c}`") for c in names]
    if repeats:
        joined = _once(joined, own)
    joined = joined.select(*own, "_kept_")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), "n_lines int, n_dropped int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts, lines, gone = [], [], []
                for value, numbers in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                    parts, stay = (value or "").split("\n"), set(numbers or ())
                    full = [bool(p.split()) for p in parts]
                    left = [p for i, p in enumerate(parts) if not full[i] or i in stay]
                    texts.append(None if value is None else "\n".join(left) if stay or not any(full) else "")
                    lines.append(sum(full))
                    gone.append(sum(full) - len(stay))
                columns = [*batch.columns[:-1], pa.array(lines, pa.int32()), pa.array(gone, pa.int32())]
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_lines", "n_dropped"])
        give_back()

    return back(joined.mapInArrow(run, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
