"""Near-duplicates by the Jaccard similarity of shingle sets: SimHash links first, the rest through an inverted index of prefixes.

Operator 1 comes first, with its byte-position index and its distance: equal fingerprints and those it links are
candidates, which are verified on the whole sets. But sets that are 80 % alike differ in about 10 bits, for which no positional
byte is guaranteed; the index of prefixes is the exact way for the rest.

All shingles have one order. Of a set of n, at least 0.8 n must be in any set that is 80 % alike, so two such sets
share one of the first n - ceil(0.8 n) + 1 shingles of each: its prefix, which is all that the index lists. No pair
is missed. Any order will do; rare shingles come first, by counts over all documents in a table of fixed size, so few
prefixes share a shingle by chance.

Members of a list that can be alike by their sizes and places become candidates. Of these, pairs go in which more
shingles of a quarter of the hashes differ than may differ in all; the others are verified on the whole sets. A list of more than `SMALL` members first gives a path through them in an order of its own, so a large group
of copies is found connected at a cost in proportion to its members. Then those pairs of it follow that are not yet
connected, all of them: first their quarters are compared within the list. If few pairs are left, they are candidates as the
others; if more than `SMALL` a member, the members that have one are compared on whole sets within the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, give_back, written
from .components import components
from .groups import run_bounds, whole_runs

WIDTH = 5
#: Least similarity, as a fraction: so many of so many.
ALIKE = (4, 5)
#: Members up to which a list gives all pairs at once.
SMALL = 8
#: Bits of a shingle that choose its counter, and into how many pieces the table of counters is cut when tasks' tables are added.
COUNTERS, PIECES = 20, 64
#: Bits of a quarter's signature.
SIGNED = 2048
#: Places of documents, of 24 bytes each, up to which they are sent to the texts; more are joined by shuffling.
SENT = 1 << 20
KEY = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * KEY
    return x ^ x >> np.uint64(29)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes, ascending, of the shingles of lower-cased words; a text of fewer words is one shingle, one of none has none."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(word) - width + 1)
    mixed = word[:n].copy()
    for i in range(1, min(width, len(word))):
        mixed = mixed * KEY + word[i : i + n]
    return np.unique(_mixed(mixed))


def prefix(shingles: np.ndarray, counts: np.ndarray, similarity: tuple[int, int] = ALIKE) -> np.ndarray:
    """The first shingles of a set, as many as any set that is alike must share one of; rare ones by their counters come first."""
    n, (some, of) = len(shingles), similarity
    order = np.argsort(counts[shingles >> np.uint64(64 - COUNTERS)], kind="stable")
    return shingles[order[: n - -(-some * n // of) + 1]]


def alike(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, similarity: tuple[int, int]) -> np.ndarray | bool:
    """Whether sets of a and b shingles, `common` of them in both, are similar enough."""
    return common * sum(similarity) >= similarity[0] * (a + b)


def quarter(shingles: np.ndarray) -> bytes:
    """Two bytes, ascending, of each of a quarter of the shingles. Some may be equal, so a count of what isn't shared is never too high."""
    return (shingles[shingles & np.uint64(3) == 0] >> np.uint64(48)).astype(np.uint16).tobytes()


def _unshared(a: np.ndarray, b: np.ndarray) -> int:
    return len(a) - int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else len(a)


def _hopeful(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The pairs that their quarters don't rule out."""
    for batch in batches:
        near = []
        for n, m, one, two in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "one", "two")), strict=True):
            a, b = np.frombuffer(one, np.uint16), np.frombuffer(two, np.uint16)
            near.append(bool(alike(min(n - _unshared(a, b), m - _unshared(b, a)), n, m, similarity)))
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _counts(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """How many documents hold a shingle of each counter, roughly: one task counts up to 65,535, and two shingles of a document count once."""
    size = (1 << COUNTERS) // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTERS, np.uint32)
        for batch in batches:
            for value in batch.column(0):
                counts[shingle_set(value.as_py() or "", width) >> np.uint64(64 - COUNTERS)] += 1
        pieces = np.minimum(counts, 0xFFFF).astype(np.uint16).reshape(PIECES, size)
        some = [i for i in range(PIECES) if pieces[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pieces[i].tobytes() for i in some], pa.binary())], names=["piece", "counts"])
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(counts, np.uint16).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["piece", "counts"])

    kind, total = "piece int, counts binary", np.zeros((PIECES, size), np.uint32)
    for row in docs.select(F.col(text)).mapInArrow(count, kind).repartition("piece").mapInArrow(add, kind).collect():
        total[row.piece] = np.frombuffer(row.counts, np.uint32)
    return total.ravel()


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray, width: int, similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(_doc_, _hash_, set, n, keys, some, fp): the digest of the document's set, its size, prefix and quarter, and the text's fingerprint."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = [t or "" for t in batch.column(2).to_pylist()]
            sets = [shingle_set(t, width) for t in texts]
            fps = np.array([simhash.fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            digests = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            keys = [prefix(s, counts, similarity).view(np.int64) if len(s) else s.view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests), pa.array(np.array(list(map(len, sets)), np.int32)), lists, pa.array(map(quarter, sets), pa.binary()), pa.array(fps)], names=["_doc_", "_hash_", "set", "n", "keys", "some", "fp"])
    give_back()


def _possible(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether sets whose first common shingle has these places can have enough in common."""
    return alike(np.minimum(n - at, m - to), n, m, similarity)


NAMES = ["key", "a", "b", "n", "at"]
CANDIDATES = "key long, a long, b long, n int, at int"


def _listed(batches: Iterator[pa.RecordBatch], small: int, similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of each list: all of a small one, else a path; members of the latter come besides, with b null."""
    for rows in whole_runs(batches):
        key, node, n, at = (rows.column(i).to_numpy() for i in range(4))
        starts, lengths = run_bounds(key)
        length = np.repeat(lengths, lengths)
        crowded = length > small
        # In large lists, neighbours by an order that each key sets anew; small ones are paired at every distance.
        order = np.lexsort((np.where(crowded, _mixed(node.astype(np.uint64) ^ key.view(np.uint64)), node.astype(np.uint64)), np.repeat(np.arange(len(starts)), lengths)))
        node, n, at = node[order], n[order], at[order]
        n, at = n.astype(np.int64), at.astype(np.int64)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, min(small, len(key))):
            same = (key[:-step] == key[step:]) & ((step == 1) | ~crowded[step:])
            x = np.flatnonzero(same)
            x = x[_possible(n[x], at[x], n[x + step], at[x + step], similarity)]
            left.append(node[x])
            right.append(node[x + step])
        a, b = np.concatenate(left), np.concatenate(right)
        c = np.flatnonzero(crowded)
        pad = lambda x, kind: pa.concat_arrays([pa.nulls(len(a), kind), pa.array(x[c], kind)])
        yield pa.RecordBatch.from_arrays([pad(key, pa.int64()), pa.concat_arrays([pa.array(np.minimum(a, b)), pa.array(node[c])]), pa.concat_arrays([pa.array(np.maximum(a, b)), pa.nulls(len(c), pa.int64())]), pad(n, pa.int32()), pad(at, pa.int32())], names=NAMES)


def _signatures(quarters: list[bytes]) -> np.ndarray:
    """`SIGNED` bits of each quarter, of which one is set for each of its shingles."""
    out = np.zeros((len(quarters), SIGNED), bool)
    for row, quarter in zip(out, quarters, strict=True):
        row[np.frombuffer(quarter, np.uint16) % SIGNED] = True
    return np.packbits(out, axis=1).view(np.uint64)


def _lacking(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one signature and many: bits of the one that each lacks and the other way round, so at least as many shingles."""
    both = np.bitwise_count(a & b).sum(axis=1, dtype=np.int64)
    return np.bitwise_count(a).sum(dtype=np.int64) - both, np.bitwise_count(b).sum(axis=1, dtype=np.int64) - both


def _hopes(n: np.ndarray, at: np.ndarray, part: np.ndarray, signs: np.ndarray, i: int, similarity: tuple[int, int]) -> np.ndarray:
    """Members of a list after the i-th that are not connected with it and that neither sizes, places nor signatures rule out."""
    later = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
    later = later[_possible(n[i], at[i], n[later], at[later], similarity)]
    if not len(later):
        return later
    one, others = _lacking(signs[i], signs[later])
    return later[alike(np.minimum(n[i] - one, n[later] - others), n[i], n[later], similarity)]


def _sifted(batches: Iterator[pa.RecordBatch], small: int, similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Of each large list the pairs that aren't connected yet and that quarters don't rule out; where these are more than `small` a member, the members that have one, with b null."""
    for rows in whole_runs(batches):
        key, node, n, at, part = (rows.column(i).to_numpy() for i in range(5))
        quarters = rows.column(5).to_pylist()
        halves = [np.frombuffer(x, np.uint16) for x in quarters]
        signs, sizes, places = _signatures(quarters), n.astype(np.int64), at.astype(np.int64)
        pairs, members = [], []
        for start, length in zip(*(x.tolist() for x in run_bounds(key)), strict=True):
            here, found, crowd = slice(start, start + length), [], set()
            for i in range(start, start + length - 1):
                for k in (_hopes(sizes[here], places[here], part[here], signs[here], i - start, similarity) + start).tolist():
                    a, b = halves[i], halves[k]
                    if alike(min(sizes[i] - _unshared(a, b), sizes[k] - _unshared(b, a)), sizes[i], sizes[k], similarity):
                        crowd |= {i, k}
                        if len(found) <= small * length:
                            found.append((i, k))
            if len(found) <= small * length:
                pairs += found
            else:
                members += sorted(crowd)
        x, y = (np.array([p[c] for p in pairs], np.int64) for c in (0, 1))
        c = np.array(members, np.int64)
        first = np.concatenate([np.minimum(node[x], node[y]), node[c]])
        last = pa.concat_arrays([pa.array(np.maximum(node[x], node[y]), pa.int64()), pa.nulls(len(c), pa.int64())])
        of = np.concatenate([x, c])
        yield pa.RecordBatch.from_arrays([pa.array(key[of]), pa.array(first), last, pa.array(n[of]), pa.array(at[of]), pa.array(part[of])], names=[*NAMES, "part"])


def _apart(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links that connect what is alike in each large list and isn't connected yet: a spanning forest, found on the whole sets."""
    for rows in whole_runs(batches):
        key, node, n, at, part = (rows.column(i).to_numpy() for i in range(5))
        n, at = n.astype(np.int64), at.astype(np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in rows.column(5).to_pylist()]
        signs = _signatures([quarter(x) for x in sets])
        a, b = [], []
        for start, length in zip(*(x.tolist() for x in run_bounds(key)), strict=True):
            here = slice(start, start + length)
            s, p, c, sign = n[here], at[here], part[here].copy(), signs[here]
            for i in range(length - 1):
                for k in _hopes(s, p, c, sign, i, similarity).tolist():
                    one, two = sets[start + i], sets[start + k]
                    if c[k] != c[i] and alike(len(np.intersect1d(one, two, assume_unique=True)), len(one), len(two), similarity):
                        a.append(node[start + i])
                        b.append(node[start + k])
                        c[c == c[k]] = c[i]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = []
        for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
            a, b = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
            near.append(bool(alike(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), similarity)))
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _by_simhash(distinct: DataFrame, distance: int) -> DataFrame:
    """Candidates (a, b): sets of equal fingerprints with the first of them, and those first ones along the links of operator 1."""
    first = cut(distinct.groupBy("fp").agg(F.min("node").alias("node")))
    equal = distinct.join(first.withColumnRenamed("node", "a"), "fp").where("a != node").select("a", F.col("node").alias("b"))
    ends = simhash.links(first.select("fp"), distance)
    for end in ("a", "b"):
        ends = ends.join(first.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_")), end).drop(end).withColumnRenamed(f"{end}_", end)
    return equal.union(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def links(named: DataFrame, distinct: DataFrame, text: str, width: int, similarity: tuple[int, int], small: int, distance: int) -> DataFrame:
    """Edges (a, b) that connect the nodes of distinct sets linked by similarity, directly or by others."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = distinct.select(F.posexplode("keys").alias("at", "key"), "node", "n").select("key", "node", "n", "at")
    listed = postings.repartition(parts, "key").sortWithinPartitions("key")
    met = written(listed.mapInArrow(lambda b: _listed(b, small, similarity), CANDIDATES), "listed")

    def spelled(nodes: DataFrame) -> DataFrame:
        """The whole sets of some nodes."""
        asked = written(distinct.join(nodes, "node").select("node", F.col("first._doc_").alias("_d"), F.col("first._hash_").alias("_t")), "asked")
        asked = F.broadcast(asked) if asked.count() <= SENT else asked.hint("shuffle_hash")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py() or "", width).tobytes() for t in part.column(1)], pa.binary())], names=["node", "shingles"])
            give_back()

        found = named.join(asked, F.col("_doc_").eqNullSafe(F.col("_d")) & (F.col("_hash_") == F.col("_t"))).select("node", F.col(text).alias("_text_"))
        return written(found.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"]), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = (distinct.select(F.col("node").alias(x), F.col("n").alias(n), F.col("some").alias(some)) for x, n, some in (("a", "n", "one"), ("b", "m", "two")))
        pairs = written(pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "n", "m", "one", "two").mapInArrow(lambda b: _hopeful(b, similarity), "a long, b long"), "candidates")
        sets = spelled(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b")
        return written(both.select("a", "b", "one", "two").mapInArrow(lambda b: _verified(b, similarity), "a long, b long"), "links")

    edges = verified(_by_simhash(distinct, distance).union(met.where(F.col("b").isNotNull()).select("a", "b")))
    crowded = met.where(F.col("b").isNull()).select("key", F.col("a").alias("node"), "n", "at")
    if not crowded.isEmpty():
        members = components(edges)
        labelled = cut(crowded.join(members, "node", "left").select("key", "node", "n", "at", F.coalesce("component", "node").alias("part")))
        # Lists that are connected throughout have nothing left to find.
        open_lists = labelled.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x != y").select("key")
        labelled = labelled.join(cut(open_lists), "key", "left_semi")
        labelled = labelled.join(distinct.select("node", "some"), "node").select("key", "node", "n", "at", "part", "some")
        sifted = labelled.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda b: _sifted(b, small, similarity), f"{CANDIDATES}, part long")
        sifted = written(sifted, "sifted")
        edges = edges.union(verified(sifted.where(F.col("b").isNotNull()).select("a", "b")))
        dense = sifted.where(F.col("b").isNull()).select("key", F.col("a").alias("node"), "n", "at", "part")
        if not dense.isEmpty():
            dense = dense.join(spelled(dense.select("node").distinct()), "node").select("key", "node", "n", "at", "part", "shingles")
            rest = dense.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda b: _apart(b, similarity), "a long, b long")
            edges = edges.union(written(rest, "links"))
    return edges


def classes(docs: DataFrame, named: DataFrame, text: str = "text", width: int = WIDTH, similarity: tuple[int, int] = ALIKE, small: int = SMALL, distance: int | None = None) -> DataFrame:
    """(component, first) of the documents linked by similarity; first is the place (unnamed, _doc_, _hash_) of the one that stays.

    `named` is docs with its places. Null and empty texts have the same, empty, set. Texts of any length are read whole.
    """
    counts = _counts(docs, text, width)
    light = named.select("_doc_", "_hash_", F.col(text).alias("text")).mapInArrow(lambda b: _prefixes(b, counts, width, similarity), "_doc_ long, _hash_ long, set long, n int, keys array<long>, some binary, fp long")
    place = F.struct(F.col("_doc_").isNull().alias("unnamed"), "_doc_", "_hash_")
    distinct = light.groupBy("set").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("some").alias("some"), F.min("fp").alias("fp"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "prefixes")
    members = components(links(named, distinct, text, width, similarity, small, distance or simhash.DISTANCE)).withColumnRenamed("node", "of")
    return distinct.select("node", "first").join(members, F.col("node") == F.col("of"), "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
