"""The registered queries as they are registered: columns, digests and forms, held against brute force over a small table."""

import hashlib
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import prose
from test_duplicates import plain_fingerprint, plain_lines, roots
from test_texts import SECRET, alike, plain_spans, shingles

from accessloom.llm import langid, queries, secrets, sketch
from accessloom.llm.common import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, texts, tmp_path_factory):
    """The two tables that the queries read, with a few secrets planted, and their rows."""
    import random

    ship(spark)
    r, folder = random.Random(41), str(tmp_path_factory.mktemp("tables"))
    rows = [(d, t, "aa" if i % 3 else None, s, len(t or "")) for i, (d, t, _, s, *_) in enumerate(texts)]
    rows += [(300 + i, f"{prose(r, 5)} {SECRET}, \n{hashlib.sha1(bytes([i])).hexdigest()} AKIA{'ABCD1234' * 2} {prose(r, 3)}", "bb", "s2", 1) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    n = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(np.concatenate([c + n.normal(size=(6, 8)) * 0.05 for c in n.normal(size=(8, 8))]))]
    vectors += [(100, None, 0), (101, [0.0] * 8, 0), (102, vectors[0][1], None), (103, vectors[0][1], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder, rows, vectors


@pytest.fixture(scope="module")
def asked(spark, tables):
    return lambda name: [x.asDict() for x in queries.queries()[name](spark, tables[0]).collect()]


def by_repr(rows):
    return sorted(map(repr, rows))


def test_simhash_query(tables, asked):
    rows = tables[1]
    prints = [plain_fingerprint(r[1]) for r in rows]
    group = roots(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if g == h and r[0] is not None), default=None) for g in group}
    assert by_repr((x["doc_id"], x["fingerprint"], x["component_id"]) for x in asked("op1_simhash")) == by_repr((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group, strict=True))


def test_simhash_query_takes_bytes_that_are_not_utf8(spark, tmp_path):
    """Spark's strings may hold any bytes: each row still gets its fingerprint, of the bytes, and links like any other."""
    ship(spark)
    texts = [b"One two\xff three four FIVE", b"one two\xff\tthree four five", b"\xed\xa0\x80 x", b"\xc3", b"\xc0\x80 \xa0", b"plain words", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text binary")
    found.selectExpr("doc_id", "cast(text as string) text").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in enumerate(texts):
        words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", t or b"")]
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[j : j + 4]), 42) for j in range(max(1, len(words) - 3))] if words else []
        want.append((i, f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}", 0 if i < 2 else i))
    assert sorted(map(tuple, queries.queries()["op1_simhash"](spark, str(tmp_path)).collect())) == want


def test_embeddings_query(tables, asked):
    rows = tables[2]
    unit = [None if v is None or not any(v) or label is None else np.array(v) / np.linalg.norm(v) for _, v, label in rows]
    linked = lambda i, j: i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98
    group = roots(len(rows), linked)
    want = [(r[0], int(sum(linked(i, j) for j in range(len(rows)))), rows[group[i]][0], group[i] == i) for i, r in enumerate(rows)]
    assert by_repr((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in asked("op2_embeddings")) == by_repr(want)


def test_lines_query(tables, asked):
    rows, seen, want = tables[1], set(), []
    cut = plain_lines([r[:2] for r in rows])
    for d, t, *_ in rows:
        kept = cut[d, t] if (d, t) not in seen else t and ("" if t.split() else t)
        full = lambda s: sum(bool(p.split()) for p in (s or "").split("\n"))
        want.append((d, kept, full(t), full(t) - full(kept)))
        seen.add((d, t))
    assert by_repr((x["doc_id"], x["text"], x["n_lines"], x["n_dropped"]) for x in asked("op3_lines")) == by_repr(want)


def test_passages_query(tables, asked):
    """Texts of 50 words and more that are there twice are found whole; spans lie in texts that agree."""
    rows, found = tables[1], asked("op4_passages")
    words = {}
    for d, t, *_ in rows:
        words.setdefault(d, []).append((t or "").lower().split())
    for x in found:
        assert any(w[x["start"] : x["end"]] == v[x["first_start"] : x["first_end"]] for w in words[x["doc_id"]] for v in words[x["first_doc_id"]]) or x["likeness"] < 1
    for i, (d, t, *_) in enumerate(rows):
        if t and len(t.split()) >= 50 and any(u[1] == t for u in rows[:i] + rows[i + 1 :]):
            assert any(d in (x["doc_id"], x["first_doc_id"]) for x in found), d


def test_fingerprints_query(spark, tables, asked):
    order = sorted(((r[0], r[1] or "") for r in tables[1]), key=lambda t: (t[0] is None, -(t[0] or 0), t[1].encode()))
    want = {}
    for (d, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        want.setdefault((d, len(t), hashlib.sha256(edited.encode()).hexdigest()), []).append((alike(shingles(t), shingles(edited)), alike(shingles(t), shingles(following)), t, edited))
    got = asked("op5_fingerprints")
    assert len(got) == len(order)
    prints = {}
    for x in got:
        near, following, text, edited = want[x["doc_id"], x["n_chars"], x["edited_sha256"]][0]
        small = max(len(shingles(text)), len(shingles(edited))) < sketch.K
        assert x["near_edited"] == pytest.approx(near, abs=1e-9 if small else 0.15)
        if len(want[x["doc_id"], x["n_chars"], x["edited_sha256"]]) == 1:
            assert x["near_next"] == pytest.approx(following, abs=1e-9 if small else 0.15) or not small
        assert prints.setdefault(text, x["fingerprint"]) == x["fingerprint"] and prints.setdefault(edited, x["edited_fingerprint"]) == x["edited_fingerprint"]


def test_mixture_query(tables, asked):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tables[0]}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    got = {repr(x["doc_id"]): x for x in asked("op6_mixture")}
    assert sum(x["size"] for x in asked("op6_mixture")) == sum(len((r[1] or "").split()) for r in tables[1])
    columns = ["doc_id", "size", "source_size", "target", "taken", "first_position"]
    assert set(columns) == set(next(iter(got.values()))) == set(db.sql(queries.oracle_sql()["op6_mixture"]).columns)
    assert all(0 <= x["taken"] <= 3 * x["size"] for x in got.values())


def test_packing_query(tables, asked):
    import tokenizers

    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {}
    for d, t, *_ in tables[1]:
        tokens.setdefault(d, []).append([*whole.encode(t or "", add_special_tokens=False).ids, 1])
    got, sequences = asked("op7_packing"), {}
    for x in got:
        assert any(x["doc_tokens"] == len(ids) and x["ids_crc32"] == zlib.crc32(struct.pack(f"<{x['length']}I", *ids[x["start"] : x["start"] + x["length"]])) for ids in tokens[x["doc_id"]] if x["start"] + x["length"] <= len(ids))
        sequences.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for pieces in sequences.values():
        ends = [0, *(o + n for o, n in sorted(pieces))]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048
    assert sum(x["length"] for x in got) == sum(len(ids) for some in tokens.values() for ids in some)


def test_secrets_query(tables, asked):
    want = []
    for d, t, *_ in tables[1]:
        base, spans = plain_spans(t or ""), secrets.scan(t or "")[1]
        digest = lambda s: ",".join(f"{k}:{a}:{b}" for a, b, k in s)
        want.append((d, *(sum(s[2] == k for s in base) for k in ("assign", "access", "hex")), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
        assert set(base) <= set(spans)
    got = [(x["doc_id"], x["n_assign"], x["n_access"], x["n_hex"], x["base_sha256"], x["spans"]) for x in asked("op8_secrets")]
    assert by_repr(got) == by_repr(want) and sum(w[1] * w[2] * w[3] for w in want) == 3


def test_language_query(spark, tables, asked):
    learned = langid.training_texts(spark.read.parquet(f"{tables[0]}/documents.parquet").where(~langid.held_out()))
    model = langid.Model(learned)
    want = [(r[0], zlib.crc32(str(r[0]).encode()) % 4 == 2 if r[0] is not None else False, *model.judged(r[1] or "")[:2]) for r in tables[1]]
    got = asked("op9_language")
    assert by_repr((x["doc_id"], x["held_out"], x["lang_pred"], x["score"]) for x in got) == by_repr(want) and {w[2] for w in want} == {"aa", "bb", "und"}


def test_shards_query(tables, asked):
    got = asked("op10_shards")
    assert by_repr((x["doc_id"], x["bytes"]) for x in got) == by_repr((r[0], len((r[1] or "").encode())) for r in tables[1])
    assert {x["shard_bytes"] for x in got} == {sum(x["bytes"] for x in got)}


def test_columns_with_names_that_operators_use(spark, docs):
    """Columns named like those that operators make for themselves pass through unharmed."""
    from pyspark.sql import functions as F

    from accessloom.llm import lines, mixture, sharding, simhash

    own = ("_h", "_b", "_s", "_part", "_offset", "_run", "_e", "_hash_", "_doc_", "_d", "_t", "_whole_", "_all_", "_kept_", "_n_", "_i_", "_at", "_path", "_guest", "_to", "_first", "_least_", "_of_", "_in_", "_text_")
    rows = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")) for c in own})
    outs = (lines.dedup_lines(rows), mixture.occurrences(mixture.mix(rows.drop("target"))), simhash.keep_one(rows), simhash.keep_one(rows, width=5, similarity=(4, 5)), sketch.with_next(rows, {"sketch": sketch.sketch(F.col("text"))}, {}))
    for out in outs:
        assert set(own) <= set(out.columns)
        assert all(x[c] == f"{c}{-1 if x.doc_id is None else x.doc_id}" for x in out.collect() for c in own)


def test_archive_for_executors(spark, tmp_path):
    """The package is whole in the archive that executors of a cluster get."""
    import subprocess
    import sys

    from accessloom.llm.common import archived

    place = archived(spark).removeprefix("file:")
    found = subprocess.run([sys.executable, "-c", "import accessloom.llm.chains as c; print(c.__file__)"], env={"PYTHONPATH": place, "PATH": "/usr/bin:/bin"}, cwd=tmp_path, capture_output=True, text=True)
    assert place in found.stdout, found.stderr
