import random

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_duplicates import plain_lines, roots
from test_texts import alike, shingles

from accessloom.llm import langid

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_phrases(text, learned):
    """Longest matches in the learned texts, one after the other."""
    at = count = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and any(text[at : at + n + 1] in t for t in learned):
            n += 1
        at, count = at + n, count + 1
    return count


def test_stages(spark, docs, tmp_path):
    r = random.Random(19)
    strange = [(900 + i, "".join(r.choice("qxwzyj") for _ in range(60 + i)), None, "s1", 60 + i, "b", "t") for i in range(3)] + [(950, "".join(r.choice("йцукен ") for _ in range(90)), None, "s1", 90, "b", "t")]
    known = docs.withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.lit("aa")))
    known.union(spark.createDataFrame(strange, docs.schema)).select(COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        seen.append((now.collect(), out.collect()))
        now = spark.createDataFrame(seen[-1][1], out.schema)
    assert [n for n, _ in pipeline.STAGES] == ["language id", "line dedup", "near dedup", "mixing", "packing"]
    assert all(list(r.asDict()) == COLUMNS for _, rows in seen[:4] for r in rows)

    given, kept = seen[0]
    ((name, learned),) = langid.training_texts(spark.createDataFrame(given, docs.select(COLUMNS).schema).where(~langid.held_out()))
    plain = [langid.letters(t) for t in learned]
    bits = langid.Model(((name, learned),)).bits[0]

    def stays(text):
        n = sum(c.isalpha() for c in text or "")
        return n > 0 and (n < langid.LETTERS or plain_phrases(langid.letters(text)[:3000], plain) * bits / sum(c.isalpha() for c in langid.letters(text)[:3000]) < langid.FOREIGN)

    assert sorted(map(repr, kept)) == sorted(repr(r) if r.lang else repr(type(r)(**{**r.asDict(), "lang": "aa"})) for r in given if stays(r.text))
    assert not {r.doc_id for r in kept} & {s[0] for s in strange} and {r.lang for r in kept} == {"aa"}

    given, kept = seen[1]
    cut = plain_lines([(r.doc_id, r.text) for r in given])
    once = {(r.doc_id, r.text): r for r in given}
    assert sorted(repr((r.doc_id, r.text, r.n_chars)) for r in kept) == sorted(repr((d, t, len(t))) for d, text in once if (t := cut[d, text]))

    given, kept = seen[2]
    sets = [shingles(r.text) for r in given]
    groups = roots(len(given), lambda i, j: alike(sets[i], sets[j]) >= 0.8)
    members = {}
    for r, g in zip(given, groups, strict=True):
        members.setdefault(g, []).append(r.doc_id)
    assert sorted(repr(r.doc_id) for r in kept) == sorted(repr(min((d for d in ids if d is not None), default=None)) for ids in members.values())

    given, kept = seen[3]
    words = lambda rows, s: sum(len(r.text.split()) for r in rows if r.source == s)
    assert {repr(r) for r in kept} <= {repr(r) for r in given}
    for source in {r.source for r in given}:
        assert words(kept, source) <= 3 * words(given, source)
    assert abs(sum(len(r.text.split()) for r in kept) - sum(len(r.text.split()) for r in given)) <= 3 * max(len(r.text.split()) for r in given)

    given, pieces = seen[4]
    assert sum(p.length == p.doc_tokens or p.start + p.length == p.doc_tokens for p in pieces) == len(given)
    assert pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_of_empty_tables(spark, none, tmp_path):
    for _, stage in pipeline.STAGES:
        assert stage(spark, none.select(COLUMNS), str(tmp_path)).count() == 0
