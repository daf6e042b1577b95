import random

import corpus_pipeline as pipeline
import numpy as np
from conftest import prose
from pyspark.sql import functions as F
from test_duplicates import plain_fingerprint, roots
from test_texts import alike as similarity
from test_texts import shingles

from accessloom.llm import alike, simhash


def near_texts():
    """Texts with copies edited in so many words that similarities lie on both sides of 0.8, and a passage that many share."""
    r = random.Random(21)
    texts = []
    for i in range(12):
        base = prose(r, r.randint(40, 120)).split()
        for edits in (0, 1, 1, 2, 3, 4):
            words = list(base)
            for at in r.sample(range(len(words)), edits):
                words[at] = f"other{r.randrange(999)}"
            texts.append(" ".join(words))
    passage, base = prose(r, 30), prose(r, 70).split()
    texts += [f"{prose(r, 12)} {passage} {prose(r, 12)}" for _ in range(30)]
    texts += [" ".join([*base[:at], f"w{r.randrange(99)}", *base[at + 1 :]]) for at in (r.randrange(70) for _ in range(40))]
    texts += ["a b", "A  b", "a b c", "", None, " \n", texts[3], texts[3]]
    r.shuffle(texts)
    return texts


def test_near_dedup_stage(spark, docs, tmp_path):
    texts = near_texts()
    sets = [shingles(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    assert sum((plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[j])).bit_count() > 4 for i, j in near) > 50
    linked = set(near)
    want = roots(len(texts), lambda i, j: (i, j) in linked)
    rows = spark.createDataFrame([(i, t, None, None, 0, "", "") for i, t in enumerate(texts)], docs.schema)
    assert sorted(x.doc_id for x in pipeline.near_dedup(spark, rows, str(tmp_path)).collect()) == sorted(set(want))
    named = rows.withColumn("_hash_", F.xxhash64("text")).withColumn("_doc_", F.col("doc_id"))
    first = alike.classes(rows, named, small=2).collect()
    assert sorted(x["first"]["_doc_"] for x in first) == sorted(set(want))


def test_rows_without_documents(docs, none):
    assert simhash.keep_one(none, width=5, similarity=(4, 5)).count() == 0
    kept = simhash.keep_one(docs, width=5, similarity=(4, 5))
    assert kept.columns == docs.columns and sum(x.text is None or not x.text.split() for x in kept.collect()) == 1


def test_simhash_links_come_first(spark, docs, monkeypatch):
    """Operator 1's links are verified on the sets; without the index of prefixes they alone connect near copies within its distance."""
    base = prose(random.Random(3), 400).split()
    texts = [" ".join([*base[:at], "changed", *base[at + 1 :]]) for at in (0, 399)] + [" ".join(base), " ".join(base), prose(random.Random(4), 300)]
    rows = spark.createDataFrame([(i, t, None, None, 0, "", "") for i, t in enumerate(texts)], docs.schema)
    real, asked = simhash.links, []
    monkeypatch.setattr(simhash, "links", lambda distinct, distance, **more: asked.append(distance) or real(distinct, distance, **more))
    monkeypatch.setattr(alike, "_listed", lambda batches, small, similarity: iter(()))
    kept = simhash.keep_one(rows, width=5, similarity=(4, 5)).collect()
    assert asked == [simhash.DISTANCE] and sorted(x.doc_id for x in kept) == [0, 4]


def test_large_lists_of_unlike_sets(spark, docs, monkeypatch):
    """Texts that only share a phrase meet in large lists, where no whole set is asked for; crowds of hopeful ones give members, not pairs."""
    r = random.Random(8)
    phrase = prose(r, 8)
    unlike = [f"{phrase} {prose(r, 12)} {prose(r, 3)}" for _ in range(60)]
    base = prose(r, 60).split()
    hopeful = [" ".join("x" + str(r.randrange(10**6)) if at in spots else w for at, w in enumerate(base)) for spots in (set(r.sample(range(60), 3)) for _ in range(60))]
    real, spelled = alike.written, {}
    monkeypatch.setattr(alike, "written", lambda df, label: spelled.setdefault(label, []).append(real(df, label)) or spelled[label][-1])
    monkeypatch.setattr(alike, "_counts", lambda *a: np.zeros(1 << alike.COUNTERS, np.uint32))
    for texts, small in ((unlike, 2), (hopeful, 1)):
        spelled.clear()
        sets = [shingles(t) for t in texts]
        want = roots(len(texts), lambda i, j, sets=sets: similarity(sets[i], sets[j]) >= 0.8)
        rows = spark.createDataFrame([(i, t, None, None, 0, "", "") for i, t in enumerate(texts)], docs.schema)
        named = rows.withColumn("_hash_", F.xxhash64("text")).withColumn("_doc_", F.col("doc_id"))
        first = alike.classes(rows, named, small=small).collect()
        assert sorted(x["first"]["_doc_"] for x in first) == sorted(set(want))
        if texts is unlike:
            assert sum(x.where("b IS NULL").count() for x in spelled["listed"]) > 2 and not sum(x.count() for x in spelled["sets"])
        else:
            assert sum(x.where("b IS NULL").count() for x in spelled["sifted"])
