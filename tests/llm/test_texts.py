import base64
import gzip
import random
import re
import zlib
from urllib.parse import quote

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from accessloom.llm import langid, mixture, packing, secrets, sharding, sketch
from accessloom.llm.common import ship

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches(docs, none, texts):
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = sketch.with_next(found, {"edited": sketch.edited(F.col("text"), F.col("next_text")), "sketch": sketch.sketch(F.col("text"))}, {"next_sketch": "sketch"})
    near, held = sketch.resemblance(F.col("sketch"), F.col("next_sketch")), sketch.containment(F.col("sketch"), F.col("next_sketch"))
    code = sketch.encoded(F.col("sketch"))
    got = rows.select("doc_id", "text", "next_text", "edited", near.alias("near"), held.alias("held"), sketch.distinct_shingles(F.col("sketch")).alias("n"), (sketch.decoded(code) == F.col("sketch")).alias("same")).collect()
    order = sorted(((t[0], t[1] or "") for t in texts), key=lambda t: (t[0] is None, -(t[0] or 0), t[1].encode()))
    want = {(a, b) for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    assert len(got) == len(texts) and {((x.doc_id, x.text), x.next_text) for x in got} == {(a, b[1]) for a, b in want}
    for x in got:
        third = len(x.text) // 3
        assert x.edited == x.text[: len(x.text) - third] + x.next_text[:third] and x.same
        a, b = shingles(x.text), shingles(x.next_text)
        if max(len(a), len(b)) < 250:
            assert x.near == pytest.approx(alike(a, b)) and x.n == len(a) and x.held == pytest.approx(len(a & b) / len(a) if a else 1)
        else:
            assert abs(x.near - alike(a, b)) < 0.1 and abs(x.n - len(a)) < 0.3 * max(1, len(a))
    assert sketch.with_next(none.select("doc_id", "text"), {}, {}).count() == 0


def test_sketches_merge(spark, docs):
    one = docs.where("doc_id < 20").select(F.lit("g").alias("k"), sketch.sketch(F.col("text")).alias("sketch"))
    merged = sketch.merge_groups(one, "k").head()["sketch"]
    assert merged == sorted({h for x in one.collect() for h in x.sketch})[: sketch.K]


def test_mixture(docs, none, texts):
    got = mixture.mix(docs).collect()
    sizes = {}
    for t in texts:
        sizes[t[3]] = sizes.get(t[3], 0) + len((t[1] or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, targets = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        total = sum(weights[s] for s in names if s not in capped)
        targets = {s: 3 * sizes[s] if s in capped else rest * weights[s] / total for s in names}
        over = {s for s in names if s not in capped and targets[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    assert len(got) == len(texts)
    for s in names:
        mine = [x for x in got if x.source == s]
        assert all(x.target == pytest.approx(targets[s]) and x.source_size == sizes[s] and x.taken <= 3 * x.size for x in mine)
        assert abs(sum(x.taken for x in mine) - targets[s]) <= 1
    each = mixture.occurrences(mixture.mix(docs)).collect()
    taken = {}
    for x in each:
        taken[x.doc_id, x.text] = taken.get((x.doc_id, x.text), 0) + x.words_taken
    assert sum(taken.values()) == sum(x.taken for x in got) and [x.position for x in each] == sorted(x.position for x in each)
    assert sorted(map(tuple, mixture.mix(docs).select("doc_id", "taken").collect()), key=repr) == sorted(((x.doc_id, x.taken) for x in got), key=repr)
    assert mixture.mix(none).count() == 0


def test_positions_invert_the_demand(spark):
    knots = ((0.0, 0.2), (0.3, 2.0), (0.8, 0.0), (1.0, 1.0))
    rows = spark.range(0, 101).select(mixture.position(F.col("id").cast("double"), F.lit(100.0), mixture.schedule_of(F.lit(0), [knots])).alias("t")).collect()

    def demand(t):
        done = 0.0
        for (a, x), (b, y) in zip(knots, knots[1:], strict=False):
            e = min(max(t, a), b)
            done += (e - a) * (x + x + (y - x) * (e - a) / (b - a)) / 2
        return done

    for u, row in enumerate(rows):
        assert demand(row.t) / demand(1.0) * 100 == pytest.approx(u, abs=1e-6)


def test_subset_sums():
    r = random.Random(4)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 4) for _ in range(r.randint(1, 5))}
        room = r.randint(1, 60)
        sums = {0}
        for length, count in counts.items():
            sums = {s + length * k for s in sums for k in range(count + 1)}
        chosen = packing.closest_multiset(counts, room)
        assert all(chosen[k] <= counts[k] for k in chosen) and sum(k * v for k, v in chosen.items()) == max(s for s in sums if s <= room)


def test_ids_equal_the_tokenizer(texts):
    ids = packing.Ids(JSON, RANKS)
    odd = ["a  b", "x\n\ny", " lead", "trail ", "tab\tx", "it's 're", "½ cup", "日本語 テスト 123", "a_b __c", "<|endoftext|> hi", "x\xa0y", "a \n b", "", " ", "\x1c a", "İı ſ ﬁ", "a\r\nb", "é x", "12,5 %", " x​ y"]
    for t in [*odd, *(x[1] or "" for x in texts)]:
        assert ids([t])[0] == ids.pack(ids.whole.encode(t, add_special_tokens=False).ids), t
    long = " ".join(x[1] for x in texts if x[1]) * 40
    assert len(long) > packing.PART and ids([long])[0] == ids.pack(ids.whole.encode(long, add_special_tokens=False).ids)


def test_packing(docs, none, texts):
    got = packing.pack_documents(docs, JSON, RANKS, with_ids=True).collect()
    whole = packing.Ids(JSON).whole
    want = sorted((repr(t[0]), packing.Ids(JSON, None).pack([*whole.encode(t[1] or "", add_special_tokens=False).ids, 1])) for t in texts)
    sequences = {}
    for x in got:
        assert zlib.crc32(x.ids) == x.ids_crc32 and len(x.ids) == 4 * x.length
        sequences.setdefault(x.sequence_id, []).append(x)
    for pieces in sequences.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048 and at & (at - 1) == 0
    single = [t for t in texts if sum(u[0] == t[0] for u in texts) == 1]
    for t in single:
        pieces = sorted((x for x in got if x.doc_id == t[0]), key=lambda x: x.start)
        assert (repr(t[0]), b"".join(bytes(x.ids) for x in pieces)) in want and sum(x.length for x in pieces) == pieces[0].doc_tokens
    assert sum(x.length for x in got) == sum(len(w) // 4 for _, w in want)
    assert packing.pack_documents(none, JSON).count() == 0


SECRET = "password = hunter2hunter2"


def plain_spans(text):
    found = []
    kinds = (("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32))
    for n, (kind, pattern, good) in enumerate(kinds):
        found += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text) if good(m)]
    return [(a, b, k) for a, _, b, k in sorted(found)]


def test_base_spans():
    r = random.Random(9)
    parts = ["password", "PassWd", "secret", "token=", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abcd1234", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "\n", "xyz", "ſecret", "toKen"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert secrets.base_spans(text) == plain_spans(text), text


def test_layers():
    code = base64.b64encode(SECRET.encode()).decode()
    nested = base64.b64encode(gzip.compress(quote(code).encode())).decode()
    for body in (code, nested, quote(SECRET, safe=""), "".join(f"\\u{ord(c):04x}" for c in SECRET), quote(quote(SECRET, safe=""), safe=""), base64.urlsafe_b64encode(zlib.compress(SECRET.encode())).decode().rstrip("=")):
        text = f"é so {body} end"
        base, spans = secrets.scan(text)
        assert base == plain_spans(text)
        (start, end, kind), *_ = [s for s in spans if s[2] == "assign"]
        assert kind == "assign" and text[start] in body and 5 <= start < end <= 5 + len(body), body
    text = "see pass%77ord%3Dabcd%C3%A9 and password=abcd%65fghi"
    assert secrets.scan(text) == ([], [(32, 52, "assign")])
    assert secrets.scan("clean text with antidisestablishmentarianism and 100% sure \\ path") == ([], [])
    self_made = "%25" * 50 + "41"
    assert secrets.scan(self_made) == ([], [])


def test_secret_rows(docs, none, texts):
    got = secrets.scan_documents(docs).collect()
    assert len(got) == len(texts) and all(not x.base and not x.spans for x in got) and secrets.scan_documents(none).count() == 0


def test_suffix_automaton():
    r = random.Random(8)
    for _ in range(60):
        learned = [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 8))]
        known = {w[i:j] for w in learned for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        automaton = langid.SuffixAutomaton(learned)
        for _ in range(40):
            text = "".join(r.choice("abcd  ") for _ in range(r.randint(1, 16)))
            at = count = 0
            while at < len(text):
                at += max([n for n in range(1, len(text) - at + 1) if text[at : at + n] in known], default=1)
                count += 1
            assert automaton.phrases(text) == count


def test_phrases_go_over_word_ends():
    model = langid.Model((("aa", ("one two three",)), ("bb", ("one", "two", "three"))))
    assert [a.phrases("one two three") for a in model.automata] == [1, 5] and langid.letters("One,2 TWO\n...three") == "one two three"


def test_language(spark, docs, none, texts):
    r = random.Random(5)
    kinds = {"aa": ["ba", "ke", "lo"], "bb": ["ri", "tu", "no"], "cc": ["ша", "ли", "во"]}
    made = [(i, " ".join("".join(r.choices(kinds[k], k=3)) for _ in range(30)), k) for i, k in enumerate(r.choices(list(kinds), k=90))]
    rows = spark.createDataFrame([*made, (None, "bakelo", None), (500, "x" * 5000, "dd"), (501, "y" * 6000, "dd")], "doc_id long, text string, lang string")
    learned = langid.training_texts(rows.where(~langid.held_out()), docs=20)
    known = [x.lang for x in rows.where(~langid.held_out()).where("lang IS NOT NULL").collect()]
    assert {k: len(t) for k, t in learned} == {k: min(20, known.count(k)) if k != "dd" else 1 for k in set(known)}
    got = langid.identify(rows, learned).collect()
    assert all(x.lang_pred == x.lang for x in got if x.lang and x.lang != "dd") and all(0 <= x.score <= 1 for x in got)
    odd = langid.identify(docs, learned)
    assert odd.columns == [*docs.columns, "lang_pred", "score", "bits", "n_letters"]
    assert {(x.lang_pred, x.score) for x in odd.collect() if not any(c.isalpha() for c in x.text or "")} == {("und", 0.0)}
    assert langid.identify(none, learned).count() == 0 and langid.training_texts(none) == ()
    assert {x.lang_pred for x in langid.identify(rows, ()).collect()} == {"und"}


def test_held_out_accuracy(spark):
    """On the small table of invented prose: nearly all documents that weren't learned from, by the registered query."""
    ship(spark)
    found = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(found) > 200 and sum(x.lang == x.lang_pred for x in found) >= 0.98 * len(found)


def test_shards(docs, none, texts):
    for limit in (2000, 10_000, 1 << 30):
        got = sharding.shard(docs, limit).collect()
        assert sorted(repr((x.doc_id, x.bytes)) for x in got) == sorted(repr((t[0], len((t[1] or "").encode()))) for t in texts)
        shards = {}
        for x in got:
            shards.setdefault(x.shard, []).append(x)
        for name, rows in shards.items():
            size = sum(x.bytes for x in rows)
            assert {x.shard_bytes for x in rows} == {size} and (size <= limit or name.startswith("alone-") and len(rows) == 1)
        plain = [n for n in shards if not n.startswith("alone-")]
        assert not any(a != b and b.startswith(a) for a in plain for b in plain)
        for name in plain:
            if name:
                assert sum(x.bytes for n in plain if n.startswith(name[:-1]) for x in shards[n]) > limit
    assert sharding.shard(none).count() == 0


def test_shards_are_written_whole(spark, docs, texts, tmp_path):
    sharding.write(docs, f"{tmp_path}/out", 5000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(repr, back.select(docs.columns).collect())) == sorted(map(repr, docs.collect()))
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("k")).collect()
    assert len(sizes) > 2 and all(x.n is None or x.n <= 5000 or x.k == 1 for x in sizes)


def test_shards_of_one_repeated_row(spark, docs):
    rows = spark.createDataFrame([(1, "abcdefghij", None, None, 0, "", "")] * 300, docs.schema)
    got = sharding.shard(rows, 500).collect()
    assert len(got) == 300 and all(x.shard_bytes <= 500 for x in got)


