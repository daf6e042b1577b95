import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from conftest import prose

from accessloom.llm import chains, lines, pivots, simhash
from accessloom.llm.components import components


def roots(n, linked):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(5, 5)]
    found = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {frozenset(e) for e in edges}
    want = roots(260, lambda i, j: frozenset((i, j)) in pairs)
    assert all(found.get(i, i) == want[i] for i in range(260))


def test_simhash(docs, none, texts):
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(t[1]) for t in texts]
    want = roots(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = defaultdict(list)
    for t, w in zip(texts, want, strict=True):
        least[w].append(t[0])
    rows = sorted((repr(t[0]), p, min(x for x in least[w] if x is not None)) for t, p, w in zip(texts, prints, want, strict=True))
    assert sorted((repr(x.doc_id), x.fp % (1 << 64), x.component_id) for x in got) == rows
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(min(x for x in ids if x is not None) for ids in least.values())


def test_simhash_index_at_all_distances(spark, docs):
    """Lists of all sizes down to those split to half bytes give the components of brute force."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 62, 3)
    for distance, largest in ((3, 3), (4, 12), (7, 20)):
        values = sorted({int(base[r.integers(3)]) ^ sum(1 << int(b) for b in r.choice(62, r.integers(distance + 2), replace=False)) for _ in range(120)})
        want = roots(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= distance)
        edges = {(values.index(x.a), values.index(x.b)) for x in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), distance, largest).collect()}
        assert roots(len(values), lambda i, j: (i, j) in edges or (j, i) in edges) == want, (distance, largest)


def test_tallies():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 63, 500).astype(np.uint64) & r.integers(0, 1 << 63, 500).astype(np.uint64) & np.uint64(0xFF00F0FF0F00FF01)
    assert simhash.tallies(x).tolist() == [sum(b == 0 for b in int(v).to_bytes(8, "big")) for v in x]


def test_vectors(spark, docs):
    r = np.random.default_rng(2)
    rows = []
    for g in range(12):
        centre = r.normal(size=16)
        rows += [[float(x) for x in centre + r.normal(size=16) * s] for s in (0, 0.03, 0.08, 0.3, 0)]
    rows += [rows[0], rows[0], None, [0.0] * 16, [math.nan] + rows[1][1:], [None] + rows[1][1:], [math.inf] + rows[1][1:], rows[2][:8], [x * 3 for x in rows[0]]]
    table = [(i, v, None if i == 6 else i % 2, "extra") for i, v in enumerate(rows)]
    table = [*table, table[10], table[11]]

    def usable(t):
        return t[1] is not None and t[2] is not None and all(x is not None and math.isfinite(x) for x in t[1]) and any(t[1])

    def linked(i, j):
        a, b = table[i], table[j]
        return usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98

    want = roots(len(table), linked)
    links = [sum(linked(max(i, j), min(i, j)) for j in range(len(table)) if j != i) for i in range(len(table))]
    for block in (1024, 4):
        got = pivots.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, size string"), block=block).collect()
        assert sorted((x.vec_id, x.n_links, x.component_id) for x in got) == sorted((t[0], n, table[w][0]) for t, n, w in zip(table, links, want, strict=True))
        assert all(x.kept == (x.vec_id == x.component_id) for x in got)
    assert pivots.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_recall(spark):
    """Links near the bound, in few and many dimensions, against brute force; at least 0.99 of them are found and no other."""
    r = np.random.default_rng(17)
    for dim in (16, 64, 384):
        rows = []
        for _ in range(60):
            centre = r.normal(size=dim)
            rows += [centre + r.normal(size=dim) * r.uniform(0.05, 0.13) for _ in range(10)]
        rows += list(r.normal(size=(900, dim)))
        unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
        cosines = unit @ unit.T
        np.fill_diagonal(cosines, 0)
        want = (cosines >= 0.98).sum(axis=1)
        assert want.sum() > 500
        for block in (1024, 100) if dim == 64 else (1024,):
            got = {x.vec_id: x for x in pivots.near_vectors(spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int"), block=block).collect()}
            counts = np.array([got[i].n_links for i in range(len(rows))])
            assert (counts <= want).all() and counts.sum() >= 0.99 * want.sum(), (dim, counts.sum() / want.sum())


def plain_lines(texts):
    """(doc_id, text) to the text that stays."""
    order = {}
    hashed = sorted({(t[0] is None, t[0] or 0, xxhash.xxh64_intdigest((t[1] or "").encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest((t[1] or "").encode(), 42) >> 63 else 0) if t[1] is not None else 42, t[1]) for t in texts}, key=lambda x: x[:3])
    for at, (_, _, _, text) in enumerate(hashed):
        for n, line in enumerate((text or "").split("\n")):
            order.setdefault(tuple(line.lower().split()), (at, n))
    order.pop((), None)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    dropped = {a for a in order if len(a) >= 5 and any(order[b] < order[a] and len(b) >= 5 and abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1 for b in order)}
    out = {}
    for at, (unnamed, doc, _, text) in enumerate(hashed):
        parts = (text or "").split("\n")
        full = [tuple(p.lower().split()) for p in parts]
        stay = [bool(w) and w not in dropped and order[w] == (at, n) for n, w in enumerate(full)]
        left = [p for p, w, s in zip(parts, full, stay, strict=True) if s or not w]
        out[None if unnamed else doc, text] = text and ("\n".join(left) if any(stay) or not any(full) else "")
    return out


def test_lines(docs, none, texts):
    got = lines.dedup_lines(docs)
    want = plain_lines(texts)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    seen, rows = set(), []
    for t in texts:  # of equal rows only the first keeps lines
        text = want[t[0], t[1]] if (t[0], t[1]) not in seen else t[1] and ("" if t[1].split() else t[1])
        rows.append((repr(t[0]), repr(text)))
        seen.add((t[0], t[1]))
    assert sorted((repr(x.doc_id), repr(x.text)) for x in got.collect()) == sorted(rows)
    assert lines.dedup_lines(none).count() == 0


def test_lines_within_one_edit(spark, docs):
    base = "one two three four five six seven eight nine ten".split()
    edits = [base, base[1:], base[:-1], [*base, "more"], ["new", *base], [*base[:4], "x", *base[5:]], [*base[:4], "x", *base[4:]], [*base[:4], "x", "y", *base[6:]], base[:7], ["x", *base[1:9], "y"]]
    for order in (edits, edits[::-1]):
        rows = [(i, " ".join(e), None, None, 0, "", "") for i, e in enumerate(order)]
        got = lines.dedup_lines(spark.createDataFrame(rows, docs.schema)).collect()
        want = plain_lines(rows)
        assert {x.doc_id: x.text for x in got} == {k[0]: v for k, v in want.items()}
    assert lines.within_one("a b".split(), "a c".split()) and not lines.within_one("a b".split(), "b c".split())


def test_passages(spark, docs, none):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(80)]
    fuzzy = [w if i % 17 else word() for i, w in enumerate(passage)]
    less = [*passage[:30], *passage[34:]]
    fill = lambda n: [word() for _ in range(n)]
    bodies = [[*fill(50), *passage, *fill(20)], [*fill(5), *fuzzy, *fill(70)], [*fill(30), *less], fill(200), [*passage, *fill(9), *passage], passage[:30] + fill(60)]
    rows = [(i, " ".join(b), None, None, 0, "", "") for i, b in enumerate(bodies)] + [(None, " ".join([*fill(3), *passage]), None, None, 0, "", ""), (9, None, None, None, 0, "", ""), (10, "", None, None, 0, "", "")]
    got = {(x.doc_id, x.first_doc_id): x for x in chains.passages(spark.createDataFrame(rows, docs.schema)).collect()}
    assert {k[0] for k in got} == {1, 2, 4, None}
    assert (got[2, 0].start, got[2, 0].end, got[2, 0].first_start, got[2, 0].first_end) == (30, 106, 50, 130)
    assert abs(got[1, 0].start - 5) <= 1 and abs(got[1, 0].end - 85) <= 1 and 0.9 < got[1, 0].likeness < 1
    assert (got[None, 0].start, got[None, 0].end, got[None, 0].likeness) == (3, 83, 1.0)
    assert chains.passages(none).count() == 0


def common_words(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


def test_passages_by_brute_force(spark, docs, monkeypatch):
    """Every passage of 50 words that occurs before is found, frequent parts or not; whatever is found is long and alike enough."""
    r = random.Random(29)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    fill = lambda n: [word() for _ in range(n)]
    lines = [fill(r.randint(25, 35)) for _ in range(12)]
    bodies = [[*fill(r.randint(0, 9)), *r.choice(lines), *fill(r.randint(0, 9))] for _ in range(60)]
    for _ in range(60):
        bodies.append([*fill(r.randint(0, 20)), *(w for line in r.sample(lines, r.randint(1, 3)) for w in line), *fill(r.randint(0, 20))])
    period = fill(60)
    bodies += [[*period, *period, *period], [*fill(4), *fill(20) * 8, *fill(4)], bodies[70][:], bodies[71][:]]
    r.shuffle(bodies)
    rows = [(r.randrange(100) if i % 9 else None, " ".join(b)) for i, b in enumerate(bodies)]
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1])]
    texts = [(d, t.split()) for d, t in rows]
    for block in (chains.BLOCK, 64):
        monkeypatch.setattr(chains, "BLOCK", block)
        frame = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, seed string, key string")
        found = chains.passages(frame).collect()
        at = {}
        for d, w in texts:
            at.setdefault(d, []).append(w)
        for x in found:
            assert min(x.end - x.start, x.first_end - x.first_start) >= chains.LEAST and x.likeness >= chains.ALIKE
            assert any(2 * common_words(a[x.start : x.end], b[x.first_start : x.first_end]) >= (x.likeness - 1e-9) * (x.end - x.start + x.first_end - x.first_start) for a in at[x.doc_id] if len(a) >= x.end for b in at[x.first_doc_id] if len(b) >= x.first_end), x
            assert x.doc_id is None or x.doc_id != x.first_doc_id or x.end - x.start == x.first_end - x.first_start or x.start > x.first_start
        # All places of each window of 50 words; all but one must lie in passages of their documents, up to a seed's window at each end.
        places = {}
        for d, w in {(d, " ".join(w)): (d, w) for d, w in texts}.values():
            for i in range(len(w) - 49):
                places.setdefault(tuple(w[i : i + 50]), set()).add((d, " ".join(w), i))
        spans = {}
        for x in found:
            spans.setdefault(x.doc_id, []).append((x.start, x.end))
            spans.setdefault(x.first_doc_id, []).append((x.first_start, x.first_end))
        missed = 0
        for some in places.values():
            if len({(d, t) for d, t, _ in some}) > 1:
                missed += sum(not any(a <= i + 25 < b for a, b in spans.get(d, [])) for d, _, i in some) > 1
        assert not missed
        assert sum(x.start == x.first_start == 0 and x.doc_id == x.first_doc_id and x.end == x.first_end for x in found) >= 2


def test_seeds():
    r = random.Random(13)
    words = [r.choice(("a", "b", "c")) for _ in range(3000)]
    keys, places = chains.seeds(words, chains.Hashes())
    by = {}
    for k, p in zip(keys.tolist(), places.tolist(), strict=True):
        size, at = (chains.LONG, p - chains.LONG_MARK) if p >= chains.LONG_MARK else (chains.K, p)
        by.setdefault(k, set()).add(tuple(words[at : at + size]))
        assert at + size <= len(words)
    assert all(len(v) == 1 for v in by.values()) and len({w for v in by.values() for w in v}) == len(by)


def test_chain_finds_best_predecessors():
    assert chains.chained([(0, 0, 10), (12, 12, 10), (30, 5, 8)]) == [(0, 22, 0, 22, 20), (30, 38, 5, 13, 8)]
    assert chains.agreeing("a b c d".split(), "b x d".split()) == 2
    r = random.Random(1)
    for _ in range(100):
        a, b = ([r.choice("abc") for _ in range(r.randrange(1, 12))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert chains.agreeing(a, b) == table[-1][-1]


def test_only_lines_asked_for_are_spelled(spark, docs):
    """The sieve lets every line through that is asked for, and few others."""
    r = random.Random(23)
    texts = [prose(r, 9) for _ in range(2000)]
    hashes = [lines._wide(t) for t in texts]
    asked = spark.createDataFrame([(h,) for h, _ in hashes[:100]], "h1 long")
    sieve = lines._sieve(asked)
    batch = pa.RecordBatch.from_pylist([{"doc": i, "text_hash": 0, "text": t} for i, t in enumerate(texts)])
    found = {x["doc"]: (x["h1"], x["h2"], x["words"]) for b in lines._hashed(iter([batch]), 5, sieve) for x in b.to_pylist()}
    assert all(found[i] == (*hashes[i], texts[i]) for i in range(100)) and len(found) < 100 + 1900 / 8
    assert not [x for b in lines._hashed(iter([batch]), 5, lines._sieve(asked.limit(0))) for x in b.to_pylist()]


def test_passages_behind_scattered_parts(spark, docs, monkeypatch):
    """A passage is met though the first occurrences of its seeds, in the same block or text or elsewhere, are parts too short for one."""
    r = random.Random(31)
    base = prose(r, 100).split()
    late = prose(r, 5).split() + ["other" if i % 20 == 10 else w for i, w in enumerate(base)]
    # Every seed's window of the late text lies in one of these parts, in its own surroundings; no part has forty words.
    parts = [" ".join(late[i : i + 37]) for i in range(80, -1, -20)]
    scattered = " ".join(f"{p} {prose(r, 8)}" for p in parts)
    passage, late, filler = " ".join(base), " ".join(late), lambda n: prose(r, n)
    cases = {
        "block": (60, [f"{filler(600)} {passage}", scattered, late], (2, 0)),
        "text": (1 << 20, [f"{passage} {filler(20)}", f"{scattered} {filler(30)} {late}"], (1, 0)),
        "other texts": (1 << 20, [*(f"{filler(9)} {p} {filler(9)}" for p in parts), f"{passage} {filler(20)}", late], (6, 5)),
    }
    for name, (block, texts, pair) in cases.items():
        monkeypatch.setattr(chains, "BLOCK", block)
        frame = spark.createDataFrame([(i, t, None, None, 0, "", "") for i, t in enumerate(texts)], docs.schema).coalesce(1)
        found = {(x.doc_id, x.first_doc_id): x for x in sorted(chains.passages(frame).collect(), key=lambda x: x.end - x.start)}
        assert pair in found and found[pair].end - found[pair].start >= 80, (name, sorted(found))
