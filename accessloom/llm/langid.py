"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled texts, as letters with a space for whatever stands between. A text is
parsed against each, across the ends of words: at every place the longest match in the automaton is one phrase (a
letter never seen is a phrase of its own). So many phrases, each a reference into as many learned letters, are what the
text costs in that language: phrases times log2 of the letters learned, per letter of the text. The language
in which it costs least wins.

The automata are fitted on a bounded sample of the labelled rows: up to `DOCS` a language, none longer than `LONGEST`
characters (but for a language that has longer ones only, of which the shortest is taken). Every text is parsed whole.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, table

#: Labelled rows of a language that are learned, and the characters up to which a row is taken.
DOCS, LONGEST = 16, 4096
#: Bits a letter from which on a text is in none of the languages, and letters from which on that can be told.
FOREIGN, LETTERS = 9.0, 40
UNKNOWN = "und"
BETWEEN = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased letters, with one space between words."""
    return BETWEEN.sub(" ", text.lower()).strip()


class SuffixAutomaton:
    """Suffix automaton over texts: accepts every substring of each of them.

    A state is the dictionary of its edges, which lead to other states; a parse follows them without any numbering.
    """

    def __init__(self, texts: list[str]):
        self.root: dict[str, dict] = {}
        self.link: dict[int, dict] = {}
        self.length = {id(self.root): 0}
        self.states = [self.root]
        self.size = sum(map(len, texts))
        for text in texts:
            last = self.root
            for c in text:
                last = self.extend(last, c)
        del self.link, self.length  # only building needs them

    def state(self, length: int, link: dict, edges: dict) -> dict:
        self.states.append(edges)
        self.length[id(edges)] = length
        self.link[id(edges)] = link
        return edges

    def extend(self, last: dict, c: str) -> dict:
        """The state of the current text one letter on; texts share states where they share substrings."""
        length, link = self.length, self.link
        if c in last:
            q = last[c]
            return q if length[id(q)] == length[id(last)] + 1 else self.split(last, c, q)
        new, p = self.state(length[id(last)] + 1, self.root, {}), last
        while p is not None and c not in p:
            p[c] = new
            p = link.get(id(p))
        if p is not None:
            q = p[c]
            link[id(new)] = q if length[id(q)] == length[id(p)] + 1 else self.split(p, c, q)
        return new

    def split(self, p: dict, c: str, q: dict) -> dict:
        """A copy of q for the shorter matches that reach it from p."""
        copy = self.state(self.length[id(p)] + 1, self.link[id(q)], dict(q))
        self.link[id(q)] = copy
        while p is not None and p.get(c) is q:
            p[c] = copy
            p = self.link.get(id(p))
        return copy

    def phrases(self, text: str) -> int:
        """Phrases of a greedy parse of the text into longest matches."""
        root = state = self.root
        count = 0
        for c in text:
            if c in state:
                state = state[c]
            else:
                count += state is not root
                if c in root:
                    state = root[c]
                else:
                    count += 1
                    state = root
        return count + (state is not root)


class Model:
    """Automata of all languages, in the order given."""

    def __init__(self, learned: tuple[tuple[str, tuple[str, ...]], ...]):
        self.names = [n for n, _ in learned]
        self.automata = [SuffixAutomaton([letters(t) for t in texts]) for _, texts in learned]
        self.bits = [math.log2(a.size + 2) for a in self.automata]

    def judged(self, text: str) -> tuple[str, float, float, int]:
        """The language in which a text costs least (ties: the first given), how far the next one is (0 to 1), bits a letter, and letters."""
        plain = letters(text)
        n = len(plain) - plain.count(" ")
        if not n or not self.names:
            return UNKNOWN, 0.0, 0.0, n
        costs = sorted((a.phrases(plain) * b, i) for i, (a, b) in enumerate(zip(self.automata, self.bits, strict=True)))
        return self.names[costs[0][1]], 1.0 if len(costs) == 1 else 1.0 - costs[0][0] / costs[1][0], costs[0][0] / n, n


@functools.lru_cache(maxsize=1)
def model_of(learned: tuple[tuple[str, tuple[str, ...]], ...]) -> Model:
    return Model(learned)


def training_texts(labelled: DataFrame, docs: int = DOCS, longest: int = LONGEST, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Texts of up to `docs` labelled rows of each language, the commonest language first.

    Rows are taken whose hash (of id and text, so that copies of one text don't come or go together) lies below a level
    set by their language's number of rows; of these the first `docs`. So texts beyond the sample aren't shuffled.
    """
    usable = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(doc, text).alias("at")).where("lang IS NOT NULL AND text IS NOT NULL")
    short = F.length("text") <= longest
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(short, 1)).alias("short"), F.min(F.struct(F.length("text").alias("length"), "at")).alias("least")).collect()
    if not sizes:
        return ()
    level = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, 4 * docs / max(1, r.short)))])
    sample = usable.where(short & (F.pmod("at", F.lit(1 << 30)) < F.element_at(level, F.col("lang")) * (1 << 30)))
    least = [r for r in sizes if not r.short]
    if least:
        only = F.create_map(*[F.lit(x) for r in least for x in (r.lang, r.least["at"])])
        sample = sample.union(usable.where(F.col("at") == F.try_element_at(only, F.col("lang"))).dropDuplicates(["lang"]))
    first = Window.partitionBy("lang").orderBy("at", "text")
    rows = sample.withColumn("n", F.row_number().over(first)).where(F.col("n") <= docs).orderBy("lang", "n").collect()
    found: dict[str, list[str]] = {}
    for row in rows:
        found.setdefault(row.lang, []).append(row.text)
    return tuple((r.lang, tuple(found.get(r.lang, ()))) for r in sorted(sizes, key=lambda r: (-r.n, r.lang)))


def identify(docs: DataFrame, learned: tuple[tuple[str, tuple[str, ...]], ...], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score, bits (a letter) and n_letters to every row; the prediction reads nothing but the text. `keep`: columns to return, all by default.

    A null text, one without letters, and any text where no language was learned get `und` and 0. Ties go to the
    commoner language. Repeated rows are judged alike, texts of any length are parsed whole, an empty table gives no
    rows, and other columns pass through (columns named as those added are replaced).
    """
    added = ("lang_pred", "score", "bits", "n_letters")
    kept = docs.drop(*added)
    keep = kept.columns if keep is None else keep
    schema = ", ".join([*(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double, bits double, n_letters long"])
    extra = [] if text in keep else [text]
    kept, at_text = kept.select(*[F.col(f"`{c}`") for c in (*keep, *extra)]), [*keep, *extra].index(text)
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for batch in batches:
            found = [model.judged(t.as_py() or "") for t in batch.column(at_text)]
            columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [()] * 4, (pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, *added])
        # A worker goes on to other stages. Building again takes less than a second, keeping takes memory from those.
        del model
        model_of.cache_clear()
        give_back()

    return kept.mapInArrow(run, schema)


def accepted(foreign: float = FOREIGN, least: int = LETTERS) -> F.Column:
    """Whether an identified row is in one of the languages: it has letters, and doesn't cost as much as a text in none of them."""
    return (F.col("lang_pred") != UNKNOWN) & ((F.col("n_letters") < least) | (F.col("bits") < foreign))


def held_out(doc: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = training_texts(docs.where(~held_out()))
    return identify(docs, learned, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
