"""Language identification by words, backing off to character n-grams.

A word that the model knows scores by its log frequency in each language.  An
unseen word falls back to its longest known character n-grams, five characters
first, then progressively shorter ones, down to single characters.  A text's
score is the posterior of the best language under the mean word score, tempered
by the number of words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.llm.bpe import slices
from lucerna.llm.common import texts_of

#: About so many texts of each language are learned from (an expected size: rows are picked by a hash).
SAMPLE = 800
#: Words, and n-grams of each length, that the model keeps of each language at most.
KEPT = 8000
LONGEST = 5
#: Languages that a model may have; more are an error (a column of something else), none is left out silently.
LANGUAGES = 1000
REMEMBERED = 300_000
#: Words beyond which more text doesn't sharpen the posterior.
EVIDENCE = 20
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def has_letter(found: list[str]) -> bool:
    """Whether the words hold a letter (the word pattern also admits some numerals)."""
    return any(w.isalpha() or any(c.isalpha() for c in w) for w in found)


def grams(word: str, n: int) -> list[str]:
    s = f"_{word}_" if n > 1 else word
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def count_units(df: DataFrame) -> DataFrame:
    """(lang, n, unit, count) over the texts of (lang, text): n = 0 for words, else n-grams by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                by: dict[str, Counter] = {}
                for lang, text in zip(b.column("lang").to_pylist(), texts_of(b.column("text"))):
                    by.setdefault(lang, Counter()).update(words(text))
                out: Counter = Counter()
                for lang, found in by.items():
                    levels = [found, *(Counter() for _ in range(LONGEST))]
                    for w, k in found.items():
                        for n in range(1, LONGEST + 1):
                            level = levels[n]
                            for g in grams(w, n):
                                level[g] += k
                    out.update({(lang, n, u): k for n, level in enumerate(levels) for u, k in level.items()})
                if out:
                    keys = list(out)
                    yield pa.record_batch([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys]), pa.array(list(out.values()), pa.int64())], names=["lang", "n", "unit", "count"])

    counted = df.select("lang", "text").mapInArrow(run, "lang string, n int, unit string, count long")
    return counted.groupBy("lang", "n", "unit").agg(F.sum("count").alias("count"))


class Model:
    """Log frequencies of units by language; a table of words grows as texts are read, within a bound.

    ``units`` holds, for words (0) and for n-grams by length, each unit's row in ``logs``.
    """

    def __init__(self, langs: list[str], units: list[dict[str, int]], logs: np.ndarray):
        self.langs, self.units, self.logs = langs, units, logs
        self._fresh()

    def __getstate__(self):
        return self.langs, self.units, self.logs

    def __setstate__(self, x):
        self.__init__(*x)

    def _fresh(self) -> None:
        self.row: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, max(1, len(self.langs))), np.float32)

    def _units_of(self, word: str) -> list[int]:
        """The rows that score a word: its own, or those of its longest known n-grams."""
        at = self.units[0].get(word)
        if at is not None:
            return [at]
        s = f"_{word}_"
        for n in range(LONGEST, 1, -1):
            get = self.units[n].get
            known = [i for k in range(len(s) - n + 1) if (i := get(s[k : k + n])) is not None]
            if known:
                return known
        get = self.units[1].get
        return [i for c in word if (i := get(c)) is not None]

    def _learn(self, new: list[str]) -> None:
        flat: list[int] = []
        ends = []
        for w in new:
            flat += self._units_of(w)
            ends.append(len(flat))
        at, to = len(self.row), len(self.row) + len(new)
        while to > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        total = np.concatenate([np.zeros((1, self.rows.shape[1])), self.logs[flat].cumsum(0, dtype=np.float64)])
        ends = np.array(ends)
        starts = np.append(0, ends[:-1])
        self.rows[at:to] = (total[ends] - total[starts]) / np.maximum(ends - starts, 1)[:, None]
        self.row.update(zip(new, range(at, to)))

    def scores(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        if len(self.row) > REMEMBERED:
            self._fresh()
        cut = [words(t) for t in texts]
        new = [w for w in dict.fromkeys(w for c in cut for w in c) if w not in self.row] if self.langs else []
        if new:
            self._learn(new)
        for found in cut:
            if not self.langs or not has_letter(found):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.rows[np.fromiter(map(self.row.__getitem__, found), np.int64, len(found))].sum(0, dtype=np.float64)
            total *= min(len(found), EVIDENCE) / len(found)
            p = np.exp(total - total.max())
            best = int(p.argmax())
            langs.append(self.langs[best])
            scores.append(float(p[best] / p.sum()))
        return langs, scores


def train(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> Model:
    """Learns from rows that have a text and a language: about ``bound`` of each, whole texts, the same ones in every run.

    Of each language the ``KEPT`` most frequent words and n-grams of each length
    are kept, which bounds what the driver gathers.
    """
    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    share = F.lit(0.0)
    for lang, n in sizes:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, bound / n))).otherwise(share)
    few = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30))
    units = count_units(few)
    top = Window.partitionBy("lang", "n").orderBy(F.desc("count"), "unit")
    kept = units.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= KEPT).drop("rank").toPandas()
    langs = sorted(set(kept["lang"]))
    at = {lang: i for i, lang in enumerate(langs)}
    units: list[dict[str, int]] = []
    logs = [np.zeros((0, max(1, len(langs))), np.float32)]
    for n in range(LONGEST + 1):
        part = kept[kept["n"] == n]
        index = {u: i for i, u in enumerate(dict.fromkeys(part["unit"]))}
        m = np.zeros((len(index), max(1, len(langs))))
        m[[index[u] for u in part["unit"]], [at[x] for x in part["lang"]]] = part["count"]
        first = sum(map(len, logs))
        if index:
            m = np.log((m + 0.5) / (m.sum(0) + 0.5 * len(index)))
            m -= m.mean(1, keepdims=True)
        logs.append(m.astype(np.float32))
        units.append({u: first + i for u, i in index.items()})
    return Model(langs, units, np.concatenate(logs))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, ``lang_pred`` and ``score``.

    A null text, or one without a letter, gets ``und`` and score 0; so does any
    text if nothing was learned.  Ties go to the first language by name.  Texts
    are read whole; repeated rows are each answered; an empty table gives no rows;
    other columns are ignored.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for b in slices(whole, "text"):
                langs, scores = m.scores(texts_of(b.column("text")))
                yield pa.record_batch([b.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep(df: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with their columns, whose text has a language with at least that score."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for b in slices(whole, text_col):
                langs, scores = m.scores(texts_of(b.column(b.schema.get_field_index(text_col))))
                yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
