"""Words of scripts that put no spaces between them: the cheapest path through what a dictionary finds.

All words of the dictionary form one automaton, which reads a run once and gives
every word that ends at each place; the best way to a place is the best way to
where such a word begins, and the word's cost.  A letter that no word covers
stands alone at the dearest cost.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a dictionary, the most frequent first: what a worker holds.
WORDS = 500_000
# Scripts without spaces between words.
UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
_RUN = re.compile(f"[{UNSPACED}]+|[^\\W{UNSPACED}]+")
_IDENTIFIER = re.compile(r"[\w./:+#-]{2,}")
_UNSPACED = re.compile(f"[{UNSPACED}]")


def dictionary(words: DataFrame, most: int = WORDS) -> DataFrame:
    """(word, cost) of the most frequent words: the negated logarithm of their share.  ``words`` is (word), a row for each occurrence."""
    counts = words.where(F.length("word") > 0).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("word", (-F.log(F.col("n") / F.col("total"))).alias("cost"))


class Lattice:
    """A dictionary's automaton, built where it is used."""

    def __init__(self, words: list[tuple[str, float]]):
        self.words, self._ready = words, None
        self.dearest = max((c for _, c in words), default=0.0) + math.log(100)

    def __getstate__(self):
        return self.words

    def __setstate__(self, words):
        self.__init__(words)

    def cut(self, run: str) -> list[str]:
        """The cheapest words of a run; of equal costs, fewer words, then the longer last one."""
        if self._ready is None:
            import ahocorasick

            self._ready = ahocorasick.Automaton()
            for w, c in self.words:
                self._ready.add_word(w, (len(w), c))
            if self.words:
                self._ready.make_automaton()
        ends: list[list[tuple[int, float]]] = [[] for _ in run]
        if self.words:
            for at, found in self._ready.iter(run):
                ends[at].append(found)
        best = [(0.0, 0, 0)]
        for i in range(len(run)):
            ways = [(best[i + 1 - n][0] + c, best[i + 1 - n][1] + 1, -n) for n, c in ends[i]]
            ways.append((best[i][0] + self.dearest, best[i][1] + 1, -1))
            best.append(min((round(c, 9), k, n) for c, k, n in ways))
        out, at = [], len(run)
        while at:
            n = -best[at][2]
            out.append(run[at - n : at])
            at -= n
        return out[::-1]

    def segment(self, text: str) -> list[str]:
        """The words of a text: letters and digits between anything else, and runs of unspaced scripts cut by the dictionary."""
        out: list[str] = []
        for m in _RUN.finditer(text):
            out += self.cut(m[0]) if _UNSPACED.match(m[0]) else [m[0]]
        return out


def folded(word: str) -> str:
    return unicodedata.normalize("NFKC", word).lower()


def terms(text: str, lattice: Lattice) -> list[str]:
    """The distinct terms of a question: its words, then whole identifiers, of more than one letter."""
    found = [folded(w) for w in lattice.segment(text)]
    found += [folded(m[0]) for m in _IDENTIFIER.finditer(text)]
    return [t for t in dict.fromkeys(found) if len(t) > 1]


def segmented(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """(key, words, terms) of each text; a null one has none.  ``words`` is ``dictionary``'s (word, cost), bounded by its size."""
    kind = df.schema[key].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(Lattice([(r[0], r[1]) for r in words.select("word", "cost").collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = held.value
        for b in batches:
            texts = [t or "" for t in b.column("v").to_pylist()]
            columns = [b.column("k"), pa.array([lattice.segment(t) for t in texts], pa.list_(pa.string())), pa.array([terms(t, lattice) for t in texts], pa.list_(pa.string()))]
            yield pa.record_batch(columns, names=[key, "words", "terms"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("v")).mapInArrow(run, f"`{key}` {kind}, words array<string>, terms array<string>")
