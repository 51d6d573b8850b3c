"""Which questions' units a text contains, without pairing every question with every text.

The units of all questions form one automaton (Aho-Corasick), which reads a text
once however many units there are.  What a text holds is added up per question
on the spot, so nothing but the wanted pairs leaves the scan: no shuffle.
Questions travel to the texts in passes of at most ``LIMIT`` units, whatever
their number; a question lies in one pass.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lucerna.session import dealt

#: Units of questions that one pass searches for, about: the automaton and the counts of a pass stay below some 200 MB.
LIMIT = 500_000


def folded(text: str | None) -> str:
    """Compatibility forms made plain, lower case: how units and texts are compared."""
    if not text:
        return ""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


@dataclass(frozen=True)
class Best:
    """Keeps, in each task, the k best texts of each question instead of every text that shares a unit with it.

    ``prior`` is a column of the texts, numbers for each kind of question one after
    the other; ``kind`` a column of the questions; ``tie`` a column of the texts.
    ``score`` takes the shares of a question's units in a text and in its best line
    and the prior's numbers of its kind (a row each); higher is better, ties go to
    the lesser ``tie``.  What is kept may be scored anew: near the k-th best all stay.
    """

    k: int
    prior: str
    kind: str
    tie: str
    score: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


#: Kinds of questions that a prior tells apart.
KINDS = 20
#: Scores that close are equal to the scan.
_CLOSE = 1e-8


class _Kept:
    """The best of each question so far."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.held = k, np.full(n, -np.inf), [[] for _ in range(n)]

    def add(self, asked: np.ndarray, scores: np.ndarray, rows: Callable[[int], tuple]) -> None:
        for i in np.flatnonzero(scores >= self.least[asked] - _CLOSE).tolist():
            own = self.held[asked[i]]
            own.append((-float(scores[i]), *rows(i)))
            if len(own) >= 4 * self.k + 8:
                self.cut(int(asked[i]))

    def cut(self, q: int) -> list:
        own = sorted(self.held[q], key=lambda r: r[:2])
        if len(own) > self.k:
            last = own[self.k - 1]
            # of scores that are close, those that tie better or equally well may still win
            self.held[q] = own = own[: self.k] + [r for r in own[self.k :] if r[0] <= last[0] + _CLOSE and (r[0] < last[0] - 1e-12 or abs(r[0] - last[0]) > 1e-12)]
            self.least[q] = -last[0]
        else:
            self.held[q] = own
        return own


class Units:
    """An automaton over the units of some questions, built where it is used."""

    def __init__(self, asked: list[tuple[object, list[str]]]):
        self.asked, self._ready = asked, None

    def __getstate__(self):
        return self.asked

    def __setstate__(self, asked):
        self.__init__(asked)

    def ready(self):
        if self._ready is None:
            import ahocorasick

            places: dict[str, list[int]] = {}
            for q, (_, units) in enumerate(self.asked):
                for u in set(units):
                    places.setdefault(u, []).append(q)
            automaton = ahocorasick.Automaton()
            for i, u in enumerate(places):
                automaton.add_word(u, i)
            if places:
                automaton.make_automaton()
            self._ready = automaton if places else None, [np.array(x) for x in places.values()], np.array([max(1, len(set(u))) for _, u in self.asked])
            self._best = np.zeros(len(self.asked), np.int64)
        return self._ready

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The questions that the text holds a unit of, how many of its units each finds in the text, and how many in its best line.

        What is found is added up; lines without a unit cost nothing, and the number
        of questions little.
        """
        automaton, places, sizes = self.ready()
        none = np.zeros(0, np.int64)
        if automaton is None or not text:
            return none, none, none
        ends = [i for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
        line, n, lines, found = 0, len(ends), [], set()
        for at, unit in automaton.iter(text):
            if line < n and at > ends[line]:
                lines.append(found)
                found = set()
                while line < n and at > ends[line]:
                    line += 1
            found.add(unit)
        lines = [x for x in [*lines, found] if x]
        if not lines:
            return none, none, none
        asked, whole = self._counted(set().union(*lines))
        if len(lines) == 1:
            return asked, whole, whole
        best = self._best
        for units in lines:
            own, counts = self._counted(units)
            best[own] = np.maximum(best[own], counts)
        found = best[asked]
        best[asked] = 0
        return asked, whole, found

    def _counted(self, units: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """The questions that some units belong to, and how many to each: by counting where they are many, else by sorting them."""
        _, places, sizes = self._ready
        every = np.concatenate([places[u] for u in units])
        if 16 * len(every) < len(sizes):
            return np.unique(every, return_counts=True)
        counts = np.bincount(every)
        own = np.flatnonzero(counts)
        return own, counts[own]


def matched_units(questions: DataFrame, key: str, texts: DataFrame, corpus: str, keep: list[str], least: float = 0.0, best: Best | None = None) -> DataFrame:
    """(key, n_units, ``keep`` columns, n_hits, n_best) of every pair that shares a unit, and at least that share of them.

    ``questions`` has ``key`` and ``units`` (folded, without line ends); n_best is
    the hits of the text's best line.  A question without units and an empty text
    match nothing.  With ``best`` those pairs only that may be among a question's
    best leave a task.
    """
    spark = texts.sparkSession
    asked = questions.where(F.size("units") > 0).select(key, "units", *([best.kind] if best else []))
    total = asked.agg(F.coalesce(F.sum(F.size("units")), F.lit(0))).first()[0]
    passes = max(1, -(-total // LIMIT))
    kind = {f.name: f.dataType.simpleString() for f in [*texts.schema, *questions.schema]}
    schema = f"`{key}` {kind[key]}, n_units int, " + "".join(f"`{c}` {kind[c]}, " for c in keep) + "n_hits long, n_best long"
    found, arrow = None, to_arrow_type(questions.schema[key].dataType)
    for p in range(passes):
        own = asked.where(F.pmod(F.xxhash64(key), F.lit(passes)) == p) if passes > 1 else asked
        rows = own.collect()
        held = spark.sparkContext.broadcast((Units([(r[0], r[1]) for r in rows]), np.array([r[2] for r in rows] if best else [], np.int64)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            units, kinds = held.value
            sizes = units.ready()[2]
            keys = pa.array([k for k, _ in units.asked]).cast(arrow)
            if best:
                yield from chosen(batches, units, kinds, sizes, keys)
                return
            for b in batches:
                out = []
                for text in b.column(b.num_columns - 1).to_pylist():
                    hit, whole, lined = units.count(folded(text))
                    enough = whole >= least * sizes[hit] - 1e-9
                    out.append((hit[enough], whole[enough], lined[enough]))
                row = pa.array(np.repeat(np.arange(b.num_rows), [len(x[0]) for x in out]))
                hit, whole, lined = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out) if out else ([], [], [])))
                columns = [keys.take(pa.array(hit)), pa.array(sizes[hit].astype(np.int32)), *(b.column(i).take(row) for i in range(len(keep))), pa.array(whole), pa.array(lined)]
                yield pa.record_batch(columns, names=[key, "n_units", *keep, "n_hits", "n_best"])

        def chosen(batches, units, kinds, sizes, keys) -> Iterator[pa.RecordBatch]:
            kept, schemas = _Kept(len(sizes), best.k), None
            for b in batches:
                schemas = [b.column(i).type for i in range(len(keep))]
                values = [b.column(i).to_pylist() for i in range(len(keep))]
                ties, priors = b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist()
                for r, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    hit, whole, lined = units.count(folded(text))
                    enough = whole >= least * sizes[hit] - 1e-9
                    hit, whole, lined = hit[enough], whole[enough], lined[enough]
                    if len(hit):
                        prior = np.array(priors[r], np.float64).reshape(-1, max(1, len(priors[r]) // KINDS))[kinds[hit]]
                        scores = best.score(whole / sizes[hit], lined / sizes[hit], prior)
                        kept.add(hit, scores, lambda i, r=r, whole=whole, lined=lined: (ties[r], int(whole[i]), int(lined[i]), *(v[r] for v in values)))
            out = [(q, row) for q in range(len(sizes)) for row in kept.cut(q)]
            if out:
                own = np.array([q for q, _ in out])
                columns = [keys.take(pa.array(own)), pa.array(sizes[own].astype(np.int32)), *(pa.array([row[4 + i] for _, row in out], t) for i, t in enumerate(schemas)), *(pa.array([row[i] for _, row in out], pa.int64()) for i in (2, 3))]
                yield pa.record_batch(columns, names=[key, "n_units", *keep, "n_hits", "n_best"])

        extra = [F.col(best.tie).alias("_tie"), F.col(best.prior).alias("_prior")] if best else []
        one = dealt(texts.select(*keep, *extra, F.col(corpus).alias("_corpus"))).mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found


def containing(passages: DataFrame, key: str, column: str, texts: DataFrame, corpus: str, keep: list[str]) -> DataFrame:
    """(key, ``keep`` columns of texts) of every text that holds a passage as it is written; an empty passage is in none."""
    spark = texts.sparkSession
    some = passages.where(F.col(column) != "").select(F.col(key).alias("key"), F.col(column).alias("passage"))
    total = some.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    passes = max(1, int(-(-total // (16 * LIMIT))))
    kind = {f.name: f.dataType.simpleString() for f in [*texts.schema, *passages.schema]}
    found, arrow = None, to_arrow_type(passages.schema[key].dataType)
    for p in range(passes):
        own = some.where(F.pmod(F.xxhash64("passage"), F.lit(passes)) == p) if passes > 1 else some
        by: dict[str, list] = {}
        for k, passage in own.collect():
            by.setdefault(passage, []).append(k)
        held = spark.sparkContext.broadcast(by)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            by, automaton = held.value, ahocorasick.Automaton()
            for passage in by:
                automaton.add_word(passage, passage)
            if by:
                automaton.make_automaton()
            for b in batches:
                hits = [{x for _, x in automaton.iter(t)} if t and by else set() for t in b.column(b.num_columns - 1).to_pylist()]
                pairs = [(k, i) for i, some in enumerate(hits) for x in some for k in by[x]]
                row = pa.array([i for _, i in pairs], pa.int64())
                yield pa.record_batch([pa.array([k for k, _ in pairs]).cast(arrow), *(b.column(i).take(row) for i in range(len(keep)))], names=[key, *keep])
        one = dealt(texts.select(*keep, F.col(corpus).alias("_corpus"))).mapInArrow(run, f"`{key}` {kind[key]}" + "".join(f", `{c}` {kind[c]}" for c in keep))
        found = one if found is None else found.unionByName(one)
    return found
