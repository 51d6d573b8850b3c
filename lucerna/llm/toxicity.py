"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.
A text's windows are its words and the space around them; a run of more than
WINDOW bytes, as text without spaces is, is read in overlapping windows.  Each window is
compressed under either dictionary; the bytes that the toxic dictionary saves
over the ordinary one are its gain.  A document's gains (how many windows reach
each step, and the greatest) are calibrated into a probability on labelled rows
that the dictionaries haven't seen.

A window is spelled out before it is compressed, four bytes for each of its own:
zstandard ignores very short matches and counts whole bytes, so that a word of
five letters would otherwise compress alike under any dictionary.  A fixed
preamble and tail, both in the dictionaries, keep the frame's own cost the same.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.bpe import slices
from lucerna.llm.common import bytes_of

#: At most about so many labelled rows of each class are learned from (an expected size: rows are picked by a hash).
SAMPLE = 3000
SIZES = {"toxic": 1024, "ordinary": 4096}
STEPS = (3, 4, 5, 6, 7, 8, 9, 10, 12)
REMEMBERED = 600_000
#: Bytes of a window, and how many windows of a longer run share: more than the beginning of a word in a dictionary has.
WINDOW, OVERLAP = 64, 36
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_HEAD, _TAIL = b"0123456789abcdefghijklmnopqrstuvwxyz", b"ZYXWVUTSRQPONMLKJIHGFEDCBA@"
_SPELLED = [bytes((q * m + c) & 255 for m, c in ((167, 13), (91, 71), (203, 5), (45, 177))) for q in range(256)]


def spell(window: bytes) -> bytes:
    return b"".join(map(_SPELLED.__getitem__, window))


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(window_log=14, chain_log=11, hash_log=11, search_log=5, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False)
    held = zstandard.ZstdCompressionDict(spell(content) + _TAIL + _HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def windows(found: list[bytes]) -> list[bytes]:
    """The words in their spaces; longer runs as windows of at most about WINDOW bytes that overlap and cut no character."""
    out = []
    for w in found:
        at, before = 0, b" "
        while len(w) - at > WINDOW:
            to, back = at + WINDOW, at + WINDOW - OVERLAP
            while w[to] & 0xC0 == 0x80 and to > back + 4:
                to -= 1
            while w[back] & 0xC0 == 0x80 and back > at + 1:
                back -= 1
            out.append(before + w[at:to])
            at, before = back, b""
        out.append(before + w[at:] + b" ")
    return out


def segments(found: set[bytes]) -> set[bytes]:
    """What a dictionary may hold of a text: its words, and the beginnings of the longer ones."""
    out = {b" " + w + b" " for w in found}
    for w in found:
        s = w.decode("utf-8", "ignore")
        out.update(b" " + s[:n].encode() for n in range(4, min(len(s), 9)))
    return out


def train(own: Counter, other: Counter, n_own: int, n_other: int, size: int, least: float) -> bytes:
    """The segments that the class has in excess, by the bytes they save; the best last, nearest to what is compressed."""
    scored = []
    for s, a in own.items():
        if a < 4:
            continue
        b = other.get(s, 0)
        p = (a + b) / (n_own + n_other)
        z = (a / n_own - b / n_other) / math.sqrt(p * (1 - p) * (1 / n_own + 1 / n_other) + 1e-12)
        if z >= least:
            scored.append((z * len(s), s))
    out = b""
    for _, s in sorted(scored, reverse=True):
        if len(out) + len(s) > size:
            break
        if s not in out:
            out = s + out
    return out


class Model:
    """Two dictionaries and the calibration of a document's gains."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: np.ndarray | None = None):
        self.toxic, self.ordinary, self.weights = toxic, ordinary, weights
        self._ready = None

    def __getstate__(self):
        return self.toxic, self.ordinary, self.weights

    def __setstate__(self, x):
        self.__init__(*x)

    def gains(self, found: list[bytes]) -> np.ndarray:
        if self._ready is None:
            pair = compressor(self.toxic), compressor(self.ordinary)
            self._ready = pair, {}, [len(c.compress(_HEAD + _TAIL)) for c in pair]
        (t, o), known, (bt, bo) = self._ready
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(found):
            if w not in known:
                x = _HEAD + spell(w) + _TAIL
                known[w] = (len(o.compress(x)) - bo) - (len(t.compress(x)) - bt)
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))

    def features(self, text: bytes) -> np.ndarray:
        found = windows(words(text))
        g = np.clip(self.gains(found), -1, 12) if found else np.zeros(1, np.int64)
        n = np.bincount(g + 1, minlength=14)[::-1].cumsum()[::-1]
        hits = np.array([n[s + 1] for s in STEPS], float)
        return np.concatenate([[1.0], np.log1p(hits), hits / math.sqrt(len(found) + 20), [max(0, int(g.max())) / 6]])

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        w = w - np.linalg.solve(h, x.T @ (p - y) + penalty @ w)
    return w


def fit(rows: list[tuple[object, bytes, int]]) -> Model:
    """Learns from (id, text, label); half of the rows, by a hash of the id, train the dictionaries, the others calibrate.

    Which excess a segment must have to enter the toxic dictionary is chosen by the calibrating half's loss.
    """
    counts, n = {0: Counter(), 1: Counter()}, {0: 0, 1: 0}
    learned = [xxhash.xxh32_intdigest(str(i)) % 2 == 0 for i, _, _ in rows]
    for (_, text, label), own in zip(rows, learned):
        if own:
            counts[label].update(segments(set(words(text))))
            n[label] += 1
    rest = [r for r, own in zip(rows, learned) if not own] or rows
    y = np.array([r[2] for r in rest], float)
    if not rows or not n[0] or not n[1] or y.min() == y.max():
        share = (sum(r[2] for r in rows) + 0.5) / (len(rows) + 10)
        m = Model(b"", b"")
        m.weights = np.zeros(2 * len(STEPS) + 2)
        m.weights[0] = math.log(share / (1 - share))
        return m
    best = None
    for least in (7.0, 9.0):
        m = Model(train(counts[1], counts[0], n[1], n[0], SIZES["toxic"], least), train(counts[0], counts[1], n[0], n[1], SIZES["ordinary"], -1e9))
        x = np.stack([m.features(r[1]) for r in rest])
        m.weights = calibrate(x, y)
        p = np.clip(m.score(x), 1e-6, 1 - 1e-6)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        if best is None or loss < best[0]:
            best = loss, m
    return best[1]


def sample(df: DataFrame, label: str, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows of each label (0 and 1), picked by a hash of the id: the same ones in every run."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for k, count in sizes.items():
        share = F.when(F.col(label) == k, F.lit(min(1.0, bound / count))).otherwise(share)
    return df.where(F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of a bounded sample of labelled rows: the labels that ``keep`` admits, one per id.

    The sampled labels, about 2 x ``bound`` rows, are broadcast to the scan of the texts.
    """
    from pyspark.sql.functions import broadcast

    y = labels.where(F.col(label).isin(0, 1) & keep(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    few = sample(y, "y", bound, 7).limit(3 * bound)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(broadcast(few), "id").select("id", "text", "y")


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column and ``score`` (0 to 1).

    Whole texts are read, of any length; a null or empty text has no window and
    gets the score of no gain; repeated rows are scored each; other columns are
    ignored; an empty table gives no rows.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for b in slices(whole, "text"):
                x = np.stack([m.features(t) for t in bytes_of(b.column("text"))])
                yield pa.record_batch([b.column("id"), pa.array(m.score(x))], names=[id_col, "score"])

    return df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"`{id_col}` {kind}, score double")
