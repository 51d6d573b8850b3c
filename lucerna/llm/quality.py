"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on the driver from a bounded sample of labelled rows, over
features cut into bins.  All trees have the same depth and are stored as flat
arrays (feature, threshold, leaf), so that a batch of documents walks down every
tree at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lucerna.llm.bpe import slices
from lucerna.llm.common import bytes_of

#: About so many labelled rows of each class are learned from.
SAMPLE = 6000
DEPTH, TREES, BINS, RATE = 4, 80, 32, 0.15
_MARKS = list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def features(text: bytes) -> np.ndarray:
    """Statistics of a whole text: byte classes, marks, words and lines; zeros for an empty one."""
    a = np.frombuffer(text, np.uint8)
    n = len(a)
    hist = np.bincount(a, minlength=256)
    words, lines = text.split(), text.split(b"\n")
    out = np.zeros(20 + len(_MARKS))
    if not n:
        return out
    p = hist[hist > 0] / n
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    ends = np.frombuffer(b"".join([w[-1:] for w in words]) or b" ", np.uint8)
    width = np.fromiter(map(len, lines), np.int64, len(lines))
    low, up = hist[97:123].sum(), hist[65:91].sum()
    out[:20] = (
        np.log1p(n), np.log1p(len(words)), low / n, up / n, hist[48:58].sum() / n, hist[128:].sum() / n, hist[32] / n,
        hist[_MARKS].sum() / n, up / (low + up + 1), -(p * np.log2(p)).sum(), lens.mean(), lens.std(), lens.max(),
        len(set(words)) / max(1, len(words)), np.isin(ends, _MARKS).mean(), hist[10] / n, np.log1p(width.max()),
        len(set(lines)) / len(lines), (hist / n).max(), np.log1p(len(lines)),
    )
    out[20:] = hist[_MARKS] / n
    return out


class Trees:
    """Boosted trees of one depth as flat arrays."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        t = np.arange(len(self.leaf))
        if not len(t):
            return np.full(len(x), self.base)
        row, node = np.arange(len(x))[:, None], np.zeros((len(x), len(t)), np.int64)
        for _ in range(DEPTH):
            right = x[row, self.feature[t, node]] > self.threshold[t, node]
            node = 2 * node + 1 + right
        return self.base + self.leaf[t, node - (2**DEPTH - 1)].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Logistic boosting; splits maximise the second-order gain over bin histograms."""
    n, m = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner = 2**DEPTH - 1
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if n < 2 or y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    flat = binned + np.arange(m) * BINS
    f, margin = [], np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feat, thr, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS, np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            code = ((node - first)[:, None] * (m * BINS) + flat).ravel()
            size = width * m * BINS
            hg = np.bincount(code, np.repeat(g, m), size).reshape(width, m, BINS)
            hh = np.bincount(code, np.repeat(h, m), size).reshape(width, m, BINS)
            gl, hl = hg.cumsum(2), hh.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < 3) | (ht - hl < 3)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k, b in enumerate(best.tolist()):
                j, at = divmod(b, BINS)
                if gain[k, j, at] > 1e-6 and at < len(edges[j]):
                    feat[first + k], thr[first + k], cut[first + k] = j, edges[j][at], at
            node = 2 * node + 1 + (binned[np.arange(n), feat[node]] > cut[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + 1)
        margin += leaf[at]
        f.append((feat, thr, leaf))
    return Trees(base, *(np.stack(a) for a in zip(*f)))


def _over(df: DataFrame, rows, schema: str, *extra: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield rows(b, np.stack([features(t) for t in bytes_of(b.column("text"))]))

    return df.select("id", "text", *extra).mapInArrow(run, schema)


def fit(sample: DataFrame) -> Trees:
    """Learns from a bounded sample of (id, text, y); its features are gathered to the driver."""
    kind = sample.schema["id"].dataType.simpleString()
    rows = lambda b, x: pa.record_batch([b.column("id"), b.column("y"), pa.array(list(x.tolist()), pa.list_(pa.float64()))], names=["id", "y", "x"])
    got = _over(sample, rows, f"id {kind}, y int, x array<double>", "y").collect()
    got.sort(key=lambda r: str(r[0]))
    if not got:
        return grow(np.zeros((0, 1)), np.zeros(0))
    return grow(np.array([r[2] for r in got]), np.array([r[1] for r in got], float))


def score(df: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column and ``score`` (0 to 1).

    Whole texts are read; a null or empty text has all-zero statistics and is
    scored from them; repeated rows are each scored; other columns are ignored;
    an empty table gives no rows.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()
    rows = lambda b, x: pa.record_batch([b.column("id"), pa.array(held.value.probability(x))], names=[id_col, "score"])
    return _over(df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), rows, f"`{id_col}` {kind}, score double")
