"""Exact and near-duplicate folding within an origin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions import texts
from lucerna.session import dealt, saved, shared_dir

SLOTS = 64
_MASK = 4294967295


def exact_representatives(df: DataFrame, origin: str, text: str, key: str) -> DataFrame:
    """(origin, digest, representative, n_copies) of texts that occur more than once within an origin."""
    return df.groupBy(origin, F.sha2(F.col(text), 256).alias("digest")).agg(F.min(key).alias("representative"), F.count("*").alias("n_copies")).where("n_copies > 1")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order; an aggregate, so the copies of a hot key are reduced where they are read."""
    first = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_e"))
    return first.select(*[F.col(f"_e.{c}").alias(c) for c in df.columns])


#: Counters by which shingles are ordered.
COUNTERS = 1 << 18


def _probes(sets: DataFrame, origin: str, least: float) -> DataFrame:
    """(origin, id, n, pos, h): the first n - ceil(least n) + 1 shingles of each set, the rare ones first.

    How rare a shingle is, is read from one of COUNTERS counters that it shares
    with others: any order serves, if it is the same for all sets, and a common
    shingle never hides in a low counter.  So no shingle is dealt to be counted,
    and those of the prefixes alone go on.
    """
    counted = sets.select(F.explode("s").alias("h")).groupBy(F.pmod("h", F.lit(COUNTERS)).cast("int").alias("at")).agg(F.count("*").alias("n"))
    counts = np.zeros(COUNTERS, np.int64)
    for at, n in counted.collect():
        counts[at] = n
    kinds = [sets.schema[c].dataType.simpleString() for c in (origin, "id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("s").flatten().to_numpy()
            size = b.column("s").value_lengths().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((h, counts[h % COUNTERS], row))
            pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            first = np.flatnonzero(pos < (size - np.ceil(size * least - 1e-9) + 1)[row])
            own = pa.array(row[first])
            columns = [b.column(origin).take(own), b.column("id").take(own), pa.array(size[row[first]], pa.int32()), pa.array(pos[first], pa.int32()), pa.array(h[order[first]])]
            yield pa.record_batch(columns, names=[origin, "id", "n", "pos", "h"])

    return sets.select(origin, "id", "s").mapInArrow(run, f"`{origin}` {kinds[0]}, id {kinds[1]}, n int, pos int, h long")


def jaccard_pairs(df: DataFrame, origin: str, text: str, key: str, least: float) -> DataFrame:
    """Pairs of an origin's texts whose 3-word shingle sets have that Jaccard similarity, by prefix filtering.

    Shingles are ordered by about how rare they are; texts that similar must share one
    of the first n - ceil(least n) + 1, so only those are joined, where sizes and
    places leave enough to share, then verified.  Equal texts are one class, met once.
    """
    sets = df.groupBy(origin, F.sha2(F.col(text), 256).alias("digest")).agg(F.min(key).alias("id"), F.first(text).alias("text"))
    sets = sets.select(origin, "id", F.array_distinct(F.transform(texts.shingles(F.col("text")), lambda s: F.xxhash64(s))).alias("s"))
    sets = saved(sets, "sets").where(F.size("s") > 0)
    probe = saved(_probes(sets, origin, least), "probes")
    a, b = probe.alias("a"), probe.alias("b")
    # what can still be shared from the first shared shingle on has to be enough
    enough = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= F.ceil((F.col("a.n") + F.col("b.n")) * (least / (1 + least)) - 1e-9)
    near = (F.col("a.n") >= F.col("b.n") * least) & (F.col("b.n") >= F.col("a.n") * least) & enough
    pairs = a.join(b, (F.col(f"a.{origin}") == F.col(f"b.{origin}")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.id") < F.col("b.id")) & near)
    pairs = pairs.select(F.col(f"a.{origin}").alias(origin), F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).distinct()
    left = sets.select(F.col("id").alias("left_id"), F.col("s").alias("x"))
    right = sets.select(F.col("id").alias("right_id"), F.col("s").alias("y"))
    both = pairs.join(left, "left_id").join(right, "right_id")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select(origin, "left_id", "right_id", (shared / (F.size("x") + F.size("y") - shared)).alias("jaccard")).where(F.col("jaccard") >= least)


def _times(x: Column, k: int) -> Column:
    """x * k modulo 2^32, by halves, so that nothing overflows."""
    low = x * F.lit(k & 0xFFFF)
    high = F.shiftleft((x * F.lit(k >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(_MASK))


def slot_hash(text: Column, seed: int) -> Column:
    """Seeded 32-bit FNV-style hash of a string's code points with a final avalanche."""
    start = (2166136261 ^ ((seed + 1) * 0x9E3779B1 & _MASK)) & _MASK
    points = F.transform(F.split(text, "(?!^)(?!$)"), lambda c: F.conv(F.hex(F.encode(c, "utf-32")), 16, 10).cast("long"))
    x = F.aggregate(points, F.lit(start).cast("long"), lambda acc, p: _times(acc.bitwiseXOR(p), 16777619))
    x = _times(x.bitwiseXOR(F.shiftright(x, 16)), 0x85EBCA6B)
    return x.bitwiseXOR(F.shiftright(x, 13))


def _starts(seeds: int) -> np.ndarray:
    return np.array([(2166136261 ^ ((s + 1) * 0x9E3779B1 & _MASK)) & _MASK for s in range(seeds)], np.uint32)


def _avalanche(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    return x


def signature(shingles: list[str], seeds: int = SLOTS) -> list[int]:
    """The least hash of the shingles under each seed."""
    start = _starts(seeds)
    best = np.full(seeds, _MASK, np.uint32)
    for at in range(0, len(shingles), 2048):
        some = sorted(shingles[at : at + 2048], key=len)
        x = np.repeat(start[None], len(some), 0)
        lens = np.array([len(s) for s in some])
        grid = np.zeros((len(some), int(lens.max())), np.uint32)
        for i, s in enumerate(some):
            grid[i, : len(s)] = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        for j in range(grid.shape[1]):
            live = x[int(np.searchsorted(lens, j, "right")) :]
            live ^= grid[len(x) - len(live) :, j, None]
            live *= np.uint32(16777619)
        best = np.minimum(best, _avalanche(x).min(0))
    return best.astype(np.int64).tolist()


#: Words of a batch that get a table at most (1.3 KB each), how often they have to occur, and shingles hashed at once.
WORDS, OFTEN, STEP = 16384, 8, 1024


class _Words:
    """The hashes of ``signature`` for a batch's 3-word shingles, most of them a word at a time instead of a letter at a time.

    A letter below 256 changes nothing of a state but its low byte before the
    state is multiplied, and low bytes follow from low bytes.  So what a space and
    a word make of a state is the state times a power, plus a number that depends
    on the word and the state's low byte: a table of 256.  Frequent words have
    one; the others, and words with other letters, go by their letters.
    """

    def __init__(self, words: pa.Array, codes: np.ndarray, seeds: int):
        self.letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        self.size = pc.utf8_length(words).to_numpy()
        self.at = np.cumsum(self.size, dtype=np.int64) - self.size
        self.start = _starts(seeds)
        n = np.bincount(codes, minlength=len(words))
        if len(words):
            n[np.maximum.reduceat(self.letters, self.at) > 255] = 0
        often = np.argsort(-n, kind="stable")[:WORDS]
        often = often[n[often] >= OFTEN]
        self.row = np.full(len(words), -1)
        self.row[often] = np.arange(len(often))
        self.first = self._spelt(np.repeat(self.start[None], len(often), 0), often, False)
        low = np.repeat(np.arange(256, dtype=np.uint32)[None], len(often), 0)
        self.power = np.array([pow(16777619, k + 1, 1 << 32) for k in self.size[often].tolist()], np.uint32)
        self.table = self._spelt(low.copy(), often, True) - low * self.power[:, None]

    def _spelt(self, x: np.ndarray, codes: np.ndarray, spaced: bool) -> np.ndarray:
        """The states x after the letters of their words, with a space before them if asked for."""
        if not len(codes):
            return x
        if spaced:
            x ^= np.uint32(32)
            x *= np.uint32(16777619)
        order = np.argsort(-self.size[codes], kind="stable")
        less, at, y = -self.size[codes][order], self.at[codes][order], x[order]
        for j in range(-int(less[0])):
            live = int(np.searchsorted(less, -j))
            y[:live] ^= self.letters[at[:live] + j, None]
            y[:live] *= np.uint32(16777619)
        x[order] = y
        return x

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """Of the shingle that starts at each word but the last two, under each seed."""
        x = np.repeat(self.start[None], len(codes) - 2, 0)
        for k in range(3):
            own = codes[k : k + len(x)]
            row = self.row[own]
            rare = np.flatnonzero(row < 0)
            spelt = self._spelt(x[rare], own[rare], k > 0)
            if len(rare) < len(row):
                if not k:
                    x = self.first[row]
                else:
                    index = np.bitwise_and(x, np.uint32(255)).astype(np.intp)
                    index += (np.maximum(row, 0) * 256)[:, None]
                    x *= self.power[row][:, None]
                    x += self.table.ravel().take(index)
            x[rare] = spelt
        return _avalanche(x)


def _signatures(lists: pa.Array, seeds: int) -> tuple[np.ndarray, np.ndarray]:
    """Of lists of words: the places of those of three words or more, and a row of least hashes for each of them."""
    size = lists.value_lengths().fill_null(0).to_numpy()
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    words = _Words(coded.dictionary, codes, seeds)
    row = np.repeat(np.arange(len(size)), size)
    best = np.full((len(size), seeds), _MASK, np.uint32)
    for at in range(0, len(codes) - 2, STEP):
        some = codes[at : at + STEP + 2]
        own, last = row[at : at + len(some) - 2], row[at + 2 : at + len(some)]
        x, own = words.hashes(some)[own == last], own[own == last]
        if len(own):
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            best[own[cut]] = np.minimum(best[own[cut]], np.minimum.reduceat(x, cut))
    kept = np.flatnonzero(size > 2)
    return kept, best[kept]


def minhash(df: DataFrame, key: str, text: str, seeds: int = SLOTS) -> DataFrame:
    """(key, signature) over the distinct 3-word shingles of each text; no row without a shingle.

    Words alone travel; their shingles are hashed in numpy, many texts at once.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, found = _signatures(b.column("w"), seeds)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * seeds), pa.array(found.ravel().astype(np.int64)))
            yield pa.record_batch([b.column("k").take(pa.array(kept)), lists], names=[key, "signature"])

    some = dealt(df.select(F.col(key).alias("k"), F.col(text).alias("t"))).select("k", texts.words(F.col("t")).alias("w"))
    return some.mapInArrow(run, f"`{key}` {kind}, signature array<long>")


def similarity(a: Column, b: Column) -> Column:
    """Equal slots of two signatures; 0 unless both have all slots."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.size(a) == SLOTS) & (F.size(b) == SLOTS), same / SLOTS).otherwise(0.0)


def near_pairs(signatures: DataFrame, origin: str, key: str, least: float = 0.9) -> DataFrame:
    """Pairs within an origin at that signature similarity, found by banding that misses none.

    At most 64 - ceil(64 x least) slots differ; with more bands than that those
    that are left agree.  Equal signatures are one class, represented by the least key.
    """
    bands = 1
    while bands <= SLOTS - -(-int(SLOTS * least * 1000) // 1000) or SLOTS % bands:
        bands += 1
    width = SLOTS // bands
    # so many bands agree at least
    agree = max(1, bands - (SLOTS - -(-int(SLOTS * least * 1000) // 1000)))
    reps = saved(signatures.groupBy(origin, "signature").agg(F.min(key).alias("id")), "classes")
    rows = reps.select(origin, "id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(F.slice("signature", b * width + 1, width)))).alias("band", "h"))
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col(f"a.{origin}") == F.col(f"b.{origin}")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.id") < F.col("b.id"))
    # ids alone meet; signatures come to the pairs that enough bands bring together
    met = a.join(b, on).groupBy(F.col(f"a.{origin}").alias(origin), F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).agg(F.count("*").alias("n")).where(F.col("n") >= agree).drop("n")
    left, right = reps.select(F.col("id").alias("left_id"), F.col(origin).alias("_lo"), F.col("signature").alias("_l")), reps.select(F.col("id").alias("right_id"), F.col(origin).alias("_ro"), F.col("signature").alias("_r"))
    pairs = met.join(left, (met.left_id == left.left_id) & (F.col(origin) == F.col("_lo"))).drop(left.left_id).join(right, (met.right_id == right.right_id) & (F.col(origin) == F.col("_ro"))).drop(right.right_id)
    return pairs.select(origin, "left_id", "right_id", similarity(F.col("_l"), F.col("_r")).alias("similarity")).where(F.col("similarity") >= least)


def representatives(nodes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, representative): the least key that pairs reach, by repeated hooking of labels (order-free)."""
    spark = nodes.sparkSession
    edges = pairs.select(F.col("left_id").alias("x"), F.col("right_id").alias("y"))
    edges = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).persist()
    labels = edges.select(F.col("x").alias("id")).distinct().withColumn("label", F.col("id"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    last = None
    while True:
        heard = edges.join(labels.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.min("label").alias("heard"))
        labels = labels.join(heard, labels.id == heard.x).select("id", F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("to"))
        labels = labels.join(jump, "label", "left").select("id", F.least("label", F.coalesce("to", "label")).alias("label")).checkpoint()
        total = labels.agg(F.sum("label")).first()[0]
        if total == last or total is None:
            break
        last = total
    edges.unpersist()
    out = labels.select(F.col("id").alias("_i"), "label")
    return nodes.select(key).join(out, F.col(key) == F.col("_i"), "left").select(key, F.coalesce("label", key).alias("representative"))


def fold_sequential(df: DataFrame, origin: str, key: str, order: str, signature: str, least: float) -> DataFrame:
    """(key, representative) by arrival: each row joins the most alike representative so far, which then speaks for it.

    The order of arrival matters, so an origin's rows are folded one after the
    other; for origins that fit one task.
    """
    import numpy as np
    import pandas as pd

    kind = df.schema[key].dataType.simpleString()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order, key])
        names, signatures, out = [], [], []
        for i, s in zip(rows[key], rows[signature]):
            s = np.asarray(s)
            alike = (np.stack(signatures) == s).mean(1) if signatures else np.zeros(0)
            best = min(np.flatnonzero(alike >= least), key=lambda j: (-alike[j], names[j]), default=None)
            if best is None:
                names.append(i)
                signatures.append(s)
                out.append(i)
            else:
                signatures[best] = s
                out.append(names[best])
        return pd.DataFrame({key: rows[key], "representative": out})

    return df.groupBy(origin).applyInPandas(fold, f"`{key}` {kind}, representative {kind}")
