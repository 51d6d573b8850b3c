"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are dealt into cells by the population counts of their four
16-bit parts.  Two fingerprints within the radius lie in cells whose counts
differ by no more than the radius in all, so only such pairs of cells are
compared; every other pair of tiles is skipped.  A cell with more fingerprints
than a tile holds is split, and its tiles meet each other and its neighbours'.
Tiles are compared exactly, by numpy exclusive-or and bit counts, and hand on a
spanning forest of the links they find; connected components join the forests.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.bpe import slices
from lucerna.llm.common import Scratch, bytes_of, text_hash
from lucerna.llm.components import Forest, components, hang
from lucerna.llm.tiles import TILE, fan_out, runs, spread

SHINGLE, SEED, RADIUS = 3, 42, 2
_PARTS, _STEPS = 4, 17
CELLS = _STEPS**_PARTS


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of the text's word k-grams; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, SEED)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip((ends - lens)[: 1 - k].tolist(), ends[k - 1 :].tolist())], np.uint64)
    ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row: the fingerprint of the whole text as a signed 64-bit integer; null counts as empty."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                fps = np.array([fingerprint(t) for t in bytes_of(b.column("text"))], np.uint64).view(np.int64)
                yield pa.record_batch([b.column("id"), pa.array(fps)], names=["id", "fp"])

    return df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, fp long")


def cells_of(fps: np.ndarray) -> np.ndarray:
    """The population counts of each fingerprint's 16-bit parts, (n, 4)."""
    return np.bitwise_count(fps.view(np.uint64).view(np.uint16).reshape(-1, _PARTS)).astype(np.int64)


def offsets(radius: int) -> list[tuple[int, ...]]:
    return [d for d in itertools.product(range(-radius, radius + 1), repeat=_PARTS) if sum(map(abs, d)) <= radius]


_WEIGHTS = np.array([_STEPS**i for i in range(_PARTS)])


def tile_keys(fps: np.ndarray, parts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each tile that a fingerprint takes part in: the fingerprint's index and the tile's key.

    A key is the two cells (33 bits) and the numbers of the tiles within them (15 bits each).
    """
    counts = cells_of(fps)
    own = counts @ _WEIGHTS
    sub = spread(fps) % parts[own]
    index, keys = [], []
    for d in offsets(radius):
        other = counts + d
        ok = np.flatnonzero(((other >= 0) & (other < _STEPS)).all(1))
        there = other[ok] @ _WEIGHTS
        row, t = fan_out(parts[there])
        i, c = ok[row], there[row]
        mine, s = own[i], sub[i]
        first = (mine < c) | ((mine == c) & (s <= t))
        lo, hi = np.minimum(mine, c), np.maximum(mine, c)
        keys.append(((lo * CELLS + hi) << 30) | (np.where(first, s, t) << 15) | np.where(first, t, s))
        index.append(i)
    return np.concatenate(index), np.concatenate(keys)


def links(ids: np.ndarray, fps: np.ndarray, left: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (ids) of the pairs within the radius; between ``left`` and the rest, or within all if it is None."""
    u = fps.view(np.uint64)
    a = np.arange(len(u)) if left is None else np.flatnonzero(left)
    b = a if left is None else np.flatnonzero(~left)
    forest, step = Forest(len(u)), max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(u[a[at : at + step], None] ^ u[None, b]) <= radius)
        forest.link(a[at + i], b[j])
    i, j = forest.edges()
    return ids[i], ids[j]


def link_tiles(rows: DataFrame, radius: int, held) -> DataFrame:
    """Spanning edges (a, b) of every tile, from rows (key, fp, id) sorted by key within partitions."""

    def compare(key: int, fps: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = divmod(int(key) >> 30, CELLS)
        s, t = (int(key) >> 15) & 0x7FFF, int(key) & 0x7FFF
        if lo != hi:
            left = cells_of(fps) @ _WEIGHTS == lo
        elif s != t:
            left = spread(fps) % held.value[lo] == s
        else:
            left = None
        return links(ids, fps, left, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        carry = [empty, empty, empty]

        def through(columns: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], pa.RecordBatch | None]:
            key, fp, ident = columns
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else empty
            ends = np.append(starts[1:], len(key))
            done = len(starts) if last else len(starts) - 1
            found = [compare(key[s], fp[s:e], ident[s:e]) for s, e in zip(starts[:done].tolist(), ends[:done].tolist()) if e - s > 1]
            rest = starts[done] if done < len(starts) else len(key)
            out = None
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                out = pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
            return [c[rest:] for c in columns], out

        for b in batches:
            columns = [np.concatenate([c, np.asarray(b.column(i))]) for i, c in enumerate(carry)]
            carry, out = through(columns, False) if len(columns[0]) else (columns, None)
            if out is not None:
                yield out
        if len(carry[0]):
            _, out = through(carry, True)
            if out is not None:
                yield out

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) per row; component_id is the least id that links reach, the row's own included.

    Ids are integers.  Null and empty texts share fingerprint zero and link like
    any other; repeated rows and ids are answered each; a row whose id is null
    links to its fingerprint's group; an empty table gives no rows.
    """
    spark = df.sparkSession
    of = scratch.save(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = of.groupBy("fp").agg(F.min("id").alias("rep"))
    pop = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) * F.lit(_STEPS**i) for i in range(_PARTS)]
    cell = pop[0] + pop[1] + pop[2] + pop[3]
    parts = np.ones(CELLS, np.int64)
    # at most CELLS rows, whatever the input
    for c, n in distinct.groupBy(cell.alias("cell")).count().where(F.col("count") > TILE).collect():
        parts[c] = min(1 << 15, -(-n // TILE))
    held = spark.sparkContext.broadcast(parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                fps, ids = (np.asarray(c) for c in whole.slice(at, 20_000).columns)
                i, keys = tile_keys(fps, held.value, radius)
                yield pa.record_batch([pa.array(keys), pa.array(fps[i]), pa.array(ids[i])], names=["key", "fp", "id"])

    dealt = distinct.where("rep IS NOT NULL").select("fp", F.col("rep").cast("long").alias("id")).mapInArrow(deal, "key long, fp long, id long")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    roots = components(link_tiles(dealt, radius, held), scratch)
    of_fp = distinct.join(roots, distinct.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    of_fp = of_fp.select(F.xxhash64("fp").alias("_g"), F.col("fp").alias("_fp"), "component_id")
    joined = of.withColumn("_h", F.xxhash64("fp")).join(of_fp, (F.col("_h") == F.col("_g")) & (F.col("fp") == F.col("_fp")))
    return joined.select(F.col("id").alias(id_col), "fp", "component_id")


#: The wide search: words of a shingle, Jaccard similarity, differing bits of 128.  Texts at similarity 0.8 differ
#: by 19.5 bits on average, within 28 in 98 of 100 cases; unrelated ones do so once in 10^9 pairs.
WORDS, SIMILARITY, WIDE = 5, 0.8, 28
#: Differing bits that the first 64 may have: 3.5 standard deviations above the mean at similarity 0.8.
FIRST = 20
#: Rows that one side of a tile of the wide search holds on average at most: what is compared is the same, but larger
#: tiles send a row to fewer of them.
WIDE_TILE = 1 << 15


def shingles(text: bytes, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text (fewer words: the whole sequence; none: none) as (n, 2) hashes, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros((0, 2), np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh3_128_digest
    if len(words) <= k:
        found = [digest(joined, SEED)]
    else:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens + 1) - 1
        found = [digest(joined[a:b], SEED) for a, b in zip((ends - lens)[: 1 - k].tolist(), ends[k - 1 :].tolist())]
    both = np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)
    return both[np.unique(both[:, 0], return_index=True)[1]]


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """128 majority bits of a set of shingles, as two signed 64-bit integers."""
    if not len(hashes):
        return np.zeros(2, np.int64)
    ones = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 16), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(np.int64)


def band(n: np.ndarray, least: float) -> np.ndarray:
    """Sets of at least that similarity lie in the same band of sizes or in neighbouring ones."""
    return (np.log(np.maximum(n, 1)) / -np.log(least) + 1e-9).astype(np.int64)


def _close(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the rows ``a`` and ``b`` whose fingerprints (x, y) are within the radius, block by block."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    step = max(1, (1 << 16) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(x[a[at : at + step], None] ^ x[None, b]) <= min(FIRST, radius))
        i, j = a[at + i], b[j]
        near = np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(y[i] ^ y[j]) <= radius
        out[0].append(i[near])
        out[1].append(j[near])
    return np.concatenate(out[0]), np.concatenate(out[1])


def similar_texts(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, least: float = SIMILARITY, radius: int = WIDE) -> DataFrame:
    """(id, text_hash, component_id, kept) per id and text: texts whose sets of k-word shingles have a Jaccard similarity of at least ``least``.

    Fingerprints of 128 bits are compared exactly in tiles; tiles whose sizes rule
    the similarity out are never paired (the population counts of such wide
    radii rule out next to nothing).  Links within the radius make candidate
    groups, and inside a group each link is proved by the sets themselves.
    component_id is the least id that links reach.  Texts without words are alike.
    A document is an id with a text, told by the text's 64-bit hash, so ids may be
    null or stand for several texts; rows that repeat both are one.  ``kept`` is
    true of one document of each group: that of the least id (none comes last),
    then of the least hash.  An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("long").alias("id"), text_hash(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    row = F.struct(F.isnull("id").alias("none"), "id", "hash")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [shingles(t, k) for t in bytes_of(b.column("text"))]
                fps = np.stack([wide_fingerprint(s) for s in sets])
                names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                n = np.array([len(s) for s in sets])
                yield pa.record_batch([b.column("id"), b.column("hash"), pa.array(names, pa.binary()), pa.array(n), pa.array(fps[:, 0]), pa.array(fps[:, 1])], names=["id", "hash", "name", "n", "x", "y"])

    of = scratch.save(source.mapInArrow(sign, "id long, hash long, name binary, n long, x long, y long"), "sets")
    classes = of.groupBy("name").agg(F.min(row).alias("least"), F.first("n").alias("n"), F.first("x").alias("x"), F.first("y").alias("y"))
    # a class has a number of its own: several may stand under one id
    every = scratch.save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    classes = every.where("n > 0")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, n = np.unique(band(np.asarray(b.column(0)), least), return_counts=True)
            yield pa.record_batch([pa.array(own), pa.array(n)], names=["band", "n"])

    # a row for each band: some 60 up to a million words, whatever the number of texts
    sizes = {r[0]: -(-r[1] // WIDE_TILE) for r in classes.select("n").mapInArrow(bands, "band long, n long").groupBy("band").agg(F.sum("n")).collect()}
    held = spark.sparkContext.broadcast(sizes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                b = whole.slice(at, 5000)
                own = band(np.asarray(b.column("n")), least)
                mixed = spread(np.asarray(b.column("rep")))
                for d in (-1, 0, 1):
                    there = own + d
                    mine = mixed % np.array([held.value[q] for q in own.tolist()])
                    row, t = fan_out(np.array([held.value.get(q, 0) for q in there.tolist()], np.int64))
                    s, low, high = mine[row], np.minimum(own, there)[row], np.maximum(own, there)[row]
                    first = (d > 0) | ((d == 0) & (s <= t))
                    key = (low << 49) | (np.where(first, s, t) << 25) | (np.where(first, t, s) << 1) | (high > low)
                    take = pa.array(row)
                    yield pa.record_batch([pa.array(key), pa.array(own[row]), *[b.column(c).take(take) for c in ("rep", "x", "y")]], names=["key", "band", "rep", "x", "y"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key"]):
            if t.num_rows < 2:
                continue
            key, (own, rep, x, y) = t.column(0)[0].as_py(), (t.column(c).to_numpy() for c in ("band", "rep", "x", "y"))
            low, s, u = key >> 49, (key >> 25) & 0xFFFFFF, (key >> 1) & 0xFFFFFF
            if key & 1:
                left = own == low
            else:
                left = np.ones(len(own), bool) if s == u else spread(rep) % held.value[low] == s
            a = np.flatnonzero(left)
            b = a if not key & 1 and s == u else np.flatnonzero(~left)
            forest = Forest(len(rep))
            forest.link(*_close(x.view(np.uint64), y.view(np.uint64), a, b, radius))
            i, j = forest.edges()
            if len(i):
                yield pa.record_batch([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])

    dealt = classes.mapInArrow(deal, "key long, band long, rep long, x long, y long")
    edges = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")
    maybe = components(edges, scratch)
    maybe = maybe.select("node", "root").union(maybe.select(F.col("root").alias("node"), "root").distinct())
    maybe = scratch.save(maybe, "maybe")
    sized = hang(maybe, maybe.groupBy(F.col("root").alias("node")).agg(F.count("*").alias("m")), "root")
    sized = sized.select(F.col("node").alias("_r"), F.col("root").alias("group"), F.col("m").alias("members"))
    wanted = classes.join(sized, F.col("rep") == F.col("_r")).select("rep", "name", "group", "members", F.col("least.id").alias("_i"), F.col("least.hash").alias("_t"))
    texts = source.join(wanted, F.col("id").eqNullSafe(F.col("_i")) & (F.col("hash") == F.col("_t"))).select(F.col("rep").alias("id"), "name", "group", "members", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's set under the key of every tile of its group that it takes part in."""
        for whole in batches:
            for b in slices(whole, "text"):
                out: list[tuple] = []
                columns = [b.column(c).to_pylist() for c in ("id", "name", "group", "members")]
                for i, name, group, members, text in zip(*columns, bytes_of(b.column("text"))):
                    found = shingles(text, k)
                    if xxhash.xxh3_128_digest(found.tobytes()) != name:
                        continue
                    parts = -(-members // TILE)
                    s = int(spread(np.array([i]))[0]) % parts
                    fp = wide_fingerprint(found).tolist()
                    raw = np.ascontiguousarray(found[:, 0]).tobytes()
                    out += [(group, min(s, t) << 24 | max(s, t), parts, i, *fp, raw) for t in range(parts)]
                columns = list(zip(*out)) or [[]] * 7
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.record_batch([pa.array(c, q) for c, q in zip(columns, kinds)], names=["group", "tile", "parts", "rep", "x", "y", "set"])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["group", "tile"]):
            if t.num_rows < 2:
                continue
            rep, x, y = (t.column(c).to_numpy() for c in ("rep", "x", "y"))
            tile, parts = t.column("tile")[0].as_py(), t.column("parts")[0].as_py()
            s, u = tile >> 24, tile & 0xFFFFFF
            left = spread(rep) % parts == s
            a = np.flatnonzero(left)
            b = a if s == u else np.flatnonzero(~left)
            sets = [np.frombuffer(r, np.uint64) for r in t.column("set").to_pylist()]
            forest = Forest(len(rep))
            i, j = _close(x.view(np.uint64), y.view(np.uint64), a, b, radius)
            for p, q in zip(i.tolist(), j.tolist()):
                if p != q and forest.root[p] != forest.root[q]:
                    m, n = len(sets[p]), len(sets[q])
                    if min(m, n) < least * max(m, n):
                        continue
                    both = len(np.intersect1d(sets[p], sets[q], True))
                    if both >= least * (m + n - both):
                        forest.link(np.array([p]), np.array([q]))
            i, j = forest.edges()
            if len(i):
                yield pa.record_batch([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])

    rows = texts.mapInArrow(cut, "group long, tile long, parts long, rep long, x long, y long, set binary")
    proved = rows.repartition("group", "tile").sortWithinPartitions("group", "tile").mapInArrow(prove, "a long, b long")
    roots = components(proved, scratch)
    # rows of equal sets are one class, texts without words among them
    rooted = scratch.save(every.join(roots, F.col("rep") == F.col("node"), "left").select("name", "least", F.coalesce("root", "rep").alias("root")), "rooted")
    stays = rooted.groupBy(F.col("root").alias("node")).agg(F.min("least").alias("m"))
    answer = hang(rooted, stays, "root").select(F.col("name").alias("_n"), F.xxhash64("name").alias("_g2"), F.col("m").alias("stays"))
    out = of.withColumn("_h", F.xxhash64("name")).join(answer, (F.col("_h") == F.col("_g2")) & (F.col("name") == F.col("_n")))
    return out.select(F.col("id").alias(id_col), F.col("hash").alias("text_hash"), F.col("stays.id").alias("component_id"), (row == F.col("stays")).alias("kept")).distinct()
