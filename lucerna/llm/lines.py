"""Fuzzy line deduplication.

Lines are normalised, and equal ones are one from there on.  Like lines are
searched by min-hashes: of the words, weighted by their length (edits are counted
in letters); of the letter 3-grams of short lines; and by what is left of very
short ones after as many deletions as they may differ by, which misses none of
those.  A key that one line alone has is dropped before lines meet: chunks of
lines ask parts of the key space, by blocks of hashes, which of their keys occur
elsewhere.  Lines that share a key compare sketches; what is close fetches its
text, meets again, and links if the edit similarity is high enough.  Of each
connected group one occurrence stays: the first by document id and line number.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm import repeats
from lucerna.llm.bpe import slices
from lucerna.llm.common import Scratch, fresh, text_hash, texts_of
from lucerna.llm.components import Forest, components, hang
from lucerna.llm.tiles import TILE, fan_out

SIMILARITY = 0.8
#: Lines of fewer words, or letters beyond the first of unspaced scripts, go only where they repeat exactly: they are alike by chance.
WORDS = 3
#: Min-hashes of the words, and of the letter 3-grams of lines of at most SHORT letters.
DRAWN, SHORT = 42, 100
#: Tables, and min-hashes in a table's key (each table has its own choice of the DRAWN): of words, and of grams.
WORD_TABLES, GRAM_TABLES = (20, 5), (16, 4)
#: Lines of at most so many letters also meet by deletions.
TINY = 14
#: Words of more letters are features by their letter 4-grams, those of unspaced scripts by their 2-grams.
LONG = 16
#: Three bits of each min-hash make a sketch; like lines agree in at least so many of them, of words and of grams.
AGREE = (21, 19)
#: Lines in a chunk, and keys in a part, about.
CHUNK, PART = 20_000, 2_000_000
_GRAM_TABLE, _DELETED = WORD_TABLES[0], WORD_TABLES[0] + GRAM_TABLES[0]
#: Scripts that don't put spaces between words (first and last code point).
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_POWER = np.uint64(0x5851F42D4C957F2D)


@lru_cache(1)
def folded() -> np.ndarray:
    """What each code point counts as: 0 between words, 10 a line's end, "0" any digit of 0 to 9, else its lower case."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    out[ord("0") : ord("9") + 1] = ord("0")
    out[10] = 10
    return out


@lru_cache(1)
def _valued() -> np.ndarray:
    return _mixed(np.arange(0x110000, dtype=np.uint64))


def codes_of(text: str) -> np.ndarray:
    """The folded code points of a text; a run of digits counts as one."""
    c = folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    digit = c == ord("0")
    again = digit[1:] & digit[:-1]
    return c[np.append(True, ~again)] if again.any() else c


def normal(line: str) -> str:
    """A line's words, in lower case, runs of digits as 0, with a space between."""
    c = codes_of(line)
    return " ".join(_text(np.where(c > 10, c, 32)).split())


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of an odd base modulo 2^64, and of its inverse; as many as were needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 20)
            inverse = np.uint64(pow(int(_POWER), -1, 1 << 64))
            cls.up, cls.down = (np.cumprod(np.append(np.uint64(1), np.full(size - 1, base, np.uint64))) for base in (_POWER, inverse))
        return cls.up, cls.down


def _hashed(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values (none may be empty): differences of one running sum of value x power."""
    up, down = _Powers.of(len(values))
    total = np.cumsum(values * up[: len(values)])
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return _mixed((total[starts + lens - 1] - before) * down[starts] + lens.astype(np.uint64))


def _draws(features: np.ndarray, weights: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """The least of DRAWN weighted draws over each run of features, (DRAWN, runs), as 32-bit integers."""
    known, index = np.unique(features, return_inverse=True)
    weight = np.empty(len(known), np.float32)
    weight[index] = weights
    index, weight = index.astype(np.intp), np.float32(-1) / weight
    low, high = known.astype(np.uint32), (known >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out = np.empty((DRAWN, len(starts)), np.float32)
    for i in range(DRAWN):
        x = low + high * np.uint32(2 * i + seed)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        x *= np.uint32(0x297A2D39)
        drawn = np.log(((x >> np.uint32(8)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)) * weight
        out[i] = np.minimum.reduceat(drawn.take(index), starts)
    return out.view(np.uint32)


def _choice(shape: tuple[int, int]) -> np.ndarray:
    """Which draws each table's key is made of."""
    rng = np.random.default_rng(shape[0])
    return np.stack([rng.choice(DRAWN, shape[1], replace=False) for _ in range(shape[0])])


def _keys(draws: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Each run's 32-bit key in each table, (runs, tables)."""
    out = np.zeros((draws.shape[1], shape[0]), np.uint32)
    for table, own in enumerate(_choice(shape)):
        key = np.zeros(draws.shape[1], np.uint64)
        for i in own:
            key = _mixed(key + draws[i])
        out[:, table] = key >> np.uint64(32)
    return out


def _sketch(draws: np.ndarray) -> np.ndarray:
    """Three bits of each draw, (runs, 2) signed 64-bit integers."""
    out = np.zeros((draws.shape[1], 2), np.uint64)
    for i in range(DRAWN):
        # the draws' bits aren't even: mixed ones are
        bits = (draws[i] * np.uint32(0x9E3779B1)) >> np.uint32(29)
        out[:, i // 21] |= bits.astype(np.uint64) << np.uint64(3 * (i % 21))
    return out.view(np.int64)


def disagree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many draws the halves of two sketches differ."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    return np.bitwise_count((x | x >> np.uint64(1) | x >> np.uint64(2)) & np.uint64(0o111111111111111111111))


def deletions(text: str, least: float) -> list[int]:
    """Keys of all that is left after as many deletions as texts of at least that similarity may differ by."""
    most = min(len(text), int((1 - least) * int(len(text) / least + 1e-9) + 1e-9))
    left = {text}
    for d in range(1, most + 1):
        left |= {"".join(x) for x in itertools.combinations(text, len(text) - d)}
    return sorted({xxhash.xxh32_intdigest(x) for x in left})


class Lines:
    """The lines with a word of some texts, by columns.

    ``number`` counts lines through all texts; ``line`` is the hash of what is
    normal; ``units`` counts words (letters beyond the first of unspaced ones).
    """

    def __init__(self, texts: list[str]):
        c = codes_of("\n".join(texts)) if texts else np.zeros(0, np.uint32)
        word = c > 10
        edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lens = ends - starts
        before = np.searchsorted(starts, np.flatnonzero(c == 10))
        held = np.diff(before, prepend=0, append=len(starts))
        letters_ = c[word]
        values = _valued()[letters_]
        at = np.cumsum(lens) - lens
        hashes = _hashed(values, at, lens) if len(at) else np.zeros(0, np.uint64)
        self.number = np.flatnonzero(held)
        words = held[self.number]
        first = np.cumsum(words) - words
        self.line = (_hashed(hashes, first, words) if len(first) else hashes).view(np.int64)
        self.size = np.add.reduceat(lens, first) + words - 1 if len(first) else words
        unspaced = np.zeros(len(lens), bool)
        far = np.flatnonzero(letters_ >= _UNSPACED[0][0])
        if len(far):
            odd = np.zeros(len(far), bool)
            for low, high in _UNSPACED:
                odd |= (letters_[far] >= low) & (letters_[far] <= high)
            unspaced[np.searchsorted(at, far[odd], "right") - 1] = True
        own = np.where(unspaced, np.maximum(lens - 1, 1), 1)
        self.units = np.add.reduceat(own, first) if len(first) else words
        self._letters, self._values, self._at, self._lens, self._hashes, self._first, self._words, self._unspaced = letters_, values, at, lens, hashes, first, words, unspaced

    def _features(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and weights of the word features of some lines (in order, one at least), and where each line's start."""
        wanted = np.zeros(len(self.line), bool)
        wanted[lines] = True
        w = np.flatnonzero(np.repeat(wanted, self._words))
        lens = self._lens[w]
        n = np.where(self._unspaced[w], 2, np.where(lens > LONG, 4, 0))
        cut = (n > 0) & (lens > n)
        if not cut.any():
            return self._hashes[w], lens + 1.0, np.cumsum(self._words[lines]) - self._words[lines]
        times = np.where(cut, lens - n + 1, 1)
        piece, k = fan_out(times)
        hashes, weights = self._hashes[w][piece], (lens + 1.0)[piece]
        for size in (2, 4):
            some = np.flatnonzero((cut & (n == size))[piece])
            if len(some):
                start = self._at[w[piece[some]]] + k[some]
                hashes[some] = _hashed(self._values, start, np.full(len(some), size))
                weights[some] = size + 1.0
        own = np.add.reduceat(times, np.cumsum(self._words[lines]) - self._words[lines])
        return hashes, weights, np.cumsum(own) - own

    def texts(self, lines: np.ndarray) -> list[str]:
        """What is normal of some lines."""
        all_, at, lens, out = _text(self._letters), self._at, self._lens, []
        for a, n in zip(self._first[lines].tolist(), self._words[lines].tolist()):
            out.append(" ".join(all_[i : i + k] for i, k in zip(at[a : a + n].tolist(), lens[a : a + n].tolist())))
        return out

    def search(self, least: float, keyed: bool = True) -> tuple[list[bytes], np.ndarray]:
        """For each line its keys (32 bits each: the tables of words, those of grams if it is short, deletions if it is tiny),
        if they are wanted, and its sketches (of words, then of grams), (n, 4); none for lines that aren't compared."""
        keys, sketch = [b""] * len(self.line), np.zeros((len(self.line), 4), np.int64)
        fuzzy = np.flatnonzero(self.units >= WORDS)
        if not len(fuzzy):
            return keys, sketch
        draws = _draws(*self._features(fuzzy), 1)
        sketch[fuzzy, :2] = _sketch(draws)
        if keyed:
            raw, step = _keys(draws, WORD_TABLES).tobytes(), 4 * WORD_TABLES[0]
            for k, i in enumerate(fuzzy.tolist()):
                keys[i] = raw[step * k : step * (k + 1)]
        short = fuzzy[self.size[fuzzy] <= SHORT]
        if len(short):
            texts = self.texts(short)
            padded = [f"\n\n{t}\n" for t in texts]
            c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            n = np.array([len(t) for t in padded])
            row, k = fan_out(n - 2)
            start = (np.cumsum(n) - n)[row] + k
            grams = _mixed(_mixed(_mixed(c[start]) + c[start + 1]) + c[start + 2])
            draws = _draws(grams, np.ones(len(grams)), np.cumsum(n - 2) - (n - 2), 201)
            sketch[short, 2:] = _sketch(draws)
            if not keyed:
                return keys, sketch
            raw, step = _keys(draws, GRAM_TABLES).tobytes(), 4 * GRAM_TABLES[0]
            for k, (i, t) in enumerate(zip(short.tolist(), texts)):
                keys[i] += raw[step * k : step * (k + 1)]
                if len(t) <= TINY:
                    keys[i] += np.array(deletions(t, least), np.uint32).tobytes()
        return keys, sketch


_LETTERS = 32


def letters(text: str) -> np.ndarray:
    """How often each class of letters occurs."""
    return letters_of([text])[0]


def letters_of(texts: list[str]) -> np.ndarray:
    """`letters` of each text."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % np.uint32(_LETTERS)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(of * _LETTERS + c, minlength=len(texts) * _LETTERS).astype(np.int32).reshape(-1, _LETTERS)


def possible(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of letter counts may belong to texts that similar: edits change no more counts than there are edits."""
    d = a - b
    edits = np.maximum(np.maximum(d, 0).sum(1), np.maximum(-d, 0).sum(1))
    return edits <= (1 - least) * np.maximum(a.sum(1), b.sum(1)) + 1e-9


def _shared(a, b) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def bounded_distance(a, b, most: int) -> int:
    """Edit distance of two sequences by Myers' bit vectors; ``most`` + 1 if it is greater.

    A path that strays far from the diagonals of both ends costs more than
    ``most``, so the vectors hold the band of the others and move down with it
    (Hyyro).
    """
    at = _shared(a, b)
    a, b = a[at:], b[at:]
    at = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - at], b[: len(b) - at]
    if len(a) < len(b):
        a, b = b, a
    most, more = min(most, len(a)), len(a) - len(b)
    if more > most:
        return most + 1
    if not len(b):
        return len(a)
    # rows of the band below the diagonal of the beginnings, and above
    below = (most - more) // 2
    above, where = more + below, {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    where = {c: x << above for c, x in where.items()}
    full, lowest = (1 << (above + below + 1)) - 1, above + below
    up, down, distance = full >> above << above, 0, below
    turn, end = len(b) - below, len(a)
    for at, c in enumerate(a):
        eq = where.get(c, 0) >> at & full
        d0 = ((eq & up) + up & full) ^ up | eq | down
        ph, mh = down | full & ~(d0 | up), d0 & up
        if at < turn:
            distance += not d0 >> lowest
            if distance - above > most:
                return most + 1
        else:
            row = lowest - 1 - at + turn
            distance += (ph >> row & 1) - (mh >> row & 1)
            if distance - (end - 1 - at) > most:
                return most + 1
        d0 >>= 1
        up, down = mh | full & ~(d0 | ph), d0 & ph
    return distance


#: Letters of pairs whose words are told apart by code points.
_BATCH = 1 << 19


def _words_of(texts: list[list[str]]) -> list[str]:
    """Texts cut into words, as a character for each, alike where the words are; no surrogates."""
    known: dict[str, int] = {}
    return ["".join([chr(n + 2048 if n >= 0xD800 else n) for n in (known.setdefault(w, len(known)) for w in t)]) for t in texts]


def within(a: str, b: str, least: float) -> bool:
    """Whether 1 - edit distance / the longer length is at least ``least``.

    Long texts are first aligned by words: few changed words bound the edits
    from above, since one costs no more than the longest word and a space.
    """
    return bool(all_within([a, b], np.array([0]), np.array([1]), least)[0])


def all_within(texts: list[str], i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of texts have that edit similarity; many of like length are proved at once."""
    size = np.array([len(t) for t in texts])
    long = np.maximum(size[i], size[j])
    most = ((1 - least) * long + 1e-9).astype(np.int64)
    out = np.zeros(len(i), bool)
    rest = np.flatnonzero(np.abs(size[i] - size[j]) <= most)
    far = rest[long[rest] > 200]
    # a batch has fewer words than there are code points; a longer pair goes alone
    batch = np.cumsum(long[far]) // _BATCH
    for some in np.split(far, np.flatnonzero(np.diff(batch)) + 1) if len(far) else []:
        used, at = np.unique(np.append(i[some], j[some]), return_inverse=True)
        cut = [texts[k].split(" ") for k in used.tolist()]
        dearest = np.array([1 + max(map(len, t)) for t in cut])
        x, y = at[: len(some)], at[len(some) :]
        enough = most[some] // np.maximum(dearest[x], dearest[y])
        k = np.flatnonzero(enough > 0)
        if long[some[0]] > _BATCH:
            out[some[k]] = [bounded_distance(cut[p], cut[q], m) <= m for p, q, m in zip(x[k].tolist(), y[k].tolist(), enough[k].tolist())]
        else:
            words = _words_of(cut)
            out[some[k]] = _no_further([words[n] for n in x[k].tolist()], [words[n] for n in y[k].tolist()], enough[k])
    rest = rest[~out[rest]]
    out[rest] = _no_further([texts[n] for n in i[rest].tolist()], [texts[n] for n in j[rest].tolist()], most[rest])
    return out


def _blocks(letters: int) -> int:
    """Blocks of 64 letters, rounded up to a power of two, so that more pairs go together."""
    return 1 << (-(-letters // 64) - 1).bit_length()


def _no_further(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """For each pair whether its edit distance is at most that.

    Pairs of like length go through Myers' bit vectors side by side, where there
    are enough of them; others one by one.
    """
    out, left = np.zeros(len(a), bool), []
    for n, (x, y, m) in enumerate(zip(a, b, most.tolist())):
        at = _shared(x, y)
        x, y = x[at:], y[at:]
        at = _shared(x[::-1], y[::-1])
        x, y = x[: len(x) - at], y[: len(y) - at]
        if len(x) < len(y):
            x, y = y, x
        if len(x) <= m:
            out[n] = True
        elif len(y) and len(x) - len(y) <= m:
            left.append((_blocks(len(y)), len(x), n, x, y))
    left.sort(key=lambda r: r[:3], reverse=True)
    for blocks, group in itertools.groupby(left, key=lambda r: r[0]):
        own = list(group)
        step = max(1, min((1 << 15) // blocks, (1 << 22) // own[0][1]))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            n = np.array([r[2] for r in part])
            if len(part) < SIDE * (4 + blocks // 4):
                out[n] = [bounded_distance(r[3], r[4], m) <= m for r, m in zip(part, most[n].tolist())]
            else:
                out[n] = _side_by_side([r[3] for r in part], [r[4] for r in part], most[n], blocks)
    return out


#: A quarter of the pairs from which numpy is faster than Python's integers; more blocks ask for more.
SIDE = 10


def _side_by_side(a: list[str], b: list[str], most: np.ndarray, blocks: int) -> np.ndarray:
    """`bounded_distance` of many pairs, the longest ``a`` first; ``b`` has at most 64 x ``blocks`` letters and isn't longer than ``a``.

    Only blocks that the pairs' bands meet are worked on.  Beneath them each row
    counts one more than the one above; above them rows grow by one a letter.
    """
    one, n = np.uint64(1), len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(y) for y in b])

    def coded(texts: list[str], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        of, at = fan_out(lens)
        return of << 21 | c, of, at

    key, _, at = coded(b, lb)
    known, place = np.unique(key, return_inverse=True)
    # where each letter of b occurs in it; the last row is that of letters that don't
    where = np.zeros((blocks, len(known) + 1), np.uint64)
    np.add.at(where, (at >> 6, place), one << (at & 63).astype(np.uint64))
    key, of, at = coded(a, la)
    place = np.minimum(np.searchsorted(known, key), len(known) - 1)
    step = np.full((int(la[0]), n), len(known), np.intp)
    step[at, of] = np.where(known[place] == key, place, len(known))
    up, down = np.full((blocks, n), ~np.uint64(0)), np.zeros((blocks, n), np.uint64)
    own, distance, left = np.arange(n), lb.copy(), np.zeros(n, bool)
    top, shift = (lb - 1) >> 6, ((lb - 1) & 63).astype(np.uint64)
    ended = np.full(n, np.iinfo(np.int64).max)
    below = (most - la + lb) // 2
    above, below = int((la - lb + below).max()), int(below.max())
    for t in range(int(la[0])):
        if t % 16 == 0:
            # what has ended is kept; what can't come down to its most any more is left out
            over = la[own] <= t
            ended[own[over]] = distance[over]
            stays = np.flatnonzero(~over & (distance - (la[own] - t) <= most[own]))
            if not len(stays):
                break
            if len(stays) < len(own):
                own, distance, top, shift, up, down, step = own[stays], distance[stays], top[stays], shift[stays], up[:, stays], down[:, stays], step[:, stays]
            last, live, column = la[own], int(la[own].min()) >= t + 16, np.arange(len(own))
            low = high = -1
        if (now := (max(0, t - above) >> 6, min(blocks - 1, t + below >> 6))) != (low, high):
            low, high = now
            # the row that is followed: the last, or the last of the blocks
            met = np.maximum(np.minimum(top, high) - low, 0)
            bit = np.where(top <= high, shift, np.uint64(63))
        u, d = up[low : high + 1], down[low : high + 1]
        eq = where[low : high + 1].take(step[t], axis=1)
        xv = eq | d
        xh = eq & u
        xh += u
        over = xh < u if high > low else None
        for w in range(1, high + 1 - low):
            carry = over[w - 1].astype(np.uint64)
            xh[w] += carry
            over[w] |= xh[w] < carry
        xh ^= u
        xh |= eq
        mh = u & xh
        ph = ~(xh | u)
        ph |= d
        rise, fall = (ph[met, column], mh[met, column]) if high > low else (ph[0], mh[0])
        rise, fall = rise >> bit & one, fall >> bit & one
        rise -= fall
        if not live:
            rise[t >= last] = 0
        distance += rise.view(np.int64)
        heads = (ph[:-1] >> np.uint64(63), mh[:-1] >> np.uint64(63)) if high > low else None
        ph <<= one
        mh <<= one
        ph[0] |= one
        if heads:
            ph[1:] |= heads[0]
            mh[1:] |= heads[1]
        np.bitwise_and(ph, xv, out=d)
        ph |= xv
        np.bitwise_or(mh, ~ph, out=u)
    else:
        ended[own] = distance
    return ended <= most


def _tiled(rows: DataFrame) -> DataFrame:
    """Rows (bucket, line, ...) with each tile that they take part in and their side of it, dealt and sorted by tile.

    What a tile holds is bounded: an overfull bucket is split by a hash of the
    line, and its parts meet each other.  How many parts a bucket has reaches its
    rows by a join (the adaptive engine broadcasts the few overfull buckets, or
    splits a hot one), never through the driver.
    """
    wide = rows.groupBy(F.col("bucket").alias("_b")).agg(F.count("*").alias("_n")).where(F.col("_n") > TILE)
    parts = F.coalesce(F.ceil(F.col("_n") / TILE), F.lit(1)).cast("long")
    out = rows.join(wide, F.col("bucket") == F.col("_b"), "left").withColumn("_k", parts).withColumn("_s", F.pmod(F.xxhash64("line"), F.col("_k")))
    out = out.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    low = F.least("_s", "_t")
    out = out.withColumn("tile", F.shiftleft(low, 24).bitwiseOR(F.greatest("_s", "_t"))).withColumn("side", (F.col("_s") != low).cast("int"))
    return out.drop("_b", "_n", "_k", "_s", "_t").repartition("bucket", "tile").sortWithinPartitions("bucket", "tile")


def _whole_runs(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole tiles and where each tile starts; the rows are sorted by their first two columns."""
    held: list[list[np.ndarray]] = []
    size = 0

    def ready(last: bool) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        columns = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        starts = np.flatnonzero(np.append(True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])))
        to = len(columns[0]) if last else int(starts[-1])
        if to < len(columns[0]):
            held.append([c[to:] for c in columns])
        if to:
            yield [c[:to] for c in columns], starts[starts < to]

    for b in batches:
        if b.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
            if size >= least:
                yield from ready(False)
                size = sum(len(x[0]) for x in held)
    if held:
        yield from ready(True)


def _near(bucket: int, least: float, x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Whether sketched rows of one bucket are worth a proof; the arrays broadcast.

    Rows are (size, two halves of the sketch that goes with the bucket's table), or
    (size, four halves) in a group (below zero), where either sketch may agree.
    """
    long, short = np.maximum(x[0], y[0]), np.minimum(x[0], y[0])
    out, table = short >= least * long - 1e-9, bucket >> 32
    words = lambda i, kind: disagree(x[i], y[i]) + disagree(x[i + 1], y[i + 1]) <= DRAWN - AGREE[kind]
    if table < 0:
        return out & (words(1, 0) | words(3, 1) & (long <= SHORT) | (short <= TINY))
    return out if table >= _DELETED else out & words(1, int(table >= _GRAM_TABLE))


def _few(side: np.ndarray, columns: list[np.ndarray], bucket: np.ndarray, tile: np.ndarray, run: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """`_pairs` of many tiles of few rows at once; ``columns`` are size and the four halves of the sketches, ``run`` numbers the tiles."""
    table = bucket >> 32
    kind, one = np.where(table < 0, -1, (table >= _GRAM_TABLE).astype(int) + (table >= _DELETED)), tile >> 24 == tile & 0xFFFFFF
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for d in range(1, int(np.bincount(run).max(initial=0))):
        i = np.flatnonzero((run[d:] == run[:-d]) & (one[d:] | (side[d:] != side[:-d])))
        for k, first in ((-1, -1), (0, 0), (1, _GRAM_TABLE), (2, _DELETED)):
            x = i[kind[i] == k]
            own = columns if k < 0 else columns[:3] if k == 0 else [columns[0], *columns[3:]]
            x = x[_near(first << 32, least, [c[x] for c in own], [c[x + d] for c in own])]
            found.append((x, x + d))
    i, j = map(np.concatenate, zip(*found))
    order = np.lexsort((j, i))
    return i[order], j[order]


def _pairs(bucket: int, tile: int, side: np.ndarray, columns: list[np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of a tile's rows that are near."""
    one = tile >> 24 == tile & 0xFFFFFF
    a = np.arange(len(side)) if one else np.flatnonzero(side == 0)
    b = a if one else np.flatnonzero(side)
    step = max(1, (1 << 18) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(_near(bucket, least, [c[a[at : at + step], None] for c in columns], [c[None, b] for c in columns]))
        i, j = a[at + i], b[j]
        new = i < j if one else np.ones(len(i), bool)
        yield i[new], j[new]


def _some_near(columns: list[np.ndarray], starts: np.ndarray, least: float, small: int = 32) -> Forest:
    """Which rows are near others of their tile."""
    bucket, tile, side, _, *own = columns
    n = np.diff(np.append(starts, len(bucket)))
    forest, run, table = Forest(len(bucket)), np.repeat(np.arange(len(n)), n), bucket >> 32
    # tiles of few rows all at once: neighbours at each distance
    for d in range(1, int(min(n.max(), small))):
        i = np.flatnonzero((run[d:] == run[:-d]) & (n[run[d:]] <= small))
        for low, high in ((0, _GRAM_TABLE), (_GRAM_TABLE, _DELETED), (_DELETED, 1 << 30)):
            k = i[(table[i] >= low) & (table[i] < high)]
            if len(k):
                k = k[_near(low << 32, least, [c[k] for c in own], [c[k + d] for c in own])]
                forest.link(k, k + d)
    for r in np.flatnonzero(n > small).tolist():
        at = slice(int(starts[r]), int(starts[r] + n[r]))
        for i, j in _pairs(int(bucket[at.start]), int(tile[at.start]), side[at], [c[at] for c in own], least):
            forest.link(at.start + i, at.start + j)
    return forest


def _kind(bucket: int) -> int:
    """Of words 0, of grams 1, of deletions 2; a group -1."""
    table = bucket >> 32
    return -1 if table < 0 else (table >= _GRAM_TABLE) + (table >= _DELETED)


def _by_table(buckets: list[np.ndarray]) -> np.ndarray:
    """Each line's bucket in each table of words and grams, where it has only one, (n, tables); none is below zero, another for each line."""
    out = np.repeat(-1 - np.arange(len(buckets)), _DELETED).reshape(-1, _DELETED)
    of, own = np.repeat(np.arange(len(buckets)), [len(x) for x in buckets]), np.concatenate(buckets)
    held = (own >= 0) & (own >> 32 < _DELETED)
    out[of[held], own[held] >> 32] = own[held]
    return out


#: Rows of a tile up to which it is searched together with others.
FEW = 32
#: Pairs of lines that wait before they are proved together.
WAITING = 1 << 17


def _links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Spanning edges (a, b) of the lines of each tile that are proved alike.

    The pairs of many tiles are proved together, in rounds: first one partner of
    each line, then twice as many each time, but never what is linked by then.
    """
    for columns, starts in _whole_runs(batches, 1 << 15):
        bucket, tile, side, line, size, s0, s1, s2, s3, norm, buckets = columns
        ends = np.append(starts[1:], len(bucket))
        forest, texts, waiting, held = Forest(len(bucket)), norm.tolist(), [], 0
        counts, by_table, kind = letters_of(texts), _by_table(buckets.tolist()), np.array([_kind(x) for x in bucket.tolist()])

        def first(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Which pairs are in a group, or in the first bucket of its kind that both lines have."""
            out = kind[x] < 0
            for k, some in ((0, slice(0, _GRAM_TABLE)), (1, slice(_GRAM_TABLE, _DELETED))):
                n = np.flatnonzero(kind[x] == k)
                p, q = by_table[x[n], some], by_table[y[n], some]
                out[n] = p[np.arange(len(n)), (p == q).argmax(1)] == bucket[x[n]]
            for n in np.flatnonzero(kind[x] == 2).tolist():
                p, q = ({b for b in buckets[k].tolist() if _kind(b) == 2} for k in (x[n], y[n]))
                out[n] = min(p & q) == bucket[x[n]]
            return out

        def prove(i: np.ndarray, j: np.ndarray) -> None:
            wide = 1
            while len(i):
                new = np.flatnonzero(np.diff(i, prepend=-1))
                now = np.arange(len(i)) - np.repeat(new, np.diff(np.append(new, len(i)))) < wide
                x, y, i, j = i[now], j[now], i[~now], j[~now]
                likely = np.concatenate([possible(counts[x[k : k + (1 << 14)]], counts[y[k : k + (1 << 14)]], least) for k in range(0, len(x), 1 << 14)])
                # a pair is proved in its group, or in the first bucket of a kind that both are near someone in
                x, y = x[likely], y[likely]
                own = first(x, y)
                x, y = x[own], y[own]
                alike = all_within(texts, x, y, least)
                forest.link(x[alike], y[alike])
                apart = forest.root[i] != forest.root[j]
                i, j, wide = i[apart], j[apart], 2 * wide

        n = ends - starts
        rows = np.flatnonzero(np.repeat((n > 1) & (n <= FEW), n))
        if len(rows):
            run = np.repeat(np.arange(len(n)), n)[rows]
            i, j = _few(side[rows], [c[rows] for c in (size, s0, s1, s2, s3)], bucket[rows], tile[rows], np.cumsum(np.diff(run, prepend=run[0]) > 0), least)
            prove(rows[i], rows[j])
        for s, e in zip(starts[n > FEW].tolist(), ends[n > FEW].tolist()):
            at, b = slice(s, e), int(bucket[s])
            own_sketch = [size, s0, s1, s2, s3] if b < 0 else [size, s0, s1] if _kind(b) == 0 else [size, s2, s3]
            for i, j in _pairs(b, int(tile[s]), side[at], [c[at] for c in own_sketch], least):
                # what is linked already needs no proof
                new = forest.root[s + i] != forest.root[s + j]
                waiting.append((s + i[new], s + j[new]))
                held += len(waiting[-1][0])
                if held >= WAITING:
                    prove(*map(np.concatenate, zip(*waiting)))
                    waiting, held = [], 0
        if held:
            prove(*map(np.concatenate, zip(*waiting)))
        i, j = forest.edges()
        if len(i):
            yield pa.record_batch([pa.array(line[i]), pa.array(line[j])], names=["a", "b"])


def repeated_lines(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, text_hash, dropped): for each document that loses lines, their numbers from 0.

    A line is what stands between newlines.  Lines of fewer than ``WORDS`` words
    (two letters of an unspaced script count as a word) go where they repeat
    exactly once normalised; lines without a word are left alone, so null and
    empty texts lose nothing.  A document is an id with a text, told by the text's
    64-bit hash: an id that stands for several texts is several documents, and so
    are the texts without an id; rows that repeat both are one.  Ties go to the
    least id (none comes last), then the least hash, then the least line number.
    An empty table gives no rows; other columns are ignored.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), text_hash(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    row = lambda number: F.struct(F.isnull("id").alias("none"), "id", "hash", number)
    names = ["s0", "s1", "s2", "s3"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # what is in work fits the processor's caches
            for b in slices(batch, "text", 1 << 20):
                texts = texts_of(b.column("text"))
                found = Lines(texts)
                keys, sketch = found.search(least)
                ends = np.cumsum([t.count("\n") + 1 for t in texts])
                doc = np.searchsorted(ends, found.number, "right")
                number = found.number - np.append(0, ends)[doc]
                columns = [b.column("id").take(pa.array(doc)), b.column("hash").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(found.line), pa.array(found.size.astype(np.int32)), pa.array(keys, pa.binary()), *map(pa.array, sketch.T)]
                yield pa.record_batch(columns, names=["id", "hash", "number", "line", "size", "keys", *names])

    scanned = scratch.save(source.mapInArrow(scan, "id long, hash long, number int, line long, size int, keys binary, s0 long, s1 long, s2 long, s3 long"), "scanned")
    searched = scanned.where("length(keys) > 0").groupBy("line").agg(*[F.first(c).alias(c) for c in ("size", "keys", *names)])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                keys = b.column("keys").to_pylist()
                blocks = [np.asarray(b.column("line")), np.asarray(b.column("size")), np.stack([np.asarray(b.column(c)) for c in names]), np.array([len(k) // 4 for k in keys], np.int32)]
                columns = [pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in blocks), pa.array([b"".join(keys)], pa.binary()), pa.array([int(blocks[3].sum())], pa.int64())]
                number += 1
                yield pa.record_batch(columns, names=["chunk", "line", "size", "sketch", "count", "keys", "total"])

    chunks = scratch.save(searched.mapInArrow(bundle, "chunk long, line binary, size binary, sketch binary, count binary, keys binary, total long"), "chunks")
    lines = scratch.save(scanned.select("id", "hash", "number", "line"), "lines")
    scratch.drop(scanned)
    distinct = scratch.save(lines.groupBy("line").agg(F.min(row("number")).alias("first"), F.count("*").alias("n")), "distinct")
    total = chunks.agg(F.sum("total")).first()[0] or 0
    parts = max(1, -(-total // PART))

    def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A chunk's buckets, whose they are, the distinct hashes of the buckets, their places and how often each occurs."""
        line, k = fan_out(np.frombuffer(row["count"], np.int32))
        bucket = np.minimum(k, _DELETED) << 32 | np.frombuffer(row["keys"], np.uint32).astype(np.int64)
        return bucket, line, *np.unique(_mixed(bucket.view(np.uint64)), return_inverse=True, return_counts=True)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in whole.to_pylist():
                _, _, values, _, counts = opened(row)
                yield repeats.question(row["chunk"], values, counts, parts, np.uint32)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in whole.to_pylist():
                bucket, of, values, place, _ = opened(row)
                at = np.flatnonzero(repeats.heard(values, parts, row["told"])[place.ravel()])
                bucket, of = bucket[at], of[at]
                sketch = np.frombuffer(row["sketch"], np.int64).reshape(4, -1)
                table = bucket >> 32
                u, v = (np.where(table < _GRAM_TABLE, sketch[i][of], sketch[i + 2][of]) for i in (0, 1))
                columns = [bucket, np.frombuffer(row["line"], np.int64)[of], np.frombuffer(row["size"], np.int32)[of], u, v]
                yield pa.record_batch([pa.array(c) for c in columns], names=["bucket", "line", "size", "u", "v"])

    told = repeats.told(chunks.mapInArrow(ask, "part long, chunk long, sent binary, twice binary"), np.uint32)
    met = chunks.join(told, F.col("chunk") == F.col("_c")).drop("_c").mapInArrow(settle, "bucket long, line long, size int, u long, v long")
    met = scratch.save(met, "met")
    scratch.drop(chunks)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts in _whole_runs(batches):
            forest = _some_near(columns, starts, least)
            i, line = np.flatnonzero(np.bincount(forest.root)[forest.root] > 1), columns[3]
            # the least line, so that lines that meet in many tables give the same edges there
            centre = line.copy()
            np.minimum.at(centre, forest.root, line)
            yield pa.record_batch([pa.array(line[i]), pa.array(columns[0][i]), pa.array(centre[forest.root[i]])], names=["line", "bucket", "centre"])

    near = _tiled(met).select("bucket", "tile", "side", "line", "size", "u", "v").mapInArrow(neighbours, "line long, bucket long, centre long")
    near = scratch.save(near, "near")
    scratch.drop(met)
    # lines that may be alike form groups; a small one meets at once, the lines of a large one by their buckets
    maybe = components(near.select(F.col("line").alias("a"), F.col("centre").alias("b")), scratch)
    member = near.groupBy("line").agg(F.collect_set("bucket").alias("buckets")).join(maybe, F.col("line") == F.col("node"), "left")
    member = scratch.save(member.select("line", "buckets", F.coalesce("root", "line").alias("group")), "members")
    sizes = member.groupBy(F.col("group").alias("node")).agg(F.count("*").alias("m"))
    group = F.array(-F.lit(1).cast("long") - F.shiftrightunsigned(F.xxhash64("group"), 1))
    member = hang(member, sizes, "group").select("line", F.when(F.col("m") <= TILE, group).otherwise(F.col("buckets")).alias("buckets"))
    near = distinct.join(member.withColumnRenamed("line", "_l"), F.col("line") == F.col("_l")).select("line", "buckets", F.col("first.id").alias("_i"), F.col("first.hash").alias("_t"), F.col("first.number").alias("_n"))
    wanted = near.groupBy("_i", "_t").agg(F.collect_list(F.struct(F.col("_n").alias("number"), "line", "buckets")).alias("lines"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                out, raw = [], []
                for text, some in zip(texts_of(b.column("text")), b.column("lines").to_pylist()):
                    own = text.split("\n")
                    for x in some:
                        if x["number"] < len(own):
                            out.append((x["line"], x["buckets"]))
                            raw.append(own[x["number"]])
                found = Lines(raw)
                at = {n: i for i, n in enumerate(found.number.tolist()) if found.line[i] == out[n][0]}
                sketch, norm = found.search(least, keyed=False)[1], found.texts(np.arange(len(found.line)))
                columns = [pa.array([out[n][0] for n in at], pa.int64()), pa.array([int(found.size[i]) for i in at.values()], pa.int32()), pa.array([out[n][1] for n in at], pa.list_(pa.int64()))]
                columns += [pa.array(sketch[list(at.values()), i]) for i in range(4)] + [pa.array([norm[i] for i in at.values()], pa.string())]
                yield pa.record_batch(columns, names=["line", "size", "buckets", *names, "norm"])

    texts = source.join(wanted, F.col("id").eqNullSafe(F.col("_i")) & (F.col("hash") == F.col("_t"))).select("text", "lines").mapInArrow(fetch, "line long, size int, buckets array<long>, s0 long, s1 long, s2 long, s3 long, norm string")
    texts = scratch.save(texts, "norms").withColumn("bucket", F.explode("buckets"))
    texts = texts.select("bucket", "line", "size", *names, "norm", "buckets")

    rows = _tiled(texts).select("bucket", "tile", "side", "line", "size", *names, "norm", "buckets")
    roots = components(rows.mapInArrow(lambda b: _links(b, least), "a long, b long"), scratch)
    grouped = distinct.join(roots, F.col("line") == F.col("node"), "left").select("line", "first", "n", F.coalesce("root", "line").alias("group"))
    grouped = scratch.save(grouped, "groups")
    stays = grouped.groupBy("group").agg(F.min("first").alias("keep"), F.sum("n").alias("total")).where("total > 1")
    stays = stays.select(F.col("group").alias("_p"), F.xxhash64("group").alias("_q"), "keep")
    known = grouped.withColumn("_o", F.xxhash64("group")).join(stays, (F.col("_o") == F.col("_q")) & (F.col("group") == F.col("_p")))
    known = known.select(F.col("line").alias("_l"), F.xxhash64("line").alias("_g"), "keep")
    goes = lines.withColumn("_h", F.xxhash64("line")).join(known, (F.col("_h") == F.col("_g")) & (F.col("line") == F.col("_l")))
    goes = goes.where(row("number") != F.col("keep"))
    return goes.groupBy(F.col("id").alias(id_col), F.col("hash").alias("text_hash")).agg(F.sort_array(F.collect_set("number")).alias("dropped"))


def drop_lines(df: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their texts less the dropped lines.

    A row loses the lines of its own id and text, so ids may be null or stand for
    several texts.  Rows keep their columns, whatever their names, and a text may
    become empty; rows that repeat lose the same lines.
    """
    there, told, gone = fresh(df, "there", "told", "gone")
    some = dropped.select(F.col(id_col).alias(there), F.col("text_hash").alias(told), F.col("dropped").alias(gone))
    rest = F.filter(F.split(F.col(text_col), "\n", -1), lambda _, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
    own = F.col(id_col).cast("long").eqNullSafe(F.col(there)) & (text_hash(F.col(text_col)) == F.col(told))
    return df.join(some, own, "left").withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in df.columns])
