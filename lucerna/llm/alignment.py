"""Aligning the tokens of two tokenizers over whole texts, each distinct segment once.

A text, with the space that both tokenizers see before it, is cut before those
whitespace runs at which no entry of either vocabulary can span the cut: what
stands on both sides is then tokenised alike alone and together (``breaks``
proves it from the vocabularies).  Segments repeat much as words do.

* ``cut``: a scan turns the texts of a chunk into numbers of its own segments and
  lists those segments once; the numbers stand for the text from here on.
* ``align``: the segments of all chunks, a row per chunk and segment, are dealt and
  sorted by segment, so that equal ones meet; each run is tokenised and aligned
  once and its alignment goes back to the rows, and with them to the chunks.
* ``compose``: each chunk composes its documents from its segments' alignments,
  and counts the documents of each linked pair of ids.
* ``scores``: the pairs' counts over the corpus go back to the chunks that hold
  the pair, and are summed over the documents' links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.bpe import slices
from lucerna.llm.common import Scratch, texts_of
from lucerna.llm.packing import read_tokenizer

#: Characters of text after which a chunk ends; a longer text is a chunk by itself.
CHUNK = 16 << 20
#: Numbers of segments whose pairs a task expands at once, or those of one document.
BLOCK = 1 << 19
#: Segments whose groups are read at once.
READ = 1 << 15
#: Chunks whose equal segments are aligned together: none is dealt to one task from more.
SHARED = 4096
#: Links of a group of tokens above which only its distinct pairs are formed.
WIDE = 1 << 16


class Tokenizers:
    """Both tokenizers, and the bytes of each of their ids.

    A is read as ranks, in which form its strings of special tokens are plain text.
    """

    def __init__(self, path_a: str, pattern: str, path_b: str):
        import sentencepiece
        import tiktoken

        self.bytes_a, _ = read_tokenizer(path_a)
        self.a = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(self.bytes_a) if t}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = range(self.b.get_piece_size())
        byte = [self.b.is_byte(i) for i in pieces]
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if byte[i] else b"" if self.b.is_control(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        self.space_b = self.b.piece_to_id("▁")
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.breaks = breaks(self.bytes_a, self.bytes_b, byte)

    def ids_a(self, texts: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all texts and how many each has: one call for texts that end in no white space, as the cuts allow."""
        ids = np.array(self.a.encode_ordinary("".join(texts)), np.int64)
        at = np.cumsum(self.sizes_a[ids])
        to = np.searchsorted(at, ends)
        if len(texts) and (any(s[-1].isspace() or s[-1] in DOUBTFUL for s in texts) or not np.array_equal(at[to], ends)):
            each = [self.a.encode_ordinary(s) for s in texts]
            return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)
        return ids, np.diff(to + 1, prepend=0)

    def ids_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """B puts a space before its input, unless that is empty: the segment's own, or one to take off again."""
        own = [s[0] == " " for s in texts]
        each = self.b.encode([s[1:] if x else s for s, x in zip(texts, own)], num_threads=1)
        each = [([self.space_b] if s == " " else ids) if x else ids[1:] for s, ids, x in zip(texts, each, own)]
        return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)


def breaks(bytes_a: list[bytes], bytes_b: list[bytes], is_byte: list[bool]) -> str:
    """The white space before whose runs a text may be cut.

    A character qualifies if no entry of either vocabulary holds it after a
    character that isn't white space: then no merge, whose result would be such an
    entry, can cross the cut, and the byte-level pattern, which never goes on from
    another character into white space, sees the run and what follows it whole.  Any
    but the space must not follow a space in an entry either, as the space that
    the second tokenizer puts before every input has to stay alone.
    """
    pieces = [t.decode(errors="replace") for t, byte in zip(bytes_b, is_byte) if not byte]
    spanning = {t[i] for t in [*(t.decode(errors="replace") for t in bytes_a), *pieces] for i in range(1, len(t)) if t[i].isspace() and not t[i - 1].isspace()}
    after_space = {t[i] for t in pieces for i in range(1, len(t)) if t[i - 1] == " "}
    return "".join(c for c in " \n\t\v\f\r" if c not in spanning and (c == " " or c not in after_space))


_LOADED: dict[tuple[str, str, str], Tokenizers] = {}


def loaded(path_a: str, pattern: str, path_b: str) -> Tokenizers:
    if (key := (path_a, pattern, path_b)) not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizers(*key)
    return _LOADED[key]


#: White space by some definition only: what the definitions differ on never stands beside a cut.
DOUBTFUL = "\u180e\u200b\ufeff"


class Segments(dict):
    """Numbers of a chunk's segments, in order of appearance.

    A segment that is a space and a word, or a newline and a word, has its word or
    itself as a key, any other a tuple: most texts need no more than a split.
    """

    def __init__(self, safe: str):
        spaces = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + DOUBTFUL
        unsafe = "".join(c for c in spaces if c not in safe)
        #: One match after the other is a segment: it ends before a run that begins with safe white space.
        self.cut = re.compile(f"[{spaces}]*[^{spaces}]+(?:[{unsafe}][{spaces}]*[^{spaces}]*)*|[{spaces}]+")
        self.plain = " " in safe and "\n" in safe

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n

    def numbers(self, text: str) -> np.ndarray:
        words, lines = text.split(), text.count("\n")
        # single spaces and newlines between words, and nothing else
        single = len("".join(words)) + len(words) - 1 == len(text) and text.count(" ") + lines == len(words) - 1
        if self.plain and single and (text.isascii() or not any(c in text for c in DOUBTFUL)):
            keys: list = text.replace("\n", " \n").split(" ") if lines else words
        else:
            keys = [s[1:] if s[0] == " " and len(s) > 1 and not s[1].isspace() else s if s[0] == "\n" and not s[1:2].isspace() else (s,) for s in self.cut.findall(" " + text)]
        return np.fromiter(map(self.__getitem__, keys), "<i4", len(keys))

    def texts(self) -> list[str]:
        return [x[0] if isinstance(x, tuple) else x if x[0] == "\n" else " " + x for x in self]


def laid(numbers: np.ndarray) -> bytes:
    """32-bit numbers by bytes of one weight, the lowest first: the others are mostly zeros and compress away."""
    return np.ascontiguousarray(numbers, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unlaid(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def cut(df: DataFrame, safe: str, id_col: str, text_col: str, chunk_chars: int = CHUNK) -> DataFrame:
    """Documents as numbers of their chunk's segments, and those segments.

    Rows with ``number`` null are documents: chunk, id, ``numbers`` (``laid``, in
    order; empty for a null or empty text).  The others are segments: chunk,
    number, segment.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size, id_type = TaskContext.get().partitionId() << 32, Segments(safe), 0, None

        def rows(ids: list, numbers: list, own: list[str]) -> pa.RecordBatch:
            n, m = len(ids), len(own)
            columns = [pa.array([chunk] * (n + m), pa.int64()), pa.array(ids + [None] * m, id_type), pa.array(numbers + [None] * m, pa.binary()), pa.array([None] * n + list(range(m)), pa.int32()), pa.array([None] * n + own, pa.string())]
            return pa.record_batch(columns, names=["chunk", "id", "numbers", "number", "segment"])

        for b in (b for whole in batches for b in slices(whole, "text")):
            id_type = b.column("id").type
            ids, out, first = b.column("id").to_pylist(), [], 0
            for i, text in enumerate(texts_of(b.column("text"))):
                if size and size + len(text) > chunk_chars:
                    yield rows(ids[first:i], out, held.texts())
                    chunk, held, size, first, out = chunk + 1, Segments(safe), 0, i, []
                out.append(laid(held.numbers(text)) if text else b"")
                size += len(text) + 16
            if out:
                yield rows(ids[first:], out, [])
        if held:
            yield rows([], [], held.texts())

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"chunk long, id {kind}, numbers binary, number int, segment string")


def _ragged(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of all members of ranges that begin at ``starts`` and have ``counts`` members."""
    total = int(counts.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total) if total else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(keys) else weights


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def _sound(raw: list[bytes], size: np.ndarray, table: list[bytes], sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which texts their ids' bytes give back."""
    parts, even = [table[i] for i in ids.tolist()], _sums(sizes[ids], counts) == size
    if even.all() and b"".join(parts) == b"".join(raw):
        return even
    return np.array([b"".join(parts[e - n : e]) == x for x, e, n in zip(raw, np.cumsum(counts).tolist(), counts.tolist())], bool)


def aligned(texts: list[str], t: Tokenizers) -> list[str | None]:
    """Of each segment its groups as text, ``a1,a2|b1;a3|b2,b3``; null if either tokenizer doesn't give its bytes back."""
    n, raw = len(texts), [s.encode() for s in texts]
    size = np.array([len(x) for x in raw], np.int64)
    a, n_a = t.ids_a(texts, np.cumsum(size))
    b, n_b = t.ids_b(texts)
    sound = _sound(raw, size, t.bytes_a, t.sizes_a, a, n_a) & _sound(raw, size, t.bytes_b, t.sizes_b, b, n_b)
    a, b, size = a[np.repeat(sound, n_a)], b[np.repeat(sound, n_b)], np.where(sound, size, 0)
    # offsets over all sound segments in a row: each segment's end is an end of both
    ends, i, j = np.intersect1d(np.cumsum(t.sizes_a[a]), np.cumsum(t.sizes_b[b]), assume_unique=True, return_indices=True)
    n_groups = np.bincount(np.searchsorted(np.cumsum(size), ends), minlength=n)
    names_a, names_b = [t.names[x] for x in a.tolist()], [t.names[x] for x in b.tolist()]
    told, p, r = [], 0, 0
    for q, s in zip((i + 1).tolist(), (j + 1).tolist()):
        told.append(f"{names_a[p]}|{names_b[r]}" if q - p == 1 == s - r else f"{','.join(names_a[p:q])}|{','.join(names_b[r:s])}")
        p, r = q, s
    return [(told[e - 1] if k == 1 else ";".join(told[e - k : e])) if good else None for good, e, k in zip(sound.tolist(), np.cumsum(n_groups).tolist(), n_groups.tolist())]


def align(entries: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """(chunk, number, segment) with its alignment in the segment's place: chunk, number, groups (null: not given back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(path_a, pattern, path_b)
        for b in (b for whole in batches for b in slices(whole, "segment")):
            own = b.column("segment").dictionary_encode()
            groups = pa.array(aligned(own.dictionary.to_pylist(), t), pa.string()).take(own.indices)
            yield pa.record_batch([b.column("chunk"), b.column("number"), groups], names=["chunk", "number", "groups"])

    met = entries.repartition("segment", F.expr(f"chunk DIV ({SHARED}L << 32)")).sortWithinPartitions("segment")
    return met.mapInArrow(run, "chunk long, number int, groups string")


def read_groups(groups: list[str], n_ids: int) -> dict[str, np.ndarray]:
    """Of each segment its tokens of A and B, groups and links; and of all of them one after the other their distinct linked
    pairs of ids (a * n_ids + b, and how often), ``n_pairs`` each.  An empty text has nothing."""
    n = len(groups)
    has = np.array([bool(x) for x in groups], bool)
    raw = "\n".join([x for x in groups if x]) + "\n"
    marks = np.frombuffer(raw.encode(), np.uint8)
    marks = marks[(marks < 48) | (marks > 57)] if has.any() else marks[:0]
    # a number before each mark
    ids = np.fromstring(raw.translate({ord(c): " " for c in ",|;\n"}), np.int64, sep=" ") if has.any() else np.zeros(0, np.int64)
    ends = np.flatnonzero((marks == ord(";")) | (marks == ord("\n")))
    bars = np.flatnonzero(marks == ord("|"))
    a0, a1, b1 = np.concatenate([[0], ends[:-1] + 1])[: len(ends)], bars + 1, ends + 1
    n_a, n_b = a1 - a0, b1 - a1
    links = n_a * n_b
    of = np.flatnonzero(has)[np.concatenate([[0], np.cumsum(marks[ends] == ord("\n"))[:-1]])[: len(ends)]]

    def per(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        np.add.at(out, of, values)
        return out

    span = n_ids * n_ids
    small = np.flatnonzero(links <= WIDE)
    k = np.repeat(small, links[small])
    within = _ragged(links[small], np.zeros(len(small), np.int64))
    keys, weights = [of[k] * span + ids[a0[k] + within // n_b[k]] * n_ids + ids[a1[k] + within % n_b[k]]], [np.ones(len(k), np.int64)]
    for g in np.flatnonzero(links > WIDE).tolist():
        (x, times_x), (y, times_y) = (np.unique(part, return_counts=True) for part in (ids[a0[g] : a1[g]], ids[a1[g] : b1[g]]))
        keys.append((of[g] * span + x[:, None] * n_ids + y).ravel())
        weights.append((times_x[:, None] * times_y).ravel())
    keys, times = _summed(np.concatenate(keys), np.concatenate(weights))
    return {"n_a": per(n_a), "n_b": per(n_b), "n_groups": per(np.ones(len(of), np.int64)), "n_links": per(links), "n_pairs": np.bincount(keys // span, minlength=n), "pairs": keys % span, "times": times}


def compose(docs: DataFrame, alignments: DataFrame, n_ids: int, block: int = BLOCK) -> DataFrame:
    """Documents' rows, and their chunks' linked pairs.

    Documents: chunk, id, n_a, n_b, n_groups, n_links, groups_sha256, and the
    numbers of the chunk's pairs that the document holds (``pairs``: ascending, as
    differences, ``laid``) with how often each is linked (``times``: little-endian
    signed 64-bit).  Pairs: chunk, number, a, b, docs.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def linked(numbers: np.ndarray, counts: np.ndarray, x: dict, of: np.ndarray, n_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of each of some documents, how often each is linked, and how many pairs each document has."""
        per, n = x["n_pairs"], max(len(x["n_pairs"]), 1)
        keys, times = _summed(np.repeat(np.arange(len(counts)), counts) * n + numbers, np.ones(len(numbers), np.int64))
        segment = keys % n
        at = _ragged(per[segment], (np.cumsum(per) - per)[segment])
        keys, times = _summed(np.repeat(keys // n, per[segment]) * n_pairs + of[at], np.repeat(times, per[segment]) * x["times"][at])
        return keys % n_pairs, times, np.bincount(keys // n_pairs, minlength=len(counts))

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        chunk, raw = own.column("own")[0], own.column("numbers").to_pylist()
        groups = known.take(pa.array(np.argsort(known.column("number").to_numpy()))).column("groups").to_pylist()
        lost = np.array([x is None for x in groups], bool)
        parts = [read_groups([g or "" for g in groups[i : i + READ]], n_ids) for i in range(0, len(groups), READ)] or [read_groups([], n_ids)]
        x = {c: np.concatenate([part.pop(c) for part in parts]) for c in list(parts[0])}
        pairs, of = np.unique(x.pop("pairs"), return_inverse=True)
        of, found = of.reshape(-1).astype(np.int32), np.zeros(len(pairs), np.int64)
        out: dict[str, list] = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")}
        at = 0
        while at < len(raw):
            # a block of documents at a time: what pairs expand to stays small
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= 4 * block):
                size, to = size + len(raw[to]), to + 1
            numbers, counts = np.concatenate([unlaid(r) for r in raw[at:to]]), np.array([len(r) // 4 for r in raw[at:to]], np.int64)
            sound = (_sums(lost[numbers], counts) == 0) & (counts > 0)
            for c in ("n_a", "n_b", "n_groups", "n_links"):
                out[c] += np.where(sound, _sums(x[c][numbers], counts), 0).tolist()
            ends = np.cumsum(counts).tolist()
            out["groups_sha256"] += [hashlib.sha256(";".join([groups[i] for i in numbers[e - k : e].tolist()]).encode()).hexdigest() if good else "" for good, e, k in zip(sound.tolist(), ends, counts.tolist())]
            held, times, of_doc = linked(numbers[np.repeat(sound, counts)], np.where(sound, counts, 0), x, of, max(len(pairs), 1))
            found += np.bincount(held, minlength=len(pairs))
            cuts = np.cumsum(of_doc)[:-1]
            out["pairs"] += [laid(np.diff(h, prepend=0)) for h in np.split(held, cuts)]
            out["times"] += [t.astype("<i8").tobytes() for t in np.split(times, cuts)]
            at = to
        full = np.flatnonzero(found)
        kinds = dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), pa.int64()) | {"groups_sha256": pa.string(), "pairs": pa.binary(), "times": pa.binary()}
        of_docs = {"id": own.column("id"), **{c: pa.array(out[c], k) for c, k in kinds.items()}}
        of_pairs = {"number": pa.array(full, pa.int32()), "a": pa.array(pairs[full] // n_ids, pa.int32()), "b": pa.array(pairs[full] % n_ids, pa.int32()), "docs": pa.array(found[full], pa.int64())}
        both = pa.concat_tables([pa.table(of_docs), pa.table(of_pairs)], promote_options="default")
        return both.add_column(0, "chunk", pa.array([chunk.as_py()] * both.num_rows, pa.int64()))

    left, right = docs.select(F.col("chunk").alias("own"), "id", "numbers").groupBy("own"), alignments.groupBy("chunk")
    return left.cogroup(right).applyInArrow(run, f"chunk long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, number int, a int, b int, docs long")


def pair_counts(per_chunk: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each pair of ids: ``count``, the documents corpus-wide that hold it linked, and ``best``, whether its A id has none higher."""
    counts = scratch.save(per_chunk.groupBy("a", "b").agg(F.sum("docs").alias("count")), "counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def scores(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents with n_best and count_sum.  ``known``: chunk, number, count, best of each chunk's pairs."""
    kind = docs.schema["id"].dataType.simpleString()
    plain = ["n_a", "n_b", "n_groups", "n_links"]

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        number = known.column("number").to_numpy()
        count, best = np.zeros(int(number.max(initial=-1)) + 1, np.int64), np.zeros(int(number.max(initial=-1)) + 1, bool)
        count[number], best[number] = known.column("count").to_numpy(), known.column("best").to_numpy()
        n_best, count_sum = [], []
        for pairs, times in zip(own.column("pairs").to_pylist(), own.column("times").to_pylist()):
            pairs, times = np.cumsum(unlaid(pairs)), np.frombuffer(times, "<i8")
            n_best.append(int(times[best[pairs]].sum()))
            count_sum.append(int((times * count[pairs]).sum()))
        columns = {"id": own.column("id"), **{c: own.column(c) for c in plain}, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": own.column("groups_sha256")}
        return pa.table(columns)

    left = docs.select(F.col("chunk").alias("own"), "id", *plain, "groups_sha256", "pairs", "times").groupBy("own")
    return left.cogroup(known.groupBy("chunk")).applyInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in plain)}, n_best long, count_sum long, groups_sha256 string")


def cross_align(df: DataFrame, path_a: str, pattern: str, path_b: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Aligns the byte-level BPE of ``path_a`` (over a space and the text) with the pieces of ``path_b`` (over the text).

    ``pattern`` is A's pre-tokens'.  Returns the documents and the pairs.  Documents,
    a row per input row: the id column, n_a and n_b (tokens), n_groups (byte ranges
    between offsets at which tokens of both end), n_links (pairs of an A and a B
    token of one group), n_best (links whose pair is held by as many documents as
    any of that A id), count_sum (over links, the documents that hold that pair),
    groups_sha256 (of ``a1,a2|b1;a3|b2,b3``).  Pairs: a, b, count, best.

    Texts that are null, empty, or that either tokenizer does not give back byte by
    byte have no tokens: zeros and an empty string.  Special tokens' strings are
    plain text.  Rows that repeat count as documents each; other columns are
    ignored; an empty table gives no rows.

    The vocabularies are files that every executor has.  Pairs and their counts, at
    most as many as pairs of ids occur, are joined and never collected; a task holds
    one chunk's segments, or the text that is longer than a chunk.
    """
    t = loaded(path_a, pattern, path_b)
    cuts = scratch.save(cut(df, t.breaks, id_col, text_col, chunk_chars), "cut")
    entries = cuts.where("number IS NOT NULL").select("chunk", "number", "segment")
    composed = scratch.save(compose(cuts.where("number IS NULL").select("chunk", "id", "numbers"), align(entries, path_a, pattern, path_b), max(len(t.bytes_a), len(t.bytes_b)), block), "composed")
    scratch.drop(cuts)
    held = composed.where("number IS NOT NULL").select("chunk", "number", "a", "b", "docs")
    counts = scratch.save(pair_counts(held, scratch), "pairs")
    known = held.select("chunk", "number", "a", "b").join(counts, ["a", "b"]).select("chunk", "number", "count", "best")
    return scores(composed.where("number IS NULL"), known).withColumnRenamed("id", id_col), counts
