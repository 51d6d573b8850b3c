from __future__ import annotations

import random
import struct
import zlib

import corpus_pipeline
import public_tokenizers
import tokenizers
import xxhash
from lucerna.llm import language, lines, queries, suffix
from lucerna.llm.common import Scratch, crc_mod
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _i string, begins int, there long"


def test_every_operator_has_a_query():
    assert [next(k for k in queries.QUERIES if k.startswith(f"op{n}_")) for n in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "suffix_dedup", "packing"]


def _corpus():
    rng = random.Random(6)
    known = ["".join(rng.choice("the and ing on ed re er at".split()) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(known) for _ in range(n))
    shared, rows = prose(60), []
    for i in range(30):
        rows.append([i, prose(rng.randint(20, 90)) + "\n" + prose(rng.randint(20, 90)), "en"])
    # a row that repeats, an id with another text, copies under no id
    rows += [rows[4], [5, prose(70), "en"], [None, rows[6][1], "en"], [None, prose(50), "en"]]
    # rejected; an exact copy of a document; one changed word in fifty; passages inside other prose; short, empty and long
    near = prose(120).split()
    rows += [[100, "12345 !!!", "en"], [101, None, None], [102, rows[3][1], "en"], [103, prose(160) + " " + shared, "en"], [104, shared + " x " + prose(170), "en"]]
    rows += [[105, " ".join(near), "en"], [106, " ".join([*near[:60], "other", *near[61:]]) + "\n" + prose(4), "en"], [107, "the", "en"], [108, "", "en"], [109, prose(5000), "en"]]
    # alike as documents though no line is: the same words cut into lines elsewhere
    words = prose(240).split()
    rows += [[110 + k, "\n".join(" ".join(words[i : i + n]) for i in range(0, 240, n)), "en"] for k, n in enumerate((240, 30))]
    return [(i, t, g, "s", 0, "x", 1, 2) for i, t, g in rows]


def _groups(n, alike):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if find(i) != find(j) and alike(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def _hash(text):
    """What tells a row's text beside its id: XXH64 of the text, seed 42, and of whether it is null, seeded with that."""
    own = xxhash.xxh64_intdigest(text.encode(), 42) if text is not None else 42
    out = xxhash.xxh64_intdigest(struct.pack("<i", text is None), own)
    return out - (1 << 64) if out >> 63 else out


def _place(row):
    """A row's document, in the order that ties go by."""
    return row[0] is None, row[0] or 0, _hash(row[1])


def _lines_by_force(rows):
    named = sorted((*_place(r), k, lines.normal(x)) for r in {(r[0], r[1], r[2]) for r in rows} for k, x in enumerate((r[1] or "").split("\n")))
    named = [x for x in named if x[-1]]
    texts = list(dict.fromkeys(x[-1] for x in named))
    enough = [len(t.split()) >= lines.WORDS for t in texts]
    group = _groups(len(texts), lambda i, j: enough[i] and enough[j] and lines.within(texts[i], texts[j], 0.8))
    at, first, gone = {t: g for t, g in zip(texts, group)}, {}, set()
    for *own, n in named:
        if first.setdefault(at[n], own) != own:
            gone.add(tuple(own))
    return [(r[0], None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if (*_place(r), k) not in gone), None) for r in rows]


def _near_by_force(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    named = sorted({(*_place(r), r[1]) for r in rows}, key=lambda x: x[:3])
    sets = [shingles(t) for *_, t in named]
    group = _groups(len(named), lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    stays = {x[:3] for k, (x, g) in enumerate(zip(named, group)) if g == k}
    return [r[:2] for r in rows if _place(r) in stays]


def _passages_by_force(rows):
    found, out = {}, []
    raw = [(t or "").encode() for _, t in rows]
    for x in raw:
        for i in range(len(x) - corpus_pipeline.PASSAGE + 1):
            found[x[i : i + corpus_pipeline.PASSAGE]] = found.get(x[i : i + corpus_pipeline.PASSAGE], 0) + 1
    for (i, t), x in zip(rows, raw):
        gone = bytearray(len(x))
        for k in range(len(x) - corpus_pipeline.PASSAGE + 1):
            if found[x[k : k + corpus_pipeline.PASSAGE]] > 1:
                gone[k : k + corpus_pipeline.PASSAGE] = b"\1" * corpus_pipeline.PASSAGE
        out.append((i, None if t is None else bytes(c for c, g in zip(x, gone) if not g).decode("utf-8", "ignore")))
    return out


def _key(rows):
    return sorted((-1 if i is None else i, "\0" if t is None else t) for i, t in rows)


def test_run_equals_brute_force(spark, tmp_path):
    rows = _corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language.train(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    scored = [(r, *(x[0] for x in model.scores([r[1] or ""]))) for r in rows]
    want = [[(r[0], r[1], None) for r, g, s in scored if g != language.UNKNOWN and s >= corpus_pipeline.LEAST_SCORE]]
    for force in (_lines_by_force, _near_by_force, _passages_by_force):
        want.append(force(want[-1]))
    for (name, stage), rows_wanted in zip(corpus_pipeline.STAGES, want):
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = docs.collect()
        assert _key((r["doc_id"], r["text"]) for r in got) == _key(r[:2] for r in rows_wanted), name
        assert all((r["_i"], r["begins"], r["there"], r["source"]) == ("x", 1, 2, "s") for r in got)
        assert name == "language_id" or name == "near_dedup" or all(r["n_chars"] == len(r["text"] or "") for r in got)
    want = [[r[:2] for r in x] for x in want]
    lang, line, near, passage = ({i for i, _ in x} for x in want)
    assert not {100, 101, 108} & lang and 111 in line - near and {103, 104} <= passage
    texts = dict(want[3])
    assert dict(want[1])[102] == "" and len(texts[104]) < len(dict(want[2])[104]) and texts[2] == rows[2][1]
    # packing: every id once, sequences gapless and of at most 1024
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, at = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    ids = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in want[3]]
    for i, x in ids:
        own = sorted(pieces[i, len(x)], key=lambda r: r["start"])
        crcs = {(p, n): zlib.crc32(b"".join(q.to_bytes(4, "little") for q in x[p : p + n])) for p, n in {(r["start"], r["length"]) for r in own}}
        copies = sum(j == i and y == x for j, y in ids)
        # rows that share an id and a length are told apart by their crcs
        mine = [r for r in own if r["ids_crc32"] == crcs[r["start"], r["length"]]]
        assert sum(r["length"] for r in mine) == copies * len(x) and {q for r in mine for q in range(r["start"], r["start"] + r["length"])} == set(range(len(x)))
    assert sum(r["length"] for x in pieces.values() for r in x) == sum(len(x) for _, x in ids)
    for x in at.values():
        end = 0
        for o, n in sorted(x):
            assert o == end
            end += n
        assert end <= 1024


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_unique_texts_of_repeated_ids_stay(spark):
    """An id that stands for several texts loses those that repeat elsewhere, and no other."""
    rng = random.Random(12)
    texts = {k: " ".join(f"{k}{rng.randrange(500)}" for _ in range(80)) for k in "auwop"}
    rows = [(1, "a"), (2, "a"), (2, "u"), (3, "w"), (4, "w"), (4, "o"), (None, "w"), (None, "p"), (None, "p")]
    docs = spark.createDataFrame([(i, texts[t], "en", "s", 0, "x", 1, 2) for i, t in rows], SCHEMA)
    back = {t: k for k, t in texts.items()} | {"": ""}
    stages = dict(corpus_pipeline.STAGES)
    lined = [(r["doc_id"], back[r["text"]]) for r in stages["line_dedup"](spark, docs, "").collect()]
    assert sorted(lined, key=str) == sorted([(1, "a"), (2, ""), (2, "u"), (3, "w"), (4, ""), (4, "o"), (None, ""), (None, "p"), (None, "p")], key=str)
    near = [(r["doc_id"], back[r["text"]]) for r in stages["near_dedup"](spark, docs, "").collect()]
    assert sorted(near, key=str) == sorted([(1, "a"), (2, "u"), (3, "w"), (4, "o"), (None, "p"), (None, "p")], key=str)


def test_a_character_goes_whole(spark):
    own = "é" * 150
    df = spark.createDataFrame([(1, "ab" + own + "ê c", 1), (1, "xy" + own + "è d", 2), (None, own, 3)], "doc_id long, text string, digest int")
    cut = suffix.cut(df, suffix.repeated_spans(df, Scratch(spark, "t"), depth=200))
    assert sorted(r["text"] for r in cut.collect()) == ["", "ab c", "xy d"]
