import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import substring_dedup as sd


def brute(rows, length=50):
    out, seen = {}, {}
    for i, raw in sorted(((i, r or b"") for i, r in rows if i is not None), key=lambda x: x[0]):
        cover = np.zeros(len(raw), bool)
        windows = [raw[p : p + length] for p in range(len(raw) - length + 1)]
        for p, w in enumerate(windows):
            if w in seen and seen[w] < i:
                cover[p : p + length] = True
        for w in windows:
            seen.setdefault(w, i)
        edges = np.diff(np.concatenate([[0], cover.view(np.int8), [0]]))
        kept = bytes(x for x, c in zip(raw, cover, strict=True) if not c)
        out[i] = (len(raw), int(cover.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def texts(rng, n):
    parts = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(20, 90))) for _ in range(12)]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6)))
        out.append(t)
    return [*out, "", None, "x" * 400, "x" * 300, out[0], "ab" * 200, "short"]


@pytest.mark.parametrize("group_bytes,piece", [(1 << 20, 1 << 20), (900, 700)])
def test_equals_brute_force(spark, monkeypatch, group_bytes, piece):
    monkeypatch.setattr(sd, "GROUP_BYTES", group_bytes)
    rng = random.Random(11)
    rows = list(enumerate(texts(rng, 60)))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows] + [(None, "x" * 90, "z")], "doc_id bigint, text string, n_bytes string")
    got = {r[0]: tuple(r[1:]) for r in sd.repeats(docs).collect()}
    alone = got.pop(None)
    assert alone[:3] == (90, 0, 0)
    assert got == brute([(i, t.encode() if t is not None else None) for i, t in rows])


def test_empty_table_and_columns(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert sd.repeats(docs).count() == 0
    docs = spark.createDataFrame([(1, "y" * 60, "en", 60), (2, "y" * 60 + "tail", "de", 64)], "doc_id bigint, text string, lang string, n_chars bigint")
    assert sorted(map(tuple, sd.without_repeats(docs).collect())) == [(1, "y" * 60, "en", 60), (2, "tail", "de", 4)]


def test_bytes_decide_where_hashes_agree(spark):
    """Two anchors that agree in 32 bits of their hash and in all around them."""
    rows = [(1, "price is yaqcfrfqmkwifpslgclgzkmachwrycoq per unit"), (2, "price is iabbgkkavjrsbaurbwrlrgbyzdoioeqh per unit"), (3, "price is iabbgkkavjrsbaurbwrlrgbyzdoioeqh per unit")]
    got = {r["doc_id"]: r["n_removed"] for r in sd.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_rows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(sd, "_keys", lambda start, words: np.zeros(len(words), np.uint64))
    rng = np.random.default_rng(5)
    rows = np.repeat(rng.integers(0, 3, (40, 16)).astype(np.uint8), 3, axis=0)[rng.permutation(120)]
    codes = rng.integers(0, 2, 120).astype(np.uint64)
    by, fresh = sd.in_order(codes, rows)
    assert fresh.sum() == len({(c, r.tobytes()) for c, r in zip(codes, rows, strict=True)})
    shape = sd.Shape()
    text = np.frombuffer(bytes(rng.integers(97, 99, 5000).astype(np.uint8)) + b"q" * 300, np.uint8)
    r = sd.records_of(text, np.array([0]), np.array([0]), shape)
    c = sd.contexts_of(r, np.arange(len(r.at)), shape)
    back = np.zeros_like(c)
    sd._expand_contexts(sd._squeeze_contexts(c, shape), back, shape)
    assert (back == c).all()
    for row, a, b in zip(c, r.begin, r.last, strict=True):
        assert bytes(row[2:][row[2:] > 0]) == text[a : b + 50].tobytes()


@pytest.mark.parametrize("group_bytes", [1 << 20, 40_000])
def test_hot_anchors_are_split(spark, monkeypatch, group_bytes):
    """A phrase of 40 bytes with a different text around it in each document, and some repeats longer than that."""
    monkeypatch.setattr(sd, "GROUP_BYTES", group_bytes)
    rng = random.Random(12)
    phrase = "a phrase that stands in every document, "
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, some(20 + i % 7) + phrase + (some(30) if i % 5 else "ending that is not rare " + some(6)) + phrase) for i in range(4000)]
    rows += [(5000 + i, "x" + rows[i * 7][1][3:] + "y") for i in range(60)]
    got = {r[0]: tuple(r[1:]) for r in sd.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute([(i, t.encode()) for i, t in rows])
    assert sum(r[1] > 0 for r in got.values()) > 300
    raws, shape = [t.encode() for _, t in rows], sd.Shape()
    told = sd._shared(pa.Table.from_batches([sd._anchors(0, sd._all_records(raws, shape), np.arange(len(raws)), shape, 1)]))
    assert len(sd._codes(told, "hot"))


def test_rows_that_repeat_an_id_and_clashing_columns(spark):
    line = "the same long line of text that stands in all of these rows here"
    rows = [(1, line), (1, line), (1, line + " and more"), (2, line), (None, line), (None, line), (3, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "id", "raw", "g", 7) for i, t in rows], "doc_id bigint, text string, id string, raw string, g string, n_chars bigint")
    got = sorted(map(tuple, sd.without_repeats(docs).collect()), key=str)
    want = [(i, "" if i == 2 else t, "id", "raw", "g", 0 if i == 2 else 7) for i, t in rows]
    assert got == sorted(want, key=str)


def test_a_very_long_text(spark, monkeypatch):
    rng = random.Random(13)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_500_000))
    rows = [(1, long[1_040_000:1_060_000]), (2, long), (3, "z" * 80 + long[2_000_000:2_000_060])]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in sd.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (0, 0), 2: (20_000, 1), 3: (60, 1)}
