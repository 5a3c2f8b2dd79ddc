"""Packing: every id in one piece, full sequences, and least squares held against its optimality conditions."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, queries
from tidemark.llm.byte_level import byte_level
from tidemark.llm.token_counts import default_tokenizer

SCHEMA = "doc_id bigint, text string, start string, ids string, sequence_id string"


def checked(pieces, texts, window=packing.WINDOW):
    """pieces: rows with ids; texts: by id, where ids don't repeat. The share of documents within a window that are cut."""
    library = Tokenizer.from_file(default_tokenizer())
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == texts.keys()
    cut = []
    for doc, parts in by_doc.items():
        want = library.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        parts.sort(key=lambda p: p["start"])
        at = 0
        for p in parts:
            assert p["start"] == at and p["length"] == len(p["ids"]) > 0 and p["doc_tokens"] == len(want)
            assert p["ids"] == want[at : at + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
            at += p["length"]
        assert at == len(want)
        if at <= window:
            cut.append(len(parts) > 1)
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts)])[:-1].tolist()
        n = sum(p["length"] for p in parts)
        assert n <= window and (n == window or n & (n - 1) == 0)
    return np.mean(cut)


def test_every_id_is_in_one_piece(spark):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choices(["tide", "mark", "naïve", "日本語", "42", "\n"], k=int(rng.paretovariate(0.8) * 20) % 6000)) for i in range(300)}
    texts |= {300: None, 301: "", 302: "word longer " * 30_000, 303: "a <|endoftext|> b", 304: "x" * 5000}
    docs = spark.createDataFrame([(i, t, "s", "i", "q") for i, t in texts.items()], SCHEMA).repartition(3)
    assert checked(packing.pack(docs).collect(), texts) < 0.2


def test_small_windows_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "one two three", "s", "i", "q"), (5, "four", "s", "i", "q"), (5, "four", "s", "i", "q")], SCHEMA)
    got = packing.pack(docs, window=4).collect()
    assert sum(p["length"] for p in got) == 8 and sum(p["length"] for p in got if p["doc_id"] == 5) == 4
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_least_squares_meets_the_optimality_conditions(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 3, (20, 60)).astype(float), rng.integers(0, 100, 20).astype(float)
    x = packing.nonnegative(a.T @ a, a.T @ b)
    slope = a.T @ (b - a @ x)
    assert x.min() >= 0 and slope.max() < 1e-5 and np.abs(slope[x > 0]).max() < 1e-5


def test_combinations_are_all_that_fill_the_window():
    parts, counts, gram = packing.combinations(12, 3)
    want = {(12,), *((a, 12 - a) for a in range(1, 7)), *((a, b, 12 - a - b) for a in range(1, 12) for b in range(a, 12) if 12 - a - b >= b)}
    assert {tuple(p for p in row if p) for row in parts.tolist()} == want
    assert (counts.T @ np.arange(1, 13) == 12).all() and (gram == counts.T @ counts).all()


def test_least_squares_leaves_few_documents_to_the_greedy_step():
    lengths = np.random.default_rng(5).integers(1, 2048, 6000)
    sequences, rest = packing._planned(lengths, 2048)
    assert len(rest) < 0.1 * len(lengths) and max(lengths[s].sum() for s in sequences) <= 2048
    doc, start, length, sequence, offset = packing.pack_lengths(lengths)
    assert (np.bincount(doc, length) == lengths).all() and np.mean(np.bincount(doc) > 1) < 0.05
    full = np.bincount(sequence, length) == 2048
    assert full.sum() == lengths.sum() // 2048


def test_faster_merges_give_the_librarys_ids():
    library = Tokenizer.from_file(default_tokenizer())
    coder, rng = byte_level(default_tokenizer()), random.Random(9)
    assert coder.fast is not None
    texts = ["".join(rng.choice(["a", " b", "  ", "\n", "é", "'s", "12", "中", "　", "\x1c", "<|endoftext|>", "🙂", "́"]) for _ in range(60)) for _ in range(300)]
    assert coder.encode(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_query(spark):
    table = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{table}/documents.parquet").collect()}
    rows = queries.op11_packing(spark, table).collect()
    library = Tokenizer.from_file(default_tokenizer())
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in rows)
