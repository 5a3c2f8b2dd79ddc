"""Token alignment against a plain merge of each text, and merge-path pieces against one piece."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm import queries, token_alignment
from tidemark.llm.byte_level import byte_level_bytes
from tidemark.llm.sentence_pieces import default_model
from tidemark.llm.token_counts import default_tokenizer

SCHEMA = "doc_id bigint, text string, n_a string, ids string, batch string"


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    a_lib, b_lib = Tokenizer.from_file(default_tokenizer()), SentencePieceProcessor(model_file=default_model())
    a_lib.encode_special_tokens = True
    aligned, counts = [], Counter()
    for text in texts:
        raw = f" {text or ''}".encode()
        a = a_lib.encode(f" {text or ''}", add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        a_raw = [byte_level_bytes(a_lib.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in a]
        b_raw = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_lib.id_to_piece(i)) for i in b)]
        if not text or b"".join(a_raw) != raw or b"".join(b_raw) != raw:
            aligned.append(([], [], [], []))
            continue
        links, groups, i, j, at_a, at_b, i0, j0 = [], [], 0, 0, len(a_raw[0]), len(b_raw[0]), 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            if at_a == at_b:
                groups.append(f"{','.join(map(str, a[i0 : i + 1]))}|{','.join(map(str, b[j0 : j + 1]))}")
                i, j = i + 1, j + 1
                i0, j0 = i, j
                at_a += len(a_raw[i]) if i < len(a) else 0
                at_b += len(b_raw[j]) if j < len(b) else 0
            elif at_a < at_b:
                i += 1
                at_a += len(a_raw[i])
            else:
                j += 1
                at_b += len(b_raw[j])
        counts.update(links)
        aligned.append((a, b, groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(len(a), len(b), len(g), len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, k in aligned]


def found(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")))
    return out


def test_texts_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "PIECE", 7)
    rng = random.Random(4)
    words = ["tide", " mark", "naïve", "日本語", "4711", "\n\n", "  ", "<|endoftext|>", "🙂", "'s", "\t", "Überraschung", "\x00", "xyzzy"]
    texts = ["".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(60)]
    texts += [None, "", " ", "a", "▁", "low ▁ bar", " leading", "trailing ", "<s> </s> <unk> <0x41>", "word longer " * 20_000, texts[0]]
    rows = [(i, t, "s", "i", "b") for i, t in enumerate(texts)]
    got = found(token_alignment.align(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert [got[i] for i in range(len(texts))] == [[w] for w in brute(texts)]


def test_repeated_and_null_ids_and_empty_tables(spark):
    texts = ["one and two", "one and two", None, "three"]
    df = spark.createDataFrame([(i, t, "s", "i", "b") for i, t in zip([1, 1, 1, None], texts, strict=True)], SCHEMA)
    got, want = found(token_alignment.align(df)), brute(texts)
    assert sorted(got[1]) == sorted(want[:3]) and got[None] == want[3:]
    assert token_alignment.align(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_pieces_give_what_one_merge_gives(seed):
    rng = np.random.default_rng(seed)
    last = 400
    a, b = (np.append(np.sort(rng.choice(last - 1, n, replace=False) + 1), last) for n in rng.integers(1, 300, 2))
    ends = np.union1d(a, b)
    want = [np.searchsorted(a, ends).tolist(), np.searchsorted(b, ends).tolist(), np.isin(ends, np.intersect1d(a, b)).tolist()]
    for piece in (1, 2, 5, 64, 10_000):
        assert [x.tolist() for x in token_alignment.overlaps(a, b, piece)] == want
    both = np.sort(np.concatenate([a, b]), kind="stable")
    at = token_alignment.split(a, b, np.arange(len(both) + 1))
    assert all(sorted([*a[:i], *b[: d - i]]) == both[:d].tolist() for d, i in enumerate(at))


def test_query_against_brute_force(spark):
    table = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{table}/documents.parquet").select("doc_id", "text").collect()
    got = found(queries.op12_token_alignment(spark, table))
    assert [got[r["doc_id"]] for r in rows] == [[w] for w in brute([r["text"] for r in rows])]
