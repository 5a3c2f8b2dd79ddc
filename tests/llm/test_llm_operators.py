"""Nulls in any column, empty and long texts, ties and repeated rows, empty tables and clashing columns, for each operator."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_extract, language_id, licence_scan, near_duplicates, sentence_pieces, token_counts, toxicity, vector_search

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_tokens string"
LONG = "word longer " * 30_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Hello world, this is text one.", "en"), (2, None, "en"), (3, "", "de"), (None, "no id here at all", "en"), (5, LONG, None), (6, "Hello world, this is text one.", "en"), (6, "Hello world, this is text one.", "en"), (7, "!!! 123", None)]
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "y") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts_equal_the_library(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.default_tokenizer())
    got = token_counts.token_counts(docs, limit=10).select("doc_id", "text", "n_bytes", "n_tokens", "over_limit", "score").collect()
    assert len(got) == 8
    for r in got:
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"], r["score"]) == (len((r["text"] or "").encode()), n, n > 10, "x")
    assert token_counts.token_counts(none).count() == 0


def test_long_texts_split_where_counts_add_up():
    rng = random.Random(1)
    text = "".join(rng.choice(["a", "b c", " ", "  ", "\n", " x", "é", "'s", "1", "<|endoftext|>", ".", "日本"]) for _ in range(6000))
    text += "".join(rng.choice(["中文", "，", "。", "'s", "'t", "12", "²", "x", "<|endoftext|>", "'", "\n", "e\u0301", "ｱ", "！"]) for _ in range(6000))
    parts = token_counts.split_long(text, 40)
    assert "".join(parts) == text and len(parts) > 20
    path = token_counts.default_tokenizer()
    assert token_counts.count(parts, path).sum() == len(token_counts._load(path).encode(text, add_special_tokens=False).ids)


def test_licences(docs, none, spark):
    got = {r["doc_id"]: r for r in licence_scan.licence_scan(docs).collect()}
    assert got[1]["licence"] is None and got[1]["dice"] is None and got[1]["n_matches"] == 0
    mit, wrapped = licence_scan.TEMPLATES["MIT-text"], licence_scan.TEMPLATES["Apache-2.0-header"].split()
    lines = "\n".join("# " + " ".join(wrapped[i : i + 7]) for i in range(0, len(wrapped), 7))
    rows = [
        (1, "Some text.\nreleased   under the MIT license!\nAll rights reserved"),
        (2, licence_scan.TEMPLATES["GPL-3.0"]),
        (3, "MIT"),
        (4, f"import x\n{lines}\ndef f(): pass\n" * 2),
        (5, "a long story " * 300 + mit.replace("Software", "Program") + " and more words behind it" * 50),
        (6, "In a paragraph (Licensed under CC BY-NC 4.0.) of a text"),
        (6, "In a paragraph (Licensed under CC BY-NC 4.0.) of a text"),
    ]
    got = sorted((r["doc_id"], r["licence"], r["n_matches"]) for r in licence_scan.licence_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert [g[:2] for g in got if g[0] != 3] == [(1, "MIT"), (2, "GPL-3.0"), (4, "Apache-2.0"), (5, "MIT-text"), (6, "CC-BY-NC-4.0"), (6, "CC-BY-NC-4.0")]
    assert got[0][2] == 2 and got[2] == (3, None, 0) and got[3][2] == 2
    assert licence_scan.licence_scan(none).count() == 0


def test_licence_bounds_drop_nothing(spark):
    """Against all windows of all templates, keys and sizes aside."""
    rng = random.Random(2)
    words = [w for t in licence_scan.TEMPLATES.values() for w in licence_scan.words_of(t)]
    texts = list(licence_scan.TEMPLATES.values())
    for t in list(texts):
        own = licence_scan.words_of(t)
        for share in (0.02, 0.05, 0.08):
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in [*rng.sample(words, 9), *own, *rng.sample(words, 9)]))
    got = licence_scan.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        grams = [f"{a} {b}" for w in [licence_scan.words_of(texts[r["doc_id"]])] for a, b in zip(w, w[1:], strict=False)]
        found = {}
        for name, t in licence_scan.TEMPLATES.items():
            own, n = set(licence_scan.bigrams_of(t)), len(licence_scan.words_of(t))
            windows = [set(grams[i : i + n - 1]) for i in range(len(grams)) if grams[i] in own]
            best = max((2 * len(g & own) / (len(g) + len(own)) for g in windows), default=0)
            if best >= licence_scan.THRESHOLD:
                found[name] = best
        want = min(((-d, n) for n, d in found.items()), default=None)
        assert r["n_matches"] == len(found) and (r["licence"], r["dice"]) == ((None, None) if want is None else (want[1], pytest.approx(-want[0])))


def test_decontamination(docs, none, spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (None, "no name"), (5, ""), (1, item)], "item_id bigint, text string")
    texts = [(1, f"Start {item.upper()} end."), (2, None), (3, ""), (4, "a SHORT, item! here " * 2), (5, "has no  name"), (6, "one two three four five six seven eight nine")]
    df = spark.createDataFrame([(i, t, "z", "q") for i, t in texts], "doc_id bigint, text string, hit_items string, n_hit string")
    one = {r["doc_id"]: tuple(r) for r in decontaminate.digest(decontaminate.match(df, items)).collect()}
    several = {r["doc_id"]: tuple(r) for r in decontaminate.digest(decontaminate.match(df, items, block_bytes=1)).collect()}
    assert one == several
    assert {i: (r[1], r[2], r[3], r[5]) for i, r in one.items()} == {1: (14, 12, 1, True), 2: (0, 0, 0, False), 3: (0, 0, 0, False), 4: (8, 4, 1, True), 5: (3, 2, 0, True), 6: (9, 0, 0, False)}
    assert decontaminate.match(none, items).count() == 0
    assert decontaminate.digest(decontaminate.match(docs, items.limit(0))).where("contaminated").count() == 0
    cleaned = {r["doc_id"]: r["text"] for r in decontaminate.clean(df, items, least_span=2, most_coverage=0.9).collect()}
    assert cleaned[1] == "Start  end." and cleaned[2] is None and cleaned[3] == "" and cleaned[6] == texts[5][1]


def _made(rng, alphabet, n):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_language_identification(spark, docs, none):
    rng = random.Random(4)
    rows = [(i, _made(rng, "abcdefgh" if i % 2 else "mnopqrst", 60), "xx" if i % 2 else "yy") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("held_out", language_id.held_out("doc_id", 3, 1))
    net = language_id.fit(df.where("NOT held_out"))
    got = language_id.predict(df, net).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    edge = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, net).collect()}
    assert edge[2] == edge[3] == edge[7] == ("und", 0.0) and edge[5][0] in ("xx", "yy") and 0 < edge[5][1] <= 1
    assert language_id.predict(none, net).count() == 0
    assert language_id.fit(none) is None and {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = _made(rng, "abcdeghiklmnorst", 40).split()
        if toxic:
            words[rng.randrange(40)] = "zzvuxq" + rng.choice("abcdef")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    from pyspark.sql import functions as F

    model = toxicity.fit(df.where(~language_id.held_out("doc_id", 4, 2)), spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id bigint, toxic int"), F.crc32(F.col("id").cast("string").cast("binary")) % 4)
    got = [r for r in toxicity.predict(df, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = [r["predicted"] == (r["doc_id"] % 5 == 0) for r in got]
    assert np.mean(right) > 0.97
    edge = toxicity.predict(docs, model).collect()
    assert len(edge) == 8 and all(0 <= r["score"] <= 1 for r in edge)
    assert toxicity.predict(none, model).count() == 0
    empty = toxicity.fit(none, spark.createDataFrame([], "doc_id bigint, toxic int"), F.lit(0))
    assert toxicity.predict(docs, empty).count() == 8


def test_sentence_pieces_equal_the_library(docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    rng = random.Random(8)
    texts = ["", " ", "  a  b ", "\n\t x", "日本語 here 🙂", "a" * 700, "<s> <0x0A>", *("".join(rng.choice("etaoinshrdlu ETA.,12é▁") for _ in range(50)) for _ in range(400))]
    model = sentence_pieces.load(sentence_pieces.default_model())
    rng.shuffle(texts)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x370, 0x530), rng.randrange(0x4E00, 0x5000), rng.randrange(0x1F600, 0x1F640), 32])) for _ in range(60)) for _ in range(300)]
    ids, sizes = model.encode(texts)
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    for text, own, back in zip(texts, parts, model.decode(ids, sizes), strict=True):
        assert own.tolist() == lib.encode(text)
        assert back.decode() == text.replace("▁", " ") if not text.startswith("▁") else True
    got = sentence_pieces.round_trip(docs).select("doc_id", "n_tokens", "round_trip").collect()
    assert sorted((r["round_trip"] for r in got), key=str) == [None] + [True] * 7
    back = sentence_pieces.decode(sentence_pieces.encode(docs)).collect()
    assert all(r["decoded"] == r["text"] for r in back)
    assert sentence_pieces.encode(none).count() == 0


def test_pairs_stay_apart_as_merging_leaves_them():
    model = sentence_pieces.load(sentence_pieces.default_model())
    rng = np.random.default_rng(4)
    usable = np.flatnonzero(model.usable)
    left, right = rng.choice(usable, 3000), rng.choice(usable, 3000)
    short = [model.ids[p] for p in model.ids if set(p) <= set("▁ateon")]
    left, right = np.append(left, rng.choice(short, 3000)), np.append(right, rng.choice(short, 3000))
    want = [sentence_pieces.merge([*model.pieces[a], *model.pieces[b]], model.score) == [model.pieces[a], model.pieces[b]] for a, b in zip(left, right, strict=True)]
    assert model.are_stable(left, right).tolist() == want and 0 < sum(want) < 6000


def test_a_wrong_key_does_not_decide(monkeypatch):
    """Where the search accepts a piece by its key alone, the pieces' characters find out."""
    model = sentence_pieces.load(sentence_pieces.default_model())
    rows = ["▁there", "▁these", "▁other"]
    right = [sentence_pieces.merge(list(r), model.score) for r in rows]
    monkeypatch.setattr(model, "viterbi", lambda rows: (np.array([model.ids["▁the"], model.ids["▁the"], model.ids["▁the"]]), np.ones(3, np.int64)))
    ids, sizes = model._search(rows)
    assert [[model.pieces[i] for i in part] for part in np.split(ids, np.cumsum(sizes)[:-1])] == right


def test_unigram_viterbi_takes_the_best_sum():
    model = object.__new__(sentence_pieces.PieceModel)
    model.__dict__.update(sentence_pieces.load(sentence_pieces.default_model()).__dict__)
    rng = random.Random(9)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(40)} | set("abc"))
    score = {p: -rng.random() * 5 for p in pieces}
    keys = sentence_pieces._mix(np.array([model._sum(p) for p in pieces], np.uint64))
    order = np.argsort(keys)
    model.__dict__.update(is_bpe=False, longest=4, keys=keys[order], key_ids=order.astype(np.int64), scores=np.array([score[p] for p in pieces]), filter=np.ones_like(model.filter), usable=np.ones(len(pieces), bool))
    for n in (1, 2, 5, 9):
        rows = ["".join(rng.choice("abc") for _ in range(n)) for _ in range(30)]
        found, sizes = model.viterbi(rows)
        for row, ids in zip(rows, np.split(found, np.cumsum(sizes)[:-1]), strict=True):
            best = [0.0] + [-1e9] * n
            for e in range(1, n + 1):
                best[e] = max(best[e - k] + score.get(row[e - k : e], -1e9) for k in range(1, min(4, e) + 1))
            assert "".join(pieces[i] for i in ids) == row and math.isclose(sum(score[pieces[i]] for i in ids), best[n])


def top(rows, k=20):
    """(query_id, rank, vec_id, score) of every row whose id 20 divides against every other row, in whole numbers of any size."""
    whole = [(i, [math.floor(x * 64) if abs(x) < 1e300 else int(x) * 64 for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for n, (q, v) in enumerate(whole):
        if q is not None and q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0) for m, (i, w) in enumerate(whole) if m != n and len(w) == len(v))[:k]
            want.update((q, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(best, 1))
    return want


def searched(df, **options):
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_search.exact_top_k(df, F.col("vec_id") % 20 == 0, **options).collect())


def test_vector_search(spark):
    """Every row but the query's own: rows that repeat an id meet, and so do those of a null id and those without components."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 0.3, (300, 16)).round(2)
    vectors[50:60] = vectors[40]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1020, [float("nan")] * 16), (1040, [None] * 16), (1060, []), (1061, []), (1080, [1.0, 2.0]), (40, vectors[40].tolist()), (None, vectors[0].tolist()), (None, (3 * vectors[20]).tolist())]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id bigint, embedding array<double>, query_row string")
    want = top(rows)
    for block in (4096, 7):
        assert searched(df, block=block) == want
    two = vector_search.exact_top_k(df, F.col("vec_id") == 40).groupBy("query_row").count().collect()
    assert [r["count"] for r in two] == [20, 20]
    assert vector_search.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_vectors_of_any_size_and_many_equal_ones(spark):
    rng = np.random.default_rng(8)
    wide = [(i, rng.normal(0, 10.0 ** rng.integers(-2, 7), 300).tolist()) for i in range(60)]
    same = [(1000 + i % 400, [0.5] * 300) for i in range(900)]
    assert searched(spark.createDataFrame(wide + same, "vec_id bigint, embedding array<double>").repartition(3)) == top(wide + same)
    large = [(0, [200000.0, 0.25]), (1, [1.0, 1.0]), (3, [-2.0, 4.0]), (20, [0.0, 3.0]), (21, [2.0**20, -(2.0**20)]), (22, [0.0, 2.0**21]), (23, [-1e300, 0.0]), (40, [1.0, 0.0]), (60, [2.0**20, 2.0**20])]
    got = searched(spark.createDataFrame(large, "vec_id bigint, embedding array<double>"), k=3)
    assert got == top(large, 3) and (0, 1, 60, (200000 * 64 + 16) * 2**26) in got


def test_a_score_beyond_a_long_is_an_error(spark):
    df = spark.createDataFrame([(20, [1e200, 1.0]), (21, [1e200, 1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="fit a long"):
        vector_search.exact_top_k(df, F.col("vec_id") % 20 == 0).collect()


def test_html(spark):
    rows = [(1, "u", "<html><body><nav><a>Menu</a></nav><article><p>Main text stands here.</p></article></body></html>", "t"), (2, None, None, "t"), (3, "u", "", "t"), (3, "u", "", "t"), (4, "u", "<p>" * 3000 + "deep", "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_extract.html_text(df, html_extract.fit(df)).collect()
    assert len(got) == 5 and {r["page_id"]: r["text"] for r in got}[1] == "Main text stands here."
    assert {(r["text"], r["n_chars"]) for r in got if r["page_id"] in (2, 3)} == {("", 0)}
    assert html_extract.html_text(df.limit(0), html_extract.PRIOR).count() == 0


def shingles(text):
    import re

    words = [w.lower() for w in re.findall("[0-9A-Za-z]+", text)]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_duplicates(spark, docs, none):
    rng = random.Random(10)
    rows, at = [], 0
    for _ in range(40):
        base = _made(rng, "abcdeghiklmnorst", 120).split()
        for _ in range(rng.randrange(1, 6)):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = "edit" + str(at)
            rows.append((at, " ".join(words)))
            at += 1
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and len(a & b) / len(a | b) >= 0.82:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    for i in got:
        assert got[root(i)] == got[i]
    assert len(Counter(got.values())) >= 40
    edge = near_duplicates.classes(docs).collect()
    assert len(edge) == 8
    by = {r["doc_id"]: r["class_id"] for r in edge}
    assert by[6] == 1 and by[1] == 1 and by[2] == 2 and by[3] == 3 and by[None] is None and by[5] == 5
    kept = sorted((r["doc_id"] for r in near_duplicates.keep_one(docs).collect()), key=str)
    assert kept == [1, 2, 3, 5, 7, None]
    assert near_duplicates.classes(none).count() == 0


def test_sampling_follows_weighted_jaccard():
    """Two weighted sets agree on a sample about as often as their weighted Jaccard similarity."""
    rng = np.random.default_rng(5)
    s = np.sort(rng.integers(1, 2**63, 200).astype(np.uint64))
    a, b = rng.uniform(1, 3, 200), None
    b = a * rng.uniform(0.6, 1.4, 200)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    x, y = (near_duplicates.bands_of(s, w, np.array([200]), bands=800, rows=1)[0] for w in (a, b))
    assert abs((x == y).mean() - want) < 0.06
