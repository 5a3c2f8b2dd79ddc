import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)

    def text(n, alphabet):
        return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 8))) for _ in range(n))

    item = text(14, "abcdefgh")
    shared = text(60, "abcdefgh")
    base = text(120, "abcdefgh")
    rows = [(i, text(80, "abcdefgh" if i % 2 else "mnopqrst"), "xx" if i % 2 else "yy") for i in range(60)]
    rows += [(100, base, "xx"), (101, base, "xx"), (102, base.replace(base.split()[60], "changed", 1), "xx")]
    rows += [(200, text(90, "abcdefgh") + " " + shared, "xx"), (201, text(90, "abcdefgh") + " " + shared, "xx")]
    rows += [(300, text(90, "abcdefgh") + " " + item + " " + text(9, "abcdefgh"), "xx"), (400, "12 34 !!", "xx"), (401, None, "yy")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "sentence_pieces":
            assert now.columns == docs.columns
    whole = {i for i, t, _ in rows if t and i != 400}
    assert set(kept["language_id"]) == whole
    assert set(kept["near_duplicates"]) == whole - {101, 102}
    assert shared not in kept["substring_dedup"][201]["text"] and shared in kept["substring_dedup"][200]["text"]
    assert item not in kept["decontaminate"][300]["text"]
    assert {i for i in range(60)} <= set(kept["sentence_pieces"])
    assert all(len(r["ids"]) == r["n_tokens"] for r in kept["sentence_pieces"].values())


def _documents(spark, rows, **more):
    names = ", ".join(f"{c} string" for c in more)
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *more.values()) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint" + (", " + names if names else ""))


def test_each_stage_equals_brute_force(spark, tmp_path):
    """The stages after the trained one, each on an input of its own."""
    import re

    import sentencepiece
    from test_near_families import _brute
    from test_substring_dedup import brute

    from tidemark.llm import sentence_pieces

    rng = random.Random(5)
    made = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    items, shared = [made(30), made(12), made(9)], made(70)
    rows = []
    for k in range(60):
        text = made(60) if k % 4 else f"{made(20)}, {rng.choice(items)} - {made(20)}"
        rows.append((len(rows), text if k % 5 else f"{made(15)} {shared} {made(15)}", "xx"))
        if k % 3 == 0:
            words = text.split()
            words[rng.randrange(len(words))] = "edit"
            rows.append((len(rows), " ".join(words), "xx"))
    docs = _documents(spark, rows)
    spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    classes, near = _brute([t for _, t, _ in rows])
    assert near == 0 and set(texts(stages["near_duplicates"](spark, docs, str(tmp_path)))) == set(classes) != set(range(len(rows)))

    import hashlib

    kept = texts(stages["substring_dedup"](spark, docs, str(tmp_path)))
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()} == {i: r[3] for i, r in brute([(i, t.encode()) for i, t, _ in rows]).items()}

    windows = [w for item in items for x in [item.split()] for n in [min(10, len(x))] for w in [x[i : i + n] for i in range(len(x) - n + 1)]]
    want = {}
    for i, text, _ in rows:
        found = list(re.finditer("[a-z0-9]+", text))
        words = [m.group() for m in found]
        hit = [any(words[a : a + len(w)] == w for w in windows for a in range(max(0, p - len(w) + 1), p + 1)) for p in range(len(words))]
        if sum(hit) > 0.5 * len(words):
            continue
        out, at, p = "", 0, 0
        while p < len(words):
            end = p
            while end < len(words) and hit[end]:
                end += 1
            if end - p >= 10:
                out, at = out + text[at : found[p].start()], found[end - 1].end()
            p = max(end, p + 1)
        want[i] = out + text[at:]
    got = texts(stages["decontaminate"](spark, docs, str(tmp_path)))
    assert got == want and any(got[i] != t for i, t, _ in rows if i in got)

    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    assert all(r["ids"] == lib.encode(rows[r["doc_id"]][1]) for r in stages["sentence_pieces"](spark, docs, str(tmp_path)).collect())


def test_empty_tables_null_ids_and_clashing_columns(spark, tmp_path):
    clash = {"class_id": "a", "score": "b", "hit_items": "c", "ids": "d", "k1": "e", "g": "f", "c0": "h"}
    line = "the very same line of words that stands in all of these documents"
    rows = [(None, line, "xx"), (None, line, "xx"), (1, line + " one", "xx"), (2, line + " of others two", "xx"), (3, "", "xx"), (4, None, None), (2, line + " of others two", "xx")]
    spark.createDataFrame([("1", "some other words")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (_documents(spark, rows, **clash), _documents(spark, [], **clash)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            found = out.collect()
            if name != "sentence_pieces":
                assert out.columns == docs.columns and all(tuple(r)[5:] == tuple(clash.values()) for r in found)
            if docs.isEmpty():
                assert found == []
            elif name == "near_duplicates":
                assert sorted((str(r["doc_id"]) for r in found)) == ["1", "2", "3", "4", "None", "None"]
            elif name == "substring_dedup":
                assert [r["text"] for r in found if r["doc_id"] is None] == [line, line] and {r["text"] for r in found if r["doc_id"] == 2} == {"f others two"}
            elif name != "language_id":
                assert len(found) == 7
