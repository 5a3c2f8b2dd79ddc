"""Classes against brute force; pairs hidden in a family of texts that are just too different: every bucket holds many of them,
and few are its pivots."""

import random

from tidemark.llm import near_duplicates


def _shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def _family(members=200, pairs=40):
    """Words of texts about 0.75 alike; each of the first `pairs` and its successor by `members` are about 0.85 alike."""
    rng = random.Random(3)
    core = [f"core{i}" for i in range(300)]
    texts = []
    for k in range(members):
        texts.append(core + [f"own{k}x{rng.randrange(10**6)}" for _ in range(49)])
    for k in range(pairs):
        texts.append(texts[k][:325] + [f"twin{k}x{rng.randrange(10**6)}" for _ in range(24)])
    return texts


def test_a_family_under_the_threshold_hides_no_pair(spark):
    texts = _family()
    sets = [_shingles(t) for t in texts]
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.83]
    assert alike == [(200 + k, k) for k in range(40)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.classes(df).collect()}
    assert [(i, j) for i, j in alike if got[i] != got[j]] == []
    assert len(set(got.values())) == 200


def _brute(texts, threshold=0.8):
    """Classes by all pairs of the weighted sets, and the similarities around the threshold."""
    raws = [t.encode() for t in texts]
    s, c, sizes, _ = near_duplicates.shingles_of(raws)
    sketch = sum_sketch(s)
    w = near_duplicates.weights_of(s, c, sketch, len(texts))
    sets, at = [], 0
    for n in sizes.tolist():
        sets.append(dict(zip(s[at : at + n].tolist(), w[at : at + n].tolist(), strict=True)))
        at += n
    parent, near = list(range(len(texts))), 0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            low = sum(min(v, b[k]) for k, v in a.items() if k in b)
            similarity = low / (sum(a.values()) + sum(b.values()) - low)
            near += abs(similarity - threshold) < 1e-5
            if similarity >= threshold:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))], near


def sum_sketch(s):
    import numpy as np

    return np.stack([np.bincount(near_duplicates._sketch_at(s, row), minlength=1 << near_duplicates.SKETCH_BITS) for row in range(near_duplicates.SKETCH_ROWS)])


def test_classes_equal_brute_force_of_weighted_sets(spark):
    rng = random.Random(21)
    texts = []
    for k in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 90, 200]))]
        for _ in range(rng.randrange(1, 7)):
            words = list(base)
            for _ in range(rng.randrange(0, len(words) // 12 + 1)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
            texts.append(" ".join(words if rng.random() < 0.8 else words + words[:20]))
    want, near = _brute(texts)
    assert near == 0
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want and 40 <= len(set(want)) < len(texts)


def test_an_id_with_several_texts_loses_no_link(spark):
    """Each row is classed by its own text, whatever other texts its id has."""
    rng = random.Random(12)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(150)] for _ in range(25)]
    rows = []
    for k in range(120):
        words = list(bases[k % 25])
        words[rng.randrange(150)] = f"edit{k}"
        rows.append((rng.randrange(60), " ".join(words)))
    a, b = " ".join(bases[0]), " ".join(f"z{i}" for i in range(80))
    rows += [(101, a), (102, b), (102, a + " q"), (103, b + " x"), (104, None), (104, a), (None, a)]
    texts = [t for _, t in rows if t]
    found, near = _brute(texts)
    assert near == 0
    least = {}
    for (i, t), c in zip([r for r in rows if r[1]], found, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    of_text = {t: least[c] for t, c in zip(texts, found, strict=True)}
    df = spark.createDataFrame([(i, t, "s", "k") for i, t in rows], "doc_id bigint, text string, k1 string, id string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"] or 0) for r in near_duplicates.classes(df).collect())
    assert got == sorted((i is None, i or 0, 0 if i is None else of_text[t] if t else i) for i, t in rows)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["k1"], r["id"]) for r in near_duplicates.keep_one(df).collect())
    want = {(i, t) for i, t in rows if i is not None and (of_text[t] if t else i) == i} | {(None, a)}
    assert kept == sorted((i is None, i or 0, t or "", "s", "k") for i, t in want)


def test_a_copy_under_an_id_with_another_text_is_linked(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (2, b), (2, a + " q"), (3, b + " x")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["class_id"]) for r in near_duplicates.classes(df).collect()) == [(1, 1), (2, 1), (2, 2), (3, 2)]
    assert sorted((r["doc_id"], r["text"]) for r in near_duplicates.keep_one(df).collect()) == [(1, a), (2, b)]
