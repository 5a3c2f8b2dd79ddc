import random

import numpy as np

from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import SuffixAutomaton, _merge, words_of


def brute(items, words, width):
    hit, found = set(), set()
    for k, item in enumerate(items):
        wins = [item[i : i + width] for i in range(len(item) - width + 1)] if len(item) >= width else [item] if item else []
        for win in wins:
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(k)
    return hit, found


def test_automaton_equals_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        width = rng.choice([2, 3, 4])
        items = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(9))] for _ in range(rng.randrange(5))]
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(25))]
        automaton = SuffixAutomaton([(str(k), i) for k, i in enumerate(items)], width)
        spans, groups = automaton.scan(words)
        assert ({x for a, b in spans for x in range(a, b)}, {int(k) for k in automaton.named(groups)}) == brute(items, words, width)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_words_are_lower_cased_in_ascii_only():
    assert words_of("Ab-9z É_x".encode()) == [b"ab", b"9z", "É".encode(), b"x"]
    assert words_of(b"") == []


def test_spans_of_two_blocks_merge():
    a, b = np.array([[1, 4], [9, 12]]), np.array([[2, 6], [12, 13], [20, 21]])
    assert _merge(a, b).tolist() == [[1, 6], [9, 13], [20, 21]]


def test_many_items_take_bounded_memory_and_time():
    """A block of items in a process of its own: what it holds, and repeats of one short item."""
    import subprocess
    import sys

    code = """
import random, resource, time
from tidemark.llm.decontaminate import BLOCK_BYTES, SuffixAutomaton
rng = random.Random(1)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
items, size = [], 0
while size < BLOCK_BYTES:
    words = [b"%x" % int(rng.paretovariate(0.4)) for _ in range(300)]
    items.append((str(len(items)), words))
    size += sum(map(len, words)) + len(words)
held = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
SuffixAutomaton(items)
print("MB", (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 - held)
repeats = SuffixAutomaton([("a", [b"word"])] * 20_000)
began = time.time()
spans, groups = repeats.scan([b"word"] * 500)
print("s", time.time() - began, spans.tolist(), repeats.named(groups))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True).stdout.split("\n")
    assert float(out[0].split()[1]) < 800
    assert float(out[1].split()[1]) < 0.1 and out[1].endswith("[[0, 500]] {'a'}")


def test_any_number_of_blocks_gives_the_same(spark):
    """Columns that bear the names of what is added, repeated items, and a very long text."""
    rng = random.Random(4)
    made = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n))
    texts = [made(40) for _ in range(20)]
    items = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate([*texts, texts[0], "One two", None])] + [(None, texts[1])], "item_id string, text string")
    rows = [(k, f"{made(30)} {texts[k % 20]} {made(30)} one TWO", 777, "x", "y", 5) for k in range(40)] + [(99, made(200_000) + " " + texts[3], 777, "x", "y", 5), (100, "", 1, "", "", 0), (101, None, 1, "", "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, hit_spans string, was_items string, n_chars int")
    found = [sorted(map(tuple, decontaminate.digest(decontaminate.match(docs, items, block_bytes=b)).collect())) for b in (1 << 20, 400)]
    assert found[0] == found[1] and sum(r[5] for r in found[0]) == 41
    assert next(r[3] for r in found[0] if r[0] == 0) == 3  # i0, i20 and the short one
    cleaned = [sorted(map(tuple, decontaminate.clean(docs, items, block_bytes=b).collect()), key=str) for b in (1 << 20, 400)]
    assert cleaned[0] == cleaned[1] and len(cleaned[0]) == 43
    assert all(r[2:5] == ((777, "x", "y") if r[0] < 100 else (1, "", "")) for r in cleaned[0])
    assert not any(texts[r[0] % 20] in (r[1] or "") for r in cleaned[0]) and all(r[5] == len(r[1] or "") or r[0] > 99 for r in cleaned[0])
