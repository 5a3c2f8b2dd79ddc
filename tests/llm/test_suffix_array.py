import random

import numpy as np

from tidemark.llm.suffix_array import suffix_array, suffix_arrays


def naive(s):
    return sorted(range(len(s)), key=lambda i: s[i:])


def test_one_sequence():
    rng = random.Random(1)
    for _ in range(600):
        s = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(40))]
        assert suffix_array(np.array(s, np.int64)).tolist() == naive(s)


def test_periodic_and_sorted_sequences():
    for s in ([0] * 50, [0, 1] * 30, list(range(40)), list(range(40))[::-1], [1, 0, 1, 1, 0] * 12):
        assert suffix_array(np.array(s)).tolist() == naive(s)


def test_lanes():
    rng = random.Random(2)
    for _ in range(30):
        rows = [[rng.randrange(1, rng.choice([2, 3, 5])) for _ in range(rng.randrange(30))] + [0] for _ in range(17)]
        lanes = np.zeros((31, 17), rng.choice([np.int16, np.int64]))
        for c, row in enumerate(rows):
            lanes[: len(row), c] = row
        found = suffix_arrays(lanes, np.array([len(r) for r in rows]))
        for c, row in enumerate(rows):
            assert found[: len(row), c].tolist() == naive(row)
