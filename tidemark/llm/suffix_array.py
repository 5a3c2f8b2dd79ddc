"""Suffix arrays by linear grouping of Lyndon prefixes.

First the suffixes are grouped by their longest Lyndon prefix: groups are taken from the highest to the lowest, each member's
previous smaller suffix (the nearest one before it in a lower group) is found, and those that as many members point to move
together into a new group right above their old one. Then the groups, which stand in order, are filled from the lowest suffix
on: the suffix before one whose place is known, and what its previous-smaller pointers lead to, take the next places of their
groups. Nothing is renamed and no smaller problem is solved on the way.

`suffix_array` takes one sequence. `suffix_arrays` takes many short ones, a column each, and lets all columns take a step at a
time in numpy.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start of each suffix in lexicographic order; any integers, a suffix that begins another comes first."""
    n = len(symbols) + 1
    ranks = np.append(np.unique(symbols, return_inverse=True)[1] + 1 if n > 1 else np.empty(0, np.int64), 0)
    group = (np.cumsum(np.bincount(ranks)) - np.bincount(ranks))[ranks].tolist()  # a group is named by its first place
    members: dict[int, list[int]] = {}
    for i, g in enumerate(group):
        members.setdefault(g, []).append(i)
    size = {g: len(m) for g, m in members.items()}
    ends_with = {g + c: g for g, c in size.items()}  # place behind a group -> group
    previous = [-1] * n
    high = n
    while high > 0:
        low = ends_with[high]
        own = [i for i in members[low] if group[i] == low]
        own.sort()
        pointed: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        moves: dict[int, dict[int, list[int]]] = {}
        for p, times in pointed.items():
            moves.setdefault(group[p], {}).setdefault(times, []).append(p)
        for old, by_times in moves.items():
            at = old + size[old] - sum(map(len, by_times.values()))
            size[old] = at - old
            if at > old:
                ends_with[at] = old
            for times in sorted(by_times):
                moved = by_times[times]
                for p in moved:
                    group[p] = at
                members[at], size[at], ends_with[at + len(moved)] = moved, len(moved), at
                at += len(moved)
        high = low
    out, free, placed = [-1] * n, list(range(n)), [False] * n
    out[0], placed[n - 1] = n - 1, True
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            placed[i] = True
            i = previous[i]
    return np.array(out[1:], np.int64)


def suffix_arrays(lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each column of lanes [place, lane], whose first `lengths` symbols count and end with a 0 that stands nowhere else.

    Column c of the result holds the order of its suffixes, the one of the final 0 first; -1 fills the rest.
    """
    depth, width = lanes.shape
    inside = np.arange(depth)[:, None] < lengths[None, :]
    symbols = np.where(inside, lanes.astype(np.int32), np.iinfo(np.int32).max)
    order = np.argsort(symbols, axis=0, kind="stable")
    ordered = np.take_along_axis(symbols, order, axis=0)
    fresh = np.ones((depth, width), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(fresh, np.arange(depth)[:, None], 0), axis=0)
    group = np.empty((depth, width), np.int16)
    np.put_along_axis(group, order, first.astype(np.int16), axis=0)
    group[~inside] = np.iinfo(np.int16).max
    lanes_all = np.arange(width)
    final = np.ones((depth, width), bool)
    final[:-1] = fresh[1:]
    ends_with = np.zeros((depth + 1, width), np.int16)  # place behind a group -> group
    np.copyto(ends_with[1:], first, where=final, casting="unsafe")
    size = np.zeros((depth, width), np.int16)
    row, lane = np.nonzero(final)
    size[first[row, lane], lane] = row + 1 - first[row, lane]
    previous = np.full((depth, width), -1, np.int16)
    flat_group, flat_previous, flat_size, flat_ends = (x.reshape(-1) for x in (group, previous, size, ends_with))
    done = lengths.astype(np.int64)
    while True:
        current = np.where(done > 0, ends_with[done, lanes_all], -1)
        if current.max() <= 0:  # the last group holds the final 0 alone
            break
        done = np.maximum(current, 0)
        own = np.flatnonzero(group == np.where(current > 0, current, -1).astype(np.int16))
        lane = own % width
        low = current[lane]
        # Back over what isn't lower: along the pointers of higher suffixes, one by one past those of this group.
        at, walking = own - width, np.flatnonzero(own >= width)
        while len(walking):
            here = at[walking]
            g = flat_group[here]
            stay = g >= low[walking]
            walking, here, g = walking[stay], here[stay], g[stay]
            onward = np.where(g > low[walking], flat_previous[here].astype(np.int64) * width + lane[walking], here - width)
            at[walking] = onward
            walking = walking[onward >= 0]
        found = at >= 0
        flat_previous[own[found]] = at[found] // width
        if not found.any():
            continue
        pointed, times = np.unique(at[found], return_counts=True)
        lane, old = pointed % width, flat_group[pointed].astype(np.int64)
        key = (lane * depth + old) * (depth + 1) + times
        by = np.argsort(key, kind="stable")
        key, pointed, lane, old = key[by], pointed[by], lane[by], old[by]
        new_set = np.concatenate([[True], key[1:] != key[:-1]])
        outer = key // (depth + 1)
        new_old = np.concatenate([[True], outer[1:] != outer[:-1]])
        at_old, at_set = np.flatnonzero(new_old), np.flatnonzero(new_set)
        home = old[at_old] * width + lane[at_old]
        left = flat_size[home] - np.diff(np.append(at_old, len(key)))
        flat_size[home] = left
        some = left > 0
        flat_ends[home[some] + left[some] * width] = old[at_old[some]]
        which = np.cumsum(new_old)[at_set] - 1
        begin, many = old[at_set] + left[which] + at_set - at_old[which], np.diff(np.append(at_set, len(key)))
        flat_size[begin * width + lane[at_set]] = many
        flat_ends[(begin + many) * width + lane[at_set]] = begin
        flat_group[pointed] = begin[np.cumsum(new_set) - 1]
    out = np.full((depth, width), -1, np.int16)
    free = np.broadcast_to(np.arange(depth, dtype=np.int16)[:, None], (depth, width)).copy()
    placed = ~inside
    out[0], placed[lengths - 1, lanes_all] = lengths - 1, True
    for k in range(depth):
        i = out[k].astype(np.int64) - 1
        lane = np.flatnonzero(i >= 0)
        i = i[lane]
        while len(lane):
            go = ~placed[i, lane]
            i, lane = i[go], lane[go]
            if not len(lane):
                break
            g = group[i, lane]
            at = free[g, lane]
            out[at, lane] = i
            free[g, lane] = at + 1
            placed[i, lane] = True
            i = previous[i, lane].astype(np.int64)
            go = i >= 0
            i, lane = i[go], lane[go]
    return out
