"""Packing of documents into sequences of at most `window` tokens, by non-negative least squares.

A document is its ids and an end id. Whole windows of it are sequences of their own; what is left (up to a window) goes into a
histogram of lengths in steps of window / STEPS, rounded up. Combinations of one to three lengths that fill the window are
enumerated; non-negative least squares finds how often each is to be repeated so that together they use up the histogram. The
counts are rounded and taken as far as there are documents; the residue is packed greedily, the largest that fits first. In all
this no document is cut. What stays open (the steps round up) is filled at last: the least full sequences are taken apart and their
documents cut into the gaps of the others, so every sequence is full, but for the last tokens of a group, which make sequences
whose lengths are powers of two and need no padding.

A task packs its rows in groups of about GROUP_TOKENS tokens, each with its own histogram; so nothing is shuffled, no group grows
with the table, and a lost task is made again alike. Ids are those of the tokenizer for whole texts (`byte_level`).

Null and empty texts are one token, the end id. Very long texts are packed whole. Rows that repeat an id are packed each. Ties go
by the order of rows. An empty table gives no rows. Other columns have no part in it, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.byte_level import byte_level, flat
from tidemark.llm.common import byte_texts, release, slices
from tidemark.llm.token_counts import default_tokenizer

WINDOW = 2048
END = 1
#: Length steps of the histogram.
STEPS = 128
#: Documents of a combination.
DEPTH = 3
GROUP_TOKENS = 4_000_000
#: Sequences that one task may number.
_TASK_BITS = 33


@lru_cache(maxsize=4)
def combinations(steps: int = STEPS, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Combinations of up to `depth` lengths that sum to `steps`, the number of each length in each of them, and its Gram matrix."""
    found: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], left: int) -> None:
        low = chosen[-1] if chosen else 1
        if left >= low:
            found.append((*chosen, left))
        if len(chosen) + 1 < depth:
            for part in range(low, left // 2 + 1):
                extend((*chosen, part), left - part)

    extend((), steps)
    counts = np.zeros((steps, len(found)))
    for k, parts in enumerate(found):
        for p in parts:
            counts[p - 1, k] += 1
    padded = np.array([[*parts, *[0] * (depth - len(parts))] for parts in found])
    return padded, counts, counts.T @ counts


def nonnegative(gram: np.ndarray, target: np.ndarray, most_steps: int = 2_000) -> np.ndarray:
    """x >= 0 with the least squared error, from A'A and A'b, by an active set."""
    x, free = np.zeros(len(target)), np.zeros(len(target), bool)
    slack = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(most_steps):
        slope = np.where(free, -np.inf, target - gram @ x)
        k = int(np.argmax(slope))
        if slope[k] <= slack:
            break
        free[k] = True
        while True:
            at = np.flatnonzero(free)
            part = gram[np.ix_(at, at)]
            best = np.linalg.solve(part + np.eye(len(at)) * 1e-10, target[at])
            if best.min(initial=1) > 0:
                x[:] = 0
                x[at] = best
                break
            below = best <= 0
            share = np.min(x[at][below] / np.maximum(x[at][below] - best[below], 1e-300))
            x[at] += share * (best - x[at])
            gone = at[below & (x[at] <= slack)]
            free[gone if len(gone) else at[np.argmin(np.where(below, x[at], np.inf))]] = False
            x[~free] = 0
    return x


def _planned(lengths: np.ndarray, window: int) -> tuple[list[list[int]], list[int]]:
    """Whole documents in sequences by the rounded counts of least squares, and the documents that are left."""
    steps = min(STEPS, window)
    parts, counts, gram = combinations(steps)
    step = -(-lengths * steps // window)  # 1 to steps
    have = np.bincount(step - 1, minlength=steps)
    repeats = nonnegative(gram, counts.T @ have)
    waiting = [at.tolist() for at in np.split(np.argsort(step, kind="stable"), np.cumsum(have)[:-1])]
    sequences: list[list[int]] = []
    for k in np.argsort(-repeats, kind="stable"):
        wanted = round(repeats[k])
        if wanted == 0:
            break
        used, times = np.unique(parts[k][parts[k] > 0] - 1, return_counts=True)
        n = min(wanted, *(len(waiting[u]) // t for u, t in zip(used, times, strict=True)))
        taken = [waiting[u][len(waiting[u]) - n * t :] for u, t in zip(used, times, strict=True)]
        for u, t in zip(used, times, strict=True):
            del waiting[u][len(waiting[u]) - n * t :]
        for i in range(n):
            sequences.append([d for held, t in zip(taken, times, strict=True) for d in held[i * t : (i + 1) * t]])
    return sequences, [d for held in waiting for d in held]


def _greedy(rest: list[int], lengths: np.ndarray, window: int) -> list[list[int]]:
    """Sequences of whole documents: the largest that is left, then always the largest that fits."""
    order = sorted(rest, key=lambda d: (lengths[d], -d))
    sizes = [int(lengths[d]) for d in order]
    out = []
    while order:
        room, chosen = window, []
        while (i := bisect_right(sizes, room)) > 0:
            room -= sizes.pop(i - 1)
            chosen.append(order.pop(i - 1))
        out.append(chosen)
    return out


def pack_lengths(tokens: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Pieces (document, start, length, sequence, offset) of documents of these many tokens; sequences are numbered from 0."""
    tokens = np.asarray(tokens, np.int64)
    whole, left = tokens // window, tokens % window
    n_whole = int(whole.sum())
    owner = np.repeat(np.arange(len(tokens)), whole)
    first = np.arange(n_whole) - np.repeat(np.cumsum(whole) - whole, whole)
    doc, start, length = [owner], [first * window], [np.full(n_whole, window)]
    sequence, offset = [np.arange(n_whole)], [np.zeros(n_whole, np.int64)]
    docs = np.flatnonzero(left)
    if len(docs):
        sizes = left[docs]
        sequences, rest = _planned(sizes, window)
        sequences += _greedy(rest, sizes, window)
        filled = np.array([sizes[s].sum() for s in sequences])
        order = np.argsort(-filled, kind="stable")
        full = int(sizes.sum()) // window
        keep, apart = order[:full], order[full:]
        pieces = [(d, 0, int(sizes[d]), k) for k, s in enumerate(keep) for d in sequences[s]]
        # what is taken apart lies in one row, and so do the gaps; where both rows are cut, pieces end
        pool = [d for s in apart for d in sequences[s]]
        gaps = window - filled[keep]
        over = int(sizes[pool].sum() - gaps.sum())
        powers = [1 << b for b in range(over.bit_length() - 1, -1, -1) if over >> b & 1]
        room = np.concatenate([gaps, np.array(powers, np.int64)]).astype(np.int64)
        room_ends, pool_ends = np.cumsum(room), np.cumsum(sizes[pool])
        cuts = np.union1d(room_ends, pool_ends)
        cuts = cuts[cuts > 0]
        begins = np.concatenate([[0], cuts[:-1]]).astype(np.int64)
        at = np.searchsorted(pool_ends, begins, "right")
        into = np.searchsorted(room_ends, begins, "right")
        pieces += [(pool[p], int(b - (pool_ends[p] - sizes[pool[p]])), int(e - b), int(k)) for p, b, e, k in zip(at, begins, cuts, into, strict=True)]
        d, s, n, k = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        by = np.argsort(k, kind="stable")
        d, s, n, k = d[by], s[by], n[by], k[by]
        ends = np.cumsum(n)
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        base = np.repeat((ends - n)[new], np.diff(np.append(new, len(k))))
        doc.append(docs[d])
        start.append(whole[docs[d]] * window + s)
        length.append(n)
        sequence.append(n_whole + k)
        offset.append(ends - n - base)
    return tuple(np.concatenate(x).astype(np.int64) for x in (doc, start, length, sequence, offset))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """A row for each piece: the document's id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids.

    start and offset count tokens from the beginning of the document and of the sequence; ids_crc32 is that of the ids as unsigned
    32-bit little-endian integers. Sequences hold no padding: shorter ones than the window have a power of two of tokens.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema[doc_id].dataType.simpleString()
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = ", ".join([f"`{doc_id}` {kind}", *(f"{c} bigint" for c in longs), *(["ids array<int>"] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, numbered = byte_level(path), TaskContext.get().partitionId() << _TASK_BITS
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            nonlocal numbered
            keys = pa.chunked_array([k for k, _, _ in held]).combine_chunks()
            ids, sizes = np.concatenate([i for _, i, _ in held]), np.concatenate([n for _, _, n in held])
            held.clear()
            doc, start, length, sequence, offset = pack_lengths(sizes, window)
            begin = (np.cumsum(sizes) - sizes)[doc] + start
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * begin).tolist(), (4 * (begin + length)).tolist(), strict=True)]
            columns = [keys.take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, sizes[doc], numbered + sequence, offset))]
            if with_ids:
                ends = np.cumsum(length)
                at = np.arange(int(ends[-1])) + np.repeat(begin - (ends - length), length)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids[at].astype(np.int32))))
            numbered += int(sequence.max()) + 1
            return pa.RecordBatch.from_arrays(columns, names=[doc_id, *longs, *(["ids"] if with_ids else [])])

        tokens = 0
        for batch in batches:
            for part in slices(batch, text):
                texts = [b.decode("utf-8", "replace") for b in byte_texts(part.column(text))]
                ids, sizes = flat([[*found, end] for found in library.encode(texts)])
                held.append((part.column(doc_id), ids.astype("<u4"), sizes))
                tokens += len(ids)
                if tokens >= GROUP_TOKENS:
                    yield packed()
                    tokens = 0
        if held:
            yield packed()
        release()

    return docs.select(doc_id, text).mapInArrow(run, schema)
