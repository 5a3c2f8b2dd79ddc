"""Suffix-array dedup: bytes of strings of `LENGTH` bytes that also start in a document of a smaller id are removed.

Every string of LENGTH bytes (a window) has an anchor: its leftmost substring of `ANCHOR` bytes of the least hash. Equal
windows have equal anchors at equal places, so windows can only repeat among occurrences of one anchor. Consecutive windows of
one anchor form a record: the bytes that its windows span, the anchor's included. Hashes bring records together; which of them
are equal, and which have one anchor, their bytes decide.

1. Documents are packed into groups by a hash, so many that a group has about GROUP_BYTES of text. A pack is an Arrow stream of
   all its columns, compressed and checkpointed: later steps read packs, not documents.
2. Each group sends the hashes of its anchors, a few bytes each, to buckets by hash. A bucket answers with those that stand
   in two documents or more, and says which of them are hot: more than about HOT_RECORDS different records have them.
3. Each group sends its distinct records of the other shared anchors with their least id. A bucket merges equal records. Where an
   anchor has several different records, their texts (the anchor as one symbol) form a generalised text; its suffix array, built
   by the linear grouping of suffix_array.py, brings equal windows together, and each such run of suffixes has its least id.
   The windows of hot anchors are sent as records of their own, with the whole window as their anchor: they are spread by all
   their bytes, need no sorting, and a bucket holds no more of one of them than a record from each group.
4. Each group marks the windows of its documents for which a smaller id is known, and cuts the bytes they cover.

A passage that many documents share costs a bucket one record from each group and variant, however many documents repeat it.
Documents of null id are neither compared nor cut; null and empty texts have 0 bytes and nothing to remove; rows that repeat an
id are one document's, and each is cut by what smaller ids have. Very long texts are read in overlapping pieces. Of equal texts
the smallest id keeps its bytes. An empty table gives no rows. Other columns pass through under any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_texts, cut, release, total_bytes
from tidemark.llm.suffix_array import suffix_array, suffix_arrays

LENGTH = 50
ANCHOR = 32
#: Bytes of text in a group of documents.
GROUP_BYTES = 6 << 20
#: Bytes that numpy handles at once; places in a piece take 24 bits of a 64-bit word.
PIECE_BYTES = 1 << 20
#: An anchor is hot if its groups have more different records than this by their own counts, which start at MANY_RECORDS.
HOT_RECORDS, MANY_RECORDS = 3000, 8
#: The longest text that goes through the columnar construction, and the cells of one call.
LANE_SYMBOLS, LANE_CELLS = 1500, 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Shape:
    length: int = LENGTH
    anchor: int = ANCHOR

    @property
    def window(self) -> int:
        """Anchors that a window could have."""
        return self.length - self.anchor + 1

    @property
    def side(self) -> int:
        """Bytes that a record may have on either side of its anchor."""
        return self.length - self.anchor

    @property
    def whole(self) -> "Shape":
        """With whole windows as anchors."""
        return Shape(self.length, self.length)

    @property
    def wide(self) -> int:
        """The most bytes of a record."""
        return 2 * self.side + self.anchor

    @property
    def words(self) -> int:
        """64-bit words that hold a record: two lengths and its bytes."""
        return -(-(self.wide + 2) // 8)

    def inside(self, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Of records with so many bytes before and behind their anchors: which of the `wide` bytes they have."""
        k, j = np.arange(self.side + 1), np.arange(self.wide)
        every = (j >= self.side - k[:, None, None]) & (j < self.side + self.anchor + k[None, :, None])
        return every.reshape(-1, self.wide)[before * (self.side + 1) + behind]


def _gram_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive bytes, put together from those of powers of two."""
    base = 0x100000001B3
    part, size, out, have = x.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if n & size:
            out = part if out is None else out[: len(x) - have - size + 1] * np.uint64(pow(base, size, 1 << 64)) + part[have : have + len(x) - have - size + 1]
            have += size
        if have == n:
            return _mix(out)
        part = part[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
        size *= 2


@dataclass
class Records:
    """Of one piece: first and last window start, place of the anchor, its hash, and the document of each record."""

    text: np.ndarray
    begin: np.ndarray
    last: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray


def pieces_of(raws: list[bytes], shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, start of each document's part, its document, its place in the document): documents joined up to about
    PIECE_BYTES, longer ones cut with an overlap that keeps each window in one piece alone."""
    parts: list[tuple[bytes, int, int]] = []
    size = 0

    def done() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
        return np.frombuffer(b"".join(p[0] for p in parts), np.uint8), starts, np.array([p[1] for p in parts]), np.array([p[2] for p in parts])

    for k, raw in enumerate(raws):
        if len(raw) < shape.length:
            continue
        for a in range(0, len(raw) - shape.length + 1, PIECE_BYTES):
            part = raw[a : a + PIECE_BYTES + shape.length - 1]
            if parts and size + len(part) > PIECE_BYTES:
                yield done()
                parts, size = [], 0
            parts.append((part, k, a))
            size += len(part)
    if parts:
        yield done()


def records_of(text: np.ndarray, starts: np.ndarray, docs: np.ndarray, shape: Shape) -> Records:
    grams = _gram_hashes(text, shape.anchor)
    place = np.uint64(0xFFFFFF)
    least = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    w, size = shape.window, 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    ends = np.append(starts[1:], len(text))
    inside = np.zeros(len(least) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.minimum(ends - shape.length + 1, len(least)), -1)
    valid = np.cumsum(inside[:-1]) > 0
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    new[starts[starts < len(new)]] = True
    begin = np.flatnonzero(new & valid)
    stop = np.ones(len(least), bool)
    stop[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    at = (least[begin] & place).astype(np.int64)
    return Records(text, begin, last, at, grams[at], docs[np.searchsorted(starts, begin, "right") - 1])


def contexts_of(r: Records, pick: np.ndarray, shape: Shape, out: np.ndarray | None = None) -> np.ndarray:
    """Rows of bytes, a multiple of 8: the numbers of bytes before and behind the anchor, then the bytes of the record; the
    anchor always stands at the same place, and what the record doesn't have is zero."""
    begin, last, at = r.begin[pick], r.last[pick], r.at[pick]
    before, behind = at - begin, last + shape.length - at - shape.anchor
    out = np.zeros((len(at), shape.words * 8), np.uint8) if out is None else out
    out[:, 0], out[:, 1] = before, behind
    border = np.zeros(shape.side, np.uint8)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([border, r.text, border]), shape.wide)
    for a in range(0, len(at), 1 << 16):
        rows = slice(a, a + (1 << 16))
        out[rows, 2 : 2 + shape.wide] = around[at[rows]] * shape.inside(before[rows], behind[rows])
    return out


def _squeeze_contexts(contexts: np.ndarray, shape: Shape) -> bytes:
    """contexts_of() as compressed bytes: both lengths of each record, then its bytes in order, without the zeros."""
    parts = [contexts[:, :2].T.tobytes()]
    for a in range(0, len(contexts), 1 << 16):
        c = contexts[a : a + (1 << 16)]
        parts.append(c[:, 2 : 2 + shape.wide][shape.inside(c[:, 0].astype(np.int64), c[:, 1].astype(np.int64))].tobytes())
    flat = b"".join(parts)
    return len(flat).to_bytes(8, "little") + _CODEC.compress(flat, asbytes=True)


def _expand_contexts(raw: bytes, out: np.ndarray, shape: Shape) -> None:
    """Fills rows of zeros with what _squeeze_contexts() made of them."""
    n = len(out)
    flat = np.frombuffer(_CODEC.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True), np.uint8)
    out[:, :2] = flat[: 2 * n].reshape(2, n).T
    at = 2 * n
    for a in range(0, n, 1 << 16):
        rows = out[a : a + (1 << 16)]
        inside = shape.inside(rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64))
        size = int(inside.sum())
        rows[:, 2 : 2 + shape.wide][inside] = flat[at : at + size]
        at += size


def _keys(start: np.ndarray, words: np.ndarray) -> np.ndarray:
    h = start.astype(np.uint64)
    for j in range(words.shape[1]):
        h = _mix(h * _ODD + words[:, j])
    return h


def in_order(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order that has equal rows of bytes of one code together, codes rising; whether each row in it is a new one).

    The order depends on the rows alone. They are sorted by a hash, or by their bytes should two rows have one hash.
    """
    words = rows.view(np.uint64)
    keys = _keys(codes, words)
    by = np.lexsort((keys, codes))
    fresh, same = np.ones(len(by), bool), np.ones(len(by), bool)
    fresh[1:] = (codes[by][1:] != codes[by][:-1]) | (keys[by][1:] != keys[by][:-1])
    for j in range(words.shape[1]):
        column = words[by, j]
        same[1:] &= column[1:] == column[:-1]
    if (~fresh & ~same).any():
        by = np.lexsort((*words.T, codes))
        fresh[1:] = (codes[by][1:] != codes[by][:-1]) | (words[by][1:] != words[by][:-1]).any(axis=1)
    return by, fresh


def anchors_of(contexts: np.ndarray, shape: Shape) -> np.ndarray:
    """The bytes of each record's anchor, in rows of a multiple of 8."""
    out = np.zeros((len(contexts), -(-shape.anchor // 8) * 8), np.uint8)
    out[:, : shape.anchor] = contexts[:, 2 + shape.side : 2 + shape.side + shape.anchor]
    return out


def symbols_of(context: np.ndarray, shape: Shape) -> np.ndarray:
    """A record as text: bytes count from 2, the anchor is one symbol above them."""
    before, behind = int(context[0]), int(context[1])
    middle = 2 + shape.side
    return np.concatenate([context[middle - before : middle].astype(np.int64) + 2, [258], context[middle + shape.anchor : middle + shape.anchor + behind].astype(np.int64) + 2])


def earlier_windows(codes: np.ndarray, contexts: np.ndarray, ids: np.ndarray, shape: Shape) -> np.ndarray:
    """Of distinct records, sorted by the codes of their anchors, with their least ids: a bit for each window that a smaller id has."""
    out = np.zeros(len(ids), np.uint32)
    if not len(ids):
        return out
    anchors = anchors_of(contexts, shape)
    fresh = np.ones(len(codes), bool)
    fresh[1:] = codes[1:] != codes[:-1]
    if (~fresh[1:] & (anchors[1:] != anchors[:-1]).any(axis=1)).any():  # one code for two anchors
        by, fresh = in_order(codes, anchors)
    else:
        by = np.arange(len(codes))
    group = np.cumsum(fresh) - 1
    keep = np.flatnonzero(_may_meet(group, contexts[by], shape))
    by, group = by[keep], group[keep]
    fresh = np.ones(len(by), bool)
    fresh[1:] = group[1:] != group[:-1]
    out[by] = _earlier(fresh, contexts[by], ids[by], shape)
    return out


def _may_meet(group: np.ndarray, contexts: np.ndarray, shape: Shape) -> np.ndarray:
    """Whether a record can have a window in common with another one of its anchor: one half of its sides' bytes next to the
    anchor stands in another one too, as every window holds all of either half."""
    half, middle = shape.side // 2, 2 + shape.side
    out = np.zeros(len(group), bool)
    for col, a in ((0, middle - half), (1, middle + shape.anchor)):
        key = group.astype(np.uint64)
        for j in range(half):
            key = _mix(key * _ODD + contexts[:, a + j].astype(np.uint64) + np.uint64(1))
        has = np.flatnonzero(contexts[:, col] >= half)
        by = has[np.argsort(key[has], kind="stable")]
        same = key[by][1:] == key[by][:-1]
        out[by[1:][same]] = True
        out[by[:-1][same]] = True
    return out


def _earlier(fresh: np.ndarray, contexts: np.ndarray, ids: np.ndarray, shape: Shape) -> np.ndarray:
    """earlier_windows() of records of which `fresh` begins each anchor's."""
    out = np.zeros(len(ids), np.uint32)
    first = np.flatnonzero(fresh)
    if not len(first):
        return out
    sizes = np.diff(np.append(first, len(fresh)))
    lengths = contexts[:, 0].astype(np.int64) + contexts[:, 1] + 2  # with the anchor and a mark behind
    totals = np.add.reduceat(lengths, first)
    several = np.flatnonzero(sizes > 1)
    several = several[np.argsort(totals[several], kind="stable")]
    at = 0
    while at < len(several):
        depth = int(totals[several[at]])
        if depth > LANE_SYMBOLS:
            for g in several[at:]:
                _one(np.arange(first[g], first[g] + sizes[g]), contexts, ids, shape, out)
            break
        end = at
        while end < len(several) and totals[several[end]] <= LANE_SYMBOLS and int(totals[several[end]]) * (end - at + 1) <= LANE_CELLS and totals[several[end]] <= depth * 1.6 + 8:
            end += 1
        end = max(end, at + 1)
        _many(several[at:end], first, sizes, lengths, contexts, ids, shape, out)
        at = end
    return out


def _mark(rank_rows: np.ndarray, rank_window: np.ndarray, texts: np.ndarray, group: np.ndarray, ids: np.ndarray, out: np.ndarray) -> None:
    """Windows in the order of their suffixes: their record, number, symbols and text; equal neighbours are a run."""
    if not len(rank_rows):
        return
    fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (texts[1:] != texts[:-1]).any(axis=1)])
    runs = np.flatnonzero(fresh)
    least = np.minimum.reduceat(ids[rank_rows], runs)[np.cumsum(fresh) - 1]
    hit = least < ids[rank_rows]
    np.bitwise_or.at(out, rank_rows[hit], (np.uint32(1) << rank_window[hit].astype(np.uint32)))


def _one(rows: np.ndarray, contexts: np.ndarray, ids: np.ndarray, shape: Shape, out: np.ndarray) -> None:
    parts = [np.append(symbols_of(contexts[i], shape), 1) for i in rows]
    text = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    order = suffix_array(text)
    row = np.searchsorted(starts, order, "right") - 1
    window = order - starts[row]
    fits = window + shape.window <= sizes[row] - 1
    order, row, window = order[fits], row[fits], window[fits]
    _mark(rows[row], window, text[order[:, None] + np.arange(shape.window)], np.zeros(len(row)), ids, out)


def _many(groups: np.ndarray, first: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, contexts: np.ndarray, ids: np.ndarray, shape: Shape, out: np.ndarray) -> None:
    rows = np.concatenate([np.arange(first[g], first[g] + sizes[g]) for g in groups])
    lane = np.repeat(np.arange(len(groups)), sizes[groups])
    own = lengths[rows]
    run = np.cumsum(own) - own
    base = run - np.repeat(run[np.cumsum(sizes[groups]) - sizes[groups]], sizes[groups])  # of each record in its lane
    totals = np.bincount(lane, own, len(groups)).astype(np.int64)
    depth = int(totals.max())
    cells = np.zeros((depth, len(groups)), np.int16)
    where = np.full((depth, len(groups)), -1, np.int32)  # which record's window starts here, if one does
    before, behind = contexts[rows, 0].astype(np.int64), contexts[rows, 1].astype(np.int64)
    cells[base + before, lane] = 258
    for j in range(shape.side):
        has = before > j
        cells[base[has] + before[has] - 1 - j, lane[has]] = contexts[rows[has], 1 + shape.side - j].astype(np.int16) + 2
        has = behind > j
        cells[base[has] + before[has] + 1 + j, lane[has]] = contexts[rows[has], 2 + shape.side + shape.anchor + j].astype(np.int16) + 2
    inner = base + own - 1
    cells[inner, lane] = 1
    cells[totals - 1, np.arange(len(groups))] = 0  # the last mark of a lane ends it
    for j in range(shape.window):
        has = j + shape.window <= own - 1
        where[base[has] + j, lane[has]] = np.flatnonzero(has)
    order = suffix_arrays(cells, totals)
    place, at_lane = order.T.reshape(-1).astype(np.int64), np.repeat(np.arange(len(groups)), depth)
    good = place >= 0
    place, at_lane = place[good], at_lane[good]
    record = where[place, at_lane]
    good = record >= 0
    place, at_lane, record = place[good], at_lane[good], record[good]
    flat = cells.T.reshape(-1)
    texts = flat[(at_lane * depth + place)[:, None] + np.arange(shape.window)]
    _mark(rows[record], place - base[record], texts, at_lane, ids, out)


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> pa.Table:
    with pa.ipc.open_stream(raw) as stream:
        return stream.read_all()


def _documents(pack: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """(texts, ids); documents without an id have empty texts here."""
    null = np.asarray(pack.column("id").is_null())
    raws = [b"" if n else r for r, n in zip(byte_texts(pack.column("raw")), null, strict=True)]
    return raws, np.asarray(pack.column("id").fill_null(0)).astype(np.int64)


_CODEC = pa.Codec("zstd", compression_level=1)


def _squeeze(values: np.ndarray, rising: bool = False) -> bytes:
    """An array as compressed bytes: first its number of items, then its bytes by place; rising ones as differences."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()
    return len(values).to_bytes(4, "little") + _CODEC.compress(planes, asbytes=True)


def _expand(raw: bytes, kind: type, rising: bool = False) -> np.ndarray:
    n, size = int.from_bytes(raw[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(_CODEC.decompress(raw[4:], n * size, asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if rising else values


def _split(code: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, the rest of the hash) of anchors."""
    return ((code >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _runs(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, start, end) of the runs of equal keys."""
    if not len(keys):
        return []
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return list(zip(keys[at].tolist(), at.tolist(), np.append(at[1:], len(keys)).tolist(), strict=True))


def windows_of(r: Records, hot: np.ndarray, shape: Shape, buckets: int) -> Records:
    """The windows of the records of hot anchors, each its own anchor."""
    pick, _ = _matching(r, hot, buckets)
    sizes = r.last[pick] - r.begin[pick] + 1
    begin = np.repeat(r.begin[pick] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return Records(r.text, begin, begin, begin, _gram_hashes(r.text, shape.length)[begin] if len(begin) else np.empty(0, np.uint64), np.repeat(r.doc[pick], sizes))


def _all_records(raws: list[bytes], shape: Shape) -> list[Records]:
    return [records_of(text, starts, docs, shape) for text, starts, docs, _ in pieces_of(raws, shape)]


def _different(held: list[Records], codes: np.ndarray, shape: Shape, buckets: int) -> np.ndarray:
    """How many different records each of the codes has; they are sorted."""
    found, rows = [np.empty(0, np.uint64)], [np.empty((0, shape.words * 8), np.uint8)]
    for r in held:
        pick, code = _matching(r, codes, buckets)
        found.append(code)
        rows.append(contexts_of(r, pick, shape))
    code = np.concatenate(found)
    by, fresh = in_order(code, np.concatenate(rows))
    return np.bincount(np.searchsorted(codes, code[by][fresh]), minlength=len(codes)).astype(np.uint32)


def _anchors(group: int, held: list[Records], ids: np.ndarray, shape: Shape, buckets: int) -> pa.RecordBatch:
    """The codes of the group's anchors by bucket: those in one document, in several, and those with many records, with their number."""
    code = np.concatenate([np.empty(0, np.uint64), *(r.anchor for r in held)])
    owner = np.concatenate([np.empty(0, np.int64), *(ids[r.doc] for r in held)])
    bucket, low = _split(code, buckets)
    code = bucket.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
    by = np.argsort(code, kind="stable")
    code, owner = code[by], owner[by]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
    twice = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first) if len(first) else np.empty(0, bool)
    times = np.diff(np.append(first, len(code)))
    code = code[first]
    n = np.zeros(len(code), np.uint32)
    if (often := np.flatnonzero(times >= MANY_RECORDS)).size:
        n[often] = _different(held, code[often], shape, buckets)
    many = n >= MANY_RECORDS
    low = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    rows = [(b, _squeeze(low[s:e][~twice[s:e]], True), _squeeze(low[s:e][twice[s:e]], True), _squeeze(low[s:e][many[s:e]], True), _squeeze(n[s:e][many[s:e]])) for b, s, e in _runs(code >> np.uint64(32))]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate([pa.int32(), *[pa.binary()] * 4])]
    return pa.RecordBatch.from_arrays([columns[0], pa.array([group] * len(rows), pa.int32()), *columns[1:]], names=["bucket", "g", "once", "twice", "many", "n"])


_ANCHORS = "bucket int, g int, once binary, twice binary, many binary, n binary"


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket's anchors those that stand in two documents, for each group that has them; hot ones apart."""
    groups = np.asarray(table.column("g"))
    once, twice, many = ([_expand(b, np.uint32, True) for b in table.column(c).to_pylist()] for c in ("once", "twice", "many"))
    every = np.sort(np.concatenate([*once, *twice]))
    shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *twice]))
    records = np.searchsorted(every, shared, "right") - np.searchsorted(every, shared)  # at least one in each group
    counted = np.concatenate(many)
    at = np.minimum(np.searchsorted(shared, counted), max(len(shared) - 1, 0))
    told = shared[at] == counted if len(shared) else np.zeros(len(counted), bool)
    np.add.at(records, at[told], np.concatenate([_expand(b, np.uint32) for b in table.column("n").to_pylist()])[told].astype(np.int64) - 1)
    hot = shared[records > HOT_RECORDS]
    shared = shared[records <= HOT_RECORDS]
    out = []
    for g, a, b in zip(groups.tolist(), once, twice, strict=True):
        own = np.sort(np.concatenate([a, b]))
        cool, warm = own[np.isin(own, shared, assume_unique=True)], own[np.isin(own, hot, assume_unique=True)]
        if len(cool) or len(warm):
            out.append((g, _squeeze(cool, True), _squeeze(warm, True) if len(warm) else None))
    bucket = table.column("bucket")[0].as_py() if len(groups) else 0
    return pa.table({"g": pa.array([r[0] for r in out], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "low": pa.array([r[1] for r in out], pa.binary()), "hot": pa.array([r[2] for r in out], pa.binary())})


_SHARED = "g int, bucket int, low binary, hot binary"


def _codes(table: pa.Table, low: str = "low") -> np.ndarray:
    parts = [_expand(b, np.uint32, True).astype(np.uint64) | np.uint64(k << 32) for k, b in zip(table.column("bucket").to_pylist(), table.column(low).to_pylist(), strict=True) if b is not None]
    return np.unique(np.concatenate([np.empty(0, np.uint64), *parts]))


def _matching(r: Records, codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(records whose anchor is among the codes, their codes)."""
    bucket, low = _split(r.anchor, buckets)
    code = bucket.astype(np.uint64) << np.uint64(32) | low
    at = np.searchsorted(codes, code)
    at[at == len(codes)] = 0
    pick = np.flatnonzero(codes[at] == code) if len(codes) else np.empty(0, np.int64)
    return pick, code[pick]


def _contexts(group: int, held: list[Records], ids: np.ndarray, codes: np.ndarray, shape: Shape, buckets: int, kind: int) -> pa.Table:
    """The group's distinct records of shared anchors, with their least ids, by bucket."""
    contexts, all_codes, owners = [np.empty((0, shape.words * 8), np.uint8)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]

    def add(code: np.ndarray, c: np.ndarray, own: np.ndarray) -> None:
        by, fresh = in_order(code, c)
        at = np.flatnonzero(fresh)
        all_codes.append(code[by[at]])
        contexts.append(c[by[at]])
        owners.append(np.minimum.reduceat(own[by], at) if len(at) else own)

    for r in held if len(codes) else ():
        pick, code = _matching(r, codes, buckets)
        add(code, contexts_of(r, pick, shape), ids[r.doc[pick]])
    found = [np.concatenate(x) for x in (all_codes, contexts, owners)]
    all_codes, contexts, owners = [], [], []
    add(*found)
    code, context, own = all_codes[0], contexts[0], owners[0]
    low = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    rows = [(b, _squeeze(low[s:e], True), _squeeze_contexts(context[s:e], shape), _squeeze(own[s:e])) for b, s, e in _runs(code >> np.uint64(32))]
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int32(), pa.binary(), pa.binary(), pa.binary()])]
    return pa.table([pa.array([kind] * len(rows), pa.int32()), columns[0], pa.array([group] * len(rows), pa.int32()), *columns[1:]], names=["kind", "bucket", "g", "low", "context", "own"])


_CONTEXTS = "kind int, bucket int, g int, low binary, context binary, own binary"


def _of_hot(group: int, held: list[Records], ids: np.ndarray, hot: np.ndarray, shape: Shape, buckets: int) -> pa.Table:
    """The group's distinct windows of hot anchors, as records of whole windows."""
    windows = [windows_of(r, hot, shape, buckets) for r in held]
    codes = [np.empty(0, np.uint64)]
    for w in windows:
        bucket, low = _split(w.anchor, buckets)
        codes.append(np.unique(bucket.astype(np.uint64) << np.uint64(32) | low))
    return _contexts(group, windows, ids, np.unique(np.concatenate(codes)), shape.whole, buckets, _WINDOWS)


def _resolved(table: pa.Table, shape: Shape, kind: int) -> pa.Table:
    """Least id and earlier windows of each record, for each group that sent it, in the order in which it did."""
    groups = table.column("g").to_pylist()
    bucket = table.column("bucket")[0].as_py() if groups else 0
    lows = [_expand(b, np.uint32, True) for b in table.column("low").to_pylist()]
    low = np.concatenate(lows)
    context, filled = np.zeros((len(low), shape.words * 8), np.uint8), 0
    for b, part in zip(table.column("context"), lows, strict=True):
        _expand_contexts(b.as_py(), context[filled : filled + len(part)], shape)
        filled += len(part)
    own = np.concatenate([_expand(b, np.int64) for b in table.column("own").to_pylist()])
    code = low.astype(np.uint64) | np.uint64(bucket << 32)
    by, first = in_order(code, context)
    at = np.flatnonzero(first)
    least = np.minimum.reduceat(own[by], at)
    bits = earlier_windows(code[by][at], context[by[at]], least, shape)
    which = np.empty(len(by), np.int64)
    which[by] = np.cumsum(first) - 1
    out, a = [], 0
    for g, part in zip(groups, lows, strict=True):
        w = which[a : a + len(part)]
        out.append((g, _squeeze(part, True), _squeeze(least[w]), _squeeze(bits[w])))
        a += len(part)
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
    names = ["g", "kind", "bucket", "low", "least", "bits"]
    return pa.table([columns[0], pa.array([kind] * len(out), pa.int32()), pa.array([bucket] * len(out), pa.int32()), *columns[1:]], names=names)


_RESOLVED = "g int, kind int, bucket int, low binary, least binary, bits binary"
#: What a row is about, or tells a group: hot anchors, records of other anchors, windows of hot ones.
_HOT, _RECORDS, _WINDOWS = 0, 1, 2


def _covered(change: list[np.ndarray], held: list[Records], ids: np.ndarray, resolved: pa.Table, shape: Shape, buckets: int) -> None:
    """Adds to `change` (one array for each piece) where windows that a smaller id has begin and end."""
    codes = _codes(resolved)
    if not len(codes):
        return
    resolved = resolved.sort_by("bucket")  # the order of the records' codes, in which the group sent them
    join = lambda name, kind: np.concatenate([np.empty(0, kind), *(_expand(b, kind) for b in resolved.column(name).to_pylist())])
    least, bits = join("least", np.int64), join("bits", np.uint32)
    found = [_matching(r, codes, buckets) for r in held]
    contexts, filled = np.zeros((sum(len(pick) for pick, _ in found), shape.words * 8), np.uint8), 0
    for r, (pick, _) in zip(held, found, strict=True):
        contexts_of(r, pick, shape, contexts[filled : filled + len(pick)])
        filled += len(pick)
    by, first = in_order(np.concatenate([code for _, code in found]), contexts)
    del contexts
    if int(first.sum()) != len(least):
        raise RuntimeError("a group's records differ from those that it sent")
    number = np.empty(len(by), np.int64)
    number[by] = np.cumsum(first) - 1
    done = 0
    for to, r, (pick, _) in zip(change, held, found, strict=True):
        at = number[done : done + len(pick)]
        done += len(pick)
        whole = ids[r.doc[pick]] > least[at]
        np.add.at(to, r.begin[pick[whole]], 1)
        np.add.at(to, r.last[pick[whole]] + shape.length, -1)
        some = ~whole & (bits[at] > 0)
        rows, b = pick[some], bits[at[some]]
        for j in range(shape.window):
            has = (b >> np.uint32(j)) & np.uint32(1) > 0
            has &= r.begin[rows] + j <= r.last[rows]
            np.add.at(to, r.begin[rows[has]] + j, 1)
            np.add.at(to, r.begin[rows[has]] + j + shape.length, -1)


def _of_kind(told: pa.Table, kind: int) -> pa.Table:
    return told.filter(pa.array(np.asarray(told.column("kind"), np.int32) == kind))


def spans_of(raws: list[bytes], ids: np.ndarray, told: pa.Table, shape: Shape, buckets: int) -> list[np.ndarray]:
    """Removed runs (start, end) of each document, in order."""
    found: list[list[np.ndarray]] = [[] for _ in raws]
    if told.num_rows:
        pieces = [*pieces_of(raws, shape)]
        held = [records_of(text, starts, docs, shape) for text, starts, docs, _ in pieces]
        change = [np.zeros(len(text) + 1, np.int32) for text, *_ in pieces]
        _covered(change, held, ids, _of_kind(told, _RECORDS), shape, buckets)
        windows = _of_kind(told, _WINDOWS)
        if windows.num_rows:
            hot = _codes(_of_kind(told, _HOT))
            _covered(change, [windows_of(r, hot, shape, buckets) for r in held], ids, windows, shape.whole, buckets)
        for (text, starts, docs, offsets), to in zip(pieces, change, strict=True):
            covered = np.cumsum(to[:-1]) > 0
            edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
            a, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            part = np.searchsorted(starts, a, "right") - 1
            # a run that goes from one document into the next is cut at the border
            ends = np.append(starts[1:], len(text))
            while (over := e > ends[part]).any():
                more = np.flatnonzero(over)
                a, e, part = np.concatenate([a, ends[part[more]]]), np.concatenate([np.where(over, ends[part], e), e[more]]), np.concatenate([part, part[more] + 1])
            by = np.argsort(part, kind="stable")
            for p, s, t in _runs(part[by]):
                found[docs[p]].append(np.stack([a[by[s:t]], e[by[s:t]]], axis=1) - starts[p] + offsets[p])
    out = []
    for runs in found:
        both = np.concatenate([np.empty((0, 2), np.int64), *runs])
        both = both[np.argsort(both[:, 0], kind="stable")]
        if len(both):
            high = np.maximum.accumulate(both[:, 1])
            new = np.concatenate([[True], both[1:, 0] > high[:-1]])
            both = np.stack([both[new, 0], high[np.append(np.flatnonzero(new)[1:] - 1, len(both) - 1)]], axis=1)
        out.append(both)
    return out


def _scan(docs: DataFrame, key: str, text: str, finish: Callable[[pa.Table | None, list[bytes], list[np.ndarray]], pa.Table], schema: str, shape: Shape) -> DataFrame:
    """finish() makes the rows of a group: its columns but the text under their numbers, its texts, the removed runs of each."""
    columns = docs.columns
    # A group's anchors are spread over as many buckets as there are groups, so both grow with the root of very large inputs.
    total = total_bytes(docs, text)
    groups = max(1, -(-total // max(GROUP_BYTES, min(8 * GROUP_BYTES, int(5 * total**0.5)))))
    buckets = groups
    # Neither rows of one id nor equal rows need to stand in one group.
    g = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text), F.spark_partition_id()), F.lit(groups)).cast("int")
    spread = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns) if c != text), F.col(key).cast("bigint").alias("id"), F.col(text).cast("binary").alias("raw"), g.alias("g"))

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"g": table.column("g")[:1].cast(pa.int32()), "pack": pa.array([_pack(table.drop_columns(["g"]))], pa.binary())})

    packs = cut(spread.groupBy("g").applyInArrow(pack, "g int, pack binary"))

    def opened(pack: pa.Array) -> tuple[list[Records], np.ndarray]:
        raws, ids = _documents(_unpack(pack.as_py()))
        return _all_records(raws, shape), ids

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, raw in zip(batch.column("g").to_pylist(), batch.column("pack"), strict=True):
                yield _anchors(group, *opened(raw), shape, buckets)
                release()

    shared = cut(packs.mapInArrow(anchors, _ANCHORS).groupBy("bucket").applyInArrow(lambda table: _shared(table), _SHARED))

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _contexts(0, [], np.empty(0, np.int64), np.empty(0, np.uint64), shape, buckets, _RECORDS)
        group, (held, ids) = left.column("g")[0].as_py(), opened(left.column("pack")[0])
        out, hot = _contexts(group, held, ids, _codes(right), shape, buckets, _RECORDS), _codes(right, "hot")
        out = pa.concat_tables([out, _of_hot(group, held, ids, hot, shape, buckets)]) if len(hot) else out
        del held
        release()
        return out

    def resolved(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py() if table.num_rows else _RECORDS
        out = _resolved(table, shape if kind == _RECORDS else shape.whole, kind)
        release()
        return out

    sent = packs.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(contexts, _CONTEXTS)
    told = cut(sent.groupBy("kind", "bucket").applyInArrow(resolved, _RESOLVED))
    hot = shared.where("hot IS NOT NULL").selectExpr("g", f"{_HOT} AS kind", "bucket", "hot AS low", "CAST(NULL AS BINARY) AS least", "CAST(NULL AS BINARY) AS bits")
    if not hot.isEmpty():
        told = told.unionByName(hot)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return finish(None, [], [])
        table = _unpack(left.column("pack")[0].as_py())
        raws, ids = _documents(table)
        spans = spans_of(raws, ids, right, shape, buckets)
        del raws
        release()
        return finish(table, byte_texts(table.column("raw")), spans)

    return packs.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(last, schema)


def _kept(raw: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.reshape(-1).tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Shape | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def finish(table: pa.Table | None, raws: list[bytes], spans: list[np.ndarray]) -> pa.Table:
        sizes = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
        return pa.table(
            [
                table.column("c0").combine_chunks() if table is not None else pa.array([], pa.int64()),
                pa.array([len(r) for r in raws], pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array([len(s) for s in spans], pa.int64()),
                pa.array([hashlib.sha256(_kept(r, s)).hexdigest() for r, s in zip(raws, spans, strict=True)], pa.string()),
            ],
            names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return _scan(docs.select(key, text), key, text, finish, f"`{key}` {kinds[key]}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", shape or Shape())


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Shape | None = None) -> DataFrame:
    """docs with the repeated bytes cut from the text (a code point cut in part goes whole), and n_chars to match."""
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def finish(table: pa.Table | None, raws: list[bytes], spans: list[np.ndarray]) -> pa.Table:
        if table is None:
            return pa.table({c: [] for c in columns})
        null = np.asarray(table.column("raw").is_null())
        texts = [None if n else _kept(r, s).decode("utf-8", "ignore") for r, s, n in zip(raws, spans, null, strict=True)]
        made = []
        for i, c in enumerate(columns):
            if c == text:
                made.append(pa.array(texts, pa.string()))
            elif c == "n_chars":
                was = table.column(f"c{i}")
                made.append(pa.array([w if not len(s) else len(t) for w, s, t in zip(was.to_pylist(), spans, texts, strict=True)], was.type))
            else:
                made.append(table.column(f"c{i}"))
        return pa.table(made, names=columns)

    return _scan(docs, key, text, finish, schema, shape or Shape())
