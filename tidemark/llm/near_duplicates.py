"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Texts are words (runs of letters and digits, A-Z lower-cased); a shingle is `SHINGLE` consecutive words, or all words of a
shorter text. A shingle's weight is (1 + ln tf) * idf. Document frequencies come from all texts, through a count sketch of
fixed size whose entries are corrected by their rows' mean load. The idf runs from 1 (in all texts) to 1 + `DAMPING` (in one):
a wide idf would make each shingle of a large group of near copies lighter than the few that set its members apart (README).

Texts of the same words are one from the start (`copies`), so a group of copies costs what one text costs. Each distinct text
gets BANDS * ROWS consistent samples; texts that agree on a whole band meet in a bucket. No bucket emits all its pairs: each
member is first compared with the bucket's pivots (its least id and the least by two hashes), and the links whose exact
weighted Jaccard similarity (of 64-bit shingles and single floats) reaches the threshold go into connected components. Where a
bucket's other members are then still in different components, they are compared by a prefix filter that drops no pair which
can reach the threshold (`rest_pairs`), so no two texts of a bucket stay both unlinked and unexamined.

Null texts and rows of a null id are classes of their own (of null ids, a null class); texts without words are copies if they
are equal as texts. Very long texts are taken whole. Repeated rows and texts have one class; of ties the least id names it. An
empty table gives no rows. Other columns have no part in it; keep_one() leaves them as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_texts, cut, extend, release, slices
from tidemark.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 3
DAMPING = 0.2
#: The count sketch: rows and buckets of a row; it is sent in blocks of so many buckets.
SKETCH_ROWS, SKETCH_BITS, SKETCH_BLOCK = 3, 16, 2048
#: Buckets of the sketch by which the prefix filter orders shingles, as a power of two.
REST_BITS = 20
#: Random triples of the sampler, as a power of two; a sample's hash picks among them.
DRAW_BITS = 16

_IS_WORD = np.array([c >= 0x80 or 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A for c in range(256)])
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, number of words of each text), by prefix sums of a polynomial."""
    line = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    inside = _IS_WORD[line]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[::2], edge[1::2]
    base = 0x100000001B3
    back = pow(base, -1, 1 << 64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[line] + np.uint64(1)) * _powers(base, len(line)), dtype=np.uint64)])
    h = (sums[end] - sums[begin]) * _powers(back, len(line))[begin]
    h = _mix(h * _ODD + (end - begin).astype(np.uint64))
    starts = np.cumsum([0] + [len(r) + 1 for r in raws])
    return h, np.diff(np.searchsorted(begin, starts))


def shingles_of(raws: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, distinct within a text and sorted, their counts, number of each text's, two keys of each text's words)."""
    words, sizes = word_hashes(raws)
    starts = np.cumsum(sizes) - sizes
    rolled = np.zeros(len(words), np.uint64)
    for j in range(n):
        rolled[: len(words) - j] += _mix(words[j:] + np.uint64(j + 1)) * np.uint64(2 * j + 3)
    keys = np.zeros((len(raws), 2), np.int64)
    kept, counts, lengths = [], [], np.zeros(len(raws), np.int64)
    place = _powers(0x2545F4914F6CDD1D, int(sizes.max(initial=0)) + 1)
    for i, (a, size, raw) in enumerate(zip(starts.tolist(), sizes.tolist(), raws, strict=True)):
        own = words[a : a + size]
        if size == 0:
            keys[i] = _text_key(raw)
            continue
        keys[i] = np.array([(own * place[:size]).sum(dtype=np.uint64), (_mix(own + _ODD) * place[:size][::-1]).sum(dtype=np.uint64)]).view(np.int64)
        if size >= n:
            s, c = np.unique(_mix(rolled[a : a + size - n + 1]), return_counts=True)
        else:
            s, c = _mix(keys[i, :1].view(np.uint64)), np.ones(1, np.int64)
        kept.append(s)
        counts.append(c)
        lengths[i] = len(s)
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *kept]), np.concatenate([np.empty(0, np.int64), *counts]), lengths, keys


def _text_key(raw: bytes) -> np.ndarray:
    import hashlib

    return np.frombuffer(hashlib.blake2b(raw, digest_size=16).digest(), np.int64)


def _sketch_at(shingles: np.ndarray, row: int, bits: int = SKETCH_BITS) -> np.ndarray:
    return (_mix(shingles + np.uint64(row + 11)) >> np.uint64(64 - bits)).astype(np.int64)


def _sketched(rows: DataFrame, found: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, int]]], bits: int) -> tuple[np.ndarray, int]:
    """(count sketch of the shingles that `found` gives of batches, texts that have some); of a fixed size whatever the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros((SKETCH_ROWS, 1 << bits), np.int32), 0
        for batch in batches:
            for s, texts in found(batch):
                n += texts
                for row in range(SKETCH_ROWS):
                    table[row] += np.bincount(_sketch_at(s, row, bits), minlength=1 << bits).astype(np.int32)
        blocks = table.reshape(-1, SKETCH_BLOCK)
        filled = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([*filled.tolist(), -1], pa.int32()), pa.array([*(blocks[i].tobytes() for i in filled), np.array([n], np.int32).tobytes()], pa.binary())],
            names=["block", "counts"],
        )
        release()

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.int32).astype(np.int64) for b in group.column("counts").to_pylist())
        return pa.table({"block": group.column("block")[:1].cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    sketch, n = np.zeros(((SKETCH_ROWS << bits) // SKETCH_BLOCK, SKETCH_BLOCK), np.int64), 0
    for row in parts.collect():  # a fixed number of blocks
        got = np.frombuffer(bytes(row["counts"]), np.int64)
        if row["block"] < 0:
            n = int(got[0])
        else:
            sketch[row["block"]] = got
    return sketch.reshape(SKETCH_ROWS, -1), n


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """(count sketch of the texts that hold each shingle, number of texts)."""

    def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
        for part in slices(batch, text):
            s, _, lengths, _ = shingles_of(byte_texts(part.column(text)))
            yield s, int((lengths > 0).sum())

    return _sketched(docs.select(text), found, SKETCH_BITS)


def weights_of(shingles: np.ndarray, counts: np.ndarray, sketch: np.ndarray, n_texts: int) -> np.ndarray:
    """(1 + ln tf) * idf."""
    spread = sketch.sum(axis=1)
    estimates = [sketch[row][at := _sketch_at(shingles, row)] - (spread[row] - sketch[row][at]) / (sketch.shape[1] - 1) for row in range(len(sketch))]
    df = np.clip(np.median(estimates, axis=0), 1, max(n_texts, 1))
    top = np.log(max(n_texts, 2))
    return (1 + np.log(counts)) * (1 + DAMPING * (np.log(max(n_texts, 1)) - np.log(df)) / top)


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_11)
    n = 1 << DRAW_BITS
    return rng.gamma(2, 1, n).astype(np.float32), np.log(rng.gamma(2, 1, n)).astype(np.float32), rng.random(n).astype(np.float32)


def bands_of(shingles: np.ndarray, weights: np.ndarray, lengths: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of each text that has shingles.

    A sample of a shingle of weight w draws r, c (gamma) and b (uniform) from the shingle: t = floor(ln w / r + b), and the
    least ln c - r (t - b + 1) over the shingles gives the sample (shingle, t).
    """
    r, log_c, b = _draws()
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.empty((0, bands), np.int64)
    starts = np.cumsum(lengths) - lengths
    log_w = np.log(weights).astype(np.float32)
    low = shingles & np.uint64(0xFFFFFFFF)
    out = np.zeros((len(lengths), bands), np.uint64)
    for k in range(bands * rows):
        at = (_mix(shingles ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - DRAW_BITS)).astype(np.int64)
        own_r, own_b = r[at], b[at]
        t = np.floor(log_w / own_r + own_b)
        bits = (log_c[at] - own_r * (t - own_b + 1)).view(np.int32).astype(np.int64)
        bits ^= (bits >> 31) & 0x7FFFFFFF  # floats in order of their bits
        pick = ((low ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x85EBCA6B))) & np.uint64(0xFFFFFFFF)).view(np.int64)
        sample = np.minimum.reduceat((bits << 32) | pick, starts).view(np.uint64)
        band = k // rows
        out[:, band] = _mix(out[:, band] * _ODD + (sample & np.uint64(0xFFFFFFFF)) + np.uint64(k + 1))
    return out.view(np.int64)


def signatures(docs: DataFrame, sketch: np.ndarray, n_texts: int, key: str, text: str) -> DataFrame:
    """(id, k1, k2, bands) of each row; null texts have null keys, texts without words no bands."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        null = np.asarray(batch.column(text).is_null())
        s, c, lengths, keys = shingles_of(byte_texts(batch.column(text)))
        found = bands_of(s, weights_of(s, c, shared.value, n_texts), lengths)
        bands: list = [None] * batch.num_rows
        for i, row in zip(np.flatnonzero(lengths > 0).tolist(), found, strict=True):
            bands[i] = row.tolist()
        return [pa.array(keys[:, 0], pa.int64(), mask=null), pa.array(keys[:, 1], pa.int64(), mask=null), pa.array(bands, pa.list_(pa.int64()))]

    return extend(docs.select(F.col(key).cast("bigint").alias("id"), text), text, {"k1": "bigint", "k2": "bigint", "bands": "array<bigint>"}, run, ["id"])


def _in_buckets(distinct: DataFrame) -> DataFrame:
    """(band, h, id, n, pivots): each member of a bucket of several, with the bucket's size and pivots; the text of the least document
    id is one of them, as later texts more often are its copies than each other's."""
    members = distinct.select("id", "first", F.posexplode("bands").alias("band", "h"))
    picks = [F.min(F.struct("first", "id")).alias("p0"), *(F.min(F.struct(F.xxhash64("first", F.lit(j)).alias("x"), F.col("id"))).alias(f"q{j}") for j in (1, 2))]
    buckets = members.groupBy("band", "h").agg(F.count("*").alias("n"), *picks).where("n > 1").select("band", "h", "n", F.array_distinct(F.array("p0.id", "q1.id", "q2.id")).alias("pivots"))
    return members.join(buckets, ["band", "h"])


def candidate_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b), a > b: each member of a bucket with the bucket's pivots."""
    met = _in_buckets(distinct).select("id", F.explode("pivots").alias("pivot")).where("id <> pivot")
    return met.select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).distinct()


def unsettled(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """(id, component) of the texts that share a bucket with one of another component, both of them no pivots of it."""
    others = _in_buckets(distinct).where((F.col("n") - F.size("pivots") > 1) & ~F.array_contains("pivots", F.col("id"))).select("band", "h", "id")
    others = cut(others.join(found.withColumnRenamed("node", "id"), "id", "left").select("band", "h", "id", F.coalesce("component", "id").alias("component")))
    open_buckets = others.groupBy("band", "h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band", "h")
    return others.join(open_buckets, ["band", "h"], "left_semi").select("id", "component").distinct()


def prefix(shingles: bytes, counts: Callable[[np.ndarray], np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(shingles from the rarest on, weight of the set from each of them on, weight of the set), as far as a match can begin.

    Sets of weights A and B that reach the threshold t share at least t / (1 + t) * (A + B), and at least t * A. All of it
    lies at or after the first shingle that both hold, in an order common to all sets, so the weight from there on is no less.
    """
    whole, weight = _unpacked(shingles)
    order = np.lexsort((whole, counts(whole)))
    left = np.cumsum(weight[order][::-1])[::-1]
    n = int((left >= (threshold - 1e-9) * left[0]).sum()) if len(left) else 0
    return whole[order[:n]].view(np.int64), left[:n], float(left[0]) if len(left) else 0.0


def rest_pairs(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a > b: the pairs of `rest` from different components that can reach the threshold, by their prefixes.

    The first shingle that the two of a pair share must leave enough weight on both sides; see prefix(). Shingles are in the order
    of how many texts of the rest hold them, by a sketch. The conditions are the join's own, so of a frequent shingle's texts only
    those come out that still can reach the threshold.
    """
    own = cut(rest.join(sets, "id").select("id", "component", "shingles"))

    def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
        for s in batch.column("shingles").to_pylist():
            yield _unpacked(s)[0], 1

    shared = own.sparkSession.sparkContext.broadcast(_sketched(own.select("shingles"), found, REST_BITS)[0].astype(np.int32))

    def counts(s: np.ndarray) -> np.ndarray:
        return np.min([shared.value[row][_sketch_at(s, row, REST_BITS)] for row in range(SKETCH_ROWS)], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                made = [prefix(s, counts, threshold) for s in part.column("shingles").to_pylist()]
                sizes = [len(m[0]) for m in made]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.repeat(part.column(c).to_numpy(), sizes), pa.int64()) for c in ("id", "component")),
                        pa.array(np.concatenate([m[0] for m in made])),
                        pa.array(np.concatenate([m[1] for m in made])),
                        pa.array(np.repeat([m[2] for m in made], sizes)),
                    ],
                    names=["id", "component", "shingle", "behind", "weight"],
                )
        release()

    posted = cut(own.mapInArrow(run, "id bigint, component bigint, shingle bigint, behind double, weight double"))
    share = threshold / (1 + threshold)
    # The lighter set of a pair shares at least 2 t / (1 + t) of its own weight.
    lighter, heavier = posted.where(F.col("behind") >= (2 * share - 1e-9) * F.col("weight")), posted
    two = heavier.select("shingle", *(F.col(c).alias(f"{c}_2") for c in ("id", "component", "behind", "weight")))
    least = share * (F.col("weight") + F.col("weight_2")) - 1e-6
    fits = (F.col("component") != F.col("component_2")) & F.col("weight").between(threshold * F.col("weight_2") - 1e-6, F.col("weight_2")) & (F.least("behind", "behind_2") >= least)
    # Sizes apart by more than the threshold can't match: neighbours among bins of that ratio meet, which splits frequent shingles.
    size = lambda c: F.floor(F.log(F.col(c)) / np.log(1 / threshold))
    one = lighter.withColumn("size", F.explode(F.array(size("weight"), size("weight") + 1)))
    met = one.join(two.withColumn("size", size("weight_2")), ["shingle", "size"]).where(fits)
    return met.select(F.greatest("id", "id_2").alias("a"), F.least("id", "id_2").alias("b")).distinct()


def weighted_sets(docs: DataFrame, sketch: np.ndarray, n_texts: int, key: str, text: str) -> DataFrame:
    """(id, k1, k2, shingles): each shingle's hash in order, then the weights as floats; keys as in signatures()."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        s, c, lengths, keys = shingles_of(byte_texts(batch.column(text)))
        w = weights_of(s, c, shared.value, n_texts).astype(np.float32)
        ends = np.cumsum(lengths)
        packed = [s[e - n : e].tobytes() + w[e - n : e].tobytes() for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
        return [pa.array(keys[:, 0], pa.int64()), pa.array(keys[:, 1], pa.int64()), pa.array(packed, pa.binary())]

    return extend(docs.select(F.col(key).cast("bigint").alias("id"), text), text, {"k1": "bigint", "k2": "bigint", "shingles": "binary"}, run, ["id"])


def _unpacked(s: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and weights of a set."""
    n = len(s) // 12
    return np.frombuffer(s, np.uint64, n), np.frombuffer(s, np.float32, n, 8 * n).astype(np.float64)


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Sum of the lesser weights over the sum of the greater ones."""
    (x, v), (y, w) = _unpacked(a), _unpacked(b)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = y[at] == x if len(y) else np.zeros(len(x), bool)
    low = np.minimum(v[same], w[at[same]]).sum()
    return float(low / (v.sum() + w.sum() - low)) if len(x) and len(y) else 0.0


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([weighted_jaccard(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s)], names=["a", "b", "similarity"])
        release()

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, similarity double").where(F.col("similarity") >= threshold)


def _classed(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """(id, k1, k2, class_id) of each row of docs; k1 and k2 name its text.

    What is linked are distinct texts, under numbers of their own: an id may have several texts.
    """
    docs = docs.select(key, text)
    sketch, n_texts = document_frequencies(docs, text)
    signed = cut(signatures(docs, sketch, n_texts, key, text))
    copies = signed.where("k1 IS NOT NULL AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("first"), F.first("bands", ignorenulls=True).alias("bands"))
    copies = cut(copies.withColumn("id", F.monotonically_increasing_id()))
    pairs = cut(candidate_pairs(copies))
    nodes = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    own = copies.join(nodes, "id", "left_semi").select(F.col("id").alias("node"), F.col("first").alias("id"), "k1", "k2")
    sets = weighted_sets(docs, sketch, n_texts, key, text).join(own, ["id", "k1", "k2"])
    sets = cut(sets.groupBy(F.col("node").alias("id")).agg(F.min("shingles").alias("shingles")))
    links = cut(verified(pairs, sets, threshold))
    found = components(links)
    rest = cut(unsettled(copies, found))
    if not rest.isEmpty():
        more = cut(verified(rest_pairs(rest, sets, threshold), sets, threshold))
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b")))
    component = F.coalesce("component", "node").alias("component")  # a component's least node has no row of its own
    of_copies = copies.select("k1", "k2", "first", F.col("id").alias("node")).join(found, "node", "left").select("k1", "k2", "first", component)
    least = cut(of_copies.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))  # so that a large class can be split
    of_copies = of_copies.join(least, "component", "left").select("k1", "k2", F.coalesce("least", "first").alias("class_id"))
    rows = signed.select("id", "k1", "k2").join(of_copies, ["k1", "k2"], "left")
    named = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("class_id", "id"))
    return rows.select("id", "k1", "k2", named.cast("bigint").alias("class_id"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, class_id) of each row of docs: the least id of its class."""
    return _classed(docs, key, text, threshold).select(F.col("id").alias(key), "class_id")


def _with_keys(docs: DataFrame, text: str) -> DataFrame:
    """docs with k1 and k2 as in signatures()."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        null = np.asarray(batch.column(text).is_null())
        keys = shingles_of(byte_texts(batch.column(text)))[3]
        return [pa.array(keys[:, i], pa.int64(), mask=null) for i in (0, 1)]

    return extend(docs, text, {"k1": "bigint", "k2": "bigint"}, run)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class, the one of the least id; rows of null ids stay. Of an id with several texts those stay
    whose class it names, a row for each text."""
    found = cut(_classed(docs, key, text, threshold).where("id IS NOT NULL").distinct())
    several = found.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias(key))
    kept = found.where("class_id = id")
    alone = kept.join(several, F.col("id") == F.col(key), "left_anti").select(F.col("id").alias(key))
    out = docs.join(alone, key, "left_semi").dropDuplicates([key, text]).unionByName(docs.where(F.col(key).isNull()))
    if several.isEmpty():
        return out
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # columns of theirs may be called as the keys
    mixed = _with_keys(docs.join(several, key, "left_semi").select(*(F.col(c).alias(n) for c, n in names.items())), names[text])
    same = (F.col(names[key]) == F.col("id")) & F.col("k1").eqNullSafe(F.col("kept_1")) & F.col("k2").eqNullSafe(F.col("kept_2"))
    mixed = mixed.join(kept.select("id", F.col("k1").alias("kept_1"), F.col("k2").alias("kept_2")), same, "left_semi")
    return out.unionByName(mixed.select(*(F.col(n).alias(c) for c, n in names.items())).dropDuplicates([key, text]))
