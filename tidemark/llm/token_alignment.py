"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning.

A text's tokens of either tokenizer end at byte offsets; the ends of all texts of a batch make two ascending rows. Merging them is a
path through a grid, and diagonals of the grid cut it into pieces of equal work: a binary search on each diagonal finds how many
ends of either row lie before it (`split`). Pieces are independent; each emits the overlaps that end in it (`overlaps`), one for each
distinct end. An end that both rows have closes a group; a group that a diagonal cuts is stitched, as pieces mark closed groups by
their places in the rows alone.

Id pairs are counted for each batch, then for the corpus; a batch's links are codes into its distinct pairs, so that only these, and
not links, are joined with the corpus's counts. No vocabulary table is sent.

Null and empty texts, and texts whose tokens' bytes aren't a space and the text, have no tokens: zeros and an empty digest. Very long
texts are aligned whole, in pieces. Rows that repeat an id are aligned each and counted each. Ties for the best pair count all. An
empty table gives no rows. Other columns have no part in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.byte_level import byte_level, byte_level_bytes, flat
from tidemark.llm.common import byte_texts, release, slices
from tidemark.llm.sentence_pieces import default_model
from tidemark.llm.token_counts import default_tokenizer
from tidemark.session import scratch

SPACE = "▁"
#: Steps of the merge path in a piece.
PIECE = 1 << 16
#: Bytes of text that are aligned, and whose distinct pairs are counted, at once.
BATCH_BYTES = 2 << 20
#: Characters that are encoded at once.
ENCODE_CHARS = 1 << 18
_TASK_BITS = 33


def split(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """For each diagonal d, how many of the first d ends of the merged rows are a's; of equal ends, a's comes first."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # a[middle] is among the first d if it doesn't come after b[d - 1 - middle]
        before = np.zeros(len(middle), bool)
        before[open_] = a[middle[open_]] <= b[(diagonals - 1 - middle)[open_]]
        low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' places (i, j) of tokens that overlap, in order of where the overlap ends, and whether both tokens end there."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    diagonals = np.unique(np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b)))
    i = split(a, b, diagonals)
    j = diagonals - i
    found = [_piece(a, b, *at) for at in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist(), strict=True)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The overlaps that end in a[i0:i1] or b[j0:j1]; one that ends at a[i0 - 1] too belongs to the piece before."""
    mine, theirs = a[i0:i1], b[j0:j1]
    if j0 < j1 and i0 and theirs[0] == a[i0 - 1]:
        theirs, j0 = theirs[1:], j0 + 1
    to = np.searchsorted(theirs, mine)  # b's tokens that end before
    n = len(mine) + len(theirs)
    at = to + np.arange(len(mine))  # places in the merged row, a's end before an equal one
    is_a = np.zeros(n, bool)
    is_a[at] = True
    i, j = np.empty(n, np.int64), np.empty(n, np.int64)
    i[at], j[at] = i0 + np.arange(len(mine)), j0 + to
    order = np.flatnonzero(~is_a)
    i[order], j[order] = i0 + np.searchsorted(mine, theirs), j0 + np.arange(len(theirs))
    closed = np.zeros(n, bool)
    inside = to < len(theirs)
    closed[at[inside]] = theirs[to[inside]] == mine[inside]
    if not inside.all() and j1 < len(b):  # b's equal end is the first of the next piece
        closed[at[~inside]] = b[j1] == mine[~inside]
    once = np.ones(n, bool)
    once[1:] = ~(closed[:-1] & is_a[:-1] & ~is_a[1:])
    return i[once], j[once], closed[once]


class Pair:
    """Two tokenizers: A a byte-level file, B a piece model, which puts a space before a text; A gets the text with one."""

    def __init__(self, a: str, b: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = byte_level(a, special=False), SentencePieceProcessor(model_file=b)
        names = self.a.library.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.a.library.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for token, i in names.items():
            self.a_bytes[i] = token.encode() if token in special else byte_level_bytes(token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # an id's digits and what stands behind it: within a group, or at the end of A's and of B's part of one
        width = len(str(max(len(self.a_bytes), len(self.b_bytes)))) + 1
        written = lambda n, ends: np.array([f"{i}{e}" for e in ends for i in range(n)], f"S{width}")
        self.a_text, self.b_text = written(len(self.a_bytes), ",|"), written(len(self.b_bytes), ",;")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both of all texts, with the number of each; none where the bytes aren't those of a space and the text."""
        found, begin, size = [], 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text or "")
            if size >= ENCODE_CHARS or end == len(texts):  # lists of ids are large, so few texts' at a time
                found.append(self._encode([t or "" for t in texts[begin:end]]))
                begin, size = end, 0
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.a.encode([f" {t}" for t in texts]), self.b.encode(texts, num_threads=1)
        for k, text in enumerate(texts):
            raw = f" {text}".encode("utf-8", "surrogatepass")
            if not text or b"".join([self.a_bytes[i] for i in a[k]]) != raw or b"".join([self.b_bytes[i] for i in b[k]]) != raw:
                a[k], b[k] = [], []
        return *flat(a), *flat(b)

    def align(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], np.ndarray]:
        """For each text the numbers of A's and B's tokens, groups and links, and the groups' digest; for each link its pair."""
        a, n_a, b, n_b = self.encode(texts)
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        i, j, closed = overlaps(ends_a, ends_b)
        first_a, first_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        cuts = np.searchsorted(i, first_a)
        n_links = np.diff(cuts)
        n_groups = np.diff(np.concatenate([[0], np.cumsum(closed)])[cuts])
        # where each token is written: behind all tokens of the groups before, and B's behind the group's A's
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[i[closed]] = True
        last_b[j[closed]] = True
        before_a, before_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # groups before the token's
        until_a, until_b = np.append(0, np.flatnonzero(last_a) + 1), np.append(0, np.flatnonzero(last_b) + 1)
        written = np.empty(len(a) + len(b), self.a_text.dtype)
        written[np.arange(len(a)) + until_b[before_a]] = self.a_text[a + last_a * len(self.a_bytes)]
        written[np.arange(len(b)) + until_a[before_b + 1]] = self.b_text[b + last_b * len(self.b_bytes)]
        raw, width, digests = written.tobytes(), written.dtype.itemsize, []
        for at, end in zip(((first_a + first_b)[:-1] * width).tolist(), ((first_a + first_b)[1:] * width).tolist(), strict=True):
            digests.append(hashlib.sha256(raw[at:end].translate(None, b"\0")[:-1]).hexdigest() if end > at else "")
        return [n_a, n_b, n_groups, n_links], digests, a[i].astype(np.int64) * len(self.b_bytes) + b[j]

    @property
    def n_b(self) -> int:
        return len(self.b_bytes)


@lru_cache(maxsize=1)
def pair(a: str, b: str) -> Pair:
    return Pair(a, b)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def batches_of(docs: DataFrame, doc_id: str, text: str, a: str, b: str) -> DataFrame:
    """A row for each batch of texts: its number, its distinct pairs and how often they are linked, what is known of each text, and
    for each link the place of its pair."""
    kind = docs.schema[doc_id].dataType.simpleString()
    longs = ", ".join(f"{c} array<bigint>" for c in _COUNTS)
    schema = f"batch bigint, a_id array<int>, b_id array<int>, times array<bigint>, ids array<{kind}>, {longs}, digests array<string>, links binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = pair(a, b), TaskContext.get().partitionId() << _TASK_BITS
        for batch in batches:
            for part in slices(batch, text, BATCH_BYTES):
                numbers, digests, keys = both.align([None if t is None else t.decode("utf-8", "replace") for t in _raw(part.column(text))])
                distinct, codes, times = np.unique(keys, return_inverse=True, return_counts=True)
                whole = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(doc_id))
                lists = [whole((distinct // both.n_b).astype(np.int32), pa.int32()), whole((distinct % both.n_b).astype(np.int32), pa.int32()), whole(times, pa.int64()), ids]
                lists += [whole(n, pa.int64()) for n in numbers]
                raw = codes.astype("<u2" if len(distinct) <= 1 << 16 else "<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, whole(digests, pa.string()), pa.array([raw], pa.binary())], names=["batch", "a_id", "b_id", "times", "ids", *_COUNTS, "digests", "links"])
                number += 1
                release()

    return docs.select(doc_id, text).mapInArrow(run, schema)


def _raw(column: pa.Array) -> list[bytes | None]:
    return (column if pa.types.is_binary(column.type) else column.cast(pa.binary())).to_pylist()


def pair_counts(batches: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best): how often the corpus links two ids, and whether no other id of A has more links with b_id."""
    zipped = batches.select(F.explode(F.arrays_zip("a_id", "b_id", "times")).alias("p"))
    counts = zipped.groupBy(F.col("p.a_id").alias("a_id"), F.col("p.b_id").alias("b_id")).agg(F.sum("p.times").alias("n"))
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return counts.join(most, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_a: str | None = None, model_b: str | None = None) -> DataFrame:
    """A row for each document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    folder = scratch(spark, "alignment")
    batches_of(docs, doc_id, text, tokenizer_a or default_tokenizer(), model_b or default_model()).write.parquet(folder)
    batches = spark.read.parquet(folder)
    told = batches.select("batch", F.posexplode(F.arrays_zip("a_id", "b_id")).alias("at", "p")).select("batch", "at", "p.a_id", "p.b_id")
    told = told.join(pair_counts(batches), ["a_id", "b_id"])
    # a batch's distinct pairs, bounded by its bytes
    told = told.groupBy("batch").agg(F.collect_list(F.struct("at", "n", "best")).alias("told"))
    rows = batches.select("batch", "ids", *_COUNTS, "digests", "links", F.size("a_id").alias("distinct")).join(told, "batch", "left")
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [doc_id, *_COUNTS, "n_best", "count_sum", "groups_sha256"]
    schema = ", ".join([f"`{doc_id}` {kind}", *(f"{c} bigint" for c in names[1:-1]), "groups_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1) for k in range(batch.num_rows)):
                distinct = row.column("distinct")[0].as_py()
                n, best = np.zeros(distinct, np.int64), np.zeros(distinct, np.int64)
                if distinct:
                    structs = row.column("told").flatten()
                    at = structs.field("at").to_numpy()
                    n[at] = structs.field("n").to_numpy()
                    best[at] = structs.field("best").to_numpy(zero_copy_only=False)
                codes = np.frombuffer(row.column("links")[0].as_buffer(), "<u2" if distinct <= 1 << 16 else "<u4")
                counts = [row.column(c).flatten() for c in _COUNTS]
                ends = np.concatenate([[0], np.cumsum(counts[-1].to_numpy())])
                sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(x[codes])])[ends]), pa.int64()) for x in (best, n)]
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), *counts, *sums, row.column("digests").flatten()], names=names)
        release()

    return rows.mapInArrow(run, schema)
