"""Benchmark decontamination: a generalised suffix automaton of the test items, over words.

Words are the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z is lower-cased. A window is `width` consecutive words
of an item; an item of fewer words, but not none, is one window. The texts stream through the automaton, which tracks the
longest match that ends at each word; from its state follow the windows that end there, and the items that hold them.

The automaton is a few numbers a state in flat arrays. The items are written in blocks of bounded size, and each block is an
automaton and one more pass over the texts; the driver holds one block at a time, and a task no more than one automaton. The
results are the same however many blocks there are.

Null and empty texts have no words; very long ones stream like others. Items of the same words are one in the automaton, and all
of them count; repeated rows of documents count each. A null item text has no window; a null item_id is left out of the list of
items (its windows still hit). An empty table of documents gives no rows, one of items no hits. Other columns keep their names
and values, but match() replaces those named as what it adds.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_texts, cut, extend, total_bytes
from tidemark.session import scratch

#: Consecutive words in a window.
WIDTH = 10
#: Item text in one automaton, in bytes; in the worst case it takes about 100 times as much while it is built.
BLOCK_BYTES = 4 << 20

_WORD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class SuffixAutomaton:
    """Of several word sequences. The moves of state 0, the empty match, are an array by word; another state's first move is in two
    arrays, and further ones are in a dictionary."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int = WIDTH):
        self.width = width
        self.ids: dict[bytes, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [-1])  # the first move of each state
        self.start = array("i")
        self.more: dict[int, int] = {}
        self.moves: dict[int, array] = {}  # words of further moves
        self.link, self.length = array("i", [-1]), array("i", [0])
        same: dict[bytes, int] = {}
        self.names: list[list[str | None]] = []
        at, owner, whole = array("i"), array("i"), []
        for name, words in items:
            numbers = array("i", [self.ids.setdefault(w, len(self.ids)) for w in words])
            self.start.extend([-1] * (len(self.ids) - len(self.start)))
            k = same.setdefault(hashlib.blake2b(b" ".join(words), digest_size=32).digest(), len(self.names))
            if k < len(self.names):
                self.names[k].append(name)
                continue
            self.names.append([name])
            last = 0
            for c in numbers:
                last = self._append(last, c)
                at.append(last)
                owner.append(k)
            if 0 < len(numbers) < width:
                whole.append((last, len(numbers), k))
        same.clear()
        link, length = np.frombuffer(self.link, np.int32), np.frombuffer(self.length, np.int32)
        by_length = np.argsort(length, kind="stable")
        # The state of the window that ends a match: the one on the link path with link length < width <= length.
        window = array("i", [-1]) * len(link)
        is_long = length >= width
        for s in by_length[is_long[by_length]].tolist():
            up = self.link[s]
            window[s] = window[up] if self.length[up] >= width else s
        self.window = window
        # Items by window: each place of an item is in a state, whose window they are.
        states = np.frombuffer(window, np.int32)[np.frombuffer(at, np.int32)] if len(at) else np.empty(0, np.int32)
        pairs = np.unique(states.astype(np.int64) << 32 | np.frombuffer(owner, np.int32)) if len(at) else np.empty(0, np.int64)
        pairs = pairs[pairs >= 0]
        self.item_keys, self.item_values = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        # Items shorter than a window: the state of each one's whole text, and from any state the nearest of these on its path.
        self.short: dict[int, tuple[int, int]] = {}
        for state, n, k in whole:
            while self.length[self.link[state]] >= n:
                state = self.link[state]
            self.short[state] = (n, k)
        self.short_at = array("i")
        if self.short:
            self.short_at = array("i", [-1]) * len(link)
            for s in by_length[1:].tolist():
                self.short_at[s] = s if s in self.short else self.short_at[self.link[s]]

    def _go(self, state: int, c: int) -> int:
        if not state:
            return self.start[c]
        return self.to[state] if self.word[state] == c else self.more.get(state << 32 | c, -1)

    def _put(self, state: int, c: int, to: int) -> None:
        if not state:
            self.start[c] = to
        elif self.word[state] in (-1, c):
            self.word[state], self.to[state] = c, to
        else:
            if state << 32 | c not in self.more:
                self.moves.setdefault(state, array("i")).append(c)
            self.more[state << 32 | c] = to

    def _append(self, last: int, c: int) -> int:
        found = self._go(last, c)
        if found >= 0:  # an earlier item went this way
            return found if self.length[found] == self.length[last] + 1 else self._split(last, c, found)
        new = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and self._go(p, c) < 0:
            self._put(p, c, new)
            p = self.link[p]
        if p >= 0:
            q = self._go(p, c)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q])
        self.word[copy], self.to[copy] = self.word[q], self.to[q]
        for w in self.moves.get(q, ()):
            self._put(copy, w, self.more[q << 32 | w])
        self.link[q] = copy
        while p >= 0 and self._go(p, c) == q:
            self._put(p, c, copy)
            p = self.link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Spans (start, end) of words inside windows, merged; the groups of equal items found."""
        width, start, first, to, more = self.width, self.start, self.word, self.to, self.more
        link, length, window, short_at = self.link, self.length, self.window, self.short_at
        spans: list[list[int]] = []
        items: set[int] = set()
        seen: set[int] = set()
        state = matched = 0
        for i, c in enumerate(map(self.ids.get, words)):
            if c is None:
                state = matched = 0
                continue
            step = -1
            while state:
                step = to[state] if first[state] == c else more.get(state << 32 | c, -1)
                if step >= 0:
                    break
                state = link[state]
                matched = length[state]
            if step < 0:
                step = start[c]
                if step < 0:
                    matched = 0
                    continue
            state = step
            matched += 1
            n = 0
            if matched >= width:
                n = width
                seen.add(window[state])
            if short_at:
                at = short_at[state]
                while at > 0:
                    m, k = self.short[at]
                    if m <= matched:
                        n = max(n, m)
                        items.add(k)
                    at = short_at[link[at]]
            if n:
                if spans and spans[-1][1] >= i + 1 - n:
                    spans[-1][1] = i + 1
                    spans[-1][0] = min(spans[-1][0], i + 1 - n)
                    while len(spans) > 1 and spans[-2][1] >= spans[-1][0]:
                        spans[-2] = [min(spans[-2][0], spans[-1][0]), spans[-1][1]]
                        spans.pop()
                else:
                    spans.append([i + 1 - n, i + 1])
        for s in seen:
            a, b = np.searchsorted(self.item_keys, s), np.searchsorted(self.item_keys, s, "right")
            items.update(self.item_values[a:b].tolist())
        return np.array(spans, np.int32).reshape(-1, 2), items

    def named(self, groups: set[int]) -> set[str]:
        return {name for k in groups for name in self.names[k] if name is not None}


#: The automaton of the block that this worker scanned last.
_BUILT: dict[str, SuffixAutomaton] = {}


def _automaton(block: Broadcast, name: str, width: int) -> SuffixAutomaton:
    if name not in _BUILT:
        _BUILT.clear()
        keys, texts = block.value
        _BUILT[name] = SuffixAutomaton([(k, words_of(t)) for k, t in zip(keys, texts, strict=True)], width)
    return _BUILT[name]


def item_blocks(items: DataFrame, key: str, text: str, most: int) -> Iterator[tuple[list[str | None], list[bytes]]]:
    """(item ids as text, texts) in blocks of about `most` bytes: Spark deals and writes them, and they are read one by one."""
    rows = items.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("text")).where(F.col(text).isNotNull())
    count = max(1, -(-total_bytes(rows, "text") // most))
    path = scratch(items.sparkSession, "items")
    rows.repartition(count).withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(path)
    written = items.sparkSession.read.schema("key string, text binary, block int").parquet(path)
    for b in range(count):
        block = written.where(F.col("block") == b).select("key", "text").toArrow()
        if block.num_rows:
            yield block.column("key").to_pylist(), block.column("text").to_pylist()


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return a if len(a) else b
    both = np.concatenate([a, b])
    both = both[np.argsort(both[:, 0], kind="stable")]
    high = np.maximum.accumulate(both[:, 1])
    first = np.concatenate([[True], both[1:, 0] > high[:-1]])
    return np.stack([both[first, 0], high[np.append(np.flatnonzero(first)[1:] - 1, len(both) - 1)]], axis=1).astype(np.int32)


_ADDS = {"n_words": "bigint", "hit_spans": "array<int>", "hit_items": "array<string>"}


def match(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hit_spans (word positions: start, end, start, end, ...) and hit_items (sorted, without repeats)."""
    keep = [c for c in docs.columns if c not in _ADDS]
    own = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("text"))
    out = None
    for keys, texts in item_blocks(items, item_key, item_text, block_bytes):
        shared, name = docs.sparkSession.sparkContext.broadcast((keys, texts)), uuid.uuid4().hex
        out = _pass(own if out is None else cut(out), out is None, lambda shared=shared, name=name: _automaton(shared, name, width))
    if out is None:
        out = _pass(own, True, lambda: SuffixAutomaton([], width))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *_ADDS)


def _pass(docs: DataFrame, first: bool, automaton: Callable[[], SuffixAutomaton]) -> DataFrame:
    """docs with what one automaton finds; what earlier ones found is kept."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        held = automaton()
        n, spans, found = [], [], []
        was = None if first else (batch.column("was_spans").to_pylist(), batch.column("was_items").to_pylist())
        for i, raw in enumerate(byte_texts(batch.column("text"))):
            words = words_of(raw)
            hit, groups = held.scan(words)
            names = held.named(groups)
            if was is not None:
                hit = _merge(np.array(was[0][i], np.int32).reshape(-1, 2), hit)
                names |= set(was[1][i])
            n.append(len(words))
            spans.append(hit.reshape(-1).tolist())
            found.append(sorted(names))
        return [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]

    if first:
        return extend(docs, "text", _ADDS, run)
    return extend(docs.withColumnsRenamed({"hit_spans": "was_spans", "hit_items": "was_items"}), "text", _ADDS, run).drop("was_spans", "was_items")


def digest(matched: DataFrame, key: str = "doc_id") -> DataFrame:
    """The figures of each document."""
    starts = F.filter(F.col("hit_spans"), lambda x, i: i % 2 == 0)
    ends = F.filter(F.col("hit_spans"), lambda x, i: i % 2 == 1)
    n_hit = F.aggregate(F.zip_with(ends, starts, lambda b, a: (b - a).cast("bigint")), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return matched.select(
        key,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _without(raw: bytes, spans: np.ndarray) -> bytes:
    """The text without the words of the spans and what stands between them."""
    if not len(spans):
        return raw
    is_word = np.frombuffer(raw.translate(_WORD), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], is_word.view(np.int8), [0]]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep, at = [], 0
    for a, b in spans:
        keep.append(raw[at : begins[a]])
        at = ends[b - 1]
    return b"".join([*keep, raw[at:]])


def clean(docs: DataFrame, items: DataFrame, text: str = "text", width: int = WIDTH, least_span: int = WIDTH, most_coverage: float = 0.5, **more) -> DataFrame:
    """docs without the hit spans of at least `least_span` words; those of which more than `most_coverage` is hit go.

    A span goes with the characters between its words; the columns of docs stay, text alone changes, and n_chars with it. Items of
    fewer words than least_span stay where they stand, unless the rest of the document is mostly hit.
    """
    columns = docs.columns
    plain = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    own, size = f"c{columns.index(text)}", f"c{columns.index('n_chars')}" if "n_chars" in columns else None

    def trim(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, gone = [], []
        for raw, null, spans, n in zip(byte_texts(batch.column(own)), batch.column(own).is_null().to_pylist(), batch.column("hit_spans").to_pylist(), batch.column("n_words").to_pylist(), strict=True):
            hit = np.array(spans, np.int64).reshape(-1, 2)
            gone.append(len(hit) > 0 and int((hit[:, 1] - hit[:, 0]).sum()) > most_coverage * n)
            texts.append(None if null else _without(raw, hit[hit[:, 1] - hit[:, 0] >= least_span]).decode("utf-8", "replace"))
        return [pa.array(texts, pa.string()), pa.array(gone, pa.bool_())]

    out = extend(match(plain, items, own, width=width, **more), own, {"trimmed": "string", "gone": "boolean"}, trim).where("NOT gone")
    made = {own: F.col("trimmed")}
    if size:
        made[size] = F.when(F.col("trimmed").eqNullSafe(F.col(own)), F.col(size)).otherwise(F.length("trimmed"))
    return out.select(*(made.get(f"c{i}", F.col(f"c{i}")).alias(c) for i, c in enumerate(columns)))


def sql(width: int = WIDTH) -> str:
    """The rows of digest(match(documents, benchmark)) in DuckDB's SQL, for ids that don't repeat."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
n AS (SELECT DISTINCT item, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM (SELECT *, least({width}, len(w)) AS k FROM i WHERE len(w) > 0))),
d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM n))),
h AS (SELECT doc_id, p, s.k, item FROM s JOIN n ON s.k = n.k AND s.g = n.g),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
