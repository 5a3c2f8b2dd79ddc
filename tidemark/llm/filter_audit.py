"""What filters of documents remove, alone and behind one another, by sorted posting lists.

Each document gets its failures from built-in functions. Documents are sorted by part and id into ranges, and a range keeps a
sorted list of its failing documents for each filter (`posting_lists`), as well as lists of good and of toxic ones. Lists hold
places within `ids`, so rows that repeat an id stay apart. `merged` walks a range's lists at once: it gallops in the list whose head
is least up to the next head, so runs in one list alone cost a logarithm of their length, and yields how many documents lie in each
set of lists. Unions and differences of any filters are sums of these sizes, and sizes of ranges add up (`audit`), so all orders of
the filters come from one merge. A hot part has more ranges; nothing holds a part.

Null texts are empty ones; a null part is the empty string. Empty and very long texts are judged whole. A row of a null id equals
no earlier text and has no labels. Rows that repeat an id are counted each; of texts that are equal, all rows of the least id pass.
Labels that repeat an id count if any of them holds. An empty table gives no rows. Other columns have no part in it, whatever they
are called.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

FILTERS = "ABCDE"
LISTS = (*FILTERS, "good", "toxic")
LEAST_WORDS = 50
#: Distinct words in a hundred words, at least.
LEAST_DISTINCT = 65
#: Capital letters in a hundred characters, at most.
MOST_CAPITALS = 5
SYMBOLS = "[#$%&*|]"
_BETWEEN = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """Conditions of failure that a text alone decides."""
    words = F.filter(F.split(text, _BETWEEN), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "source") -> DataFrame:
    """(part, id, row, A to E, good, toxic): a row for each document, without its text."""
    plain = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    small = cut(plain.select("id", "part", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(F.col("t"), 256)).alias("key"), *(c.alias(k) for k, c in failures(F.col("t")).items())))
    first = small.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    both = small.join(first, "key", "left").join(marks.where("good OR toxic"), "id", "left")
    false = F.lit(False)
    return both.select("part", "id", "row", *"ABCD", F.coalesce(F.col("id") > F.col("first"), false).alias("E"), F.coalesce("good", false).alias("good"), F.coalesce("toxic", false).alias("toxic"))


def posting_lists(rows: DataFrame) -> DataFrame:
    """(part, ids, and for each of LISTS the sorted places in ids): a row for each part and range of ids."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"part string, ids array<{kind}>, " + ", ".join(f"`{n}` array<int>" for n in LISTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").to_pylist()
            begins = [0, *(i for i in range(1, len(parts)) if parts[i] != parts[i - 1]), len(parts)]
            if not parts:
                continue
            offsets = pa.array(begins, pa.int32())
            columns = [pa.array([parts[i] for i in begins[:-1]], pa.string()), pa.ListArray.from_arrays(offsets, batch.column("id"))]
            for name in LISTS:
                at = np.flatnonzero(batch.column(name).to_numpy(zero_copy_only=False))
                cuts = np.searchsorted(at, begins)
                local = at - np.repeat(begins[:-1], np.diff(cuts))
                columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(local, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["part", "ids", *LISTS])

    sorted_rows = cut(rows).repartitionByRange("part", "id", "row").sortWithinPartitions("part", "id", "row")
    return sorted_rows.mapInArrow(run, schema)


def gallop(places: list[int], at: int, target: int) -> int:
    """The first position from `at` on whose place isn't below the target: steps that double, then a bisection."""
    step = 1
    while at + step <= len(places) and places[at + step - 1] < target:
        at += step
        step *= 2
    return bisect_left(places, target, at, min(at + step, len(places)))


def merged(lists: list[list[int]]) -> dict[int, int]:
    """How many places lie in just these lists, by the sum of 1 << i over the lists i that hold them."""
    counts: dict[int, int] = {}
    heads = [0] * len(lists)
    live = [i for i, x in enumerate(lists) if x]
    while live:
        now = [lists[i][heads[i]] for i in live]
        least = min(now)
        there = [i for i, p in zip(live, now, strict=True) if p == least]
        mask = sum(1 << i for i in there)
        if len(there) == 1:
            i = there[0]
            others = [p for p in now if p != least]
            end = gallop(lists[i], heads[i], min(others)) if others else len(lists[i])
            counts[mask] = counts.get(mask, 0) + end - heads[i]
            heads[i] = end
        else:
            counts[mask] = counts.get(mask, 0) + 1
            for i in there:
                heads[i] += 1
        live = [i for i in live if heads[i] < len(lists[i])]
    return counts


def set_sizes(lists: DataFrame) -> DataFrame:
    """(part, mask, n): documents of a part in just the lists of the mask; 0 for those in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[str, int], int] = {}
            for row in batch.select(["part", *LISTS]).to_pylist():
                for mask, n in merged([row[name] for name in LISTS]).items():
                    out[row["part"], mask] = out.get((row["part"], mask), 0) + n
            for part, ids in zip(batch.column("part").to_pylist(), batch.column("ids").value_lengths().to_pylist(), strict=True):
                out[part, 0] = out.get((part, 0), 0) + ids
            for part, mask in list(out):
                if mask:
                    out[part, 0] -= out[part, mask]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([m for _, m in out], pa.int32()), pa.array(list(out.values()), pa.int64())], names=["part", "mask", "n"])

    return lists.mapInArrow(run, "part string, mask int, n bigint").groupBy("part", "mask").agg(F.sum("n").alias("n"))


def audit(sizes: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; sizes: those of set_sizes()."""
    counts = ("step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in counts[1:])
    n_filters, masks = len(FILTERS), np.arange(1 << len(LISTS))
    orders = ["".join(o) for o in permutations(FILTERS)]

    def of(n: np.ndarray) -> list[list]:
        good, toxic = (n * (masks >> LISTS.index(x) & 1) for x in ("good", "toxic"))
        fails = masks & (1 << n_filters) - 1
        made = {}
        for f in range(n_filters):
            for before in range(1 << n_filters):
                if not before >> f & 1:
                    here = (fails >> f & 1).astype(bool) & (fails & before == 0)  # the list of f without the union of those before
                    late = (fails >> f & 1).astype(bool) & (fails & before != 0)
                    union = fails & (before | 1 << f) != 0
                    made[f, before] = [n[~union].sum(), n[here].sum(), n[late].sum(), n[fails == 1 << f].sum(), good[here].sum(), toxic[here].sum()]
        # a set of k filters stands before a step in k! (4 - k)! of the orders
        shares = [sum(made[f, b][1] * factorial(b.bit_count()) * factorial(n_filters - 1 - b.bit_count()) for b in range(1 << n_filters) if (f, b) in made) for f in range(n_filters)]
        rows = []
        for order in orders:
            before = 0
            for step, name in enumerate(order):
                f = FILTERS.index(name)
                rows.append([order, step + 1, *made[f, before], shares[f]])
                before |= 1 << f
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column("part").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                n = np.zeros(len(masks), np.int64)
                for mask, size in found:
                    n[mask] = size
                columns = list(zip(*of(n), strict=True))
                arrays = [pa.array([part] * len(columns[0]), pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), *(pa.array(np.array(c, np.int64)) for c in columns[2:])]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "filter_order", *counts])

    by_part = sizes.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", "n"))).alias("sizes"))  # a row for each mask
    return by_part.mapInArrow(run, schema)


def filter_audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for documents of a table."""
    return audit(set_sizes(posting_lists(judged(docs, labels, text, part))))


def sql() -> str:
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, [x FOR x IN string_split_regex(t, '{_BETWEEN}') IF x <> ''] AS words FROM d),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, (len(words) < {LEAST_WORDS})::INT
      + 2 * (100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words))::INT
      + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t))::INT
      + 8 * regexp_matches(t, '{SYMBOLS}')::INT
      + 16 * coalesce(w.doc_id > least, false)::INT AS mask,
    coalesce(good, false) AS good, coalesce(marks.toxic, false) AS toxic
  FROM w JOIN first USING (t) LEFT JOIN marks ON marks.doc_id = w.doc_id),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM m GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT o, k, substr(o, k, 1) AS f, 1 << (ascii(substr(o, k, 1)) - 65) AS bit,
    list_sum([1 << (ascii(substr(o, i::INT, 1)) - 65) FOR i IN range(0, k) IF i > 0])::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS k)),
r AS (
  SELECT part, o AS filter_order, k AS step, f,
    sum(n) FILTER (mask & (coalesce(before, 0) | bit) = 0) AS kept,
    sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0) AS removed,
    sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) > 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails,
    sum(n_good) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0) AS good_lost,
    sum(n_toxic) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0) AS toxic_lost
  FROM s, g GROUP BY part, o, k, f)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM r"""
