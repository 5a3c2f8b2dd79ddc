"""Toxicity: class-conditional Kneser-Ney models over the bytes of words.

Two models, one of toxic and one of ordinary labelled texts, give each word a log-likelihood ratio. The highest order counts
within a class; the lower orders are continuation counts that both classes share, so a word neither class has seen whole is
judged by its parts, and a rare one leans on the shared counts. The ratios are normalised by length, over the whole text and
over its most toxic words, and a logistic regression on labelled rows that the counts leave out turns them into a score. An
n-gram holds bytes of one word and the spaces around it; n-grams that reach into the word before made the scores worse (README).

All labelled rows but the held-out ones are counted, exactly: the counts are Spark tables keyed by the n-gram, which grow with
the data. The shared counts cancel out for an n-gram that no labelled text has, so its ratio depends on its history alone, and
the ratios of the n-grams and histories of the labelled texts say all. The regression learns from a bounded sample
(`CALIBRATION_DOCS`); the rows that it comes from are counted once it is fitted.

Null and empty texts, and those without a word, have ratios of 0. Very long texts are scored whole. Repeated rows score alike.
Labels of an id that has several count as toxic if one of them is; null labels and ids don't count. Empty tables give no rows;
without labelled rows every score is 1/2. Columns named score and predicted are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, byte_texts, cut, extend, slices

ORDER = 6
DISCOUNT = 0.75
CALIBRATION_DOCS = 20_000
#: Labels are sent to all tasks up to this number of rows (9 bytes each), and joined by a shuffle beyond it.
MOST_SENT_LABELS = 5_000_000
#: Words that a task remembers.
MOST_WORDS = 250_000
#: Ratios of n-grams are sent to all tasks up to this number (16 bytes each), and joined by shuffles beyond it; the scores are the same.
MOST_SENT_GRAMS = 4_000_000
#: Keys over which the texts that hold a word are spread in that join.
SPREAD = 32

_WORD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-gram that ends at each byte of each word and at the space after it, number of n-grams of each word).

    A word stands between spaces; what would come before the first of them is zero.
    """
    before = b"\0" * (ORDER - 1) + b" "
    line = np.frombuffer(b"".join(before + w + b" " for w in words), np.uint8).astype(np.int64)
    key = line.copy()
    for j in range(1, ORDER):
        key[j:] |= line[:-j] << (8 * j)
    sizes = np.array([len(w) + ORDER + 1 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(line), bool)
    for j in range(ORDER):
        keep[starts + j] = False
    return key[keep], sizes - ORDER


@dataclass
class Model:
    #: (gram, ordinary, toxic): how often each n-gram of the highest order stands in either class; all else follows from it.
    counts: DataFrame
    weights: np.ndarray


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(id, text, toxic) of the labelled rows."""
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    if own.count() <= MOST_SENT_LABELS:
        own = F.broadcast(own)
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(own, "id")


def gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, ordinary, toxic): how often each n-gram stands in either class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key, to = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return key, *(np.bincount(to, np.concatenate([h[c] for h in held]), len(key)) for c in (1, 2))

        for batch in batches:
            for part in slices(batch, "text"):
                toxic = part.column("toxic").to_pylist()
                for c in (0, 1):
                    words = [w for raw, t in zip(byte_texts(part.column("text")), toxic, strict=True) if (t > 0) == c for w in words_of(raw)]
                    if words:
                        key, n = np.unique(grams_of(words)[0], return_counts=True)
                        zero = np.zeros(len(key))
                        held.append((key, zero, n) if c else (key, n, zero))
                if sum(len(h[0]) for h in held) > 2_000_000:
                    held = [merged()]
        if held:
            key, ordinary, toxic = merged()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ordinary, pa.float64()), pa.array(toxic, pa.float64())], names=["gram", "ordinary", "toxic"])

    return rows.select("text", "toxic").mapInArrow(run, "gram bigint, ordinary double, toxic double").groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _ending(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1))


def _discounted(count: Column, total: Column, kinds: Column, p: Column) -> Column:
    """Kneser-Ney: the discounted count of a gram and its share of p; p alone after a history that was never seen."""
    return F.when(total > 0, (F.greatest(F.coalesce(count, F.lit(0.0)) - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * p) / total).otherwise(p)


def gram_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): the log-likelihood ratio (toxic to ordinary) of each n-gram of the counts; and under the negative of each
    history, less 1, that of an n-gram that follows the history but isn't among them.

    From short to long n-grams, each order joins its own counts, those of its histories and the order below. A key of these
    joins has no more than 256 n-grams.
    """
    shorter, lower = counts.select("gram"), {}
    for order in range(ORDER - 1, 1, -1):
        # How many distinct longer n-grams end with each: its continuation count.
        lower[order] = shorter.groupBy(_ending(order).alias("gram")).agg(F.count("*").cast("double").alias("n"))
        shorter = lower[order].select("gram")
    below = None
    for order in range(2, ORDER):
        histories = lower[order].groupBy(F.shiftright("gram", 8).alias("h")).agg(F.sum("n").alias("total"), F.count("*").cast("double").alias("kinds"))
        out = lower[order].withColumn("h", F.shiftright("gram", 8)).join(histories, "h", "left")
        out = out.withColumn("p", F.lit(1 / 256)) if below is None else out.withColumn("end", _ending(order - 1)).join(below, "end")
        below = out.select(F.col("gram").alias("end"), _discounted(F.col("n"), F.col("total"), F.col("kinds"), F.col("p")).alias("p"))
    classes = ["ordinary", "toxic"]
    histories = cut(counts.groupBy(F.shiftright("gram", 8).alias("h")).agg(*(F.sum(c).alias(f"{c}_total") for c in classes), *(F.sum((F.col(c) > 0).cast("double")).alias(f"{c}_kinds") for c in classes)))
    out = counts.withColumn("h", F.shiftright("gram", 8)).withColumn("end", _ending(ORDER - 1)).join(histories, "h").join(below, "end")
    ordinary, toxic = (F.log(_discounted(F.col(c), F.col(f"{c}_total"), F.col(f"{c}_kinds"), F.col("p"))) for c in classes)
    # What is left for grams that a class hasn't seen is a share of p, the same p in both classes.
    share = [F.log(_discounted(F.lit(0.0), F.col(f"{c}_total"), F.col(f"{c}_kinds"), F.lit(1.0))) for c in classes]
    return out.select("gram", (toxic - ordinary).alias("ratio")).unionByName(histories.select((-F.col("h") - 1).alias("gram"), (share[1] - share[0]).alias("ratio")))


class Ratios:
    """Ratios of n-grams from gram_ratios(), sorted."""

    def __init__(self, grams: np.ndarray, ratios: np.ndarray):
        self.grams, self.ratios = np.append(grams, np.iinfo(np.int64).max), np.append(ratios, 0.0)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, grams)
        out = np.where(self.grams[at] == grams, self.ratios[at], 0.0)
        rest = np.flatnonzero(self.grams[at] != grams)
        histories = -(grams[rest] >> 8) - 1
        at = np.searchsorted(self.grams, histories)
        out[rest] = np.where(self.grams[at] == histories, self.ratios[at], 0.0)
        return out


def word_ratios(docs: DataFrame, ratios: DataFrame, text: str) -> DataFrame:
    """(word, ratio): the length-normalised ratio of each distinct word of docs, from those of n-grams."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, text):
                new = {w for raw in byte_texts(part.column(text)) for w in words_of(raw)} - seen
                if len(seen) > MOST_WORDS:
                    seen = set()
                seen |= new
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary())], names=["word"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word"):
                words = part.column("word").to_pylist()
                for at in range(0, len(words), 20_000):
                    some = words[at : at + 20_000]
                    key, sizes = grams_of(some)
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()).take(pa.array(np.repeat(np.arange(len(some)), sizes))), pa.array(key)], names=["word", "gram"])

    stands = docs.select(text).mapInArrow(distinct, "word binary").distinct().mapInArrow(grams, "word binary, gram bigint")
    asked = cut(stands.select("gram").distinct())
    of_histories = ratios.where("gram < 0").select((-F.col("gram") - 1).alias("h"), F.col("ratio").alias("other"))
    own = asked.join(ratios, "gram", "left").withColumn("h", F.shiftright("gram", 8)).join(of_histories, "h", "left").select("gram", F.coalesce("ratio", "other", F.lit(0.0)).alias("ratio"))
    return cut(stands.join(own, "gram").groupBy("word").agg(F.avg("ratio").alias("ratio")))


def features(ratios: Ratios, raws: list[bytes], known: dict[bytes, float]) -> np.ndarray:
    """Of each text: ratio over all its words, of its most toxic word, and the mean of its three most toxic ones."""
    split = [words_of(raw) for raw in raws]
    new = [*{w for words in split for w in words if w not in known}]
    if len(known) + len(new) > MOST_WORDS:
        known.clear()
        new = [*{w for words in split for w in words}]
    for at in range(0, len(new), 20_000):
        part = new[at : at + 20_000]
        key, sizes = grams_of(part)
        known.update(zip(part, (np.add.reduceat(ratios(key), np.cumsum(sizes) - sizes) / sizes).tolist(), strict=True))
    out = np.zeros((len(raws), 3))
    for i, words in enumerate(split):
        if words:
            r = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
            size = np.fromiter(map(len, words), np.float64, len(words)) + 1
            top = np.partition(r, -3)[-3:] if len(r) > 3 else r
            out[i] = (r * size).sum() / size.sum(), r.max(), top.mean()
    return out


def _expand(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), 10 * x[:, 0], x[:, 1], x[:, 2], np.maximum(x[:, 1], 0) ** 2])


def calibrate(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps, lightly regularised."""
    z, w = _expand(x), np.zeros(5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(5), z.T @ (toxic - p) - 0.05 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fold: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", calibration_fold: int = 3) -> Model:
    """fold: a column over docs' key, named `id` here; rows of `calibration_fold` calibrate before they are counted too."""
    rows = labelled(docs, labels, key, text, label).withColumn("fold", fold)
    model = Model(cut(gram_counts(rows.where(F.col("fold") != calibration_fold))), np.zeros(5))
    sample = bounded_sample(rows.where(F.col("fold") == calibration_fold), "id", CALIBRATION_DOCS)
    found = _featured(sample, model, "text", ["id", "toxic"]).toPandas()
    if len(found):
        model.weights = calibrate(found[["f0", "f1", "f2"]].to_numpy(), (found["toxic"] > 0).to_numpy(float))
    left_out = gram_counts(rows.where(F.col("fold") == calibration_fold))
    model.counts = cut(model.counts.unionByName(left_out).groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")))
    return model


def _featured(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """The columns of keep with the features f0, f1 and f2."""
    ratios = cut(gram_ratios(model.counts))
    if ratios.count() > MOST_SENT_GRAMS:
        return _joined(docs, word_ratios(docs, ratios, text), text, keep)
    held = ratios.toArrow().sort_by("gram")
    shared, made = docs.sparkSession.sparkContext.broadcast((np.asarray(held.column("gram"), np.int64), np.asarray(held.column("ratio"), np.float64))), []
    known: dict[bytes, float] = {}

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        if not made:
            made.append(Ratios(*shared.value))
        x = features(made[0], byte_texts(batch.column(text)), known)
        return [pa.array(x[:, i], pa.float64()) for i in range(3)]

    return extend(docs, text, {f"f{i}": "double" for i in range(3)}, run, keep)


def _joined(docs: DataFrame, words: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """features() by a join of each text's distinct words with their ratios; frequent words are spread over SPREAD keys."""
    named = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    rows = cut(docs.select(*named, F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for row, raw in zip(part.column("row").to_pylist(), byte_texts(part.column("text")), strict=True):
                    n = Counter(words_of(raw))
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(n), pa.int64()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["row", "word", "n"])

    stand = rows.select("row", "text").mapInArrow(run, "row bigint, word binary, n bigint").withColumn("spread", F.col("row") % SPREAD)
    held = words.withColumn("spread", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))))
    size = (F.octet_length("word") + 1) * F.col("n")
    top = F.slice(F.sort_array(F.flatten(F.collect_list(F.array_repeat("ratio", F.least("n", F.lit(3)).cast("int")))), asc=False), 1, 3)
    found = stand.join(held, ["word", "spread"]).groupBy("row").agg((F.sum(F.col("ratio") * size) / F.sum(size)).alias("f0"), F.max("ratio").alias("f1"), top.alias("top"))
    mean = F.aggregate("top", F.lit(0.0), lambda acc, x: acc + x) / F.size("top")
    found = found.select("row", "f0", "f1", mean.alias("f2"))
    return rows.join(found, "row", "left").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *(F.coalesce(f"f{i}", F.lit(0.0)).alias(f"f{i}") for i in range(3)))


def predict(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """docs with score and predicted (score >= threshold); columns of these names are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    z = [F.lit(1.0), 10 * F.col("f0"), F.col("f1"), F.col("f2"), F.pow(F.greatest("f1", F.lit(0.0)), F.lit(2.0))]
    dot = sum((float(w) * c for w, c in zip(model.weights, z, strict=True)), F.lit(0.0))
    s = 1 / (1 + F.exp(-F.least(F.greatest(dot, F.lit(-30.0)), F.lit(30.0))))
    return _featured(docs, model, text, keep).select(*keep, s.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
