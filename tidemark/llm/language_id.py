"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths run over windows of a fixed number of bytes; each filter's maximum over the window, rectified, goes
to a softmax over the languages. The whole text is covered by windows, and the mean of their log-probabilities decides.

The network learns from a bounded sample (`SAMPLE_DOCS` labelled documents, spread evenly over the languages and picked by a
hash of the id, and `SAMPLE_WINDOWS` windows of each). A row of counts for each label reaches the driver, and windows of eight
documents of each at least: labels are names of languages, so they are few. Predictions use the text alone. A null text, or one
without a letter, gives `und` with score 0; so does everything where no labelled row exists. Very long texts are read whole, window
by window; repeated rows are predicted each; an empty table gives no rows. Ties go to the first language in order. Columns named
lang_pred and score are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_texts, extend

WINDOW = 256
WIDTHS = (2, 4, 6)
FILTERS = 12
SAMPLE_DOCS = 4000
SAMPLE_WINDOWS = 4
EPOCHS = 6
#: Windows that are scored at once.
BLOCK = 512
UNDETERMINED = "und"


@dataclass
class Network:
    languages: list[str]
    #: One table for each width: [offset, byte, filter].
    taps: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pairs(self) -> list[np.ndarray]:
        """Tables over pairs of bytes, half as many look-ups: [offset / 2, first * 256 + second, filter]."""
        return [np.stack([(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, len(t), 2)]).astype(np.float32) for t in self.taps]


def windows_of(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """The whole text in rows of `size` bytes; the last is filled with zeros."""
    x = np.frombuffer(raw, np.uint8)
    n = -(-len(x) // size)
    out = np.zeros(n * size, np.uint8)
    out[: len(x)] = x
    return out.reshape(n, size)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def log_probabilities(net: Network, pairs: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Of each language for each window."""
    both = rows[:, :-1].astype(np.uint16) * 256 + rows[:, 1:]
    pooled = []
    for table in pairs:
        n = both.shape[1] - 2 * (len(table) - 1)
        total = table[0][both[:, :n]]
        for j in range(1, len(table)):
            total += table[j][both[:, 2 * j : 2 * j + n]]
        pooled.append(total.max(axis=1))
    hidden = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0)
    return _log_softmax(hidden @ net.out + net.out_bias)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam over shuffled batches; the gradient of max pooling reaches the bytes under the largest response alone."""
    rng = np.random.default_rng(seed)
    classes, hidden_size = len(languages), FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(hidden_size, np.float32), rng.normal(0, 0.3, (hidden_size, classes)).astype(np.float32), np.zeros(classes, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 128):
            rows, want = windows[order[at : at + 128]], labels[order[at : at + 128]]
            pooled, where = [], []
            for taps, w in zip(params[:3], WIDTHS, strict=True):
                n = rows.shape[1] - w + 1
                total = taps[0][rows[:, :n]]
                for j in range(1, w):
                    total += taps[j][rows[:, j : j + n]]
                where.append(total.argmax(axis=1))
                pooled.append(np.take_along_axis(total, where[-1][:, None, :], axis=1)[:, 0])
            z = np.concatenate(pooled, axis=1) + params[3]
            hidden = np.maximum(z, 0)
            error = np.exp(_log_softmax(hidden @ params[4] + params[5]))
            error[np.arange(len(want)), want] -= 1
            error /= len(want)
            back = (error @ params[4].T) * (z > 0)
            grads = [np.zeros_like(p) for p in params[:3]] + [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            line, unit = np.arange(len(rows))[:, None], np.arange(FILTERS)[None, :]
            for g, (w, at_most) in enumerate(zip(WIDTHS, where, strict=True)):
                part = back[:, g * FILTERS : (g + 1) * FILTERS]
                for j in range(w):
                    np.add.at(grads[g][j], (rows[line, at_most + j], np.broadcast_to(unit, at_most.shape)), part)
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(languages, params[:3], params[3], params[4], params[5])


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """A network from the labelled rows, or None if there are none."""
    rows = labelled.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("h"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = max(8, sample_docs // len(counts))
    part = F.element_at(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, share / n)))), F.col("lang"))
    size = F.octet_length("text")
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: F.floor(i * F.greatest(size - WINDOW, F.lit(0)) / max(1, SAMPLE_WINDOWS - 1)).cast("int")))
    raw = F.col("text").cast("binary")
    bounded = rows.where(F.pmod("h", F.lit(1 << 20)) < part * (1 << 20)).orderBy("h").limit(2 * sample_docs + 8 * len(counts))
    picked = bounded.select("lang", F.transform(starts, lambda s: F.substring(raw, s + 1, F.lit(WINDOW))).alias("w")).collect()
    languages = sorted(counts)
    if not picked:  # so few rows that the hash left none out of chance
        picked = rows.orderBy("h").limit(sample_docs).select("lang", F.transform(starts, lambda s: F.substring(raw, s + 1, F.lit(WINDOW))).alias("w")).collect()
    windows = np.concatenate([windows_of(bytes(w))[:1] for r in picked for w in r["w"]])
    labels = np.array([languages.index(r["lang"]) for r in picked for _ in r["w"]])
    return train(windows, labels, languages)


def _has_letter(raw: bytes) -> bool:
    """bytes.swapcase() changes a text just if it holds an ASCII letter."""
    return raw.swapcase() != raw or any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def predict(docs: DataFrame, net: Network | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score, the probability of the language named; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    tables: list = []

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        net, raws = shared.value, byte_texts(batch.column(text))
        langs, scores = [UNDETERMINED] * len(raws), np.zeros(len(raws))
        able = [i for i, raw in enumerate(raws) if net is not None and _has_letter(raw)]
        if able:
            if not tables:
                tables.append(net.pairs())
            parts = [windows_of(raws[i]) for i in able]
            sizes = np.array([len(p) for p in parts])
            rows = np.concatenate(parts)
            logs = np.concatenate([log_probabilities(net, tables[0], rows[a : a + BLOCK]) for a in range(0, len(rows), BLOCK)])
            # A window counts by its bytes, so that a short last one weighs little.
            weight = np.full(len(rows), float(WINDOW))
            ends = np.cumsum(sizes)
            weight[ends - 1] = [max(1, len(raws[i]) - (n - 1) * WINDOW) for i, n in zip(able, sizes, strict=True)]
            mean = np.add.reduceat(logs * weight[:, None], ends - sizes, axis=0) / np.add.reduceat(weight, ends - sizes)[:, None]
            p = np.exp(_log_softmax(mean))
            for i, best, q in zip(able, p.argmax(axis=1), p.max(axis=1), strict=True):
                langs[i], scores[i] = net.languages[best], float(q)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return extend(docs, text, {"lang_pred": "string", "score": "double"}, run, keep)


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))
