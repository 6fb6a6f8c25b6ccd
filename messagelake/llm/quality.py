"""Quality classifier: histogram gradient-boosted trees over document statistics, as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, text_buffers
from .textscan import FOLD, LETTERS, NOT_SPACE, fold_doc, prefix, runs, stretch

#: Labelled rows that a model is fitted on, at most; those whose ids have the smallest hashes.
TRAIN_ROWS = 20_000

FEATURES = (
    "log_bytes", "log_words", "mean_word", "spread_word", "short_words", "long_words", "space", "newline", "digit", "upper", "wide",
    "stop", "comma", "other_mark", "mark_runs", "distinct_words", "top_word", "mean_line", "longest_line", "distinct_lines", "bare_words", "mixed_words",
)

_CLASS = np.full(256, 8, np.int64)  # other marks
_CLASS[[32, 9, 11, 12, 13]] = 0
_CLASS[10] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[128:] = 5
_CLASS[[ord(c) for c in ".!?"]] = 6
_CLASS[[ord(c) for c in ",;:"]] = 7
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False
_MARKS = (_CLASS == 8) | (_CLASS == 6) | (_CLASS == 7)


def _most_common(text: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values each text has, and how often its most frequent one occurs."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(values):
        order = np.argsort(fold_doc(text, values))
        told, owner = fold_doc(text, values)[order], text[order]
        first = np.flatnonzero(np.concatenate([[True], told[1:] != told[:-1]]))
        distinct += np.bincount(owner[first], minlength=n)
        np.maximum.at(top, owner[first], np.diff(np.append(first, len(told))))
    return distinct, top


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text, from all its bytes. An empty text has zeros."""
    n = len(at) - 1
    size = np.diff(at).astype(float)
    text = np.repeat(np.arange(n), np.diff(at))
    classes = np.bincount(text * 9 + _CLASS[data], minlength=9 * n).reshape(n, 9)
    of = np.maximum(size, 1)
    sums = prefix(FOLD[data])

    first, last, owner = runs(data, at, NOT_SPACE)
    words = np.bincount(owner, minlength=n).astype(float)
    per = np.maximum(words, 1)
    length = (last - first).astype(float)
    mean = np.bincount(owner, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / per - mean**2, 0))
    distinct, top = _most_common(owner, stretch(sums, first, last), n)
    bare = np.bincount(owner, LETTERS[data[last - 1]] & LETTERS[data[first]], n)
    ends = LETTERS[data[first]] & (_CLASS[data[last - 1]] == 8) if len(first) else first.astype(bool)
    mixed = np.bincount(owner, ends, n)

    low, high, row = runs(data, at, _NOT_NEWLINE)
    lines = np.bincount(row, minlength=n).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, row, high - low)
    distinct_lines, _ = _most_common(row, stretch(sums, low, high), n)
    mark, unmark, marked = runs(data, at, _MARKS)
    mark_runs = np.bincount(marked, unmark - mark >= 2, n)

    share = classes / of[:, None]
    return np.stack(
        [
            np.log1p(size), np.log1p(words), mean, spread, np.bincount(owner, length <= 3, n) / per, np.bincount(owner, length > 12, n) / per,
            share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 5], share[:, 6], share[:, 7], share[:, 8], mark_runs / per,
            distinct / per, top / per, size / np.maximum(lines, 1), np.log1p(longest), distinct_lines / np.maximum(lines, 1), bare / per, mixed / per,
        ],
        axis=1,
    ).astype(np.float32)


@dataclass
class Forest:
    """Trees of one depth as arrays: node k of a tree has its children at 2k + 1 and 2k + 2; leaves follow the inner nodes."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # to the right if the value is larger
    value: np.ndarray  # trees x leaves
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.1, ridge: float = 2.0, least: float = 10.0) -> Forest:
    """Boosts logistic loss: each level adds up gradients by node, feature and bin, and splits where the gain is largest."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(m)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(m)], 1)  # value > cut[b] means bin > b
    base = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(base / (1 - base)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, limit, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin = np.full(n, start)
    flat = binned + np.arange(m) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            place = ((node - width + 1)[:, None] * (m * bins) + flat).ravel()
            g = np.bincount(place, np.repeat(grad, m), width * m * bins).reshape(width, m, bins)
            h = np.bincount(place, np.repeat(hess, m), width * m * bins).reshape(width, m, bins)
            gl, hl = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
            gt, ht = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least * 0.1) | (ht - hl < least * 0.1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins - 1)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[t, width - 1 + k], limit[t, width - 1 + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > limit[t, node])
        g = np.bincount(node - inner, grad, leaves)
        value[t] = rate * g / (np.bincount(node - inner, hess, leaves) + ridge)
        margin += value[t, node - inner]
    return Forest(feature, limit, value, start)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, **options) -> Forest:
    """A forest fitted on labelled texts, at most `rows` of them, taken by the smallest hashes of their ids.

    The sample's ids are broadcast, as their number is bounded; statistics are computed where the texts are.
    Null labels and ids are left out; null and empty texts count as empty; without rows the score is 0.5.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).dropna().orderBy(F.xxhash64("id"), "y").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch["text"])
            for low, high in steps(at, 2 << 20):
                x = statistics(data[at[low] : at[high]], at[low : high + 1] - at[low])
                yield pa.RecordBatch.from_arrays([batch["id"].slice(low, high - low).cast(pa.string()), pa.array(list(x.astype(float)), pa.list_(pa.float64())), batch["y"].slice(low, high - low)], ["id", "x", "y"])

    found = texts.mapInArrow(run, "id string, x array<double>, y double").orderBy("id", "y").toPandas()
    x = np.array(found.x.tolist(), np.float32).reshape(-1, len(FEATURES))
    return fit_forest(x, found.y.to_numpy(float), **options)


def score_quality(docs: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds `score`, 0 to 1, to every row from its whole text; all columns of the input stay.

    Null and empty texts have the score of a row of zeros. Equal texts have equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = docs.drop("score").schema
    text_at = kinds.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(text_at).cast(pa.string()))
            scores = [sent.value.score(statistics(data[at[low] : at[high]], at[low : high + 1] - at[low])) for low, high in steps(at, 2 << 20)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], [*batch.schema.names, "score"])

    return docs.drop("score").mapInArrow(run, kinds.add("score", "double"))
