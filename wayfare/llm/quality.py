"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = logistic(s(text) - threshold_k) for ordered thresholds and one score s, the same for all grades:
a sum of weights of hashed features, averaged over the text's words. A word's features are its hash, its shape (the
kinds of its first and last byte, and its length), whether it repeats the word before, and its shape with that
of the word before. Weights and the gaps between thresholds are fitted together by full-batch Adam on at most
``SAMPLE`` rated rows with an L2 penalty; scoring reads whole texts, as arrays, a few passes over their bytes.

From the thresholds follow the expected grade and the probability of each grade or better; a text is kept when the
probability of ``least`` or better is at least ``keep``. Defined results: null and wordless texts have score 0 from
words and the model's intercept alone; without ratings, or with one grade only, everything is kept and the expected
grade is that grade (0 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm import textnum
from wayfare.llm.common import frugal, put_together, text_apart, text_column, with_fields
from wayfare.llm.sampling import labelled

SAMPLE = 4_000
LOG_FEATURES = 16
SLICE_BYTES = 1 << 21
STEPS = 200
RATE = 0.05
PENALTY = 1e-5
SCALE = 30.0
KEEP = 0.5

_KIND = np.zeros(256, np.uint64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[33:48], _KIND[58:65], _KIND[91:97], _KIND[123:127] = (np.arange(5, 20), np.arange(20, 27), np.arange(27, 33), np.arange(33, 37))


def features(words: textnum.Words) -> list[np.ndarray]:
    """For each word, the places of its features among 2 ** LOG_FEATURES."""
    h = words.hashes(folded=True)
    n = len(h)
    if not n:
        return [np.zeros(0, np.int64)] * 4
    first, last = _KIND[words.raw[words.starts]], _KIND[words.raw[words.ends - 1]]
    size = np.minimum(words.ends - words.starts, 24).astype(np.uint64)
    shape = (first << np.uint64(16)) | (last << np.uint64(8)) | size
    before = np.zeros(n, np.uint64)
    before[1:] = (first[:-1] << np.uint64(8)) | last[:-1]
    begins = words.first[:-1][words.first[:-1] < n]
    before[begins] = 0xFFFF
    repeat = np.zeros(n, np.uint64)
    repeat[1:] = h[1:] == h[:-1]
    repeat[begins] = 2
    out = []
    for salt, x in enumerate((h, shape, repeat, (before << np.uint64(16)) | (first << np.uint64(8)) | last)):
        out.append((textnum.mix(x + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - LOG_FEATURES)).astype(np.int64))
    return out


def scores(words: textnum.Words, weights: np.ndarray) -> np.ndarray:
    """Mean over each text's words of the sum of their features' weights."""
    total = np.zeros(len(words.starts) + 1)
    np.cumsum(sum(weights[f] for f in features(words)), out=total[1:])
    counts = np.diff(words.first)
    return SCALE * (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(counts, 1)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all texts, made a few texts at a time: what stays is 10 bytes an entry."""
    rows, places, values = [], [], []
    at = 0
    while at < len(texts):
        raw, size, end = [], 0, at
        while end < len(texts) and (end == at or size < SLICE_BYTES // 4):
            raw.append(texts[end].encode())
            size += len(raw[-1])
            end += 1
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        words = textnum.Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        counts = np.maximum(np.diff(words.first), 1)
        key, times = np.unique(np.tile(words.texts(), 4) * (1 << LOG_FEATURES) + np.concatenate(features(words)), return_counts=True)
        row = key >> LOG_FEATURES
        rows.append((row + at).astype(np.int32))
        places.append((key & ((1 << LOG_FEATURES) - 1)).astype(np.uint16))
        values.append((SCALE * times / counts[row]).astype(np.float32))
        at = end
    return np.concatenate(rows), np.concatenate(places), np.concatenate(values)


def thresholds_of(params: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, and gaps that are positive by their softplus."""
    at = 1 << LOG_FEATURES
    return params[at] + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, params[at + 1 :]))])


def loss(params: np.ndarray, entries: tuple, above: np.ndarray) -> float:
    """Mean over texts of the log losses at all thresholds, and the penalty on the weights."""
    row, feature, value = entries
    s = np.bincount(row, value * params[feature], len(above))
    z = s[:, None] - thresholds_of(params)
    return float((np.logaddexp(0, z) - above * z).sum() / len(above) + PENALTY / 2 * (params[: 1 << LOG_FEATURES] ** 2).sum())


def slope(params: np.ndarray, entries: tuple, above: np.ndarray) -> np.ndarray:
    """The gradient of the loss."""
    row, feature, value = entries
    size = 1 << LOG_FEATURES
    s = np.bincount(row, value * params[feature], len(above))
    wrong = (_logistic(s[:, None] - thresholds_of(params)) - above) / len(above)
    by_weight = np.bincount(feature, value * wrong.sum(axis=1)[row], size) + PENALTY * params[:size]
    gaps = [-wrong[:, k:].sum() * _logistic(params[size + k]) for k in range(1, above.shape[1])]
    return np.concatenate([by_weight, [-wrong.sum()], gaps])


class OrdinalModel:
    """Grades 0 .. K - 1 with K - 1 ordered thresholds; ``grades`` are the ratings they stand for, ascending."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[int]):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    @classmethod
    def train(cls, texts: list[str], ratings: list[int], steps: int = STEPS) -> OrdinalModel:
        grades = sorted(set(ratings))
        if len(grades) < 2:
            return cls(np.zeros(1 << LOG_FEATURES), np.zeros(0), grades or [0])
        entries = _sparse(texts)
        above = np.searchsorted(grades, ratings)[:, None] > np.arange(len(grades) - 1)  # each threshold is a question that all texts answer
        share = above.mean(axis=0).clip(1e-3, 1 - 1e-3)
        first = -np.log(share[0] / (1 - share[0]))
        gaps = np.diff(-np.log(share / (1 - share))).clip(1e-2)
        params = np.concatenate([np.zeros(1 << LOG_FEATURES), [first], np.log(np.expm1(gaps))])
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, steps + 1):
            down = slope(params, entries, above)
            m, v = 0.9 * m + 0.1 * down, 0.999 * v + 0.001 * down**2
            params = params - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(params[: 1 << LOG_FEATURES], thresholds_of(params), grades)

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, descending along k."""
        return _logistic(s[:, None] - self.thresholds)


def _judged(batches, model: OrdinalModel, least: int | None):
    """(rows, expected grade, probability of ``least`` or better) of a few rows at a time."""
    grades = np.array(model.grades, float)
    at = len(grades) - 1 if least is None else int(np.searchsorted(grades, least))
    for batch in batches:
        for part in textnum.slices(batch, "text", SLICE_BYTES):
            s = scores(textnum.Words(*textnum.buffers(part.column("text"))), model.weights)
            tails = model.tails(s)
            yield part, grades[0] + tails @ np.diff(grades), tails[:, at - 1] if at else np.ones(len(s))


def grade(docs: DataFrame, model: OrdinalModel, least: int | None = None, keep: float = KEEP, with_text: bool = True) -> DataFrame:
    """docs with expected_grade, tail_probability (of ``least``, the best grade unless given, or better) and kept, in place
    of columns of these names; without its text if that is not wanted."""
    own = [c for c in docs.columns if c not in ("expected_grade", "tail_probability", "kept")]
    base = text_apart(docs, own)
    names = ["row", "text"] if with_text else ["row"]
    made = ["expected_grade", "tail_probability", "kept"]

    def run(batches):
        for part, expected, tail in _judged(batches, model, least):
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= keep, pa.bool_())], names=[*names, *made])

    schema = with_fields(base.schema["row"], "text string, " * with_text + "expected_grade double, tail_probability double, kept boolean")
    return base.mapInArrow(frugal(run), schema).select(*put_together(own, with_text), *made)


def kept_rows(docs: DataFrame, model: OrdinalModel, least: int | None = None, keep: float = KEEP) -> DataFrame:
    """The rows of docs that ``grade`` keeps, all columns as they are; the others do not come back from Python."""
    base = text_apart(docs, docs.columns)

    def run(batches):
        for part, _, tail in _judged(batches, model, least):
            yield part.filter(pa.array(tail >= keep, pa.bool_()))

    return base.mapInArrow(frugal(run), base.schema).select(*put_together(docs.columns))


def train(docs: DataFrame, labels: DataFrame, rating: str = "quality", sample: int = SAMPLE, folds: tuple[int, ...] | None = None) -> OrdinalModel:
    rows = labelled(docs, labels, rating, sample, folds)
    return OrdinalModel.train([r.text for r in rows], [r.label for r in rows])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept for every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return grade(rows, train(docs, labels), with_text=False)
