"""Toxicity by compression distance: windows of a text are compressed under two zstandard dictionaries.

Both dictionaries begin with the same base, which zstandard's own trainer makes of windows of the ordinary training
texts, so that ordinary language costs the same under either. Then, nearest to the data, follows what each class's own texts
add: segments of ``SEGMENT`` bytes cut from them by cover selection, as the trainer does it, but with every run of
``GRAM`` bytes scored by how much more often the class's texts have it than the other's (standard errors of the log
ratio, ``LEAST_Z`` or more); the segment with the greatest sum of runs not covered yet comes first. Only bytes of the
texts are looked at: no words are listed.

A window is ``WINDOW_WORDS`` consecutive words; its distance is its compressed length under the ordinary dictionary
less that under the toxic one. A text's distances (greatest, mean of the greatest three, mean, share and number of
windows over two thresholds, number of windows) are calibrated to a probability by logistic regression on a fold whose
texts are in neither dictionary; the thresholds and the size of the segments' part are those that fit that fold best.
Learned from at most ``SAMPLE`` labelled rows; scores see whole texts, a window at a time.

Defined results: null and empty texts, and texts of white space, have no windows and score as a text of distances 0;
without labels of both classes every score is the share of toxic labels (0 without any); equal texts score equally.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import text_column
from wayfare.llm.sampling import fold, fold_of, labelled

SAMPLE = 6_000
WINDOW_WORDS = 12
BASE_BYTES, BASE_WINDOWS = 1 << 16, 30_000
GRAM, SEGMENT, LEAST_Z = 6, 12, 3.0
#: Sizes that the part of own segments may have, and pairs of window thresholds.
OWN_BYTES = (256, 384, 512, 768)
THRESHOLDS = ((2, 3), (2, 4), (3, 5))
#: Places of a run of bytes that are tried for a segment.
PLACES = 32


def padded(text: str) -> bytes:
    """The words of a text, a space before, between and after them."""
    return (" " + " ".join(text.split()) + " ").encode()


def windows(text: str) -> list[bytes]:
    words = text.split()
    return [(" " + " ".join(words[i : i + WINDOW_WORDS]) + " ").encode() for i in range(0, len(words), WINDOW_WORDS)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content.rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(3, source_size=96, dict_size=len(content), min_match=5, strategy=zstandard.STRATEGY_LAZY, search_log=6, write_checksum=False, write_content_size=False, write_dict_id=False)
    data.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=how)


def grams(raw: bytes) -> np.ndarray:
    """All runs of GRAM bytes as numbers."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint64)
    out = np.zeros(max(len(a) - GRAM + 1, 0), np.uint64)
    for i in range(GRAM if len(out) else 0):
        out = (out << np.uint64(8)) | a[i : i + len(out)]
    return out


def text_counts(texts: list[bytes], at_once: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes, ascending, and the number of texts that have each."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at in range(0, len(texts), at_once):
        own, n = np.unique(np.concatenate([np.unique(grams(t)) for t in texts[at : at + at_once]]), return_counts=True)
        both, place = np.unique(np.concatenate([keys, own]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)
        keys = both
    return keys, counts


def contrasts(own: tuple, other: tuple, n_own: int, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs that texts of the one class have more often, and by how many standard errors of the log ratio."""
    keys, a = own
    at = np.minimum(np.searchsorted(other[0], keys), max(len(other[0]) - 1, 0))
    b = np.where(other[0][at] == keys, other[1][at], 0) if len(other[0]) else np.zeros(len(keys))
    z = (np.log((a + 0.5) / (n_own + 1)) - np.log((b + 0.5) / (n_other + 1))) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    told = z >= LEAST_Z
    return keys[told], z[told]


def segments(texts: list[bytes], keys: np.ndarray, score: np.ndarray, most: int) -> list[bytes]:
    """Segments of the texts, best first, at most ``most`` bytes of them: cover selection over the scored runs."""
    places: list[list[tuple[int, int]]] = [[] for _ in keys]
    for t, raw in enumerate(texts):
        g = grams(raw)
        at = np.minimum(np.searchsorted(keys, g), max(len(keys) - 1, 0))
        for p in np.flatnonzero(keys[at] == g).tolist() if len(keys) else ():
            if len(places[at[p]]) < PLACES:
                places[at[p]].append((t, p))
    score = score.copy()
    out: list[bytes] = []
    for k in np.argsort(-score, kind="stable").tolist():
        if score[k] <= 0:
            continue  # covered by a segment already
        if (len(out) + 1) * SEGMENT > most:
            break
        best, chosen, covered = -1.0, b"", np.zeros(0, np.int64)
        for t, p in places[k]:
            begin = max(0, min(p - (SEGMENT - GRAM) // 2, len(texts[t]) - SEGMENT))
            piece = texts[t][begin : begin + SEGMENT]
            own = grams(piece)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            held = np.unique(at[keys[at] == own])
            if score[held].sum() > best:
                best, chosen, covered = float(score[held].sum()), piece, held
        out.append(chosen)
        score[covered] = 0
    return out


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> list[tuple[bytes, bytes]]:
    """A pair of dictionaries (toxic, ordinary) for each of OWN_BYTES that differ."""
    every = [w for t in ordinary for w in windows(t)]
    every = every[:: -(-len(every) // BASE_WINDOWS)] if every else []
    try:
        base = zstandard.train_dictionary(BASE_BYTES, every).as_bytes()
    except zstandard.ZstdError:  # too few windows to train on: the windows themselves
        base = b"".join(every)[:BASE_BYTES]
    texts = [[padded(t) for t in own] for own in (toxic, ordinary)]
    counted = [text_counts(t) for t in texts]
    own = [segments(texts[i], *contrasts(counted[i], counted[1 - i], len(texts[i]), len(texts[1 - i])), max(OWN_BYTES)) for i in (0, 1)]
    out = []
    for most in OWN_BYTES:
        # the best segments come last, nearest to the data
        parts = [b"".join(reversed(o[: most // SEGMENT])) for o in own]
        size = max(map(len, parts))
        pair = tuple(base + p.rjust(size, b" ") for p in parts)
        if size and pair not in out:
            out.append(pair)
    return out


class Distances:
    """Window distances under a pair of dictionaries."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.toxic, self.ordinary = (_compressor(d) for d in dictionaries)

    def of(self, text: str) -> np.ndarray:
        toxic, ordinary = self.toxic.compress, self.ordinary.compress
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], np.int32)


LEVELS = sorted({t for pair in THRESHOLDS for t in pair})


def text_features(d: np.ndarray) -> list[float]:
    if not len(d):
        return [0.0] * (4 + 2 * len(LEVELS))
    top = np.sort(d)[::-1][:3]
    over = [int((d >= t).sum()) for t in LEVELS]
    return [float(top[0]), float(top.mean()), float(d.mean()), float(np.log1p(len(d))), *[x for k in over for x in (k / len(d), float(np.log1p(k)))]]


def _columns(pair: tuple[int, int]) -> list[int]:
    return [0, 1, 2, 3, *[4 + 2 * LEVELS.index(t) + i for t in pair for i in (0, 1)]]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Newton's method on standardised columns: (mean, scale, weights with the intercept last, loss)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    keep = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return mean, scale, w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


class ToxicityModel:
    def __init__(self, dictionaries: tuple[bytes, bytes] | None, thresholds: tuple[int, int], mean, scale, weights, share: float):
        self.dictionaries, self.thresholds, self.mean, self.scale, self.weights, self.share = dictionaries, thresholds, mean, scale, weights, share

    @classmethod
    def train(cls, rows: list) -> ToxicityModel:
        """From (doc_id, text, label) rows: a quarter, by another hash of the id, calibrates, the rest make dictionaries."""
        share = float(np.mean([r.label for r in rows])) if rows else 0.0
        inner = [fold_of(f"{r.doc_id}:calibrate") == 0 or fold_of(f"{r.doc_id}:calibrate") == 1 for r in rows]
        made = [r for r, i in zip(rows, inner, strict=True) if not i]
        kept = [r for r, i in zip(rows, inner, strict=True) if i]
        y = np.array([r.label for r in kept], float)
        toxic, ordinary = ([r.text for r in made if r.label == v] for v in (1, 0))
        if not toxic or not ordinary or y.sum() in (0, len(y)):
            return cls(None, THRESHOLDS[0], None, None, None, share)
        best = None
        for dictionaries in train_dictionaries(toxic, ordinary):
            far = Distances(dictionaries)
            x = np.array([text_features(far.of(r.text)) for r in kept])
            for pair in THRESHOLDS:
                fit = fit_logistic(x[:, _columns(pair)], y)
                if best is None or fit[3] < best[0]:
                    best = (fit[3], dictionaries, pair, fit)
        if best is None:
            return cls(None, THRESHOLDS[0], None, None, None, share)
        return cls(best[1], best[2], *best[3][:3], share)

    def score(self, far: Distances | None, texts: list[str]) -> np.ndarray:
        if self.dictionaries is None or not texts:
            return np.full(len(texts), self.share)
        x = np.array([text_features(far.of(t)) for t in texts])[:, _columns(self.thresholds)]
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1) for every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))

    def run(batches):
        far = Distances(model.dictionaries) if model.dictionaries else None
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(far, batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return base.mapInArrow(run, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    return ToxicityModel.train(labelled(docs, labels, "toxic", sample, folds=(1, 2, 3, 4)))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows are never read."""
    out = toxicity(docs, train(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
