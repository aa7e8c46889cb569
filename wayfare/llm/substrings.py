"""Substring dedup: words covered by a window of words that occurs earlier in the corpus are removed.

Method: a count-min prefilter. Texts travel in units (``units``); the units' sketches of window hashes are merged by
cell range (``sketch``) and only windows whose estimate is two or more go on; as estimates never fall short, no
repeated window is lost. The second pass groups those by 128 bits, two 64-bit hashes of their words that have nothing
in common (other byte values, other base): each unit keeps, of its own equal windows, the earliest, and sends that one
alone to the group's segment, so a window that a third of the corpus holds costs a segment one entry a unit. Segments
answer with the places that are not the earliest, and the answers meet the texts in their units. The texts are shuffled
once; the sketch grows with the input, so the prefilter rejects the same share of windows at any size.

Order is by doc_id, then by the window's first word. Defined results: null text has no words; texts shorter than a
window keep all; rows without doc_id come before all others, as one document; rows that share a doc_id are one document
for the order, so windows at the same place in equal rows do not remove each other; extra columns are not read.
Windows are held to be equal by their 128 bits; with n windows, chance makes two others equal once in 2**129 / n**2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm import sketch, textnum, units
from wayfare.llm.common import text_column

WINDOW = 20
SEGMENT_WINDOWS = 1_500_000
NO_ID = np.int64(np.iinfo(np.int64).min)
ENTRY = (("h1", np.uint64), ("h2", np.uint64), ("ord", np.int64), ("dup", np.int64), ("start", np.uint32), ("length", np.uint32))
ENTRY_DDL = "segment long, " + ", ".join(f"{c} binary" for c, _ in ENTRY)
ENTRY_SCHEMA = pa.schema([("segment", pa.int64()), *((c, pa.binary()) for c, _ in ENTRY)])


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight together: high ones are mostly equal, and shuffles compress them away."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _from_planes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _row(segment: int, entry: dict[str, np.ndarray]) -> tuple:
    return (segment, *(_planes(entry[c].astype(t)) for c, t in ENTRY))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] + [pa.binary()] * len(ENTRY)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["segment"] + [c for c, _ in ENTRY])


def _order(ord_: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places of (ord, start) pairs in their order; equal pairs have equal places."""
    _, rank = np.unique(ord_, return_inverse=True)
    return (rank.astype(np.uint64) << np.uint64(32)) | start.astype(np.uint64)


def _earliest(h1: np.ndarray, h2: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Mask of the entries that no other of the same hashes comes before."""
    if not len(h1):
        return np.zeros(0, bool)
    by = np.argsort(h1)
    new = np.empty(len(by), bool)
    new[0] = True
    a, b = h1[by], h2[by]
    np.not_equal(a[1:], a[:-1], out=new[1:])
    if np.any(~new[1:] & (b[1:] != b[:-1])):  # one h1 with two h2: sort by both
        by = np.lexsort((h2, h1))
        a, b = h1[by], h2[by]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(order[by], at)
    first = np.empty(len(by), bool)
    first[by] = order[by] == np.repeat(least, np.diff(at, append=len(by)))
    return first


def _ordinals(batch: pa.RecordBatch) -> np.ndarray:
    return np.ascontiguousarray(batch.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64))


def _keys(words: textnum.Words, k: int) -> np.ndarray:
    return textnum.runs(words.hashes(), words.first, k)[0]


def _answers(entry: dict[str, np.ndarray], segments: int, buckets: int):
    """Rows of places to remove, by bucket; consecutive places of a text become one run."""
    by = np.lexsort((entry["start"], entry["dup"], entry["ord"]))
    e = {c: v[by] for c, v in entry.items()}
    n = len(by)
    if not n:
        return
    joined = np.zeros(n, bool)
    joined[1:] = (e["ord"][1:] == e["ord"][:-1]) & (e["dup"][1:] == e["dup"][:-1]) & (e["start"][1:].astype(np.int64) == e["start"][:-1].astype(np.int64) + 1)
    at = np.flatnonzero(~joined)
    runs = {c: e[c][at] for c in ("ord", "dup", "start")} | {"length": np.diff(at, append=n), "h1": np.zeros(0), "h2": np.zeros(0)}
    bucket = units.unit_of(runs["ord"], runs["dup"], buckets)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        own = by[cuts[b] : cuts[b + 1]]
        yield _row(segments + int(b), {c: (v[own] if len(v) else v) for c, v in runs.items()})


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space), a row per row of docs."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    size = base.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    n_bytes = size.b or 0
    shared = base.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    # rows of one doc_id, or of none, are told apart by their text
    same_id = size.n and shared.limit(1).count()
    text_mark = F.shiftleft(F.xxhash64("text"), 1) if same_id else F.lit(0).cast("long")
    base = base.withColumn("dup", text_mark + F.col("doc_id").isNull().cast("long"))

    parts = units.unit_count(n_bytes)
    segments = max(1, n_bytes // 6 // SEGMENT_WINDOWS + 1)

    def packed(batches):
        for batch in batches:
            ord_, dup = _ordinals(batch), np.ascontiguousarray(batch.column("dup").to_numpy())
            yield units.pack(units.unit_of(ord_, dup, parts), ord_, dup, batch.column("text"))

    texts = base.mapInArrow(packed, units.DDL).repartition(units.partitions(parts), "unit")
    counts = sketch.Sketch(n_bytes // 6 + 1, (2,))

    def keys_of(group: pa.Table) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(_keys(words, window) for _, _, words in units.unpack(group))])

    levels = sketch.answered(texts, "unit", keys_of, counts)

    def candidates(unit: pa.Table, answers: pa.Table) -> pa.Table:
        """Entries of windows that may be repeated, by segment, and places that an earlier window of the unit removes."""
        none = pa.Table.from_batches([], schema=ENTRY_SCHEMA)
        if not unit.num_rows:
            return none
        every = list(units.unpack(unit))
        hot = counts.levels(np.concatenate([np.zeros(0, np.uint64), *(_keys(words, window) for _, _, words in every)]), answers) > 0
        held, at = [], 0
        for ord_, mark, words in every:
            h, place = textnum.runs(words.hashes(), words.first, window)
            own = hot[at : at + len(h)]
            at += len(h)
            if own.any():
                h2, _ = textnum.runs(words.hashes(salt=1), words.first, window, textnum.RUN_BASE_2)
                doc = words.texts()[place[own]]
                held.append((h[own], h2[own], ord_[doc], mark[doc], (place[own] - words.first[doc]).astype(np.uint32)))
        if not held:
            return none
        h, h2, ord_, dup, start = (np.concatenate(x) for x in zip(*held, strict=True))
        first = _earliest(h, h2, _order(ord_, start))
        rest = ~first
        rows = list(_answers({"ord": ord_[rest], "dup": dup[rest], "start": start[rest]}, segments, parts))
        own = (h[first] % np.uint64(segments)).astype(np.int64)
        by = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[by], np.arange(segments + 1))
        entry = {"h1": h[first], "h2": h2[first], "ord": ord_[first], "dup": dup[first], "start": start[first], "length": np.zeros(0)}
        for s in np.flatnonzero(np.diff(cuts)):
            at = by[cuts[s] : cuts[s + 1]]
            rows.append(_row(int(s), {c: (v[at] if len(v) else v) for c, v in entry.items()}))
        return pa.Table.from_batches([_batch(rows)]) if rows else none

    def exact(group: pa.Table) -> pa.Table:
        segment = group.column("segment")[0].as_py()
        if segment >= segments:  # answers on their way to their unit
            return group
        entry = {c: np.concatenate([_from_planes(b, t) for b in group.column(c).to_pylist()]) for c, t in ENTRY if c != "length"}
        rest = ~_earliest(entry["h1"], entry["h2"], _order(entry["ord"], entry["start"]))
        rows = list(_answers({c: v[rest] for c, v in entry.items()}, segments, parts))
        return pa.Table.from_batches([_batch(rows)]) if rows else group.slice(0, 0)

    sent = texts.groupBy("unit").cogroup(levels.groupBy("unit")).applyInArrow(candidates, ENTRY_DDL)
    answers = sent.groupBy("segment").applyInArrow(exact, ENTRY_DDL).select((F.col("segment") - segments).alias("unit"), *[c for c, _ in ENTRY])

    def kept(unit: pa.Table, away: pa.Table) -> pa.Table:
        answer = {c: np.concatenate([_from_planes(b, t) for b in away.column(c).to_pylist()] or [np.zeros(0, t)]) for c, t in ENTRY if c[0] != "h"}
        by = np.lexsort((answer["dup"], answer["ord"]))
        answer = {c: v[by] for c, v in answer.items()}
        key = np.stack([answer["ord"], answer["dup"].astype(np.int64)], axis=1)
        new = np.ones(len(key), bool)
        new[1:] = np.any(key[1:] != key[:-1], axis=1)
        begins = np.flatnonzero(new)
        of = {(int(key[a, 0]), int(key[a, 1])): (a, b) for a, b in zip(begins.tolist(), np.append(begins[1:], len(key)).tolist(), strict=False)}
        out: list[tuple] = []
        for ords, marks, words in units.unpack(unit):
            edge = np.zeros(len(words.starts) + 1, np.int64)
            for i, (o, mark) in enumerate(zip(ords.tolist(), marks.tolist(), strict=True)):
                a, b = of.get((o, mark), (0, 0))
                if b > a:
                    begin = words.first[i] + answer["start"][a:b].astype(np.int64)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + answer["length"][a:b] + (window - 1), -1)
            keep = np.cumsum(edge)[:-1] == 0
            body, places = textnum.gather(words.raw, words.starts[keep], (words.ends - words.starts)[keep], gap=1)
            body = body.tobytes()
            kept_at = np.concatenate([[0], np.cumsum(keep)])[words.first]
            for i, (o, mark) in enumerate(zip(ords.tolist(), marks.tolist(), strict=True)):
                n, left = int(words.first[i + 1] - words.first[i]), int(kept_at[i + 1] - kept_at[i])
                text = body[places[kept_at[i]] : places[kept_at[i + 1]] - 1] if left else b""
                out.append((None if mark & 1 else o, n, n - left, text))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return texts.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(kept, "doc_id long, n_words long, n_removed long, text string")
