"""Count-min sketches of 64-bit keys that are cut by cell range, however large: built, merged and read by shuffles.

A table comes as units, bounded groups of its rows. Every unit hashes its keys to cells of ``ROWS`` rows and sends each
range of cells (a segment) its sorted cells as Rice-coded gaps, a bit and a half more than a gap's own bits; a segment adds the
units up and answers each with the levels of the cells it asked about, two bits or fewer a cell; a unit's answers meet
its rows again. The number of cells follows the number of keys, and no task, neither driver nor broadcast, holds more
than one segment or one unit's share, so there is no size at which the sketch fills up.

A key's estimate, the least of its cells' counts, never falls below its count, so "not reached" is certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfare.llm.common import pow2_at_least

ROWS = 2
ODD = (np.uint64(0x9E6C63D0876A68DB), np.uint64(0xC4CEB9FE1A85EC53))
MIN_LOG_CELLS = 16
#: Cells of a segment are between these powers of two; they grow with the sketch so that units send fewer pieces.
LOG_SEGMENT = (18, 26)
CELLS_DDL = "segment long, unit long, n long, low int, gaps binary"
LEVELS_DDL = "unit long, segment long, n long, levels binary"


class Sketch:
    """The shape of a sketch for about ``expected`` keys, and the thresholds whose number reached is a key's level."""

    def __init__(self, expected: int, thresholds: tuple[int, ...]):
        if not 0 < len(thresholds) < 4 or max(thresholds) > 255:
            raise ValueError("one to three thresholds, at most 255")
        self.thresholds = tuple(sorted(thresholds))
        self.log_cells = max(MIN_LOG_CELLS, pow2_at_least(2 * expected))
        self.log_segment = min(self.log_cells, max(LOG_SEGMENT[0], min(LOG_SEGMENT[1], self.log_cells // 2 + 8)))
        self.bits = 1 if len(self.thresholds) == 1 else 2

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        return (keys * ODD[row]) >> np.uint64(64 - self.log_cells)

    def asked(self, unit: int, keys: np.ndarray) -> pa.Table:
        """What a unit sends: a row for each segment that any of its keys falls into (CELLS_DDL)."""
        out = []
        segments = 1 << (self.log_cells - self.log_segment)
        for row in range(ROWS):
            cells, counts = np.unique(self.cells(keys, row), return_counts=True)
            # what a unit counts beyond the greatest threshold changes no level
            cells = np.repeat(cells.astype(np.int64), np.minimum(counts, self.thresholds[-1]))
            own = cells >> self.log_segment
            cuts = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(cells))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out.append((row * segments + int(own[a]), unit, b - a, *_coded(cells[a:b] - (own[a] << self.log_segment))))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["segment", "unit", "n", "low", "gaps"])

    def answer(self, group: pa.Table) -> pa.Table:
        """A segment's answers (LEVELS_DDL) to all units that asked."""
        table = np.zeros(1 << self.log_segment, np.uint8)
        asked = []
        for n, low, gaps in zip(*(group.column(c).to_pylist() for c in ("n", "low", "gaps")), strict=True):
            cells = _decoded(n, low, gaps)
            first = np.flatnonzero(np.diff(cells, prepend=-1))
            times = np.diff(first, append=n)
            cells = cells[first]
            table[cells] = np.minimum(table[cells] + times, 255)
            asked.append(cells.astype(np.uint32))
        out = []
        for cells in asked:
            held = table[cells]
            level = sum((held >= t).astype(np.uint8) for t in self.thresholds)
            out.append((len(held), b"".join(np.packbits((level >> b) & 1).tobytes() for b in range(self.bits))))
        n, levels = zip(*out, strict=True)
        return pa.table({"unit": group.column("unit"), "segment": group.column("segment"), "n": pa.array(n, pa.int64()), "levels": pa.array(levels, pa.binary())})

    def levels(self, keys: np.ndarray, answers: pa.Table) -> np.ndarray:
        """The level of each of a unit's keys; ``answers`` are all that were sent to the unit."""
        order = np.argsort(answers.column("segment").to_numpy())
        segment = answers.column("segment").to_numpy()[order]
        n = answers.column("n").to_numpy()[order]
        coded = answers.column("levels").take(pa.array(order))
        found = np.zeros(int(n.sum()), np.uint8)
        at = 0
        for size, x in zip(n.tolist(), coded, strict=True):
            raw = np.frombuffer(x.as_py(), np.uint8).reshape(self.bits, -1)
            for b in range(self.bits):
                found[at : at + size] |= np.unpackbits(raw[b], count=size) << np.uint8(b)
            at += size
        first = int(n[segment < (1 << (self.log_cells - self.log_segment))].sum())
        out = np.full(len(keys), 255, np.uint8)
        for row, own in enumerate((found[:first], found[first:])):
            cells, place = np.unique(self.cells(keys, row), return_inverse=True)
            if len(cells) != len(own):
                raise ValueError("the answers are not those to this unit's keys")
            np.minimum(out, own[place], out=out)
        return out


def _coded(cells: np.ndarray) -> tuple[int, bytes]:
    """Ascending cells, which may repeat, as gaps: the number of low bits, and for each gap its high part in unary,
    then its low bits, plane by plane."""
    gaps = np.diff(cells, prepend=0)
    low = max(0, int(np.log2(gaps.mean() * 0.69 + 1e-9)))
    ends = np.cumsum((gaps >> low) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    return low, b"".join([np.packbits(unary).tobytes(), *(np.packbits(((gaps >> b) & 1).astype(np.uint8)).tobytes() for b in range(low))])


def _decoded(n: int, low: int, coded: bytes) -> np.ndarray:
    raw = np.frombuffer(coded, np.uint8)
    size = (n + 7) // 8
    planes = raw[len(raw) - low * size :].reshape(low, size)
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - low * size]))
    gaps = np.diff(ends, prepend=-1) - 1 << low
    for b in range(low):
        gaps |= np.unpackbits(planes[b], count=n).astype(np.int64) << b
    return np.cumsum(gaps)


def answered(units: DataFrame, key: str, keys_of, sketch: Sketch) -> DataFrame:
    """Answers (LEVELS_DDL) to all units. ``keys_of(group)`` gives the keys of a group of ``units``, which are grouped
    by ``key``, a long."""

    def asked(group: pa.Table) -> pa.Table:
        return sketch.asked(group.column(key)[0].as_py(), keys_of(group))

    def answer(group: pa.Table) -> pa.Table:
        return sketch.answer(group)

    sent = units.groupBy(key).applyInArrow(asked, CELLS_DDL)
    return sent.groupBy("segment").applyInArrow(answer, LEVELS_DDL)
