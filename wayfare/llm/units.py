"""Units: bounded groups of texts that travel compressed, many texts to a row, so that answers can meet them again.

A unit is a hash range of the texts' keys and marks. The same frame of units may be read by several steps of one plan; Spark
then shuffles it once. What a step sees of a unit is a table of packed rows, in any order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

from wayfare.llm import textnum

SLICE_BYTES = 1 << 21
#: A packed row holds at most about so many bytes of text, unless one text is longer.
ROW_BYTES = 1 << 25
#: Bytes of text of a unit, up to an input of BASE_INPUT; beyond it they grow with the cube root of the input.
UNIT_BYTES, BASE_INPUT, MOST_UNIT = 1 << 21, 1 << 30, 1 << 26
#: Units that a partition of them holds, where there are more of them than cores of a machine.
PER_PARTITION, FEW = 4, 8
DDL = "unit long, keys binary, marks binary, sizes binary, packed binary"
NAMES = ["unit", "keys", "marks", "sizes", "packed"]


def unit_count(n_bytes: int) -> int:
    """Units for so many bytes of text."""
    return max(1, -(-n_bytes // min(MOST_UNIT, int(UNIT_BYTES * max(1.0, n_bytes / BASE_INPUT) ** (1 / 3)))))


def partitions(units: int) -> int:
    return max(min(units, FEW), units // PER_PARTITION)


def unit_of(keys: np.ndarray, marks: np.ndarray, units: int) -> np.ndarray:
    return (textnum.mix(textnum.mix(keys.view(np.uint64)) + marks.view(np.uint64)) % np.uint64(units)).astype(np.int64)


def pack(own: np.ndarray, keys: np.ndarray, marks: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    """Rows (DDL) of texts of the given units, with a key and a mark of 64 bits each."""
    press = zstandard.ZstdCompressor(level=1)
    raw, offsets = textnum.buffers(texts)
    by = np.argsort(own, kind="stable")
    sizes = np.diff(offsets)
    upto = np.cumsum(sizes[by]) // ROW_BYTES
    new = np.ones(len(by), bool)
    new[1:] = (own[by][1:] != own[by][:-1]) | (upto[1:] != upto[:-1])
    cuts = np.append(np.flatnonzero(new), len(by)) if len(by) else np.zeros(1, np.int64)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at = by[a:b]
        body, _ = textnum.gather(raw, offsets[at], sizes[at])
        out.append((int(own[at[0]]), keys[at].astype(np.int64).tobytes(), marks[at].astype(np.int64).tobytes(), sizes[at].astype(np.int64).tobytes(), press.compress(body.tobytes())))
    cols = list(zip(*out, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(cols)], names=NAMES)


def unpack(group: pa.Table, most_bytes: int = SLICE_BYTES):
    """(keys, marks, words) of a unit's texts, about most_bytes of text at a time."""
    press = zstandard.ZstdDecompressor()
    for i in range(group.num_rows):
        keys, marks, sizes = (np.frombuffer(group.column(c)[i].as_py(), t) for c, t in (("keys", np.int64), ("marks", np.int64), ("sizes", np.int64)))
        raw = np.frombuffer(press.decompress(group.column("packed")[i].as_py()), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < len(keys):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
            yield keys[at:end], marks[at:end], textnum.Words(raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end
