"""Words of whole Arrow batches as numpy arrays: boundaries, word hashes and hashes of runs of words.

A batch's texts stay one byte buffer; every step is a few passes over arrays, so cost is bytes, not Python objects.
A word's hash sums, modulo 2**64, a random 64-bit value for each of its bytes and the byte's place in the word, and is
then mixed: no arithmetic ties the places together, so words of any pattern and length collide only by chance. Another
salt gives hashes that do not follow from these. Runs of words are sums of mixed word hashes times powers of an odd
base. Equal words have equal hashes on any machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
RUN_BASE = np.uint64(0xD6E8FEB86659FD93)
#: For a second hash of runs that does not follow from the first.
RUN_BASE_2 = np.uint64(0xE7037ED1A0B428DB)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Values of bytes at the first places of a word come from a table, those of later places are made when needed.
TABLE_PLACES = 32
_tables: dict[int, np.ndarray] = {}
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] = np.arange(97, 123)


def _byte_values(byte: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """A random value for each byte at its place."""
    x = (place.astype(np.uint64) << np.uint64(8)) + byte.astype(np.uint64) + np.uint64(1)
    return mix(mix(x * np.uint64(0x632BE59BD9B4E019) + np.uint64(salt * 0x9FB21C651E98DF25 % 2**64)))


def _table(salt: int) -> np.ndarray:
    if salt not in _tables:
        at = np.arange(TABLE_PLACES * 256)
        _tables[salt] = _byte_values(at & 255, at >> 8, salt)
    return _tables[salt]


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), kept between calls up to some millions."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 16
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[int(base)] = have
    return have[:n]


def _inverse(base: np.uint64, n: int) -> np.uint64:
    """base ** -n modulo 2 ** 64."""
    return np.uint64(pow(int(base), -n, 1 << 64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string or binary array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = False, salt: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes, none of them empty; folded: A-Z as a-z."""
    return salted_hashes(raw, starts, ends, (salt,), folded)[0]


def salted_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salts: tuple[int, ...], folded: bool = False) -> list[np.ndarray]:
    """``span_hashes`` under several salts; the bytes and their places are made out once."""
    lengths = ends - starts
    if not len(lengths):
        return [np.zeros(0, np.uint64) for _ in salts]
    begin = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=begin[1:])
    place = np.arange(begin[-1])
    byte = raw[place + np.repeat(starts - begin[:-1], lengths)]
    place -= np.repeat(begin[:-1], lengths)
    if folded:
        byte = _FOLDED[byte]
    late = np.flatnonzero(place >= TABLE_PLACES)
    late_place = place[late]
    np.minimum(place, TABLE_PLACES - 1, out=place)
    place <<= 8
    place |= byte
    out = []
    for salt in salts:
        value = _table(salt)[place]
        if len(late):
            value[late] = _byte_values(byte[late], late_place, salt)
        out.append(mix(np.add.reduceat(value, begin[:-1]) + lengths.astype(np.uint64)))
    return out


class Words:
    """Words of consecutive texts: starts and ends in the bytes, and first: the n + 1 places of each text's first word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        inside = ~_IS_WHITE[raw]
        edge = np.empty(len(raw) + 1, bool)
        edge[-1] = True
        edge[1:-1] = ~inside[:-1]
        if len(raw):
            edge[0] = True
        edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
        self.starts = np.flatnonzero(inside & edge[:-1])
        edge[1:-1] = ~inside[1:]
        edge[offsets[1:]] = True
        self.ends = np.flatnonzero(inside & edge[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, folded: bool = False, salt: int = 0) -> np.ndarray:
        """64-bit hash of each word; folded: A-Z as a-z."""
        return span_hashes(self.raw, self.starts, self.ends, folded, salt)

    def texts(self) -> np.ndarray:
        """The place of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(hashes: np.ndarray, first: np.ndarray, k: int, base: np.uint64 = RUN_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words within a text, and the places of their first words."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n + 1, np.uint64)
    pw = powers(base, n + 1)
    np.cumsum(hashes * pw[:n], out=total[1:])
    whole = np.ones(n - k + 1, bool)
    for before in range(1, k):  # a run that begins less than k words before the end of a text goes beyond it
        at = first[1:] - before
        whole[at[(at >= 0) & (at <= n - k)]] = False
    h = total[k:] - total[:-k]
    h *= pw[k:][::-1]
    h *= _inverse(base, n)
    return mix(h[whole] + np.uint64(k)), np.flatnonzero(whole)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int):
    """The batch in consecutive slices of whole rows with about most_bytes of the column's text each."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def gather(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, gap: int = 0, fill: int = 0x20) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of raw one after another, each followed by gap fill bytes; and the n + 1 places of the pieces."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + gap, out=at[1:])
    source = np.arange(at[-1])
    source += np.repeat(starts - at[:-1], lengths + gap)
    out = raw[np.minimum(source, max(len(raw) - 1, 0))] if len(raw) else np.zeros(at[-1], np.uint8)
    if gap:
        for g in range(gap):
            out[at[:-1] + lengths + g] = fill
    return out, at
