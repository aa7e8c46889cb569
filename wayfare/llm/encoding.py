"""BPE encoding and decoding with a lexicon automaton.

Texts are cut into pieces as the tokenizer file's pre-tokenizer does; a piece's ids come from, in turn, a bounded cache
of the worker, the memory-mapped lexicon transducer of frequent pieces, and exact merges (``bpe.Bpe``). The lexicon is
compiled on the driver from piece counts over all texts: of each hash range at most so many pieces go on, and the most
frequent of them all, a bounded number, are taken, so the file has a bounded size; it lies in the shared folder and Spark hands it to every executor. It
only saves work: ids are the same without it.

Two families of tokenizer files are understood: byte-level ones, whose pieces carry a leading space, and word-level
ones with an end-of-word suffix, whose texts are NFC-normalised, lower-cased and cut at white space.

Defined results: null and empty texts have no ids and decode to the empty text; strings of special tokens inside a
text are their ids, as the tokenizers library does by default; pieces of any length are merged in bounded memory;
extra columns are not read.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
import uuid
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm import textnum
from wayfare.llm.bpe import Bpe, Lexicon, build_lexicon
from wayfare.llm.common import as_row, frugal, kept_in_worker, put_together, shared_dir, text_apart, text_column, with_fields

LEXICON_PIECES = 32_768
#: Bytes of text to each hash range of pieces, and the least number of ranges.
BUCKET_BYTES, LEAST_BUCKETS = 1 << 26, 64
CACHE_PIECES = 250_000
FLUSH_PIECES = 1_000_000
#: Bytes of text that are cut and encoded together.
SLICE_BYTES = 1 << 20

# The pre-tokenizers' patterns of the two families of files.
BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")

WORD_OR_END = regex.compile(WORD_PIECES.pattern + r"|\n")
#: No code point below U+0378 is unassigned.
MAYBE_UNASSIGNED = re.compile("[\u0378-\U0010ffff]")
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
WHITE = regex.compile(r"\p{White_Space}+")
#: Kinds of ASCII bytes: 1 letters, 2 digits, 3 other printable characters but the apostrophe; 0 all else.
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127], _KINDS[48:58], _KINDS[39] = 3, 2, 0
_KINDS[65:91] = _KINDS[97:123] = 1


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def _lowered(text: str) -> str:
    """Lower case character by character, without rules for word ends."""
    return text.replace("Σ", "σ").lower()


class Encoder:
    """A worker's encoder: texts to ids of 16 bits and back."""

    def __init__(self, path: str, lexicon: Lexicon | None = None, cache_pieces: int = CACHE_PIECES):
        self.bpe, self.lexicon, self.most = load(path), lexicon, cache_pieces
        if len(self.bpe.token_length) > 1 << 16:
            raise ValueError(f"{path} has ids beyond 16 bits")
        self.words = bool(self.bpe.suffix)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.bpe.special, key=len, reverse=True))) if self.bpe.special else None
        self.path, self._library = path, None
        self.known: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.parts: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The units that ids are cached for: pieces, or for word-level files whole words between white space."""
        if not self.words:
            return BYTE_PIECES.findall(text)
        return text.split() if not ODD_SPACE.search(text) else [w for w in WHITE.split(text) if w]

    def pieces_of(self, words: list[str]) -> list[list[str]]:
        """Pieces of each word, cut in one pass over all of them."""
        text = "\n".join(words)
        if not text.isascii():
            text = _lowered(unicodedata.normalize("NFC", text))
        else:
            text = text.lower()
        out: list[list[str]] = [[]]
        for p in WORD_OR_END.findall(text):
            if p == "\n":
                out.append([])
            else:
                out[-1].append(p)
        return out

    def _ids_of(self, pieces: list[str], into: dict[str, bytes]) -> None:
        raw = [p.encode() for p in pieces]
        at = self.lexicon.numbers(raw) if self.lexicon is not None else np.full(len(raw), -1)
        unseen = np.flatnonzero(at < 0).tolist()
        for i in np.flatnonzero(at >= 0).tolist():
            into[pieces[i]] = self.lexicon.lookup(int(at[i])).tobytes()
        for i, ids in zip(unseen, self.bpe.encode_words([raw[i] for i in unseen]), strict=True):
            into[pieces[i]] = ids.tobytes()

    def learn(self, units: set[str]) -> None:
        """Make sure that all units are known. A byte-level piece with a character that this Python's tables do not have
        yet is known as None: the library may cut around it elsewhere."""
        known, parts = self.known, self.parts
        units = units.difference(known)
        again = [u for u in units if u in self.old]
        known.update((u, self.old[u]) for u in again)
        units.difference_update(again)
        if not units:
            return
        if MAYBE_UNASSIGNED.search("\n".join(units)):
            odd = [u for u in units if self.odd(u)]
            units.difference_update(odd)
            for u in odd:
                known[u] = self.library(u) if self.words else None
        own = list(units)
        if not self.words:
            self._ids_of(own, known)
            return
        cut = self.pieces_of(own) if own else []
        new = {p for ps in cut for p in ps}.difference(parts)
        if new:
            self._ids_of(list(new), parts)
        for u, ps in zip(own, cut, strict=True):
            known[u] = parts[ps[0]] if len(ps) == 1 else b"".join([parts[p] for p in ps])

    def forget(self) -> None:
        """Keep one older generation of what is known, so that memory stays bounded."""
        self.old, self.known = self.known, {}
        self.parts.clear()

    def library(self, text: str) -> bytes:
        """Ids of a text as the tokenizers library gives them."""
        from tokenizers import Tokenizer

        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Texts are cut once, and what is new in any of them is learnt together."""
        plain: list[str] = []
        made: list[list[tuple[str, int]]] = []  # per text: ("text", place in plain) or ("id", id)
        for text in texts:
            if self.special is not None and "<|" in text and self.special.search(text):
                parts, at = [], 0
                for m in self.special.finditer(text):
                    parts += [("text", len(plain)), ("id", self.bpe.special[m[0]])]
                    plain.append(text[at : m.start()])
                    at = m.end()
                made.append([*parts, ("text", len(plain))])
                plain.append(text[at:])
            else:
                made.append([("text", len(plain))])
                plain.append(text)
        cut = [self.split(t) for t in plain]
        if len(self.known) > self.most:
            self.forget()
        units: set[str] = set()
        for own in cut:
            units.update(own)
        if len(units) <= self.most:
            self.learn(units)
            ids = [self._joined(own, t) for own, t in zip(cut, plain, strict=True)]
        else:
            ids = [b"".join(self._learnt(own[i : i + self.most], t) for i in range(0, len(own), self.most)) for own, t in zip(cut, plain, strict=True)]
            ids = [self.library(t) if len(own) > self.most and not self.words and any(self.odd(u) for u in own) else x for x, own, t in zip(ids, cut, plain, strict=True)]
        out = []
        for parts in made:
            if len(parts) == 1:
                out.append(np.frombuffer(ids[parts[0][1]], np.uint16))
            else:
                out.append(np.concatenate([np.frombuffer(ids[x], np.uint16) if kind == "text" else np.array([x], np.uint16) for kind, x in parts]))
        return out

    def odd(self, unit: str) -> bool:
        return MAYBE_UNASSIGNED.search(unit) is not None and any(unicodedata.category(c) == "Cn" for c in unit)

    def _learnt(self, units: list[str], text: str) -> bytes:
        """Ids of some units of a text, with the cache emptied before them."""
        self.forget()
        self.learn(set(units))
        return b"".join([self.known[u] or b"" for u in units])

    def _joined(self, units: list[str], text: str) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, units))
        except TypeError:  # an odd piece
            return self.library(text)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        every = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
        raw, at = self.bpe.decode(every.astype(np.int64))
        raw, ends = raw.tobytes(), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        return [raw[at[a] : at[b]].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


class LibraryEncoder:
    """A worker's encoder on top of the tokenizers library, for whole Arrow arrays.

    For a file of words with ends, which lowers case and cuts between letters, digits and other characters, texts are cut
    into pieces at ASCII white space and where ASCII characters of those three kinds meet; not around apostrophes and
    control characters, nor in words that may hold a special token. A piece is known by 128 bits of hashes, the ids of
    known pieces are gathered from one array, and the new pieces of a slice go to the library as one text, so cost is a
    few passes over arrays and the library's time for what is new. Pieces are kept in a table of twice ``most`` slots, or
    up to four times: in the slot that the hash names or, where that is taken, in place of what its neighbour held. A
    piece that has lost its slot is new again.
    For other files whole texts go to the library. Ids are 16 bits wide where the vocabulary allows it, else 32.
    """

    WORDS_AT_ONCE = 20_000
    SLICE_BYTES = 1 << 21

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.library.no_truncation()
        self.library.no_padding()
        self.words = bool(load_suffix(path))
        self.dtype = id_type(self.library)
        self.special = sorted({t.content.encode()[:2] for t in self.library.get_added_tokens_decoder().values()})
        bits = max(1, int(2 * most - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros((1 << bits, 4), np.uint64)  # key, check, place in the pool and number of ids; in one row, as they are read together
        self.pool, self.filled = np.zeros(1 << 16, self.dtype), 0

    def _library_ids(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each) of words."""
        ids, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for at in range(0, len(starts), self.WORDS_AT_ONCE):
            body, places = textnum.gather(raw, starts[at : at + self.WORDS_AT_ONCE], lengths[at : at + self.WORDS_AT_ONCE], gap=1, fill=0x0A)
            made = self.library.encode(body.tobytes().decode(), add_special_tokens=False)
            characters = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])[places]
            own = np.array(made.ids, self.dtype)
            word = np.searchsorted(characters, np.fromiter(itertools.chain.from_iterable(made.offsets), np.int64, 2 * len(own))[::2], "right") - 1
            ids.append(own)
            counts.append(np.diff(np.searchsorted(word, np.arange(len(places)))))
        return np.concatenate(ids), np.concatenate(counts)

    def _known(self, key: np.ndarray, check: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, number of ids) of each piece, after learning the new ones."""
        slot = (key >> self.shift).astype(np.int64)
        rows = self.slots.take(slot, axis=0)
        begin, count = rows[:, 2].astype(np.int64), rows[:, 3].astype(np.int64)
        # a slot without a piece is all zeros, with no ids: a piece without ids is learnt whenever met
        new = np.flatnonzero((rows[:, 0] != key) | (rows[:, 1] != check) | (count == 0))
        rows = self.slots.take(slot[new] ^ 1, axis=0)
        held = (rows[:, 0] == key[new]) & (rows[:, 1] == check[new]) & (rows[:, 3] > 0)
        begin[new[held]], count[new[held]] = rows[held, 2].astype(np.int64), rows[held, 3].astype(np.int64)
        new = new[~held]
        if len(new):
            own, first, place = np.unique(key[new], return_index=True, return_inverse=True)
            if np.any(check[new] != check[new][first][place]):  # two pieces of one key
                pairs, first, place = np.unique(np.stack([key[new], check[new]], axis=1), axis=0, return_index=True, return_inverse=True)
                own, place = np.ascontiguousarray(pairs[:, 0]), place.ravel()
            at = new[first]
            ids, counts = self._library_ids(raw, starts[at], lengths[at])
            self._make_room(len(ids))
            begins = np.cumsum(counts) - counts + self.filled
            self.pool[self.filled : self.filled + len(ids)] = ids
            self.filled += len(ids)
            to = slot[at]
            to ^= self.slots[to, 3] > 0  # the first piece keeps its slot, those after it take turns in the next
            self.slots[to] = np.stack([own, check[at], begins.astype(np.uint64), counts.astype(np.uint64)], axis=1)
            begin[new], count[new] = begins[place], counts[place]
        return begin, count

    def _make_room(self, n: int) -> None:
        """Room for n more ids at the pool's end. Places given out before stay valid for as long as nothing moves, so a pool
        that is full grows, and is rid of lost pieces between slices only."""
        if self.filled + n > len(self.pool):
            pool = np.zeros(2 * (self.filled + n), self.dtype)
            pool[: self.filled] = self.pool[: self.filled]
            self.pool = pool

    def _tidy(self) -> None:
        """Drop the ids of pieces that lost their slots, once they may be more than half of the pool."""
        if self.filled > 8 * len(self.slots):
            live = np.flatnonzero(self.slots[:, 3])
            lengths = self.slots[live, 3].astype(np.int64)
            pool, at = textnum.gather(self.pool[: self.filled], self.slots[live, 2].astype(np.int64), lengths)
            self.slots[live, 2] = at[:-1].astype(np.uint64)
            if len(pool) > 4 * len(self.slots):  # long pieces: all of them are learnt anew
                self.slots[:], pool = 0, pool[:0]
            self.pool, self.filled = pool, len(pool)

    def _pieces(self, words: textnum.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes, other hashes) of the pieces of the words."""
        raw = words.raw
        kind = _KINDS[raw]
        cut = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cut &= (kind[1:] > 0) & (kind[:-1] > 0)
        cut[words.starts[words.starts > 0] - 1] = False  # texts may meet without white space
        whole = np.zeros(0, np.int64)
        for two in self.special:
            at = np.flatnonzero((raw[:-1] == two[0]) & (raw[1:] == two[1])) if len(two) == 2 else np.flatnonzero(raw == two[0])
            whole = np.union1d(whole, np.searchsorted(words.starts, at, "right") - 1)
        for w in whole.tolist():
            cut[words.starts[w] : words.ends[w] - 1] = False
        inner = np.flatnonzero(cut) + 1
        starts, ends = np.sort(np.concatenate([words.starts, inner])), np.sort(np.concatenate([words.ends, inner]))
        key, check = textnum.salted_hashes(raw, starts, ends, (0, 1), folded=True)
        if len(whole):  # case tells special tokens from others
            at = np.searchsorted(starts, words.starts[whole])
            key[at], check[at] = textnum.salted_hashes(raw, starts[at], ends[at], (2, 3))
        return starts, ends, key, check

    def _slice(self, words: textnum.Words) -> tuple[np.ndarray, np.ndarray]:
        if not len(words.starts):
            return np.zeros(0, self.dtype), np.zeros(len(words.first), np.int64)
        self._tidy()
        starts, ends, key, check = self._pieces(words)
        begin, count = self._known(key, check, words.raw, starts, ends - starts)
        ids, places = textnum.gather(self.pool, begin, count)
        return ids, places[np.searchsorted(starts, np.append(words.starts, len(words.raw))[words.first])]

    def _parts(self, raw: np.ndarray) -> list[tuple[int, int]]:
        """Cuts of a very long text, after white space."""
        out, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + self.SLICE_BYTES)
            while end < len(raw):
                white = np.flatnonzero(np.isin(raw[end : end + self.SLICE_BYTES], textnum.WHITE))
                end = end + int(white[0]) + 1 if len(white) else min(len(raw), end + self.SLICE_BYTES)
                if len(white):
                    break
            out.append((at, end))
            at = end
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, the n + 1 places of the texts' ids)."""
        raw, offsets = textnum.buffers(texts)
        if not self.words:
            made = [np.array(self.library.encode(bytes(raw[a:b]).decode(), add_special_tokens=False).ids, self.dtype) for a, b in itertools.pairwise(offsets.tolist())]
            return np.concatenate([np.zeros(0, self.dtype), *made]), np.concatenate([[0], np.cumsum([len(x) for x in made], dtype=np.int64)])
        ids, sizes, at = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)], 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.SLICE_BYTES, "right")) - 1)
            own = raw[offsets[at] : offsets[end]]
            if end == at + 1 and len(own) > 2 * self.SLICE_BYTES:
                made = [self._slice(textnum.Words(own[a:b], np.array([0, b - a])))[0] for a, b in self._parts(own)]
                ids += made
                sizes.append(np.array([sum(len(x) for x in made)]))
            else:
                made, places = self._slice(textnum.Words(own, offsets[at : end + 1] - offsets[at]))
                ids.append(made)
                sizes.append(np.diff(places))
            at = end
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def load_suffix(path: str) -> str | None:
    """What a tokenizer file puts at the ends of words."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)["model"].get("end_of_word_suffix")


def id_type(library) -> type:
    return np.uint16 if max(library.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else np.uint32


@cache
def library_encoder(path: str) -> LibraryEncoder:
    """This worker's encoder; its cache serves one task after another."""
    return LibraryEncoder(path)


def frequent_pieces(docs: DataFrame, path: str, pieces: int = LEXICON_PIECES) -> list[str]:
    """The most frequent pieces of all texts; ties go by the piece."""
    encoder_words = bool(load(path).suffix)
    texts = docs.select(text_column(docs).alias("text"))
    # hash ranges are even: four times a range's share of the most frequent pieces, and some more, holds all of them
    buckets = max(LEAST_BUCKETS, (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    share = 4 * pieces // buckets + 64

    def counted(batches):
        encoder = Encoder(path)
        units: Counter[str] = Counter()

        def flush():
            out: Counter[str] = Counter()
            while units:
                unit, n = units.popitem()
                for p in encoder.pieces_of([unit])[0] if encoder_words else BYTE_PIECES.findall(" " + unit):
                    out[p] += n
            rows: dict[int, tuple[list, list]] = {}
            while out:
                p, n = out.popitem()
                own = rows.setdefault(zlib.crc32(p.encode()) % buckets, ([], []))
                own[0].append(p)
                own[1].append(n)
            held = [(b, "\n".join(ps), np.array(ns, np.int64).tobytes()) for b, (ps, ns) in rows.items()]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)], names=["bucket", "pieces", "counts"])

        for batch in batches:
            for part in textnum.slices(batch, "text", SLICE_BYTES):
                for text in part.column("text").to_pylist():
                    units.update(text.split())
                    if len(units) > FLUSH_PIECES:
                        yield from flush()
        yield from flush()

    def most(group: pa.Table) -> pa.Table:
        total: dict[str, int] = {}
        for ps, ns in zip(group.column("pieces"), group.column("counts"), strict=True):
            for p, n in zip(ps.as_py().split("\n"), np.frombuffer(ns.as_py(), np.int64).tolist(), strict=True):
                total[p] = total.get(p, 0) + n
        first = sorted(total, key=lambda p: (-total[p], p))[:share]
        return pa.table([pa.array(first, pa.string()), pa.array([total[p] for p in first], pa.int64())], names=["piece", "n"])

    rows = texts.mapInArrow(frugal(counted), "bucket int, pieces string, counts binary").groupBy("bucket").applyInArrow(most, "piece string, n long")
    return [r.piece for r in rows.orderBy(F.desc("n"), "piece").limit(pieces).collect()]


def shared_lexicon(docs: DataFrame, path: str, pieces: int = LEXICON_PIECES) -> str:
    """Compile the lexicon of docs and hand its file to all executors; returns the file's name there."""
    spark = docs.sparkSession
    found = [p.encode() for p in frequent_pieces(docs, path, pieces) if p]
    data = build_lexicon(dict(zip(found, load(path).encode_words(found), strict=True)))
    name = f"lexicon-{uuid.uuid4().hex}.u32"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lexicons/{name}")
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        stream.write(bytearray(data.tobytes()))
    finally:
        stream.close()
    spark.sparkContext.addFile(target.toString())
    return name


def worker_encoder(path: str, name: str | None) -> Encoder:
    """This worker's encoder, over the memory-mapped lexicon; its cache serves one task after another of the same lexicon."""
    return kept_in_worker(("encoder", path, name), lambda: Encoder(path, Lexicon(np.memmap(SparkFiles.get(name), np.uint32, "r")) if name else None))


def encoded_batches(batches, encoder: Encoder):
    """(record batch of whole rows, their texts, their ids) for all rows of a partition, a few texts at a time."""
    for batch in batches:
        for part in textnum.slices(batch, "text", SLICE_BYTES):
            texts = part.column("text").fill_null("").to_pylist()
            yield part, texts, encoder.encode(texts)


def encode(docs: DataFrame, path: str, lexicon_pieces: int = LEXICON_PIECES, with_text: bool = True) -> DataFrame:
    """docs with n_tokens and ids (array<int>) for its text, in place of columns of these names; other columns stay, the
    text too unless it is not wanted. Null text has no ids."""
    name = shared_lexicon(docs, path, lexicon_pieces)
    own = [c for c in docs.columns if c not in ("n_tokens", "ids")]
    base = text_apart(docs, own)
    names = ["row", "text"] if with_text else ["row"]

    def run(batches):
        encoder = worker_encoder(path, name)
        for part, _, ids in encoded_batches(batches, encoder):
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            sizes = np.array([len(x) for x in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=[*names, "n_tokens", "ids"])

    schema = with_fields(base.schema["row"], "text string, " * with_text + "n_tokens long, ids array<int>")
    return base.mapInArrow(frugal(run, keeps=True), schema).select(*put_together(own, with_text), "n_tokens", "ids")


def decode(encoded: DataFrame, path: str, into: str = "decoded") -> DataFrame:
    """encoded with the text of its ids, in place of a column of that name; null ids are empty."""
    own = [c for c in encoded.columns if c != into]
    base = encoded.select(as_row(encoded, own).alias("row"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            ids = [np.asarray(x, np.int64) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(encoder.decode(ids), pa.string())], names=["row", "decoded"])

    return base.mapInArrow(run, with_fields(base.schema["row"], "decoded string")).select("row.*", F.col("decoded").alias(into))


def decimals(ids: np.ndarray) -> bytes:
    """Ids as decimal numbers, joined by commas."""
    digits, shown = _digits()
    return digits[ids][shown[ids]].tobytes()[:-1]


@cache
def _digits() -> tuple[np.ndarray, np.ndarray]:
    text = np.array([f"{i}," for i in range(1 << 16)], "S6")
    table = np.frombuffer(text.tobytes(), np.uint8).reshape(-1, 6)
    return table, table > 0


def round_trip(docs: DataFrame, path: str, lexicon_pieces: int = LEXICON_PIECES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and its ids decoded again, ids not kept."""
    import hashlib

    name = shared_lexicon(docs, path, lexicon_pieces)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))

    def run(batches):
        encoder = worker_encoder(path, name)
        for part, _, ids in encoded_batches(batches, encoder):
            out = [(len(x), hashlib.sha256(decimals(x)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for x, t in zip(ids, encoder.decode(ids), strict=True)]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return base.mapInArrow(frugal(run, keeps=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
