"""Byte-pair encoding of many words at once, and a memory-mapped lexicon automaton of words with their ids.

``Bpe`` reads a public tokenizer file (byte-level symbols, ranked merges, optional end-of-word suffix) and merges whole
batches of distinct words in numpy: words of equal length are rows of a matrix; each round every live row merges its
lowest-ranked leftmost pair, so a row loses one symbol a round. That is the order in which the merges are defined, so
results are exact. Words too long for matrices are merged one by one with a heap.

``Lexicon`` is a minimal acyclic transducer: words that end alike share states, edges carry the number of words that
come before in sorted order, so the sum along a path numbers the word and the number finds its ids. It is one array of
32-bit integers, written once and memory-mapped by every worker of a machine.
"""

from __future__ import annotations

import heapq
import json

import numpy as np

MATRIX_MOST = 64
NO_RANK = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [rest.get(b, chr(b)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[s] for s in symbols], np.int32)
        self.last_id = np.array([vocab[s + self.suffix] for s in symbols], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in pairs], np.int64)
        b = np.array([vocab[y] for _, y in pairs], np.int64)
        made = np.array([vocab[x + y] for x, y in pairs], np.int32)
        keys = (a << 20) | b
        by = np.argsort(keys, kind="stable")
        new = np.concatenate([[True], keys[by][1:] != keys[by][:-1]])
        self.keys, self.ranks, self.made = keys[by][new], by[new].astype(np.int32), made
        least = int(max(self.byte_id.max(), self.last_id.max())) + 1
        self.small = np.full((least, least), NO_RANK, np.int32)
        low = (a < least) & (b < least)
        for x, y, r in zip(a[low][::-1], b[low][::-1], np.flatnonzero(low)[::-1], strict=True):
            self.small[x, y] = r
        self.pair_rank = {int(k): int(r) for k, r in zip(self.keys, self.ranks, strict=True)}
        inverse = {s: b for b, s in enumerate(symbols)}
        size = max(max(vocab.values()), *self.special.values()) + 1
        token_bytes: list[bytes] = [b""] * size
        for s, i in vocab.items():
            token_bytes[i] = bytes(inverse[c] for c in s if c in inverse)
        for s, i in self.special.items():
            token_bytes[i] = s.encode()
        lengths = np.array([len(t) for t in token_bytes], np.int64)
        self.token_raw, self.token_length = np.frombuffer(b"".join(token_bytes), np.uint8), lengths
        self.token_start = np.concatenate([[0], np.cumsum(lengths)[:-1]])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (a >= 0) & (b >= 0), self.ranks[at], NO_RANK)

    def _merged(self, ids: np.ndarray) -> list[np.ndarray]:
        """Rows of equal length, merged."""
        out: list[np.ndarray] = [None] * len(ids)  # type: ignore[list-item]
        rows = np.arange(len(ids))
        rank = self.small[ids[:, :-1], ids[:, 1:]]
        while True:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            best = rank[np.arange(len(ids)), at] if rank.shape[1] else np.full(len(ids), NO_RANK)
            live = best < NO_RANK
            for r, x in zip(rows[~live].tolist(), ids[~live].astype(np.uint16), strict=True):
                out[r] = x
            if not live.any():
                return out
            rows, ids, rank, at, best = rows[live], ids[live], rank[live], at[live], best[live]
            n, width = ids.shape
            every = np.arange(n)
            columns = np.arange(width - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            ids[every, at] = self.made[best]
            columns = np.arange(width - 2)
            rank = np.take_along_axis(rank, columns + (columns >= at[:, None]), axis=1) if width > 2 else np.zeros((n, 0), np.int32)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < width - 2)
            rank[right, at[right]] = self._rank(ids[right, at[right]], ids[right, at[right] + 1])

    def _merged_long(self, ids: list[int]) -> np.ndarray:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair_rank.get((ids[i] << 20) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = int(self.made[r]), 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (s := self.pair_rank.get((ids[p] << 20) | ids[q])) is not None:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return np.array([x for x, g in zip(ids, gone, strict=True) if not g], np.uint16)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids (uint16) of each non-empty word by itself."""
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        lengths = np.array([len(w) for w in words], np.int64)
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            if n > MATRIX_MOST:
                for i in own.tolist():
                    ids = self.byte_id[np.frombuffer(words[i], np.uint8)].tolist()
                    ids[-1] = int(self.last_id[words[i][-1]])
                    out[i] = self._merged_long(ids)
                continue
            raw = np.frombuffer(b"".join([words[i] for i in own.tolist()]), np.uint8).reshape(len(own), n)
            ids = self.byte_id[raw]
            ids[:, -1] = self.last_id[raw[:, -1]]
            for i, x in zip(own.tolist(), self._merged(ids), strict=True):
                out[i] = x
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids one after another, and the place of each id's bytes."""
        from wayfare.llm.textnum import gather

        return gather(self.token_raw, self.token_start[ids], self.token_length[ids])


def build_lexicon(words: dict[bytes, np.ndarray]) -> np.ndarray:
    """The transducer of words and ids as one array: five lengths, then its parts (see Lexicon)."""
    states: list[tuple[bool, tuple]] = []  # (final, ((label, target), ...)) of registered states
    register: dict[tuple, int] = {}

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = register.get(key)
        if at is None:
            at = register[key] = len(states)
            states.append(key)
        return at

    path: list[list] = [[False, []]]  # open states along the last word: final, edges
    last = b""
    ordered = sorted(words)
    for word in ordered:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1][-1] = (path[-1][1][-1][0], settle(node))
        for label in word[common:]:
            path[-1][1].append((label, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1][-1] = (path[-1][1][-1][0], settle(node))
    root = settle(path[0])
    under = np.zeros(len(states), np.int64)
    for s, (final, edges) in enumerate(states):  # targets come before their states
        under[s] = final + sum(under[t] for _, t in edges)
    keys, targets, before = [], [], []
    for s, (final, edges) in enumerate(states):
        skipped = int(final)
        for label, target in edges:
            keys.append((s << 8) | label)
            targets.append(target)
            before.append(skipped)
            skipped += int(under[target])
    ids = [words[w] for w in ordered]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else np.zeros(1)
    parts = [keys, targets, before, [int(f) for f, _ in states], offsets, np.concatenate(ids) if ids else []]
    head = [root, len(keys), len(states), len(ordered), int(offsets[-1])]
    return np.concatenate([np.asarray(x, np.uint32) for x in (head, *parts)])


class Lexicon:
    """Reads what build_lexicon made; ``source`` may be a memory map."""

    def __init__(self, source: np.ndarray):
        self.root, edges, states, words, ids = (int(x) for x in source[:5])
        cuts = np.cumsum([5, edges, edges, edges, states, words + 1, ids])
        self.keys, self.targets, self.before, self.final, self.offsets, self.ids = (source[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 if it is not there; all words walk the automaton together, a byte a step."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        raw = np.frombuffer(b"".join(words), np.uint8)
        who = np.flatnonzero(lengths)
        state, number = np.full(len(who), self.root, np.int64), np.zeros(len(who), np.int64)
        step = 0
        while len(who):
            key = (state << 8) | raw[starts[who] + step]
            at = np.minimum(np.searchsorted(self.keys, key.astype(np.uint32)), len(self.keys) - 1)
            found = self.keys[at] == key
            who, at = who[found], at[found]
            state, number = self.targets[at].astype(np.int64), number[found] + self.before[at]
            step += 1
            ended = lengths[who] == step
            done = ended & (self.final[state] == 1)
            out[who[done]] = number[done]
            who, state, number = who[~ended], state[~ended], number[~ended]
        return out

    def lookup(self, number: int) -> np.ndarray:
        return self.ids[self.offsets[number] : self.offsets[number + 1]].astype(np.uint16)
