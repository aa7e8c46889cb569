import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wayfare.llm import jaccard, sketch, substrings, textnum, units
from wayfare.llm.components import local_components, star_components
from wayfare.llm.jaccard import deduplicated, jaccard_components, link_overlap
from wayfare.llm.substrings import dedup_substrings

DOCS = "doc_id long, text string"
SEP = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(rows, k=20):
    """Windows at equal (doc_id, start) are neither first nor later; no id comes before all ids."""
    key = lambda d: (d is not None, d or 0)
    words = [(d, SEP.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            first[g] = min(first.get(g, (key(d), s)), (key(d), s))
    out = []
    for d, w in words:
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < (key(d), s):
                gone |= set(range(s, s + k))
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def removed(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        if i % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = passage[rng.randint(0, 20) : rng.randint(30, 60)]
        if i % 7 == 0:
            own += own
        rows.append((i * 5 % 61, (" \t\n\x0b"[i % 4]).join(own)))
    rows += [(100, None), (101, ""), (102, " \n "), (103, "word " * 300), (104, "x" * 300_000 + " y"), (105, rows[3][1]), (7, rows[5][1]), (7, rows[6][1]), (7, rows[6][1]), (None, rows[9][1]), (106, " ".join(passage * 400))]
    return rows


@pytest.mark.parametrize(("unit_bytes", "partitions"), [(1 << 20, 3), (2000, 5)])
def test_substrings_are_brute_force(spark, monkeypatch, unit_bytes, partitions):
    rows = corpus()
    monkeypatch.setattr(units, "UNIT_BYTES", unit_bytes)
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], DOCS + ", segment int, ord string").repartition(partitions)
    assert removed(dedup_substrings(docs)) == brute_substrings(rows)


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def long_words():
    """Words that sums of powers modulo a power of two cannot tell apart, and long random ones that differ in a letter."""
    rng = random.Random(5)
    out = [(thue_morse(n), thue_morse(n, "ba")) for n in (1024, 2048, 4096)]
    for n in (33, 1000, 50_000):
        word = "".join(rng.choice("abcdefgh") for _ in range(n))
        at = rng.randrange(n)
        out.append((word, word[:at] + "z" + word[at + 1 :]))
    return out


def test_long_words_that_differ_have_other_hashes():
    pairs = long_words()
    words = textnum.Words(*textnum.buffers(pa.array([w for p in pairs for w in p])))
    for salt in (0, 1):
        assert len(set(words.hashes(salt=salt).tolist())) == 2 * len(pairs)
    assert not set(words.hashes().tolist()) & set(words.hashes(salt=1).tolist())


def test_windows_and_texts_of_long_words_are_told_apart(spark):
    common = [f"w{i}" for i in range(19)]
    rows = []
    for a, b in long_words():
        rows += [(len(rows), " ".join([*common, a])), (len(rows) + 1, " ".join([*common, b])), (len(rows) + 2, a), (len(rows) + 3, b)]
    docs = spark.createDataFrame(rows, DOCS)
    assert all(r[2] == 0 for r in removed(dedup_substrings(docs)))
    assert components(jaccard_components(docs)) == brute_components(rows)


def test_substrings_empty(spark):
    assert dedup_substrings(spark.createDataFrame([], DOCS)).count() == 0
    assert removed(dedup_substrings(spark.createDataFrame([(1, None)], DOCS))) == brute_substrings([(1, None)])


def sketched(spark, keys_by_unit, shape):
    """Levels of each unit's keys, by way of a plan."""
    rows = [(u, np.asarray(k, np.uint64).tobytes()) for u, k in keys_by_unit.items()]
    df = spark.createDataFrame(rows, "unit long, keys binary").repartition(3)
    keys_of = lambda g: np.concatenate([np.frombuffer(x, np.uint64) for x in g.column("keys").to_pylist()])
    answers = sketch.answered(df, "unit", keys_of, shape).toArrow()
    unit = answers.column("unit").to_numpy()
    return {u: shape.levels(np.asarray(k, np.uint64), answers.filter(pa.array(unit == u))) for u, k in keys_by_unit.items()}


@pytest.mark.parametrize("thresholds", [(2,), (2, 5, 40)])
def test_sketch_never_underestimates(spark, thresholds):
    rng = np.random.RandomState(0)
    by_unit = {u: textnum.mix(rng.randint(0, 3000, 4000 if u else 1).astype(np.uint64)) for u in range(6)}
    by_unit[7] = textnum.mix(np.arange(10_000, 20_000).astype(np.uint64))
    counts = Counter(int(k) for ks in by_unit.values() for k in ks)
    got = sketched(spark, by_unit, sketch.Sketch(30_000, thresholds))
    for u, keys in by_unit.items():
        true = [sum(counts[int(k)] >= t for t in thresholds) for k in keys]
        assert (got[u] >= true).all()
        assert (got[u] > true).mean() < 0.2


def test_cells_come_back_from_their_code():
    rng = np.random.RandomState(1)
    for n, most in ((1, 5), (1, 1 << 26), (7, 3), (5000, 300), (5000, 1 << 26)):
        cells = np.sort(rng.randint(0, most, n)).astype(np.int64)
        low, coded = sketch._coded(cells)
        assert sketch._decoded(n, low, coded).tolist() == cells.tolist()


def test_sketch_grows_with_its_keys():
    """The share of keys that occur once and pass as repeated stays small at any number of keys; one unit is enough here,
    as cells and segments follow from the expected number alone."""
    for n in (10_000, 100_000, 3_000_000):
        shape = sketch.Sketch(n, (2,))
        keys = textnum.mix(np.arange(n, dtype=np.uint64))
        asked = shape.asked(0, keys)
        segment = asked.column("segment").to_numpy()
        answers = pa.concat_tables([shape.answer(asked.filter(pa.array(segment == s))) for s in np.unique(segment)])
        assert (shape.levels(keys, answers) > 0).mean() < 0.2
    assert sketch.Sketch(10**13, (2,)).log_cells >= 44


def test_words_and_runs():
    texts = ["a  b\tc", "", "Ab é", "x"]
    words = textnum.Words(*textnum.buffers(pa.array([*texts, None])))
    assert [bytes(words.raw[s:e]).decode() for s, e in zip(words.starts, words.ends, strict=True)] == ["a", "b", "c", "Ab", "é", "x"]
    assert words.first.tolist() == [0, 3, 3, 5, 6, 6]
    assert len(set(words.hashes().tolist())) == 6
    folded = textnum.Words(*textnum.buffers(pa.array(["Ab É", "aB é"]))).hashes(folded=True)
    assert folded[0] == folded[2] and folded[1] != folded[3]
    h, at = textnum.runs(words.hashes(), words.first, 2)
    assert at.tolist() == [0, 1, 3]


def test_second_hash_of_a_window_does_not_follow_from_the_first():
    one, base = np.uint64(1), textnum.RUN_BASE
    a = textnum.mix(np.arange(2, dtype=np.uint64))
    hashes = np.array([a[0], a[1], a[0] + base, a[1] - one], np.uint64)  # a collision: a0 + a1 * base both times
    first = np.array([0, 2, 4])
    h, at = textnum.runs(hashes, first, 2)
    assert at.tolist() == [0, 2] and h[0] == h[1]
    other, _ = textnum.runs(hashes, first, 2, textnum.RUN_BASE_2)
    assert other[0] != other[1]


def sets_of(rows, gram):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = []
    for _, t in rows:
        w = SEP.findall(low(t))
        out.append({tuple(w[i : i + gram]) for i in range(len(w) - gram + 1)} if len(w) >= gram else {tuple(w)} if w else set())
    return out


def brute_components(rows, gram=4, percent=85):
    sets = sets_of(rows, gram)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def near_copies():
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(900)]
    rows = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows) * 17 % 1009, " ".join(own)))
    rows += [(2000, None), (2001, ""), (2002, "only three words"), (2003, "Only THREE words"), (2004, "one"), (5, rows[8][1]), (5, rows[30][1]), (None, rows[8][1]), (None, "lonely text without an id at all"), (2005, "again and " * 5000)]
    return rows


def components(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize(("gram", "percent", "tile_sets"), [(4, 85, 2048), (5, 80, 5), (4, 85, 2)])
def test_components_are_brute_force(spark, gram, percent, tile_sets):
    rows = near_copies()
    docs = spark.createDataFrame([(*r, "c") for r in rows], DOCS + ", class string").repartition(4)
    assert components(jaccard_components(docs, gram, percent, tile_sets=tile_sets)) == brute_components(rows, gram, percent)


def test_components_empty(spark):
    assert jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    assert components(jaccard_components(spark.createDataFrame([(3, None), (1, "")], DOCS))) == [(1, 0, 1), (3, 0, 3)]


def test_link_overlap_is_the_definition():
    for a in range(1, 40):
        for b in range(1, 40):
            least = next((i for i in range(min(a, b) + 1) if 100 * i >= 85 * (a + b - i)), None)
            assert least is None or link_overlap(a, b, 85) == least
    assert jaccard.least_overlap(20, 85) == 17


def test_star_components_on_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (300, 300)]
    for most in (2_000_000, 7):  # one part, and stars over several
        got = {r.node: r.root for r in star_components(spark.createDataFrame(edges, "u long, v long"), most).collect()}
        assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 150: 100}
    assert local_components(5, np.array([3, 1]), np.array([4, 3])).tolist() == [0, 1, 2, 1, 1]


def test_edges_of_a_gram_hold_every_link():
    """All pairs of classes that pass the filters are within components, whether a gram has few classes or many."""
    rng = random.Random(8)
    sets = []
    for _ in range(60):
        own = set(rng.sample(range(4000), rng.randint(5, 60)))
        for _ in range(rng.randint(1, 6)):
            sets.append(np.unique(textnum.mix(np.array(sorted(own - set(rng.sample(sorted(own), 1)) | {rng.randrange(4000)}), np.uint64))))
    classes = np.arange(len(sets)) * 3 + 1
    sizes = np.array([len(x) for x in sets])
    counts = Counter(int(g) for x in sets for g in x)
    ordered = [sorted(x.tolist(), key=lambda g: (counts[g], g)) for x in sets]
    rows = [(g, i, k) for i, x in enumerate(ordered) for k, g in enumerate(x[: sizes[i] - jaccard.least_overlap(sizes[i], 85) + 1])]
    h, who, place = (np.array(x) for x in zip(*rows, strict=True))
    vectors = jaccard.range_counts(sets)
    links = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert len(links) > 20
    for near in (1, 16):
        u, v = jaccard.candidate_edges(h.astype(np.uint64), classes[who], sizes[who], place, vectors[who], 85, near)
        label = dict(zip(classes.tolist(), local_components(len(sets), np.searchsorted(classes, u), np.searchsorted(classes, v)).tolist(), strict=True))
        assert all(label[classes[i]] == label[classes[j]] for i, j in links)


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(4)
    make = lambda: [rng.choice([f"n{i}" for i in range(500)]) for _ in range(60)]
    x, y, z = make(), make(), make()
    near = [*y[:-1], "other"]
    text = " ".join
    rows = [(1, text(x)), (5, text(x)), (5, text(y)), (7, text(near)), (9, text(z)), (9, text(z)), (None, text(z)), (None, text(make())), (3, None), (4, ""), (4, ""), (6, text(x).upper())]
    docs = spark.createDataFrame([(d, t, i, "c", None) for i, (d, t) in enumerate(rows)], "doc_id long, text string, `a.b` int, class string, __row string").repartition(3)
    out = deduplicated(docs, 5, 80)
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert kept == sorted([(1, text(x)), (5, text(y)), (9, text(z)), rows[7], (3, None), (4, "")], key=str)
    assert deduplicated(docs.limit(0)).count() == 0
