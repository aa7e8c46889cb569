"""N-gram Jaccard join: texts whose sets of word 4-grams have a Jaccard similarity of 0.85 or more, and their components.

Words are lower-cased (A-Z) runs between white space; a text of fewer words than a gram has its whole sequence as one
gram, a text without words has the empty set and is linked with nothing. Texts of equal sets are one class.

Method, over classes, with 64-bit gram hashes:
1. Texts are hashed once; of each class one text a task travels on, in units (``units``), where classes meet. A
   count-min sketch by cell range (``sketch``) estimates how many classes hold a gram. Grams that certainly occur once
   cannot be shared.
2. Rare-first prefix filtering: each class's grams are ordered by estimate level, then hash, one order for all; of n
   grams the first n - ceil(0.85 n) + 1 are its prefix, and two linked classes share a prefix gram. Prefix grams that
   may be shared are sent to the segment of their hash, with their place in the order and the counts of the set over
   ``RANGES`` ranges of hashes. There the classes of a gram, in order of set size, are compared with the ``NEAR``
   classes after them: by length, by position (what can still follow the first common prefix gram) and by suffix (the
   difference of the counts). What passes is an edge; classes of a gram that more hold are also linked along the order
   of size, as far as lengths allow. A segment sends one edge per class, never its pairs, and the components of these
   edges (neighbourhoods) hold every link.
3. Sets travel once, from their unit to their neighbourhood. There, in-memory prefix lists give candidate pairs, which
   pass the same three filters and are verified once, exactly. Pairs already in one component are not verified again:
   no link between components is lost, and a group of thousands of copies costs about a comparison a member.
   Neighbourhoods beyond ``TILE_BYTES`` are dealt into tiles. Each tile is worked on with a first tile of all; then
   only what is not in the neighbourhood's main component meets all tiles, so no task holds one whole, and a large
   group of copies costs what its size is, not the square.

Defined results: null text is empty; a text's component_id is the least doc_id reachable by links, itself included;
rows that share a doc_id are judged by their own texts; rows without doc_id do not lower a component_id. Grams and sets
are held to be equal by 64 bits of hashes without structure (``textnum``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm import sketch, textnum, units
from wayfare.llm.common import as_row, frugal, staged, text_column
from wayfare.llm.components import joined_up, lookup, star_components
from wayfare.plans.staging import small

GRAM = 4
PERCENT = 85
SLICE_BYTES = 1 << 21
TILE_BYTES = 1 << 24
TILE_SETS = 2048
RANGES = 64
POSTED_RANGES = 32
NEAR = 16
SEGMENT_KEYS = 4_000_000
THRESHOLDS = (2, 8, 32)
#: Classes that a task remembers to have sent.
MOST_MET = 1_000_000
#: Rows to go that reach the documents by broadcast (17 bytes each); more are joined by shuffle.
MARKED_ROWS = 1_000_000
POSTING = (("grams", np.uint64), ("classes", np.int64), ("sizes", np.int32), ("places", np.int32), ("counts", np.uint8))


def gram_sets(words: textnum.Words, gram: int = GRAM) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct gram hashes of each text, and the texts' class ids (0 for empty sets)."""
    hashes = words.hashes(folded=True)
    h, at = textnum.runs(hashes, words.first, gram)
    cuts = np.searchsorted(at, words.first)
    sets = [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    n_words = np.diff(words.first)
    for k in range(1, gram):
        short = np.flatnonzero(n_words == k)
        if len(short):
            h, at = textnum.runs(hashes, words.first, k)
            whole = dict(zip(at.tolist(), h, strict=True))
            for i in short:
                sets[i] = np.array([whole[int(words.first[i])]], np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    classes = np.zeros(len(sets), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        mixed = textnum.mix(np.concatenate(sets))
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1][full]
        classes[full] = textnum.mix(np.add.reduceat(mixed, starts) + sizes[full].astype(np.uint64)) | np.uint64(1)
    return sets, classes.view(np.int64)


def least_overlap(n, percent: int):
    """Grams of a set of n that any linked set shares."""
    return (percent * n + 99) // 100


def link_overlap(a, b, percent: int):
    """Common grams that sets of a and b need: 100 i >= percent (a + b - i)."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _rows(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _verified(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> np.ndarray:
    """Least place of each set's component under links; where sides differ, only pairs across them count."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    by = np.argsort(sizes, kind="stable")
    sets, sizes, sides = [sets[i] for i in by], sizes[by], sides[by]
    across = bool(np.any(sides != sides[0]))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.zeros((m, RANGES), np.int32)
    np.add.at(counts, (owner, (flat >> np.uint64(58)).astype(np.int64)), 1)
    _, token, df = np.unique(flat, return_inverse=True, return_counts=True)
    rank_of = np.empty(len(df), np.int64)
    rank_of[np.lexsort((np.arange(len(df)), df))] = np.arange(len(df))
    rank = rank_of[token]
    ordered = rank[np.lexsort((rank, owner))]
    place = np.arange(len(ordered)) - offsets[owner]
    prefix = (place < (sizes - least_overlap(sizes, percent) + 1)[owner]) & (np.sort(df)[ordered] > 1)
    p_rank, p_owner, p_place = ordered[prefix], owner[prefix], place[prefix]
    of = np.searchsorted(p_owner, np.arange(m + 1))
    by_rank = np.lexsort((p_owner, p_rank))
    l_owner, l_place = p_owner[by_rank], p_place[by_rank]
    begin, end = np.searchsorted(p_rank[by_rank], p_rank), np.searchsorted(p_rank[by_rank], p_rank, "right")
    label = np.arange(m)
    mark = np.zeros(len(df), np.int32)
    for i in range(m):
        a, b = of[i], of[i + 1]
        if a == b:
            continue
        lengths = end[a:b] - begin[a:b]
        at = np.arange(lengths.sum()) + np.repeat(begin[a:b] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        other = l_owner[at]
        fit = (other > i) & (label[other] != label[i])
        if across:
            fit &= sides[other] != sides[i]
        if not fit.any():
            continue
        own_place, other_place, other = np.repeat(p_place[a:b], lengths)[fit], l_place[at][fit], other[fit]
        other, first = np.unique(other, return_index=True)  # lists run from rare to frequent: the first is the first common
        need = link_overlap(sizes[i], sizes[other], percent)
        fit = 100 * sizes[i] >= percent * sizes[other]
        fit &= 1 + np.minimum(sizes[i] - own_place[first] - 1, sizes[other] - other_place[first] - 1) >= need
        other, need = other[fit], need[fit]
        fit = np.abs(counts[other] - counts[i]).sum(axis=1) <= sizes[i] + sizes[other] - 2 * need
        other, need = other[fit], need[fit]
        if not len(other):
            continue
        mark[token[offsets[i] : offsets[i + 1]]] = 1
        for j, least in zip(other, need, strict=True):
            if label[j] != label[i] and mark[token[offsets[j] : offsets[j + 1]]].sum() >= least:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
        mark[token[offsets[i] : offsets[i + 1]]] = 0
    out = np.empty(m, np.int64)
    out[by] = by[label]
    return out


def range_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many grams of each set fall into each of POSTED_RANGES ranges of hashes, 255 for more."""
    flat = np.concatenate(sets)
    at = np.repeat(np.arange(len(sets)), [len(x) for x in sets]) * POSTED_RANGES + (flat >> np.uint64(59)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=len(sets) * POSTED_RANGES), 255).astype(np.uint8).reshape(len(sets), POSTED_RANGES)


def candidate_edges(h: np.ndarray, c: np.ndarray, size: np.ndarray, place: np.ndarray, counts: np.ndarray, percent: int, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes that may be linked, so that every link between classes of one gram is within a component."""
    by = np.lexsort((c, size, h))
    h, c, size, place, counts = h[by], c[by], size[by].astype(np.int64), place[by].astype(np.int64), counts[by]
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, near + 1):
        at = np.flatnonzero(h[d:] == h[:-d])
        if not len(at):
            break
        a, b = size[at], size[at + d]
        need = link_overlap(a, b, percent)
        fit = (100 * a >= percent * b) & (c[at] != c[at + d]) & (1 + np.minimum(a - place[at] - 1, b - place[at + d] - 1) >= need)
        at = at[fit]
        room = (a + b - 2 * need)[fit]
        apart = np.abs(counts[at].astype(np.int16) - counts[at + d]).sum(axis=1)  # no more than what the sets differ by
        at = at[apart <= room]
        u.append(c[at])
        v.append(c[at + d])
    if len(h) > near + 1:
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        many = np.repeat(np.diff(begin, append=len(h)) > near + 1, np.diff(begin, append=len(h)))
        at = np.flatnonzero(many[:-1] & (h[1:] == h[:-1]) & (100 * size[:-1] >= percent * size[1:]))
        u.append(c[at])
        v.append(c[at + 1])
    return np.concatenate(u), np.concatenate(v)


def _docs_row(part: pa.RecordBatch, classes: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """One row with the documents of a slice; the columns of units are null there."""
    known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    ids = np.ascontiguousarray(part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    own = [x.tobytes() for x in (ids, known.astype(np.uint8), np.ascontiguousarray(part.column("key").to_numpy()), classes, sizes.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] + [pa.nulls(1, pa.binary())] * 4 + [pa.array([x], pa.binary()) for x in own], names=[*units.NAMES, *DOCS])


DOCS = ["ids", "known", "texts", "classes", "shingles"]
SIGNED = units.DDL + ", " + ", ".join(f"{c} binary" for c in DOCS)


ROWS_DDL = "doc_id long, key long, class long, n_shingles long"


def _documents(batches):
    """The rows (ROWS_DDL) that _docs_row made."""
    for batch in batches:
        for held in zip(*(batch.column(c).to_pylist() for c in DOCS), strict=True):
            ids, known, keys, classes, sizes = (np.frombuffer(x, t) for x, t in zip(held, (np.int64, np.uint8, np.int64, np.int64, np.int64), strict=True))
            yield _rows({"doc_id": (pa.array(ids, mask=known == 0), pa.int64()), "key": (keys, pa.int64()), "class": (pa.array(classes, mask=sizes == 0), pa.int64()), "n_shingles": (sizes, pa.int64())})


def class_sets(group: pa.Table, gram: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Classes of a unit, ascending, and their sets."""
    found: dict[int, np.ndarray] = {}
    for keys, _, words in units.unpack(group):
        if not all(k in found for k in keys.tolist()):
            for k, own in zip(keys.tolist(), gram_sets(words, gram)[0], strict=True):
                found.setdefault(k, own)
    classes = np.array(sorted(found), np.int64)
    return classes, [found[k] for k in classes.tolist()]


def jaccard_components(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, tile_bytes: int = TILE_BYTES, tile_sets: int = TILE_SETS) -> DataFrame:
    """doc_id, n_shingles, component_id (see the module), a row per row of docs."""
    found = _components(docs, gram, percent, tile_bytes, tile_sets)[0]
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, of which one stays of each component: that of the least doc_id, known ids before
    none, and of the least hash of the text among rows of one id. Of rows equal in doc_id and text one stays, whatever
    their other columns hold; texts without words are in no component."""
    rows, total = _components(docs, gram, percent)
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    rows = staged(rows, "components")
    grouped = rows.filter("component IS NOT NULL").withColumn("place", place)
    first = grouped.groupBy("component").agg(F.min("place").alias("first"), F.count("*").alias("__n"))
    gone = lookup(grouped.select("component", "place"), first, "component", total).filter(F.col("place") != F.col("first"))
    gone = gone.select("place.doc_id", "place.key").distinct()
    twice = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "key")
    twice = twice.join(gone, twice.doc_id.eqNullSafe(gone.doc_id) & (twice.key == gone.key), "left_anti")
    marked = gone.withColumn("__gone", F.lit(True)).unionByName(twice.withColumn("__gone", F.lit(False)))
    marked = small(staged(marked.withColumnsRenamed({"doc_id": "__marked", "key": "__marked_text"}), "marked"), MARKED_ROWS)
    held = docs.select(as_row(docs).alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text_column(docs)).alias("__text"))
    held = held.join(marked, F.col("__id").eqNullSafe(F.col("__marked")) & (F.col("__text") == F.col("__marked_text")), "left")
    once = held.filter("__gone IS NULL").unionByName(held.filter("NOT __gone").dropDuplicates(["__id", "__text"]))
    return once.select("__row.*")


def _components(docs: DataFrame, gram: int, percent: int, tile_bytes: int = TILE_BYTES, tile_sets: int = TILE_SETS) -> tuple[DataFrame, int]:
    """(doc_id, key (hash of the text), n_shingles, component, component_id), a row per row of docs, and the number of
    rows with words; component is null where a row is alone or without words."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).withColumn("key", F.xxhash64("text"))
    n_bytes = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = units.unit_count(n_bytes)

    def signed(batches):
        met: set[int] = set()
        for batch in batches:
            for part in textnum.slices(batch, "text", SLICE_BYTES):
                sets, classes = gram_sets(textnum.Words(*textnum.buffers(part.column("text"))), gram)
                yield _docs_row(part, classes, np.array([len(x) for x in sets], np.int64))
                if len(met) > MOST_MET:
                    met.clear()
                new = []
                for i, c in enumerate(classes.tolist()):
                    if c and c not in met:
                        met.add(c)
                        new.append(i)
                if new:
                    at = np.array(new)
                    rows = units.pack(np.mod(classes[at], parts), classes[at], np.zeros(len(at), np.int64), part.column("text").take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.nulls(rows.num_rows, pa.binary())] * len(DOCS)], names=[*units.NAMES, *DOCS])

    held = staged(base.mapInArrow(frugal(signed), SIGNED), "signed")
    texts = held.filter("unit IS NOT NULL").select(*units.NAMES).repartition(units.partitions(parts), "unit")
    rows = held.filter("unit IS NULL").select(*DOCS).mapInArrow(_documents, ROWS_DDL)
    owners = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.count("*").alias("rows"))
    owners = staged(owners, "classes")
    counts = sketch.Sketch(n_bytes // 6 + 1, THRESHOLDS)
    segments = max(1, n_bytes // 6 // SEGMENT_KEYS + 1)

    def keys_of(group: pa.Table) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *class_sets(group, gram)[1]])

    levels = sketch.answered(texts, "unit", keys_of, counts)

    def postings(unit: pa.Table, answers: pa.Table) -> pa.Table:
        """Prefix grams that may be shared, by segment: a row holds a unit's grams of one segment."""
        classes, sets = class_sets(unit, gram)
        out = []
        if len(sets):
            sizes = np.array([len(x) for x in sets], np.int64)
            flat = np.concatenate(sets)
            level = counts.levels(flat, answers)
            owner = np.repeat(np.arange(len(sets)), sizes)
            by = np.argsort(owner * 4 + level, kind="stable")  # sets are in order of hash already
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            by, place = by[(chosen := (place < (sizes - least_overlap(sizes, percent) + 1)[owner]) & (level[by] > 0))], place[chosen]
            h, who = flat[by], owner[by]
            vectors = range_counts(sets)
            own = (h % np.uint64(segments)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(segments + 1))
            for s in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[s] : cuts[s + 1]]
                entry = (h[at], classes[who[at]], sizes[who[at]], place[at], vectors[who[at]])
                out.append((int(s), *(x.astype(t).tobytes() for x, (_, t) in zip(entry, POSTING, strict=True))))
        cols = list(zip(*out, strict=True)) or [[]] * (1 + len(POSTING))
        return pa.table([pa.array(x, pa.int64() if k == 0 else pa.binary()) for k, x in enumerate(cols)], names=["segment", *[c for c, _ in POSTING]])

    def neighbours(group: pa.Table) -> pa.Table:
        """One edge per class to the least class of its neighbourhood, as far as this segment's grams show it."""
        h, c, size, place, vectors = (np.concatenate([np.frombuffer(x, t) for x in group.column(k).to_pylist()]) for k, t in POSTING)
        u, v = joined_up(*candidate_edges(h, c, size, place, vectors.reshape(-1, POSTED_RANGES), percent))
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    sent = texts.groupBy("unit").cogroup(levels.groupBy("unit")).applyInArrow(postings, "segment long, " + ", ".join(f"{c} binary" for c, _ in POSTING))
    around = star_components(sent.groupBy("segment").applyInArrow(neighbours, "u long, v long"))
    around = staged(owners.join(around, F.col("class") == F.col("node")).select("class", "n", "root"), "neighbourhoods")
    about = around.groupBy("root").agg(F.count("*").alias("__n"), F.sum("n").alias("grams"), F.greatest(F.ceil(F.sum("n") * 8 / F.lit(tile_bytes)), F.ceil(F.count("*") / F.lit(tile_sets))).cast("int").alias("tiles"))
    about = staged(about, "about")
    total = about.agg(F.sum("grams").alias("grams"), F.sum("__n").alias("classes"), F.max("tiles").alias("tiles")).first()
    members, tiled = total.classes or 0, (total.tiles or 0) > 1
    groups = max(1, int(total.grams or 0) * 8 // tile_bytes + 1)
    placed = lookup(around, about.select("root", "tiles", "__n"), "root", members, stage=False)
    single = placed.filter("tiles = 1").select("class", "root", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.pmod(F.xxhash64("root"), F.lit(groups)).alias("task"))
    large = placed.filter("tiles > 1").select("class", "root", "tiles", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int").alias("tile"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # each tile with the first one
    first = large.withColumn("i", F.explode(F.when(F.col("tile") == 0, upto("tiles")).otherwise(F.array("tile"))))
    first = first.select("class", "root", "i", F.lit(0).alias("j"), F.lit(0).alias("side"), F.xxhash64("root", "i").alias("task"))

    def linked(wanted: DataFrame) -> DataFrame:
        """Edges (u, v) from the verification of sets in the groups (task, root, i, j) that are wanted."""

        def carried(unit: pa.Table, wanted: pa.Table) -> pa.Table:
            if not wanted.num_rows:
                return pa.table([pa.array([], t) for t in (*[pa.int64()] * 2, *[pa.int32()] * 3, pa.int64(), pa.binary())], names=["class", "root", "i", "j", "side", "task", "grams"])
            classes, sets = class_sets(unit, gram)
            at = np.searchsorted(classes, wanted.column("class").to_numpy())
            return wanted.select(["class", "root", "i", "j", "side", "task"]).append_column("grams", pa.array([sets[i].tobytes() for i in at.tolist()], pa.binary()))

        def links(group: pa.Table) -> pa.Table:
            ids, root, i, j, side = (group.column(k).to_numpy() for k in ("class", "root", "i", "j", "side"))
            by = np.lexsort((side, ids, j, i, root))
            new = np.ones(len(by), bool)
            new[1:] = np.any([k[by][1:] != k[by][:-1] for k in (root, i, j)], axis=0)
            starts = np.flatnonzero(new)
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(starts, np.append(starts[1:], len(by)), strict=True):
                own = by[a:b]
                if len(own) > 1:
                    label = _verified([np.frombuffer(x, np.uint64) for x in group.column("grams").take(pa.array(own)).to_pylist()], side[own], percent)
                    moved = np.flatnonzero(label != np.arange(len(own)))
                    u.append(ids[own][moved])
                    v.append(ids[own][label[moved]])
            return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in (u, v)], names=["u", "v"])

        wanted = wanted.withColumn("unit", F.pmod("class", F.lit(parts)))
        sets = texts.groupBy("unit").cogroup(wanted.groupBy("unit")).applyInArrow(carried, "class long, root long, i int, j int, side int, task long, grams binary")
        return sets.groupBy("task").applyInArrow(links, "u long, v long")

    edges = staged(linked(single.unionByName(first) if tiled else single), "links")
    if tiled:
        # what is not in the component that most of a large neighbourhood is in, against all of its tiles
        found = star_components(edges).select(F.col("node").alias("class"), F.col("root").alias("part"))
        part = staged(large.join(found, "class", "left").withColumn("part", F.coalesce("part", "class")), "parts")
        sizes = part.groupBy("root", "part").agg(F.count("*").alias("k"))
        main = sizes.groupBy("root").agg(F.max(F.struct("k", "part")).alias("m"), F.sum("k").alias("__n"))
        main = main.filter(F.col("__n") > F.col("m.k")).select("root", F.col("m.part").alias("main"), F.ceil((F.col("__n") - F.col("m.k")) / F.lit(tile_sets)).cast("int").alias("rests"), "__n")
        part = staged(lookup(part, main, "root", members), "parts")
        task = F.xxhash64("root", "i", "j", F.lit(1)).alias("task")
        rest = part.filter("part <> main").withColumn("i", F.pmod(F.xxhash64("class", F.lit(1)), F.col("rests")).cast("int")).withColumn("j", F.explode(upto("tiles")))
        every = part.withColumn("j", F.col("tile")).withColumn("i", F.explode(upto("rests")))
        both = rest.select("class", "root", "i", "j", F.lit(1).alias("side"), task).unionByName(every.select("class", "root", "i", "j", F.lit(0).alias("side"), task))
        edges = edges.unionByName(linked(both))
    return _with_components(rows, owners, star_components(edges))


def _with_components(rows: DataFrame, owners: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """What _components returns, for rows (ROWS_DDL); owners are their classes, roots components of those."""
    linked = staged(owners.join(roots, F.col("class") == F.col("node")).select("class", "root", "doc_id"), "linked")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("__n"))
    total = owners.agg(F.count("*").alias("classes"), F.sum("rows").alias("rows")).first()
    linked = lookup(linked, least, "root", total.classes).select("class", "component_id", F.col("root").alias("linked"))
    shared = owners.join(linked, "class", "left").filter("linked IS NOT NULL OR rows > 1").select("class", F.coalesce("linked", "class").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("rows").alias("__n"))
    out = ["doc_id", "key", "n_shingles", "component", "component_id"]
    with_class = lookup(rows.filter("class IS NOT NULL"), shared, "class", total.rows or 0, "left").select(*out)
    none = F.lit(None).cast("long")
    without = rows.filter("class IS NULL").withColumns({"component": none, "component_id": none}).select(*out)
    return with_class.unionByName(without), total.rows or 0
