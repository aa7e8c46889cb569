import hashlib
import itertools
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfare.llm import quality, store, textnum
from wayfare.llm.bpe import Bpe, Lexicon, build_lexicon
from wayfare.llm.encoding import Encoder, LibraryEncoder, decimals, decode, encode, round_trip
from wayfare.llm.html import main_text
from wayfare.llm.sampling import fold_of
from wayfare.llm.toxicity import ToxicityModel, toxicity, toxicity_scores

DOCS = "doc_id long, text string"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
ENCODERS = {p: Encoder(p) for p in (BYTE, WORD)}
LIBRARY_ENCODERS = {p: LibraryEncoder(p, 500) for p in (BYTE, WORD)}
ODD = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("abcXYZ019 \n\t'.,!?ÉßΣςİſḰ中😀🏽́‍\x1c\x85　"))), max_size=80)
TEXTS = [(1, "Hello  world, it's I'LL\n\n  x"), (2, None), (3, ""), (4, "a<|endoftext|>b <|startoftext|>"), (5, "né 中文 😀👍🏽 " * 50), (5, "x"), (None, "no id"), (6, "z" * 5000 + " " + "ab" * 400), (7, " \t\n ")]


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(text=ODD)
def test_encoder_is_the_library(path, text):
    assert ENCODERS[path].encode([text])[0].tolist() == LIBRARY[path].encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(text=ODD)
def test_byte_round_trip(text):
    ids = ENCODERS[BYTE].encode([text])
    assert ENCODERS[BYTE].decode(ids) == [text] == [LIBRARY[BYTE].decode(ids[0].tolist(), skip_special_tokens=False)]
    assert decimals(ids[0]).decode() == ",".join(map(str, ids[0].tolist()))


def test_long_words_and_small_caches():
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in (1, 2, 63, 64, 65, 300)]
    small = Encoder(BYTE, cache_pieces=8)
    for w in [*words, " ".join(words * 3)]:
        assert small.encode([w])[0].tolist() == LIBRARY[BYTE].encode(w, add_special_tokens=False).ids


def test_lexicon_is_a_minimal_map(tmp_path):
    bpe = Bpe(BYTE)
    words = sorted({w.encode() for w in "tap taps top tops stop stops a é ✓ tapped topped stopped".split()})
    ids = dict(zip(words, bpe.encode_words(words), strict=True))
    data = build_lexicon(ids)
    data.tofile(tmp_path / "lexicon.u32")
    lexicon = Lexicon(np.memmap(tmp_path / "lexicon.u32", np.uint32, "r"))
    numbers = lexicon.numbers([*words, b"", b"ta", b"tapz", b"zzz"])
    assert sorted(numbers[: len(words)].tolist()) == list(range(len(words)))
    assert numbers[len(words) :].tolist() == [-1] * 4
    assert all(np.array_equal(lexicon.lookup(int(n)), ids[w]) for n, w in zip(numbers, words, strict=False))
    assert len(lexicon.final) < sum(map(len, words)) / 1.5  # suffixes are shared
    assert Lexicon(build_lexicon({})).numbers([b"a"]).tolist() == [-1]


def test_round_trip_query(spark):
    docs = spark.createDataFrame([(*t, 1, 2) for t in TEXTS], DOCS + ", n_tokens int, ids int")
    expected = []
    for d, t in TEXTS:
        ids = LIBRARY[BYTE].encode(t or "", add_special_tokens=False).ids
        expected.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY[BYTE].decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((tuple(r) for r in round_trip(docs, BYTE, 64).collect()), key=str) == sorted(expected, key=str)
    assert round_trip(spark.createDataFrame([], DOCS), BYTE).count() == 0
    back = decode(encode(docs, BYTE, 64), BYTE)
    assert all(r.decoded == (r.text or "") for r in back.collect())


def test_store(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    rows = [*TEXTS, (8, "the same passage again " * 600), (9, "other " + "the same passage again " * 600)]
    docs = spark.createDataFrame([(*t, 1) for t in rows], DOCS + ", kind int").repartition(3)
    store.write_store(docs, WORD, folder, log_chunk=5)
    store.verify_manifest(spark, folder)
    found = sorted(store.document_crcs(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append([*LIBRARY[WORD].encode(t or "", add_special_tokens=False).ids, 1])
    at = 0
    for r in found:
        crcs = {zlib.crc32(np.array(x, "<u4").tobytes()): len(x) for x in ids[r.doc_id]}
        assert r.start == at and crcs[r.ids_crc32] == r.n_tokens
        at += r.n_tokens
    whole = {(r.doc_id, tuple(r.ids)) for r in store.read_documents(spark, folder).collect()}
    assert whole == {(d, tuple(x)) for d, xs in ids.items() for x in xs}
    chunks = store._chunks(spark, folder)
    assert chunks.count() == chunks.select("digest").distinct().count()
    total = chunks.agg(F.sum(F.length("body") / 2)).first()[0]
    assert total < sum(r.n_tokens for r in found)  # repeated passages are stored once


def damaged(spark, folder, table, change):
    """Rewrite a table of a store."""
    df = change(spark.read.parquet(f"{folder}/{table}"))
    rows = spark.createDataFrame(df.collect(), df.schema)
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("kind") if table == "parts" else writer).parquet(f"{folder}/{table}")


DAMAGE = {
    "body": ("parts", lambda df: df.withColumn("body", F.when(F.length("body") > 8, F.concat(F.lit(b"\1\1"), F.expr("substring(body, 3)"))).otherwise(F.col("body"))), "digest"),
    "missing": ("parts", lambda df: df.filter("body IS NULL OR length(body) < 9"), "missing"),
    "leaf": ("recipes", lambda df: df.withColumn("leaf", F.lit(b"0" * 16)), "leaf"),
    "size": ("recipes", lambda df: df.withColumn("n_tokens", F.col("n_tokens") + 1), "follow"),
}


@pytest.mark.parametrize("kind", DAMAGE)
def test_store_query_finds_damage(spark, tmp_path, monkeypatch, kind):
    from wayfare.llm import queries

    table, change, message = DAMAGE[kind]
    spark.createDataFrame(TEXTS, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    write, folders = store.write_store, []

    def write_and_damage(docs, tokenizer, folder):
        write(docs, tokenizer, folder)
        folders.append(folder)
        damaged(spark, folder, table, change)

    monkeypatch.setattr(store, "write_store", write_and_damage)
    if kind == "leaf":
        with pytest.raises(Exception, match=message):
            store.document_crcs(spark, _written(spark, tmp_path, write, table, change)).collect()
        return
    with pytest.raises(Exception, match=message):
        queries.op10_token_store(spark, str(tmp_path)).collect()


def _written(spark, tmp_path, write, table, change):
    folder = f"file://{tmp_path}/store"
    write(spark.read.parquet(f"{tmp_path}/documents.parquet"), WORD, folder)
    damaged(spark, folder, table, change)
    return folder


def test_chunk_that_many_documents_use(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    rows = [(i, "" if i % 3 else f"own words {i}") for i in range(3000)]
    store.write_store(spark.createDataFrame(rows, DOCS), WORD, folder)
    found = {r.doc_id: r.ids for r in store.read_documents(spark, folder).collect()}
    assert all(found[i] == [*LIBRARY[WORD].encode(t, add_special_tokens=False).ids, 1] for i, t in rows)


def test_store_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    store.write_store(spark.createDataFrame([], DOCS), WORD, folder)
    store.verify_manifest(spark, folder)
    assert store.document_crcs(spark, folder).count() == 0


def test_cuts_follow_content():
    rng = np.random.RandomState(4)
    body = rng.randint(0, 49000, 4000).astype(np.uint16)
    one = lambda x, *how: store.cuts(x, np.array([0, len(x)]), *how)
    a, b = one(body, 6), one(np.concatenate([rng.randint(0, 49000, 37).astype(np.uint16), body]), 6) - 37
    assert a[-1] == 4000 and len(set(a[1:].tolist()) & set(b.tolist())) > 0.95 * (len(a) - 1)
    same = one(np.zeros(50_000, np.uint16), 6, 1000)
    assert np.diff(same, prepend=0).max() <= 1000 and same[-1] == 50_000
    both = store.cuts(np.concatenate([body, body[:50], body]), np.array([0, 4000, 4050, 8050]), 6)
    assert set(a.tolist()) | {4050} | set((a + 4050).tolist()) <= set(both.tolist())
    assert [e for e in both.tolist() if e > 4050] == (a + 4050).tolist()


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(ODD, max_size=6))
def test_library_encoder_is_the_library(path, texts):
    encoder = LIBRARY_ENCODERS[path]
    ids, at = encoder.encode(pa.array([*texts, None], pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [LIBRARY[path].encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


def test_library_encoder_in_small_steps():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("aA'é1.&<|") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 400))) for _ in range(40)]
    texts += ["x" * 30_000 + " y", "a<|endoftext|>b<|ENDOFTEXT|> <|startoftext|>" * 300, "a", "&b", "1", "2"]
    small = LibraryEncoder(WORD, 100)
    small.SLICE_BYTES, small.WORDS_AT_ONCE = 500, 30
    for _ in range(2):
        ids, at = small.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [LIBRARY[WORD].encode(t, add_special_tokens=False).ids for t in texts]


PAGE = "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy, now. Really, buy.</div>{}<footer>&copy; me, all rights.</footer></body></html>"
ARTICLE = "<article><h1>Title &amp; more</h1><p>First, a <b>long\n paragraph</b> of text, with points; and more. Yes.</p><p>Ok.<p>Unclosed &eacute;<br>line &lt;x&gt;</p></article>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a>x</a></nav>", ""),
        ("plain", "plain"),
        (PAGE.replace("{}", ARTICLE), "Title & more First, a long paragraph of text, with points; and more. Yes. Ok. Unclosed é line <x>"),
        (PAGE.replace("{}", "<main>" + ARTICLE + "<div id='comments'><p>I think, well, that this is bad. Very bad.</p></div><form>Mail: <input></form></main>"), "Title & more First, a long paragraph of text, with points; and more. Yes. Ok. Unclosed é line <x>"),
        (PAGE.replace("{}", "<div class='content'><p>One, two, three. Four five, six; seven.</p><p>End.</p></div><aside class='sidebar'>Links, and links.</aside><div class='cookie-notice'>We use, well, cookies.</div>"), "One, two, three. Four five, six; seven. End."),
        ("<p>a < b & c", "a < b & c"),
        ("<p>x<!-- <p>y</p> --><p>z<!-- open", "x z"),
        (PAGE.replace("{}", ""), ""),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


LONG = ["The river, which was high, ran past the mill; nobody saw it, or so they said.", "In March, after the frost, the miller came back. He said nothing, and left.", "Later, much later, they found the boat, the oars, and a letter; it was empty."]
LINKS = "".join(f"<li><a href='/{i}'>Other story number {i}</a></li>" for i in range(6))
#: Neither article elements nor telling names: paths alone tell content from menus, lists of links and fine print.
UNNAMED = [
    (f"<body><div><ul>{LINKS}</ul></div><div><h1>The mill</h1><p>{LONG[0]}</p><p>{LONG[1]}</p><ul>{LINKS}</ul><p>{LONG[2]}</p></div><div>Imprint <a>contact</a></div></body>", " ".join(["The mill", *LONG])),
    (f"<body><table><tr><td><a>Home</a></td><td><a>News</a></td></tr></table><div class=c1><h2>The mill</h2><p>{LONG[0]}<p>{LONG[1]}<div class=c2><a>One</a> <a>Two</a></div><div class=c2><a>Three</a></div><p>{LONG[2]}</div><div class=c3>Top</div></body>", " ".join(["The mill", *LONG])),
    (f"<body><div><div>{LONG[0]}</div><div>{LONG[1]}</div><div>{LONG[2]}</div><ol>{LINKS}</ol></div><div><ul>{LINKS}</ul></div></body>", " ".join(LONG)),
]


@pytest.mark.parametrize(("html", "text"), UNNAMED)
def test_paths_choose_content_without_names(html, text):
    assert main_text(html) == text
    assert main_text(html, 0.0, 0.0) != text  # without thresholds every path is content


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><p class=it's>{LONG[0]}</p><p>{LONG[1]}</p></article>", " ".join(LONG[:2])),
        (f"<article><p>{LONG[0]}</p><div class='side-effects'><p>{LONG[1]}</p></div><div class='related work'><p>{LONG[2]}</p></div></article>", " ".join(LONG)),
        (f"<article><p>{LONG[0]}</p><div class='related'><ul>{LINKS}</ul></div><div class='ad-box'><p>{LONG[1]}</p></div></article>", LONG[0]),
        (f"<article><p>{LONG[0]}</p><p title=\"a > b\" data-x='it\"s'>{LONG[1]}</p><p x=\"open>{LONG[2]}</p></article>", " ".join(LONG)),
        (f"<article><p>{LONG[0]}</p><ul><li>one pear</li><li>two figs</li></ul><p>{LONG[1]}</p></article>", f"{LONG[0]} one pear two figs {LONG[1]}"),
    ],
)
def test_main_text_of_odd_markup(html, text):
    assert main_text(html) == text


def test_deep_and_broken_pages_take_linear_time():
    import time

    def seconds(n):
        pages = ["<div>" * n + LONG[0] + "</div>" * n, "<div>x" * n, "<b><p>" * n + "</section>" * n, "<blockquote>" * n + "<p>y" * n, "<a href=" * n, "<!-- " * n]
        began = time.process_time()
        texts = [main_text(p) for p in pages]
        assert texts[0] == LONG[0]
        return time.process_time() - began

    seconds(100)
    small, large = seconds(2_000), seconds(20_000)
    assert large < 30 * small + 1


def test_path_ratios_are_brute_force():
    import math

    from wayfare.llm.html import Page, content_paths, path_ratios

    for html, _ in UNNAMED:
        found = Page(html).blocks
        per = {b.path: [x for x in found if x.path == b.path] for b in found}
        size = [sum(len(x.text) for x in per[b.path]) / len(per[b.path]) for b in found]
        marks = [sum(sum(c in ".,;:!?" for c in x.text) for x in per[b.path]) / len(per[b.path]) for b in found]
        near = lambda s, i: 0.25 * s[max(i - 1, 0)] + 0.5 * s[i] + 0.25 * s[min(i + 1, len(s) - 1)]
        open_share = [1 - sum(x.linked for x in per[b.path]) / sum(len(x.text) for x in per[b.path]) for b in found]
        fused = np.array([math.log2(1 + near(size, i)) * math.log2(2 + near(marks, i)) * open_share[i] for i in range(len(found))])
        ratios, spread = path_ratios(found)
        assert spread == pytest.approx(fused.std())
        for path in per:
            assert ratios[path] == pytest.approx(np.mean([f for f, b in zip(fused, found, strict=True) if b.path == path]))
        assert set(content_paths(found)) == {p for p in per if ratios[p] >= min(max(ratios.values()), (1.0 if per[p][0].generic else 0.25) * spread)}


def test_pages_are_the_article(spark, sf_dir):
    import re
    from html import unescape

    from wayfare.llm.html import extract

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    held = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages.withColumn("text", F.lit(1))).collect():
        inner = re.search(r"<article>(.*?)</article>", held[r.page_id], re.S)[1]
        assert r.text == " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split())
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def rated(n=160):
    rng = random.Random(8)
    good, fair, bad = (["harbour", "lantern", "meadow", "orchid", "river"], ["so", "like", "stuff", "thing"], ["|", "$$$", "!!!", "###"])
    rows = []
    for i in range(n):
        g = i % 3
        words = [rng.choice((bad, fair, good)[g] if rng.random() < 0.8 else ["the", "and", "of"]) for _ in range(30)]
        rows.append((i, " ".join(words), g))
    return rows


def test_ordinal_grades(spark):
    rows = rated()
    model = quality.OrdinalModel.train([t for _, t, _ in rows[:100]], [g for *_, g in rows[:100]])
    assert np.all(np.diff(model.thresholds) > 0) and model.grades == [0, 1, 2]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows[100:]] + [(900, None), (901, "")], DOCS)
    out = {r.doc_id: r for r in quality.grade(docs, model, least=1).collect()}
    near = [abs(out[i].expected_grade - g) < 0.5 for i, _, g in rows[100:]]
    assert np.mean(near) > 0.9 and out[900].expected_grade == out[901].expected_grade
    assert all(0 <= r.tail_probability <= 1 and r.kept == (r.tail_probability >= 0.5) for r in out.values())


def test_slope_is_that_of_the_loss():
    rows = rated(24)
    entries = quality._sparse([t for _, t, _ in rows])
    above = np.array([g for _, _, g in rows])[:, None] > np.arange(2)
    rng = np.random.RandomState(0)
    params = np.concatenate([rng.normal(0, 0.05, 1 << quality.LOG_FEATURES), [0.3, -0.4]])
    found = quality.slope(params, entries, above)
    for k in [*np.unique(entries[1])[::17].tolist(), len(params) - 2, len(params) - 1]:
        step = np.zeros_like(params)
        step[k] = 1e-5
        assert found[k] == pytest.approx((quality.loss(params + step, entries, above) - quality.loss(params - step, entries, above)) / 2e-5, abs=1e-6)
    model = quality.OrdinalModel.train([t for _, t, _ in rows], [g for _, _, g in rows])
    fitted = np.concatenate([model.weights, [model.thresholds[0], np.log(np.expm1(np.diff(model.thresholds)[0]))]])
    assert quality.loss(fitted, entries, above) < 0.5 * quality.loss(np.concatenate([np.zeros(1 << quality.LOG_FEATURES), fitted[-2:]]), entries, above)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels, folds=(1, 2, 3, 4))
    out = {r.doc_id: r.kept for r in quality.grade(docs, model).select("doc_id", "kept").collect()}
    held = [(out[r.doc_id], bool(r.quality)) for r in labels.collect() if fold_of(r.doc_id) == 0 and r.quality is not None]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95


def test_quality_without_ratings(spark):
    docs, none = spark.createDataFrame([(1, "a"), (2, None)], DOCS), spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.kept, r.expected_grade) for r in quality.quality(docs, none).collect()} == {(True, 0.0)}
    assert quality.quality(spark.createDataFrame([], DOCS), none).count() == 0


def toxic_rows(n=400):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice(["an", "er", "th", "ing", "ou", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for w in rng.sample(["grobnik", "vexling", "snorfle", "quibbet"], 3):
                words[rng.randrange(60)] = w
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "score") for i, t, _ in rows] + [(9001, None, ""), (9002, "  ", "")], DOCS + ", score string")
    labels = spark.createDataFrame([(i, y if fold_of(i) else 1 - y) for i, _, y in rows], "doc_id long, toxic int")  # held-out labels lie: they must not count
    out = {r.doc_id: r for r in toxicity_scores(docs, labels).collect()}
    assert all(r.held_out == (fold_of(r.doc_id) == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in out.values())
    assert np.mean([out[i].predicted == y for i, _, y in rows if fold_of(i) == 0]) > 0.95
    assert out[9001].score == out[9002].score


def test_toxicity_without_labels(spark):
    docs, none = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], DOCS), spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity_scores(docs, none).collect()] == [0.0] * 3
    model = ToxicityModel.train([SimpleNamespace(doc_id=i, text="x", label=1) for i in range(20)])
    assert toxicity(docs, model).first().score == 1.0


def test_encode_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6), (2, None, 7, 8)], "doc_id long, text string, `a.b` int, ids int")
    out = {r.doc_id: r for r in encode(docs, BYTE).collect()}
    assert out[1]["a.b"] == 5 and out[1].ids == LIBRARY[BYTE].encode("a b", add_special_tokens=False).ids and out[2].n_tokens == 0
    graded = quality.grade(docs.withColumn("kept", F.lit("x")), quality.OrdinalModel.train(["a", "b"], [0, 1])).collect()
    assert all(isinstance(r.kept, bool) and r["a.b"] in (5, 7) for r in graded)


def test_workers_keep_one_encoder_and_none_for_other_operators(spark):
    """One partition after another, so that one worker serves all of them."""
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], DOCS).coalesce(1)

    def held(batches):
        import gc

        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([sum(type(o).__name__ == "Encoder" and "wayfare" in type(o).__module__ for o in gc.get_objects())], pa.int64())], names=["n"])

    def alive():
        return docs.mapInArrow(held, "n long").first().n

    for _ in range(3):
        round_trip(docs, BYTE, lexicon_pieces=10).collect()
    assert alive() == 1
    quality.grade(docs, quality.OrdinalModel.train(["a", "b"], [0, 1])).collect()
    assert alive() == 0


def arrow_input(df):
    """Type of what the MapInArrow node of a plan hands to Python."""
    node = df._jdf.queryExecution().optimizedPlan()
    while "MapInArrow" not in node.nodeName():
        node = node.children().head()
    return node.children().head().schema().simpleString()


def test_texts_cross_to_python_once(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b", 3), (2, None, 0), (3, "", 0)], "doc_id long, text string, n_chars long")
    model = quality.OrdinalModel.train(["a b", "c d"], [1, 0])
    kept = quality.kept_rows(docs, model)
    for df in (encode(docs, BYTE), quality.grade(docs, model), kept):
        assert arrow_input(df).count("text:string") == 1
    graded = quality.grade(docs, model).collect()
    assert [r.text for r in graded] == ["a b", None, ""]
    assert [tuple(r) for r in kept.collect()] == [tuple(r)[:3] for r in graded if r.kept]
    assert [(r.text, r.n_tokens) for r in encode(docs, BYTE).collect()] == [("a b", 2), (None, 0), ("", 0)]
    assert corpus_pipeline.encoding_stage(spark, docs, "").columns == ["doc_id", "n_chars", "n_tokens", "ids"]


def test_pipeline_stages_cope_with_odd_tables(spark, tmp_path):
    """Repeated ids, nulls in every column, clashing and dotted names, and empty tables, at every stage."""
    import corpus_pipeline

    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, ids string, kept int, markov string, class string"
    rows = [(1, "some words here now and then", "en", None, 5, 1, "x", 2, None, "c"), (1, "some words here now and then", "en", None, 5, 1, "x", 2, None, "c"), (1, "quite other words of this text", None, "s", None, None, None, None, "m", None), (None, None, None, None, None, None, None, None, None, None), (2, "", "en", "s", 0, 1, "", 0, "", "")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "unrelated item of the benchmark"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]
            assert out.count() <= len(table)
    near = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, schema), folder)
    assert sorted(str(r.text) for r in near.collect()) == sorted(["some words here now and then", "quite other words of this text", "None", ""])


def test_pipeline_on_fixture(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    base = rated(90)
    rng = random.Random(3)
    clean = " ".join(rng.choice(["harbour", "lantern", "meadow", "orchid", "river", "stone", "valley"]) for _ in range(80))
    item = "benchmark question about seven green bottles standing on the old garden wall tonight"
    docs = [(i, t, "en", "s", len(t)) for i, t, _ in base] + [(500, clean, "en", "s", 1), (501, clean + " tail", "en", "s", 1), (502, f"river {item} river meadow " * 2, "en", "s", 1), (503, "meadow river orchid password=abcdef123 lantern " * 2, "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(g > 0)) for i, _, g in base], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert 500 in out and 501 not in out and 502 not in out and 503 in out
    bad = [i for i, _, g in base if g == 0]
    assert not set(bad) & set(out) and len([i for i, _, g in base if g and i in out]) > 50
    text = ENCODERS[BYTE].decode([np.array(out[503].ids)])[0]
    assert text.count("[SECRET]") == 2 and "abcdef123" not in text and out[503].n_tokens == len(out[503].ids)
    assert [k for k, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_known_pieces_are_found_in_their_slots(monkeypatch):
    rng = np.random.RandomState(4)
    texts = [" ".join(f"w{rng.randint(400)} {''.join(chr(97 + c) for c in rng.randint(0, 26, 9))}" for _ in range(60)) for _ in range(40)]
    expected = [LIBRARY[WORD].encode(t, add_special_tokens=False).ids for t in texts]

    def same(encoder):
        ids, first = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(first.tolist())] == expected

    tiny = LibraryEncoder(WORD, 3)  # slots are lost within a slice, the pool is tidied between slices
    tiny.SLICE_BYTES = 2000
    for _ in range(3):
        same(tiny)
    assert tiny.filled <= 8 * len(tiny.slots) + 10_000
    large = LibraryEncoder(WORD, 100_000)
    same(large)
    sorted_at_once, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, *a, **b: sorted_at_once.append(len(x)) or unique(x, *a, **b))
    same(large)
    assert sum(sorted_at_once) < 50  # hardly any piece is sorted, or learnt, again


def test_runs_of_words_stay_within_their_texts():
    rng = np.random.RandomState(8)
    for sizes in ([0], [3, 0, 1, 5, 4, 0], rng.randint(0, 9, 200).tolist()):
        first = np.concatenate([[0], np.cumsum(sizes)])
        words = rng.randint(0, 3, first[-1]).astype(np.uint64)
        for k in (1, 2, 4):
            h, at = textnum.runs(textnum.mix(words + np.uint64(1)), first, k)
            places = [i for a, b in itertools.pairwise(first.tolist()) for i in range(a, b - k + 1)]
            assert at.tolist() == places and len(h) == len(places)
            assert len(set(zip(h.tolist(), (tuple(words[i : i + k].tolist()) for i in places), strict=True))) == len(set(h.tolist())) == len({tuple(words[i : i + k].tolist()) for i in places})
    raw = np.frombuffer(b"one Two three-and-a-word-of-more-than-thirty-two-bytes", np.uint8)
    starts, ends = np.array([0, 4, 8]), np.array([3, 7, len(raw)])
    for folded in (False, True):
        assert all(np.array_equal(h, textnum.span_hashes(raw, starts, ends, folded, salt)) for salt, h in enumerate(textnum.salted_hashes(raw, starts, ends, (0, 1, 2), folded)))
