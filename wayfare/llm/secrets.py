"""Secret scans, in DataFrame functions only: three patterns, and spans added by two character Markov models.

Base spans are the leftmost non-overlapping matches of each pattern that are long enough (``KINDS``); kinds do not
suppress one another. The method then reads the remaining tokens of 16 or more characters of keys' alphabets. Two
first-order character chains, one of random strings and one of ordinary identifiers, are estimated from labelled
samples with add-one smoothing; a token's score is its log-likelihood ratio per transition, and a token that scores
above the threshold and overlaps no base span is added with kind ``markov``. The threshold is the midpoint between
what ordinary samples hardly reach (their median and four times their upper quartile's distance from it, in standard
deviations, so that some secrets among them do not move it) and the 1st percentile of random ones, never below zero.
Ordinary samples above it are then left out and the chains fitted once more, with samples of no label below it.

The labelled samples of the query do not come from the patterns: random strings over several alphabets and identifiers
made of common words (``made_samples``, the same each time). The other long tokens of all documents (``corpus_tokens``),
each once, are samples without a label: those that the first fit does not find random are ordinary in the second, so
secrets among them are not learnt as ordinary.

Defined results: null and empty texts have no spans; no samples of either label leaves the method silent, base spans
stay; rows are scanned one by one, so equal rows have equal spans.
"""

from __future__ import annotations

import random
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import text_column
from wayfare.plans.staging import cut

# kind, pattern, group whose length counts, least length
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]+"
KINDS = (
    ("assign", ASSIGN + VALUE, 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]+", 24),
)
#: Any text with a span of the kind matches this; the scan for positions then runs on few texts.
MAY_HOLD = {"assign": ASSIGN + r"[A-Za-z0-9+/_.=-]{6}", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: The same matches as the pattern and the length together: a run matched greedily is as long as it can be.
SCAN = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
SPAN = "array<struct<s:int,e:int>>"
#: Alphabets of random samples: base62, base64, base64 for addresses, base36, base32, hexadecimal.
RANDOM = [string.ascii_letters + string.digits + x for x in ("", "+/", "_-")] + [string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_uppercase + "234567", "0123456789ABCDEF", "0123456789abcdef"]
WORDS = """
account active address admin array author block buffer build bytes cache channel check class client code column
command config connection content context count create current data default delete device document driver element
email enable encode error event exception export factory field file filter format function get group handle header
height id image index info init input instance interface internal item key label language last length level line link
list load local log manager map max message method model module name network node number object offset option order
output owner package page parameter parent parse password path pattern permission plugin point policy port prefix
process project property provider query queue range read record reference region remote render report request reset
resource response result root row schema search select server service session set settings size source stack start
state status storage stream string style system table target task template text thread time title token total trace
type update upload url user util value version view widget width window worker write
""".split()


def _no_spans() -> Column:
    return F.array().cast(SPAN)


def spans(text: Column, pattern: str) -> Column:
    """Starts and ends (code points, end exclusive) of the leftmost non-overlapping matches of a pattern."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(F.char_length(b).alias("b"), F.char_length(m).alias("m")))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["b"] + x["m"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["b"]).alias("s"), (acc["at"] + x["b"] + x["m"]).alias("e")))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), _no_spans().alias("out"))
    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def piece(text: Column, span: Column) -> Column:
    return F.substring(text, span["s"] + 1, span["e"] - span["s"])


def _kind_spans(kind: str, pattern: str, least: int) -> Column:
    text = F.col("text")
    if kind in SCAN:
        out = spans(text, SCAN[kind])
    else:
        value_length = lambda s: F.char_length(F.regexp_replace(piece(text, s), "^" + ASSIGN, ""))
        out = F.filter(spans(text, pattern), lambda s: value_length(s) >= least)
    return F.when(F.col("text").rlike(MAY_HOLD[kind]), out).otherwise(_no_spans())


def base_spans(df: DataFrame) -> DataFrame:
    """Adds a column of spans for each kind to rows with a non-null text."""
    for kind, pattern, least in KINDS:
        df = df.withColumn(kind, _kind_spans(kind, pattern, least))
    return df


def _tokens(df: DataFrame, into: str = "tokens") -> DataFrame:
    """Tokens, with at least one letter, that overlap no base span: struct(s, e, t)."""
    clear = lambda t: ~F.exists(F.col("__base"), lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"]))
    df = df.withColumn("__base", F.concat(*[F.col(k) for k, _, _ in KINDS]))
    df = df.withColumn("__at", F.when(F.col("text").rlike(TOKEN), spans(F.col("text"), TOKEN)).otherwise(_no_spans()))
    found = F.transform(F.filter("__at", clear), lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), piece(F.col("text"), s).alias("t")))
    return df.withColumn(into, F.filter(found, lambda x: x["t"].rlike("[A-Za-z]"))).drop("__at", "__base")


#: The label of samples that may be of either kind.
UNLABELLED = -1


def made_samples() -> list[tuple[str, int]]:
    """Labelled samples (text, label): 1 for random strings over each of RANDOM, 0 for identifiers of several styles."""
    rng = random.Random(20)
    out = [("".join(rng.choice(a) for _ in range(rng.randint(16, 64))), 1) for a in RANDOM for _ in range(250)]
    for _ in range(2000):
        words = [rng.choice(WORDS) for _ in range(rng.randint(2, 5))]
        while sum(map(len, words)) < 16:
            words.append(rng.choice(WORDS))
        camel = "".join(w.title() for w in words)
        out.append((rng.choice((camel, words[0] + camel[len(words[0]) :], "_".join(words), "-".join(words), "/".join(words), "_".join(words).upper())), 0))
    return out


def corpus_tokens(docs: DataFrame) -> DataFrame:
    """The long tokens of all documents that overlap no base span, each once: text."""
    rows = _tokens(base_spans(docs.select(text_column(docs).alias("text"))))
    return rows.select(F.explode("tokens").alias("x")).select(F.col("x.t").alias("text")).distinct()


def made_table(spark: SparkSession) -> DataFrame:
    """The labelled samples as a table that no Python worker has to read."""
    text, label = zip(*made_samples(), strict=True)
    return spark.createDataFrame(pa.table({"text": pa.array(text, pa.string()), "label": pa.array(label, pa.int32())}))


def default_samples(docs: DataFrame) -> DataFrame:
    made = made_table(docs.sparkSession)
    return cut(corpus_tokens(docs).withColumn("label", F.lit(UNLABELLED)).unionByName(made))


def transitions(text: Column) -> Column:
    width = len(ALPHABET) + 1
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(1))), lambda i: F.call_function("locate", F.substring(text, i, F.lit(1)), F.lit(ALPHABET)) * width + F.call_function("locate", F.substring(text, i + 1, F.lit(1)), F.lit(ALPHABET)))


class MarkovPair:
    """Log-likelihood ratios of all transitions, and the threshold; a fixed few thousand numbers."""

    def __init__(self, ratios: np.ndarray, threshold: float):
        self.ratios, self.threshold = ratios, threshold

    @classmethod
    def train(cls, samples: DataFrame) -> MarkovPair | None:
        """From (text, label) rows; None where a label has no samples. Unlabelled ones count as ordinary from the second
        fit on, if the first does not find them random."""
        width = len(ALPHABET) + 1
        samples = samples.filter(F.char_length("text") > 1)
        pair, fitted = None, samples.filter(F.col("label") != UNLABELLED)
        for _ in range(2):
            counts = fitted.select("label", F.explode_outer(transitions(F.col("text"))).alias("k")).groupBy("label", "k").count().collect()  # at most 2 * 67 ** 2 rows
            table = np.ones((2, width, width))
            seen = [0, 0]
            for row in counts:
                table[row.label, row.k // width, row.k % width] += row["count"]
                seen[row.label] += row["count"]
            if not all(seen):
                return pair
            logp = np.log(table / table.sum(axis=2, keepdims=True))
            pair = cls((logp[1] - logp[0]).ravel(), 0.0)
            scored = fitted.withColumn("score", pair.score(F.col("text")))
            marks = {r.label: r.q for r in scored.groupBy("label").agg(F.percentile_approx("score", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.75)), 10_000).alias("q")).collect()}
            _, middle, upper = marks[0]
            pair.threshold = max(0.0, (middle + 4 * (upper - middle) / 0.6745 + marks[1][0]) / 2)
            scored = samples.withColumn("score", pair.score(F.col("text")))
            fitted = scored.filter((F.col("label") == 1) | (F.col("score") <= F.lit(float(pair.threshold)))).select("text", F.greatest("label", F.lit(0)).alias("label"))
        return pair

    def score(self, text: Column) -> Column:
        """Log-likelihood ratio per transition, random against ordinary."""
        table = F.lit(self.ratios)
        total = F.aggregate(transitions(text), F.lit(0.0), lambda acc, k: acc + F.get(table, k))
        return total / F.greatest(F.char_length(text) - 1, F.lit(1))


def scan(df: DataFrame, model: MarkovPair | None) -> DataFrame:
    """Adds assign, access, hex and markov: spans of each kind, to rows with a text column."""
    df = base_spans(df.withColumn("text", text_column(df)))
    if model is None:
        return df.withColumn("markov", _no_spans())
    df = _tokens(df, "__tokens")
    added = F.filter("__tokens", lambda t: model.score(t["t"]) > F.lit(float(model.threshold)))
    return df.withColumn("markov", F.transform(added, lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e")))).drop("__tokens")


def listed(kinds: list[str]) -> Column:
    """kind:start:end of the spans, by start, then kind as given, joined by commas."""
    tag = lambda i: lambda s: F.struct(s["s"].alias("s"), F.lit(i).alias("k"), s["e"].alias("e"))
    tagged = F.concat(*[F.transform(k, tag(i)) for i, k in enumerate(kinds)])
    name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(tagged), lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_spans(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov (see the module)."""
    model = MarkovPair.train(default_samples(docs) if samples is None else samples)
    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")
    kinds = [k for k, _, _ in KINDS]
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(listed(kinds), 256).alias("base_sha256"),
        listed([*kinds, "markov"]).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )


def redacted(docs: DataFrame, samples: DataFrame | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs, same columns, each text with its spans (merged where they overlap) replaced by the mask; texts without
    spans, nulls too, stay as they are."""
    model = MarkovPair.train(default_samples(docs) if samples is None else samples)
    # the given columns travel as one struct, so that none can clash with the columns of the scan
    rows = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text")), model)
    every = F.array_sort(F.concat(*[F.col(k) for k, _, _ in KINDS], F.col("markov")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        piece_before = F.substring(F.col("text"), acc["at"] + 1, s["s"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["e"]).alias("at"),
            F.when(s["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], piece_before, F.lit(mask))).alias("out"),
        )

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text")))
    rows = rows.withColumn("__all", every).withColumn("__cleaned", F.aggregate(F.col("__all"), start, step, rest))
    found = F.size("__all") > 0
    given = lambda c: F.col("__row")[c]
    new = {"text": F.when(found, F.col("__cleaned")).otherwise(given("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(found, F.char_length("__cleaned").cast(dict(docs.dtypes)["n_chars"])).otherwise(given("n_chars"))
    return rows.select(*[new.get(c, given(c)).alias(c) for c in docs.columns])
