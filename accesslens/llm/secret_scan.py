"""Secrets by a battery of randomness tests, in native expressions.

Besides three fixed kinds, every run of token characters whose encoding can be
inferred is tested.  Each test takes the run for structured until shown
otherwise: the chi-squared test for one that uses no more than half of its
encoding's alphabet, the runs test for one that keeps to a side of the alphabet
(or changes it) four times in five, the test of serial correlation for one of
0.7 or more.  A run is random if all three are rejected, so its p-value is the
largest of theirs; Benjamini and Hochberg's procedure, run apart for each class
of lengths, bounds the share of structured runs among those reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Carried, read_table, stage, text_or_empty
from .spans import SPAN, as_spans, bind, count_kind, joined, matches, moved, segments

KINDS = ("assign", "access", "hex")
#: The patterns of the three kinds.
KEYS = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = KEYS + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = "^" + KEYS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
RUN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}"
MAY = KEYS + "|AKIA|[0-9a-f]{24}|" + RUN
#: Alphabets of the encodings, in order of code.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
CLASSES = (24, 32, 40, 64)
RATE = 0.05
#: What counts as structured: the share of the alphabet in use, the share of changes of side, the serial correlation.
USED, CHANGES, SERIAL = 0.5, 0.2, 0.7
RUNS = "array<struct<s:int,e:int,m:string,kind:string>>"
TESTED = "array<struct<s:int,e:int,class:int,p:double>>"


def base_spans(text: Column) -> Column:
    """Spans of the three kinds in a segment, as ``SPAN`` in order."""
    assign = F.filter(matches(text, ASSIGN, text.rlike(KEYS)), lambda x: F.length(F.regexp_extract(x["m"], VALUE, 1)) >= 6)
    access = matches(text, ACCESS, text.contains("AKIA"))
    hexes = matches(text, HEX, text.rlike("[0-9a-f]{24}"))
    return F.sort_array(F.concat(*(as_spans(x, k, i) for i, (k, x) in enumerate(zip(KINDS, (assign, access, hexes), strict=True)))))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, to 1e-7 (a published rational approximation)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding(run: Column) -> Column:
    """The narrowest encoding that a run of letters and digits may have, in either case; null for digits alone."""
    upper = F.upper(run)
    one_case = (run == upper) | (run == F.lower(run))
    narrow = F.when(run.rlike("^[A-Za-z]+\\z"), "letters").when(upper.rlike("^[0-9A-F]+\\z"), "hex").when(upper.rlike("^[A-Z2-7]+\\z"), "base32").when(upper.rlike("^[A-Z0-9]+\\z"), "base36")
    return F.when(run.rlike("[A-Za-z]"), F.coalesce(F.when(one_case, narrow), F.lit("base64")))


def battery(run: Column, kind: Column) -> Column:
    """The largest p-value of the three tests of a run, each against structure of its sort."""

    def tests(b: Column) -> Column:
        codes, n, a = b["codes"], b["n"], b["a"]
        squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.size(F.array_remove(codes, c)), 2))
        # chi-squared against uniform symbols, where in truth USED * a symbols are equally likely
        same = 1 / (USED * a)
        mean_chi, spread_chi = a * (1 - same) + n * (a * same - 1), (a / n) * F.sqrt(2 * n * (n - 1) * same * (1 - same))
        z_chi = (mean_chi - (squares * a / n - n)) / spread_chi
        mean, spread, start = (a - 1) / 2, (a * a - 1) / 12, F.struct(F.lit(0.0).alias("turns"), F.lit(0.0).alias("serial"))

        def step(acc: Column, i: Column) -> Column:
            x, y = F.get(codes, i), F.get(codes, i - 1)
            return F.struct((acc["turns"] + ((x > mean) != (y > mean)).cast("int")).alias("turns"), (acc["serial"] + (x - mean) * (y - mean)).alias("serial"))

        def combined(w: Column) -> Column:
            turns = F.least(w["turns"], n - 1 - w["turns"])
            z_runs = (turns - CHANGES * (n - 1)) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES))
            z_serial = (SERIAL - F.abs(w["serial"]) / ((n - 1) * spread)) * F.sqrt((n - 1) / (1 - SERIAL * SERIAL))
            return upper_tail(F.least(z_chi, z_runs, z_serial))

        return bind(F.aggregate(F.sequence(F.lit(1), F.size(codes) - 1), start, step), combined)

    alphabet = F.element_at(F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair]), kind)
    cased = F.when(kind == "hex", F.lower(run)).when(kind == "base64", F.translate(run, "-_", "+/")).otherwise(F.upper(run))
    plain = F.regexp_replace(cased, "=+\\z", "")
    coded = bind(alphabet, lambda al: F.struct(F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.position(c, al) - 1).alias("codes"), F.length(plain).cast("double").alias("n"), F.length(al).cast("double").alias("a")))
    return bind(coded, tests)


def candidates(text: Column, spans: Column) -> Column:
    """Runs of a segment with an inferred encoding and outside its ``spans``: offsets, the run and its encoding, as ``RUNS``."""
    found = F.transform(matches(text, RUN, text.rlike(RUN)), lambda x: F.struct(x["s"], x["e"], x["m"], encoding(x["m"]).alias("kind")))
    free = lambda x: ~F.exists(spans, lambda s: (s["s"] < x["e"]) & (x["s"] < s["e"]))
    return F.filter(found, lambda x: x["kind"].isNotNull() & free(x)).cast(RUNS)


def searched(text: Column) -> Column:
    """``base`` (``SPAN``) and ``runs`` (``RUNS``) of a whole non-null text."""

    def one(x: Column) -> Column:
        found = lambda spans: F.struct(moved(spans, x["at"]).cast(SPAN).alias("base"), moved(candidates(x["t"], spans), x["at"]).cast(RUNS).alias("runs"))
        return bind(base_spans(x["t"]), found)

    def both(found: Column) -> Column:
        some = lambda name, kind: F.flatten(F.transform(found, lambda x: x[name])).cast(kind).alias(name)
        return F.struct(some("base", SPAN), some("runs", RUNS))

    empty = F.struct(F.array().cast(SPAN).alias("base"), F.array().cast(RUNS).alias("runs"))
    return F.when(text.rlike(MAY), bind(F.transform(segments(text), one), both)).otherwise(empty)


def tested(runs: Column) -> Column:
    """Offsets, class of length and p-value of each of ``RUNS``, as ``TESTED``."""

    def one(x: Column) -> Column:
        n = x["e"] - x["s"]
        klass = sum(((n >= c).cast("int") for c in CLASSES), F.lit(0))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), klass.alias("class"), battery(x["m"], x["kind"]).alias("p"))

    return F.transform(runs, one).cast(TESTED)


def false_discovery_bounds(rows: DataFrame, rate: float = RATE) -> list[float]:
    """For each class of lengths the largest p-value that is reported (-1 if none).

    p-values are counted in steps of a thousandth of their logarithm, so there
    is a bounded number of rows to a class, however many runs there are.
    """
    p = rows.select(F.explode("runs").alias("x")).select(F.col("x.class").alias("class"), F.greatest("x.p", F.lit(1e-16)).alias("p"))
    bins = p.groupBy("class", F.ceil(F.log10("p") * 1000).alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("class").orderBy("bin")
    whole = Window.partitionBy("class")
    ranked = bins.withColumn("k", F.sum("n").over(upto)).withColumn("m", F.sum("n").over(whole)).withColumn("p", F.pow(F.lit(10.0), F.col("bin") / 1000))
    bounds = {r["class"]: r["p"] for r in ranked.where(F.col("p") <= rate * F.col("k") / F.col("m")).groupBy("class").agg(F.max("p").alias("p")).collect()}
    return [bounds.get(c, -1.0) for c in range(len(CLASSES) + 1)]


def find_secrets(docs: DataFrame, rate: float = RATE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``secret_base`` and ``secret_spans`` (arrays of ``SPAN``).

    Reads ``text`` in full; a null text counts as empty.  ``keep`` names the
    columns to carry along (all, if not given); columns named like the two
    results are replaced, any other name is the user's.  Runs of at least 20
    characters that the battery shows to be random and that lie in no span of the
    three kinds are added as kind ``random``; at most a share of ``rate`` of them
    are expected to be structured.  Repeated rows are treated alike (and count
    alike in the false-discovery control); empty tables give empty results.

    One pass over the texts finds spans and runs and is written to the shared
    folder; the tests and bounds come from there.  Five numbers go to the driver.
    """
    carried = Carried(docs, keep, ["secret_base", "secret_spans"])
    rows = docs.select(carried.column, searched(text_or_empty()).alias("found"))
    rows = stage(rows.select("carried", F.col("found.base").alias("secret_base"), F.col("found.runs").alias("runs")), "secret-rows")
    rows = rows.withColumn("runs", tested(F.col("runs")))
    bounds = false_discovery_bounds(rows, rate)
    random = lambda x: x["p"] <= F.element_at(F.array(*map(F.lit, bounds)), x["class"] + 1)
    more = F.transform(F.filter("runs", random), lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("ord"), x["e"].alias("e"), F.lit("random").alias("kind")))
    return rows.select(*carried.fields(), "secret_base", F.concat("secret_base", more.cast(SPAN)).alias("secret_spans"))


def op4_query(spark, sf_dir):
    found = find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.col("secret_base")
    return found.select("doc_id", *(count_kind(base, k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))
