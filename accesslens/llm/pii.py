"""Personal data by bootstrapped contextual extraction, in native expressions.

Pattern-shaped entities (addresses, card and telephone numbers) are the seeds.
The words before a seed induce lexical patterns; patterns and the
identifier-like tokens they stand before form a graph, over which Spark scores
patterns by their known instances and instances by their patterns, in turn.
Patterns of high confidence then discover identifiers of other shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Carried, read_table, small_or_shuffled, stage, text_or_empty, whole_row
from .spans import SPAN, as_spans, bind, count_kind, joined, matches, moved, replaced, segments

KINDS = ("email", "ip", "card", "phone")
#: The seeds' patterns, written so that none backtracks.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A run of characters with a digit or an at sign in it.
TOKEN = r"(?<![^\s])[^\s]*[0-9@][^\s]*"
MENTION = "array<struct<s:int,e:int,token:string,near:string,far:string,kind:string>>"

ROUNDS = 3
#: Digits that a token without an at sign needs to be an instance.
LEAST_DIGITS = 3
LEAST_SUPPORT = 3.0
LEAST_SCORE = 0.6
#: Documents with learned spans that may be broadcast; beyond that they meet their rows by shuffle.
MOST_FOUND = 100_000


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def passes_luhn(m: Column) -> Column:
    """Luhn's check over the digits of a string."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9)

    return F.aggregate(F.transform(F.split(F.reverse(digits(m)), ""), value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def small_parts(m: Column) -> Column:
    """Whether all parts of a dotted number are at most 255; parts may be of any length."""
    return F.forall(F.split(m, r"\."), lambda p: bind(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def base_spans(text: Column) -> Column:
    """The seeds' spans of a segment, as ``SPAN`` in order."""
    email = matches(text, EMAIL, text.contains("@"))
    ip = F.filter(matches(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: small_parts(x["m"]))
    card = F.filter(matches(text, CARD, text.rlike(CARD)), lambda x: passes_luhn(x["m"]))
    phone = F.filter(matches(text, PHONE, text.rlike(r"\+[0-9]")), lambda x: F.length(digits(x["m"])).between(10, 15))
    return F.sort_array(F.concat(*(as_spans(x, k, i) for i, (k, x) in enumerate(zip(KINDS, (email, ip, card, phone), strict=True)))))


def mentions(text: Column, before: Column, spans: Column, least_digits: int) -> Column:
    """Identifier-like tokens of a segment with the word and the two words before them, and the kind of a seed that starts there.

    Words before the segment's first token may come from the one before it; a
    token right after another one has ``#`` for that.  Tokens within a seed, but
    not at its start, are left out.
    """
    words = lambda x: F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")
    last = lambda x: F.when(F.size(x) > 2, F.slice(x, -2, 2)).otherwise(x)

    def all_of(found: Column) -> Column:
        def lead(x: Column, i: Column) -> Column:
            far = F.concat(F.when(i == 0, last(words(before))).otherwise(F.concat(last(words(F.get(found, i - 1)["left"])), F.array(F.lit("#")))))
            return bind(last(words(x["left"])), lambda own: F.when(F.size(own) == 2, own).otherwise(last(F.concat(far, own))))

        def one(x: Column, i: Column) -> Column:
            skip = F.length(x["m"]) - F.length(F.regexp_replace(x["m"], r"^[\"'(\[<{]+", ""))
            token = F.regexp_replace(F.regexp_replace(x["m"], r"^[\"'(\[<{]+", ""), r"[\"')\]>}.,;:!?]+\z", "")
            kind = F.get(F.transform(F.filter(spans, lambda s: (s["s"] >= x["s"]) & (s["s"] < x["e"])), lambda s: s["kind"]), 0)
            made = lambda b: F.struct(
                (x["s"] + b["skip"]).alias("s"),
                (x["s"] + b["skip"] + F.length(b["token"])).alias("e"),
                b["token"].alias("token"),
                F.coalesce(F.element_at(F.when(F.size(b["lead"]) > 0, b["lead"]), -1), F.lit("")).alias("near"),
                F.when(F.size(b["lead"]) == 2, F.array_join(b["lead"], " ")).otherwise("").alias("far"),
                b["kind"].alias("kind"),
            )
            return bind(F.struct(skip.alias("skip"), token.alias("token"), lead(x, i).alias("lead"), kind.alias("kind")), made)

        return F.transform(found, one)

    def outside(x: Column) -> Column:
        inner = F.exists(spans, lambda s: (x["s"] > s["s"]) & (x["s"] < s["e"]))
        shaped = x["token"].contains("@") | (F.length(digits(x["token"])) >= least_digits)
        return ~inner & shaped & (x["token"] != "@") | x["kind"].isNotNull()

    return F.filter(bind(matches(text, TOKEN, text.rlike("[0-9@]")), all_of), outside).cast(MENTION)


def searched(text: Column, least_digits: int) -> Column:
    """``base`` (``SPAN``) and ``mentions`` (``MENTION``) of a whole non-null text."""

    def one(x: Column) -> Column:
        found = lambda spans: F.struct(moved(spans, x["at"]).cast(SPAN).alias("base"), moved(mentions(x["t"], x["before"], spans, least_digits), x["at"]).alias("mentions"))
        return F.when(x["t"].rlike("[0-9@]"), bind(base_spans(x["t"]), found))

    def both(found: Column) -> Column:
        some = lambda name, kind: F.flatten(F.transform(found, lambda x: x[name])).cast(kind).alias(name)
        return F.struct(some("base", SPAN), some("mentions", MENTION))

    empty = F.struct(F.array().cast(SPAN).alias("base"), F.array().cast(MENTION).alias("mentions"))
    return F.when(text.rlike("[0-9@]"), bind(F.filter(F.transform(segments(text), one), lambda x: x.isNotNull()), both)).otherwise(empty)


def score_patterns(rows: DataFrame, rounds: int, least_support: float, least_score: float) -> DataFrame:
    """High-confidence patterns: ``pattern, kind, score``, by iterating over the graph of patterns and instances.

    ``rows`` has ``mentions``.  A pattern's score is the summed confidence of
    its distinct instances over their number plus two; an instance's confidence
    is that no pattern before it is wrong.  Edges are combined before each
    shuffle, so a pattern or token that holds a third of all mentions comes as
    a row of each task.
    """
    m = rows.select(F.explode("mentions").alias("x")).select("x.*")
    patterns = F.explode(F.filter(F.array(F.concat(F.lit("1 "), "near"), F.when(F.col("far") != "", F.concat(F.lit("2 "), "far"))), lambda p: p.isNotNull() & (p != "1 ") & (p != "1 #"))).alias("pattern")
    edges = stage(m.select(patterns, F.lower("token").alias("token"), "kind").groupBy("pattern", "token").agg(F.max("kind").alias("kind")), "pii-edges")
    known = edges.where("kind is not null").groupBy("token", "kind").agg(F.lit(1.0).alias("confidence"))
    kept = edges.where("false").select("pattern", F.col("kind"), F.lit(0.0).alias("score"))
    for _ in range(rounds):
        size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
        support = edges.select("pattern", "token").join(known, "token").groupBy("pattern", "kind").agg(F.sum("confidence").alias("f"))
        good = support.where(F.col("f") >= least_support).join(size, "pattern").withColumn("score", F.col("f") / (F.col("n") + 2)).where(F.col("score") >= least_score)
        kept = stage(good.select("pattern", "kind", "score"), "pii-patterns")
        doubt = edges.where("kind is null").select("pattern", "token").join(kept, "pattern").groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("confidence"))
        seeds = edges.where("kind is not null").groupBy("token", "kind").agg(F.lit(1.0).alias("confidence"))
        known = seeds.unionByName(doubt.where(F.col("confidence") >= least_score))
    return kept


def find_pii(docs: DataFrame, rounds: int = ROUNDS, least_support: float = LEAST_SUPPORT, least_score: float = LEAST_SCORE, least_digits: int = LEAST_DIGITS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans`` (arrays of ``SPAN``).

    Reads ``text`` in full; a null text counts as empty.  ``keep`` names the
    columns to carry along (all, if not given); columns named like the two
    results are replaced, any other name is the user's.  Spans of ``pii_spans``
    hold those of ``pii_base`` and, as kind ``ctx_<kind>``, tokens that only a
    learned pattern found: those with an at sign, and those with at least
    ``least_digits`` digits.  With no ``rounds`` nothing is learned.  Repeated
    rows are treated alike; empty tables give empty results.

    One pass over the texts finds seeds and mentions and is written to the
    shared folder; all else works on these few bytes a document.
    """
    carried = Carried(docs, keep, ["pii_base", "pii_spans"])
    rows = docs.select(carried.column, F.monotonically_increasing_id().alias("pii_row"), searched(text_or_empty(), least_digits).alias("found"))
    rows = stage(rows.select("carried", "pii_row", F.col("found.base").alias("pii_base"), F.col("found.mentions").alias("mentions")), "pii-rows")
    kept = score_patterns(rows.select("mentions"), rounds, least_support, least_score).groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("best"))
    open_ = rows.select("pii_row", F.explode("mentions").alias("x")).where("x.kind is null").select("pii_row", "x.s", "x.e", F.explode(F.array(F.concat(F.lit("1 "), "x.near"), F.concat(F.lit("2 "), "x.far"))).alias("pattern"))
    named = open_.join(kept, "pattern").groupBy("pii_row", "s", "e").agg(F.max("best").alias("best"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("best.kind")).cast("int") + len(KINDS) - 1
    found = named.groupBy("pii_row").agg(F.collect_list(F.struct("s", order.alias("ord"), "e", F.concat(F.lit("ctx_"), "best.kind").alias("kind"))).alias("more"))
    none = F.array().cast(SPAN)
    out = rows.drop("mentions").join(small_or_shuffled(stage(found, "pii-found"), MOST_FOUND), "pii_row", "left")
    return out.select(*carried.fields(), "pii_base", F.concat("pii_base", F.coalesce(F.col("more").cast(SPAN), none)).alias("pii_spans"))


def redacted(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind, columns as before; further columns may have any names."""
    whole = docs.select(whole_row(docs, "doc"), "text")
    out = find_pii(whole, **options)
    text = F.when(F.col("text").isNotNull(), replaced(F.col("text"), F.col("pii_spans"))).alias("text")
    return out.select(*(text if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))


def op1_query(spark, sf_dir):
    found = find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.col("pii_base")
    return found.select("doc_id", *(count_kind(base, k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
