"""Native column expressions for finding and naming spans of a text.

A text is cut into segments at places that no span crosses, so that work on the
spans of a segment, which takes their number squared, is linear in the text.
(A text of any length without such a place is one segment.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<s:int,e:int,m:string,left:string>>"
SPAN = "array<struct<s:int,ord:int,e:int,kind:string>>"
#: A segment has 1024 characters and what follows up to a line end, or to a space after a letter that no sign of an assignment follows.
SEGMENT = r"(?s:.{1024}.*?(?:\n|(?<=[A-Za-z])\x20(?![\x20:=]))|.+)"
#: Elements whose sums are run through one by one; segments that share a look at a text's spans.
RUN = 256
SHARED = 64


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(sizes: Column) -> Column:
    """For each of an array of integers the sum of those before it, by blocks and then within them."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def within(part: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def blocked(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / RUN).cast("int")), lambda i: F.slice(x, i * RUN + 1, RUN))
        starts = lambda p: bind(within(F.transform(p, total), F.lit(0)), lambda s: F.flatten(F.zip_with(p, s, within)))
        return bind(parts, starts)

    return bind(sizes, lambda x: F.when(F.size(x) <= RUN, within(x, F.lit(0))).otherwise(blocked(x)))


def matches(text: Column, pattern: str, may: Column | None = None) -> Column:
    """All leftmost, non-overlapping matches in order, as ``MATCH``; ``left`` is the text between a match and the one before.

    Offsets count code points, the end is exclusive.  The pieces between
    matches and the matches themselves come from two native regex functions;
    running lengths give the offsets.  ``may`` is a cheap condition without
    which there is no match.  The text must not be null.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def placed(b: Column) -> Column:
        steps = F.transform(b["m"], lambda m, i: F.length(F.get(b["g"], i)) + F.length(m))

        def one(at: Column):
            def use(m: Column, i: Column) -> Column:
                gap = F.get(b["g"], i)
                return bind(F.get(at, i) + F.length(gap), lambda s: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"), gap.alias("left")))

            return F.transform(b["m"], use)

        return bind(running(steps), one)

    found = bind(both, placed)
    return found if may is None else F.when(may, found).otherwise(F.array().cast(MATCH))


def segments(text: Column) -> Column:
    """The segments of a non-null text: ``at``, ``t`` and the segment ``before`` (empty for the first)."""
    before = lambda t, i: F.when(i > 0, F.get(t, i - 1)).otherwise("")
    placed = lambda t: bind(running(F.transform(t, lambda x: F.length(x))), lambda at: F.transform(t, lambda x, i: F.struct(F.get(at, i).alias("at"), x.alias("t"), before(t, i).alias("before"))))
    return bind(F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0)), placed)


def moved(found: Column, by: Column) -> Column:
    """Structs with ``s`` and ``e`` moved by an offset."""
    return F.transform(found, lambda x: x.withField("s", x["s"] + by).withField("e", x["e"] + by))


def as_spans(found: Column, kind: str, order: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("ord"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of ``SPAN``, by start and then by kind as listed, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def _marked(text: Column, spans: Column, at: Column) -> Column:
    """A segment with its spans replaced."""

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        mark = F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] - at + 1, x["s"] - acc["at"]), mark)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    start = F.struct(at.alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] - at + 1, F.length(text)))))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans one mark stays.

    Spans lie within segments.  Some neighbouring segments share one look at all
    spans, and each then looks at theirs.
    """
    inside = lambda some, low, high: F.filter(some, lambda x: (x["s"] >= low) & (x["s"] < high))

    def group(part: Column, some: Column) -> Column:
        last = F.element_at(part, -1)
        own = inside(some, F.get(part, 0)["at"], last["at"] + F.length(last["t"]))
        return bind(own, lambda o: F.array_join(F.transform(part, lambda x: _marked(x["t"], inside(o, x["at"], x["at"] + F.length(x["t"])), x["at"])), ""))

    def whole(b: Column) -> Column:
        groups = F.sequence(F.lit(0), ((F.size(b["segments"]) - 1) / SHARED).cast("int"))
        return F.array_join(F.transform(groups, lambda i: group(F.slice(b["segments"], i * SHARED + 1, SHARED), b["spans"])), "")

    made = bind(F.struct(segments(text).alias("segments"), F.sort_array(spans).alias("spans")), whole)
    return F.when(F.size(spans) == 0, text).otherwise(made)
