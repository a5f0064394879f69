"""Mix sources to target weights by hash-threshold histograms.

Each document gets a 60-bit hash.  Words are summed by source and leading hash
bits; the bucket in which a source's budget is crossed is the only one that is
refined by further bits.  The thresholds that come out are nested (a larger
budget keeps every document of a smaller one) and are applied as a plain
filter: no sort, and no shuffle of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Carried, count_words, read_table, small_or_shuffled, stage, text_or_empty, whole_row

HASH_BITS = 60
LEVEL_BITS = 12
WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2.0, 17
#: Sources whose thresholds may be broadcast; with more, documents meet them by shuffle.
MOST_BROADCAST = 100_000


def hash60(seed: int, doc_id: Column, text: Column) -> Column:
    """The first 60 bits of a digest of seed, id and text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string"), text)), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, n, target`` of ``sizes`` (``source, n``): ``share`` times all words, divided by weight.

    Sources go by code point, null last, and take ``weights`` in turn.  Where a
    target would exceed ``most`` times its source's size it stops there, and the
    excess is shared again among the others until none is above.  Those that
    stop are the first by limit over weight, so running sums in that order tell
    where it ends.  One row a source is sorted in one task; no document is.
    """
    numbered = sizes.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("number", F.lit(len(weights))) + 1)
    rows = numbered.withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("n"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "number")
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("left", F.lit(float(share)) * F.sum("n").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(after))
    rows = rows.withColumn("stops", F.col("left") * F.col("weight") / F.col("open") > F.col("limit"))
    rows = rows.withColumn("at", F.row_number().over(order))
    first = F.min(F.when(~F.col("stops"), F.struct("at", "left", "open"))).over(whole)
    rows = rows.withColumn("first", first)
    shared = F.col("first.left") * F.col("weight") / F.col("first.open")
    return rows.select("source", "n", F.when(F.col("first").isNull() | (F.col("at") < F.col("first.at")), F.col("limit")).otherwise(shared).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target, source_size, base, cut``: a document is taken ``base`` times, and once more if its hash is below ``cut``.

    ``sized`` has ``source, size, h``.  One pass over it (it is a small table) for
    each level of the hash; each aggregates to at most ``2**LEVEL_BITS`` rows a
    source, and the state of all sources is a written table.
    """
    base = F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n"))).otherwise(0).cast("long")
    need = F.when(F.col("n") > 0, F.col("target") - F.col("base") * F.col("n")).otherwise(0.0)
    state = targets.withColumn("base", base).withColumn("need", need).withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(1 << HASH_BITS))
    state = stage(state.withColumn("cut", F.when(F.col("need") <= 0, F.lit(0).cast("long"))), "mix-state")
    for bits in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        open_ = small_or_shuffled(state.where("cut is null").select(F.col("source").alias("s"), "need", "low", "high"), MOST_BROADCAST)
        inside = sized.join(open_, F.col("source").eqNullSafe(F.col("s"))).where("h >= low and h < high and size > 0")
        hist = inside.groupBy("s", "need", F.shiftright("h", bits).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("first"), F.max("h").alias("last"))
        upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        crossed = hist.withColumn("below", F.coalesce(F.sum("words").over(upto), F.lit(0))).where("below < need and below + words >= need")
        crossed = crossed.select("s", "bucket", "words", "first", "last", "below", F.lit(True).alias("found"))
        both = state.join(crossed, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("rest", F.col("need") - F.coalesce("below", F.lit(0)))
        alone = (F.col("first") == F.col("last")) | F.lit(bits == 0)  # one hash: it is taken if that comes nearer
        cut = F.when(F.col("cut").isNotNull(), F.col("cut")).when(F.col("found").isNull(), F.col("high")).when(alone, F.when(F.col("rest") * 2 >= F.col("words"), F.col("last") + 1).otherwise(F.col("first")))
        low, high = F.coalesce(F.shiftleft("bucket", bits), "low"), F.coalesce(F.shiftleft(F.col("bucket") + 1, bits), "high")
        state = stage(both.select("source", "n", "target", "base", F.col("rest").alias("need"), low.alias("low"), high.alias("high"), cut.alias("cut")), "mix-state")
    return state.select("source", "target", F.col("n").alias("source_size"), "base", "cut")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_copies`` and ``mix_taken``.

    Reads ``doc_id``, ``source`` and ``text``; ``keep`` names the columns to
    carry along (all, if not given), of which any named like the five results
    are replaced; any other name is the user's.  A null text counts as no words;
    a null source is a source of its own, the last.  Equal rows have equal hashes
    and are taken alike, so reruns agree whatever the order of rows.  Empty
    tables give empty results.  A source's taken words differ from its target by
    at most half the words that share one hash, as a rule half a document.

    Nothing goes to the driver but numbers of rows.  Sources meet documents by
    an equality join: the table of thresholds is broadcast up to
    ``MOST_BROADCAST`` sources; beyond that Spark shuffles, and splits a hot
    source.
    """
    text, source = text_or_empty().cast("string"), F.col("source").cast("string").alias("source")
    carried = Carried(docs, keep, ["mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"])
    h = hash60(seed, F.col("doc_id"), text).alias("h")
    sized = stage(docs.select(source, count_words(text).alias("size"), h), "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("n")), weights, share, most)
    cuts = small_or_shuffled(thresholds(sized, targets).withColumnRenamed("source", "s"), MOST_BROADCAST)
    out = docs.select(carried.column, source, count_words(text).alias("mix_size"), h)
    out = out.join(cuts, F.col("source").eqNullSafe(F.col("s")))
    copies = F.least(F.col("base") + (F.col("h") < F.col("cut")).cast("long"), F.lit(int(most)).cast("long")).alias("mix_copies")
    out = out.select("carried", "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), copies)
    return out.select(*carried.fields(), "mix_size", "mix_source_size", "mix_target", "mix_copies", (F.col("mix_copies") * F.col("mix_size")).alias("mix_taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``, whatever their names."""
    chosen = mix(docs.select("doc_id", "source", "text", whole_row(docs, "row")), keep=["row"], **options).where("mix_copies > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("copy")
    return chosen.select("row", copies).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op5_query(spark, sf_dir):
    mixed = mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id"])
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CAST('0x' || substr(md5(concat_ws('|', '{SEED}', CAST(doc_id AS VARCHAR), coalesce(text, ''))), 1, {HASH_BITS // 4}) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
w AS (SELECT *, ([{', '.join(f'{w:.1f}' for w in WEIGHTS)}]::DOUBLE[])[(number % {len(WEIGHTS)}) + 1] AS weight, {MOST}::DOUBLE * n AS most
    FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM s)),
l AS (SELECT *, {SHARE}::DOUBLE * sum(n) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_, row_number() OVER o AS place FROM w WINDOW o AS (ORDER BY most / weight, number)),
f AS (SELECT place, left_, open_ FROM l WHERE NOT left_ * weight / open_ > most ORDER BY place LIMIT 1),
t AS (SELECT l.source, l.n, CASE WHEN f.place IS NULL OR l.place < f.place THEN l.most ELSE f.left_ * l.weight / f.open_ END AS target FROM l LEFT JOIN f ON true),
b AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS base FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d WHERE size > 0 GROUP BY source, h),
c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
x AS (SELECT c.source, CASE WHEN 2 * (b.target - b.base * b.n - below) >= words THEN h + 1 ELSE h END AS cut FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
    WHERE below < b.target - b.base * b.n AND below + words >= b.target - b.base * b.n)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, b.n AS source_size, b.target,
    CAST(d.size * least({int(MOST)}, b.base + CASE WHEN b.n > 0 AND b.target - b.base * b.n > 0 AND d.h < coalesce(x.cut, {1 << HASH_BITS}) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
