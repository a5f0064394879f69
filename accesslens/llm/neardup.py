"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set of word shingles is hashed once; its sketch is the smallest
hash values.  Inverted lists of retained values propose pairs, the sketch of a
pair's union estimates their similarity, and whole sets verify it.

Documents with equal sets are one class and meet the lists once.  Frequent
values (shared passages, large groups of near copies) are kept apart from the
others.  Only sets that consist of them for the most part are listed under
frequent values; a pair of others that reaches the similarity shares much of its
rest, and meets there.  So a passage that many documents share pairs only those
which it may link.  Each list is first compared with its most
central member.  Members of long lists that this leaves open are compared by a
prefix filter over whole sets: with values in order of their frequency, the
rarest first, two sets can only reach the similarity if they share one of the
first values, fewer of the smaller set than of the larger.  So documents around
one template meet only if the template makes six sevenths of one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, give_back, read_table, small_or_shuffled, stage, text_or_empty, whole_row
from .graph import components

WIDTH = 5
LEAST_PERCENT = 75
#: Values of a sketch; of these those whose frequency counts; of these those that enter lists (of either kind).
SKETCH = 128
REGION = 48
LISTED = 16
#: Share of frequent values from which on a set is listed under them.  Of two sets with fewer, at least 0.44 of the
#: other values are common where the similarity is 0.75, so that none of LISTED is common once in 10,000 pairs at most.
PURE = 0.55
#: Members of a list beyond which its value is frequent and it is compared in blocks.
LONG = 24
BLOCK = 1024
#: Values of the wider sketches that blocks compare, and of those compared at a time.
WIDE = 1024
PIECE = 4096
#: Pairs of a set that are verified together; with more, the set is copied.
HUB = 256
#: An estimate is at fault by less than this many standard deviations.
DEVIATIONS = 4.0
#: Rows of a table of keys that may be broadcast; beyond that it is joined by shuffle.
MOST_BROADCAST = 1_000_000

U = np.uint64
_FACTORS = [U(pow(0x9E3779B97F4A7C15, WIDTH - 1 - i, 1 << 64)) for i in range(WIDTH)]
SKETCHES = "row long, doc_id long, key1 long, key2 long, n long, sig1 long, sig2 long, sketch array<long>"


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles of a text; of the whole sequence if that is shorter; empty without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words)) >> 1], np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    x = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        x += h[i : len(h) - width + 1 + i] * _FACTORS[i]
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return np.unique(((x ^ (x >> U(31))) >> U(1)).astype(np.int64))


def sketches(keyed: DataFrame) -> DataFrame:
    """Sizes, signatures and sketches of all documents, one row each."""

    def run(batches):
        for batch in batches:
            n, a, b, values = [], [], [], []
            for text in batch.column("nd_text"):
                s = shingle_set(text.as_py())
                digest = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                a.append(int.from_bytes(digest[:8], "little", signed=True))
                b.append(int.from_bytes(digest[8:], "little", signed=True))
                values.append(s[:SKETCH])
            offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "key1", "key2")), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["row", "doc_id", "key1", "key2", "n", "sig1", "sig2", "sketch"],
            )
        give_back()

    return stage(keyed.mapInArrow(run, SKETCHES), "nd-sketches")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, nd_text`` and two hashes that together tell a row's id and text from others."""
    text = text_or_empty().cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("key1"), F.xxhash64(F.lit(7), text, "doc_id").alias("key2"), text.alias("nd_text"))


def lists(classes: DataFrame) -> DataFrame:
    """Rows of the inverted lists: ``value, row, n, f, centre``; values that no other class retains are left out.

    A list has ``f`` members; its centre is the one with the largest share of
    frequent values, as the original of many copies has.  A class has at most
    twice ``LISTED`` rows.
    """
    near = classes.select("row", "n", F.slice("sketch", 1, REGION).alias("near"))
    values = near.select("row", F.explode("near").alias("value"))
    frequent = stage(values.groupBy("value").agg(F.count("*").alias("f")).where(F.col("f") > LONG).select("value"), "nd-frequent")
    held = stage(values.join(small_or_shuffled(frequent, MOST_BROADCAST), "value").groupBy("row").agg(F.sort_array(F.collect_list("value")).alias("held")), "nd-held")
    none = F.array().cast("array<long>")
    both = near.join(held, "row", "left").withColumn("held", F.coalesce("held", none)).withColumn("pure", F.size("held") / F.size("near"))
    listed = F.concat(F.when(F.col("pure") >= PURE, F.slice("held", 1, LISTED)).otherwise(none), F.slice(F.array_except("near", "held"), 1, LISTED))
    rows = stage(both.select("row", "n", "pure", F.explode(listed).alias("value")), "nd-values")
    shared = stage(rows.groupBy("value").agg(F.count("*").alias("f"), F.max(F.struct("pure", -F.col("n"), "row"))["row"].alias("centre")).where("f > 1"), "nd-lists")
    members = stage(rows.join(shared, "value").drop("pure"), "nd-members")
    drop_staged(frequent, held, rows, shared)
    return members


def enough(n: str, m: str) -> F.Column:
    """Whether sets of two sizes can reach the similarity at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * LEAST_PERCENT


LAST = np.iinfo(np.int64).max


def padded(rows: list, width: int = SKETCH) -> np.ndarray:
    """Arrays of increasing values as rows, filled up with the largest long."""
    out = np.full((len(rows), width), LAST)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def possible(x: np.ndarray, nx: int, others: np.ndarray, n: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which of some sets may reach the similarity with another, by the sketch of each union.

    ``x`` and the rows of ``others`` are sketches of sets of ``nx`` and ``n``
    values, ``common`` the number of values that they share.  All values of a
    union up to the smaller of the two largest retained ones are known; the
    share of common ones among these estimates the similarity, with the
    deviation of a sample without replacement.  It is exact where both sketches
    are whole sets.
    """
    own = x[-1] if nx > len(x) else LAST - 1
    theirs = np.where(n > others.shape[1], others[:, -1], LAST - 1)
    cx = np.searchsorted(x, np.minimum(theirs, own), side="right")
    cy = (others <= own).sum(1)
    seen = cx + cy - common
    similarity = common / np.maximum(seen, 1)
    union = np.maximum((nx + n) / (1 + np.maximum(similarity, LEAST_PERCENT / 100)), seen)
    j = LEAST_PERCENT / 100
    return similarity >= j - DEVIATIONS * np.sqrt(j * (1 - j) / np.maximum(seen, 1) * (1 - seen / np.maximum(union, 1))) - 1e-9


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of distinct pairs ``a, b`` whose estimate leaves the similarity possible."""

    def run(batches):
        for batch in batches:
            s, t = batch.column("s"), batch.column("t")
            sn, tn = batch.column("sn").to_numpy(), batch.column("tn").to_numpy()
            keep = []
            for i in range(batch.num_rows):
                x, y = s[i].values.to_numpy(), t[i].values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                if possible(x, sn[i], padded([y]), tn[i : i + 1], np.array([common]))[0]:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        give_back()

    s = classes.select(F.col("row").alias("a"), F.col("sketch").alias("s"), F.col("n").alias("sn"))
    t = classes.select(F.col("row").alias("b"), F.col("sketch").alias("t"), F.col("n").alias("tn"))
    return pairs.join(s, "a").join(t, "b").select("a", "b", "s", "t", "sn", "tn").mapInArrow(run, "a long, b long")


def shared_counts(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many values each of ``rows`` shares with each of ``others``, in pieces of bounded size."""
    values = np.intersect1d(rows[rows != LAST], others[others != LAST])
    out = np.zeros((len(rows), len(others)), np.float32)

    def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(values, x), len(values) - 1)
        r, c = np.nonzero(values[at] == x)
        return r, at[r, c]

    if not len(values):
        return out
    (ra, va), (rb, vb) = places(rows), places(others)
    for low in range(0, len(values), PIECE):
        a, b = np.zeros((len(rows), PIECE), np.float32), np.zeros((len(others), PIECE), np.float32)
        i, j = (va >= low) & (va < low + PIECE), (vb >= low) & (vb < low + PIECE)
        a[ra[i], va[i] - low], b[rb[j], vb[j] - low] = 1, 1
        out += a @ b.T
    return out


def block_pairs(value: int, side: np.ndarray, row: np.ndarray, n: np.ndarray, part: np.ndarray, once: np.ndarray, sketch: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Possible pairs of a block of open members (``side``) with another block of the list of ``value``.

    A pair is compared in the list of the smallest value under which both are
    ``listed``, and nowhere else; where both come on either side, with the
    smaller row on the left, unless the right one says that it comes ``once``.
    """
    one, two = np.flatnonzero(side), np.flatnonzero(~side)
    if not len(one) or not len(two):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.where(listed < value, listed, LAST)
    earlier = shared_counts(before[one], before[two])
    common = shared_counts(sketch[one], sketch[two])
    a, b = [], []
    for k, i in enumerate(one):
        fit = (earlier[k] == 0) & (part[two] != part[i]) & (once[two] | (row[two] > row[i]))
        fit &= np.minimum(n[two], n[i]) * 100 >= np.maximum(n[two], n[i]) * LEAST_PERCENT
        at = np.flatnonzero(fit)
        if len(at):
            x = sketch[i, : min(sketch.shape[1], n[i])]
            hit = row[two[at[possible(x, n[i], sketch[two[at]], n[two[at]], common[k, at])]]]
            a.append(np.minimum(hit, row[i]))
            b.append(np.maximum(hit, row[i]))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def sets_of(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``row, set``: the whole sets of the classes whose ``row`` is in ``ids``; texts are not shuffled while the ids are few."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x.as_py()) for x in batch.column("nd_text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.list_(pa.int64()))], ["row", "set"])
        give_back()

    wanted = stage(classes.select("row", "key1", "key2").join(ids, "row"), "nd-wanted")
    texts = keyed_texts(docs).drop("doc_id").join(small_or_shuffled(wanted, MOST_BROADCAST), ["key1", "key2"])
    sets = stage(texts.select("row", "nd_text").mapInArrow(run, "row long, set array<long>").dropDuplicates(["row"]), "nd-sets")
    drop_staged(wanted)
    return sets


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of distinct pairs ``a, b`` (a written table) whose whole sets reach the similarity.

    Each set in question is made once.  Of a pair the set in more pairs is the
    hub; hubs come in copies, one for each ``HUB`` of their pairs, so that the
    pairs of a very frequent one are dealt to many tasks.
    """

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("s"), batch.column("t"), strict=True)):
                s, t = x.values.to_numpy(), y.values.to_numpy()
                at = np.searchsorted(s, t)
                both = int((s[np.minimum(at, len(s) - 1)] == t).sum())
                if 100 * both >= LEAST_PERCENT * (len(s) + len(t) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        give_back()

    ends = stage(pairs.select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").agg(F.count("*").alias("f")), "nd-ends")
    sets = sets_of(ends.select("row"), classes, docs)
    copies = lambda f: F.ceil(F.col(f) / HUB).cast("int")
    end = lambda name: ends.select(F.col("row").alias(name), F.col("f").alias(f"{name}_f"))
    dealt = pairs.join(end("a"), "a").join(end("b"), "b")
    first = F.col("a_f") >= F.col("b_f")
    dealt = dealt.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), F.greatest("a_f", "b_f").alias("f"))
    dealt = dealt.withColumn("copy", F.pmod(F.xxhash64("other"), copies("f")).cast("int"))
    s = sets.join(ends, "row").select(F.col("row").alias("hub"), F.explode(F.sequence(F.lit(0), copies("f") - 1)).alias("copy"), F.col("set").alias("s"))
    t = sets.select(F.col("row").alias("other"), F.col("set").alias("t"))
    links = stage(dealt.join(s, ["hub", "copy"]).join(t, "other").select("a", "b", "s", "t").mapInArrow(run, "a long, b long"), "nd-links")
    drop_staged(ends, sets)
    return links


def open_pairs(members: DataFrame, linked: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Likely pairs of list members that no links found so far connect, but for those with the list's centre."""
    stars = components(linked)
    label = stage(stars, "nd-labels")
    drop_staged(stars)
    named = members.where("row <> centre").join(label.select(F.col("node").alias("row"), F.col("root").alias("part")), "row", "left").withColumn("part", F.coalesce("part", "row"))
    core = label.select(F.col("node").alias("centre"), F.col("root").alias("core"))
    state = named.join(core, "centre", "left").withColumn("done", F.coalesce(F.col("part") == F.col("core"), F.lit(False)))
    every = stage(state.select("value", "f", "row", "n", "part", "done"), "nd-open")
    open_lists = stage(every.where("not done").select("value").distinct(), "nd-open-lists")
    state = every.join(open_lists, "value")
    short = state.where(F.col("f") <= LONG)
    p = short.where("not done").select("value", F.col("row").alias("x"), F.col("n").alias("xn"), F.col("part").alias("xp"))
    q = short.select("value", F.col("row").alias("y"), F.col("n").alias("yn"), F.col("part").alias("yp"), "done")
    close = p.join(q, "value").where("xp <> yp and (done or x < y)").where(enough("xn", "yn"))
    short = stage(close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "nd-short")
    rows = state.where(F.col("f") > LONG).groupBy("row").agg(F.first("n").alias("n"), F.first("part").alias("part"), F.max(~F.col("done")).alias("open"))
    long = stage(rows, "nd-long")
    by_prefix = prefix_pairs(long, classes, docs)
    pairs = stage(likely(short, classes).unionByName(by_prefix).distinct(), "nd-open-pairs")
    drop_staged(label, every, open_lists, short, long, by_prefix)
    return pairs


def prefixes(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``value, row, n, part, open, index``: of each set its rarest values, those that may be shared.

    A set of n values that reaches the similarity with one of at least its size
    shares with it one of the ``index`` values of the smaller and of all that are
    listed of the larger; of equal sizes this is exact.
    """
    values = sets.select("row", F.explode("set").alias("value"))
    frequency = values.groupBy("value").agg(F.count("*").alias("f"))
    ordered = values.join(frequency, "value").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("f", "value"))).alias("order"))
    n, p = F.col("n"), LEAST_PERCENT
    probe, index = n - F.ceil(n * p / 100) + 1, n - F.ceil(n * 2 * p / (100 + p)) + 1
    cut = ordered.join(rows, "row").withColumn("index_to", index.cast("int")).withColumn("order", F.slice("order", 1, probe.cast("int")))
    placed = cut.select("row", "n", "part", "open", "index_to", F.posexplode("order").alias("at", "x"))
    return placed.where("x.f > 1").select("x.value", "row", "n", "part", "open", (F.col("at") < F.col("index_to")).alias("index"))


def prefix_pairs(rows: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Likely pairs of ``rows`` (``row, n, part, open``) of different parts, one of them open, by a prefix filter over whole sets.

    Short lists are joined with themselves, long ones meet block by block, so
    that a task holds two blocks however long a list is: open index members with
    all, and open members with the other index members.
    """
    sets = sets_of(rows.select("row"), classes, docs)
    listed = stage(prefixes(rows, sets), "nd-prefixes")
    lists_ = stage(listed.groupBy("value").agg(F.count("*").alias("f"), F.max("open").alias("any"), F.max("index").alias("some"), *(F.sum(F.when(F.expr(c), 1).otherwise(0)).alias(name) for name, c in (("open_index", "open and index"), ("opens", "open"), ("done_index", "not open and index")))).where("f > 1 and any and some"), "nd-prefix-lists")
    placed = listed.join(lists_, "value")
    x = placed.where(F.col("f") <= LONG).select("value", "row", "n", "part", "open", "index")
    y = x.select("value", *(F.col(c).alias(f"{c}_") for c in ("row", "n", "part", "open", "index")))
    short = x.where("index").join(y, "value").where("row <> row_ and part <> part_ and (open or open_) and n <= n_").where(enough("n", "n_"))
    short = stage(short.select(F.least("row", "row_").alias("a"), F.greatest("row", "row_").alias("b")).distinct(), "nd-short")

    long = placed.where(F.col("f") > LONG)
    names = long.groupBy("row").agg(F.sort_array(F.collect_list("value")).alias("probes"), F.sort_array(F.collect_list(F.when(F.col("index"), F.col("value")))).alias("indexes"))
    named = stage(names, "nd-listed")
    sized = long.join(named, "row").join(sets.select("row", F.slice("set", 1, WIDE).alias("wide")), "row")
    salt, blocks = F.pmod(F.xxhash64("row"), F.lit(1 << 20)), lambda c: F.ceil(F.col(c) / BLOCK).cast("int")

    def side(task: int, left: bool, which: str, own: str, others: str, once, listed_: str) -> DataFrame:
        mine, theirs = F.pmod(salt, blocks(own)).cast("int"), F.explode(F.sequence(F.lit(0), blocks(others) - 1))
        i, j = (mine, theirs) if left else (theirs, mine)
        chosen = sized.where(which).where((F.col(own) > 0) & (F.col(others) > 0))
        return chosen.select("value", F.lit(task).alias("task"), i.alias("i"), j.alias("j"), F.lit(left).alias("left"), "row", "n", "part", once.alias("once"), "wide", F.col(listed_).alias("listed"))

    done, yes = ~F.col("open"), F.lit(True)
    met = side(0, True, "open and index", "open_index", "f", yes, "indexes").unionByName(side(0, False, "true", "f", "open_index", done | ~F.col("index"), "probes"))
    met = met.unionByName(side(1, True, "open", "opens", "done_index", yes, "probes")).unionByName(side(1, False, "not open and index", "done_index", "opens", yes, "indexes"))

    def run(table: pa.Table) -> pa.Table:
        arrays = [table.column(c).to_numpy() for c in ("left", "row", "n", "part", "once")]
        sketch = padded([x.values.to_numpy() for x in table.column("wide")], WIDE)
        many = max(len(x.values) for x in table.column("listed"))
        a, b = block_pairs(table.column("value")[0].as_py(), *arrays, sketch, padded([x.values.to_numpy() for x in table.column("listed")], many))
        return pa.table({"a": a, "b": b})

    pairs = stage(likely(short, classes).unionByName(met.groupBy("value", "task", "i", "j").applyInArrow(run, "a long, b long")), "nd-prefix-pairs")
    drop_staged(sets, listed, lists_, short, named)
    return pairs


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with shingles, and those without: ``doc_id, key1, key2, n_shingles``.

    The former have the ``component_id``; ``best``, the keys of the document of
    their component that comes first by doc_id (null last) and then by keys; and
    ``copies``, the number of rows with their set.
    """
    rows = sketches(keyed_texts(docs).withColumn("row", F.monotonically_increasing_id()))
    sig = ["sig1", "sig2"]
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key1", "key2")
    groups = stage(rows.where("n > 0").groupBy(*sig).agg(F.min("row").alias("class"), F.min("doc_id").alias("least"), F.min(first).alias("best"), F.count("*").alias("copies")), "nd-classes")
    classes = stage(rows.select("row", "key1", "key2", "n", "sketch").join(groups.select(F.col("class").alias("row")), "row"), "nd-class-sketches")
    members = lists(classes)
    pair = [F.least("row", "centre").alias("a"), F.greatest("row", "centre").alias("b")]
    centres = members.select(F.col("centre")).distinct().join(classes.select(F.col("row").alias("centre"), F.col("n").alias("cn")), "centre")
    star = stage(members.where("row <> centre").select(*pair, "n", "centre").distinct().join(centres, "centre").where(enough("n", "cn")).select("a", "b").distinct(), "nd-star")
    close = stage(likely(star, classes), "nd-likely")
    linked = verified(close, classes, docs)
    opened = open_pairs(members, linked, classes, docs)
    rest = stage(opened.join(star, ["a", "b"], "left_anti"), "nd-rest")
    drop_staged(members, star, close, opened)
    more = verified(rest, classes, docs)
    drop_staged(classes, rest)
    stars = components(linked.unionByName(more))
    rooted = groups.join(stars.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    rooted = stage(rooted.select(*sig, "root", "least", "best", "copies"), "nd-rooted")
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("best").alias("best")), "nd-least")
    named = stage(rooted.drop("best").join(least, "root").select(*sig, "component_id", "best", "copies"), "nd-named")
    plain = stage(rows.select("doc_id", "key1", "key2", F.col("n").alias("n_shingles"), *sig), "nd-plain")
    drop_staged(rows, groups, linked, more, stars, rooted, least)
    return plain.where("n_shingles > 0").join(named, sig).drop(*sig), plain.where("n_shingles = 0").drop(*sig)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` and the row's hashes ``key1, key2``: one row for each row of ``docs``.

    Reads ``doc_id`` and the whole ``text``.  Null, empty and blank texts have
    no shingles and link with nothing; texts of fewer than five words have one.
    ``component_id`` is the smallest doc_id of the component; a null doc_id is
    never the smallest unless there is no other, then it is null and ``kept``
    false.  Repeated rows have equal sets and so one component; ``kept`` holds
    for each row with the smallest doc_id.  Empty tables give empty results.
    """
    full, empty = grouped(docs)
    full, empty = full.drop("best", "copies"), empty.withColumn("component_id", F.col("doc_id"))
    return full.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component, columns as before, whatever their names.

    It is the row with the smallest doc_id, a null one coming last; of several
    texts with that doc_id the one with the smallest hashes; of rows with equal
    doc_id and text the first by all columns.  Documents without shingles all
    stay.
    """
    full, _ = grouped(docs)
    best = (F.col("key1") == F.col("best.key1")) & (F.col("key2") == F.col("best.key2"))
    marked = full.withColumn("nd_best", best).where("not nd_best or copies > 1").groupBy(F.col("key1").alias("nd_key1"), F.col("key2").alias("nd_key2"))
    marked = stage(marked.agg(F.min("nd_best").alias("nd_best"), F.count("*").alias("n")).where("not nd_best or n > 1").drop("n"), "nd-marked")
    drop_staged(full)
    keys, text = ["nd_key1", "nd_key2"], text_or_empty().cast("string")
    keyed = docs.select(whole_row(docs, "nd_row"), F.xxhash64("doc_id", text).alias("nd_key1"), F.xxhash64(F.lit(7), text, "doc_id").alias("nd_key2"))
    kept = keyed.join(small_or_shuffled(marked.select(*keys), MOST_BROADCAST), keys, "left_anti").select("nd_row")
    repeated = marked.where("nd_best").select(*keys)
    if repeated.count():
        once = keyed.join(small_or_shuffled(repeated, MOST_BROADCAST), keys).groupBy(*keys).agg(F.min_by("nd_row", F.to_json("nd_row")).alias("nd_row"))
        kept = kept.unionByName(once.select("nd_row"))
    return kept.select(*(F.col("nd_row").getField(c).alias(c) for c in docs.columns))


def op9_query(spark, sf_dir):
    found = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All pairs that share a shingle, counted, and everything that can be reached by links.
OP9_SQL = f"""
WITH RECURSIVE a AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT id, w, unnest(range(1, greatest(len(w) - {WIDTH - 2}, 2))) AS i FROM a WHERE len(w) > 0),
s AS (SELECT DISTINCT id, CASE WHEN len(w) < {WIDTH} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {WIDTH - 1}], ' ') END AS shingle FROM p),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.id < y.id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n m ON c.a = m.id JOIN n o ON c.b = o.id WHERE 100 * c >= {LEAST_PERCENT} * (m.n + o.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT r.a AS id, min(a.doc_id) AS least FROM r JOIN a ON r.b = a.id GROUP BY r.a)
SELECT a.doc_id, coalesce(n.n, 0) AS n_shingles, least(a.doc_id, k.least) AS component_id, coalesce(a.doc_id = least(a.doc_id, k.least), false) AS kept
FROM a LEFT JOIN n ON a.id = n.id LEFT JOIN k ON a.id = k.id
"""
