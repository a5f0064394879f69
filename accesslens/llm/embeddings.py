"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and fast Hadamard
transforms; its hash is the axis it points along most.  Several hashes make a
bucket, several tables of buckets and probes of the next-best axes make pairs of
near vectors meet, and every pair is verified.

Hashes to a bucket grow with the logarithm of the number of vectors, so that a
bucket holds few by chance; tables and probes are then chosen for a stated
recall, from the share of simulated pairs at the bound that meet.

Crowds of almost equal vectors are gathered into balls first.  Two vectors of a
ball are linked for sure, as both are within a small angle of its centre, so
their links are counted and not listed.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, stage
from .graph import components

LEAST_COSINE = 0.9
#: Share of the pairs at LEAST_COSINE that must meet; nearer pairs meet more often.
RECALL = 0.97
#: Vectors this near to a centre are in its ball: twice that angle is below the angle of LEAST_COSINE.
BALL_COSINE = 0.976
#: Tables in whose buckets centres are looked for.
BALL_TABLES = 3
#: Probes of a table that are tried, and simulated pairs (of tables each) that a rate is measured on.
PROBES = (2, 4, 8)
PAIRS, TRIED = 1500, 4
#: Balls in a bucket beyond which they meet block by block, and balls in a block.
MOST_IN_BUCKET = 64
BLOCK = 512
#: Rows that are rotated together.
CHUNK = 2048
SEED = 20240229


def rotation_width(d: int) -> int:
    """Components that a rotation works on: a power of two, four at least."""
    return 1 << max(2, (int(d) - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the columns, orthonormal; the height is a power of two."""
    width, n = x.shape
    h = 1
    while h < width:
        y = x.reshape(width // (2 * h), 2, h, n)
        x = np.empty_like(y)
        np.add(y[:, 0], y[:, 1], out=x[:, 0])
        np.subtract(y[:, 0], y[:, 1], out=x[:, 1])
        h *= 2
    return x.reshape(width, n) * x.dtype.type(1 / math.sqrt(width))


@cache
def signs(table: int, j: int, width: int) -> np.ndarray:
    """Random signs of the three rounds of a rotation."""
    return np.random.default_rng([SEED, table, j, width]).choice(np.array([-1, 1], np.float32), (3, width, 1))


def axes(x: np.ndarray, table: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The three best axes of a rotation of vectors (in single precision, as columns), and how far each is behind the first."""
    y = x
    for s in signs(table, j, len(x)):
        y = hadamard(y * s)
    size, n = np.abs(y), np.arange(y.shape[1])
    ids, values = np.empty((3, len(n)), np.int64), np.empty((3, len(n)), np.float32)
    for b in range(3):
        at = size.argmax(0)
        values[b] = size[at, n]
        ids[b] = at * 2 + (y[at, n] < 0)
        size[at, n] = -1
    return ids, values[0] - values


def buckets(x: np.ndarray, table: int, k: int, probes: int) -> np.ndarray:
    """Bucket of each row, then those of its ``probes`` likeliest neighbours: (n, 1 + probes)."""
    n, d = x.shape
    width = rotation_width(d)
    weight = np.array([pow(2 * width, j, 1 << 61) for j in range(k)], np.int64)
    out = np.empty((n, 1 + probes), np.int64)
    for low in range(0, n, CHUNK):
        part = np.zeros((width, min(CHUNK, n - low)), np.float32)
        part[:d] = x[low : low + CHUNK].T
        found = [axes(part, table, j) for j in range(k)]
        key = sum(ids[0] * w for (ids, _), w in zip(found, weight, strict=True))
        out[low : low + CHUNK, 0] = key
        if probes:
            moves = np.concatenate([gaps[1:] for _, gaps in found])
            shift = np.concatenate([(ids[1:] - ids[0]) * w for (ids, _), w in zip(found, weight, strict=True)])
            pick = np.argsort(moves, axis=0, kind="stable")[:probes]
            out[low : low + CHUNK, 1:] = (key + np.take_along_axis(shift, pick, 0)).T
    return out


def meeting_rate(d: int, k: int, probes: int, cosine: float) -> float:
    """Share of simulated pairs at a cosine that meet in one table, less two standard errors."""
    rng = np.random.default_rng([SEED, d, k, probes])
    x, y = rng.normal(size=(2, PAIRS, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine * cosine) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    hit = []
    for t in range(TRIED):
        a, b = buckets(x, t, k, probes), buckets(y, t, k, probes)
        hit.append((a[:, :1] == b).any(1) | (b[:, :1] == a).any(1))
    rate = float(np.mean(hit))
    return max(rate - 2 * math.sqrt(rate * (1 - rate) / (PAIRS * TRIED)), 1e-4)


@cache
def plan(d: int, n: int, cosine: float = LEAST_COSINE, recall: float = RECALL) -> tuple[int, int, int]:
    """Hashes to a bucket, tables and probes for ``n`` vectors of ``d`` components: of the probes tried, those with the fewest rows."""
    k = max(1, math.ceil(math.log(max(n, 2)) / math.log(2 * rotation_width(d))))
    best = None
    for probes in {min(p, 2 * k) for p in PROBES}:
        rate = meeting_rate(d, k, probes, cosine)
        tables = 1 if rate >= recall else math.ceil(math.log(1 - recall) / math.log(1 - rate))
        if best is None or (tables * (1 + probes), probes) < (best[1] * (1 + best[2]), best[2]):
            best = k, tables, probes
    return best


def _array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = _array(column)
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def units(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Unit vectors of a column of lists, null where there is none, and their lengths (0 for none)."""
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    n, row = len(column), np.repeat(np.arange(len(column)), size)
    ok = (size > 0) & (np.bincount(row, ~np.isfinite(flat), n) == 0)
    keep = ok[row]
    flat, row = flat[keep], row[keep]
    most = np.zeros(n)
    np.maximum.at(most, row, np.abs(flat))
    ok &= most > 0
    keep = ok[row]
    flat, row = flat[keep], row[keep]
    flat = flat / most[row]
    flat /= np.sqrt(np.bincount(row, flat * flat, n))[row]
    size = np.where(ok, size, 0)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~ok, False)), pa.array(flat))
    return lists, size


def prepare(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``row, vec_id, dim, unit``: a row number and the unit vector, or null if it links with nothing."""

    def run(batches):
        for batch in batches:
            lists, size = units(batch.column("v"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(size, pa.int32()), lists], ["row", "vec_id", "dim", "unit"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    return stage(rows.mapInArrow(run, "row long, vec_id long, dim int, unit array<double>"), "vectors")


def hashed(vectors: DataFrame, plans: dict[int, tuple[int, int, int]], extra: str) -> DataFrame:
    """Rows of ``vectors`` (``dim, unit``, one ``extra`` long) with their buckets, one row for each table and probe.

    ``plans`` gives hashes, tables and probes by rotation width.
    """

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x, own = _matrix(part.column("unit")), part.column(extra).to_numpy()
                k, tables, probes = plans[rotation_width(dim)]
                for t in range(tables):
                    keys = buckets(x, t, k, probes)
                    width = keys.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(own, width)),
                            pa.array(np.full(keys.size, t, np.int32)),
                            pa.array(np.full(keys.size, dim, np.int32)),
                            pa.array(keys.ravel()),
                            pa.array(np.tile(np.arange(width) > 0, len(keys))),
                        ],
                        [extra, "table", "dim", "bucket", "probe"],
                    )

    columns = list(dict.fromkeys(["dim", "unit", extra]))
    return vectors.select(*columns).mapInArrow(run, f"{extra} long, table int, dim int, bucket long, probe boolean")


def cosines(pairs: DataFrame, keep: list[str], least: float) -> DataFrame:
    """Of ``pairs`` with unit vectors ``u`` and ``v`` those of a cosine of at least ``least``: ``keep`` and their ``cosine``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                u, v = (_array(batch.column(c)) for c in "uv")
                size = u.value_lengths().to_numpy()
                product = u.flatten().to_numpy() * v.flatten().to_numpy()
                dot = np.add.reduceat(product, np.cumsum(size) - size)
                at = pa.array(np.flatnonzero(dot >= least))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array(dot).take(at)], [*keep, "cosine"])

    schema = ", ".join([*(f"{c} long" for c in keep), "cosine double"])
    return pairs.select(*keep, "u", "v").mapInArrow(run, schema)


BUCKET = ["table", "dim", "bucket"]


def gather(vectors: DataFrame, plans: dict[int, tuple[int, int, int]]) -> DataFrame:
    """``row, ball, cosine``: the centre of each row's ball and how near it is.

    Centres are the smallest rows of buckets.  A row goes to the smallest centre
    of its buckets that is near enough; a row without one is a ball of one.  (A
    centre may itself belong to another ball.)
    """
    keyed = stage(hashed(vectors, {w: (k, BALL_TABLES, 0) for w, (k, _, _) in plans.items()}, "row").drop("probe"), "ball-keys")
    centre = keyed.groupBy(*BUCKET).agg(F.min("row").alias("ball"), F.count("*").alias("n")).where("n > 1").drop("n")
    wanted = stage(keyed.join(centre, BUCKET).where("row <> ball").select("row", "ball").distinct(), "ball-wanted")
    u = vectors.select("row", F.col("unit").alias("u"))
    v = vectors.select(F.col("row").alias("ball"), F.col("unit").alias("v"))
    near = cosines(wanted.join(u, "row").join(v, "ball"), ["row", "ball"], BALL_COSINE)
    best = near.groupBy("row").agg(F.min(F.struct("ball", "cosine")).alias("x")).select("row", "x.ball", "x.cosine")
    every = vectors.select("row").join(stage(best, "balls"), "row", "left")
    return every.select("row", F.coalesce("ball", "row").alias("ball"), F.coalesce("cosine", F.lit(1.0)).alias("cosine"))


def ball_pairs(members: DataFrame, plans: dict[int, tuple[int, int, int]]) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``p < q`` of balls that meet in a bucket, and the rows of crowded buckets.

    A ball comes once to a bucket, however many of its vectors fall there; of
    two balls that meet, one is in its own bucket and not just probing.
    """
    rows = stage(hashed(members, plans, "ball").groupBy(*BUCKET, "ball").agg(F.min("probe").alias("probe")), "ball-buckets")
    crowded = stage(rows.groupBy(*BUCKET).agg(F.count("*").alias("n")).where(F.col("n") > MOST_IN_BUCKET), "crowded-buckets")
    few = rows.join(crowded.select(*BUCKET), BUCKET, "left_anti")
    met = few.where("not probe").select(*BUCKET, F.col("ball").alias("p")).join(few.select(*BUCKET, F.col("ball").alias("q")), BUCKET)
    pairs = met.where("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    return pairs, rows.join(crowded, BUCKET)


def crowd_pairs(crowded: DataFrame, centres: DataFrame, least: float) -> DataFrame:
    """Pairs of balls of crowded buckets whose centres are near: blocks of a bucket against blocks, in bounded memory."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = crowded.join(centres.select("ball", "unit"), "ball").withColumn("blocks", blocks).withColumn("block", F.pmod(F.pmod(F.xxhash64("ball"), F.lit(1 << 20)), "blocks").cast("int"))
    left = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*BUCKET, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "probe", "ball", "unit")

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("unit"))
        block, probe, ball = (table.column(c).to_numpy() for c in ("block", "probe", "ball"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        s, t = np.nonzero(x[one] @ x[two].T >= least)
        s, t = one[s], two[t]
        ok = ~(probe[s] & probe[t]) & ((ball[s] < ball[t]) if i == j else (ball[s] != ball[t]))
        p, q = ball[s[ok]], ball[t[ok]]
        return pa.table({"p": np.minimum(p, q), "q": np.maximum(p, q)})

    return left.groupBy(*BUCKET, "i", "j").applyInArrow(run, "p long, q long")


def link(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", least_cosine: float = LEAST_COSINE, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each row of ``vectors``.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing; vectors link only with those of equal length.  Repeated
    rows are vectors of their own, linked with each other, that share a vec_id;
    ``kept`` holds for all rows with the smallest vec_id of their component.  A
    null vec_id is never the smallest, unless a component has no other: then
    ``component_id`` is null and ``kept`` false.  Other columns are not read,
    whatever their names.  Empty tables give empty results.

    ``recall`` is the share of pairs at ``least_cosine`` that meet, at any number
    of vectors: the plan of each rotation width comes from how many it has.
    """
    rows = prepare(vectors, id_column, vector_column)
    valid = rows.where("unit is not null")
    counts = {r["dim"]: r["n"] for r in valid.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each length
    sizes: dict[int, list[int]] = {}
    for d in counts:
        sizes.setdefault(rotation_width(d), []).append(d)
    plans = {w: plan(max(ds), sum(counts[d] for d in ds), least_cosine, recall) for w, ds in sizes.items()}
    ball = gather(valid, plans)
    members = stage(valid.join(ball, "row").select("row", "dim", "unit", "ball", "cosine"), "ball-members")
    grouped = members.groupBy("ball").agg(F.count("*").alias("size"), F.min("cosine").alias("reach"))
    centres = stage(grouped.join(valid.select(F.col("row").alias("ball"), "unit"), "ball"), "ball-balls")
    pairs, crowded = ball_pairs(members, plans)
    angle, reach = math.acos(least_cosine), math.acos(BALL_COSINE)
    if 2 * reach > angle:
        raise ValueError("balls are too wide for that cosine")
    far = math.cos(min(math.pi, angle + 2 * reach))
    pairs = stage(pairs.unionByName(crowd_pairs(crowded, centres, far)).distinct(), "ball-pairs")
    side = lambda p, u: centres.select(F.col("ball").alias(p), F.col("unit").alias(u))
    near = stage(cosines(pairs.join(side("p", "u"), "p").join(side("q", "v"), "q"), ["p", "q"], far), "near-balls")
    size = lambda side: centres.select(F.col("ball").alias(side), F.col("size").alias(f"{side}_size"), F.acos(F.least("reach", F.lit(1.0))).alias(f"{side}_reach"))
    near = near.join(size("p"), "p").join(size("q"), "q").withColumn("between", F.acos(F.greatest(F.lit(-1.0), F.least("cosine", F.lit(1.0)))))
    slack = 1e-7
    sure = F.col("between") + F.col("p_reach") + F.col("q_reach") + slack <= angle
    never = F.col("between") - F.col("p_reach") - F.col("q_reach") - slack > angle
    single = (F.col("p_size") == 1) & (F.col("q_size") == 1) & (F.col("p_reach") == 0) & (F.col("q_reach") == 0)
    decided = stage(near.withColumn("all", F.when(single, F.col("cosine") >= least_cosine).when(sure, True).when(never, False)), "decided-balls")
    whole = decided.where("all")
    by_ball = whole.select(F.col("p").alias("ball"), F.col("q_size").alias("n")).unionByName(whole.select(F.col("q").alias("ball"), F.col("p_size").alias("n"))).groupBy("ball").agg(F.sum("n").alias("more"))
    some = verify_members(decided.where("all is null").select("p", "q", "p_size", "q_size"), members, least_cosine)
    by_row = some.groupBy("row").agg(F.sum("n").alias("few"))
    edges = whole.select(F.col("p").alias("a"), F.col("q").alias("b")).unionByName(some.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct())
    root = components(edges).select(F.col("node").alias("ball"), "root")
    known = members.select("row", "ball").join(centres.select("ball", "size"), "ball").join(by_ball, "ball", "left").join(root, "ball", "left").join(by_row, "row", "left")
    counted = stage(known.select("row", F.coalesce("root", "ball").alias("root"), (F.col("size") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("few", F.lit(0))).alias("n_links")).join(rows.select("row", "vec_id"), "row"), "links")
    least = stage(counted.groupBy("root").agg(F.min("vec_id").alias("component_id")), "least-ids")
    linked = counted.join(least, "root").select("vec_id", "n_links", "component_id")
    alone = rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def verify_members(pairs: DataFrame, members: DataFrame, least_cosine: float) -> DataFrame:
    """``row, p, q, n``: links of each member of a ball with members of another, where balls alone don't tell.

    Members come in blocks, so a task holds two blocks whatever the balls' sizes.
    """
    blocks = lambda side: F.ceil(F.col(f"{side}_size") / BLOCK).cast("int")
    todo = pairs.select("p", "q", blocks("p").alias("np"), blocks("q").alias("nq"))
    m = members.select("row", "ball", "unit", F.pmod(F.xxhash64("row"), F.lit(1 << 20)).alias("salt"))
    left = todo.join(m.withColumnRenamed("ball", "p"), "p").select("p", "q", F.lit(0).alias("side"), F.pmod("salt", "np").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("j"), "row", "unit")
    right = todo.join(m.withColumnRenamed("ball", "q"), "q").select("p", "q", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("i"), F.pmod("salt", "nq").cast("int").alias("j"), "row", "unit")

    def run(table: pa.Table) -> pa.Table:
        x, side, row = _matrix(table.column("unit")), table.column("side").to_numpy(), table.column("row").to_numpy()
        hit = x[side == 0] @ x[side == 1].T >= least_cosine
        rows, n = np.concatenate([row[side == 0], row[side == 1]]), np.concatenate([hit.sum(1), hit.sum(0)]).astype(np.int64)
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        some = n > 0
        return pa.table({"row": rows[some], "p": np.full(some.sum(), p), "q": np.full(some.sum(), q), "n": n[some]})

    return stage(left.unionByName(right).groupBy("p", "q", "i", "j").applyInArrow(run, "row long, p long, q long, n long"), "member-links")


def op10_query(spark, sf_dir):
    return link(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
