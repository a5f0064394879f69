"""Language-model scores by context-tree weighting over bytes.

A text is lower-cased (A to Z), white space as it is, and an end mark follows;
each byte is coded as eight binary decisions.  Every decision
has a tree of contexts, the last 0 to ``DEPTH`` bytes.  A node keeps
Krichevsky-Trofimov counts; its weighted probability is half its own estimate
and half the product of its children's, so the tree mixes all depths.  Trained
counts give every node the weight of its own estimate against its children's;
scoring follows a context downwards and mixes by these weights.  A child that
training never saw has counts of zero and predicts one half.

Counting, tree building and scoring are distributed.  No node is left out:
every context of ``DEPTH`` bytes is in one part of the tree, with all that share
its last ``TOP`` bytes.  The scores of the most frequent grams (a context and
the byte after it) are sent to the workers; all other grams of the documents
meet the whole tree of their part in a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, read_table, stage, text_or_empty

#: Bytes of context, and of them those that place a subtree.
DEPTH = 6
TOP = 3
#: The end mark, a byte that UTF-8 has no use for.
END = 255
#: Grams whose scores are sent to each worker, at most: those with the most occurrences.
MOST_GRAMS = 1 << 20
#: Words sent to each worker: those with at least this share of all training tokens.
WORD_SHARE = 1 / (1 << 20)
#: Bytes of text and distinct keys that a worker gathers before it hands on.
BLOCK = 3 << 20
HELD = 4 << 20
#: Grams whose nodes are held together, and grams scored together.
STRETCH = 1 << 15
#: Counts and places of counts in the base score.
ALPHA = 0.1

U = np.uint64
GRAMS = "part int, grams binary"
NODES = "kind int, key long, a double, b double"
UPPER = "head int, " + NODES
WORDS = "word long, n long"
BLOCKS = "block long, sums binary"
#: Bits of the number of a document within its block.
DOC_BITS = 10
SCORES = "held_out boolean, doc_row long, n_tokens long, known long, base double, score double, rare array<struct<word:long,n:long>>, open array<struct<gram:long,n:long>>"


# --- packing -----------------------------------------------------------------


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys, as differences, and columns of integers (of distinct keys their counts), byte by byte, compressed."""
    codec = pa.Codec("zstd", 1)
    values = (np.diff(keys, prepend=U(0)), *columns)
    raw = np.ascontiguousarray(np.vstack([x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T for x in values])).tobytes()
    return len(keys).to_bytes(8, "little") + codec.compress(raw, asbytes=True)


def unpack(data: bytes, columns: int = 1) -> tuple[np.ndarray, ...]:
    n, rows = int.from_bytes(data[:8], "little"), 8 * (1 + columns)
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], rows * n, asbytes=True), np.uint8).reshape(rows, n)
    steps, *rest = (np.ascontiguousarray(raw[i : i + 8].T).view(np.uint64).reshape(-1) for i in range(0, rows, 8))
    return np.cumsum(steps, dtype=np.uint64), *rest


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    start = np.flatnonzero(np.diff(k, prepend=~k[:1])) if len(k) else np.zeros(0, np.int64)
    return k[start], np.add.reduceat(c, start) if len(k) else c


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values of integer keys."""
    x = x * U(0x9E3779B97F4A7C15)
    return (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)


def place_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of the tree that holds the contexts of some keys."""
    return (mixed(keys >> U(8 * (DEPTH + 1 - TOP))) >> U(33)) % U(parts)


def counted(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each occurs."""
    order = np.lexsort((value, group))
    group, value = group[order], value[order]
    new = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(value, prepend=U(0)) != 0))
    return group[new], value[new], np.diff(new, append=len(group))


# --- texts -------------------------------------------------------------------


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all coded bytes of some lower-cased texts, and the first one of each text.

    A key holds the ``DEPTH`` bytes before a byte, the last one first, and then
    the byte itself.  Before a text stand end marks.
    """
    pad = bytes([END]) * DEPTH
    bodies = [pad + t + pad[:1] for t in texts]
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    keys = raw[DEPTH:].astype(np.uint64)
    for j in range(1, DEPTH + 1):
        keys |= raw[DEPTH - j : len(raw) - j].astype(np.uint64) << U(8 * (DEPTH + 1 - j))
    starts = np.cumsum(sizes) - sizes
    real = np.ones(len(raw), bool)
    real[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return keys[real[DEPTH:]], np.cumsum(sizes - DEPTH) - (sizes - DEPTH)


# --- training ----------------------------------------------------------------


def count_grams(texts: DataFrame, parts: int) -> DataFrame:
    """Counts of all keys of all training texts: packed, one row for each of ``parts``."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: list[bytes] = []
        size = 0

        def settle():
            nonlocal held, waiting, size
            keys = np.sort(stream(waiting)[0])
            start = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            held.append((keys[start], np.diff(start, append=len(keys)).astype(np.uint64)))
            held = [merged([k for k, _ in held], [c for _, c in held])]
            waiting, size = [], 0

        def flush():
            nonlocal held
            [(keys, counts)] = held
            held = []
            part = (mixed(keys) >> U(33)) % U(parts)
            order = np.argsort(part, kind="stable")
            keys, counts, cut = keys[order], counts[order], np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            spans = [(p, a, b) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in spans], pa.int32()), pa.array([pack(keys[a:b], counts[a:b]) for _, a, b in spans], pa.binary())], ["part", "grams"])

        for batch in batches:
            for text in batch.column("text"):
                waiting.append(lowered(text.as_py()))
                size += len(waiting[-1]) + DEPTH
                if size >= BLOCK:
                    settle()
                    if len(held[0][0]) >= HELD:
                        yield flush()
        if waiting:
            settle()
        if held:
            yield flush()

    def total(table: pa.Table) -> pa.Table:
        got = [unpack(x.as_py()) for x in table.column("grams")]
        keys, counts = merged([k for k, _ in got], [c for _, c in got])
        place = place_of(keys, parts)
        order = np.argsort(place, kind="stable")
        keys, counts, cut = keys[order], counts[order], np.searchsorted(place[order], np.arange(parts + 1, dtype=np.uint64))
        spans = [(p, a, b) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        return pa.table({"part": pa.array([p for p, _, _ in spans], pa.int32()), "grams": pa.array([pack(keys[a:b], counts[a:b]) for _, a, b in spans], pa.binary())})

    packed = texts.mapInArrow(run, GRAMS).repartition(parts, "part")
    return stage(packed.groupBy("part").applyInArrow(total, GRAMS), "ctw-grams")


_HALVES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(4096) + 0.5))])
_FACTORIALS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096)))])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for arguments from 4096 on."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _log_halves(n: np.ndarray) -> np.ndarray:
    """log of (1/2)(3/2)...(n - 1/2)."""
    small = n < 4096
    far = np.where(small, 4096.0, n)
    return np.where(small, _HALVES[np.where(small, n, 0).astype(np.int64)], _log_gamma(far + 0.5) - 0.5 * np.log(np.pi))


def _log_factorial(n: np.ndarray) -> np.ndarray:
    small = n < 4096
    far = np.where(small, 4096.0, n)
    return np.where(small, _FACTORIALS[np.where(small, n, 0).astype(np.int64)], _log_gamma(far + 1.0))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of counts."""
    return _log_halves(zeros) + _log_halves(ones) - _log_factorial(zeros + ones)


def node_key(depth: int, context: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Key of a node: depth, context (its bytes, last one first) and place in the tree of a byte's bits (1 to 255)."""
    return (U(depth) << U(56)) | (context << U(8)) | index.astype(np.uint64)


def build_nodes(grams: np.ndarray, counts: np.ndarray, depth: int, least: int, below: dict[int, np.ndarray] | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """All nodes from contexts of ``depth`` bytes up to ``least`` bytes, of whole subtrees.

    ``grams`` are sorted keys of ``depth`` bytes and one more.  ``below`` has
    keys and log-probabilities of the children of the deepest nodes.  Returns a
    list of ``(key, odds, w, visits)`` arrays, odds being those of a one, and keys and summed logs for the
    parents of the nodes of ``least`` bytes.
    """
    out, child = [], below
    for d in range(depth, least - 1, -1):
        if d < depth:
            shift = U(8 * (depth - d))
            grams_d = ((grams >> U(8)) >> shift) << U(8) | (grams & U(255))
            g, c = merged([grams_d], [counts])
        else:
            g, c = grams, counts
        c = c.astype(np.float64)
        up_keys, up_logs = [], []
        for level in range(8):
            head = g >> U(8 - level)  # context and the first bits of the byte
            start = np.flatnonzero(np.diff(head, prepend=~head[:1])) if len(head) else np.zeros(0, np.int64)
            if not len(start):
                continue
            bit = ((g >> U(7 - level)) & U(1)).astype(np.float64)
            n, ones = np.add.reduceat(c, start), np.add.reduceat(c * bit, start)
            context = g[start] >> U(8)
            index = (U(1 << level) | ((g[start] & U(255)) >> U(8 - level))) if level else np.ones(len(start), np.uint64)
            key = node_key(d, context, index)
            own = log_kt(n - ones, ones)
            if child is None:
                log_w, w = own, np.ones(len(start))
            else:
                keys, logs = child
                at = np.searchsorted(keys, key)
                inner = np.where((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == key), logs[np.minimum(at, len(keys) - 1)], 0.0)
                log_w = np.logaddexp(own, inner) - np.log(2)
                w = np.exp(own - np.log(2) - log_w)
            out.append((key, (ones + 0.5) / (n - ones + 0.5), w, n))
            if d:
                up_keys.append(node_key(d - 1, context >> U(8), index))
                up_logs.append(log_w)
        if d and up_keys:
            k, x = np.concatenate(up_keys), np.concatenate(up_logs)
            order = np.argsort(k)
            k, x = k[order], x[order]
            first = np.flatnonzero(np.diff(k, prepend=~k[:1]))
            child = (k[first], np.add.reduceat(x, first))
        else:
            child = (np.zeros(0, np.uint64), np.zeros(0))
    return out, *child


def stretches(keys: np.ndarray, depth: int, most: int) -> np.ndarray:
    """Bounds of stretches of sorted keys that hold whole contexts of ``depth`` bytes: ``most`` keys at most, or one context."""
    head = keys >> U(8 * (DEPTH + 1 - depth))
    cuts = np.append(np.flatnonzero(np.diff(head, prepend=~head[:1])), len(keys))
    bounds = [0]
    while bounds[-1] < len(keys):
        at = np.searchsorted(cuts, bounds[-1] + most, "right") - 1
        bounds.append(int(cuts[at] if cuts[at] > bounds[-1] else cuts[at + 1]))
    return np.array(bounds if len(keys) else [0, 0])


def shortened(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of ``depth`` bytes of context, in order, and their counts."""
    return merged([((keys >> U(8)) >> U(8 * (DEPTH - depth))) << U(8) | (keys & U(255))], [counts])


def handed_up(keys: np.ndarray, counts: np.ndarray, least: int, most: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """What ``build_nodes`` hands up from contexts of ``DEPTH`` to ``least`` bytes, of which a stretch at a time is built.

    A context with more grams than a stretch holds is built from those that are
    one byte longer, which are divided alike.
    """
    up, logs = [np.zeros(0, np.uint64)], [np.zeros(0)]
    bounds = stretches(keys, least, most)
    for a, b in zip(bounds, bounds[1:]):
        k, c = keys[a:b], counts[a:b]
        if b - a <= most or least == DEPTH:
            _, u, x = build_nodes(k, c, DEPTH, least)
        else:
            _, u, x = build_nodes(*shortened(k, c, least), least, least, handed_up(k, c, least + 1, most))
        up.append(u)
        logs.append(x)
    return merged(up, logs)


def _node_table(kind: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> pa.Table:
    zeros = np.zeros(len(keys))
    values = [zeros if x is None else x.astype(np.float64) for x in (a, b)]
    return pa.table([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), *map(pa.array, values)], ["kind", "key", "a", "b"])


def gathered(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a part and their counts."""
    none = np.zeros(0, np.uint64)
    got = [unpack(x) for x in packed] or [(none, none)]
    return merged([k for k, _ in got], [c for _, c in got])


def steps_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts.astype(np.float64)) * 64).astype(np.int64)


def build_tree(texts: DataFrame, parts: int, most_grams: int = MOST_GRAMS) -> tuple[DataFrame, tuple[np.ndarray, ...], int]:
    """The tree of the training texts (``text``, not null).

    Returns the counted grams of each of ``parts``, a written table; the nodes
    above them, of contexts shorter than ``TOP`` bytes (at most 256 to the power
    ``TOP`` at any size of the corpus), as keys in order, estimates and weights; and the
    step of counts from which on a gram is one of the ``most_grams`` most
    frequent, all of the last step or none.  Subtrees below ``TOP`` bytes are
    built apart, in as many tasks as ``parts``; what is above them by their last
    byte.
    """
    grams = count_grams(texts, parts)

    def subtrees(table: pa.Table) -> pa.Table:
        keys, counts = gathered([x.as_py() for x in table.column("grams")])
        up, logs = handed_up(keys, counts, TOP)
        # nodes of TOP bytes hand their logs on; the counts of shorter contexts too
        k, c = shortened(keys, counts, TOP - 1)
        step, n = np.unique(steps_of(counts), return_counts=True)
        return pa.concat_tables([_node_table(1, up, logs), _node_table(2, k, c), _node_table(3, step.view(np.uint64), n)])

    rows = stage(grams.repartition(parts, "part").groupBy("part").applyInArrow(subtrees, NODES), "ctw-nodes")

    def upper(table: pa.Table) -> pa.Table:
        """Nodes of ``TOP`` - 1 bytes and up to one byte, of all contexts with one last byte."""
        kind, key, a = (table.column(x).to_numpy() for x in ("kind", "key", "a"))
        key = key.view(np.uint64)
        up, short = kind == 1, kind == 2
        uo, so = np.argsort(key[up]), np.argsort(key[short])
        keys, counts = key[short][so], a[short][so]
        nodes, next_up, logs = build_nodes(keys, counts, TOP - 1, 1, (key[up][uo], a[up][uo]))
        k, odds, w, _ = (np.concatenate(x) for x in zip(*nodes, strict=True))
        return pa.concat_tables([_node_table(0, k, odds, w), _node_table(1, next_up, logs), _node_table(2, *merged([keys & U(255)], [counts]))])

    sums = rows.groupBy("kind", "key").agg(F.sum("a").alias("a"))
    head = F.shiftright("key", 8 * (TOP - 1)).bitwiseAND(F.lit(255)).cast("int")
    middle = stage(sums.where("kind < 3").withColumn("head", head).groupBy("head").applyInArrow(upper, NODES), "ctw-upper")
    least_rows = middle.where("kind > 0").groupBy("kind", "key").agg(F.sum("a").alias("a")).orderBy("key").toArrow()  # 511 rows at most
    kind, key, a = (least_rows.column(x).to_numpy() for x in ("kind", "key", "a"))
    key = key.view(np.uint64)
    nodes, _, _ = build_nodes(key[kind == 2], a[kind == 2], 0, 0, (key[kind == 1], a[kind == 1]))
    shorter = pa.concat_tables([middle.where("kind = 0").select("key", "a", "b").toArrow(), *(_node_table(0, *x[:3]).select(["key", "a", "b"]) for x in nodes)])
    key, odds, w = (shorter.column(x).to_numpy() for x in ("key", "a", "b"))
    order = np.argsort(key.view(np.uint64))
    above = key.view(np.uint64)[order], odds[order], w[order]
    taken, least = 0, 1 << 40
    for r in sums.where("kind = 3").orderBy(F.desc("key")).collect():
        taken += r["a"]
        if taken > most_grams:
            break
        least = r["key"]
    return grams, above, least


def train(texts: DataFrame, parts: int, least_share: float = 0.0) -> dict:
    """The model of a few texts, brought to the driver whole but for nodes below ``TOP`` bytes with less than ``least_share`` of all coded bytes."""
    grams, above, _ = build_tree(texts, parts)
    keys, counts = gathered([r["grams"] for r in grams.select("grams").collect()])
    return part_model(keys, counts, above, keys[:0], least_share * float(counts.sum()))


# --- scoring -----------------------------------------------------------------


def mixtures(keys: np.ndarray, odds: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of each node the log-odds of a one where it is the deepest node that training saw of a context.

    A node's ancestors are known by its key, and they must all be given.  What a
    node leaves to children that were never seen is predicted by one half.  Ones
    and zeros are mixed apart, so that neither is lost beside the other.
    """
    order = np.argsort(keys)
    keys, odds, w = keys[order], odds[order], w[order]
    p = np.stack([odds / (1 + odds), 1 / (1 + odds)])
    above, carry = np.zeros((2, len(keys))), np.ones(len(keys))
    depth = (keys >> U(56)).astype(np.int64)
    for d in range(1, DEPTH + 1):
        own = np.flatnonzero(depth == d)
        if not len(own):
            break
        context = (keys[own] >> U(8)) & U((1 << 48) - 1)
        parent = np.searchsorted(keys, node_key(d - 1, context >> U(8), keys[own] & U(255)))
        above[:, own] = above[:, parent] + carry[parent] * w[parent] * p[:, parent]
        carry[own] = carry[parent] * (1 - w[parent])
    one, zero = above + carry * (w * p + (1 - w) / 2)
    out = np.empty(len(keys))
    out[order] = np.log(one) - np.log(zero)
    return out


def hash_table(keys: np.ndarray, values: np.ndarray) -> dict:
    """An open hash table of distinct keys above zero, at most half full, and their values; zero where nothing is."""
    bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
    size = 1 << bits
    table, value = np.zeros(size, np.uint64), np.zeros(size)
    slot = (mixed(keys) >> U(64 - bits)).astype(np.int64)
    left = np.arange(len(keys))
    while len(left):
        s = slot[left]
        free = table[s] == 0
        table[s[free]] = keys[left[free]]  # of those that want one slot, the last gets it
        got = table[s] == keys[left]
        value[s[got]] = values[left[got]]
        left = left[~got]
        slot[left] = (slot[left] + 1) % size
    return {"bits": bits, "keys": table, "value": value}


def part_model(keys: np.ndarray, counts: np.ndarray, above: tuple[np.ndarray, ...], asked: np.ndarray, least: float = 0.0, depth: int = TOP) -> dict:
    """A hash table of the nodes of a part and of their ancestors: key and mixed log-odds of a one.

    ``keys`` and ``counts`` are all grams of whole contexts of ``depth`` bytes,
    ``above`` the nodes of shorter contexts in order; of those the ones between
    the first and the last ancestors of ``keys`` and of the grams ``asked`` are
    taken.
    """
    ends = np.concatenate([x[[0, -1]] for x in (keys, asked) if len(x)] or [keys])
    near = [np.zeros(0, np.int64)]
    for d in range(depth):
        context = ends >> U(8 * (DEPTH + 1 - d))
        if len(context):
            near.append(np.arange(*np.searchsorted(above[0], [node_key(d, context.min(), U(0)), node_key(d, context.max() + U(1), U(0))])))
    near = np.concatenate(near)
    nodes, _, _ = build_nodes(keys, counts, DEPTH, depth)
    key, odds, w = (np.concatenate(x) for x in zip([x[near] for x in above], *([x[n >= least] for x in (k, o, w)] for k, o, w, n in nodes), strict=True))
    return hash_table(key, mixtures(key, odds, w))


def part_logs(keys: np.ndarray, counts: np.ndarray, above: tuple[np.ndarray, ...], asked: np.ndarray, depth: int = TOP, most: int = STRETCH) -> np.ndarray:
    """log10 of the grams ``asked`` (sorted) from the grams of a part, of whose nodes a stretch at a time is held.

    A context with more grams than a stretch holds is divided by those that are
    one byte longer, its own nodes then being ``above`` them.
    """
    logs = np.empty(len(asked))
    bounds = stretches(keys, depth, most)
    first = keys[bounds[1:-1]] >> U(8 * (DEPTH + 1 - depth)) << U(8 * (DEPTH + 1 - depth))
    own = np.concatenate([[0], np.searchsorted(asked, first), [len(asked)]])
    for a, b, low, high in zip(bounds, [*bounds[1:-1], len(keys)], own, own[1:]):
        k, c, these = keys[a:b], counts[a:b], asked[low:high]
        if not len(these):
            continue
        if b - a <= most or depth == DEPTH:
            model = part_model(k, c, above, these, depth=depth)
            for i in range(low, high, STRETCH):
                logs[i : min(i + STRETCH, high)] = log10_of(model, asked[i : min(i + STRETCH, high)])
        else:
            nodes, _, _ = build_nodes(*shortened(k, c, depth), depth, depth, handed_up(k, c, depth + 1, most))
            more = [np.concatenate(x) for x in zip(above, *(x[:3] for x in nodes), strict=True)]
            order = np.argsort(more[0])
            logs[low:high] = part_logs(k, c, tuple(x[order] for x in more), these, depth + 1, most)
    return logs


def find(model: dict, keys: np.ndarray) -> np.ndarray:
    """Slot of each key, or -1."""
    table, size = model["keys"], 1 << model["bits"]
    slot = (mixed(keys) >> U(64 - model["bits"])).astype(np.int64)
    out = np.full(len(keys), -1)
    left = np.arange(len(keys))
    while len(left):
        here = table[slot[left]]
        hit = here == keys[left]
        out[left[hit]] = slot[left[hit]]
        left = left[~hit & (here != 0)]
        slot[left] = (slot[left] + 1) % size
    return out


def log10_of(model: dict, grams: np.ndarray) -> np.ndarray:
    """log10 of the probability of the last byte of each key, given the bytes before it.

    Wherever a context is kept, so are its suffixes; a search by halves finds
    the longest kept one of each decision.
    """
    logs = np.zeros(len(grams))
    context, byte = grams >> U(8), grams & U(255)
    shift = (8 * (DEPTH - np.arange(DEPTH + 1))).astype(np.uint64)
    for level in range(8):
        index = (U(1 << level) | (byte >> U(8 - level))) if level else np.ones(len(grams), np.uint64)
        one = ((byte >> U(7 - level)) & U(1)).astype(bool)
        low, high = np.full(len(grams), -1), np.full(len(grams), DEPTH)  # kept at low (or nothing is), not above high
        best = np.full(len(grams), -1)
        while len(todo := np.flatnonzero(low < high)):
            middle = (low[todo] + high[todo] + 1) // 2
            key = (middle.astype(np.uint64) << U(56)) | ((context[todo] >> shift[middle]) << U(8)) | index[todo]
            slot = find(model, key)
            hit = slot >= 0
            low[todo[hit]], best[todo[hit]] = middle[hit], slot[hit]
            high[todo[~hit]] = middle[~hit] - 1
        odds = np.where(best >= 0, model["value"][best], 0.0)
        logs -= np.logaddexp(0, np.where(one, -odds, odds))
    return logs / np.log(10)


def frequent_logs(grams: DataFrame, parts: int, above, least: int) -> dict:
    """A hash table of the grams from a step of counts on, each key plus one, and their log10."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = gathered([x.as_py() for x in table.column("grams")])
        asked = keys[steps_of(counts) >= least]
        logs = part_logs(keys, counts, above.value, asked)
        return pa.table({"gram": asked.view(np.int64), "log": logs})

    got = grams.repartition(parts, "part").groupBy("part").applyInArrow(run, "gram long, log double").toArrow()
    return hash_table(got.column("gram").to_numpy().view(np.uint64) + U(1), got.column("log").to_numpy())


def open_scores(scored: DataFrame, grams: DataFrame, parts: int, above) -> DataFrame:
    """``doc_row, more_score``: sums of log10 of the ``open`` grams of documents.

    Grams are sent packed to the part of the tree that has all their contexts.
    A part's distinct grams are scored once; of its packed rows one at a time is
    open.  A part's sums go back packed, a row for each block of documents, and
    are added up block by block.
    """

    def sent(batches):
        for batch in batches:
            lists = batch.column("open")
            keys, n = (lists.flatten().field(i).to_numpy() for i in (0, 1))
            keys = keys.view(np.uint64)
            doc = np.repeat(batch.column("doc_row").to_numpy(), lists.value_lengths().to_numpy())
            part = place_of(keys, parts)
            order = np.lexsort((keys, part))
            keys, doc, n, cut = keys[order], doc[order], n[order], np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            spans = [(p, a, b) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in spans], pa.int32()), pa.array([pack(keys[a:b], doc[a:b], n[a:b]) for _, a, b in spans], pa.binary())], ["part", "grams"])

    def run(table: pa.Table) -> pa.Table:
        rows, asking = table.column("grams"), table.column("asked").to_numpy()
        waiting = np.flatnonzero(asking)
        blocks, packed = [], []
        if len(waiting):
            asked = np.unique(np.concatenate([np.unique(unpack(rows[i].as_py(), 2)[0]) for i in waiting]))
            keys, counts = gathered([rows[i].as_py() for i in np.flatnonzero(~asking)])
            logs = part_logs(keys, counts, above.value, asked)
            for i in waiting:
                k, doc, n = unpack(rows[i].as_py(), 2)
                doc, back = np.unique(doc, return_inverse=True)
                sums = np.bincount(back, logs[np.searchsorted(asked, k)] * n, len(doc))
                block = doc >> U(DOC_BITS)
                start = np.flatnonzero(np.diff(block, prepend=~block[:1]))
                blocks.append(block[start].view(np.int64))
                packed += [pack(d, x.view(np.uint64)) for d, x in zip(np.split(doc, start[1:]), np.split(sums, start[1:]))]
        return pa.table({"block": np.concatenate([np.zeros(0, np.int64), *blocks]), "sums": pa.array(packed, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros(1 << DOC_BITS)
        seen = np.zeros(1 << DOC_BITS, bool)
        first = np.uint64(table.column("block")[0].as_py() << DOC_BITS)
        for x in table.column("sums"):
            doc, more = unpack(x.as_py())
            at = (doc - first).astype(np.int64)
            sums[at] += more.view(np.float64)
            seen[at] = True
        at = np.flatnonzero(seen)
        return pa.table({"doc_row": at + int(first), "more_score": sums[at]})

    asked = scored.where(F.size("open") > 0).select("doc_row", "open").mapInArrow(sent, GRAMS).withColumn("asked", F.lit(True))
    met = grams.withColumn("asked", F.lit(False)).unionByName(asked).select("part", "grams", "asked")
    blocks = stage(met.repartition(parts, "part").groupBy("part").applyInArrow(run, BLOCKS), "ctw-open")
    return stage(blocks.groupBy("block").applyInArrow(add, "doc_row long, more_score double"), "ctw-open")


# --- words of the base score -------------------------------------------------


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def count_words(texts: DataFrame) -> DataFrame:
    """Counts of the words of all training texts by 64-bit hash; each task adds up before the shuffle."""

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal held, size
            words, n = np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                held.append(hashes(lowered(text.as_py()).split()))
                size += len(held[-1])
                if size >= HELD:
                    yield flush()
        if size:
            yield flush()

    return texts.mapInArrow(run, WORDS).groupBy("word").agg(F.sum("n").alias("n"))


def listed(rows: int, row: np.ndarray, values: np.ndarray, times: np.ndarray, name: str) -> pa.ListArray:
    """Values and how often they occur, as a list of structs for each of ``rows``."""
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], [name, "n"]))


# --- the operator ------------------------------------------------------------

def score(docs: DataFrame, keep: list[str] | None = None, most_grams: int = MOST_GRAMS) -> DataFrame:
    """``docs`` with ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Reads ``doc_id`` and ``text``; ``score`` is that of the whole text, white space included.  Documents whose CRC-32 of the doc_id (as
    text; null counts as the empty text) is divisible by 10 are held out, all
    others train.  A null or empty text has the end mark alone.  ``keep`` names
    the columns to carry along (all, if not given); columns named like the
    results are replaced.  Repeated rows are scored alike (and train as often as
    they occur).  With no training text every word is unknown and every bit
    costs one bit; ``base_score`` is null then.  Words are told apart by 64-bit
    hashes.

    Frequent words and grams, a bounded number, are sent to the workers with
    their counts and scores; the rest of each document's words and grams meet
    the counts and the tree in joins and return as one number a document and a
    part of the tree.  ``most_grams`` changes what is sent, not the scores.
    """
    spark = docs.sparkSession
    names = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    carried = Carried(docs, keep, names)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    text = text_or_empty().cast("string")
    training = docs.where(~held_out).select(text.alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), training.rdd.getNumPartitions(), 1)
    grams, nodes, least = build_tree(training, parts, most_grams)
    above = spark.sparkContext.broadcast(nodes)
    model = spark.sparkContext.broadcast(frequent_logs(grams, parts, above, least))
    counts = stage(count_words(training), "ctw-words")
    ends = training.count()
    total, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    train_tokens, kinds = (total or 0) + ends, kinds + (ends > 0)
    frequent = counts.where(F.col("n") >= train_tokens * WORD_SHARE).orderBy("word").toArrow() if train_tokens else counts.limit(0).toArrow()
    known_words = frequent.column("word").to_numpy().view(np.uint64)
    order = np.argsort(known_words)
    words = spark.sparkContext.broadcast((known_words[order], frequent.column("n").to_numpy()[order]))
    base = train_tokens + ALPHA * (kinds + 1)

    def run(batches):
        frequent, (vocabulary, n_of) = model.value, words.value
        for batch in batches:
            texts, at = batch.column("ctw_text"), 0
            while at < batch.num_rows:
                group, size = [], 0
                while at + len(group) < batch.num_rows and size < BLOCK // 4:
                    group.append(lowered(texts[at + len(group)].as_py()))
                    size += len(group[-1]) + DEPTH
                keys, first = stream(group)
                words_of = [t.split() for t in group]
                slot = find(frequent, keys + U(1))
                sums = np.add.reduceat(np.where(slot >= 0, frequent["value"][slot], 0.0), first)
                missing = np.flatnonzero(slot < 0)
                open_ = listed(len(group), *counted(np.searchsorted(first, missing, "right") - 1, keys[missing]), "gram")
                n_words = np.fromiter(map(len, words_of), np.int64, len(group))
                h = hashes([w for x in words_of for w in x])
                doc = np.repeat(np.arange(len(group)), n_words)
                slot = np.searchsorted(vocabulary, h)
                slot[slot == len(vocabulary)] = 0
                hit = vocabulary[slot] == h if len(vocabulary) else np.zeros(len(h), bool)
                n = np.where(hit, n_of[slot], 0) if len(vocabulary) else np.zeros(len(h))
                part = np.where(hit, np.log10((n + ALPHA) / base), 0.0) if base else np.zeros(len(h))
                logs = np.bincount(doc, part, len(group)) + (np.log10((ends + ALPHA) / base) if base else 0.0)
                known = np.bincount(doc, hit, len(group)).astype(np.int64) + int(ends > 0)
                rare = listed(len(group), *counted(doc[~hit], h[~hit]), "word")
                rows = batch.slice(at, len(group))
                same = ["carried", "held_out", "doc_row"]
                yield pa.RecordBatch.from_arrays([*map(rows.column, same), pa.array(n_words + 1), pa.array(known), pa.array(logs), pa.array(sums), rare, open_], [*same, "n_tokens", "known", "base", "score", "rare", "open"])
                at += len(group)

    numbered = docs.select(carried.column, held_out.alias("held_out"), F.monotonically_increasing_id().alias("doc_row"), text.alias("ctw_text"))
    schema = carried.schema(SCORES)
    scored = stage(numbered.mapInArrow(run, schema), "ctw-scores")
    model.destroy()
    words.destroy()
    rest = scored.select("doc_row", F.explode("rare").alias("x")).select("doc_row", "x.word", F.col("x.n").alias("times"))
    met = rest.join(counts.where(F.col("n") < max(train_tokens * WORD_SHARE, 1e-9)), "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    by_word = met.select("doc_row", (F.col("times") * F.log10((c + ALPHA) / F.lit(float(base or 1)))).alias("more_base"), F.when(c > 0, F.col("times")).otherwise(0).alias("more_known"), F.lit(0.0).alias("more_score"))
    by_part = open_scores(scored, grams, parts, above).select("doc_row", F.lit(0.0).alias("more_base"), F.lit(0).cast("long").alias("more_known"), "more_score")
    more = by_word.unionByName(by_part).groupBy("doc_row").agg(*(F.sum(x).alias(x) for x in ("more_base", "more_known", "more_score")))
    out = scored.drop("rare", "open").join(more, "doc_row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    out = out.withColumn("base_score", F.when(F.lit(train_tokens > 0), F.col("base") + F.coalesce("more_base", F.lit(0.0))))
    out = out.withColumn("n_known", F.col("known") + F.coalesce("more_known", F.lit(0))).withColumn("train_tokens", F.lit(train_tokens).cast("long"))
    return out.select(*carried.fields(), *names)


def op2_query(spark, sf_dir):
    scored = score(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
