"""Near duplicates of texts and vectors, components, and the pipeline: against brute force."""

import random
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from accesslens.llm import embeddings, graph, neardup


def partition(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)] + [(600, i) for i in range(601, 700)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = partition(700, edges)
    assert all(want[n] == r for n, r in got.items()) and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if w else set())
    return out


def brute(texts):
    s = sets(texts)
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])]
    return s, partition(len(s), links)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(150)]
    texts = [None, "", " \n", "One two", "one  TWO", "one two three four five", "ÀB c d e f"]
    texts += [" ".join(word() for _ in range(rng.randint(5, 300))) for _ in range(150)]
    for _ in range(80):  # passages that many share
        texts.append(" ".join(word() for _ in range(rng.randint(10, 80))) + " " + passage)
    texts += [" ".join(base)] * 5
    for _ in range(120):  # near copies of one original, near the bound on either side
        w = list(base)
        for _ in range(rng.randint(1, 7)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    for _ in range(40):  # chains
        w = texts[rng.randrange(7, 150)].split()
        texts.append(" ".join([word(), *w]))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(neardup, "MOST_BROADCAST", 0)
        monkeypatch.setattr(neardup, "BLOCK", 16)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_shingles string").repartition(5)
    s, want = brute(texts)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(x) for i, x in enumerate(s)}
    assert {i: r["component_id"] for i, r in got.items()} == dict(enumerate(want))
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert sorted(r["doc_id"] for r in neardup.deduplicated(docs).collect()) == sorted(set(want))


def test_pages_around_a_template(spark, monkeypatch):
    """Texts that share a template of three, five, six or seven eighths: linked as by brute force, and compared only where the template may link."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    texts = []
    for eighths in (5, 6, 7):
        template = [word() for _ in range(20 * eighths)]
        texts += [" ".join([*template, *(word() for _ in range(160 - 20 * eighths + rng.randint(0, 3)))]) for _ in range(40)]
    texts += [" ".join(template)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    _, want = brute(texts)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == dict(enumerate(want))
    rows = spark.createDataFrame([(i, len(s), i, True) for i, s in enumerate(sets(texts)[:40])], "row long, n long, part long, open boolean")
    held = spark.createDataFrame([(i, sorted(hash(x) for x in s)) for i, s in enumerate(sets(texts)[:40])], "row long, set array<long>")
    assert not neardup.prefixes(rows, held).where("index").count()  # five eighths link nothing: no list has an index member


def test_prefixes_are_exact(spark):
    """Every pair of sets that reaches the similarity shares one of the smaller's index values among the larger's listed ones."""
    rng = random.Random(3)
    base = rng.sample(range(10_000), 90)
    made = []
    for _ in range(60):
        s = set(rng.sample(base, rng.randint(50, 90))) | set(rng.sample(range(10_000), rng.randint(0, 12)))
        made.append(sorted(s))
    frame = spark.createDataFrame(list(enumerate(made)), "row long, set array<long>")
    rows = spark.createDataFrame([(i, len(s), i, True) for i, s in enumerate(made)], "row long, n long, part long, open boolean")
    listed: dict[int, dict[int, bool]] = {}
    for r in neardup.prefixes(rows, frame).collect():
        listed.setdefault(r["row"], {})[r["value"]] = r["index"]
    linked = 0
    for i, x in enumerate(made):
        for j, y in enumerate(made):
            both = len(set(x) & set(y))
            if i != j and len(x) <= len(y) and 100 * both >= 75 * (len(x) + len(y) - both):
                linked += 1
                assert any(index and v in listed[j] for v, index in listed[i].items())
    assert linked > 50


def test_near_duplicate_edges(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"], r["n_shingles"]) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 3, True, 2), (3, 3, True, 2), (None, 3, False, 2), (None, None, False, 2), (7, 7, True, 0)], key=str)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_deduplicated_keeps_one_row(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, "a b c d e f", 1), (3, "a b c d e f", 1), (None, "a b c d e f", 1), (None, "q r s t u v", 1), (7, None, 1), (7, None, 1)]
    rows += [(4, long, 1), (4, long + " tail", 1), (None, "g h i j k l", 1), (None, "g h i j k l", 2), (None, "g h i j k  L", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x long")
    got = [(r["doc_id"], (r["text"] or "").lower().split()[:1]) for r in neardup.deduplicated(docs).collect()]
    assert sorted(got, key=str) == sorted([(3, ["a"]), (None, ["q"]), (7, []), (7, []), (4, ["w0"]), (None, ["g"])], key=str)


def test_near_duplicates_leave_only_what_results_read(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    rng = random.Random(4)
    words = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(12)]
    texts = [" ".join(w[: 60 - i]) for w in words for i in (0, 1, 2)] + [None, "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = {p.name for p in shared.iterdir()}
    for function, rows in ((neardup.near_duplicates, 38), (neardup.deduplicated, 14)):
        found = function(docs)
        left = {p.name for p in shared.iterdir()} - before
        assert left == {Path(f).parent.name for f in found.inputFiles()} and found.count() == rows
        before |= left


def test_estimates():
    rng = np.random.default_rng(0)
    pool = rng.choice(1 << 40, 5000, replace=False)
    for share in (0.5, 0.7, 0.75, 0.8, 0.95):
        both = int(2000 * share / (1 + share) * 2 / 2)
        a, b = np.sort(pool[:2000]), np.sort(pool[2000 - 2 * both + both : 4000 - both])
        common = len(np.intersect1d(a[:128], b[:128]))
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ok = neardup.possible(a[:128], len(a), neardup.padded([b[:128]]), np.array([len(b)]), np.array([common]))[0]
        assert ok or truth < 0.75
    small = np.arange(100)
    assert not neardup.possible(small, 100, neardup.padded([np.arange(30, 130)]), np.array([100]), np.array([70]))[0]


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    rows = [centres[rng.integers(40)] * rng.uniform(0.5, 3) + rng.normal(size=32) * rng.choice([0.02, 0.2, 0.35]) for _ in range(500)]
    rows += [centres[0] + rng.normal(size=32) * 0.05 for _ in range(150)] + [centres[1]] * 20 + list(rng.normal(size=(150, 32)))
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [1.0] * 31 + [None], [float("inf")] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0]]
    frame = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(rows)] + [(1000 + i, r, 1) for i, r in enumerate(odd)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    got = {r["vec_id"]: r for r in embeddings.link(frame).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (links <= hit.sum(1)).all() and links.sum() >= 0.95 * hit.sum()
    want = partition(len(rows), [(int(a), int(b)) for a, b in np.argwhere(hit)])
    assert sum(got[i]["component_id"] != want[i] for i in range(len(rows))) <= 0.05 * len(rows)
    assert [(got[1000 + i]["n_links"], got[1000 + i]["component_id"], got[1000 + i]["kept"]) for i in range(8)] == [(0, 1000 + i, True) for i in range(6)] + [(1, 1006, True), (1, 1006, False)]
    assert embeddings.link(frame.limit(0)).count() == 0


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MOST_IN_BUCKET", 2)
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    x = np.array([centre + rng.normal(size=16) * 0.35 for _ in range(120)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum() - len(x)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = sum(r["n_links"] for r in embeddings.link(rows).collect())
    assert 0.9 * true <= got <= true


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: rng.choice("the of and to in is that for it as".split()) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() for _ in range(120)) for _ in range(60)]
    texts += [texts[0] + " tail", texts[1], "### $$$ " * 200, "short", None, texts[2] + " bob.x@mail.example.com"]
    docs = spark.createDataFrame([(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for name, function in corpus_pipeline.STAGES:
        before, now = now, function(spark, now, str(tmp_path))
        ids = [r["doc_id"] for r in now.select("doc_id").collect()]
        if name == "quality_rules":
            assert set(ids) == {*range(62), 65}
        if name == "near_duplicates":
            assert set(ids) == set(range(60))
        if name != "encoding":
            assert now.columns == before.columns
        if name == "personal_data":
            assert not [r for r in now.collect() if "@" in r["text"]]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= set(range(60))
    empty = docs.limit(0)
    for _, function in corpus_pipeline.STAGES:
        empty = function(spark, empty, str(tmp_path))
        assert empty.count() == 0
