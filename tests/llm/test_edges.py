"""What all operators promise: further columns of any name, nulls, repeated rows, empty tables."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from accesslens.llm import bpe, ctw, embeddings, html_text, mixing, neardup, pii, quality, secret_scan, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Names that operators use inside, or did, and awkward ones.
NAMES = (
    "pii_row pii_text mentions more found runs at t before q_text q_words q_lang q_chars q_common q_classes r_chars n rare mix_hash mix_source mix_base mix_cut h s size base cut need"
    " bpe_text known open doc_row ctw_text more_base more_known more_score part page_html row key1 key2 nd_text nd_key1 nd_key2 nd_row nd_best doc unit dim ball bucket position value carried none a.b `x Html"
).split()


def prose(seed: int, n: int = 110) -> str:
    rng = random.Random(seed)
    odd = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    return " ".join(rng.choice(quality.COMMON["en"]) if rng.random() < 0.4 else odd() for _ in range(n)) + " "


TEXTS = [None, "", " \n", prose(1) + "bob.x@mail.example.com", prose(1) + "bob.x@mail.example.com", prose(2) + "password = hunter22x " + prose(3, 20), "one two", "x" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, TEXTS[5], None, None), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.select("*", *(F.concat(F.lit(n), F.coalesce("doc_id", F.lit(-1)).cast("string")).alias(n) for n in NAMES)).cache()


OPERATORS = {
    "pii": lambda d: pii.find_pii(d),
    "ctw": lambda d: ctw.score(d),
    "secrets": lambda d: secret_scan.find_secrets(d),
    "mixing": lambda d: mixing.mix(d),
    "bpe": lambda d: bpe.encode(d, PATH, with_ids=True),
    "quality": lambda d: quality.judge(d),
}
FILTERS = {"redacted": pii.redacted, "mixed": mixing.mixed_documents, "kept": quality.kept_documents, "deduplicated": neardup.deduplicated}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_and_repeats(docs, name):
    out = OPERATORS[name](docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = [r.asDict() for r in out.collect()]
    key = lambda r: repr([r[c] for c in docs.columns])
    assert sorted(map(key, got)) == sorted(key(r.asDict()) for r in docs.collect())
    by: dict[str, dict] = {}
    for r in got:
        first = by.setdefault(key(r), r)
        assert all(first[c] == r[c] or first[c] == pytest.approx(r[c]) for c in out.columns[len(docs.columns) :])
    assert OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(docs, name):
    out = FILTERS[name](docs)
    assert out.dtypes == docs.dtypes
    rows = {(r["doc_id"], *(r[n] for n in NAMES)) for r in out.collect()}
    assert rows <= {(r["doc_id"], *(r[n] for n in NAMES)) for r in docs.collect()} and rows


def test_result_names_are_replaced(docs):
    clash = docs.select("doc_id", "text", "lang", F.lit(1).alias("N_Words"), F.lit("x").alias("kept"))
    out = quality.judge(clash)
    assert out.columns.count("kept") == 1 and [c for c in out.columns if c.lower() == "n_words"] == ["n_words"]


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "u", "<p>" + prose(4)), (1, "u", "<p>" + prose(4)), (None, None, None), (2, "u", "")], "page_id long, url string, html string")
    pages = pages.select("*", *(F.lit(n).alias(n) for n in NAMES if n != "Html"))
    got = html_text.extract(pages)
    assert got.columns == [*pages.columns, "text", "n_chars"] and sorted(r["n_chars"] for r in got.collect()) == [0, 0, *[len(prose(4).strip())] * 2]
    assert html_text.extract(pages.limit(0)).count() == 0
    assert warc.archive_pages(pages)[0].count() == 4
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.1]), (4, None)], "vec_id long, embedding array<double>")
    rows = embeddings.link(vectors.select("*", *(F.lit(n).alias(n) for n in NAMES))).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in rows) == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (4, 0, 4, True)]


def test_pipeline_loses_nothing(spark, docs, tmp_path):
    """Null ids, repeated rows and further columns: one row of each group of copies comes through, then the mix."""
    path = str(tmp_path)
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    kept = {}
    now = spark.read.parquet(f"{path}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:3]:
        now = function(spark, now, path)
        kept[name] = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["Html"]) for r in now.collect())
    assert kept["quality_rules"] == [(-1, "Html-1"), (3, "Html3"), (3, "Html3"), (3, "Html3"), (4, "Html4"), (5, "Html5")]
    assert kept["near_duplicates"] == kept["personal_data"] == [(3, "Html3"), (5, "Html5")]
    assert all("@" not in r["text"] for r in now.collect())
