"""Quality rules with distribution divergence, in native expressions.

Fixed rules come first (too short, too repetitive).  Then a document's
histogram of character classes and its histogram of common words (all other
words are one bin) are compared
with references of its language by the Jensen-Shannon distance; a document far
from its language is rejected, unless it is too short to tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Carried, read_table, small_or_shuffled, stage, text_or_empty, words_of, whole_row
from .spans import bind

#: Common words of languages; any other language has none.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "this", "are", "or", "an", "from"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "pas", "avec"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
#: Classes of characters; what is in none of them is a class of its own.
CLASSES = {"lower": r"\p{Ll}\p{Lo}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "space": r"\x20\x09-\x0D", "stop": r".,;:'\"()?-"}

#: Documents that a language needs for references of its own.
LEAST_DOCUMENTS = 30
MOST_BROADCAST = 100_000
LEAST_WORDS = 50
MOST_REPEATED = 50
LEAST_CHARS = 200
LEAST_COUNTED = 100
MOST_CHAR_DISTANCE = 0.3
#: Read off the labels of sf0.1, see the README; a text without any common word is at 0.34 or so.
MOST_WORD_DISTANCE = 0.25


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, the first time included.

    Windows are compared by 64-bit hash.  Where all are distinct that is known
    without sorting; else window positions are sorted by hash, those with an
    equal neighbour are kept, and the words they cover are counted once each.
    """

    def count(b: Column) -> Column:
        w, n = b["w"], b["n"]
        windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def doubles(s: Column) -> Column:
            equal = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            return F.transform(F.filter(s, lambda x, j: equal(x, F.get(s, j - 1)) | equal(x, F.get(s, j + 1))), lambda x: x["i"])

        starts = F.sort_array(bind(placed, doubles))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
        return F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(F.struct(words.alias("w"), F.size(words).alias("n")), count)).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of the fixed rules, and the two histograms as arrays of counts."""
    text, lang = text_or_empty(), F.coalesce(F.col("lang").cast("string"), F.lit(""))
    out = docs.withColumn("q_words", words_of(text)).withColumn("q_text", text).withColumn("q_lang", lang)
    q = F.col("q_text")
    out = out.withColumn("n_words", F.size("q_words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("q_words", "")).cast("long"))
    out = out.withColumn("n_symbols", F.length(F.regexp_replace(q, r"[^#*$%&|<>]+", "")).cast("long"))
    out = out.withColumn("n_dup_lines", dup_lines(q)).withColumn("n_repeat_words", repeat_words(F.col("q_words")))
    classes = [F.length(F.regexp_replace(q, f"[^{c}]+", "")) for c in CLASSES.values()]
    out = out.withColumn("q_classes", F.array(*classes))
    out = out.withColumn("q_chars", F.concat("q_classes", F.array(F.length(q) - F.aggregate("q_classes", F.lit(0), lambda a, x: a + x))))
    none = F.array().cast("array<string>")
    common = F.coalesce(F.element_at(F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("q_lang")), none)
    lowered = F.split(F.lower(q), SPACE + "+", -1)
    found = lambda b: F.struct(F.filter(b["w"], lambda w: F.array_contains(b["c"], w)).alias("w"), b["c"].alias("c"))
    counts = lambda b: F.transform(b["c"], lambda c: F.size(b["w"]) - F.size(F.array_remove(b["w"], c)))
    others = lambda c: F.concat(c, F.array((F.col("n_words") - F.aggregate(c, F.lit(0), lambda a, x: a + x)).cast("int")))
    made = bind(bind(bind(F.struct(lowered.alias("w"), common.alias("c")), found), counts), others)
    return out.withColumn("q_common", made).drop("q_words", "q_text", "q_classes")


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, from 0 to 1) of an array of counts and an array of shares; null without counts."""

    def with_total(b: Column) -> Column:
        part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
        terms = F.zip_with(b["c"], b["r"], lambda c, r: bind(F.struct((c / b["n"]).alias("p"), ((c / b["n"] + r) / 2).alias("m")), lambda x: part(x["p"], x["m"]) + part(r, x["m"])))
        total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
        return F.when(b["n"] > 0, F.sqrt(F.greatest(total / 2, F.lit(0.0))))

    n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return bind(F.struct(counts.alias("c"), reference.alias("r"), n.alias("n")), with_total)


def references(rows: DataFrame) -> DataFrame:
    """``q_lang, r_chars, r_common``: of each language the shares of character classes and of common words.

    They are means over all its documents that pass the fixed rules.  Languages
    with fewer than ``LEAST_DOCUMENTS`` of these share the character classes of
    them all; common words are always a language's own.
    A row a language is written; nothing comes to the driver.
    """
    n_chars, n_common = len(CLASSES) + 1, len(COMMON["en"]) + 1
    each = lambda name, n: [F.coalesce(F.get(name, F.lit(i)), F.lit(0)) / F.greatest(F.col("n_words"), F.lit(1)) for i in range(n)]
    sums = lambda name, n: F.array(*(F.sum(x) for x in each(name, n)))
    passed = F.when(~F.col("base_failed"), F.lit(1)).otherwise(0)
    of = rows.withColumn("q_chars", F.when(passed == 1, F.col("q_chars"))).withColumn("q_common", F.when(passed == 1, F.col("q_common")))
    by = stage(of.groupBy("q_lang").agg(F.sum(passed).alias("n"), sums("q_chars", n_chars).alias("chars"), sums("q_common", n_common).alias("common")), "quality-sums")
    shares = lambda x: bind(F.struct(x.alias("v"), F.aggregate(x, F.lit(0.0), lambda a, y: a + y).alias("t")), lambda b: F.transform(b["v"], lambda y: y / F.when(b["t"] > 0, b["t"]).otherwise(1.0)))
    rare = F.col("n") < LEAST_DOCUMENTS
    pooled = by.where(rare).groupBy(rare.alias("rare")).agg(F.array(*(F.sum(F.get("chars", F.lit(i))) for i in range(n_chars))).alias("pool"))
    every = by.withColumn("rare", rare).join(F.broadcast(pooled), "rare", "left").withColumn("chars", F.coalesce("pool", "chars"))
    return every.select("q_lang", shares(F.col("chars")).alias("r_chars"), shares(F.col("common")).alias("r_common"))


FOUND = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, most_char_distance: float = MOST_CHAR_DISTANCE, most_word_distance: float = MOST_WORD_DISTANCE, least_chars: int = LEAST_CHARS, least_counted: int = LEAST_COUNTED, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``char_distance``, ``word_distance`` and ``kept``.

    Reads ``text`` and ``lang``; ``keep`` names the columns to carry along (all,
    if not given), of which those named like the results are replaced; any other
    name is the user's.  A null or empty text has no words and fails.  A null
    language is one of its own.  A language without a list of common words has no
    word distance, which rejects nothing.  The character distance counts from
    ``least_chars`` characters on, the word distance from ``least_counted`` words
    on, common or not.  Repeated rows are judged alike; empty tables give empty
    results.

    Texts are measured once; the measures are written to the shared folder, and
    references and verdicts come from there.  Nothing is shuffled but a row a
    task and language.
    """
    carried = Carried(docs, keep, [*FOUND, "base_failed", "char_distance", "word_distance", "kept"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = measured(docs.select(carried.column, F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    rows = stage(rows.select("carried", *FOUND, "q_lang", "q_chars", "q_common", failed.alias("base_failed")), "quality-measures")
    known = stage(references(rows.select("q_lang", "q_chars", "q_common", "n_words", "base_failed")), "quality-references")
    rows = rows.join(small_or_shuffled(known, MOST_BROADCAST), "q_lang", "left")
    rows = rows.withColumn("char_distance", distance(F.col("q_chars"), F.col("r_chars")))
    rows = rows.withColumn("word_distance", F.when(F.col("q_lang").isin(*COMMON), distance(F.col("q_common"), F.col("r_common"))))
    sized = F.aggregate("q_chars", F.lit(0), lambda a, x: a + x) >= least_chars
    counted = F.col("n_words") >= least_counted
    far = F.coalesce(sized & (F.col("char_distance") > most_char_distance), F.lit(False)) | F.coalesce(counted & (F.col("word_distance") > most_word_distance), F.lit(False))
    return rows.select(*carried.fields(), *FOUND, "base_failed", "char_distance", "word_distance", (~F.col("base_failed") & ~far).alias("kept"))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, columns as before, whatever their names."""
    whole = docs.select(whole_row(docs, "row"), "text", "lang")
    return judge(whole, keep=["row"], **options).where("kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op7_query(spark, sf_dir):
    judged = judge(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])
    return judged.select("doc_id", *FOUND, "base_failed", "kept")


_WORD = "[^\\x20\\x09-\\x0D]"
_NAMES = "[" + ", ".join(f"'{k}'" for k in COMMON) + "]"
_LISTS = "[" + ", ".join("[" + ", ".join(f"'{w}'" for w in v) + "]" for v in COMMON.values()) + "]"
_CHARS = ", ".join("length(regexp_replace(t, '[^" + c.replace("'", "''") + "]+', '', 'g'))" for c in CLASSES.values())
OP7_SQL = f"""
WITH a AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
b AS (SELECT *, regexp_extract_all(t, '{_WORD}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines,
    string_split_regex(lower(t), '[\\x20\\x09-\\x0D]+') AS low FROM a),
p AS (SELECT id, unnest(range(1, len(w) - 1)) AS i, w FROM b),
g AS (SELECT id, i, count(*) OVER (PARTITION BY id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT id, count(DISTINCT i + k) AS n FROM g CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY id),
m AS (SELECT b.id, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, length(t) AS size, [{_CHARS}] AS classes,
    list_transform(coalesce({_LISTS}[list_position({_NAMES}, lang)], []), lambda c: len(list_filter(low, lambda x: x = c))) AS counts
    FROM b LEFT JOIN r ON b.id = r.id),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m),
h AS (SELECT id, lang, base_failed, n_words, 'chars' AS kind, unnest(list_append(classes, size - list_sum(classes))) AS c, unnest(range(1, {len(CLASSES) + 2})) AS i FROM f
    UNION ALL SELECT id, lang, base_failed, n_words, 'common', unnest(list_append(counts, n_words - list_sum(counts))), unnest(range(1, {len(COMMON['en']) + 2})) FROM f WHERE len(counts) > 0),
k AS (SELECT lang, count(*) FILTER (NOT base_failed) AS n FROM f GROUP BY lang),
l AS (SELECT lang, CASE WHEN n < {LEAST_DOCUMENTS} THEN NULL ELSE lang END AS own FROM k),
z AS (SELECT id, h.lang, base_failed, n_words, kind, c, i, CASE WHEN kind = 'chars' THEN own ELSE h.lang END AS own FROM h JOIN l USING (lang)),
s AS (SELECT own, kind, i, sum(c::DOUBLE / greatest(n_words, 1)) FILTER (NOT base_failed) AS v FROM z GROUP BY own, kind, i),
q AS (SELECT own, kind, i, coalesce(v / nullif(sum(v) OVER (PARTITION BY own, kind), 0), 0) AS r FROM s),
n AS (SELECT id, kind, sum(c) AS total FROM h GROUP BY id, kind),
e AS (SELECT h.id, h.kind, total, c::DOUBLE / nullif(total, 0) AS p, coalesce(r, 0) AS r FROM z h JOIN n ON h.id = n.id AND h.kind = n.kind LEFT JOIN q ON h.own IS NOT DISTINCT FROM q.own AND h.kind = q.kind AND h.i = q.i),
j AS (SELECT id, kind, any_value(total) AS total, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + r) / 2)) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(r / ((p + r) / 2)) ELSE 0 END) / 2, 0)) AS d FROM e GROUP BY id, kind)
SELECT f.doc_id, CAST(f.n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(x.total >= {LEAST_CHARS} AND x.d > {MOST_CHAR_DISTANCE}, false) AND NOT coalesce(f.n_words >= {LEAST_COUNTED} AND y.d > {MOST_WORD_DISTANCE}, false) AS kept
FROM f LEFT JOIN j x ON f.id = x.id AND x.kind = 'chars' LEFT JOIN j y ON f.id = y.id AND y.kind = 'common'
"""
