"""BPE, language model, WARC, HTML: round trips, the tokenizers library, held-out texts, cases."""

import hashlib
import os
import random
import subprocess
import sys
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from accesslens.llm import bpe, ctw, html_text, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def test_lexicon(vocabulary):
    rng = random.Random(2)
    words = sorted({" " + "".join(rng.choice("aehtnorisdé") for _ in range(rng.randint(0, 9))) for _ in range(3000)})
    entries = list(zip([w.encode() for w in words], vocabulary.word_ids(words), strict=True))
    lexicon = bpe.Lexicon(bpe.build_lexicon(entries))
    assert lexicon.get([w for w, _ in entries]) == [i for _, i in entries]
    assert lexicon.get([b"", b" zzzz", b"a"]) == [None] * 3
    assert bpe.Lexicon(bpe.build_lexicon([])).get([b"x"]) == [None]


def test_automaton_is_minimal(vocabulary):
    words = sorted(f"{a}{b}ing".encode() for a in "abcdefgh" for b in "xyz")
    data = np.frombuffer(bpe.build_lexicon([(w, [1]) for w in words]), "<i4")
    assert data[0] == 6 and data[1] == 8 + 3 + 3  # one state for each suffix class


def test_encoder_equals_library(vocabulary, tokenizer):
    rng = random.Random(4)
    enc = bpe.Encoder(vocabulary, bpe.Lexicon(bpe.build_lexicon([(b" the", vocabulary.word_ids([" the"])[0])])))
    letters = [*"ab é\n\t   'sté1２　\x1c\x85🙂_-.,!?\0", "<|endoftext|>", "'ll", " re", "\r\n", "the ", "  "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["a" * 3000, " the the\nthe"]
    for text, (ids, decoded) in zip(texts, enc.encode(texts), strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want)), text
        assert decoded.decode("utf-8", "replace") == tokenizer.decode(want, skip_special_tokens=False)


def test_odd_white_space_and_long_pieces(vocabulary, tokenizer):
    """Texts with any white space are cut, and cut exactly; pieces of any length merge as the library does."""
    rng = random.Random(5)
    space = ["  ", "\n\n", "\t", "\xa0", "\r\n", "\u3000", " \n ", "\x1c", "\u200b", "\ufeff", "\x85", "\0", " "]
    words = ["the", "don't", "1234", "été", "😀", "...", "x", "<|endoftext|>", "漢字"]
    texts = ["".join(rng.choice(rng.choice([space, words])) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["".join(rng.choice("ACGT") for _ in range(20_000)), "a" * 30_000, "漢字仮名" * 4000, "ab " * 40 + "\n\n" + "z" * 5000, "\n" * 5000]
    enc = bpe.Encoder(vocabulary, bpe.Lexicon(bpe.build_lexicon([])))
    for text, (ids, _) in zip(texts, enc.encode(texts), strict=True):
        assert ids == ",".join(map(str, tokenizer.encode(text, add_special_tokens=False).ids)), text[:80]
    assert all(len(bpe.cut_words(t)) == 3 for t in ("a\n\nb\tc", "a  b\xa0c"))
    for piece in [bytes(rng.choice(b"etaoinshr") for _ in range(rng.randint(65, 300))) for _ in range(50)]:
        assert vocabulary.merge_long(piece) == tokenizer.encode(piece.decode(), add_special_tokens=False).ids


def test_plain_words_are_cut_together(vocabulary, tokenizer, monkeypatch):
    """Words of letters, digits and symbols don't go to the tokenizer's cutter one by one, and equal pieces merge once."""
    rng = random.Random(6)
    letters = [*"abstmdrevlABé'0123456789!#%&*-.,?_|~\u2019\u2026", "'ll", "'s", "the"]
    words = list({rng.choice(" \n") + "".join(rng.choices(letters, k=rng.randint(1, 8))) for _ in range(20_000)})
    assert all(bpe.PLAIN.fullmatch(w) and [p.encode() for p in bpe.PIECE.findall(w)] == vocabulary.pieces(w) for w in words)
    words += [" zqthe" + "#" * i for i in range(9)] + [" zqthe" + "%" * i for i in range(1, 9)] + ["odd", " \u6f22\u5b57", " \xb2"]
    merge, pieces, merged, cut = bpe.Vocabulary.merge, bpe.Vocabulary.pieces, [], []
    monkeypatch.setattr(bpe.Vocabulary, "merge", lambda self, x: merged.extend(x) or merge(self, x))
    monkeypatch.setattr(bpe.Vocabulary, "pieces", lambda self, w: cut.append(w) or pieces(self, w))
    assert vocabulary.word_ids(words) == [e.ids for e in tokenizer.encode_batch(words, add_special_tokens=False)]
    assert len(merged) == len(set(merged)) and cut == words[-3:]
    assert vocabulary.word_ids([]) == []


def test_table():
    """Every key is found at its place, others are not; also with one or no key."""
    keys = np.random.default_rng(1).permutation(np.unique(np.random.default_rng(2).integers(0, 1 << 40, 50_000)))
    for n in (0, 1, len(keys)):
        table = bpe.Table(keys[:n])
        assert (table.find(keys[:n]) == np.arange(n)).all()
        assert (table.find(np.array([-1, -(1 << 32), 1 << 41, (7 << 32) - 1 | 1 << 50])) == n).all()


def test_words_that_decode_differently(vocabulary):
    """What ids decode to comes from the ids: a wrong entry of the lexicon shows, in its words alone."""
    enc = bpe.Encoder(vocabulary, bpe.Lexicon(bpe.build_lexicon([(b" cat", vocabulary.word_ids([" dog"])[0]), (b" xy", vocabulary.word_ids([" yxz"])[0])])))
    assert [d for _, d in enc.encode(["a cat is xy", "dog"])] == [b"a dog is yxz", b"dog"]


def test_a_million_letters(vocabulary, tokenizer):
    piece = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    enc = bpe.Encoder(vocabulary, bpe.Lexicon(bpe.build_lexicon([])))
    (ids, decoded), _ = enc.encode([piece, "short"])
    assert ids == ",".join(map(str, tokenizer.encode(piece, add_special_tokens=False).ids)) and decoded == piece.encode()
    enc.encode(["next"])
    enc.held = bpe.REMEMBERED
    enc.encode(["one more"])
    assert len(enc.ids) == 3 and enc.held < 10_000  # all else is forgotten; the special token stays known


WORKER = """
import random, re, sys
import pyarrow as pa
from accesslens.llm import bpe

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng = random.Random(3)
texts = pa.array([" ".join("".join(rng.choices("etaoinshr", k=8)) for _ in range(1000)) for _ in range(330)])
with open(sys.argv[1], encoding="utf-8") as f:
    spec = f.read()
start = held()
enc = bpe._encoder(spec, bpe.build_lexicon([]))
peak = held() - start
for group in bpe.groups(texts):
    enc.encode(group)
    peak = max(peak, held() - start)
print(peak)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_memory_of_an_encoding_worker():
    """Vocabulary, words and groups of a worker stay small over 330,000 distinct words; they took 130 MB, and take 75."""
    code = subprocess.run([sys.executable, "-c", WORKER, PATH], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert float(code.stdout) < 100


PIPELINE_WORKER = (
    WORKER.replace("import bpe\n", "import bpe\nfrom corpus_pipeline import REMEMBERED\n")
    .replace("bpe.build_lexicon([]))", "bpe.build_lexicon([]), REMEMBERED)")
    .replace("bpe.groups(texts)", "bpe.groups(texts, REMEMBERED // bpe.ROOM)")
)


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_memory_of_the_pipelines_encoding_worker():
    """As above with the pipeline's bound, which also makes groups small; they took 42 MB, and take 21."""
    code = subprocess.run([sys.executable, "-c", PIPELINE_WORKER, PATH], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert float(code.stdout) < 32


def test_the_pipelines_batches_are_bounded(spark):
    """Long rows go to Python workers a few at a time, in the stages whose workers get texts or whole sets."""
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(400, numPartitions=1).selectExpr("id AS doc_id", "repeat('long row ', 9000) AS text")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.encoding):
        spark.conf.unset(key)
        stage(spark, docs.limit(0), "")
        try:
            got = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
        finally:
            spark.conf.unset(key)
        assert sum(got) > 5 * corpus_pipeline.BATCH and max(got) < corpus_pipeline.BATCH + (1 << 20)


def test_counting_words_in_little_memory(spark):
    """However few words a worker may hold, all are counted."""
    texts = ["a b a c", "b a", None, "a  b\tc"]
    want = {r["word"]: r["n"] for r in bpe.count_corpus_words(documents(spark, texts)).collect()}
    assert {r["word"]: r["n"] for r in bpe.count_corpus_words(documents(spark, texts), remembered=1).collect()} == want and sum(want.values()) == 9


def test_unsupported_tokenizers():
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": spec["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(spec | change))


def test_encode(spark, tokenizer):
    texts = [None, "", "The cat.\nThe dog", "  odd\tspace ", "naïve café <|endoftext|> x"] * 3
    got = {r["doc_id"]: r for r in bpe.encode(documents(spark, texts), PATH, with_ids=True, least_share=0.01).collect()}
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(documents(spark, texts).limit(0), PATH).count() == 0


def test_log_kt():
    from math import lgamma, pi

    for a, b in ((0, 0), (1, 0), (5, 7), (5000, 3), (10**7, 10**6)):
        want = lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - np.log(pi)
        assert ctw.log_kt(np.array([float(a)]), np.array([float(b)]))[0] == pytest.approx(want, rel=1e-9, abs=1e-9)


def brute_ctw(grams):
    """log10 of a byte after its context: the weighted probability of the training bits with it, over that without it.

    Whole trees, from the definition: nothing is stored but counts.
    """
    from math import lgamma, log, pi

    trees: dict[int, dict[tuple, list[int]]] = {}

    def bits(g):
        byte, context = g & 255, tuple((g >> (8 * (ctw.DEPTH - i))) & 255 for i in range(ctw.DEPTH))
        return [((1 << level) | (byte >> (8 - level)), (byte >> (7 - level)) & 1, context) for level in range(8)]

    for g in grams.tolist():
        for index, bit, context in bits(g):
            for d in range(ctw.DEPTH + 1):
                trees.setdefault(index, {}).setdefault(context[:d], [0, 0])[bit] += 1
    children: dict[int, dict[tuple, set]] = {i: {} for i in trees}
    for i, tree in trees.items():
        for c in tree:
            if c:
                children[i].setdefault(c[:-1], set()).add(c)
    cache: dict[tuple, float] = {}

    def kt(z, o):
        return lgamma(z + 0.5) + lgamma(o + 0.5) - lgamma(z + o + 1) - log(pi)

    def weighted(i, c):
        if (i, c) not in cache:
            own = kt(*trees[i][c])
            cache[i, c] = own if len(c) == ctw.DEPTH else np.logaddexp(own, sum(weighted(i, x) for x in children[i][c])) - log(2)
        return cache[i, c]

    def with_bit(i, c, context, bit):
        z, o = trees.get(i, {}).get(c, (0, 0))
        own = kt(z + (bit == 0), o + (bit == 1))
        if len(c) == ctw.DEPTH:
            return own
        below = context[: len(c) + 1]
        others = sum(weighted(i, x) for x in children.get(i, {}).get(c, ()) if x != below)
        return np.logaddexp(own, others + with_bit(i, below, context, bit)) - log(2)

    return lambda g: sum(with_bit(i, (), c, b) - (weighted(i, ()) if i in trees else 0.0) for i, b, c in bits(g)) / log(10)


def test_ctw_equals_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat", "é"]) for _ in range(12)) for _ in range(20)]
    frame = documents(spark, texts).select("text")
    model = ctw.train(frame, 3, least_share=0.0)
    grams, _ = ctw.stream([ctw.lowered(t) for t in texts])
    new, _ = ctw.stream([b"the dog sat", b""])
    log10 = brute_ctw(grams)
    probe = np.concatenate([grams[:60], new])
    assert ctw.log10_of(model, probe) == pytest.approx([log10(int(g)) for g in probe], rel=1e-6)


def test_ctw_holds_a_stretch_of_nodes_at_a_time():
    """A part's scores and what it hands up are those of its whole tree, with a fraction of its memory, also where one context has most of the grams."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) + "the" for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 300)).encode() for _ in range(40)]
    keys = np.sort(ctw.stream(texts)[0])
    start = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    keys, counts = keys[start], np.diff(start, append=len(keys)).astype(np.uint64)
    nodes, _, _ = ctw.build_nodes(*ctw.shortened(keys, counts, ctw.TOP - 1), ctw.TOP - 1, 0, ctw.handed_up(keys, counts, ctw.TOP))
    above = [np.concatenate(x) for x in zip(*(n[:3] for n in nodes))]
    order = np.argsort(above[0])
    above = tuple(x[order] for x in above)
    asked = np.unique(np.concatenate([keys, keys[::5] ^ ctw.U(5), keys[::5] ^ ctw.U(1 << 8), keys[::5] ^ ctw.U(1 << 20)]))

    def peak(f):
        tracemalloc.start()
        got = f()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got, most

    whole, large = peak(lambda: ctw.log10_of(ctw.part_model(keys, counts, above, asked), asked))
    _, up, logs = ctw.build_nodes(keys, counts, ctw.DEPTH, ctw.TOP)
    for most in (200, 1000):
        got, small = peak(lambda: ctw.part_logs(keys, counts, above, asked, most=most))
        assert got == pytest.approx(whole, rel=1e-9)
        assert small < large / 2
        k, x = ctw.handed_up(keys, counts, ctw.TOP, most)
        assert np.array_equal(k, up) and x == pytest.approx(logs, rel=1e-9)
    assert max(np.unique(keys >> ctw.U(32), return_counts=True)[1]) > 200
    none = keys[:0]
    assert len(ctw.part_logs(keys, counts, above, none)) == 0
    assert ctw.part_logs(none, counts[:0], above, asked) == pytest.approx(ctw.log10_of(ctw.part_model(none, counts[:0], above, asked), asked))


def test_ctw_stays_finite():
    """Contexts with very many equal visits: what never came after them stays possible."""
    grams = np.array([ctw.stream([b"aaaaaa"])[0][-2], ctw.stream([b"bbbbbb"])[0][-2]])
    for n in (10**8, 10**14):
        counts = np.array([n, n], np.uint64)
        order = np.argsort(grams)
        nodes, _, _ = ctw.build_nodes(grams[order], counts, ctw.DEPTH, 0)
        key, odds, w, _ = (np.concatenate(x) for x in zip(*nodes))
        model = ctw.hash_table(key, ctw.mixtures(key, odds, w))
        seen, other = grams[0], grams[0] ^ ctw.U(1)
        logs = ctw.log10_of(model, np.array([seen, other]))
        assert np.isfinite(logs).all() and logs[0] > -1e-6 and -2 * np.log10(n) < logs[1] < -0.5 * np.log10(n)


def test_score(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    texts = [None, "", *(" ".join(rng.choice(words[: rng.choice([5, 20, 60])]) for _ in range(40)) for _ in range(400)), "zzz QQQ zzz"]
    got = {r["doc_id"]: r for r in ctw.score(documents(spark, texts)).collect()}
    tokens = [ctw.lowered(t or "").split() for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    count: dict[bytes, int] = {}
    ends = 0
    for t, h in zip(tokens, held, strict=True):
        if not h:
            ends += 1
            for w in t:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()) + ends, len(count) + 1
    for i, t in enumerate(tokens):
        want = sum(np.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t) + np.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t) + 1, sum(w in count for w in t) + 1, n)
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["score"] < 0
    out = [i for i in range(2, len(texts) - 1) if held[i]]
    assert sum(got[i]["score"] for i in out) / sum(len(b" ".join(tokens[i])) + 1 for i in out) > -0.75  # under 2.5 bits a byte
    assert ctw.score(documents(spark, texts).limit(0)).count() == 0


def test_score_equals_brute_force(spark):
    """The query's own path, frequent grams sent or all of them joined; white space counts as it is."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh\0") for _ in range(rng.randint(2, 7))) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(15)) for _ in range(40)] + ["zz zyx  unseen\n~~~\t"] * 4 + [None, ""]
    docs = documents(spark, texts)
    raw = [ctw.lowered(t or "") for t in texts]
    log10 = brute_ctw(ctw.stream([t for i, t in enumerate(raw) if zlib.crc32(str(i).encode()) % 10])[0])
    for most in (0, 50):
        got = {r["doc_id"]: r["score"] for r in ctw.score(docs, ["doc_id"], most).collect()}
        for i, t in enumerate(raw):
            assert got[i] == pytest.approx(sum(log10(int(g)) for g in ctw.stream([t])[0]), rel=1e-6)


def test_pack():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 56, 1000).astype(np.uint64))
    k, c = ctw.unpack(ctw.pack(keys, np.arange(len(keys), dtype=np.uint64)))
    assert (k == keys).all() and (c == np.arange(len(keys))).all()


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, archive string")


def test_warc(spark):
    big, other = "é" * 700, "b" * 1500
    rows = [(1, "http://a/1", big), (5, None, big), (3, "u\r\nX: y", big), (4, "", "small"), (6, "http://a/6", "small"), (7, "http://a/7", None), (8, "http://a/8", ""), (9, "http://a/9", other), (9, "http://a/9", other), (None, "n", big), (10, "x", "\r\n\r\nWARC/1.1\r\n" * 90)]
    got, folder = warc.archive_pages(pages(spark, rows))
    out = sorted(((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()), key=str)
    want = []
    for page, url, html in rows:
        data = (html or "").encode()
        refers = 5 if html == big and page != 5 else None
        want.append((page, url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers))
    assert out == sorted(want, key=str)
    assert warc.archive_pages(pages(spark, rows).limit(0))[0].count() == 0


def test_warc_files(spark):
    rows = [(i, f"http://a/{i}", f"page {i} " * 50) for i in range(18)]
    _, folder = warc.archive_pages(pages(spark, [*rows, (30, "http://a/30", "page x " * 300), (31, "http://a/31", "page x " * 300)]).coalesce(1))
    fs, root = warc._open(folder)
    import struct

    import pyarrow.fs as pafs

    [name] = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".gz")]
    data = fs.open_input_file(name).read()
    index = list(struct.iter_unpack("<QQ", fs.open_input_file(name + ".idx").read()))
    assert len(index) == 20 and sum(n for _, n in index) == len(data)
    for offset, n in index:  # each member stands alone
        [(head, block)] = warc.Records(pa.BufferReader(data[offset : offset + n]))
        assert (head["WARC-Type"], block.decode()[:5]) == (("revisit", "") if head["X-Page-Id"] == "30" else ("response", "page "))
    heads = [head for head, _ in warc.Records(pa.BufferReader(data))]  # and all are one stream
    ids = {head["WARC-Record-ID"]: head["X-Page-Id"] for head in heads}
    assert len(heads) == len(ids) == 20 and [ids[head["WARC-Refers-To"]] for head in heads if "WARC-Refers-To" in head] == ["31"]


FILL = "The quick brown fox jumps over the lazy dog again and again in this long sentence. "
PAGES = [
    ("<html><body><nav><a href=/>Home</a><a href=/x>X</a></nav><article><h1>Title</h1><p>" + FILL * 4 + "</p><p>Short &amp; sweet.</p></article><footer>Foot</footer></body></html>", "Title\n\n" + (FILL * 4).strip() + "\n\nShort & sweet."),
    ("<body><div class='menu main'><ul><li><a>One</a><li><a>Two</a></ul></div><div id=content><p>" + FILL * 3 + "<p>" + FILL * 2 + "<p>End</div><div class='comments'><p>" + FILL * 9 + "</p></div><div class=sidebar>" + FILL + "</div></body>", (FILL * 3).strip() + "\n\n" + (FILL * 2).strip() + "\n\nEnd"),
    ("<main><p>a&nbsp;b\n\n c<br>d <!-- no --> e" + FILL + "<script>var x='<p>';</script><p>2</main>", "a b c d e" + FILL.strip() + "\n\n2"),
    ("<div><header>Site</header><div><section><h2>Head</h2><p>" + FILL * 5 + "</p></section></div></div>", "Head\n\n" + (FILL * 5).strip()),
    ("no markup at all", "no markup at all"), ("", ""), (None, ""), ("   ", ""), ("<p", ""), ("<style>p{}</style>", ""), ("<article><p>ok<p>cut<foot", "ok\n\ncut"),
]


BODY = f"<h1>Title</h1><p>{FILL * 3}</p><p>{FILL * 2}</p>"
WHOLE = "Title\n\n" + (FILL * 3).strip() + "\n\n" + (FILL * 2).strip()
NAV = "<ul><li><a href=/a>Start page</a><li><a href=/b>About us</a></ul>"
#: Pages whose article stands in an element that looks like furniture, or beside some.
PAGES += [
    (f"<body><form id=aspnetForm><div>{NAV}</div><div id=main>{BODY}</div></form></body>", WHOLE),
    (f"<body><div class='content has-sidebar'>{BODY}</div><div class=sidebar>{FILL}</div></body>", WHOLE),
    (f"<body><div class='elementor-widget-container'>{BODY}</div></body>", WHOLE),
    (f"<body><div class='entry no-comments'>{BODY}</div><div class=post-comments><p>{FILL * 8}</p></div></body>", WHOLE),
    (f"<body><article><div class=entry-header><h1>Title</h1></div><p>{FILL * 3}</p><p>{FILL * 2}</p></article></body>", WHOLE),
    (f"<body><header><div>{BODY}</div></header></body>", WHOLE),
    (f"<body><div id=page style='display: none'>{BODY}</div><div class=cookie-banner>We use cookies. {FILL}</div></body>", WHOLE),
    (f"<body><div class=site-header><p>My site</p></div><div>{BODY}</div><div id=related-posts><p>{FILL}</p></div><footer><p>{FILL}</p></footer></body>", WHOLE),
    (f"<body><article>{BODY}<aside>{FILL}</aside><form><label>Mail</label><input></form></article><section id=comments><p>{FILL * 9}</p></section></body>", WHOLE),
    (f"<body><article><p>Brief.</p></article><div class=sidebar>{FILL * 3}</div><footer>{FILL * 3}</footer></body>", "Brief."),
    (f"<body><form><div class=sidebar>{FILL}</div>{BODY}<div class=comments>{FILL * 9}</div></form><footer>{FILL}</footer></body>", WHOLE),
    (f"<body><nav>{NAV}</nav><main>{BODY}</main><div role=complementary><p>{FILL}</p></div></body>", WHOLE),
]


def brute_density(node, root):
    """A node's composite density from the definition, its text gathered anew."""
    import math

    def count(x, in_link):
        c = t = lc = lt = 0
        link = in_link or x.name == "a"
        for y in x.parts:
            if isinstance(y, str):
                n = len(y) - y.count(" ") if y.isspace() else len(y)
                c, lc = c + n, lc + n * link
            elif not y.off:
                a, b, d, e = count(y, link)
                c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e
        return c, t, lc, t + 1 if x.name == "a" else lt

    c, t, lc, lt = count(node, False)
    whole = count(root, False)
    if not c:
        return 0.0
    text = max(c - lc, 1)
    lc, lt, t = max(lc, 1), max(lt, 1), max(t, 1)
    base = math.log(c / text * lc + whole[2] / max(whole[0], 1) * c + math.e)
    return c / t * max(math.log(max(c / lc * t / lt, 1)), 0) / math.log(base) if base > 1 else 0.0


@pytest.mark.parametrize("page", [p for p, t in PAGES if p and t and "<br" not in p])
def test_densities(page):
    root = html_text.parse(page)
    html_text.switch_off(root)
    order = html_text.measure(root)
    for node in order:
        assert node.density == pytest.approx(brute_density(node, root))
        assert node.total == pytest.approx(sum(brute_density(x, root) for x in node.parts if not isinstance(x, str) and not x.off))


@pytest.mark.parametrize("page,text", PAGES)
def test_html(page, text):
    assert html_text.main_text(page) == text


def test_extract(spark):
    rows = [(i, "u", p) for i, (p, _) in enumerate(PAGES)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "text")
    got = {r["page_id"]: r for r in html_text.extract(frame.select("page_id", "html", "text")).collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 5000 + FILL * 3) == (FILL * 3).strip()
    assert html_text.main_text("<article>" + "<p>word</p>" * 20000 + "</article>").count("\n\n") == 19999
