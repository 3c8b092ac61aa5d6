"""Operators and the pipeline against versions in plain Python, odd inputs, and the SQL of those that have some."""

import html as entities
import random
import re
import zlib
from html.parser import HTMLParser

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus_ops import SMALL, brute_leaks, components, docs_of, word_sets

from strandlake.llm import decontaminate, html, jaccard, licences, packing, personal, quality, registry, secrets
from strandlake.llm.bits import bit_filter
from strandlake.llm.text import SpanHasher, WordHasher


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s[:n]


@pytest.mark.parametrize("name", ["op2_secret_scan", "op4_cover_tree", "op6_ngram_jaccard", "op8_personal_data"])
def test_query_equals_sql(spark, name):
    assert compare.difference(registry.QUERIES[name](spark, SMALL), compare.connect(SMALL), registry.ORACLE_SQL[name]) is None


def test_words_of_regular_letters_are_told_apart(spark):
    pairs = [(thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))) for n in (64, 128, 256, 257, 1024, 4096)]
    words = sorted({w for p in pairs for w in p} | {w + "a" for p in pairs for w in p} | {w[:-1] for p in pairs for w in p})
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    assert len(set(WordHasher()(data)[0].tolist())) == len(words)
    spans = SpanHasher().spans(np.frombuffer(b"abcdefgh" * 4, np.uint8), np.array([0, 0, 0, 8, 16, 0]), np.array([7, 8, 9, 17, 24, 0]))
    assert spans[1] == spans[4] and spans[2] == spans[3] and len(set(spans.tolist())) == 4
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.Encoder(packing.tokenizer_path())
    for a, b in pairs:
        for text in (a, b, f"{a} {b} {a}", f"{b} {a}"):
            raw = np.frombuffer(text.encode(), np.uint8)
            assert list(encode(raw, np.array([0, len(raw)]))[0]) == tokenizer.encode(text, add_special_tokens=False).ids
    tail = " ".join(f"w{i}" for i in range(30))
    texts = [f"{w} {tail}" for p in pairs[1:3] for w in p]
    sets = word_sets(texts, 5)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs_of(spark, texts), k=5, similarity="0.95").collect()}
    assert [got[i] for i in range(len(texts))] == components(len(texts), [(i, j) for j in range(len(texts)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 95 * len(sets[i] | sets[j])])
    item = pairs[2][0] + " one two"
    found = decontaminate.find_leaks(docs_of(spark, [item, pairs[2][1] + " one two"]), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found if r.edits == 0] == [(0, 7)]


def test_a_family_of_near_copies(spark):
    """Copies around a base at similarities on both sides of the threshold, as sets of one place in many components."""
    rng = random.Random(5)
    base = [f"b{rng.randrange(10**6)}" for _ in range(160)]
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(i % 11):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    for split in (jaccard.SPLIT, 16):
        jaccard.SPLIT, kept = split, jaccard.SPLIT
        try:
            got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs_of(spark, texts), k=4, similarity="0.85").collect()}
        finally:
            jaccard.SPLIT = kept
        sets = word_sets(texts, 4)
        links = [(i, j) for j in range(len(texts)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
        want = components(len(texts), links)
        assert [got[i] for i in range(len(texts))] == want and 10 < len(set(want)) < 140


def test_an_id_with_several_texts_is_one_document(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(f"t{rng.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    rows = [(9, a), (9, b), (4, b + " x"), (2, b), (7, a + " y"), (7, a + " y"), (5, c), (3, None), (3, c), (None, c)]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(9, 2), (9, 2), (4, 2), (2, 2), (7, 2), (7, 2), (5, 3), (3, 3), (3, 3), (None, None)], key=str)


def test_wide_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (5, 100, 1000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n, dtype=np.uint64)]))
        differ = len(np.setxor1d(a, b))
        x, y = jaccard.sketch(a, jaccard.wide_bits(len(a))), jaccard.sketch(b, jaccard.wide_bits(len(b)))
        while len(x) != len(y):
            x, y = (x, y[: len(y) // 2] ^ y[len(y) // 2 :]) if len(x) < len(y) else (x[: len(x) // 2] ^ x[len(x) // 2 :], y)
        bits = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
        assert bits <= differ and bits % 2 == differ % 2


def test_bit_filters_pass_all_that_is_wanted(spark):
    rows = spark.range(3000).select("id", F.col("id").cast("string").alias("text"))
    wanted = rows.where("id % 7 = 3").select("id")
    found = bit_filter(wanted, "id")
    passed = {r.id for r in found.passing(rows, "id").collect()}
    assert passed >= {i for i in range(3000) if i % 7 == 3} and len(passed) < 600
    assert {r.id for r in found.passing(rows, "id", negate=True).collect()} == set(range(3000)) - passed
    assert bit_filter(wanted.limit(0), "id").passing(rows, "id").count() == 0


def test_ledger_scans_only_what_is_new(spark, monkeypatch):
    texts = [None, "", "token = abcdef1", "plain", "token = abcdef1", "x AKIA" + "B" * 16]
    docs = docs_of(spark, texts)
    rows, first = secrets.scan_ledger(docs)
    assert first.count() == 4 and {r.path: len(r.spans or ()) for r in rows.collect()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 1, 5: 1}
    again, more = secrets.scan_ledger(docs, first)
    assert more.count() == 0 and sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    later = docs.union(docs_of(spark, ["password: hunter22", "plain"], 10))
    grown, added = secrets.scan_ledger(later, first)
    assert added.count() == 1 and {r.path: len(r.spans or ()) for r in grown.collect()}[10] == 1
    assert secrets.scan_ledger(docs, first, version="other")[1].count() == 4
    plan = again._jdf.queryExecution().toString()
    assert "body" not in plan.split("== Physical Plan ==")[1]  # no text is read to join findings to paths


def test_redaction_keeps_columns_of_any_name(spark):
    rows = [(1, "token = abcdef1", "s", "b", 1.0, "x"), (2, None, None, None, None, None), (3, "plain", "s", "b", 2.0, "x"), (1, "token = abcdef1", "s", "b", 1.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, blob string, c0 double, _blob string")
    got = secrets.redacted(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, "[assign]" if t and "token" in t else t, *r) for i, t, *r in rows], key=str)


def brute_score(model, data):
    """The network's score of one text by loops over its chunks, places and filters."""
    width, step, chunk = quality.WIDTH, quality.STEP, quality.CHUNK
    n = max(1, len(data))
    padded = data + b"\0" * (chunk + width)
    segments = -(-(len(data) + width - 1) // step)
    hop = chunk // step - 1
    logits = []
    for k in range(max(1, -(-(segments - 1) // hop))):
        begin = k * hop * step
        peak = np.full(quality.FILTERS, -1e30)
        for at in range(begin, min(begin + chunk, n)):
            peak = np.maximum(peak, model.bias + sum(model.tables[i][padded[at + i]] for i in range(width)))
        logits.append(float(np.maximum(peak, 0) @ model.top + model.shift))
    return 1 / (1 + np.exp(-np.mean(logits)))


def test_scores_equal_a_loop():
    model = quality.Network(3)
    rng = random.Random(2)
    texts = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in (0, 1, 5, 59, 60, 63, 64, 507, 508, 512, 513, 960, 1000, 2500)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.score(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert np.allclose(got, [brute_score(model, t) for t in texts], rtol=1e-4, atol=1e-5)
    for t in texts:  # training lays chunks out as scoring does
        chunks, inside = quality.chunks_of(np.frombuffer(t, np.uint8))
        assert sum(inside) >= max(1, len(t)) and bytes(chunks[0][: min(len(t), 512)]) == t[:512]


def test_training_takes_whole_texts_under_a_bound(spark):
    docs = spark.createDataFrame([(i, ("good " if i % 2 else "bad ") * (200 if i < 40 else 2), "s") for i in range(80)] + [(500, None, "s")], "doc_id long, text string, score string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.train(docs, labels)
    out = quality.scored(docs, model, score="mine")
    assert out.columns == [*docs.columns, "mine"] and {r.doc_id % 2 == 1: r.mine >= 0.5 for r in out.where("doc_id < 500").collect()} == {True: True, False: False}
    assert quality.scored(docs.limit(0), model).count() == 0 and isinstance(quality.train(docs.limit(0), labels), float)


class Blocks(HTMLParser):
    """Blocks of plain pages by the standard parser: every block tag ends one; skipped elements hide all in them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.skip = [], [], 0

    def cut(self):
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        self.out += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")
        self.cut() if tag in html.BLOCK_TAGS else None

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")
        self.cut() if tag in html.BLOCK_TAGS else None

    def handle_data(self, data):
        self.parts.append(data) if not self.skip else None


def test_blocks_equal_the_standard_parser(spark):
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        plain = Blocks()
        plain.feed(r.html)
        plain.close()
        plain.cut()
        assert [b[0] for b in html.text_blocks(r.html)] == plain.out


def test_main_text_of_odd_pages():
    tree = html.trained()
    pages = {
        "<body class='no-sidebar'><article><p>Some words here</p></article></body>": "Some words here",
        "<div class='content with-sidebar'><p>text of the page</p></div>": "text of the page",
        "<p class='ad'>Buy<p>text of the page": "text of the page",
        "<main><p>one</p><table class='legal'><tr><td>cell<td>two</table></main>": "one\ncell\ntwo",
        "<article><p>a<ul><li>b<li class='share'>no<li>c</ul></article><div id='comments'><p>nice</p></div>": "a\nb\nc",
        "<div class=site-header>x</div><div class='ad-box'>y</div><div>abc def</div>": "abc def",
        "<article>" + "<div><p>deep" * 20_000: "\n".join(["deep"] * 20_000),
    }
    for page, text in pages.items():
        assert html.main_text(page, tree) == text
    assert entities.unescape("&eacute;") in html.main_text("<article>caf&eacute;</article>", tree)


def test_the_tree_looks_at_neighbours_and_words():
    tree, seen = html.trained(), set()

    def walk(node):
        if node.feature >= 0:
            seen.add(html.FEATURES[node.feature])
            walk(node.low)
            walk(node.high)

    walk(tree)
    assert seen >= {"words", "link_density", "link_density_before", "in_boilerplate", "in_article"} and seen & {"words_before", "words_after"}
    rng = random.Random(1)
    some = lambda: (rng.choice((1, 4, 30, 200)), rng.random(), rng.choice((0, 3, 60)), rng.random(), rng.choice((0, 3, 60)), rng.random())
    assert all(tree((*some(), 0, 1, 1, 0)) >= 0.5 and tree((*some(), 1, 0, 1, 0)) < 0.5 for _ in range(2000))
    page = "<a href=x>Home</a><div>Topics</div><a href=y>More</a><p>" + "word " * 60 + "</p><p><a href=z>a link as a sentence</a></p><p>" + "word " * 60
    kept = html.main_text(page, tree).split("\n")
    assert "Home" not in kept and "Topics" not in kept and "a link as a sentence" in kept


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def test_licences_equal_brute_force(spark):
    templates = (("one", "the quick brown fox jumps over the lazy dog again"), ("two", "all rights are reserved by the owner of this work and its parts"))
    rng = random.Random(8)
    words = sorted({w for _, t in templates for w in t.split()}) + ["other", "words", "here"]
    texts = [None, "", "fox"]
    for _ in range(60):
        t = rng.choice(templates)[1].split()
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join([rng.choice(words) for _ in range(rng.randrange(9))] + t + [rng.choice(words) for _ in range(rng.randrange(9))]))
    got = {(r.doc_id, r.licence) for r in licences.find_licences(docs_of(spark, texts), templates, 0.8).collect()}
    grams = lambda w: set(zip(w, w[1:], strict=False))
    for i, text in enumerate(texts):
        w = (text or "").split()
        best = {n: max((dice(grams(t.split()), grams(w[a:b])) for a in range(len(w)) for b in range(a + 2, len(w) + 1)), default=0.0) for n, t in templates}
        assert {n for d, n in got if d == i} == {n for n, d in best.items() if d >= 0.8}


def test_pieces_of_a_common_length_are_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 7)
    pieces = spark.createDataFrame([(i, 0, 64 if i % 3 else 1 + i % 64, i * 17, 64) for i in range(500)], packing.SCHEMA)
    rows = packing.pack(pieces, 64).collect()
    taken = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert len(rows) == 500 and all(a + n == b if s == t else b == 0 and a + n <= 64 for (s, a, n), (t, b, _) in zip(taken, taken[1:], strict=False))


def test_scores_of_personal_data(spark):
    rows = personal.find_personal(docs_of(spark, ["call my phone +1 555 123 4567", "+1 555 123 4567", None]))
    assert {r.path: [s.score for s in r.spans] for r in rows.collect()} == {0: [pytest.approx(0.7)], 1: [pytest.approx(0.6)], 2: []}


def corpus(rng):
    word = lambda good: rng.choice(("sun", "river", "stone", "letter") if good else ("zzq", "xxv", "qqk", "vvj")) + str(rng.randrange(40))
    item = " ".join(f"bench{rng.randrange(10**6)}" for _ in range(30))
    rows, labels = [], []
    for i in range(90):
        good = i % 5 != 0
        text = " ".join(word(good) for _ in range(rng.randrange(20, 120)))
        if i % 9 == 2 and rows:
            text = rows[-1][1] + " end"
        if i % 13 == 4:
            text += " " + item
        if i % 17 == 6:
            text += ' password = "abcdef1234" ' + word(good)
        rows.append((i, text, "en", "web" if i % 3 else None, len(text), "s", "t"))
        labels.append((i, int(good), 0))
    rows += [(200, None, None, None, None, None, None), (201, "", "en", "web", 0, "s", "t"), (None, rows[1][1], "en", "web", 5, "s", "t"), (7, rows[7][1], "en", "web", 5, "s", "t"), (202, "sun1 " * 30_000, "en", "web", 5, "s", "t")]
    return rows, labels, [(1, item), (2, None), (None, "x y z"), (3, "")]


def test_pipeline_equals_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, labels, items = corpus(random.Random(12))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, blob string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    # The same stages in plain Python, each on what the one before kept.
    kept = [r for r in map(tuple, docs.collect()) if brute_score(model, (r[1] or "").encode()) >= quality.THRESHOLD]
    assert 60 < len(kept) < len(rows)
    sets = word_sets([r[1] for r in kept], 5)
    of = components(len(kept), [(i, j) for j in range(len(kept)) for i in range(j) if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])])
    best = {}
    for i, r in enumerate(kept):
        best.setdefault(of[i], []).append((r[0] is None, r[0] or 0, i))
    kept = [kept[min(x)[2]] for x in best.values()]
    leaks = brute_leaks([r[1] for r in kept], [(i, t) for i, t in items if i is not None and t])
    leaked = {kept[x[0]][0] for x in leaks}
    kept = [r for r in kept if r[0] not in leaked]

    def cleaned(text):
        out, at = "", 0
        for kind, a, b in secrets.find_secrets(text):
            if b > at:
                out, at = out + (text[at:a] + f"[{kind}]" if a >= at else ""), b
        return out + text[at:]

    want = {(r[0], r[1] if r[1] is None else cleaned(r[1])) for r in kept}
    stages = docs
    for name, stage in pipeline.STAGES[:-1]:
        stages = pipeline.staged(stage(spark, stages, str(tmp_path)), "t")
        assert stages.columns == docs.columns, name
    assert {(r.doc_id, r.text) for r in stages.collect()} == want and stages.count() == len(kept)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in stages.collect())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    packed = pipeline.run(spark, str(tmp_path)).collect()
    by_doc = {}
    for r in packed:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in packed) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in want)
    for doc, text in want:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[doc, len(ids)], key=lambda r: r.start)
        got = {(r.start, r.length, r.ids_crc32) for r in pieces}
        assert {(a, min(2048, len(ids) - a), zlib.crc32(np.array(ids[a : a + 2048], "<u4"))) for a in range(0, len(ids), 2048)} <= got
    taken = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    assert all(a + n == b if s == t else b == 0 for (s, a, n), (t, b, _) in zip(taken, taken[1:], strict=False)) and all(a + n <= 2048 for _, a, n in taken)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "", "x"), (1, "", "x"), (2, " \n ", None)]])
def test_stages_on_empty_tables_and_texts(spark, tmp_path, rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, similarity string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in packed), key=str) == sorted((r[0] for r in rows), key=str) and all(r.start == 0 and r.length == r.doc_tokens for r in packed)


def edited(rng, words, n, kind):
    w, new = list(words), lambda: f"x{rng.randrange(10**9)}"
    if kind == "head replaced":
        return [new() for _ in range(n)] + w[n:]
    if kind == "tail replaced":
        return w[: len(w) - n] + [new() for _ in range(n)]
    if kind == "head dropped":
        return w[n:]
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + 1] = {"replaced": [new()], "dropped": [], "inserted": [new(), w[i]]}[kind]
    return w


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_recall_of_walks(share):
    """Items of 10 to 80 words with that share of edits, by kind: at least 0.95 of them share a bucket and are found, by the class that op7 uses."""
    rng = random.Random(int(share * 100))
    for kind in ("head replaced", "head dropped", "tail replaced", "replaced", "dropped", "inserted"):
        items = [[f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(10, 81))] for _ in range(60)]
        around = lambda: [f"p{rng.randrange(10**9)}" for _ in range(rng.randrange(40))]
        texts = [" ".join(around() + edited(rng, w, int(share * len(w) + 1e-9), kind) + around()).encode() for w in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = {(t, i) for t, i, *_ in decontaminate.matches(WordHasher(), decontaminate.index([(k, " ".join(w)) for k, w in enumerate(items)]), np.frombuffer(b"".join(texts), np.uint8), offsets)}
        assert sum((k, k) in got for k in range(60)) >= 0.95 * 60, kind
        assert all(t == i for t, i in got)


def test_walks_meet_at_equal_words_and_part_at_others():
    rng = np.random.default_rng(4)
    item = rng.integers(1, 2**63, 50, dtype=np.uint64)
    own = decontaminate.buckets(np.stack([item, item, rng.integers(1, 2**63, 50, dtype=np.uint64)]))
    assert (own[0] == own[1]).all() and not (own[0] == own[2]).any()
    for size in (1, 2, 5, 300):
        assert decontaminate.buckets(rng.integers(1, 2**63, (3, size), dtype=np.uint64)).shape == (3, decontaminate.WALKS, decontaminate.SAMPLES)
