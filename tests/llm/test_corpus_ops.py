"""Joins, packing, decontamination, licences, the classifier, pages and the pipeline against brute force on small tables."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import cosine, decontaminate, html, jaccard, licences, packing, quality, secrets
from strandlake.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, frequent string, keys string"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "x", "y") for i, t in enumerate(texts)], DOCS)


def components(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def word_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def near_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    out = [None, "", " \n", "One two", "one TWO", "ÀB à b c d e", "a b c d", "a b c d"]
    for size in (7, 12, 40, 200):
        base = [rng.choice(words) + str(rng.randrange(9)) for _ in range(size)]
        for _ in range(18):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + size // 12)):
                w[rng.randrange(size)] = "new" + str(rng.randrange(50))
            out.append(" ".join(w + [rng.choice(words)] * rng.randrange(2)))
    common = " ".join(f"line{i}" for i in range(25))
    out += [common + " " + " ".join(rng.choice(words) for _ in range(8)) for _ in range(30)]
    return out + ["x" * 50_000, "y " * 30_000]


@pytest.mark.parametrize(("k", "similarity"), [(4, "0.85"), (5, "0.8"), (2, "0.5")])
def test_jaccard_equals_brute_force(spark, k, similarity):
    texts = near_texts()
    sets, t = word_sets(texts, k), jaccard.Rule(similarity).t
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])]
    want = components(len(texts), links)
    rows = jaccard.jaccard_components(docs_of(spark, texts), k, similarity).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), want[i]) for i in range(len(texts))}
    assert len(rows) == len(texts)


def test_jaccard_edges(spark):
    odd = docs_of(spark, ["a b c d e f", None]).union(spark.createDataFrame([(None, "a b c d e f", "", ""), (0, "a b c d e f", "", "")], DOCS))
    rows = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(odd, 4, "0.85").collect()), key=str)
    assert rows == sorted([(0, 0), (0, 0), (1, 1), (None, None)], key=str)
    assert jaccard.jaccard_components(odd.limit(0), 4, "0.85").count() == 0


def test_prefix_keys_lose_no_pair():
    """Random sets, any table of frequent tokens: whatever links shares a key."""
    rng = np.random.default_rng(1)
    rule = jaccard.Rule("0.8")
    for trial in range(300):
        n = int(rng.integers(5, 150))
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        other = np.unique(np.concatenate([rng.choice(base, max(1, int(len(base) * rng.uniform(0.8, 1))), replace=False), rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        both = len(np.intersect1d(base, other))
        if rule.linked(both, len(base), len(other)) and len(base) != both:
            often = np.sort(np.unique(rng.choice(base, int(len(base) * rng.uniform(0, 1)), replace=False) >> np.uint64(24)))
            assert len(np.intersect1d(jaccard.prefix_keys(base, often, rule), jaccard.prefix_keys(other, often, rule))), trial


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 380)] + [(400, i) for i in range(401, 460)]
    want = components(460, links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: want[x] for ab in links for x in ab if ab[0] != ab[1]}


@pytest.mark.parametrize("unit", [cosine.UNIT, 24])
def test_cosine_equals_brute_force(spark, monkeypatch, unit):
    monkeypatch.setattr(cosine, "UNIT", unit)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.08, 0.3])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(5)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, [1e38] * 16), (405, [])]
    n = np.array([r[1] for r in rows[:305]], float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    link = n @ n.T >= 0.95
    parts = components(305, zip(*np.nonzero(link), strict=True))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cosine.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, leaf int")).collect()}
    assert {i: got[i] for i in range(305)} == {i: (int(link[i].sum()) - 1, parts[i], parts[i] == i) for i in range(305)}
    assert all(got[i] == (0, i, True) for i in (*range(400, 404), 404, 405)) and len(got) == 311


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(4)
    texts = [None, "", "  a  b \n\n c ", "x　y <|endoftext|> é\U0001f600", "w" * 3000, " ".join(f"word{rng.randrange(9999)}" for _ in range(3000))]
    texts += [" ".join(rng.choice(["alpha", "beta,", "don't", "\nnew", "12"]) for _ in range(rng.randrange(1, 900))) for _ in range(60)] + ["same text"] * 5
    pieces = packing.cut_pieces(docs_of(spark, texts), with_ids=True)
    rows = packing.pack(pieces).collect()
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    back, places = {}, {}
    for r in sorted(rows, key=lambda r: r.start):
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) and r.doc_tokens == len(want[r.doc_id]) and r.start == len(back.get(r.doc_id, []))
        back.setdefault(r.doc_id, []).extend(r.ids)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert back == want
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(pieces.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    histogram = np.bincount(np.minimum(2048, 1 + (rng.pareto(1.1, 4000) * 60).astype(int)), minlength=2049)
    used = np.zeros(2049, np.int64)
    steps = packing.plan(histogram)
    for combo, times in steps:
        assert sum(combo) <= 2048 and times > 0
        np.add.at(used, list(combo), times)
    assert (used == histogram).all()
    assert (histogram * np.arange(2049)).sum() > 0.9 * 2048 * sum(t for _, t in steps)


def brute_leaks(texts, items):
    out = set()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for i, text in enumerate(texts):
        words = split(text)
        for item, it in items:
            w = split(it)
            row = [0] * (len(words) + 1)
            for n, a in enumerate(w, 1):
                then = [n]
                for j, b in enumerate(words, 1):
                    then.append(min(row[j] + 1, then[-1] + 1, row[j - 1] + (a != b)))
                row = then
            if w and min(row) <= decontaminate.edits_allowed(len(w)):
                out.add((i, item))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"t{rng.randrange(400)}" for _ in range(n))) for i, n in enumerate([1, 3, 7, 9, 15, 22, 30, 41, 58])] + [(50, None), (51, ""), (None, "a b c")]
    texts = [None, "", "nothing here"]
    for _ in range(60):
        w = rng.choice(items[3:9])[1].split()
        for _ in range(rng.randrange(0, 1 + len(w) // 8)):
            w[rng.randrange(len(w))] = "zz"
        around = [f"t{rng.randrange(400)}" for _ in range(60)]
        texts.append(" ".join(around[:30] + w + around[30:]).replace("t", rng.choice("tT")))
    want = brute_leaks(texts, [x for x in items if x[0] is not None])
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs_of(spark, texts), bench).collect()}
    assert not got - want and len(got) >= 0.95 * len(want)
    assert decontaminate.find_leaks(docs_of(spark, texts), bench.limit(0)).count() == 0


def leaks_of(spark, texts, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs_of(spark, texts), bench).collect()}


def test_leaks_of_overlapping_items(spark):
    rng = random.Random(21)
    source = [f"t{rng.randrange(5000)}" for _ in range(140)]
    items = [(i, " ".join(source[i : i + 50])) for i in range(0, 91, 5)]
    around = [f"t{rng.randrange(5000)}" for _ in range(60)]
    texts = [" ".join(around[:30] + source[a:b] + around[30:]) for a, b in ((0, 75), (4, 75), (8, 90), (30, 80), (0, 140), (41, 140))]
    assert (0, 25) in (want := brute_leaks(texts, items))
    assert leaks_of(spark, texts, items) == want


def test_leaks_at_the_bound_of_edits(spark):
    rng = random.Random(22)
    items = [(n, " ".join(f"t{rng.randrange(3000)}" for _ in range(n))) for n in (5, 6, 7, 8, 10, 11, 15, 20, 33, 50, 80)]
    texts = []
    for n, item in items:
        k = decontaminate.edits_allowed(n)
        for at in (range(k), range(n - k, n), rng.sample(range(n), k), [n // 2 + i - k // 2 for i in range(k)]):
            for how in ("replace", "drop", "insert"):
                w = item.split()
                for i in sorted(at, reverse=True):
                    w[i : i + 1] = {"replace": ["zz"], "drop": [], "insert": ["zz", w[i]]}[how]
                around = [f"t{rng.randrange(3000)}" for _ in range(40)]
                texts.append(" ".join(around[:20] + w + around[20:]))
    assert len(want := brute_leaks(texts, items)) >= len(texts)
    assert leaks_of(spark, texts, items) == want


def test_licences(spark):
    mit = licences.TEMPLATES[4][1]
    texts = [None, "", "Some prose.\nReleased under the MIT License.\nmore prose", "x " * 300 + mit.replace("\n", " ").replace("charge", "cost") + " y" * 300, "licensed", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."]
    got = {(r.doc_id, r.licence) for r in licences.find_licences(docs_of(spark, texts)).collect()}
    assert got == {(2, "MIT"), (3, "MIT"), (5, "GPL-3.0"), (6, "CC-BY-NC-4.0")}


def test_sibling_licences_are_told_apart(spark):
    names = {"LGPL-2.1", "AGPL-3.0", "GPL-2.0", "EPL-1.0", *(f"CC-{x}-4.0" for x in ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND"))}
    held = [(n, f"Some prose here. {t} And more of it.") for n, t in licences.TEMPLATES]
    assert all(any(n == name and len(t) > 9000 for n, t in held) for name in names)
    held += [("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."), ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."), ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."), ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.")]
    got = sorted((r.doc_id, r.licence) for r in licences.find_licences(docs_of(spark, [t for _, t in held])).collect())
    assert got == list(enumerate(n for n, _ in held))


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.op9_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and held
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)
    assert sum(r.predicted for r in held if r.quality) >= 0.98 * sum(r.quality for r in held)
    none = quality.train(docs, labels.where("quality = 1"))
    assert none == 1.0 and quality.scored(docs.limit(3), none).first().score == 1.0


def test_quality_sees_the_whole_text():
    model = quality.Network(1)
    data = np.frombuffer(b"a" * 5000 + b"Z" + b"a" * 5000 + b"" + b"q" * 100, np.uint8)
    whole = model.score(data, np.array([0, 10001, 10001, 10101]))
    alone = [model.score(data[a:b], np.array([0, b - a]))[0] for a, b in ((0, 10001), (10001, 10001), (10001, 10101))]
    assert np.allclose(whole, alone) and abs(model.score(np.frombuffer(b"a" * 10001, np.uint8), np.array([0, 10001]))[0] - whole[0]) > 1e-9


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>no</p> --><header><p>Site name</p></header>
<div class="cookie-notice">We use cookies on this site to serve you</div><div class="ad">Buy now</div><article><h1>Head &amp; tail</h1><p>One&nbsp; two <b>three</b>
four.<br>Five</p><script>var x = "<p>";</script><p>Six &lt;seven&gt; &#233;</p><div id="comments"><p>Nice words by a reader of this page</p></div></article><form><label>Mail</label><input name="x"></form>
<aside>Related</aside><footer>&copy; me</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>only text that goes on for a while, long enough", "x"), (5, "u", "<nav>" * 3000 + "x", "x"), (6, "u", "<article><p>" + "w " * 100_000, "x"), (1, "u", PAGE, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got[1] == "Head & tail\nOne two three four.\nFive\nSix <seven> é"
    assert got[2] == got[3] == "" and got[None].startswith("only text") and len(got[6]) == 199_999


def test_redaction_and_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = ["a token = \"abcdef123456\" b", None, "plain", "x AKIA" + "B" * 16]
    out = {r.doc_id: r.text for r in secrets.redacted(docs_of(spark, texts)).collect()}
    assert out == {0: "a [assign]\" b", 1: None, 2: "plain", 3: "x [access]"}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in pipeline.STAGES:
        docs = pipeline.staged(stage(spark, docs, SMALL), "test")
        if name != "packing":
            assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").count() == 0, name
    packed, ids = docs.agg(F.sum("length")).first()[0], docs.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert packed == ids and docs.select("doc_id").distinct().count() <= before.count()


def test_near_copies_are_dropped_by_row(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(31)
    a, b, c = (" ".join(f"t{rng.randrange(5000)}" for _ in range(80)) for _ in range(3))
    rows = [(5, a), (5, b), (3, a + " end"), (None, c), (None, c + " end"), (None, b), (8, None), (8, None), (9, c)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    got = [tuple(r) for r in pipeline.drop_near_copies(spark, spark.read.parquet(str(tmp_path / "docs")), SMALL).collect()]
    assert sorted(got, key=str) == sorted([(3, a + " end"), (5, b), (9, c), (8, None), (8, None)], key=str)
