import collections
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from quern.llm import chat_format, decontam, html_extract, line_dedup, mixing, perfect_hash, quality, queries, shard, simhash, toxicity, url_filter
from quern.llm.components import components

from ..oracle import same
from . import tables

WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    return tables.write(tmp_path_factory.mktemp("sf"))


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return tables.write(tmp_path_factory.mktemp("empty"), empty=True)


def connect(sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty, name):
    rows = queries.queries()[name](spark, empty).collect()
    assert len(rows) == (1 if name.startswith("op5_") else 0)


# 1


def test_html(spark, sf):
    rows = queries.queries()["op1_html_extraction"](spark, sf).collect()
    assert len(rows) == 19
    for r in rows:
        want = tables.TEXTS[(1 if r["page_id"] is None else r["page_id"]) % len(tables.TEXTS)]
        assert r["text"] == want and r["n_chars"] == len(want)


def test_html_void_embed():
    e = html_extract.Extractor()
    for embed in ("<embed src=x>", "<embed src='x'/>", "<object><embed src=x></object>", "<EMBED>"):
        assert e.text(f"<article><p>First paragraph here.</p>{embed}<p>Second paragraph here.</p></article>") == "First paragraph here.\n\nSecond paragraph here."


def test_html_is_linear():
    e = html_extract.Extractor()
    bad = ["<p " * 50_000, "<div>" * 20_000 + "x", '<a href="' * 20_000, "<!--" * 50_000, "<script>" * 20_000, "&" * 100_000, "</p>" * 50_000]
    bad += ["<i x><div>" + "<b x>" * 30_000 + "</i>" * 30_000, "<div><p><b x>" * 10_000, "<li><a>x" * 20_000, "<td><p>" * 20_000]
    for page in bad:
        began = time.perf_counter()
        e.text(page)
        assert time.perf_counter() - began < 10


def test_html_region_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        scores = rng.normal(-0.3, 2, rng.integers(0, 30)).round(2).tolist()
        first, last = html_extract.best_region(scores)
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        best = max(sums.values(), default=0)
        assert (first, last) == (0, 0) if best <= 0 else abs(sums[first, last] - best) < 1e-9


def html_pages_of_all_kinds():
    """(page, main paragraphs): the same article in many surroundings, also named misleadingly."""
    import random

    rng = random.Random(12)
    said = [" ".join(f"w{rng.randrange(999)}" for _ in range(n)) + "." for n in (30, 2, 17, 45, 1, 9)]
    ad, more = "Buy one and get one for free today only here.", " ".join(["Another story that is told elsewhere"] * 3) + "."
    main = lambda c="": "<h1>A title</h1>" + f"{c}".join(f"<p>{x}</p>" for x in said)
    want = ["A title", *said]
    menu = "<nav><ul>" + "<li><a href=x>one entry</a></li>" * 5 + "</ul></nav>"
    for wrap in ("<article>{}</article>", "<main><div class='page'>{}</div></main>", "<div class='social-history'><article>{}</article></div>", "<div class='promo-text article'>{}</div>", "<article id='comments-on-law'>{}</article>", "<div>" * 700 + "<article>{}</article>"):
        yield menu + wrap.format(main()) + f"<footer>{ad}</footer>", want
        yield f"<div class=hilfe>{ad}</div>" + wrap.format(main(f"<div class=hilfe>{ad}</div>")), want
        yield wrap.format(main("<aside><p>beside the point</p></aside><form><p>your name</p></form>")) + f"<div class=teaser><h4><a href=y>Another story</a></h4><p>{more}</p></div>", want
        if "<article" in wrap:  # text that looks no different stands before and behind
            yield f"<div><p>{said[2]}</p><p>{more}</p></div>" + wrap.format(main()) + f"<div><p>{more}</p></div>" * 2, want
            yield wrap.format(main()) + f"<article><p>{more}</p></article>", want
        yield wrap.format(main() + f"<section class=comments><p>{more}</p></section>") + f"<ul class=comments><li>{more}</li></ul>", want
    yield "<article>" + "<div>" * 600 + f"<p>{said[0]}</p>{menu}<p>{said[3]}</p>" + "</div>" * 600 + "</article>", [said[0], said[3]]
    yield menu + f"<div class=body><p>{said[0]}</p><p>{said[3]}</p></div><div><div><h4><a href=z>Another</a></h4><p>{more}</p></div></div>", [said[0], said[3]]


def test_html_pages_of_all_kinds():
    e = html_extract.Extractor()
    for page, want in html_pages_of_all_kinds():
        assert e.text(page).split("\n\n") == want, page[:200]


def best_text(scores):
    """In place of the scan: the one token that scores highest."""
    i = max(range(len(scores)), key=scores.__getitem__, default=0)
    return (i, i + 1) if scores and scores[i] > 0 else (0, 0)


def all_positive(scores):
    """In place of the scan: from the first to the last token that scores positive."""
    found = [i for i, s in enumerate(scores) if s > 0]
    return (found[0], found[-1] + 1) if found else (0, 0)


def test_html_scan_decides(monkeypatch):
    """Other regions than the scan's give other texts, of pages with and without an article."""
    e, pages = html_extract.Extractor(), [p for p, _ in html_pages_of_all_kinds()]
    texts = [e.text(p) for p in pages]
    for other, least, without in ((best_text, 34, 9), (all_positive, 20, 4)):
        monkeypatch.setattr(html_extract, "best_region", other)
        changed = [p for p, text in zip(pages, texts, strict=True) if e.text(p) != text]
        assert len(changed) >= least and sum("<article" not in p for p in changed) >= without, (other.__name__, len(changed))


def test_html_scan_decides_on_the_tables_pages(monkeypatch):
    import pyarrow.parquet as pq

    e, pages = html_extract.Extractor(), pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    texts = [e.text(p) for p in pages]
    monkeypatch.setattr(html_extract, "best_region", best_text)
    assert sum(e.text(p) != t for p, t in zip(pages, texts, strict=True)) == len(pages)


SAID = "The council met on Monday to talk about the new bridge over the river and its cost for all. " * 3
HEAD = f"<h1>Bridge</h1><p>{SAID}</p><p>{SAID}</p>"
POSTS = ("I really think that is wrong of them to do.", "So do I my friend.", "Nobody asked you about that at all.")


@pytest.mark.parametrize(
    "page",
    [
        f"<main>{HEAD}<p>Short end.</p><div id='disqus_thread'>" + "".join(f"<div class='post-{i}'><p>{x}</p></div>" for i, x in enumerate(POSTS)) + "</div></main>",
        f"<main>{HEAD}<p>Short end.</p><div class='discussion'>" + "".join(f"<div class='msg'><p>{x}</p></div>" for x in POSTS[:2]) + "</div></main>",
        f"<div class='q1'>{HEAD}<p>Short end.</p></div><ul class='q2'>" + "".join(f"<li class='q3'><p>{x}</p></li>" for x in POSTS) + "</ul>",
        f"<article>{HEAD}<div class='gdpr'><p>We value your privacy and store data on your device.</p></div><p>Short end.</p></article>",
        f"<div class='q4'>{HEAD}<section class='q5'><p>Order today and save on every shoe that you like.</p></section><p>Short end.</p></div>",
        f"<div><a href=/>x</a></div><div>{HEAD}<p>Short end.</p></div><div class='q6'><p>Other things that we wrote about bridges in the past.</p></div>",
    ],
)
def test_html_unknown_names(page):
    """Replies, notices and adverts whose names were never seen: their shape tells."""
    said = SAID.strip()
    assert html_extract.Extractor().text(page).split("\n\n") == ["Bridge", said, said, "Short end."]


def test_html_learns_from_a_sample(spark):
    """Pages with one article label themselves; an unknown class outside of it is learned."""
    page = "<div class='zork'><p>Some words that are no part of the article but long enough to be.</p></div><article><p>Text of the article in one sentence.</p><nav><a>menu</a></nav><p>More text of it.</p></article>"
    assert html_extract.mark(page).count("[[") == 2 and "[[<p>More" in html_extract.mark(page)
    assert html_extract.mark("<article>a</article><article>b</article>") is None and html_extract.mark("<p>x</p>") is None and html_extract.mark("<article><nav>x</article>") is None
    df = spark.createDataFrame([(i, page.replace("menu", f"menu {i}")) for i in range(80)] + [(99, None)], "page_id long, html string")
    weights = html_extract.fit(df)
    assert weights.near["h:zork"] < -1 and "h:zork" not in html_extract.plain_weights().near
    text = "<div class='zork'><p>Some words that are no part of it but long enough to be text.</p></div><div><p>Text of the page in a sentence that is longer still.</p><p>And more of it, so that it is the best.</p></div>"
    assert "zork" not in text or html_extract.Extractor(weights).text(text).startswith("Text of the page")


# 2


def test_toxicity_learns(spark):
    import random

    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        body = [tables.sentence(rng, 12) for _ in range(rng.randint(2, 8))]
        if toxic:
            body[rng.randrange(len(body))] += rng.choice([" zuvile", " zuvilest thing", " grumock"])
        rows.append((i, ". ".join(body) + "."))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    test = [(got[i]["score"] >= 0.5, bool(y)) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in test) >= 0.95 * len(test) and got[1000]["score"] == got[1001]["score"] < 0.5
    text = dict(rows)[0]
    where = [i for i, s in enumerate(text.split(". ")) if "zuvil" in s or "grumock" in s]
    assert got[0]["offending"] == where and got[0]["worst_sentence"] == where[0]


def test_toxicity_features_of_both_labels(spark):
    """A word that only clean documents have speaks against the label; the number of features has no bound."""
    rows = [(i, f"common words here {'zorkish' if i % 3 == 0 else 'calmly'} w{i}a.") for i in range(600)]
    labels = [(i, int(i % 3 == 0)) for i in range(600)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.weights["w:zorkish"] > 0 > model.weights["w:calmly"]


def test_toxicity_gradient():
    """Noisy-or and gradient against plain loops and finite differences."""
    rng = np.random.default_rng(3)
    n_docs, n_feat = 12, 6
    doc = np.sort(rng.integers(0, n_docs, 30))
    sent = np.repeat(np.arange(30), 2)
    feat = rng.integers(0, n_feat, 60)
    label, weight = rng.integers(0, 2, n_docs), rng.random(n_docs) + 0.5
    n_sent = np.bincount(doc, minlength=n_docs) + rng.integers(0, 3, n_docs).astype(float)
    w = np.r_[rng.normal(0, 1, n_feat), -1.5, -2.0]
    loss, grad = toxicity.loss_and_gradient(w, doc, sent, feat, label, weight, n_sent)
    logistic = lambda z: 1 / (1 + np.exp(-z))
    plain = 0.0
    for d in range(n_docs):
        clean = 1 - logistic(w[-1])
        for s in np.flatnonzero(doc == d):
            clean *= 1 - logistic(w[-2] + sum(w[f] for f, x in zip(feat, sent, strict=True) if x == s))
        clean *= (1 - logistic(w[-2])) ** (n_sent[d] - (doc == d).sum())
        plain -= weight[d] * np.log(1 - clean if label[d] else clean)
    assert abs(loss - plain / weight.sum() - 1e-5 * (w[:n_feat] ** 2).sum()) < 1e-9
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        a, b = (toxicity.loss_and_gradient(w + x, doc, sent, feat, label, weight, n_sent)[0] for x in (step, -step))
        assert abs((a - b) / 2e-6 - grad[i]) < 1e-6


def test_toxicity_score_by_brute_force():
    import math

    m = toxicity.Model({"w:bad": 6.0, "p:wor": 2.0, "w:good": -3.0}, -4.0, 0.01)
    text = "A good day. Bad words!\nWorse, worst? \n\n  nothing. BAD bad bad."
    found = m.score(text)
    weights = {s: sum(m.word_weight(w) for w in set(re.findall(r"[^\W\d_]+", s.lower()))) for s in ("A good day.", " Bad words!", "Worse, worst?", "  nothing.", " BAD bad bad.")}
    p = [1 / (1 + math.exp(-(m.bias + z))) for z in weights.values()]
    clean = (1 - m.leak) * math.prod(1 - x for x in p)
    assert abs(found[0] - (1 - clean)) < 1e-9 and found[1] == 5
    assert found[2] == max(range(5), key=p.__getitem__) and found[4] == [i for i, x in enumerate(p) if x >= 0.5]
    assert m.score("")[:2] == (pytest.approx(m.leak), 0)


def test_toxicity_training_is_bounded(spark):
    """Repeated ids are one training row, texts beyond the bound none; null texts teach nothing."""
    rows = [(i, "good words here." if i % 2 else "zorg words here.") for i in range(60)] + [(0, "zorg again.")] * 50 + [(61, "zorg " * 2000), (62, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(63)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, train_bytes=1000)
    assert model.score("zorg")[0] > 0.5 > model.score("good")[0]
    assert toxicity.fit(docs.where("doc_id = 61"), labels).weights == {}


def test_toxicity_query(spark, sf):
    rows = queries.queries()["op2_toxicity"](spark, sf).collect()
    assert len(rows) == len(tables.documents()[0])
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_toxicity_without_positives(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert toxicity.score(docs, m).first()["score"] < 0.5


# 3


def fingerprint(text):
    w = WORD.findall(lower(text))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    """Least index of each fingerprint's component."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4) + i + 1:
            x, y = sorted((find(i), find(int(j))))
            root[y] = x
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, sf):
    docs = tables.documents()[0]
    fps = [fingerprint(t) for _, t, _ in docs]
    at = groups(fps)
    low = collections.defaultdict(list)
    for (i, _, _), g in zip(docs, at, strict=True):
        if i is not None:
            low[g].append(i)
    want = sorted(((i, f"{f:016x}", min(low[g], default=None)) for (i, _, _), f, g in zip(docs, fps, at, strict=True)), key=repr)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.queries()["op3_simhash_near_dedup"](spark, sf).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("limit", [50_000, 40])
def test_links_lose_nothing(spark, limit):
    """Dense groups, chains and strangers; with a low limit crowded cells are dealt to blocks."""
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    found = set(map(int, seeds))
    for s in seeds[:20]:
        x = int(s)
        for _ in range(40):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            y = x
            for b in flips:
                y ^= 1 << int(b)
            found.add(y)
            if rng.random() < 0.3:
                x = y
    found |= {int(seeds[50]) ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    fps = sorted(found)
    want = groups(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    cc = components(simhash.links(df, cell_limit=limit, sample=1 if limit == 40 else 64))
    root = {r["node"]: r["root"] for r in cc.collect()}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    ours = [root.get(f, f) for f in signed]
    first: dict = {}
    assert [first.setdefault(o, i) for i, o in enumerate(ours)] == want


def test_links_of_the_largest_distance(spark):
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 2**63, 300, dtype=np.uint64)
    pairs = []
    for s in seeds:
        x = int(s)
        for b in rng.choice(64, simhash.MOST_DISTANCE, replace=False):
            x ^= 1 << int(b)
        pairs += [int(s), x]
    signed = [f - 2**64 if f >= 2**63 else f for f in pairs]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    assert components(simhash.links(df, distance=simhash.MOST_DISTANCE)).count() == 300
    for bad in (-1, 6, 8):
        with pytest.raises(ValueError):
            simhash.links(df, distance=bad)


def test_crowded_cells_with_many_blocks(spark):
    """Over 1023 blocks a cell: pairs of blocks keep apart."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    found = sorted({int(b) ^ (1 << i) ^ (1 << j) for b in base for i in range(20) for j in range(i)})
    df = spark.createDataFrame([(f,) for f in found], "fp long")
    crowded = spark.createDataFrame([(int(c), 1500) for c in np.unique(simhash.cells_of(np.array(found, dtype=np.uint64))[1])[:20]], "cell long, blocks long")
    dealt = simhash.dealt_entries(df, crowded)
    assert dealt.agg(F.max("pair")).first()[0] > 2**20
    plain = simhash.entries(df).where(F.col("cell").isin([r["cell"] for r in crowded.collect()])).count()
    assert dealt.join(crowded, "cell", "left_semi").count() == 1500 * plain


def test_forest_of_large_runs():
    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 2**10, 900, dtype=np.uint64) * np.uint64(2**40))
    cell = np.zeros(len(fp), dtype=np.int64)
    a, b = simhash.links_of_runs(cell, fp, 2, large=8)
    c, d = simhash.links_of_runs(cell, fp, 2, large=10_000)
    label = lambda x, y: dict(zip(*map(list, simhash.roots(x, y)), strict=True))
    assert label(a, b) == label(c, d) and len(a) < len(fp) and len(c) < len(fp)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (7, 7), (1, 5)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {5: 1, 9: 1} | {i: 500 for i in range(501, 560)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 4


def test_automaton():
    import fnmatch
    import random

    rng = random.Random(6)
    patterns = ["".join(rng.choices("ab*?", k=rng.randint(0, 6))) for _ in range(300)]
    machine = url_filter.ShiftAnd(patterns)
    for _ in range(300):
        t = "".join(rng.choices("ab", k=rng.randint(0, 8)))
        assert machine.matches(t) == [i for i, p in enumerate(patterns) if fnmatch.fnmatchcase(t, p)]
    assert url_filter.ShiftAnd([r"a\*b"]).matches("a*b") == [0] and url_filter.ShiftAnd([r"a\*b"]).matches("axb") == []


# 5


def test_chat_round_trip():
    import random

    rng = random.Random(8)
    parts = [*chat_format.CONTROLS, "\\", "\n", "<", "[", "é", "漢", " ", "%0A", "a", "INST]"]
    tok = chat_format.make_encoder(open(chat_format.TOKENIZER, encoding="utf-8").read())
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant", "to\nol", "%"]), "".join(rng.choices(parts, k=rng.randint(0, 12)))) for _ in range(rng.randint(1, 5))]
        text, spans = chat_format.render(turns)
        assert chat_format.read_back(text) == turns
        enc = tok.encode(text, add_special_tokens=False)
        flags, covered = chat_format.mask(enc, spans)
        said = [chat_format.unescape(text[a:b]) for a, b in covered]
        assert said == [t for r, t in turns if r == "assistant" and t]
        assert tok.decode([i for i, f in zip(enc.ids, flags, strict=True) if f], skip_special_tokens=False) == "".join(text[a:b] for a, b in covered)


def test_segments_are_the_whole_conversation(monkeypatch):
    """Text, ids and mask of a conversation cut into segments equal one encoding of it."""
    import random

    rng = random.Random(4)
    parts = [*chat_format.CONTROLS, " ", "  ", "\n", "\n\n", "word", " word", "Ünï", "漢字", "'s", "12", "\t", "<s", ">"]
    tok = chat_format.make_encoder(open(chat_format.TOKENIZER, encoding="utf-8").read())
    for _ in range(60):
        turns = [(rng.choice(["user", "assistant", "system"]), "".join(rng.choices(parts, k=rng.randint(0, 15)))) for _ in range(rng.randint(1, 40))]
        whole, spans = chat_format.render(turns)
        enc = tok.encode(whole, add_special_tokens=False)
        flags, _ = chat_format.mask(enc, spans)
        monkeypatch.setattr(chat_format, "SEGMENT_TURNS", rng.randint(1, 9))
        batch = pa.RecordBatch.from_pydict({"conv": [1] * len(turns), "turn": list(range(len(turns))), "role": [r for r, _ in turns], "text": [t for _, t in turns]})
        text, ids, mask = "", [], []
        for _, _, _, some in chat_format._segments(iter([batch])):
            formatted, own = chat_format.render(some)
            e = tok.encode(formatted, add_special_tokens=False)
            text, ids, mask = text + formatted, ids + e.ids, mask + chat_format.mask(e, own)[0].tolist()
        assert (text, ids, mask) == (whole, enc.ids, flags.tolist())


def test_format_chats(spark, sf):
    rows = chat_format.format_chats(spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id = 9")).orderBy("task", "seq").collect()
    assert len(rows) >= 3 and sum(len(chat_format.read_back(r["formatted"])) for r in rows) == 1500
    assert all(len(r["input_ids"]) == len(r["loss_mask"]) for r in rows)


# 6


def test_quality(spark, sf):
    docs = tables.documents()[0]
    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    want = []
    for i, t, _ in docs:
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        count = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = {x for j in range(len(w) - 7) if count[tuple(w[j : j + 8])] > 1 for x in range(j, j + 8)}
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        raw = t.encode()
        fits = lambda b: (lambda lo, hi: lo <= len(packer.compress(b)) / len(b) <= hi)(*quality.band_of(len(b)))
        n = max(1, len(raw) // quality.CHUNK)
        chunks = [raw[k * quality.CHUNK : (k + 1) * quality.CHUNK if k < n - 1 else None] for k in range(n)] if raw else []
        bad = sum(not fits(c) for c in chunks)
        kept = not failed and fits(raw) and bad < max(1, quality.BAD_CHUNKS * n)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed, kept))
    got = [tuple(r)[:8] for r in queries.queries()["op6_quality_rules"](spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = quality.keep_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    assert kept.count() == sum(w[7] for w in want) and kept.columns == spark.read.parquet(f"{sf}/documents.parquet").columns


def test_quality_incompressible():
    import base64
    import random
    import string

    packer, rng = zstandard.ZstdCompressor(level=quality.LEVEL), random.Random(5)

    def words(s, n):
        out, i = [], 0
        while i < len(s):
            k = rng.randint(3, 10)
            out.append(s[i : i + k])
            i += k
        return " ".join(out)[:n].encode()

    def inside(raw):
        return quality.compression(raw, packer)[3]

    for n in (300, 1500, 5000):
        for _ in range(20):
            assert not inside(words(base64.b64encode(rng.randbytes(n)).decode(), n))
            assert not inside(words(rng.randbytes(n).hex(), n))
            # at 300 bytes, random letters compress no worse than prose
            assert n == 300 or not inside(words("".join(rng.choices(string.ascii_lowercase, k=n)), n))
    # scripts of three bytes are not noise
    han = "".join(chr(0x4E00 + int(20 * rng.expovariate(0.05))) for _ in range(700))
    assert inside(han[:100].encode()) and inside(han[:333].encode())
    assert inside(("The quality of a text is judged by how well it compresses, which depends on its length; "
                   "short texts hardly repeat themselves, and so the limits must be wide where little is known, "
                   "narrow where much is seen, and never so narrow that an honest paragraph is thrown away by mistake.").encode())  # fmt: skip


def prose(rng, n):
    """Sentences of invented words, some of them frequent, as prose has them."""
    common = [tables.sentence(rng, 1) for _ in range(60)]
    out = []
    while sum(map(len, out)) + len(out) < n:
        out.append(rng.choice(common) if rng.random() < 0.55 else "".join(rng.choices("etaoinshrdlucmfw", weights=range(16, 0, -1), k=rng.randint(3, 9))))
    return " ".join(out)[:n]


def test_quality_learns_its_limits(spark):
    """Documents of quality 0 that compress a little better than prose are told from it; nothing is learned without them."""
    import random

    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        text = prose(rng, rng.randint(400, 6000))
        if i % 4 == 0:
            text = " ".join(w + "%&*#"[k % 4] * 3 for k, w in enumerate(text.split()))
        rows.append((i, text))
        labels.append((i, int(i % 4 != 0)))
    docs = spark.createDataFrame(rows + [(None, "x"), (4, "again")], "doc_id long, text string")
    good = spark.createDataFrame(labels + [(None, 1), (3, None), (999, 0), (1, 0)], "doc_id long, quality int")
    usual = quality.fit(docs, good)
    assert usual.lowest(10**7) == 0
    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    kept = {i: quality.judge(t.encode(), len(t), packer, usual=usual)[6] for i, t in rows}
    assert sum(kept[i] for i in kept if i % 4) >= 0.98 * 300 and sum(not kept[i] for i in kept if i % 4 == 0) >= 60
    bands = sum(not quality.judge(t.encode(), len(t), packer)[6] for i, t in rows if i % 4 == 0)
    assert bands < 10  # the table alone doesn't find them
    assert quality.fit(docs, good.where("quality = 1 and doc_id <> 1")) is None
    few = [quality.fit(docs, good.where(f"doc_id < {n}")) for n in (8, 16, 24, 64)]
    assert few[0] is None and 0 < few[1].trust < few[2].trust < few[3].trust < usual.trust < 1
    assert few[1].limit(3000, 0.2) - 0.2 <= few[1].trust * max(0.0, few[1].lowest(3000) - 0.2) + 1e-12 and usual.limit(10**7, 0.2) == 0.2


def test_quality_finds_a_third_of_junk():
    """Noise, encodings and repetition in 30 % of a document, though the whole ratio hides them;
    hex beside prose in one chunk is too near to prose, so that takes a longer text."""
    import base64
    import random
    import string

    rng, packer = random.Random(3), zstandard.ZstdCompressor(level=quality.LEVEL)
    hidden = 0
    for n in (6000, 9000, 30_000):
        assert quality.judge(prose(rng, n).encode(), n, packer)[6]
        kinds = [base64.b64encode(rng.randbytes(n)).decode(), "".join(rng.choices(string.ascii_lowercase, k=n)), "word and word " * n]
        for junk in kinds + [rng.randbytes(n).hex()] * (n > 10_000):
            text = f"{prose(rng, n - 3 * n // 10)} {junk}"[:n]
            row = quality.judge(text.encode(), n, packer)
            assert not row[6]
            hidden += quality.compression(text.encode(), packer)[3]
    assert hidden >= 3


def test_repeated_words_collision(monkeypatch):
    import random

    rng = random.Random(1)
    for _ in range(50):
        w = [rng.choice([b"a", b"b"]) for _ in range(60)]
        count = collections.Counter(tuple(w[j : j + 8]) for j in range(53))
        assert quality.repeated_words(w) == len({x for j in range(53) if count[tuple(w[j : j + 8])] > 1 for x in range(j, j + 8)})


# 7


def check_shards(rows, docs, shards=24):
    assert len(rows) == len(docs)
    total = sum(r["size"] for r in rows)
    top = max(r["size"] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for s, own in by.items():
        assert 0 <= s < shards and sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= max(top, total / shards / 64) + 1
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_sharding(spark, sf):
    q = queries.queries()["op7_sharding"]
    rows = q(spark, sf).collect()
    docs = [(i, t) for i, t, _ in tables.documents()[0]]
    total, top = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert total < 24 * top  # one row is larger than a shard: only places and sizes can be checked
    for s in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, q(spark, sf).collect()), key=repr)


def plain_shards(docs, shards=24):
    """(doc_id, size, crc32, shard, slot, text) by prefix sums over one global order, in plain Python."""
    import hashlib

    mark = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    rows = sorted((mark(t or ""), mark("-" if i is None else str(i)), -1 if i is None else i, len((t or "").encode()) + 8, t or "") for i, t in docs)
    total, top = sum(r[3] for r in rows), max((r[3] for r in rows), default=0)
    target = max(1.0, total / shards)
    unit = max(top, int(target / shard.WHOLE))
    group = collections.Counter()
    for r in rows:
        group[r[0]] += r[3]
    out, at, begun = [], 0, {}
    slots = collections.Counter()
    for h, _, i, size, text in rows:
        begun.setdefault(h, at)
        middle = begun[h] + group[h] / 2 if group[h] <= unit else at + size / 2
        s = min(shards - 1, int(middle // target))
        out.append((None if i == -1 else i, size, zlib.crc32(text.encode()), s, slots[s], text))
        slots[s] += 1
        at += size
    return out


@pytest.mark.parametrize("buckets", [(1, 1), (64, 64), (1024, 65536)])
def test_sharding_by_brute_force(spark, sf, buckets):
    docs = [(i, t) for i, t, _ in tables.documents()[0]] + [(i, "one text of many") for i in range(200, 900)] + [(i, f"text {i}" * (i % 9)) for i in range(900, 1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in shard.shard_by_bytes(df, buckets=buckets).collect()]
    assert sorted(got, key=repr) == sorted((r[:5] for r in plain_shards(docs)), key=repr)


def test_sharding_with_large_groups(spark):
    docs = [(i, "common text " * 3) for i in range(1500)] + [(i, f"text {i % 900}" * (i % 7 + 1)) for i in range(1500, 4000)] + [(None, None)] * 40
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = shard.shard_by_bytes(df, buckets=(64, 64)).collect()
    check_shards(rows, docs)
    where = collections.defaultdict(set)
    for r in rows:
        where[r["text_crc32"], r["size"]].add(r["shard"])
    whole = [len(s) for k, s in where.items() if k[0] != zlib.crc32(b"common text " * 3)]
    assert set(whole) == {1}
    carried = shard.shard_by_bytes(df, carry=True)
    assert carried.select("row.text").distinct().count() == df.select("text").distinct().count()


# 8


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 20_000, dtype=np.uint64))
    for levels in (24, 2):
        ph = perfect_hash.PerfectHash(keys, levels=levels)
        ph = perfect_hash.PerfectHash.load(ph.dump())
        assert sorted(ph.slots(keys)) == list(range(len(keys))) and (ph.slots(keys + np.uint64(1)) < len(keys)).all()
    assert perfect_hash.PerfectHash(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def test_counts_in_the_arrays():
    """Partial counts of lines, some with equal first halves, against a plain count."""
    rng = np.random.default_rng(5)
    h = rng.integers(0, 40, 3000)
    f = rng.integers(0, 2**63, (40, 2))[h, rng.integers(0, 2, 3000)]  # two lines of each first half
    h = h.astype(np.uint64)
    n, keep = rng.integers(1, 4, 3000), rng.integers(0, 10**6, 3000)
    want: dict = {}
    for a, b, c, d in zip(h.tolist(), f.tolist(), n.tolist(), keep.tolist(), strict=True):
        old = want.get((a, b), (0, 0))
        want[a, b] = old[0] + c, max(old[1], d)
    limit = sorted(v[0] for v in want.values())[len(want) // 3]
    raw, lines = line_dedup.count_shard(h, f, n, keep, limit)
    assert lines == len(want)
    index = line_dedup.Index({0: raw}, 1)
    ask = [*want, (99, 5), (3, 77)]
    a, b = np.array([k[0] for k in ask], dtype=np.int64), np.array([k[1] for k in ask], dtype=np.int64)
    count, keeper = index.keeper(a, b, np.zeros(len(ask), dtype=np.int64))
    for k, c, d in zip(ask, count.tolist(), keeper.tolist(), strict=True):
        total, most = want.get(k, (0, 0))
        assert (c, d) == ((total, most) if total >= limit else (0, 0))


@pytest.mark.parametrize("options", [{"shard_lines": 1}, {"shard_lines": 1, "most_bytes": 1}, {"most_bytes": 1, "task_rows": 7}, {"shard_lines": 40, "most_bytes": 1, "task_rows": 1}])
def test_line_dedup_in_shards(spark, sf, options):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(i, "\n".join(f"common line number {n} of some length for all" for n in range(i % 7 + 1)) + f"\nown {i}") for i in range(200, 240)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    plain = sorted(map(tuple, line_dedup.dedup_lines(docs).collect()), key=repr)
    assert plain == sorted(map(tuple, line_dedup.dedup_lines(docs, **options).collect()), key=repr) and sum(r[2] for r in plain) > 100


# 9


def test_sainte_lague():
    import random

    rng = random.Random(9)
    for _ in range(200):
        shares = [rng.choice([0.0, rng.random() * 10 ** rng.randint(0, 4)]) for _ in range(rng.randint(1, 8))]
        seats = rng.randint(0, 300)
        got = [0] * len(shares)
        for _ in range(seats if any(shares) else 0):
            i = max((i for i in range(len(shares)) if shares[i]), key=lambda i: (shares[i] / (2 * got[i] + 1), -i))
            got[i] += 1
        assert mixing.sainte_lague(shares, seats) == got
        quotas = mixing.shard_quotas(shares, seats, 5)
        assert [sum(q[i] for q in quotas) for i in range(len(shares))] == got and (not any(shares) or max(map(sum, quotas)) - min(map(sum, quotas)) <= 1)


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs, bucket_rows=(4, 4)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * mixing.BLOCK_TOKENS and own[0]["target"] <= 3 * own[0]["source_size"]
    mixed = mixing.mix(docs, carry=True)
    out = mixing.emit(mixed)
    assert out.columns == docs.columns
    words = out.groupBy("source").agg(F.sum(mixing.count_words(F.col("text"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in words} == {s: n for s, own in by.items() if (n := sum(r["taken"] for r in own))}


def test_mix_deals_each_shard_its_quota(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mixing.mix(docs, carry=True, shards=5)
    parts = mixing.deal(mixed).collect()
    rows = mixed.select("doc_id", "source", "size", "source_size", "taken", "mix_shard", "place").collect()
    block = mixing.BLOCK_TOKENS
    have = collections.Counter()
    for p in parts:
        assert p["n_words"] == len(WORD.findall(p["text"])) > 0
        have[p["source"], p["shard"]] += p["n_words"]
    assert sum(have.values()) == sum(r["taken"] for r in rows)
    for source in {r["source"] for r in rows}:
        r = next(x for x in rows if x["source"] == source)
        upto = r["place"]["upto"]
        for s, (a, b) in enumerate(zip([0, *upto], upto, strict=False)):
            # only the last block of a source is shorter, and it is taken at most three times
            assert 0 <= (b - a) * block - have[source, s] <= 3 * block
    quota = mixing.plan([r["source_size"] for r in rows][:1], shards=5)[0]
    assert quota["upto"][-1] == quota["quota"] and max(np.diff([0, *quota["upto"]])) - min(np.diff([0, *quota["upto"]])) <= 1
    single = [r for r in rows if r["taken"] and sum(x["doc_id"] == r["doc_id"] for x in rows) == 1]
    for r in single:
        first = min((p for p in parts if p["doc_id"] == r["doc_id"]), key=lambda p: (p["round"], p["from_word"]))
        assert first["from_word"] == 0 and first["shard"] == r["mix_shard"]
    assert {r["mix_shard"] for r in rows if not r["taken"]} <= {None}


# 10


def test_decontamination_by_joins(spark, sf):
    """A benchmark too large to be broadcast gives the same."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    a, b = (sorted(map(tuple, decontam.decontaminate(docs, items, most_bytes=n).collect()), key=repr) for n in (decontam.MOST_BYTES, 0))
    assert a == b and sum(r[5] for r in a) > 5


def test_decontamination_folds_a_to_z_only(spark):
    item = "Ä straße İx ΑΣ one two three four five six seven eight nine ten"
    docs = [(1, item.upper().replace("STRASSE", "straße")), (2, "pre " + item.replace("one", "ONE") + " post"), (3, item.lower()), (4, item[:20]), (5, "ΑΣ.x " + item)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontam.decontaminate(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: 0, 2: 14, 3: 0, 4: 0, 5: 14} or got[2] == got[5] == 14 and got[3] == 0


def test_clean_documents(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    said = decontam.decontaminate(docs, items)
    kept = decontam.clean_documents(docs, items)
    assert kept.columns == docs.columns and kept.count() == said.where("not contaminated").count()
    cut = decontam.clean_documents(docs, items, how="spans")
    assert cut.count() == docs.count() and decontam.decontaminate(cut, items).where("contaminated").count() == 0
