import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from quern.functions import identity, vectors
from quern.functions import text as T
from quern.operators import bm25, channels, chunking, filters, fusion, segments


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_normalize(spark):
    """Rows and queries alike, in every script."""
    assert T.normalize_text("  Zażółć\tGĘŚLĄ  jaźń! ") == "zazołc gesla jazn"
    texts = ["", "a_b-c", "Ünïcode ß x1", "…", "ΟΔΟΣ Ñandú", "がぎ カﾞ", "한국어", "ﬁnance ① x² ½", "İstanbul I", "ÀÉÎ\u0301õü", "Ⅻ ㎏ ﷺ", "नमस्ते", "שָׁלוֹם", "𝔘𝔫𝔦 𝟙𝟚"]
    got = one(spark, [(t,) for t in texts], "t string", T.normalize(F.col("t")))
    assert [g for (g,) in got] == [T.normalize_text(t) for t in texts]
    assert dict(zip(texts, (g for (g,) in got), strict=True))["ﬁnance ① x² ½"] == "finance 1 x2 1 2"


def test_normalize_all_of_unicode(spark):
    """Every character, against Python's tables; those assigned later than the JVM's tables know count as gaps."""
    import unicodedata

    points = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"a{chr(c)}B {chr(c)}") for c in points], "c int, t string")
    ours = {r["c"]: r["n"] for r in df.select("c", T.normalize(F.col("t")).alias("n")).collect()}

    def plain(t):
        kinds = [(x, unicodedata.category(x)) for x in unicodedata.normalize("NFKD", "".join(x.lower() for x in t))]
        return " ".join("".join(x if k[0] == "L" or k == "Nd" else " " for x, k in kinds if k != "Mn").split())

    other = [c for c in points if ours[c] != plain(f"a{chr(c)}B {chr(c)}")]
    assert len(other) < 1500 and all(c > 0x800 for c in other) and sum(c < 0x10000 for c in other) < 120


def test_chunking_is_linear(spark):
    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)], "t string").cache()
        df.count()
        took = []
        for _ in range(3):
            began = time.perf_counter()
            assert df.select(F.explode(chunking.windows(F.col("t")))).count() == -(-(n - 250) // 210) + 1
            took.append(time.perf_counter() - began)
        return min(took)

    seconds(5_000)
    assert seconds(160_000) < 4.5 * max(seconds(40_000), 0.25)


def test_grams(spark):
    q = T.query_grams("genrate qr cdoes emtpy state")
    text = "generate printable QR codes from the empty state"
    arr = F.array(*[F.lit(g) for g in q])
    ((s, g, none),) = one(spark, [(text,)], "t string", T.similarity(arr, T.gram_set(F.col("t"))), T.grams_text(T.gram_set(F.lit("ab abcd"))), T.similarity(arr, T.gram_set(F.lit("!!"))))
    assert s >= 0.40 and g == "ab abc bcd" and none == 0


def test_chunks(spark):
    rows = [("k", " ".join(["word"] * 600)), ("s", "  short text\n"), ("e", " \n"), ("x", "a\tb  c " * 100)]
    got = chunking.chunk_entries(spark.createDataFrame(rows, "entry_key string, text string")).collect()
    n = {k: sorted(r["part"] for r in got if r["entry_key"] == k) for k in "ksex"}
    assert n == {"k": [0, 1, 2], "s": [0], "e": [], "x": [0, 1]}
    assert all(len(r["text_hash"]) == 64 for r in got) and len({r["chunk_key"] for r in got}) == 6
    assert [r["text"] for r in got if r["entry_key"] == "s"] == ["short text"]
    last = [r["text"] for r in got if r["entry_key"] == "k" and r["part"] == 2][0]
    assert len(last.split()) == 180


def test_titles(spark):
    got = one(spark, [("\n  a   b \nc",), ("",), ("x" * 150,), (None,)], "t string", T.first_line_title(F.col("t")))
    assert [g[0] for g in got] == ["a b", "Untitled session", "x" * 99 + "…", "Untitled session"]
    got = one(spark, [("pi", "1", "/a b"), ("zed", "1", "/a"), ("codex", "it's", "")], "h string, i string, c string", T.resume_hint(F.col("h"), F.col("i"), F.col("c")))
    assert [g[0] for g in got] == ["cd '/a b' && pi --session '1'", "", "codex resume 'it'\"'\"'s'"]


@pytest.mark.parametrize("raw", ["git@Example.com:owner/repository.git", "https://example.com/owner/repository", "ssh://git@example.com:22/owner/repository.git"])
def test_remotes(spark, raw):
    assert identity.remote_name(raw) == "example.com/owner/repository"
    assert one(spark, [(raw,)], "t string", identity.normalize_remote(F.col("t"))) == [("example.com/owner/repository",)]


def test_no_remote(spark):
    bad = ["", "file:///x/y", "ftp://h/p", "nothing", "https:///x"]
    assert [identity.remote_name(b) for b in bad] == [""] * 5
    assert one(spark, [(b,) for b in bad], "t string", identity.normalize_remote(F.col("t"))) == [("",)] * 5


def test_remotes_in_the_jvm(spark):
    """The column and the driver's function agree."""
    rng = random.Random(4)
    parts = ["https://", "ssh://", "git@", "HTTP://", "h.Org", "[::1]", ":22", ":", "/", "o%20r", "a+b", ".git", "?q", "#f", " ", "x@y", "//", "é", "%zz", "\t", "ftp://"]
    raw = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(800)] + [None]
    raw = [r for r in raw if r is None or not ("%zz" in r and "%20" in r)]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, t string").select("i", identity.normalize_remote(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: identity.remote_name(r) for i, r in enumerate(raw)}


def test_times(spark):
    from quern.functions import times

    said = {
        "2026-01-01T00:00:00Z": 1767225600000, "2026-01-01T00:00:00.5Z": 1767225600500, "2026-01-01T01:00:00.123456+01:00": 1767225600123, "2026-01-01T00:00:00-05:30": 1767245400000,
        "2026-07-29": None, "2026-13-01T00:00:00Z": None, "2026-02-30T00:00:00Z": None, "2026-01-01 00:00:00Z": None, "2026-01-01T00:00:00": None, "": None, "soon": None, None: None,
    }
    got = spark.createDataFrame([(k,) for k in said], "t string").select("t", times.rfc3339_millis(F.col("t")).alias("ms"), times.bound_millis(F.col("t"), True).alias("last")).collect()
    assert {r["t"]: r["ms"] for r in got} == said
    last = {r["t"]: r["last"] for r in got}
    assert last["2026-07-29"] == filters.parse_date("2026-07-29", True) and last["2026-01-01T00:00:00Z"] == 1767225600000 and last["soon"] is None


def test_record_names_in_the_jvm(spark):
    from quern.sources import records

    names = ["m_abc123.json", "m_abc123.json.bak", "m_ABC123.json", "m_a.json", "x.sync-conflict-20260101-000000-AbC.json", "x.SYNC-conflict-20260101-000000-1.JSON", "x.sync-conflict-2026-1.json", "m_abc123.json\n", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(records.id_column(F.col("n")), records.canonical_column(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(records.id_of(n), records.canonical(n)) for n in names]


def test_stable_key(spark):
    ((k,),) = one(spark, [("é", "b")], "a string, b string", identity.stable_key("x", F.col("a"), F.col("b")))
    assert k == identity.stable_key_of("x", "é", "b")


def test_vectors(spark):
    rows = [([1.0, -0.5, 0.25],), ([0.0, 0.0, 0.0],), ([1.0],), (None,)]
    df = spark.createDataFrame(rows, "v array<float>")
    got = df.select(vectors.decode(vectors.encode("v")), vectors.dot(F.col("v"), vectors.vector([1, 0, 2])), vectors.normalized(F.col("v"))).collect()
    assert got[0][0] == [1.0, -0.5, 0.25] and got[0][1] == 1.5 and got[1][2] is None and got[2][1] is None
    assert [r["similarity"] for r in vectors.similarities(df, "v", [1, 0, 2]).collect()] == [1.5, 0.0, None, None]
    bad = spark.createDataFrame([(b"",), (b"abc",)], "b binary").select(vectors.decode("b")).collect()
    assert [r[0] for r in bad] == [None, None]


def test_filters():
    assert filters.parse_date("2024-01-02") == 1704153600000 and filters.parse_date("2024-01-02", True) == 1704239999999
    assert filters.parse_date("2024-01-02T00:00:00Z") == 1704153600000
    for bad in (lambda: filters.SessionFilters(limit=101), lambda: filters.SessionFilters(harnesses=("x",)), lambda: filters.SessionFilters(roles=("system",)), lambda: filters.check_threshold(float("nan"))):
        with pytest.raises(ValueError):
            bad()
    assert filters.SessionFilters(limit=0).limit == 3


def test_path_filter(spark):
    got = one(spark, [("/w/P",), ("/w/P/x",), ("/W/p/x",), ("/w/p",), ("/w/Px",), ("/w/P%",)], "c string", filters.path_prefix(F.col("c"), "/w/P/"))
    assert [g[0] for g in got] == [True, True, True, False, False, False]


def test_bm25_like_fts5(spark):
    """Scores equal those of SQLite's full-text index."""
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30))), " ".join(rng.choices(vocabulary, k=rng.randint(0, 4)))) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(a, b)")
    con.executemany("insert into t(rowid, a, b) values (?, ?, ?)", docs)
    want = dict(con.execute("select rowid, bm25(t, 1.0, 3.0) from t where t match '\"alpha\" OR \"omega\" OR \"alpha\"'"))
    df = spark.createDataFrame(docs, "id long, a string, b string").select("id", T.tokens(F.col("a")).alias("ta"), T.tokens(F.col("b")).alias("tb"))
    w = {"ta": 1.0, "tb": 3.0}
    query = ["alpha", "omega", "alpha"]
    got = {r["id"]: r["bm25"] for r in bm25.score_scan(df, w, query).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    rows = df.select(F.col("id").cast("string").alias("row_id"), "ta", "tb", F.array().cast("array<string>").alias("grams"))
    index = segments.Index([segments.segment(rows, None, w)])
    also = {int(r["row_id"]): r["raw"] for r in segments.scores(index, segments.WORD, query).collect()}
    assert also.keys() == want.keys() and all(abs(also[k] - want[k]) < 1e-9 for k in want)


def channel(spark, keys):
    rows = [(f"{k}{i}", k[0], "" if k.startswith("!") else f"text {k}", 1.0, 5, i + 1) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "row_id string, group_key string, text string, raw double, updated_at long, pos long")


def test_fusion_example(spark):
    parts = {"exact": channel(spark, ["A"]).withColumn("text", F.lit("")), "lexical": channel(spark, ["B", "B", "A"]), "fuzzy": channel(spark, ["A"]), "semantic": channel(spark, ["C"])}
    got = {r["group_key"]: r for r in fusion.fuse(parts, 10, True).collect()}
    a = got["A"]
    assert abs(a["score"] - (4 / 61 + 1 / 62 + 1 / 61)) < 1e-9 and (a["exact_rank"], a["lexical_rank"], a["fuzzy_rank"], a["semantic_rank"]) == (1, 2, 1, None)
    assert a["text"] == "text A" and a["row_id"] == "A0" and abs(got["B"]["score"] - 1 / 61) < 1e-9 and got["C"]["similarity"] == 1.0


def test_fusion_random(spark):
    """Against a plain model of the fusion."""
    rng = random.Random(3)
    for _ in range(2):
        lists = {n: [rng.choice("ABCDEFG") for _ in range(rng.randint(0, 9))] for n, _ in fusion.WEIGHTS}
        want: dict = {}
        for (name, w), keys in zip(fusion.WEIGHTS, lists.values(), strict=True):
            for rank, k in enumerate(dict.fromkeys(keys), 1):
                want[k] = want.get(k, 0) + w / (60 + rank)
        got = {r["group_key"]: r["score"] for r in fusion.fuse({n: channel(spark, k) for n, k in lists.items()}, 100, True).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_coverage():
    assert [channels.least_coverage(["a"] * n) for n in (1, 3)] == [1, 1]
    assert [channels.least_coverage(list("abcdefg")[:n]) for n in (2, 3, 4, 7)] == [1, 1, 2, 3]


def test_similar_texts_with_a_common_trigram(spark, monkeypatch):
    """Trigrams that most rows have are not asked for; rows, shares and ties are those of brute force."""
    from quern.operators import blocks

    rng = random.Random(9)
    rare = [f"g{i}" for i in range(400)]
    rows = [(i, ["the", "ion", *(["sel"] if i % 2 else []), *rng.sample(rare, rng.randint(0, 30))]) for i in range(3000)]
    asked = [(q, ["the", "ion", *rng.sample(rare, 12)]) for q in range(6)] + [(6, []), (7, ["none"]), (8, ["the"])]
    want = []
    for q, grams in asked:
        found = sorted((-round(len(set(grams) & set(g)) / len(grams), 9), i) for i, g in rows) if grams else []
        want += [(q, i, -s) for s, i in [f for f in found if -f[0] >= 0.25][:20]]
    df = spark.createDataFrame(rows, "key bigint, grams array<string>")
    ask = spark.createDataFrame(asked, "key bigint, grams array<string>")
    for size in (100, 10**6):
        got = blocks.similar_texts(df, ask, key="key", k=20, sample_rows=size)
        assert sorted((r["query"], r["key"], r["similarity"]) for r in got.collect()) == sorted(want)
        monkeypatch.setattr(blocks, "MOST_GRAMS", 0)


def test_nearest_keeps_order_of_single_rows(spark):
    """Matrix products choose, single products decide; keys may be strings, a least similarity bounds."""
    import numpy as np

    from quern.operators import blocks

    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[500:600] = x[100]  # ties
    q = rng.normal(size=(5, 16)).astype(np.float32)
    q[0] = x[100]
    df = spark.createDataFrame([(f"r{i:04d}", v.tolist()) for i, v in enumerate(x)] + [("short", [1.0]), ("none", None)], "name string, v array<float>").repartition(3)
    ask = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "no int, v array<float>")
    want = []
    for i, v in enumerate(q):
        sums = [(-round(float((r * v).astype(np.float64).sum()), 9), f"r{n:04d}") for n, r in enumerate(x)]
        want += [(i, name) for s, name in sorted(sums)[:30] if -s >= 1.0]
    got = blocks.nearest(df, ask, key="name", query="no", vector="v", k=30, least=1.0)
    assert sorted((r["query"], r["key"]) for r in got.collect()) == sorted(want)


def test_normalize_looks_no_letter_up(spark):
    """The final sigma is replaced as a string; a table look-up a letter took a third of the time."""
    rows = spark.createDataFrame([("ΟΔΟΣ ΣΑΣ",), ("abc DEF",), ("",)], "text string").select(T.normalize(F.col("text")).alias("n"))
    assert "translate(" not in rows._jdf.queryExecution().analyzed().toString()
    assert [r["n"] for r in rows.collect()] == ["οδοσ σασ", "abc def", ""]
