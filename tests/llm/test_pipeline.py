import collections
import hashlib
import math
import random
import re

import zstandard

import corpus_pipeline
from quern.llm import decontam, mixing, quality, simhash

from . import tables
from .test_operators import WORD, fingerprint, groups, lower, plain_shards

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_kept(docs):
    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    return [d for d in docs if quality.judge((d[1] or "").encode(), len(d[1] or ""), packer)[6]]


def own_judge(text, usual):
    """The verdict on a text, written anew: base rules, whole text and chunks against limits that lie between the table's and the curve's."""
    raw, pack = text.encode(), zstandard.ZstdCompressor(level=3).compress
    words = raw.split()
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {p for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    if len(words) < 20 or 100 * len(again) > 30 * len(words):
        return False

    def inside(part):
        n = len(part)
        low, high = [b[1:] for b in quality.BANDS if n >= b[0]][-1]
        if n >= 200 and math.log(n) <= usual.longest:
            x = (max(usual.shortest, math.log(n)) - 6) / 3
            mean = sum(c * x**k for k, c in enumerate(reversed(usual.mean)))
            spread = math.exp(sum(c * x**k for k, c in enumerate(reversed(usual.spread))))
            low += usual.trust * max(0, mean - usual.reach * spread - low)
        ratio = len(pack(part)) / n
        counts = collections.Counter(part).values()
        bits = -sum(c / n * math.log2(c / n) for c in counts) / 8
        gain = [g for least, g in ((0, 0.0), (1000, 1.05), (1500, 1.02), (3000, 1.005), (8192, 0.99)) if n >= least][-1]
        return ratio >= low and not (ratio > high and ratio > gain * bits)

    n = max(1, len(raw) // 1024)
    chunks = [raw[i * 1024 : (i + 1) * 1024 if i < n - 1 else None] for i in range(n)]
    return inside(raw) and sum(not inside(c) for c in chunks) < max(1, 0.2 * n)


def test_first_stage_with_learned_limits(spark, tmp_path):
    """150 good labels and 50 bad ones: the stage keeps what an own judge keeps, by limits that the table doesn't have."""
    rng = random.Random(6)
    vocabulary = [tables.sentence(rng, 1) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, labels = [], []
    for i in range(260):
        bad = i % 4 == 3
        text = prose(rng.randint(40, 900))
        if bad:  # phrases of seven words again and again: no window of eight words repeats, but the text compresses
            phrases = [prose(7) for _ in range(6)]
            text = " ".join(f"{rng.choice(phrases)} {rng.choice(vocabulary)}{j}" for j in range(rng.randint(20, 90)))
        docs.append((i, text, "s", "en", len(text)))
        if i < 200:
            labels.append((i, int(not bad), 0))
    sf = tmp_path / "sf"
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    df = spark.read.parquet(f"{sf}/documents.parquet")
    usual = quality.fit(df, spark.read.parquet(f"{sf}/labels.parquet"))
    assert usual.trust > 0.8
    want = {i for i, text, *_ in docs if own_judge(text, usual)}
    got = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, df, str(sf)).collect()}
    assert got == want
    by_table = {r["doc_id"] for r in quality.keep_documents(df).collect()}
    assert got < by_table and {i for i in range(260) if i % 4 < 3} <= got


def plain_contaminated(text, items):
    words = ITEM_WORD.findall(lower(text))
    hit = set()
    for item in items:
        own = ITEM_WORD.findall(lower(item))
        m = min(13, len(own))
        windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if m else set()
        hit |= {p for i in range(len(words) - m + 1) if tuple(words[i : i + m]) in windows for p in range(i, i + m)}
    return bool(hit) and 20 * len(hit) >= len(words)


def plain_mix(docs):
    """The documents of the mix, whole and in part."""
    size = lambda d: len(WORD.findall(d[1] or ""))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sources = sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    plan = mixing.plan([sum(size(d) for d in docs if d[2] == s) for s in sources])
    out = []
    for source, p in zip(sources, plan, strict=True):
        at = 0
        for d in sorted((d for d in docs if d[2] == source), key=lambda d: (md5(f"{mixing.SEED}:{'-' if d[0] is None else d[0]}"), md5(d[1] or ""))):
            n = size(d)
            rounds, lead = divmod(p["quota"], max(1, p["blocks"]))
            taken = rounds * n + max(0, min(at + n, lead * mixing.BLOCK_TOKENS) - at)
            at += n
            if n:
                pieces = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", d[1])
                out += [(d[0], d[1])] * (taken // n) + ([(d[0], "".join(pieces[: taken % n]))] if taken % n else [])
    return out


def test_pipeline_by_brute_force(spark, tmp_path):
    """Every stage against plain Python."""
    sf = tables.write(tmp_path / "sf")
    docs = tables.documents()[0]
    docs = [d for i, d in enumerate(docs) if d not in docs[:i]]  # repeated rows have tests of their own
    spark.read.parquet(f"{sf}/documents.parquet").dropDuplicates(["doc_id", "text", "source"]).write.parquet(f"{tmp_path}/in")
    now = spark.read.parquet(f"{tmp_path}/in")
    items = [t for t in tables.documents()[1] if t]
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{tmp_path}/{n}")
        now = spark.read.parquet(f"{tmp_path}/{n}")
        if n == 0:
            docs = plain_kept(docs)
        elif n == 1:
            label = groups([fingerprint(t) for _, t, _ in docs])
            best = {}
            for g, d in zip(label, docs, strict=True):
                best[g] = min(best.get(g, d), d, key=lambda d: (d[0] is None, d[0] or 0))
            docs = list(best.values())
        elif n == 2:
            docs = [d for d in docs if not plain_contaminated(d[1], items)]
        elif n == 3:
            mixed = plain_mix(docs)
            assert rows(now) == sorted(mixed, key=repr) and len({r[0] for r in mixed}) < len(mixed)
            continue
        else:
            want = collections.Counter((i, size, s, t) for i, size, _, s, _, t in plain_shards(mixed))
            assert collections.Counter((r["doc_id"], r["size"], r["shard"], r["text"]) for r in now.collect()) == want
            continue
        assert rows(now) == sorted((d[:2] for d in docs), key=repr), n


def test_pipeline(spark, tmp_path):
    sf = tables.write(tmp_path / "sf")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n < 4:
            assert docs.columns == before.columns
        if n == 0:
            want = quality.quality_rules(before).where("kept").count()
            assert 0 < docs.count() == want < before.count()
        if n == 1:
            found = simhash.near_duplicates(before)
            assert docs.count() == found.select("root").distinct().count() < before.count()
            assert {r["doc_id"] for r in docs.collect()} == {r["component_id"] for r in found.collect()}
        if n == 2:
            items = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert 0 < docs.count() == decontam.decontaminate(before, items).where("not contaminated").count() < before.count()
        if n == 4:
            assert docs.count() == before.count() and {"shard", "slot"} <= set(docs.columns)
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, docs.collect()))


def test_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables.write(tmp_path / "sf", empty=True)).count() == 0
