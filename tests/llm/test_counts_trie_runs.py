"""Token counts, the prefix trie and periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import chat_format, periodic_runs, prefix_trie, queries, token_counts

from . import tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    return tables.write(tmp_path_factory.mktemp("sf"))


# 11


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(chat_format.TOKENIZER)


def odd_texts():
    rng = random.Random(5)
    parts = ["a", "B1", " ", "  ", "\n", "\t", ".", "é", "漢字", "Ω", " ", "　", "​", "\x1c", "\x85", "'s", "'ll", "<|endoftext|>", "<|endof", "𝔘", "ৎ", "१२", "word", "١"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(1500)]
    return [*made, None, "", " ", "<|endoftext|>", "x" * 5000, " " * 3000, "ab " * 4000 + "end", "<|endoftext|> <|endoftext|>\n"]


def test_tokens_are_the_librarys(spark, library):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n", F.lit(1)).withColumn("rid", F.lit("x"))
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    for most, held in ((token_counts.MOST, token_counts.HELD), (20, 50), (0, 10**6)):  # all known, most of them joined, all joined
        rows = token_counts.count_tokens(docs, chat_format.TOKENIZER, most=most, held=held).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows} == want and len(rows) == len(texts)


def test_tokens_query(spark, sf, library):
    docs = pq.read_table(f"{sf}/documents.parquet").select(["doc_id", "text"]).to_pylist()
    want = sorted(((d["doc_id"], len((d["text"] or "").encode()), n := len(library.encode(d["text"] or "", add_special_tokens=False).ids), n > 1024) for d in docs), key=repr)
    assert sorted((tuple(r) for r in queries.op11_token_counts(spark, sf).collect()), key=repr) == want


def test_pattern_and_library_agree_on_plain_characters(library):
    for i in range(ord(token_counts.PLAIN)):
        c = chr(i)
        s = f"a{c}b1{c}2 {c} {c}"
        assert [s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)] == token_counts._CUT.findall(s), hex(i)
        assert not c.isalpha() or token_counts._CUT.findall(f" {c}{c}") == [f" {c}{c}"], hex(i)


def test_frequent_pre_tokens_are_bounded(spark):
    rows = [(f"w{i}", 1 + i % 7, 1) for i in range(500)] + [("x" * 200, 10**9, 40)]
    found = spark.createDataFrame(rows, "pre_token string, n bigint, pieces bigint")
    for most in (0, 60, 300, 10_000):
        got = found.where(token_counts.frequent(found, most)).collect()
        assert len(got) <= most and all(len(r["pre_token"]) <= token_counts.SHORT for r in got)
        rest = [r for r in found.collect() if r not in got and len(r["pre_token"]) <= token_counts.SHORT]
        assert not got or not rest or max(r["n"] for r in rest) < min(r["n"] for r in got)


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Cutter(open("/opt/tokenizers/word_bpe_49k.json", encoding="utf-8").read())


# 12


def brute_trie(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids.get(node, [])) or 1
        saved[node] = sum(saved[k] for k in kids.get(node, [])) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n], sha(ends.get(n, []))) for n, m in members.items())


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_trie_of_whole_conversations(spark):
    rng = random.Random(8)
    comb = [("user", f"step {i}") for i in range(300)]
    convs = {i: comb[: i + 1] + [("assistant", "off")] for i in range(0, 300, 3)}  # a branch at every third turn
    convs |= {1000 + i: [("user", "the same start"), ("assistant", "the same answer")] for i in range(400)}  # a third of all rows end at one node
    convs |= {2000 + i: [("user", rng.choice("ab")) for _ in range(rng.randint(1, 6))] for i in range(200)}
    convs |= {-5: comb, 3000: comb[:150]}
    rows = [(c, d, r, t) for c, turns in convs.items() for d, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = prefix_trie.prefix_trie(*prefix_trie.whole_conversations(prefix_trie.ordered_turns(df)))
    assert sorted((tuple(r[c] for c in TRIE) for r in out.collect()), key=repr) == sorted(brute_trie(convs), key=repr)


def test_trie_query_by_brute_force(spark, sf):
    rows = [r for r in pq.read_table(f"{sf}/conversations.parquet").to_pylist() if r["conv_id"] is not None]
    mark = lambda r: hashlib.md5(f"{len((r['role'] or '').encode())}:{r['role'] or ''}{r['text'] or ''}".encode()).hexdigest()[:30]
    turns = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"] is not None, r["turn"] or 0, mark(r))):
        turns.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    built = {c: turns.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + own[h:] for c, own in turns.items()}
    got = queries.op12_prefix_trie(spark, sf).collect()
    assert sorted((tuple(r[c] for c in TRIE) for r in got), key=repr) == sorted(brute_trie(built), key=repr)


def test_peeling_ends_with_the_root(spark):
    rng = random.Random(3)
    rows, total = [(0, None, None, 5)], {0: 5}
    for i in range(1, 60):
        rows.append((i, rng.randrange(max(0, i - 3), i), i, 1))
    paths = spark.createDataFrame(rows, "path bigint, up bigint, at bigint, saved bigint")
    got = prefix_trie.peel(paths).collect()
    assert len(got) == 60
    last = [r for r in got if r["up"] is None]
    assert len(last) == 1 and last[0]["leaves"] == 60 and last[0]["saved"] == 5 + 59 and total


# 13


def brute_runs(words, least=24, times=3):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, size, q) for (s, size), q in out.items())


def test_runs_by_brute_force():
    rng = random.Random(2)
    for k in range(1500):
        n, letters = rng.randint(0, 130), rng.choice([1, 2, 3, 5, 50])
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 5:
                a, p = rng.randrange(n), rng.randint(1, 12)
                for i in range(a + p, min(n, a + p * rng.randint(2, 8) + rng.randrange(p))):
                    words[i] = words[i - p]
        least, times = (24, 3) if k % 3 else rng.choice([(6, 2), (10, 3), (1, 2), (8, 4)])
        assert periodic_runs.find_runs([str(w).encode() for w in words], least, times) == brute_runs(words, least, times), words


def test_runs_of_long_texts():
    line = [b"w%d" % (i % 40_000) for i in range(200_000)]
    assert periodic_runs.find_runs(line) == [(0, 200_000, 40_000)]
    assert periodic_runs.find_runs([b"na"] * 100_000 + [b"end"] + [b"na"] * 30) == [(0, 100_000, 1), (100_001, 30, 1)]
    assert periodic_runs.find_runs([b"%d" % i for i in range(30_000)]) == []


def test_runs_query(spark, sf, tmp_path):
    docs = pq.read_table(f"{sf}/documents.parquet").select(["doc_id", "text"]).to_pylist()
    want = []
    for d in docs:
        words = WORD.findall(d["text"] or "")
        n = len(words)
        if d["doc_id"] is not None and n and (h := zlib.crc32(str(d["doc_id"]).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words) if n < 3000 else periodic_runs.find_runs([w.encode() for w in words])
        best = min(runs, key=lambda r: (-(1000 * 10**12 * r[1] // r[2]), r[0], r[2]), default=None)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((d["doc_id"], len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in got) > 5


def test_collapsed_text(spark):
    song = "la " * 30 + "and then " + "one two three " * 9 + "end"
    docs = spark.createDataFrame([(1, song), (2, None), (None, "a b"), (3, " \n ")], "doc_id bigint, text string").withColumn("runs", F.lit(0))
    got = {r["doc_id"]: r for r in periodic_runs.collapse_runs(docs).collect()}
    assert got[1]["collapsed"] == "la and then one two three end" and [tuple(r) for r in got[1]["runs"]] == [(0, 30, 1), (32, 27, 3)]
    assert (got[1]["start"], got[1]["length"], got[1]["period"], got[1]["exponent_milli"]) == (0, 30, 1, 30_000)
    assert got[None]["collapsed"] == "a b" and got[2]["collapsed"] == got[3]["collapsed"] == "" and got[2]["n_runs"] == 0 and got[2]["start"] is None
