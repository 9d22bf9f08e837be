"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of
its words' features (whole words and word beginnings); the document's score is
the noisy-or of its sentences, 1 - (1 - leak) * prod(1 - p).  Only documents are
labelled: the likelihood of the document labels trains the sentence weights, and
the trained sentence scores locate the offending sentences.

Training takes a bounded sample: of the labelled documents outside the held-out
fold the ``per_class`` of each label with the smallest id hashes, one row an id and
texts of at most ``TRAIN_BYTES`` bytes.  Features are counted on the executors; those
that go with either label beyond chance are kept, by their log-likelihood ratio, however
many they are.  The sample's sentences then come to the driver as lists of feature
numbers, which the two bounds of the sample limit.

Defined results: a null or empty text has no sentence and scores ``leak``;
labels other than 0 and 1, null ids and labels without a document are not used
for training; of several labels of an id the larger holds; without a positive
training label every score is the share of positives (zero); repeated rows get
equal scores; texts are read whole; other columns are never inputs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches

#: Bound of the training sample: documents of each label.
PER_CLASS = 2000
#: Bound of a training text; longer ones aren't learned from (but scored whole).
TRAIN_BYTES = 1 << 20
#: Least log-likelihood ratio of a feature with a label.
LEAST_RATIO = 10.0
PREFIXES = (3, 4, 5, 6, 7)
SEED = 42

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The word and its beginnings; ``w:`` and ``p:`` keep them apart."""
    return [f"w:{word}", *(f"p:{word[:n]}" for n in PREFIXES if len(word) >= n)]


def held_out(id_col: str = "doc_id", folds: int = 5):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


class Model:
    """Weights of features; ``leak`` is the score of a document without sentences."""

    #: Words whose weight is kept at hand.
    MEMO = 200_000

    def __init__(self, weights: dict[str, float], bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak
        self.gate = {f[2:5] for f in weights}
        self.whole = {f[2:]: w for f, w in weights.items() if f[0] == "w"}
        begin: dict[int, dict[str, float]] = {}
        for f, w in weights.items():
            if f[0] == "p":
                begin.setdefault(len(f) - 2, {})[f[2:]] = w
        self.begin = sorted(begin.items())
        self.memo: dict[str, float] = {}

    def word_weight(self, word: str) -> float:
        found = self.memo.get(word)
        if found is None:
            found = self.whole.get(word, 0.0)
            for n, table in self.begin:
                if len(word) < n:
                    break
                found += table.get(word[:n], 0.0)
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def sentence(self, words) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.bias + sum(map(self.word_weight, set(words)))))))

    def score(self, text: str) -> tuple[float, int, int, float, list[int]]:
        """Score, sentences, number and score of the worst one, and the numbers of those at 0.5 or more."""
        gate, weight, bias = self.gate, self.word_weight, self.bias
        plain = self.sentence(())
        plain_miss = math.log1p(-plain)
        n, miss, worst, top, bad = 0, math.log1p(-self.leak), -1, 0.0, []
        for s in _SENTENCE.findall(text.lower()):
            words = [w for w in _WORD.findall(s) if w[:3] in gate]
            if not words:
                if s.isspace():
                    continue
                p, no = plain, plain_miss
            else:
                z = bias + sum([weight(w) for w in set(words)])
                p = 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))
                no = math.log1p(-min(p, 1 - 1e-12))
            miss += no
            if p > top:
                worst, top = n, p
            if p >= 0.5:
                bad.append(n)
            n += 1
        return -math.expm1(miss), n, worst, top, bad


def loss_and_gradient(w: np.ndarray, doc: np.ndarray, sent: np.ndarray, feat: np.ndarray, label: np.ndarray, weight: np.ndarray, n_sent: np.ndarray, penalty: float = 2e-5) -> tuple[float, np.ndarray]:
    """Negative mean log-likelihood of the documents' labels under the noisy-or of their sentences,
    and its gradient.  ``w``: weights of the features, bias, logit of the leak.  ``sent`` and
    ``feat`` are the pairs of sentences with features; ``doc`` is the document of each sentence
    that has any; ``n_sent`` counts all sentences."""
    n_docs, n_feat, total = len(label), len(w) - 2, weight.sum()
    plain_count = n_sent - np.bincount(doc, minlength=n_docs)
    z = np.bincount(sent, w[feat], len(doc)) + w[-2]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    p0 = 1 / (1 + np.exp(-np.clip(w[-2], -30, 30)))
    leak = 1 / (1 + np.exp(-np.clip(w[-1], -30, 30)))
    miss = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n_docs) + plain_count * np.log1p(-p0) + np.log1p(-leak)
    hit = np.maximum(-np.expm1(miss), 1e-9)
    loss = -(weight * np.where(label == 1, np.log(hit), miss)).sum() / total + penalty / 2 * (w[:n_feat] ** 2).sum()
    # d loss / d miss, times -1: weight for label 0, -weight * (1 - P) / P for label 1
    g = weight * np.where(label == 1, -np.exp(miss) / hit, 1.0) / total
    gz = p * g[doc]
    grad = np.zeros_like(w)
    grad[:n_feat] = np.bincount(feat, gz[sent], n_feat)[:n_feat] + penalty * w[:n_feat]
    grad[-2] = gz.sum() + (g * plain_count).sum() * p0
    grad[-1] = g.sum() * leak
    return float(loss), grad


def train_weights(doc: np.ndarray, sent: np.ndarray, feat: np.ndarray, label: np.ndarray, weight: np.ndarray, n_sent: np.ndarray, start: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float, float]:
    """Fit by full-batch Adam."""
    w = np.concatenate([start, [-6.0, -6.0]])  # features, bias, logit of the leak
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        _, grad = loss_and_gradient(w, doc, sent, feat, label, weight, n_sent)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-2], float(w[-2]), float(1 / (1 + np.exp(-w[-1])))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, least_ratio: float = LEAST_RATIO, train_bytes: int = TRAIN_BYTES) -> Model:
    """Train on labelled documents outside the held-out fold."""
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts.get(1) or not counts.get(0):
        share = float(bool(counts.get(1)))
        return Model({}, -30.0, min(max(share, 1e-6), 1 - 1e-6))
    picked = [known.where(F.col("label") == y).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(cut(picked[0].unionByName(picked[1])))  # at most 2 * per_class ids
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= train_bytes).join(sample, "doc_id")
    # a row an id, however often it stands in the documents
    texts = cut(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")))

    def make_sets():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out, owner = [], []
            for i, t in enumerate(batch.column(0).to_pylist()):
                found = {f for w in set(_WORD.findall((t or "").lower())) for f in features_of(w)}
                out += found
                owner += [i] * len(found)
            return pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(1).take(pa.array(owner, pa.int64()))], names=["feature", "label"])

        return fn

    size = {0: 0, 1: 0} | {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    if not size[0] or not size[1]:
        return Model({}, -30.0, 1e-6)
    counted = map_batches(texts.select("text", "label"), make_sets, "feature string, label int").groupBy("feature").agg(F.sum("label").cast("double").alias("a"), F.count("*").cast("double").alias("n"))
    share = size[1] / (size[0] + size[1])
    ratio = f"2 * (if(a > 0, a * ln(a / (n * {share})), 0) + if(n > a, (n - a) * ln((n - a) / (n * {1 - share})), 0))"
    best = counted.withColumn("ratio", F.expr(ratio)).where(f"ratio >= {least_ratio}").orderBy(F.desc("ratio"), "feature").collect()
    names = [r["feature"] for r in best]
    number = {f: i for i, f in enumerate(names)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = {f[2:5] for f in number}
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                n, found = 0, []
                for s in _SENTENCE.findall((t or "").lower()):
                    if s.isspace():
                        continue
                    n += 1
                    ids = {number[f] for w in set(_WORD.findall(s)) if w[:3] in gate for f in features_of(w) if f in number}
                    if ids:
                        found.append(sorted(ids))
                rows.append((n, found))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array([n for n, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.list_(pa.list_(pa.int32())))], names=["doc_id", "label", "n", "bags"])

    got = texts.select("text", "label", "doc_id").mapInArrow(bags, "doc_id bigint, label int, n int, bags array<array<int>>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"], r["n"], r["bags"]))
    doc, sent, feat = [], [], []
    for i, r in enumerate(got):
        for b in r["bags"]:
            sent += [len(doc)] * len(b)
            feat += b
            doc.append(i)
    label = np.array([r["label"] for r in got])
    n_sent = np.array([r["n"] for r in got], dtype=np.float64)
    weight = np.where(label == 1, counts[1] / size[1], counts[0] / size[0])  # back to the labels' own shares
    start = np.array([0.5 * math.log(((r["a"] + 0.5) / (size[1] + 1)) / ((r["n"] - r["a"] + 0.5) / (size[0] + 1))) for r in best])
    w, bias, leak = train_weights(np.array(doc, dtype=np.int64), np.array(sent, dtype=np.int64), np.array(feat, dtype=np.int64), label, weight, n_sent, start)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, bias, leak)


SCHEMA = "doc_id bigint, score double, n_sentences bigint, worst_sentence bigint, worst_score double, offending array<int>"


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Document score, and where the offending sentences are (numbers from 0), in one pass."""
    state = (model.weights, model.bias, model.leak)

    def make():
        m = Model(*state)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [m.score(t or "") for t in batch.column(1).to_pylist()]
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int32()))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], names=[f.split()[0] for f in SCHEMA.split(", ")])

        return fn

    return map_batches(docs.select(id_col, text_col), make, SCHEMA)
