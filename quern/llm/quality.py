"""Quality rules: word statistics and zstandard compression bands.

The verdict of the method comes from compression ratios (compressed bytes over
raw bytes).  The whole document is compressed once, and then each fixed chunk
on its own: a whole-document ratio sees repetition at any distance, chunk
ratios see a document of which only a part is junk: a fifth of the chunks
outside their band rejects it.  Text that repeats itself compresses too well,
keyboard noise or encoded data too badly; what is usual depends on the length, so
the limits do.  Upper limits are a table by length (:data:`BANDS`), as noise is the
same everywhere.  Lower limits are learned (:func:`fit`): from labelled documents
that pass the base rules, a curve of the usual ratio and one of its spread by
length; the limit lies so many spreads below the curve as tells documents of
quality 0 from those of quality 1 best, where a good one lost counts
``LOSS`` times as much as a bad one found.

Learning takes a bounded sample: of each label the ``PER_CLASS`` documents with the
smallest id hashes.  A limit is a mean of the learned one and the table's, in which the
learned one weighs (n - ``FEWEST``) / (n - ``FEWEST`` + ``PRIOR``) with n good documents:
few labels move the table's limits little, and without labels of both kinds those hold.

Defined results:

* null text counts as the empty text: all counts 0, ``base_failed`` true;
* an empty or white-space-only text is the same;
* texts shorter than the first band's length get no ratio limit;
* units with many bytes outside ASCII (other scripts) have the table's lower limit;
* equal rows get equal results, row by row; an empty table gives no rows;
* labels that are null, neither 0 nor 1, or without a document teach nothing; of
  several labels of an id the smaller holds;
* columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, as_bytes, cut, map_batches

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
CHUNK = 1024
LEVEL = 3

#: (shortest length in bytes, lowest ratio, highest ratio) of a unit, be it a
#: whole document or one chunk.  The upper limits lie above prose and, from 200
#: bytes, below base64; from 1000 bytes also below random lower-case letters, from
#: 3000 below hex.  Shorter keyboard noise compresses as prose of its length does.
BANDS = (
    (0, 0.0, float("inf")),
    (200, 0.30, 0.88),
    (300, 0.30, 0.84),
    (400, 0.30, 0.80),
    (500, 0.30, 0.76),
    (700, 0.30, 0.71),
    (1000, 0.25, 0.60),
    (1250, 0.25, 0.585),
    (1500, 0.25, 0.57),
    (2000, 0.25, 0.54),
    (3000, 0.22, 0.515),
    (4096, 0.22, 0.49),
    (8192, 0.22, 0.46),
    (10000, 0.20, 0.46),
    (16000, 0.20, 0.445),
)

#: A unit over its band's upper limit is kept all the same if it is compressed below
#: this multiple of its bytes' entropy: scripts of many bytes and upper-case prose have
#: a high entropy, but repeat themselves, which noise doesn't.  (shortest length, multiple)
GAINS = ((0, 0.0), (1000, 1.05), (1500, 1.02), (3000, 1.005), (8192, 0.99))
#: Below this length repetition tells nothing; units with a share of bytes outside
#: ASCII above MULTIBYTE have no upper limit there.
SHORT, MULTIBYTE = 1500, 0.25

HEX = b"0123456789abcdefABCDEF"
ASCII = bytes(range(128))
#: Hexadecimal text counts as incompressible if its decoded bytes have a higher ratio.
HEX_RATIO = 0.9

#: Share of chunks outside their band from which a document is rejected.
BAD_CHUNKS = 0.2

#: Bound of the labelled sample: documents of each label.
PER_CLASS = 2000
#: Good documents that a curve needs, and how many more weigh as much as the table.
FEWEST, PRIOR = 8, 20
#: A good document lost weighs as many bad ones found.
LOSS = 25
#: Spreads below the curve that a limit may lie.
REACHES = tuple(2.5 + 0.25 * i for i in range(23))
#: Shortest unit with a learned limit, in bytes.
LEAST = 200
SEED = 42

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, zstd_ratio double, n_chunks bigint, n_bad_chunks bigint"
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words that the text has twice or more."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    if len(ids) == n:
        return 0
    # a fixed pseudo-random 64-bit value per word, then a polynomial over the window (mod 2**64)
    x = (codes + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    m = n - window + 1
    h = x[:m].copy()
    for k in range(1, window):
        h *= np.uint64(0x100000001B3)
        h += x[k : k + m]
    order = np.argsort(h, kind="stable")
    hs = h[order]
    same = hs[1:] == hs[:-1]
    if not same.any():
        return 0
    rows = np.flatnonzero(same)
    wins = np.lib.stride_tricks.sliding_window_view(codes, window)
    if (wins[order[rows]] != wins[order[rows + 1]]).any():  # a hash collision: count exactly
        groups: dict[tuple, list[int]] = {}
        for i in range(m):
            groups.setdefault(tuple(codes[i : i + window]), []).append(i)
        starts = np.array(sorted(i for g in groups.values() if len(g) > 1 for i in g), dtype=np.int64)
    else:
        twice = np.zeros(m, dtype=bool)
        twice[order[rows]] = True
        twice[order[rows + 1]] = True
        starts = np.flatnonzero(twice)
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


def band_of(size: int, bands=BANDS) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for least, a, b in bands:
        if size >= least:
            low, high = a, b
    return low, high


@dataclass(frozen=True)
class Usual:
    """What ratio good text has at its length: curves over the logarithm of its bytes."""

    mean: tuple[float, ...]
    spread: tuple[float, ...]
    shortest: float
    longest: float
    reach: float
    trust: float = 1.0

    def curves(self, size: float) -> tuple[float, float]:
        """The usual ratio and its spread."""
        x = (max(self.shortest, math.log(size)) - 6) / 3
        return float(np.polyval(self.mean, x)), math.exp(float(np.polyval(self.spread, x)))

    def lowest(self, size: int) -> float:
        """The lower limit; none beyond the lengths it was learned from, where the chunks decide."""
        if math.log(size) > self.longest:
            return 0.0
        mean, spread = self.curves(size)
        return mean - self.reach * spread

    def limit(self, size: int, low: float) -> float:
        """The lower limit, drawn to the table's ``low`` as far as few labels can't be trusted."""
        return low + self.trust * max(0.0, self.lowest(size) - low)


def learn(sizes: np.ndarray, ratios: np.ndarray, good: np.ndarray) -> Usual | None:
    """Curves of the good units by robust least squares, and the reach that tells bad from good."""
    n = int(good.sum())
    if n <= FEWEST or good.all():  # the learned limits would have no weight, or nothing to tell from
        return None
    logs = np.log(sizes)
    ends = np.quantile(logs[good], [0.01, 0.99])
    x = (np.clip(logs, *ends) - 6) / 3
    design = np.vander(x[good], 4)
    own = ratios[good]
    mean = np.linalg.lstsq(design, own, rcond=None)[0]
    for _ in range(5):
        off = np.abs(own - design @ mean)
        weight = 1 / np.sqrt(np.maximum(1, off / max(1e-9, 2 * 1.4826 * np.median(off))))
        mean = np.linalg.lstsq(design * weight[:, None], own * weight, rcond=None)[0]
    off = np.abs(own - design @ mean)
    parts = np.array_split(np.argsort(x[good], kind="stable"), max(2, min(20, n // 40)))
    middle = [x[good][p].mean() for p in parts]
    level = [math.log(max(1e-4, 1.4826 * np.median(off[p]))) for p in parts]
    spread = np.polyfit(middle, level, 1) if np.ptp(middle) > 1e-9 else np.array([0.0, max(level)])
    below = (np.polyval(mean, x) - ratios) / np.exp(np.polyval(spread, x))
    reach = max(REACHES, key=lambda r: ((below[~good] > r).sum() - LOSS * (below[good] > r).sum(), r))
    return Usual(tuple(map(float, mean)), tuple(map(float, spread)), *map(float, ends), reach, (n - FEWEST) / (n - FEWEST + PRIOR))


def entropy(raw: bytes) -> float:
    """Entropy of the single bytes over their eight bits: the ratio of a coder that knows no repetition."""
    p = np.bincount(np.frombuffer(raw, dtype=np.uint8)) / len(raw)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum() / 8)


def incompressible(raw: bytes, ratio: float, high: float) -> bool:
    """Whether a unit of ``ratio`` over the limit ``high`` is noise, not prose with many different bytes."""
    if ratio <= high:
        return False
    n = len(raw)
    if n < SHORT and len(raw.translate(None, ASCII)) > MULTIBYTE * n:
        return False
    return ratio > [m for least, m in GAINS if n >= least][-1] * entropy(raw)


def encoded(raw: bytes, packer) -> bool:
    """Whether a unit is nothing but hexadecimal digits of incompressible bytes."""
    if raw[:64].translate(None, HEX + WS) or raw.translate(None, HEX + WS):
        return False
    digits = raw.translate(None, WS)
    if digits.isdigit():
        return False
    data = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
    return len(packer.compress(data)) > HEX_RATIO * len(data)


def lowest(raw: bytes, low: float, usual: Usual | None) -> float:
    """The lower limit of a unit: the table's or, for long enough text of few bytes outside ASCII, the learned one."""
    if usual is None or len(raw) < LEAST or len(raw.translate(None, ASCII)) > MULTIBYTE * len(raw):
        return low
    return usual.limit(len(raw), low)


def fits(raw: bytes, ratio: float, packer, bands=BANDS, usual: Usual | None = None) -> bool:
    """Whether a unit lies in its band."""
    low, high = band_of(len(raw), bands)
    return lowest(raw, low, usual) <= ratio and not incompressible(raw, ratio, high) and not (high < float("inf") and encoded(raw, packer))


def compression(raw: bytes, packer, chunk: int = CHUNK, bands=BANDS, usual: Usual | None = None) -> tuple[float, int, int, bool]:
    """Whole ratio, chunks, chunks outside their band, and whether the whole lies in its band."""
    n = len(raw)
    if not n:
        return 1.0, 0, 0, True
    ratio = len(packer.compress(raw)) / n
    inside = fits(raw, ratio, packer, bands, usual)
    bad, chunks = 0, max(1, n // chunk)  # the rest joins the last chunk
    if chunks == 1:
        bad = not inside
    else:
        for i in range(chunks):
            part = raw[i * chunk : (i + 1) * chunk if i < chunks - 1 else n]
            bad += not fits(part, len(packer.compress(part)) / len(part), packer, bands, usual)
    return ratio, chunks, int(bad), inside


def base_rules(raw: bytes) -> tuple[int, int, bool]:
    """Words, words in repeated windows, and whether the base rules fail."""
    words = raw.split()
    n, repeat = len(words), repeated_words(words)
    return n, repeat, n < 20 or 100 * repeat > 30 * n


def judge(raw: bytes, cp: int, packer, chunk: int = CHUNK, bands=BANDS, bad_chunks: float = BAD_CHUNKS, usual: Usual | None = None) -> tuple:
    """The row of :data:`SCHEMA` after the id, of one text with ``cp`` code points."""
    n, repeat, failed = base_rules(raw)
    word_chars = cp - (len(raw) - len(raw.translate(None, WS)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    dup = 0
    if b"\n" in raw:
        lines = [x for x in raw.split(b"\n") if x.strip()]
        dup = len(lines) - len(set(lines))
    ratio, chunks, bad, inside = compression(raw, packer, chunk, bands, usual)
    kept = not failed and inside and bad < max(1.0, bad_chunks * chunks)
    return n, word_chars, symbols, dup, repeat, failed, kept, ratio, chunks, bad


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, level: int = LEVEL) -> Usual | None:
    """Learn the lower limits from a bounded sample of labelled documents."""
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    picked = [known.where(F.col("label") == y).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(cut(picked[0].unionByName(picked[1])))  # at most 2 * per_class ids

    def make():
        packer = zstandard.ZstdCompressor(level=level)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for i, y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                few_ascii = len(t.translate(None, ASCII)) > MULTIBYTE * len(t)
                if len(t) >= LEAST and not few_ascii and not base_rules(t)[2]:
                    rows.append((i, y, len(t), len(packer.compress(t)) / len(t)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["doc_id", "label", "n", "ratio"])

        return fn

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).join(sample, "doc_id").select("doc_id", "label", "text")
    made = map_batches(texts, make, "doc_id bigint, label int, n bigint, ratio double")
    # a row an id, however often it stands in the documents
    rows = made.groupBy("doc_id", "label").agg(F.min(F.struct("n", "ratio")).alias("m")).select("label", "m.n", "m.ratio").collect()
    rows.sort()
    return learn(np.array([r["n"] for r in rows], dtype=np.float64), np.array([r["ratio"] for r in rows]), np.array([r["label"] == 1 for r in rows], dtype=bool))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, level: int = LEVEL, bands=BANDS, bad_chunks: float = BAD_CHUNKS, usual: Usual | None = None) -> DataFrame:
    """One verdict per document, in one pass without a shuffle."""

    def make():
        packer = zstandard.ZstdCompressor(level=level)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = batch.column(0), as_bytes(batch.column(1))
            rows = [judge(t, len(t.decode("utf-8", "replace")), packer, chunk, bands, bad_chunks, usual) for t in texts]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *cols], names=[f.split()[0] for f in SCHEMA.split(", ")])

        return fn

    return map_batches(docs.select(id_col, text_col), make, SCHEMA)


def keep_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were.

    The verdict is taken inside the same pass (a Boolean UDF over Arrow), so the
    text is neither joined nor shuffled.
    """
    chunk, level = options.get("chunk", CHUNK), options.get("level", LEVEL)
    bands, bad_chunks, usual = options.get("bands", BANDS), options.get("bad_chunks", BAD_CHUNKS), options.get("usual")

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=level)
        return pa.array([judge(t, len(t.decode("utf-8", "replace")), packer, chunk, bands, bad_chunks, usual)[6] for t in as_bytes(texts)], pa.bool_())

    return docs.where(good(F.col("text")))
