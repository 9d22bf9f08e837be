r"""Runs of periodically repeated words, by a suffix automaton.

A run is a stretch of words with smallest period q (words q apart are equal) of at least
max(``min_words``, ``min_times`` * q) words that no neighbouring word extends.

A text's suffix automaton has a state for each set of end positions of a substring.  In
the order of falling lengths, states merge their ordered end positions into those of
their suffix link, the smaller set into the larger; each position that is inserted gets
neighbours, and a neighbour at distance d that is no larger than the state's length shows
that the state's longest substring overlaps or meets its own repetition: a square, that
is a seed of a run of period d.  Seeds are extended to runs.  The repeated part of a run of
period q is a substring of L - q words whose neighbouring occurrence is q away, so every
run has a seed in a state of at least max(min_words - q, (min_times - 1) * q) words;
states shorter than the least of these (16 by default) needn't be merged.

All words of a run lie in windows of that many words that occur at least twice.  Texts
without such windows have no run; of others, the automaton is built over the stretches
that these windows cover.  The windows are compared by hashes, so a chance collision
makes a stretch longer, but never hides one.

Defined results: a null or blank text has no words and no run; a null id means that no
words are replaced; repeated rows are rows of their own; an empty table gives no rows;
other columns are not looked at.  Texts of any length are handled whole, within one task
(a text is one row); memory is some hundred bytes a word of the stretches.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches

MIN_WORDS, MIN_TIMES = 24, 3
#: Positions in a block of an ordered set.
BLOCK = 1024


class Ends:
    """An ordered set of end positions, in blocks, so an insertion moves few of them."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, position: int):
        self.blocks, self.tops, self.size = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def insert(self, x: int) -> tuple[int, int]:
        """The neighbours that ``x`` gets; -1 where it has none."""
        blocks, tops = self.blocks, self.tops
        b = bisect_left(tops, x)
        if b == len(tops):
            b -= 1
            tops[b] = x
        block = blocks[b]
        i = bisect_left(block, x)
        before = block[i - 1] if i else tops[b - 1] if b else -1
        after = block[i] if i < len(block) else -1  # only in the last block nothing is after x
        block.insert(i, x)
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            blocks[b : b + 1] = [block[:half], block[half:]]
            tops[b : b + 1] = [block[half - 1], block[-1]]
        return before, after


def automaton(words: list[int]) -> tuple[array, array, array]:
    """(length, link, end) of the states of the suffix automaton; ``end`` is -1 for clones and the root.

    Most states have one transition, which lies in arrays; dictionaries hold the others."""
    length, link, end = array("q", [0]), array("q", [-1]), array("q", [-1])
    word1, to1 = array("q", [-1]), array("q", [-1])
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, w in enumerate(words):
        cur = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        word1.append(-1)
        to1.append(-1)
        p = last
        q = -1
        while p >= 0:
            if word1[p] == w:
                q = to1[p]
                break
            if word1[p] < 0:
                word1[p], to1[p] = w, cur
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {w: cur}
                elif (q := others.get(w, -1)) >= 0:
                    break
                else:
                    others[w] = cur
            p = link[p]
        if q >= 0:
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                word1.append(word1[q])
                to1.append(to1[q])
                if q in more:
                    more[clone] = dict(more[q])
                link[q] = link[cur] = clone
                while p >= 0:
                    if word1[p] == w:
                        if to1[p] != q:
                            break
                        to1[p] = clone
                    elif p in more and more[p].get(w) == q:
                        more[p][w] = clone
                    else:
                        break
                    p = link[p]
        last = cur
    return length, link, end


def least_state(min_words: int, min_times: int) -> int:
    """The length below which no state has the seed of a run that no longer state has."""
    return min(max(min_words - d, (min_times - 1) * d, 1) for d in range(1, min_words + 1))


class _Seeds:
    """Extends seeds to stretches [lo, hi] of positions i with word i = word i + d, each stretch once."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.known: dict[int, tuple[list[int], list[int]]] = {}

    def add(self, d: int, end: int) -> None:
        known = self.known.get(d)
        if known is None:
            known = self.known[d] = ([], [])
        i = bisect_right(known[0], end) - 1
        if i >= 0 and known[1][i] >= end:
            return
        lo, hi = end - self._equal(end, d, -1) + 1, end + self._equal(end, d, 1) - 1
        known[0].insert(i + 1, lo)
        known[1].insert(i + 1, hi)

    def _equal(self, at: int, d: int, way: int) -> int:
        """How many positions from ``at`` on have their word again d words later."""
        w, n, total, step = self.words, len(self.words) - d, 0, 64
        while True:
            size = min(step, n - at if way > 0 else at + 1)
            if size <= 0:
                return total
            part = slice(at, at + size) if way > 0 else slice(at - size + 1, at + 1)
            equal = w[part] == w[part.start + d : part.stop + d]
            if way < 0:
                equal = equal[::-1]
            if not equal.all():
                return total + int(equal.argmin())
            total += size
            at += way * size
            step *= 4


def _divisors(d: int) -> list[int]:
    """d / r for the prime factors r of d."""
    out, rest, r = [], d, 2
    while r * r <= rest:
        if rest % r == 0:
            out.append(d // r)
            while rest % r == 0:
                rest //= r
        r += 1
    return [*out, d // rest] if rest > 1 else out


def runs_of(words: np.ndarray, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, sorted by start and period."""
    least = least_state(min_words, min_times)
    length, link, end = automaton(words.tolist())
    seeds = _Seeds(words)
    sets: dict[int, Ends] = {}
    lengths = np.frombuffer(length, dtype=np.int64)
    for v in np.argsort(-lengths, kind="stable").tolist():
        size = length[v]
        if size < least:
            break
        own = sets.pop(v, None)
        if own is None:
            own = Ends(end[v])
        u = link[v]
        size = length[u]
        if size < least:
            continue
        large = sets.get(u)
        if large is None and end[u] >= 0:
            large = Ends(end[u])
        if large is None:
            sets[u] = own
            continue
        small, large = (own, large) if own.size <= large.size else (large, own)
        for x in small:
            before, after = large.insert(x)
            if before >= 0 and (d := x - before) <= size and size >= max(min_words - d, (min_times - 1) * d):
                seeds.add(d, before)
            if after >= 0 and (d := after - x) <= size and size >= max(min_words - d, (min_times - 1) * d):
                seeds.add(d, x)
        sets[u] = large
    out = []
    for d, (los, his) in seeds.known.items():
        shorter = None
        for lo, hi in zip(los, his, strict=True):
            total = hi - lo + 1 + d
            if total < max(min_words, min_times * d):
                continue
            shorter = _divisors(d) if shorter is None else shorter
            # a smaller period divides d, for the run has at least 2 d words; the first d + q words show it
            if not any((words[lo : lo + d] == words[lo + q : lo + q + d]).all() for q in shorter if q < d):
                out.append((lo, total, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


_MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def stretches(hashes: np.ndarray, window: int) -> list[tuple[int, int]]:
    """[first, end): what the windows of so many words that occur at least twice cover together."""
    n = len(hashes)
    if n <= window:
        return []
    h, have, at = hashes, 1, 0
    while have < window:  # windows of twice the words, or of what is missing, by two that they consist of
        by = min(have, window - have)
        h = h[:-by] * _MULTIPLIERS[at % len(_MULTIPLIERS)] + h[by:] if by == have else h[: len(h) - by] * _MULTIPLIERS[at % len(_MULTIPLIERS)] + h[by:]
        h = h ^ (h >> np.uint64(29))
        have, at = have + by, at + 1
    in_order = np.sort(h)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return []
    places = np.flatnonzero(np.isin(h, twice))
    cuts = np.flatnonzero(np.diff(places) > window)  # covered words that don't touch
    return list(zip(places[np.r_[0, cuts + 1]].tolist(), (places[np.r_[cuts, len(places) - 1]] + window).tolist(), strict=True))


def find_runs(words: list[bytes], min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, sorted by start and period."""
    window = least_state(min_words, min_times)
    if len(words) < min_words:
        return []
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    found = stretches(hashes, window)
    if not found:
        return []
    out = []
    for first, end in found:
        if end - first < min_words:
            continue
        ids: dict[bytes, int] = {}
        numbers = np.array([ids.setdefault(w, len(ids)) for w in words[first:end]], dtype=np.int64)
        out += [(first + s, n, q) for s, n, q in runs_of(numbers, min_words, min_times)]
    return out


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run has after its first q words."""
    stay = np.ones(n, dtype=bool)
    for start, size, q in runs:
        stay[start + q : start + size] = False
    return stay


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, exactly; of equal ones that with the smallest start, then period."""
    best = None
    for r in runs:  # in the order of start and period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def repeat_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, in one document of ten (by its id) with a tail that repeats its first words again and again."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def collapse_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repeat: bool = False, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> DataFrame:
    """Per row its runs, the one of the highest exponent, and ``collapsed``: the words but for repetitions.

    ``repeat`` replaces words of some documents by :func:`repeat_words` first."""
    return _mapped(docs, id_col, text_col, repeat, min_words, min_times, digest=False)


DIGEST = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def digest_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repeat: bool = False, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> DataFrame:
    """The same with hashes of runs and text in their place, so no text leaves the task that reads it."""
    return _mapped(docs, id_col, text_col, repeat, min_words, min_times, digest=True)


def _mapped(docs: DataFrame, id_col: str, text_col: str, repeat: bool, min_words: int, min_times: int, digest: bool) -> DataFrame:
    numbers = [pa.int64()] * 6
    of_runs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = [*numbers, pa.string(), pa.string()] if digest else [*numbers, of_runs, pa.string()]
    schema = DIGEST if digest else SCHEMA
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", *(["runs_sha256", "collapsed_sha256"] if digest else ["runs", "collapsed"])]

    def row(doc_id: int | None, raw: bytes) -> tuple:
        words = raw.split()  # bytes split at the six ASCII white-space characters
        if repeat:
            words = repeat_words(words, doc_id)
        runs = find_runs(words, min_words, min_times)
        best = best_run(runs)
        if runs:
            stay = kept(len(words), runs)
            words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
        text = b" ".join(words)
        numbers = (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4))
        if digest:
            return (*numbers, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
        return (*numbers, [{"start": s, "length": n, "period": q} for s, n, q in runs], text.decode())

    def make():
        def of(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            if not batch.num_rows:
                return None
            rows = [row(i, raw) for i, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        return of

    return map_batches(docs.select(F.col(id_col).cast("bigint"), F.col(text_col)), make, schema)
