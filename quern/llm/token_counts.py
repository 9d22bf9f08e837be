r"""Token counts without token ids.

A byte-level BPE encodes every pre-token for itself, so a text has as many tokens as its
pre-tokens have pieces.  Pieces are counted once per distinct pre-token of the corpus;
per-document frequencies of pre-tokens are joined with these counts and summed up.

1. Every task counts its pre-tokens; the sums per pre-token are shuffled, and each
   distinct one is encoded once, by the library.
2. The ``MOST`` most frequent short ones (at most; a histogram of their frequencies says
   where to cut) go to all tasks, which is a bound that doesn't grow with the data.  Texts
   are read again, and sum up what they find there.
3. All other pre-tokens are joined by a shuffle, as (row, pre-token, frequency).  Each is so
   rare that no task gets many rows of it: one more frequent would be among the ``MOST``.

Both passes split texts at lone spaces first: a space between two characters that aren't
white space always begins a pre-token, so pre-tokens are cut once per distinct word of a
task, not once per occurrence.

Defined results: a null text counts as empty and has no tokens; a null id stays null;
repeated rows are rows of their own; an empty table gives no rows; other columns are not
looked at.  Strings of special tokens inside a text are one token each, as by the
library's default.  Texts of any length are counted whole; a task holds one text and its
words at a time.
"""

from __future__ import annotations

import functools
import json
import os
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Pre-tokens that go to all tasks, and the length up to which one may be among them.
MOST, SHORT = 400_000, 64
#: Different words of a task after which what was counted is sent on.
HELD = 300_000
#: Rows of a batch that are worked on at once.
SOME = 500
#: More than the known pieces of any text: what a word with other pre-tokens counts beside its known ones.
OTHERS = 1 << 48
#: Steps of the histogram of frequencies for each doubling.
STEPS = 8

#: How the byte-level pre-tokenizer cuts (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point the ``regex`` module and the library agree on letters, digits and white
#: space; words with characters beyond it are cut by the library, whose Unicode tables are older.
PLAIN = "Ԁ"

_CUT = regex.compile(PATTERN)
#: White space beside a space: there a space needn't begin a pre-token.
_BESIDE = regex.compile(r"\s | \s|^ | $")
_LONE = regex.compile(r"(?<=\S) (?=\S)")


class Cutter:
    """Cuts texts into words, and words into the pre-tokens of a byte-level tokenizer."""

    def __init__(self, tokenizer_json: str):
        about = json.loads(tokenizer_json)
        pre, model = about.get("pre_tokenizer") or {}, about.get("model") or {}
        if about.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type") != "BPE" or model.get("dropout"):
            raise ValueError("token counts need a byte-level BPE without normalizer, prefix space and dropout")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in about.get("added_tokens", [])):
            raise ValueError("token counts need added tokens that take no white space and stand anywhere")
        self._json, self._tokenizer = tokenizer_json, None
        added = sorted((t["content"] for t in about.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    @property
    def tokenizer(self):
        """The library's own, which tasks need for encoding and for characters beyond ``PLAIN`` only."""
        if self._tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_str(self._json)
        return self._tokenizer

    def parts(self, text: str) -> list[str]:
        """The text between added tokens; there is one of them between any two parts."""
        return self.added.split(text) if self.added and self.added.search(text) else [text]

    @staticmethod
    def words(part: str) -> tuple[str, list[str]]:
        """The first word, and the others, each of which a space begins that isn't in it."""
        found = _LONE.split(part) if _BESIDE.search(part) else part.split(" ")
        return found[0], found[1:]

    def pre_tokens(self, word: str, lead: str = "") -> list[str]:
        """Of a word, and the space before it if there is one."""
        if word.isascii() or max(word) < PLAIN:
            if word.isalpha():  # nothing but letters
                return [lead + word]
            return _CUT.findall(lead + word)
        word = lead + word
        return [word[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(word)]

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        """Pieces of each; none of them holds the string of an added token."""
        return [len(e.ids) for e in self.tokenizer.encode_batch(pre_tokens, add_special_tokens=False)]


@functools.lru_cache(maxsize=1)
def cutter_of(tokenizer_json: str) -> Cutter:
    """Made once a worker, not once a task."""
    return Cutter(tokenizer_json)


@functools.lru_cache(maxsize=1)
def _pieces_of(raw: bytes) -> dict[str, int]:
    read = pa.ipc.open_stream(raw).read_all()
    return dict(zip(read.column(0).to_pylist(), read.column(1).to_pylist(), strict=True))


class Memo(dict):
    """Remembers what ``look`` says of words that a space begins.

    A class of the module, as one made by a task would keep the task's tables until a full collection."""

    __slots__ = ("look",)

    def __init__(self, look: Callable[[str, str], int]):
        super().__init__()
        self.look = look

    def __missing__(self, word: str) -> int:
        found = self[word] = self.look(word, " ")
        return found


def _texts(column: pa.Array, some: int = 200) -> Iterator[str]:
    """The texts of a batch, some at a time."""
    for at in range(0, len(column), some):
        for text in column.slice(at, some).to_pylist():
            yield text or ""


def distinct_pre_tokens(docs: DataFrame, vocabulary, text_col: str = "text", held: int = HELD) -> DataFrame:
    """pre_token, n, pieces: every distinct pre-token, how often it stands in the texts, and its pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = cutter_of(vocabulary.value)
        first, later = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            out: Counter = Counter()
            for words, lead in ((first, ""), (later, " ")):
                for word, n in words.items():
                    for t in cutter.pre_tokens(word, lead):
                        out[t] += n
                words.clear()
            return pa.RecordBatch.from_pydict({"pre_token": pa.array(out.keys(), pa.string()), "n": pa.array(out.values(), pa.int64())})

        for batch in batches:
            for text in _texts(batch.column(0)):
                for part in cutter.parts(text):
                    head, rest = cutter.words(part)
                    first[head] += 1
                    later.update(rest)
                if len(first) + len(later) > held:
                    yield flush()
        if first or later:
            yield flush()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = cutter_of(vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SOME):
                part = batch.slice(at, SOME)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cutter.pieces(part.column(0).to_pylist()), pa.int64())], names=["pre_token", "n", "pieces"])

    counted = docs.select(text_col).mapInArrow(count, "pre_token string, n bigint").groupBy("pre_token").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(encode, "pre_token string, n bigint, pieces bigint")


def frequent(found: DataFrame, most: int = MOST, short: int = SHORT):
    """Which of the distinct pre-tokens are frequent enough to be known to all tasks: a condition, at most ``most`` rows."""
    level = F.floor(F.log2("n") * STEPS)
    fits = F.length("pre_token") <= short
    levels = sorted(((r["level"], r["count"]) for r in found.where(fits).groupBy(level.alias("level")).count().collect()), reverse=True)  # a row for each of at most 64 * STEPS levels
    total, least = 0, None
    for at, n in levels:
        total += n
        if total > most:
            break
        least = at
    return F.lit(False) if least is None else fits & (level >= least)


def _key(col):
    """Long pre-tokens are joined by their hash."""
    return F.when(F.length(col) <= SHORT, col).otherwise(F.concat(F.lit("\0"), F.sha2(col, 256)))


_FOUND = "n_bytes bigint, n_known bigint, others array<struct<pre_token:string,n:bigint>>"


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, held: int = HELD) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; ``tokenizer`` is the path of a vocabulary file that the driver reads."""
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # a few MB, whatever the data
    found = cut(distinct_pre_tokens(docs, vocabulary, text_col, held))
    known = frequent(found, most)
    table = found.where(known).select("pre_token", "pieces").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    shared = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())  # ``most`` short strings at most

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = cutter_of(vocabulary.value)
        pieces = _pieces_of(shared.value)
        def look(word: str, lead: str) -> int:
            """Pieces of a word's known pre-tokens; ``OTHERS`` more if there are others."""
            total, more = 0, 0
            for t in cutter.pre_tokens(word, lead):
                n = pieces.get(t)
                if n is None:
                    more = OTHERS
                else:
                    total += n
            return total + more

        memo = Memo(look)

        def of(text: str) -> tuple[int, Counter]:
            parts = cutter.parts(text)
            total, others = len(parts) - 1, Counter()
            for part in parts:
                head, rest = cutter.words(part)
                own = look(head, "")
                if own >= OTHERS:
                    others.update(t for t in cutter.pre_tokens(head) if t not in pieces)
                found = sum(map(memo.__getitem__, rest))
                if found >= OTHERS:
                    for word in rest:
                        if memo[word] >= OTHERS:
                            others.update(t for t in cutter.pre_tokens(word, " ") if t not in pieces)
                total += own % OTHERS + found % OTHERS
            return total, others

        for batch in batches:
            for at in range(0, batch.num_rows, SOME):
                part = batch.slice(at, SOME)
                if len(memo) > held:
                    memo.clear()
                sizes, known_, ends, names, counts = [], [], [0], [], []
                for text in _texts(part.column("text")):
                    total, others = of(text)
                    sizes.append(len(text.encode()))
                    known_.append(total)
                    names += others.keys()
                    counts += others.values()
                    ends.append(len(names))
                each = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["pre_token", "n"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(known_, pa.int64()), lists], names=["rid", "doc_id", "n_bytes", "n_known", "others"])

    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.mapInArrow(of_texts, f"rid bigint, doc_id bigint, {_FOUND}")
    rare = found.where(~known).select(_key(F.col("pre_token")).alias("key"), "pieces")
    if rare.isEmpty():
        return rows.select("doc_id", "n_bytes", F.col("n_known").alias("n_tokens"))
    each = rows.select("rid", "doc_id", "n_bytes", "n_known", F.explode_outer("others").alias("o"))
    # a row without other pre-tokens gets a key of its own, so such rows don't meet in one task
    each = each.select("rid", "doc_id", "n_bytes", "n_known", F.coalesce(_key(F.col("o.pre_token")), F.concat(F.lit("\1"), F.col("rid").cast("string"))).alias("key"), F.col("o.n").alias("n"))
    joined = each.join(rare, "key", "left")
    out = joined.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.first("n_known").alias("n_known"), F.sum(F.coalesce(F.col("n") * F.col("pieces"), F.lit(0).cast("bigint"))).alias("n_rare"))
    return out.select("doc_id", "n_bytes", (F.col("n_known") + F.col("n_rare")).alias("n_tokens"))
