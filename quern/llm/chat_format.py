r"""Chat formatting with offset-aligned loss masks.

Template: a turn of the role ``assistant`` is ``<s>`` text ``</s>``, any other
turn ``[INST]`` role, line feed, text ``[/INST]``.  Control strings inside texts
and roles get a backslash after their first character, and one that already has
backslashes there gets one more, so :func:`unescape` restores every text.

A conversation is rendered, encoded once with offsets, and the spans of the
assistant's texts are intersected with the sorted token spans by binary search;
that gives the loss mask.  Control strings are special tokens of the encoder,
so token spans never straddle a turn, and a conversation beyond ``SEGMENT_CHARS``
or ``SEGMENT_TURNS`` is rendered and encoded in segments of whole turns, in bounded
memory: put together, text, ids and mask are those of the whole conversation.

Rows are dealt by ranges of (conversation, turn), so a conversation with a third
of all rows is rendered and encoded by many tasks.  A conversation that lies in
one task is finished there; of the others only the texts to be hashed go on, and
are hashed in order with running SHA-256 states, in bounded memory.

Defined results: null texts and roles are empty; a null turn comes first, equal
turns are ordered by role and text, repeated rows are turns of their own; a null
id is a conversation of its own; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The vocabulary file where neither the caller nor the session's ``spark.quern.tokenizer`` names one;
#: only the driver reads it.
TOKENIZER, TOKENIZER_SETTING = "/opt/tokenizers/byte_bpe_50k.json", "spark.quern.tokenizer"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
#: Turns and characters at which a segment ends.
SEGMENT_TURNS, SEGMENT_CHARS = 512, 1 << 20

_TAIL = "|".join(rf"(?<={re.escape(c[0])})\\*(?={re.escape(c[1:])})" for c in CONTROLS)
_ESCAPE = re.compile(_TAIL)
_TURN = re.compile(r"<s>(?P<said>.*?)</s>|\[INST\](?P<role>.*?)\n(?P<text>.*?)\[/INST\]", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][1:], text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns, and the spans of the assistant's texts in it."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        body = escape(text)
        if role == "assistant":
            spans.append((at + 3, at + 3 + len(body)))
            piece = f"<s>{body}</s>"
        else:
            piece = f"[INST]{escape_role(role)}\n{body}[/INST]"
        parts.append(piece)
        at += len(piece)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [("assistant", unescape(m["said"])) if m["said"] is not None else (unescape_role(m["role"]), unescape(m["text"])) for m in _TURN.finditer(formatted)]


def make_encoder(tokenizer_json: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    tok.add_special_tokens(list(CONTROLS))
    return tok


def mask(encoding, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Loss mask over the tokens, and the character spans that masked tokens cover within ``spans``."""
    found = encoding.offsets
    offsets = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int64, count=2 * len(found)).reshape(-1, 2)
    start, end = offsets[:, 0], offsets[:, 1]
    if len(end):  # white space that offsets leave out belongs to the token after it
        start = np.minimum(start, np.r_[0, np.maximum.accumulate(end)[:-1]])
    flags = np.zeros(len(end), dtype=bool)
    covered = []
    for a, b in spans:
        if a == b:
            continue
        lo, hi = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b, "left"))
        flags[lo:hi] = True
        if lo < hi:
            covered.append((max(a, int(start[lo])), min(b, int(end[hi - 1]))))
    return flags, covered


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, first, last, turns): segments of whole turns of sorted rows (conv, turn, role, text).

    ``first``: nothing of the conversation came before in this task; ``last``:
    the task has rows of a later conversation."""
    none = object()
    conv, turns, chars, first = none, [], 0, True
    for batch in batches:
        for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if conv is not none and (c != conv or len(turns) >= SEGMENT_TURNS or chars >= SEGMENT_CHARS):
                yield conv, first, c != conv, turns
                first, turns, chars = c != conv, [], 0
            conv = c
            turns.append((role or "", text or ""))
            chars += len(turns[-1][1])
    if turns:
        yield conv, first, False, turns


def _sorted_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = rows.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")


def vocabulary_path(spark: SparkSession) -> str:
    return spark.conf.get(TOKENIZER_SETTING, TOKENIZER)


def _tokenizer(rows: DataFrame, path: str | None):
    spark = rows.sparkSession
    with open(path or vocabulary_path(spark), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())  # a file of a few MB, whatever the data


def format_chats(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Segments in order: conv_id, task, seq, formatted, input_ids, loss_mask."""
    vocabulary = _tokenizer(rows, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = make_encoder(vocabulary.value)
        for n, (c, _, _, turns) in enumerate(_segments(batches)):
            formatted, spans = render(turns)
            enc = tok.encode(formatted, add_special_tokens=False)
            flags, _ = mask(enc, spans)
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([c], pa.int64()), "seq": pa.array([n], pa.int64()), "formatted": [formatted], "input_ids": pa.array([enc.ids], pa.list_(pa.int32())), "loss_mask": pa.array([flags], pa.list_(pa.bool_()))})

    made = _sorted_rows(rows, conv, turn, role, text).mapInArrow(run, "conv_id bigint, seq bigint, formatted string, input_ids array<int>, loss_mask array<boolean>")
    return made.select("conv_id", F.spark_partition_id().alias("task"), "seq", "formatted", "input_ids", "loss_mask")


_PART = "conv_id bigint, seq bigint, done boolean, n_turns bigint, turns string, loss string, loss_chars bigint, formatted_chars bigint"
_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def digest_chats(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Per conversation what is read back from its formatted text and its loss mask."""
    vocabulary = _tokenizer(rows, tokenizer)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = make_encoder(vocabulary.value)
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            names = [f.split()[0] for f in _PART.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held.clear()
            return out

        seen, size = False, 0
        for n, (c, first, last, turns) in enumerate(_segments(batches)):
            formatted, spans = render(turns)
            enc = tok.encode(formatted, add_special_tokens=False)
            _, covered = mask(enc, spans)
            said = "".join(unescape(formatted[a:b]) for a, b in covered)
            back = read_back(formatted)
            whole = "".join(f"{r}\n{t}\n" for r, t in back)
            done = seen and first and last  # neither cut by this task's first row nor by its last
            seen = seen or last
            held.append((c, n, done, len(back), _sha(whole) if done else whole, _sha(said) if done else said, len(said), len(formatted)))
            size += len(held[-1][4]) + len(held[-1][5])
            if len(held) >= 2000 or size > 4 << 20:
                size = 0
                yield flush()
        if held:
            yield flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv_id, state = none, None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            names = [f.split()[0] for f in _DIGEST.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return made

        for batch in batches:
            for r in batch.to_pylist():
                if r["done"]:
                    out.append((r["conv_id"], r["n_turns"], r["turns"], r["loss_chars"], r["loss"], r["formatted_chars"]))
                    continue
                if r["conv_id"] != conv_id or state is None:
                    if state is not None:
                        out.append((conv_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    conv_id, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += r["n_turns"]
                state[1].update(r["turns"].encode("utf-8", "surrogatepass"))
                state[2] += r["loss_chars"]
                state[3].update(r["loss"].encode("utf-8", "surrogatepass"))
                state[4] += r["formatted_chars"]
            if out:
                yield flush()
        if state is not None:
            out.append((conv_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
            yield flush()

    parts = _sorted_rows(rows, conv, turn, role, text).mapInArrow(digest, _PART).withColumn("task", F.spark_partition_id())
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "task", "seq").drop("task")
    return parts.mapInArrow(join, _DIGEST)
