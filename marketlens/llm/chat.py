"""Chat transcripts rebuilt from event logs and rendered for training.

A log holds, per conversation and message, events in sequence: ``message`` opens
a message with a role and its first text, ``delta`` adds streamed text, ``edit``
puts a new text in place of what there is, ``regenerate`` throws the text away
and what follows is streamed anew. The log is partitioned by conversation and
sorted by message and sequence; one pass folds it, so a task holds one message
at a time, however long its conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates, escaped inside texts.
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"
#: Characters of a text per event when a table of turns is read as a log.
DELTA_CHARS = 2000

_ESCAPE = re.compile(rf"\\|(?={'|'.join(re.escape(c) for c in CONTROLS)}).", re.S)
_UNESCAPE = re.compile(r"\\(\\|x[0-9a-f]{2})")
_PIECE = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*){re.escape(CLOSE)}\n", re.S)


def escaped(text: str) -> str:
    """The text with every backslash doubled and the first character of every control string in hex."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"\\x{ord(m[0]):02x}", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[1] == "\\" else chr(int(m[1][1:], 16)), text)


def _role(role: str) -> str:
    return escaped(role).replace("\n", "\\x0a")


def render_message(role: str, text: str) -> tuple[str, int, int]:
    """The message in the template, and where in it the text under the loss mask begins and ends."""
    head, body = f"{OPEN}{_role(role)}\n", escaped(text)
    end = len(head) + len(body)
    return f"{head}{body}{CLOSE}\n", len(head) if role == LOSS_ROLE else end, end


def read_message(piece: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    found = _PIECE.fullmatch(piece)
    if not found:
        raise ValueError("not a rendered message")
    return unescaped(found[1]), unescaped(found[2])


RENDERED = pa.schema([
    ("conv_id", pa.int64()), ("position", pa.int64()), ("formatted", pa.string()),
    ("loss_start", pa.int64()), ("loss_end", pa.int64()),
])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, message, position, role, parts = None, None, -1, "", None
    out: list[tuple] = []
    size = 0

    def close() -> None:
        nonlocal size
        if parts is not None:
            piece, start, end = render_message(role, "".join(parts))
            out.append((conv, position, piece, start, end))
            size += len(piece)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "message", "kind", "role", "text")]
        for c, m, kind, r, text in zip(*columns):
            if parts is None or c != conv or m != message or kind == "message":
                close()
                position = position + 1 if parts is not None and c == conv else 0
                conv, message, role, parts = c, m, r or "", []
            if kind in ("edit", "regenerate"):
                parts = []
            if text:
                parts.append(text)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), RENDERED)], schema=RENDERED)
                out, size = [], 0
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), RENDERED)], schema=RENDERED)


def format_chats(log: DataFrame) -> DataFrame:
    """Rendered messages of a log with ``conv_id``, ``message``, ``seq``, ``kind``, ``role``, ``text``.

    One row per message: ``formatted``, its ``position`` in the conversation,
    and the part under the loss mask, empty unless the role is assistant. The
    rows of a conversation follow one another in order within a partition, and
    a conversation is the concatenation of its rows. Null texts add nothing, a
    null role is empty, events of a null conversation form one, and an event
    without an opening one opens its message. Events that agree in message and
    seq are taken by kind and text, those of two messages that share a key by
    seq. An empty log gives no rows; other columns of the log are not read.
    """
    needed = ("conv_id", "message", "seq", "kind", "role", "text")
    ordered = (
        log.select(F.col("conv_id").cast("long").alias("conv_id"), *needed[1:])
        .repartition("conv_id").sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text")
    )
    return ordered.mapInArrow(_fold, "conv_id long, position long, formatted string, loss_start long, loss_end long")


def turn_log(turns: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """Turns (``conv_id``, ``turn``, ``role``, ``text``) as the log of a chat whose texts were streamed.

    Turns that share a number are messages of their own, in order of role and
    text. A long text comes as several deltas.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    parts: Column = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0)))
    numbered = turns.select("conv_id", F.row_number().over(order).cast("long").alias("message"), "role", parts.alias("parts"))
    return numbered.select("conv_id", "message", "role", F.posexplode("parts").alias("seq", "text")).withColumn(
        "kind", F.when(F.col("seq") == 0, "message").otherwise("delta"))


DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, n, turns, loss, loss_chars, chars = None, 0, None, None, 0, 0
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "position", "formatted", "loss_start", "loss_end")]
        for c, position, piece, start, end in zip(*columns):
            if turns is None or c != conv or position == 0:
                if turns is not None:
                    out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                conv, n, turns, loss, loss_chars, chars = c, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            role, text = read_message(piece)
            turns.update(f"{role}\n{text}\n".encode())
            learned = unescaped(piece[start:end])
            loss.update(learned.encode())
            n, loss_chars, chars = n + 1, loss_chars + len(learned), chars + len(piece)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), DIGESTS)], schema=DIGESTS)
    if turns is not None:
        last = [(conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*last), DIGESTS)], schema=DIGESTS)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row of digests per conversation from the rows of :func:`format_chats`, taken as they come."""
    return formatted.mapInArrow(
        _digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
