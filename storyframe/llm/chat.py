"""Chat formatting from event logs.

A log has events of conversations: `open` starts a message (role, text), `delta` adds text, `edit` replaces the text,
`regenerate` empties the message and drops every message opened after it, `delete` drops the message. Logs are partitioned by
conversation and sorted by sequence; one pass folds the events into final messages, renders them and, for the query,
reads the rendered text back. The passes stream: a task holds the messages of one conversation and one batch, never a whole partition.

A turn is rendered as <|turn|>role, newline, text, <|end|>, newline. In texts and roles a backslash is doubled and a
control string gets \\e after its first character, so it cannot end or start a turn and the text comes back
exactly; line ends in roles become \\n.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyframe.llm.common import batch

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of this template and of templates in wide use.
CONTROL = (TURN, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_READ = re.compile(rf"{re.escape(TURN)}(.*?)\n(.*?){re.escape(END)}\n", re.DOTALL)

_MESSAGE = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_PIECE = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
MESSAGE_DDL = "conv_id long, position long, role string, text string"
PIECE_DDL = "conv_id long, position long, formatted string, loss_start long, loss_end long"
DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\e", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\([\\en])", lambda m: {"\\": "\\", "e": "", "n": "\n"}[m[1]], text)


class Fold:
    """The messages of a conversation, as its events come in order."""

    def __init__(self) -> None:
        self.messages: dict = {}

    def take(self, event: str, msg: int | None, role: str | None, text: str | None) -> None:
        messages, text = self.messages, text or ""
        if event == "delete":
            messages.pop(msg, None)
            return
        if msg not in messages:
            messages[msg] = [role or "", []]
        if event == "regenerate":
            while next(reversed(messages)) != msg:
                messages.popitem()
        if event in ("edit", "regenerate", "open"):
            messages[msg][1] = [text]
        elif event == "delta":
            messages[msg][1].append(text)
        else:
            raise ValueError(f"unknown event {event!r}")

    def done(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in self.messages.values()]


def fold(events: Iterator[tuple]) -> list[tuple[str, str]]:
    """(role, text) of the messages that stand after (event, msg, role, text) in order."""
    out = Fold()
    for e in events:
        out.take(*e)
    return out.done()


_NONE = object()
#: Messages and characters that fill a batch.
_ROWS, _CHARS = 2000, 4 << 20


def _fold_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation; batches hold the messages of many short ones, or a part of a long one's."""
    held: list[tuple] = []
    size = 0

    def full() -> pa.RecordBatch:
        return batch(_MESSAGE, **{c: [m[i] for m in held] for i, c in enumerate(("conv_id", "position", "role", "text"))})

    def ended(conv: int | None, state: Fold) -> Iterator[pa.RecordBatch]:
        nonlocal size
        for position, (role, text) in enumerate(state.done()):
            held.append((conv, position, role, text))
            size += len(text)
            if len(held) >= _ROWS or size >= _CHARS:
                yield full()
                held.clear()
                size = 0

    conv, state = _NONE, Fold()
    for rows in batches:
        for c, *event in zip(*(rows[x].to_pylist() for x in ("conv_id", "event", "msg", "role", "text"))):
            if c != conv:
                if conv is not _NONE:
                    yield from ended(conv, state)
                conv, state = c, Fold()
            state.take(*event)
    if conv is not _NONE:
        yield from ended(conv, state)
    if held:
        yield full()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        pieces, starts, ends = [], [], []
        for role, text in zip(rows["role"].to_pylist(), rows["text"].to_pylist()):
            head, body = f"{TURN}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
            pieces.append(f"{head}{body}{END}\n")
            starts.append(len(head) if role == "assistant" else None)
            ends.append(len(head) + len(body) if role == "assistant" else None)
        yield batch(_PIECE, conv_id=rows["conv_id"], position=rows["position"], formatted=pieces, loss_start=starts, loss_end=ends)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of rendered conversations, whose pieces come in order; holds one batch of pieces and two hashes."""
    conv, held = _NONE, []
    out: list[tuple] = []

    def ended() -> None:
        turns, n, loss, chars, size = held
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    def full() -> pa.RecordBatch:
        return batch(_DIGEST, **{f.name: [r[i] for r in out] for i, f in enumerate(_DIGEST)})

    for rows in batches:
        for c, piece, start, end in zip(*(rows[x].to_pylist() for x in ("conv_id", "formatted", "loss_start", "loss_end"))):
            if c != conv:
                if conv is not _NONE:
                    ended()
                conv, held = c, [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for m in _READ.finditer(piece):
                held[0].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                held[1] += 1
            if start is not None:
                masked = unescape(piece[start:end])
                held[2].update(masked.encode("utf-8", "surrogatepass"))
                held[3] += len(masked)
            held[4] += len(piece)
        if len(out) >= _ROWS:
            yield full()
            out.clear()
    if conv is not _NONE:
        ended()
    if out:
        yield full()


def _dealt(log: DataFrame, order: list[str]) -> DataFrame:
    """Conversations side by side in a partition, their events in order."""
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = ["conv_id", "event", "msg", "role", "text"]
    rows = log.select(*kept, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]).repartition(parts, "conv_id")
    return rows.sortWithinPartitions("conv_id", *[f"_o{i}" for i in range(len(order))], "msg", "event", "role", "text").select(*kept)


def chat_messages(log: DataFrame, order: list[str]) -> DataFrame:
    """Final messages (conv_id, position, role, text) of log(conv_id, event, msg, role, text and the order columns).

    Rows of a conversation stay together and in order. Null roles and texts count as empty, a null conv_id is a
    conversation of its own, null order values come first; events that tie in all order columns are taken by msg, event, role and text.
    A repeated event counts as often as it stands there. A conversation whose messages are all deleted has no rows, and neither has an empty
    log. Other columns are ignored. A conversation's messages are held by one task, as every later event may change any of them.
    """
    return _dealt(log, order).mapInArrow(_fold_all, MESSAGE_DDL)


def format_chat(messages: DataFrame) -> DataFrame:
    """Rendered turns (conv_id, position, formatted, loss_start, loss_end) of chat_messages(); joined in order they are the text.

    The loss mask covers the text of assistant turns, in code points of the piece; other turns have null. Roles and texts, never null after
    chat_messages(), may be empty and of any length; repeated rows are rendered alike; no rows give none.
    """
    return messages.mapInArrow(_render, PIECE_DDL)


def chat_digests(pieces: DataFrame) -> DataFrame:
    """What reading format_chat() back gives, one row for each conversation; its pieces must stand together and in order. No pieces give no row."""
    return pieces.mapInArrow(_read_back, DIGEST_DDL)


def events_of(conversations: DataFrame) -> DataFrame:
    """An event log of stored turns whose fold gives them again: conv_id, turn, tie, base, part, msg, event, role, text.

    Each turn is opened empty and streamed in two deltas. One in four is streamed wrongly first, answered, and regenerated; one in four is streamed too far and
    edited; before one in four another message is opened, which is deleted halfway. Null texts and roles are empty; a null turn is streamed
    only; rows that are alike are turns of their own; an empty table gives an empty log.
    """
    text, half = F.coalesce(F.col("text"), F.lit("")), F.expr("int(length(coalesce(text, '')) / 2)")
    begin, end = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    nothing, wrong = F.lit(""), F.lit("\u2026")

    def log(*events: tuple) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("part"), F.lit(event).alias("event"), F.lit(other).alias("other"), said.alias("text")) for i, (event, other, said) in enumerate(events)])

    kind = F.pmod("turn", F.lit(4))
    streamed = log(("open", 0, nothing), ("delta", 0, begin), ("delta", 0, end))
    again = log(("open", 0, nothing), ("delta", 0, wrong), ("open", 1, wrong), ("regenerate", 0, nothing), ("delta", 0, begin), ("delta", 0, end))
    edited = log(("open", 0, nothing), ("delta", 0, begin), ("delta", 0, wrong), ("edit", 0, begin), ("delta", 0, end))
    deleted = log(("open", 1, wrong), ("open", 0, nothing), ("delta", 0, begin), ("delete", 1, nothing), ("delta", 0, end))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = turns.select(
        "conv_id",
        "turn",
        F.xxhash64("role", "text").alias("tie"),
        F.monotonically_increasing_id().alias("base"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.when(kind == 1, again).when(kind == 2, edited).when(kind == 3, deleted).otherwise(streamed).alias("events"),
    )
    # one id a turn: taken before its events are laid out
    turns = turns.select("conv_id", "turn", "tie", "base", "role", F.explode("events").alias("e"))
    return turns.select("conv_id", "turn", "tie", "base", "e.part", (F.col("base") * 2 + F.col("e.other")).alias("msg"), "e.event", "role", "e.text")


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Digests of stored conversations(conv_id, turn, role, text), put through log, fold, template and back in one stage.

    One row for each conv_id, null among them. Nulls, empty and long texts, ties and repeated rows as in events_of(); other columns are
    ignored; an empty table gives no rows.
    """
    log = _dealt(events_of(conversations), ["turn", "tie", "base", "part"])
    return log.mapInArrow(lambda batches: _read_back(_render(_fold_all(batches))), DIGEST_DDL)
