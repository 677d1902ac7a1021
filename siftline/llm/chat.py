"""Chat formatting with a grammar round trip.

A conversation is rendered by a template, the rendering is read back by a deterministic
parser, and the recovered turns are compared with the source. Turns whose content conflicts
with the grammar are escaped, and the trip repeats until both are identical.

The grammar, with one space where it shows one:

    conversation = "<s>" turn*
    turn         = "[INST] " text " [/INST]"                    a user's
                 | " " text "</s>"                              an assistant's
                 | "[ROLE] " text " [SEP] " text " [/ROLE]"     any other role, and its text

A text holds no control string. An escaped one has a backslash after its first character
("[\\/INST]"), and one that looks escaped already gets one more, so the parser restores any text
by removing one. A turn's rendering doesn't depend on its neighbours; long conversations
are therefore rendered and parsed in blocks of turns, in bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

BEGIN, USER, USER_END, ASSISTANT_END = "<s>", "[INST]", "[/INST]", "</s>"
ROLE, ROLE_SEP, ROLE_END = "[ROLE]", "[SEP]", "[/ROLE]"
_CONTROLS = (BEGIN, ASSISTANT_END, USER, USER_END, ROLE, ROLE_SEP, ROLE_END)
_CONTROL = re.compile("|".join(map(re.escape, _CONTROLS)))
_SPLIT = re.compile(r"([\[<])(\\*)(" + "|".join(re.escape(c[1:]) for c in _CONTROLS) + ")")

#: Turns, and characters, of a conversation that are rendered and parsed at once.
BLOCK_TURNS, BLOCK_CHARS = 4096, 4_000_000

Turn = tuple[str, str]


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return _SPLIT.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _SPLIT.sub(lambda m: m[1] + m[2][1:] + m[3] if m[2] else m[0], text)


def _render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where the assistant's text starts and ends in it (0, 0 for others)."""
    if role == "user":
        return f"{USER} {text} {USER_END}", 0, 0
    if role == "assistant":
        return f" {text}{ASSISTANT_END}", 1, 1 + len(text)
    return f"{ROLE} {role} {ROLE_SEP} {text} {ROLE_END}", 0, 0


def _until(s: str, at: int, end: str, control: str) -> tuple[str, int]:
    m = _CONTROL.search(s, at)
    if not m or m[0] != control or not s.startswith(end, m.start() - (len(end) - len(control))):
        raise GrammarError(f"{control} expected after {at}")
    stop = m.start() - (len(end) - len(control))
    if stop < at:
        raise GrammarError(f"no text at {at}")
    return s[at:stop], m.end()


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, mask start, mask end) of each turn; raises GrammarError if it isn't in the grammar."""
    at, out = 0, []
    while at < len(rendered):
        if rendered.startswith(USER + " ", at):
            text, at = _until(rendered, at + len(USER) + 1, " " + USER_END, USER_END)
            out.append(("user", unescape(text), 0, 0))
        elif rendered.startswith(ROLE + " ", at):
            role, at = _until(rendered, at + len(ROLE) + 1, f" {ROLE_SEP}", ROLE_SEP)
            if not rendered.startswith(" ", at):
                raise GrammarError(f"space expected at {at}")
            text, at = _until(rendered, at + 1, " " + ROLE_END, ROLE_END)
            out.append((unescape(role), unescape(text), 0, 0))
        elif rendered.startswith(" ", at):
            text, end = _until(rendered, at + 1, ASSISTANT_END, ASSISTANT_END)
            out.append(("assistant", unescape(text), at + 1, at + 1 + len(text)))
            at = end
        else:
            raise GrammarError(f"no turn at {at}")
    return out


def _recovered(rendered: str) -> list[Turn] | None:
    try:
        return [(r, t) for r, t, _, _ in parse(rendered)]
    except GrammarError:
        return None


def round_trip(turns: list[Turn]) -> str:
    """The rendering of turns that parses back to exactly these turns."""
    plain = [_render(r, t)[0] for r, t in turns]
    if _recovered(whole := "".join(plain)) == turns:
        return whole
    # Escape the turns that don't survive alone, then, if need be, all.
    some = [p if _recovered(p) == [turn] else _render(escape(turn[0]), escape(turn[1]))[0] for p, turn in zip(plain, turns)]
    if _recovered(whole := "".join(some)) == turns:
        return whole
    whole = "".join(_render(escape(r), escape(t))[0] for r, t in turns)
    if _recovered(whole) != turns:
        raise GrammarError("the grammar can't carry these turns")
    return whole


OUTPUT = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
)

FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("loss_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, bool, str]]:
    """(conversation, block, is last, rendering) from rows that are sorted by conversation."""
    current: int | None = None
    turns: list[Turn] = []
    size, block, any_rows = 0, 0, False

    def rendering() -> str:
        return (BEGIN if block == 0 else "") + round_trip(turns)

    for batch in batches:
        ids, roles, texts = (batch.column(i).to_pylist() for i in range(3))
        for conv, role, text in zip(ids, roles, texts):
            if any_rows and conv != current:
                yield current, block, True, rendering()
                turns, size, block = [], 0, 0
            elif len(turns) >= BLOCK_TURNS or size >= BLOCK_CHARS:
                yield current, block, False, rendering()
                turns, size, block = [], 0, block + 1
            current, any_rows = conv, True
            turns.append((role or "", text or ""))
            size += len(text or "")
    if any_rows:
        yield current, block, True, rendering()


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for conv, block, _, text in _blocks(batches):
        head = len(BEGIN) if block == 0 else 0
        spans = [[a + head, b + head] for r, _, a, b in parse(text[head:]) if r == "assistant"]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([conv], pa.int64()),
                pa.array([block], pa.int32()),
                pa.array([text], pa.string()),
                pa.array([spans], pa.list_(pa.list_(pa.int64()))),
            ],
            FORMATTED.names,
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
    n = loss = chars = 0
    for conv, block, last, text in _blocks(batches):
        chars += len(text)
        body = text[len(BEGIN) :] if block == 0 else text
        for role, content, a, b in parse(body):
            n += 1
            turns_hash.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                masked = unescape(body[a:b])
                loss += len(masked)
                loss_hash.update(masked.encode("utf-8", "surrogatepass"))
        if last:
            rows.append((conv, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars))
            turns_hash, loss_hash, n, loss, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        if len(rows) >= 5000:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], OUTPUT.names)


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    shared.ship(conversations.sparkSession)
    rows = shared.pick(conversations, "conv_id", "turn", "role", "text").withColumn("conv_id", F.col("conv_id").cast("long"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, block, formatted, loss_spans (start, end in code points) of every conversation.

    Input: conv_id, turn, role, text; other columns are ignored. Rows go by turn, null
    turns first, ties by role then text; repeated rows are turns each. A null text is
    empty, a null role is the empty role, null conv_ids are one conversation. Blocks follow
    one another without a gap; only very long conversations have more than one.
    """
    return _sorted_turns(conversations).mapInArrow(_format, FORMATTED)


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """What is read back from the formatted text, one row per conversation (see OUTPUT).

    Cases are as for format_conversations. A conversation is digested by one task because a
    hash of its turns is a sequence, but it streams through: memory holds one block.
    """
    return _sorted_turns(conversations).mapInArrow(_digest, OUTPUT)


def conflicting_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are made of the template's own control strings.

    A table that has a conversation -1 itself gets these turns among its own, in the order of
    turn, role and text, as one conversation.
    """
    text = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", text), (-1, 1, "assistant", text)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
