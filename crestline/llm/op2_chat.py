"""Chat formatting from an event log.

An event is (conv_id, seq, kind, turn, role, text). Kinds: `start` opens a turn's message, `delta` appends streamed
text, `edit` replaces all the message had, `regenerate` drops every event so far of its turn and of later turns and
opens the turn anew. The log is partitioned by conversation and read backwards by seq, which tells in constant state
which events a later one has undone; what lives is folded by turn and rendered, one row per message.

Template: <|im_start|>ROLE\\nTEXT<|im_end|>\\n. Inside roles and texts a backslash is doubled and `<|` becomes `<\\|`, so
no text can hold a control string, and reading back restores each text exactly; a line feed in a role becomes `\\n`.

Everything but the digests runs in the JVM; a message is one row, a conversation is never gathered: its digests are
updated row by row over a sorted partition, so a conversation of any length needs the memory of one batch. Digests are
sequential by nature, so one conversation's rows do pass through one task.

Defined results: null roles and texts count as empty; a null conv_id is a conversation of its own; rows of equal
conversation and turn are separate turns, by role, then text; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Roles whose text is under the loss mask.
LOSS_ROLES = ("assistant",)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def events_of(turns: DataFrame) -> DataFrame:
    """A log for finished turns: a start and one delta each. Turns are numbered anew, so repeated numbers stay apart."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", (F.row_number().over(by_turn) - 1).cast("long").alias("turn"), "role", "text")
    event = lambda kind, k: F.struct((F.col("turn") * 2 + k).alias("seq"), F.lit(kind).alias("kind"), F.col("text") if k else F.lit("").alias("text"))
    return numbered.select("conv_id", "turn", "role", F.inline(F.array(event("start", 0), event("delta", 1)))).select("conv_id", "seq", "kind", "turn", "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of an event log."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    of_turn = Window.partitionBy("conv_id", "turn").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    undone = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(back)
    alive = events.select("conv_id", "seq", "kind", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("undone", undone)
    alive = alive.where(F.col("undone").isNull() | (F.col("turn") < F.col("undone")))
    replaced = F.coalesce(F.max((F.col("kind") != "delta").cast("int")).over(of_turn), F.lit(0))
    every = Window.partitionBy("conv_id", "turn").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    alive = alive.withColumn("replaced", replaced).withColumn("role", F.first("role", ignorenulls=True).over(every)).where("replaced = 0")
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return alive.groupBy("conv_id", "turn").agg(
        F.coalesce(F.max("role"), F.lit("")).alias("role"),
        F.concat_ws("", F.transform(parts, lambda p: p["text"])).alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, and the loss span [loss_from, loss_to) in code points of `formatted` (null: none)."""
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = escape(F.col("text"))
    under = F.col("role").isin(*LOSS_ROLES)
    return messages.select(
        "conv_id",
        "turn",
        F.concat(head, body, F.lit(CLOSE + "\n")).alias("formatted"),
        F.when(under, F.length(head)).alias("loss_from"),
        F.when(under, F.length(head) + F.length(body)).alias("loss_to"),
    )


def format_chat(events: DataFrame) -> DataFrame:
    return render(fold(events))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    state: list | None = None

    def close() -> dict:
        return {"conv_id": state[0], "n_turns": state[1], "turns_sha256": state[2].hexdigest(), "loss_chars": state[3], "loss_sha256": state[4].hexdigest(), "formatted_chars": state[5]}

    for batch in batches:
        done = []
        for conv, formatted, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(close())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            if not (formatted.startswith(OPEN) and formatted.endswith(CLOSE + "\n") and formatted.find("<|", len(OPEN)) == len(formatted) - len(CLOSE) - 1):
                raise ValueError(f"conversation {conv}: its output cannot be read back")
            role, _, text = formatted[len(OPEN) : -len(CLOSE) - 1].partition("\n")
            state[1] += 1
            state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            if a is not None:
                masked = unescape(formatted[a:b])
                state[3] += len(masked)
                state[4].update(masked.encode())
            state[5] += len(formatted)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([close()], schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted messages back and sums up each conversation."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return ordered.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(_digests, DIGESTS)
