"""Operator 7: chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the formatted turns before it are context, and
only the reply's text is trainable (loss_start to loss_end, characters of ``text``). Turns after the last reply
make one more example, without a loss span, so the output holds the whole conversation.

Template: ``<s>text</s>`` for assistants, ``[INST]<<SYS>>role<</SYS>>text[/INST]`` for other roles. In roles and
texts a backslash is doubled and each control string gets a backslash after its first character, so no
control string of the output comes from a text and reading back takes one backslash away.

Rows are dealt by conversation, sorted by turn and streamed; a worker holds one formatted conversation at most.

Defined results: null texts and roles are empty; a null conv_id is a conversation of its own; null turns come
first, equal turns go by role and text, and repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small_batches, table

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"\[INST\]<<SYS>>(.*?)<</SYS>>(.*?)\[/INST\]|<s>(.*?)</s>", re.S)
_BATCH = 4 << 20  # characters of an output batch


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def formatted(role: str, text: str) -> str:
    return f"<s>{escape(text)}</s>" if role == "assistant" else f"[INST]<<SYS>>{escape(role)}<</SYS>>{escape(text)}[/INST]"


def read_back(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    at = 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        at = m.end()
        yield ("assistant", unescape(m[3])) if m[3] is not None else (unescape(m[1]), unescape(m[2]))
    if at != len(text):
        raise ValueError("text after the last turn")


_EXAMPLES = "conv_id long, example int, n_turns int, text string, loss_start long, loss_end long"
_NAMES = ["conv_id", "example", "n_turns", "text", "loss_start", "loss_end"]


def expand(df: DataFrame) -> DataFrame:
    """Examples of conversations (conv_id, turn, role, text), a conversation's examples together and in order."""
    small_batches(df.sparkSession)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        conv, begun, parts, turns, number, open_tail = None, False, [], 0, 0, False

        def flush():
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_NAMES)

        def tail():
            return (conv, number, turns, "".join(parts), None, None)

        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and conv_id != conv:
                    if open_tail:
                        out.append(tail())
                        held += len(out[-1][3])
                    parts, turns, number, open_tail = [], 0, 0, False
                conv, begun = conv_id, True
                parts.append(formatted(role, text))
                turns += 1
                open_tail = role != "assistant"
                if not open_tail:
                    whole = "".join(parts)
                    parts = [whole]
                    end = len(whole) - len("</s>")
                    out.append((conv, number, turns, whole, end - len(escape(text)), end))
                    number += 1
                    held += len(whole)
                if held > _BATCH or len(out) >= 1000:
                    yield flush()
                    out.clear()
                    held = 0
        if begun and open_tail:
            out.append(tail())
        if out:
            yield flush()

    return rows.mapInArrow(run, _EXAMPLES)


def digest(examples: DataFrame) -> DataFrame:
    """Reads the examples of ``expand`` back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, last, loss, chars, size, begun = None, "", hashlib.sha256(), 0, 0, False
        out: list[tuple] = []

        def close():
            turns, n = hashlib.sha256(), 0
            for role, text in read_back(last):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def flush():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv_id, number, _, text, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number == 0:
                    if begun:
                        out.append(close())
                    conv, loss, chars, size, begun = conv_id, hashlib.sha256(), 0, 0, True
                last = text
                size += len(text)
                if a is not None:
                    said = unescape(text[a:b])
                    chars += len(said)
                    loss.update(said.encode())
            if len(out) >= 1000:
                yield flush()
                out.clear()
        if begun:
            out.append(close())
        if out:
            yield flush()

    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(expand(rows.unionByName(more)))
