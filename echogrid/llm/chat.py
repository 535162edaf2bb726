"""Chat formatting with loss masks aligned by character offsets."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed marks of the template.
BEGIN, END = "[INST] ", " [/INST]"
SYSTEM_BEGIN, SYSTEM_END = "<<SYS>>", "<</SYS>>"
STOP = "</s>"
ESCAPE = "\\"
OPENERS = re.compile(r"[\\<\[]")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    """A back slash goes before every character that can begin a mark, and before itself, so no mark arises inside a text."""
    return OPENERS.sub(lambda m: ESCAPE + m.group(), text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation as one string, and the span of each turn's escaped text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        if role == "assistant":
            head, tail = " ", STOP
        elif role == "user":
            head, tail = BEGIN, END
        else:
            head, tail = f"{SYSTEM_BEGIN}{escaped(role)}\n", SYSTEM_END
        body = escaped(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


TURN = re.compile(r"\[INST\] (?P<user>(?:[^\\<\[]|\\.)*?) \[/INST\]|<<SYS>>(?P<role>(?:[^\\<\[\n]|\\.)*)\n(?P<other>(?:[^\\<\[]|\\.)*)<</SYS>>| (?P<assistant>(?:[^\\<\[]|\\.)*)</s>", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from a formatted conversation."""
    turns = []
    for m in TURN.finditer(formatted):
        if m["assistant"] is not None:
            turns.append(("assistant", unescaped(m["assistant"])))
        elif m["user"] is not None:
            turns.append(("user", unescaped(m["user"])))
        else:
            turns.append((unescaped(m["role"]), unescaped(m["other"])))
    return turns


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token mask and the exact character range of each token that the loss counts.

    Token spans and turn spans are both sorted, so the tokens of a turn are found by two binary searches; tokens that reach
    over the edge of a turn are clipped to it.
    """
    mask = np.zeros(len(offsets), dtype=bool)
    begin, end = [], []
    for a, b in spans:
        low = int(np.searchsorted(offsets[:, 1], a, side="right"))
        high = int(np.searchsorted(offsets[:, 0], b, side="left"))
        if low < high and a < b:
            mask[low:high] = True
            begin.append(np.clip(offsets[low:high, 0], a, b))
            end.append(np.clip(offsets[low:high, 1], a, b))
    empty = np.zeros(0, dtype=np.int64)
    return mask, np.concatenate(begin) if begin else empty, np.concatenate(end) if end else empty


COLUMNS = "conv_id long, n_turns long, formatted string, input_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start: int, end: int>>"


#: Conversations handled at once in a task.
GROUP = 32


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            yield batch.slice(at, GROUP)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), kind))


def _format(tokenizer: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer)
    encoder.encode_special_tokens = True
    for group in _groups(batches):
        counts, texts, ids, masks, starts, ends = [], [], [], [], [], []
        for turns in group.column("turns").to_pylist():
            pairs = [(t["role"], t["text"]) for t in turns]
            text, spans = render(pairs)
            encoding = encoder.encode(text, add_special_tokens=False)
            offsets = np.array(encoding.offsets, dtype=np.int64).reshape(-1, 2)
            mask, begin, end = loss_mask(offsets, [s for s, (role, _) in zip(spans, pairs, strict=True) if role == "assistant"])
            # several byte-level tokens of one character count it once
            begin = np.maximum(begin, np.concatenate([[0], np.maximum.accumulate(end)[:-1]])) if len(end) else begin
            use = begin < end
            for column, value in zip((counts, texts, ids, masks, starts, ends), (len(pairs), text, np.array(encoding.ids), mask, begin[use], end[use]), strict=True):
                column.append(value)
        spans = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum([len(x) for x in starts])]).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(ends), pa.int32())], ["start", "end"]))
        yield pa.RecordBatch.from_arrays(
            [group.column("conv_id"), pa.array(counts, pa.int64()), pa.array(texts, pa.string()), _lists(ids, pa.int32()), _lists(masks, pa.bool_()), spans],
            ["conv_id", "n_turns", "formatted", "input_ids", "loss_mask", "loss_spans"])


def formatted(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, n_turns, formatted text, input_ids, loss_mask and the masked character spans, one row a conversation.

    A conversation is one training example, so its turns meet in one row; its size is the example's own. Turns are ordered by
    turn, then role and text, nulls first; null roles and texts are empty strings. Rows with a null conv_id form one
    conversation of that name. Repeated turns stay. An empty table gives no rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.mapInArrow(partial(_format, tokenizer), COLUMNS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        rows = [], [], [], [], []
        for text, spans in zip(group.column("formatted").to_pylist(), group.column("loss_spans").to_pylist(), strict=True):
            turns = parse(text)
            turned = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode("utf-8", "surrogatepass"))
            loss = unescaped("".join(text[s["start"]:s["end"]] for s in spans))
            values = len(turns), turned.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)
            for column, value in zip(rows, values, strict=True):
                column.append(value)
        kinds = pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
        yield pa.RecordBatch.from_arrays(
            [group.column("conv_id"), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def chat_report(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Digests read back from the formatted text and its mask."""
    return formatted(conversations, tokenizer).select("conv_id", "formatted", "loss_spans").mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
