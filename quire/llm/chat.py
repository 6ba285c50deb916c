"""Chat formatting: conversations as one byte string each, assembled column-wise, with loss masks.

A turn is `[INST] role\\ntext[/INST]`, an assistant's turn `<s> role\\ntext</s>`. Control strings inside roles and
texts are escaped by one more backslash after their first character, which reading back takes away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import buffer_of

ASSISTANT = "assistant"
# The template's control strings.
MARKS = {False: ("[INST] ", "[/INST]"), True: ("<s> ", "</s>")}
_CONTROL = r"([\[<])(\\*)(/?INST\]|/?s>)"
_ESCAPED = re.compile(rb"([\[<])\\(\\*)(/?INST\]|/?s>)")
_TURN = re.compile(rb"(?:\[INST\]|<s>) ([^\n]*)\n(.*?)(?:\[/INST\]|</s>)", re.S)
FORMATTED = "conv_id long, formatted string, mask array<struct<start: long, length: long>>"
#: Bytes of text that are assembled at a time (a longer conversation is assembled whole).
STEP_BYTES = 8 << 20


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=_CONTROL, replacement=r"\1\\\2\3")


def unescape(data: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1\2\3", data)


def _role_out(role: str) -> str:
    return re.sub(_CONTROL, r"\1\\\2\3", role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(data: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(data), flags=re.S)


def _scatter(out: np.ndarray, to: np.ndarray, source: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
    """Copy source[at : at + size] to out[to : to + size] for every row at once."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return
    lane = np.arange(ends[-1]) - np.repeat(ends - size, size)
    out[lane + np.repeat(to, size)] = source[lane + np.repeat(at, size)]


def assemble(conv: np.ndarray, ids: pa.Array, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Rows of whole conversations in order -> FORMATTED. conv: the number of each row's conversation, from 0."""
    coded = roles.fill_null("").dictionary_encode()
    names = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy()
    heads = [MARKS[n == ASSISTANT][0].encode() + _role_out(n).encode() + b"\n" for n in names]
    feet = [MARKS[n == ASSISTANT][1].encode() for n in names]
    body, offsets = buffer_of(escape(texts.fill_null("")))
    blob = np.frombuffer(b"".join(heads + feet), np.uint8)
    sizes = np.array([len(x) for x in heads + feet], np.int64)
    begins = np.cumsum(sizes) - sizes
    head, text, foot = sizes[code], np.diff(offsets), sizes[code + len(names)]
    ends = np.cumsum(head + text + foot)
    start = ends - (head + text + foot)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    _scatter(out, start, blob, begins[code], head)
    _scatter(out, start + head, body, offsets[:-1], text)
    _scatter(out, start + head + text, blob, begins[code + len(names)], foot)
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]]) if len(conv) else np.zeros(0, np.int64)
    cuts = np.r_[start[first], len(out)].astype(np.int64)
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(cuts), pa.py_buffer(out)).cast(pa.string())
    told = np.flatnonzero(np.array([n == ASSISTANT for n in names], bool)[code])
    spans = pa.StructArray.from_arrays([pa.array(start[told] + head[told] - cuts[conv[told]]), pa.array(text[told])], ["start", "length"])
    mask = pa.ListArray.from_arrays(pa.array(np.searchsorted(conv[told], np.arange(len(first) + 1)).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), formatted, mask], ["conv_id", "formatted", "mask"])


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> FORMATTED, one row per conversation; mask: byte spans of the assistants' texts.

    Turns go by turn, then role, then text, nulls first. Null roles and texts are empty. Rows with a null conv_id are
    one conversation. Repeated rows are repeated turns. An empty table gives no rows. Other columns are not read. A
    conversation of over 2 GiB, which no row can hold, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()
            if not rows:
                return
            if len(rows) > 1:  # strings past 2 GiB do not combine
                raise OverflowError("a conversation of over 2 GiB fits no row")
            rows = rows[0]
            key = rows.column(0).fill_null(0).to_numpy()
            null = rows.column(0).is_null().to_numpy(zero_copy_only=False)
            change = np.r_[False, (key[1:] != key[:-1]) | (null[1:] != null[:-1])]
            end = rows.num_rows if last else int(np.flatnonzero(change)[-1]) if change.any() else 0
            if end:
                part = rows.slice(0, end)
                yield assemble(np.cumsum(change)[:end], part.column(0), part.column(1), part.column(2))
            held = [rows.slice(end)]
            size = held[0].nbytes

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                held.append(batch.slice(at, 2000))
                size += held[-1].nbytes
                if size > STEP_BYTES:
                    yield from solve(False)
        if held:
            yield from solve(True)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(run, FORMATTED)


def turns_of(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn."""
    return [(_role_in(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def read_back(chats: DataFrame) -> DataFrame:
    """FORMATTED -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the formatted bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, mask in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                data = data.as_py()
                turns = turns_of(data)
                loss = b"".join(unescape(data[s["start"] : s["start"] + s["length"]]) for s in mask.as_py())
                whole = hashlib.sha256()
                for role, text in turns:
                    whole.update(role + b"\n" + text + b"\n")
                rows.append((len(turns), whole.hexdigest(), len(loss.decode()), hashlib.sha256(loss).hexdigest(), len(data.decode())))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
