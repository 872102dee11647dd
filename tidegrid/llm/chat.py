"""Chat formatting by columnar byte assembly.

A turn becomes `<|im_start|>role`, a line end, the text, `<|im_end|>` and a line end. Control strings inside roles and texts (these two, any other
`<|`, and the `<s>`, `[INST]` and `<<SYS>>` families) get a backslash behind their first character, one more than they have, so no control string
stands inside a text and unescaping gives back every text exactly. The loss mask of a turn covers the text of assistant turns.

Assembly. For a batch of turns the segment lengths give cumulative offsets, these give the scatter indices of headers, contents and endings, and
numpy copies all bytes into one preallocated buffer that becomes the Arrow column. The formatted turns of a conversation, in the order of its turns,
are its formatted text. Readers take the turns sorted by conversation, one at a time: a conversation of any length needs no more memory than a turn.
The digest of a conversation runs over its turns in order, so one conversation is read back in one task, however many turns it has.

Edge cases: null texts and roles count as empty; equal turn numbers are ordered by role, then text, both as escaped; a null conv_id is a conversation of its own and
null turns come first; an empty conversation doesn't exist; repeated rows are turns of their own; other columns are ignored.
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

from .common import map_texts, short_batches, slices, table

#: The template, and what is escaped in texts.
START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
ESCAPED = re.compile(r"([<\[])\\(\\*)(\||/?s>|/?INST\]|</?SYS>>)")

#: Bytes from which a segment is copied as a slice.
SEGMENT = 4096

FORMATTED = "conv_id long, turn long, formatted string, loss_start long, loss_stop long, n_chars long"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(column, ""), CONTROL, r"\1\\\2\3")


def escape_role(column: pa.Array) -> pa.Array:
    """A role ends at the line end, so line ends and backslashes in it are written as two characters."""
    plain = pc.replace_substring(pc.replace_substring(pc.fill_null(column, ""), "\\", "\\\\"), "\n", "\\n")
    return escape(plain)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
    """Copy segment i, data[starts[i]:][:sizes[i]], to out[to[i]:]: short segments by one index array for many, long ones each as a slice."""
    for i in np.flatnonzero(sizes > SEGMENT).tolist():
        out[to[i] : to[i] + sizes[i]] = data[starts[i] : starts[i] + sizes[i]]
    short = np.flatnonzero(sizes <= SEGMENT)
    to, starts, sizes = to[short], starts[short], sizes[short]
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(to, sizes) + within] = data[np.repeat(starts, sizes) + within]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string column's bytes, and where each value starts and how long it is."""
    column = pa.concat_arrays([column.cast(pa.large_string())])
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def assemble(columns: list[pa.Array | bytes]) -> tuple[pa.Array, list[np.ndarray]]:
    """Row by row, the columns' values (constants: the same bytes in each row) behind one another; and each column's sizes in bytes."""
    rows = max(len(c) for c in columns if not isinstance(c, bytes))
    parts = []
    for c in columns:
        if isinstance(c, bytes):
            parts.append((np.frombuffer(c, np.uint8), np.zeros(rows, np.int64), np.full(rows, len(c), np.int64)))
        else:
            parts.append(bytes_of(c))
    sizes = [p[2] for p in parts]
    total = np.sum(sizes, axis=0)
    ends = np.cumsum(total)
    out = np.empty(int(ends[-1]) if rows else 0, np.uint8)
    at = ends - total
    for data, starts, size in parts:
        scatter(out, at, data, starts, size)
        at = at + size
    offsets = np.r_[0, ends].astype(np.int64)
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string()), sizes


def format_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, turn, formatted; loss_start and loss_stop: the code points under the loss mask (equal: none)."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            role, text = escape_role(batch.column("role")), escape(batch.column("text"))
            formatted, _ = assemble([START, role, MIDDLE, text, END])
            start = np.asarray(pc.utf8_length(role)).astype(np.int64) + len(START) + len(MIDDLE)
            size = np.where(np.asarray(pc.equal(role, "assistant")), np.asarray(pc.utf8_length(text)), 0)
            return {
                "conv_id": batch.column("conv_id"),
                "turn": batch.column("turn"),
                "formatted": formatted,
                "loss_start": pa.array(start),
                "loss_stop": pa.array(start + size),
                "n_chars": pc.utf8_length(formatted).cast(pa.int64()),
            }

        return step

    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"]
    return map_texts(df, columns, "text", FORMATTED, make)


def read_turn(formatted: str) -> tuple[str, str]:
    """The role and the text that a formatted turn states."""
    head, end = START.decode(), END.decode()
    if not (formatted.startswith(head) and formatted.endswith(end)):
        raise ValueError("not a formatted turn")
    role, _, text = formatted[len(head) : -len(end)].partition("\n")
    return unescape_role(role), unescape(text)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its formatted turns say when they are read back."""
    order = ["conv_id", "turn", "formatted"]
    tasks = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = formatted.repartition(tasks, "conv_id").sortWithinPartitions(*order)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state: list | None = None
        for batch in slices(batches, "formatted"):
            done = []
            for conv, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_stop"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(closed(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = read_turn(text)
                loss = unescape(text[a:b])
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(closed(state), types)], names=names)

    return short_batches(rows).mapInArrow(task, DIGESTS)


def closed(state: list) -> tuple:
    return tuple(x.hexdigest() if hasattr(x, "hexdigest") else x for x in state)


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(format_turns(turns.unionByName(probe)))


QUERIES = {"op8_chat_formatting": op8_chat_formatting}
ORACLE_SQL: dict[str, str] = {}
