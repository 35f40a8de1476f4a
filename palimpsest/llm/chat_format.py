"""Chat formatting (operator 10): conversations as one marked text each, with the spans that a loss is taken over.

A turn is `<|im_start|>` role newline text `<|im_end|>` newline. Inside texts and roles, a backslash goes after the
first character of every control string of CONTROL (one more where backslashes stand there already), so none is left
and taking one away again gives the text back. In roles, backslashes and newlines are escaped first.

A batch of turns is assembled column by column: segment lengths, cumulative offsets and scatter indices in numpy, and
one copy of markers, roles and texts into one buffer, which becomes the Arrow column. Conversations are dealt out by
conv_id and sorted; one that goes over the end of a batch is carried on.

Null texts and roles are empty. Rows that repeat a turn are turns of their own, in the order of role and text. Turns
without conv_id are one conversation. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common as c

#: Control strings of common chat templates, first characters and the rest.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>\n"
_TAILS = "|".join(re.escape(x[1:]) for x in CONTROL)
ESCAPE, ESCAPED = rf"([<\[])(\\*)({_TAILS})", r"\1\\\2\3"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
FORMATTED = "conv_id bigint, formatted string, n_turns bigint, loss_starts array<bigint>, loss_ends array<bigint>"
_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escaped(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(text.fill_null("").cast(pa.string()), ESCAPE, ESCAPED)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def escaped_role(role: pa.Array) -> pa.Array:
    role = pc.replace_substring(role.fill_null("").cast(pa.string()), "\\", "\\\\")
    return escaped(pc.replace_substring(role, "\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
    """Copies each segment of data to its place."""
    size = np.diff(at)
    out[np.arange(len(data)) + np.repeat(to - at[:-1], size)] = data


def assembled(turns: pa.Table) -> pa.RecordBatch:
    """Sorted turns of whole conversations, a row for each conversation."""
    turns = turns.combine_chunks()
    role_data, role_at = c.text_bytes(escaped_role(turns["role"].combine_chunks()))
    text_data, text_at = c.text_bytes(escaped(turns["text"].combine_chunks()))
    n = turns.num_rows
    size = np.stack([np.full(n, len(OPEN)), np.diff(role_at), np.ones(n, int), np.diff(text_at), np.full(n, len(CLOSE))], 1)
    at = np.concatenate([[0], np.cumsum(size)])
    to = at[:-1].reshape(n, 5)
    out = np.empty(at[-1], np.uint8)
    out[to[:, :1] + np.arange(len(OPEN))] = np.frombuffer(OPEN, np.uint8)
    _scatter(out, to[:, 1], role_data, role_at)
    out[to[:, 2]] = 10
    _scatter(out, to[:, 3], text_data, text_at)
    out[to[:, 4:] + np.arange(len(CLOSE))] = np.frombuffer(CLOSE, np.uint8)
    conv = turns["conv_id"].combine_chunks()
    key, none = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (none[1:] != none[:-1])]))
    bounds = np.append(to[starts, 0], at[-1])
    loss = pc.equal(turns["role"].combine_chunks(), "assistant").fill_null(False).to_numpy(zero_copy_only=False)
    base = np.repeat(bounds[:-1], np.diff(starts, append=n))
    before = np.concatenate([[0], np.cumsum(loss)])[np.append(starts, n)].astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(x[loss], pa.int64())) for x in (to[:, 3] - base, to[:, 4] - base)]
    text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    return pa.record_batch({"conv_id": conv.take(pa.array(starts)), "formatted": text, "n_turns": pa.array(np.diff(starts, append=n), pa.int64()), "loss_starts": spans[0], "loss_ends": spans[1]})


def _format(batches):
    rest: list[pa.RecordBatch] = []  # of the conversation at the end of what came so far
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id")
        same = conv.is_null() if not conv[-1].is_valid else pc.equal(conv, conv[-1]).fill_null(False)
        tail = int(pc.sum(same).as_py())
        if tail == batch.num_rows and (not rest or rest[-1].column("conv_id")[-1] == conv[-1] or rest[-1].column("conv_id")[-1].is_valid == conv[-1].is_valid == False):  # noqa: E712
            rest.append(batch)
            continue
        head = [*rest, batch.slice(0, batch.num_rows - tail)]
        rest = [batch.slice(batch.num_rows - tail)]
        if sum(b.num_rows for b in head):
            yield assembled(pa.Table.from_batches(head))
    if rest:
        yield assembled(pa.Table.from_batches(rest))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, n_turns, and the byte spans of assistant texts in formatted (a list of starts, one of ends)."""
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(_format, FORMATTED)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    open_, close, out = OPEN.decode(), CLOSE.decode(), []
    for turn in formatted.split(close)[:-1]:
        if not turn.startswith(open_):
            raise ValueError("a turn doesn't start with its marker")
        role, text = turn[len(open_) :].split("\n", 1)
        out.append((unescaped_role(role), unescaped(text)))
    return out


def _read_back(batches):
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            turns = parsed(row["formatted"])
            data = row["formatted"].encode()
            loss = "".join(unescaped(data[i:j].decode()) for i, j in zip(row["loss_starts"], row["loss_ends"]))
            whole = "".join(f"{r}\n{t}\n" for r, t in turns)
            out.append((row["conv_id"], len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(row["formatted"])))
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    return format_chats(rows.unionByName(probe)).mapInArrow(_read_back, _DIGEST)


_SQL_TAILS = "|".join(re.escape(x[1:]).replace("\\<", "<").replace("\\>", ">") for x in CONTROL)
SQL = {
    "op10_chat_format": rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role = 'assistant' AS loss FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', false
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', true)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (loss), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (loss), '')) AS loss_sha256,
  CAST(sum(length(role) + length(regexp_replace(text, '([<\[])(\\*)({_SQL_TAILS})', '\1\\\2\3', 'g')) + {len(OPEN) + 1 + len(CLOSE)}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""",
}
QUERIES = {"op10_chat_format": op10_chat_format}
