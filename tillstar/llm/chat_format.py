r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, turn after turn::

    ### Assistant: <text></turn>\n

``### `` opens a header, ``: `` ends it and ``</turn>`` ends the text. Inside texts a backslash
is doubled and the two control strings are broken by one (``#\## ``, ``<\/turn>``), so they never
occur there as such, and taking one backslash away from each pair ``\x`` gives the text back.

The rendered text is encoded once, with offsets: places in its UTF-8 bytes, the running sum of the
tokens' lengths. Headers and turn ends are special tokens, which split a text before anything
else, so no token crosses the edge of a turn's text. The loss spans (texts of the given roles) and
the tokens are both sorted by place: two binary searches a span give its tokens, and those are the
loss mask.

Rows come to a task by conversation and by ``PIECE_TURNS`` turn numbers, sorted, and stream
through it: a conversation of any length is cut between turns into pieces of bounded size, each
rendered and encoded as a whole. The marks keep turns apart in the tokenizer, so pieces have the
tokens that the uncut conversation would have.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.llm.common import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECE_TURNS = 512
PIECE_CHARS = 1 << 20

# The template.
HEAD, COLON, END = "### ", ": ", "</turn>"
ROLE_NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
NO_ROLE = "\\N"
# Fixed value: how the tokenizer's vocabulary was cut into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = 1 << 16
_LONG_SPACE = re.compile(rf"\s{{{SPACES + 1}}}")

PIECE = "conv_id long, chunk long, part int, first_turn long, n_turns long, text string, token_ids array<int>, loss_tokens array<struct<first:int,end:int>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(END, "<\\/turn>").replace(HEAD, "#\\## ")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def role_name(role: str | None) -> str:
    """A role as headers spell it; ``role_of`` reads it back."""
    if role is None:
        return NO_ROLE
    if role in ROLE_NAMES:
        return ROLE_NAMES[role]
    out = escape(role).replace(COLON, ":\\ ")
    if out.endswith(":"):
        out = out[:-1] + "\\:"
    return "\\" + out if role in ROLE_NAMES.values() else out


def role_of(name: str) -> str | None:
    if name == NO_ROLE:
        return None
    return {v: k for k, v in ROLE_NAMES.items()}.get(name) or unescape(name)


def render(turns: list[tuple[str | None, str]]) -> tuple[str, list[tuple[str | None, int, int]]]:
    """The formatted text of some turns, and (role, start, end) of each escaped text in its bytes."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = HEAD + role_name(role) + COLON, escape(text)
        at += len(head.encode())
        end = at + len(body.encode())
        spans.append((role, at, end))
        at = end + len(END) + 1
        parts += [head, body, END, "\n"]
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str | None, str]]:
    """The turns of a formatted text."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(HEAD, at):
            raise ValueError(f"no header at {at}")
        colon = text.index(COLON, at)
        end = text.index(END, colon + len(COLON))
        out.append((role_of(text[at + len(HEAD) : colon]), unescape(text[colon + len(COLON) : end])))
        at = end + len(END) + 1
    return out


class Coder:
    """A byte-level tokenizer from a file of ranks, with a token of its own for each known header and for the turn end."""

    def __init__(self, ranks: bytes, pattern: str, roles: tuple[str, ...]):
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        marks = [*sorted({HEAD + role_name(r) + COLON for r in (*ROLE_NAMES, *roles)}), END]
        own = {m: max(known.values()) + 1 + i for i, m in enumerate(marks)}
        self.core = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=known, special_tokens=own)
        self.length = np.zeros(max(own.values()) + 1, np.int64)
        for word, i in known.items():
            self.length[i] = len(word)
        for word, i in own.items():
            self.length[i] = len(word.encode())

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids, and [start, end) of each token in the text's bytes. White space beyond ``SPACES``
        characters on end is encoded in stretches, which the pattern could not match whole."""
        parts = re.split(rf"(\s{{{SPACES}}})", text) if _LONG_SPACE.search(text) else [text]
        ids = np.concatenate([self.core.encode_to_numpy(x, allowed_special="all") for x in parts]).astype(np.int64)
        ends = np.cumsum(self.length[ids])
        return ids, np.stack([ends - self.length[ids], ends], axis=1)

    def decode(self, ids: list[int]) -> str:
        return self.core.decode_bytes(ids).decode()


def model_of(spark: SparkSession, path: str):
    """The tokenizer's file, read by the driver and sent to the tasks (under a MB, whatever the tables)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def masked(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """[first, end) of the tokens under each span; both are sorted, (start, end) a row."""
    first = np.searchsorted(offsets[:, 1], spans[:, 0], side="right")
    end = np.searchsorted(offsets[:, 0], spans[:, 1], side="left")
    return np.stack([first, np.maximum(first, end)], axis=1)


def format_conversations(
    rows: DataFrame,
    roles: tuple[str, ...] = ("assistant",),
    tokenizer: str = TOKENIZER,
    pattern: str = PATTERN,
    chunk_turns: int = PIECE_TURNS,
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """Pieces of formatted conversations: conv_id, chunk, part, first_turn, n_turns, text, token_ids, loss_tokens.

    ``rows`` has conv_id, turn, role, text; other columns are ignored. Turns come by their number,
    null first, rows of one number by role (null first), then by the MD5 of the text, then the
    text; repeated rows are turns of their own. A null text is empty, a null role is marked as
    none, and rows without conv_id make one conversation. Pieces of a conversation follow one
    another by (chunk, part): conversations of less than ``chunk_turns`` turns and
    ``piece_chars`` characters are one piece, and a very long text is a piece by itself.
    ``loss_tokens`` lists the runs [first, end) of tokens under the loss mask, one per turn of
    ``roles``; an empty text has an empty run. No rows in, no rows out.
    """
    model = model_of(rows.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Coder(model.value, pattern, roles)
        held: list[tuple[str | None, str]] = []
        key, part, first, size, ready = None, 0, None, 0, 0
        out: list[tuple] = []

        def piece() -> tuple:
            text, spans = render(held)
            ids, offsets = t.encode(text)
            wanted = np.array([(a, b) for r, a, b in spans if r in roles], np.int64).reshape(-1, 2)
            runs = masked(offsets, wanted)
            return (*key, part, first, len(held), text, ids, [{"first": int(a), "end": int(b)} for a, b in runs])

        def batch_of(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

        for batch in batches:
            for conv, chunk, turn, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "chunk", "turn", "role", "text")]):
                same = (conv, chunk) == key
                if held and not (same and size + len(text) <= piece_chars):
                    out.append(piece())
                    ready += size
                    held, size, part = [], 0, part + 1
                    if ready > piece_chars:
                        yield batch_of(out)
                        out, ready = [], 0
                if not held:
                    key, first, part = (conv, chunk), turn, part if same else 0
                held.append((role, text))
                size += len(text)
        if held:
            out.append(piece())
        if out:
            yield batch_of(out)

    names = ["conv_id", "chunk", "part", "first_turn", "n_turns", "text", "token_ids", "loss_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))]
    turns = rows.select(
        F.col("conv_id").cast("long"),
        F.coalesce(F.floor(F.col("turn") / chunk_turns), F.lit(-(1 << 62))).cast("long").alias("chunk"),
        F.col("turn").cast("long"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = turns.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "role", F.md5(F.col("text").cast("binary")), "text")
    return dealt.mapInArrow(run, PIECE)


def read_back(pieces: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Pieces read again: ``turns`` (each as role, newline, text, newline) from the formatted text,
    ``loss`` from the tokens under the mask, decoded and unescaped, with the pieces' keys and sizes."""
    model = model_of(pieces.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Coder(model.value, pattern, roles)
        for batch in batches:
            turns, losses, sizes = [], [], []
            for text, ids, runs in zip(*[batch.column(c).to_pylist() for c in ("text", "token_ids", "loss_tokens")]):
                turns.append("".join(f"{r or ''}\n{x}\n" for r, x in parse(text)))
                losses.append("".join(unescape(t.decode(ids[r["first"] : r["end"]])) for r in runs))
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("conv_id", "chunk", "part", "n_turns")], pa.array(turns, pa.string()), pa.array(losses, pa.string()), pa.array(sizes, pa.int64())],
                ["conv_id", "chunk", "part", "n_turns", "turns", "loss", "n_chars"],
            )

    return pieces.mapInArrow(run, "conv_id long, chunk long, part int, n_turns long, turns string, loss string, n_chars long")


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation from its pieces in order; only running hashes are held, one conversation at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done: list[tuple] = []

        def row() -> tuple:
            return (key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            for conv, n, turns, loss, size in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "turns", "loss", "n_chars")]):
                if key is None or key[0] != conv:
                    if key is not None:
                        done.append(row())
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(turns.encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += size
            if done:
                yield out(done)
                done = []
        if key is not None:
            yield out([row()])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "part")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


# The contract's own conversation.
EXTRA_CONV = -7
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(EXTRA_CONV).cast("long").alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(EXTRA_TEXT).alias("text"),
    )
    return digests(read_back(format_conversations(rows.unionByName(more))))


def _sql_escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '\\', '\\\\'), '</turn>', '<\\/turn>'), '### ', '#\\## ')"


OP13_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA_CONV}, 0, 'user', '{EXTRA_TEXT}' UNION ALL SELECT {EXTRA_CONV}, 1, 'assistant', '{EXTRA_TEXT}'),
r AS (
  SELECT *, CASE WHEN role IS NULL THEN '\N' WHEN role IN ('user', 'assistant', 'system') THEN upper(role[1]) || role[2:]
                 ELSE CASE WHEN role IN ('User', 'Assistant', 'System') THEN '\' ELSE '' END
                   || regexp_replace(replace({_sql_escaped('role')}, ': ', ':\ '), ':$', 'x:') END AS name FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, md5(text)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(name) + 2 + length({_sql_escaped('text')}) + 8)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
