"""Chat formatting with offset-aligned loss masks.

A turn is rendered as ``<|turn|>`` role ``<|body|>`` text ``<|end|>``; a conversation is its turns, one after the other.
Inside roles and texts every ``<``, ``!``..., ``|`` gets one more ``!`` (``<|`` becomes ``<!|``, ``<!|`` becomes
``<!!|``), so no marker can arise there, and taking one ``!`` away again restores them exactly. Strings that are control
strings of other templates are ordinary text.

The rendered conversation is encoded once, with offsets. The markers are added tokens, at which the tokenizer splits
before anything else, so no token reaches over a turn's edge. Spans of turns and of tokens are both sorted, and a binary
search intersects them: a token is under the loss mask if it lies in the body of an assistant's turn.

Because tokens never cross a marker, a conversation may be encoded in blocks of whole turns with the same result; that
bounds memory where one conversation holds a large part of all rows. Rows are dealt by conv_id and sorted, and each
conversation streams through its task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, pre_tokenizers, processors

from corpusloom.llm.common import column, small_batches

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
TRAINED_ROLE = "assistant"
TOKENIZER = "byte_bpe_50k.json"
#: Characters of whole turns that are encoded at once; a single turn may be longer.
BLOCK = 1 << 18
#: Rendered characters that are encoded in one call over many conversations.
CALL = 1 << 20
_ESCAPE, _UNESCAPE = re.compile(r"<(!*)\|"), re.compile(r"<!(!*)\|")
_PARSE = re.compile(r"<\|turn\|>(.*?)<\|body\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<!\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str | None, str | None]]) -> str:
    """(role, text) pairs to one string; null counts as empty."""
    return "".join(f"{TURN}{escape(role or '')}{BODY}{escape(text or '')}{END}" for role, text in turns)


def parse(rendered: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that ``render`` was given."""
    return [(unescape(role), unescape(text)) for role, text in _PARSE.findall(rendered)]


def bodies(rendered: str, role: str = TRAINED_ROLE) -> np.ndarray:
    """Spans [start, end) of the bodies of a role's turns, in code points, sorted."""
    return np.array([m.span(2) for m in _PARSE.finditer(rendered) if unescape(m[1]) == role], np.int64).reshape(-1, 2)


def loss_mask(tokens: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each token span [start, end) whether it lies in one of the sorted spans."""
    if not len(spans) or not len(tokens):
        return np.zeros(len(tokens), bool)
    at = np.searchsorted(spans[:, 0], tokens[:, 0], side="right") - 1
    own = np.maximum(at, 0)
    return (at >= 0) & (tokens[:, 1] <= spans[own, 1]) & (tokens[:, 1] > tokens[:, 0])


def chat_tokenizer(path: str | None = None) -> Tokenizer:
    """The tokenizer with the three markers added; offsets keep leading spaces."""
    t = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_special_tokens([AddedToken(m, normalized=False) for m in (TURN, BODY, END)])
    return t


@dataclass
class Block:
    """Whole turns of one conversation, rendered and encoded."""

    conv: int | None
    rendered: str
    ids: list[int]
    tokens: np.ndarray
    mask: np.ndarray

    def loss_text(self) -> str:
        """The text under the loss mask, unescaped turn by turn, read back from offsets and mask."""
        out = []
        for start, end in bodies(self.rendered).tolist():
            lo, hi = np.searchsorted(self.tokens[:, 0], [start, end])
            inside = self.tokens[lo:hi][self.mask[lo:hi]]
            if not len(inside):
                continue
            reach = np.maximum.accumulate(inside[:, 1])  # a character of several tokens has the same span in each
            gaps = np.flatnonzero(inside[1:, 0] > reach[:-1])
            parts = zip([inside[0, 0], *inside[gaps + 1, 0]], [*reach[gaps], reach[-1]], strict=True)
            out.append(unescape("".join(self.rendered[x:y] for x, y in parts)))
        return "".join(out)


def _encoded(tokenizer: Tokenizer, waiting: list[tuple[int | None, str]]) -> Iterator[Block]:
    for (conv, rendered), e in zip(waiting, tokenizer.encode_batch([r for _, r in waiting], add_special_tokens=False), strict=True):
        tokens = np.array(e.offsets, np.int64).reshape(-1, 2)
        yield Block(conv, rendered, e.ids, tokens, loss_mask(tokens, bodies(rendered)))


def blocks(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[Block]:
    """Rows sorted by conversation and turn to encoded blocks in order: one for each conversation of up to ``BLOCK`` characters."""
    tokenizer = chat_tokenizer(path)
    waiting: list[tuple[int | None, str]] = []
    own: list[str] = []
    size = waits = 0
    conv: object = own
    for batch in batches:
        for c, role, text in zip(*(column(batch, n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if own and (c != conv or size >= BLOCK):
                waiting.append((conv, "".join(own)))
                waits += size
                own, size = [], 0
                if waits >= CALL:
                    yield from _encoded(tokenizer, waiting)
                    waiting, waits = [], 0
            conv = c
            own.append(render([(role, text)]))
            size += len(own[-1])
    if own:
        waiting.append((conv, "".join(own)))
    if waiting:
        yield from _encoded(tokenizer, waiting)


def _by_conversation(conversations: DataFrame) -> DataFrame:
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, block, rendered, input_ids, loss_mask) of ``conversations`` (conv_id, turn, role, text; others are ignored).

    Rows are ordered by turn, then role, then text, nulls first; equal rows are turns of their own. Null roles and texts
    are empty; rows with a null conv_id are one conversation. ``block`` numbers the blocks of a conversation, from 0. An
    empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, int] = (run, 0)
        for b in blocks(batches, tokenizer):
            last = (b.conv, last[1] + 1 if b.conv == last[0] else 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.conv], pa.int64()), pa.array([last[1]], pa.int32()), pa.array([b.rendered]), pa.array([b.ids], pa.list_(pa.int32())), pa.array([b.mask.tolist()], pa.list_(pa.bool_()))],
                ["conv_id", "block", "rendered", "input_ids", "loss_mask"],
            )

    return _by_conversation(conversations).mapInArrow(run, "conv_id long, block int, rendered string, input_ids array<int>, loss_mask array<boolean>")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def digests(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row for each conversation with digests of what is read back from its blocks; nulls and ties as above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now: list | None = None
        for b in blocks(batches, tokenizer):
            if now is None or b.conv != now[0]:
                if now is not None:
                    rows.append(tuple(now))
                now = [b.conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, text in parse(b.rendered):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            loss = b.loss_text()
            now[3] += len(loss)
            now[4].update(loss.encode("utf-8", "surrogatepass"))
            now[5] += len(b.rendered)
            now[6] += len(b.ids)
            now[7] += int(b.mask.sum())
            if len(rows) >= 10_000:
                yield _digest_batch(rows)
                rows = []
        if now is not None:
            rows.append(tuple(now))
        if rows:
            yield _digest_batch(rows)

    return _by_conversation(conversations).mapInArrow(run, DIGEST)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = [[v.hexdigest() if hasattr(v, "hexdigest") else v for v in c] for c in zip(*rows, strict=True)]
    kinds = [pa.string() if "string" in f else pa.int64() for f in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in DIGEST.split(", ")])


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the whole table ``conversations`` and conversation -7, whose texts are control strings of another template."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return digests(table.unionByName(added)).drop("n_tokens", "n_loss_tokens")


SQL = r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS a, coalesce(text, '') AS b FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(a || chr(10) || b || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
coalesce(sum(length(b)) FILTER (a = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(b, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (a = 'assistant'), '')) AS loss_sha256,
sum(8 + 8 + 7 + length(regexp_replace(a, '<(!*)\|', '<!\1|', 'g')) + length(regexp_replace(b, '<(!*)\|', '<!\1|', 'g')))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
