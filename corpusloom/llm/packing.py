"""Hierarchical multi-length packing of tokenized documents.

A document is its token ids and one end id. Whole windows of the longest context are cut from long documents first; what
is left of a document is routed to the smallest of ``TIERS`` that holds it. Each tier is packed in turn, from the longest
down: a document opens a sequence of its tier and the gap behind it is filled from shorter tiers, with the longest pieces
that fit whole, then with a piece cut to measure. What can't be filled any more is laid end to end and cut into exact
tier lengths. So all sequences but the last of a pool have exactly the length of a tier, a power of two, and need no
padding; that last one is padded to the longest context.

Pools are formed inside each input partition, up to ``POOL`` tokens at a time: no shuffle, bounded memory, and a lost
task is recomputed alike, for a pool depends on its partition's rows only. Step groups hold ``STEP`` tokens each of one
tier, so that every optimizer step is equally large.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import column, small_batches

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens of documents packed together.
POOL = 1 << 20
#: Tokens of a step group.
STEP = 16 * 2048
TOKENIZER = "byte_bpe_50k.json"
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, sequence_tokens long, padded_tokens long, step_group long"
)


def byte_level_encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a ``tokenizers`` file, run by tiktoken: the same ids several times as fast.

    The file's vocabulary lists the 256 bytes and then the merges in order of priority, so an entry's id is its rank.
    Its added tokens cut a text before anything else and are one id each, as ``tokenizers`` has it; those that match
    otherwise than by their plain string, or of which one begins with another, are refused.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    odd = any(t["single_word"] or t["lstrip"] or t["rstrip"] or (t["normalized"] and spec["normalizer"]) for t in spec["added_tokens"])
    if odd or any(a != b and a.startswith(b) for a in special for b in special):
        raise ValueError(f"added tokens of {path} are not plain strings")
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Pool:
    """Packs the lengths of one pool. Pieces are (document's index, start, length)."""

    def __init__(self, lengths: list[int], tiers: tuple[int, ...] = TIERS):
        self.tiers, self.sequences = tiers, []  # (tier, pieces)
        top = tiers[-1]
        #: by tier, [(length, document, start)] in ascending order
        self.shelves: list[list[tuple[int, int, int]]] = [[] for _ in tiers]
        for i, n in enumerate(lengths):
            whole = n // top * top
            self.sequences += [(top, [(i, at, top)]) for at in range(0, whole, top)]
            if n > whole:
                self.shelves[self._tier(n - whole)].append((n - whole, i, whole))
        for shelf in self.shelves:
            shelf.sort()
        rest = []
        for t in reversed(range(len(tiers))):
            while self.shelves[t]:
                n, i, start = self.shelves[t].pop()
                pieces = [(i, start, n)] + self._fill(tiers[t] - n, t)
                full = sum(p[2] for p in pieces) == tiers[t]
                if full:
                    self.sequences.append((tiers[t], pieces))
                else:
                    rest += pieces
        self._lay(rest)

    def _tier(self, n: int) -> int:
        return bisect.bisect_left(self.tiers, n)

    def _fill(self, gap: int, below: int) -> list[tuple[int, int, int]]:
        """Pieces from tiers under ``below`` that fill the gap exactly, or whatever they still hold."""
        pieces = []
        while gap:
            for t in reversed(range(below)):  # the longest document that fits whole
                k = bisect.bisect_right(self.shelves[t], (gap, float("inf"), 0)) - 1
                if k >= 0:
                    n, i, start = self.shelves[t].pop(k)
                    pieces.append((i, start, n))
                    gap -= n
                    break
            else:  # none fits: cut one to measure
                t = next((t for t in range(below) if self.shelves[t]), None)
                if t is None:
                    return pieces
                n, i, start = self.shelves[t].pop()
                pieces.append((i, start, gap))
                bisect.insort(self.shelves[self._tier(n - gap)], (n - gap, i, start + gap))
                gap = 0
        return pieces

    def _lay(self, rest: list[tuple[int, int, int]]) -> None:
        """Lay pieces end to end and cut them into exact tiers; the remainder is one sequence of the longest tier."""
        total = sum(p[2] for p in rest)
        rest = rest[::-1]
        while total:
            tier = next((t for t in reversed(self.tiers) if t <= total), None)
            room = tier or total
            total -= room
            pieces = []
            while room:
                i, start, n = rest.pop()
                took = min(n, room)
                pieces.append((i, start, took))
                room -= took
                if took < n:
                    rest.append((i, start + took, n - took))
            self.sequences.append((tier or self.tiers[-1], pieces))


def pack(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL, step_tokens: int = STEP, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text; other columns are ignored).

    ``tokenizer``: path of a byte-level BPE file of ``tokenizers``. ``with_ids`` adds the ids themselves (``input_ids``).
    A null or empty text is the end id alone; a null doc_id stays null; equal rows are packed as often as they come. An
    empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    schema = SCHEMA + (", input_ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level_encoder(path)
        first = TaskContext.get().partitionId() << 33
        state = {"sequence": first, "steps": {t: [0, 0] for t in tiers}}
        ids, arrays, total = [], [], 0
        for batch in batches:
            for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                ids.append(doc)
                arrays.append(np.array([*encoder.encode(text or "", allowed_special="all"), END_ID], np.uint32))
                total += len(arrays[-1])
                if total >= pool_tokens:
                    yield _packed(ids, arrays, state, first)
                    ids, arrays, total = [], [], 0
        if ids:
            yield _packed(ids, arrays, state, first)

    def _packed(ids: list, arrays: list[np.ndarray], state: dict, first: int) -> pa.RecordBatch:
        out = [[] for _ in range(11)]
        pieces_ids = []
        for tier, pieces in Pool([len(a) for a in arrays], tiers).sequences:
            filled = sum(p[2] for p in pieces)
            padded = filled if filled & (filled - 1) == 0 else tiers[-1]
            step = state["steps"][tier]
            group = first + (step[0] * len(tiers) + tiers.index(tier))
            at = 0
            for i, start, n in pieces:
                a = arrays[i][start : start + n]
                row = (ids[i], start, n, zlib.crc32(a.astype("<u4").tobytes()), len(arrays[i]), state["sequence"], at, tier, filled, padded, group)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
                if with_ids:
                    pieces_ids.append(a.astype(np.int32))
                at += n
            step[1] += padded
            if step[1] >= step_tokens:
                step[0], step[1] = step[0] + 1, 0
            state["sequence"] += 1
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        cols = [pa.array(c, pa.int32() if name == "tier" else pa.int64()) for c, name in zip(out, names, strict=True)]
        if with_ids:
            cols, names = [*cols, pa.array(pieces_ids, pa.list_(pa.int32()))], [*names, "input_ids"]
        return pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: a row for each piece of every document of the whole table."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
