"""WordPiece training from counts of distinct words: what the ``tokenizers`` trainer does, without its reading of every occurrence.

That trainer takes texts, so a word that occurs a million times has to be fed a million times, in one process. Here each
distinct word is held once with its count, as arrays of symbols; a merge touches the places of its pair alone.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PREFIX = "##"
#: Words or characters handled at a time: about 20 bytes are held for each character of the distinct words, besides them.
CHUNK = 1 << 20


def train_vocab(words: list[str] | pa.Array, counts: np.ndarray, size: int, specials: list[str], min_frequency: int = 2, limit_alphabet: int = 1000) -> list[str]:
    """Tokens by id: ``specials``, the most frequent characters, their continuations, then merges by count, ties by ids.

    The alphabet is whole even if it exceeds ``size``. ``words`` in a fixed order give the same ids on every run.
    """
    words = pa.array(words, pa.string()) if isinstance(words, list) else words
    counts = np.asarray(counts, np.int64)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    codes = np.frombuffer(b"".join("".join(words.slice(s, CHUNK).to_pylist()).encode("utf-32-le") for s in range(0, len(words), CHUNK)), np.uint32)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    n = len(codes)
    chunks = [slice(s, s + CHUNK) for s in range(0, n, CHUNK)]

    often = np.zeros(0x110000, np.int64)
    for c in chunks:
        own, which = np.unique(codes[c], return_inverse=True)
        often[own] += _sums(which, counts[word[c]], len(own))
    letters = np.flatnonzero(often)
    held = np.zeros(0x110000, bool)
    held[letters[np.lexsort((letters, -often[letters]))[:limit_alphabet]]] = True
    tokens = list(specials)
    ids = {t: i for i, t in enumerate(tokens)}

    def number(token: str) -> int:
        if token not in ids:
            ids[token] = len(tokens)
            tokens.append(token)
        return ids[token]

    start = np.full(0x110000, -1, np.int32)
    for x in np.flatnonzero(held).tolist():
        start[x] = number(chr(x))
    follow = np.full(0x110000, -1, np.int32)
    first = np.ones(n, bool)
    first[1:] = word[1:] != word[:-1]
    for c in chunks:
        inner = codes[c][~first[c] & held[codes[c]]]
        own, seen = np.unique(inner, return_index=True)
        for x in own[np.argsort(seen)].tolist():
            follow[x] = number(PREFIX + chr(x))

    symbol = np.where(first, start[codes], follow[codes])
    del codes, first
    known = symbol >= 0
    if not known.all():
        symbol, word = symbol[known], word[known]
    del known
    n = len(symbol)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    ends = np.ones(n, bool)
    ends[:-1] = word[1:] != word[:-1]
    after[ends] = -1
    before[1:][ends[:-1]] = -1
    del ends

    total: dict[int, int] = {}
    places: dict[int, list[np.ndarray]] = {}

    def add(at: np.ndarray, sign: int) -> list[int]:
        """Count the pairs that start at ``at`` in or out; the pairs."""
        if not len(at):
            return []
        pairs, own = np.unique((symbol[at].astype(np.int64) << 32) | symbol[after[at]], return_inverse=True)
        change = sign * _sums(own, counts[word[at]], len(pairs))
        for p, c in zip(pairs.tolist(), change.tolist(), strict=True):
            total[p] = total.get(p, 0) + c
        if sign > 0:
            cuts = np.cumsum(np.bincount(own, minlength=len(pairs)))[:-1]
            for p, own_at in zip(pairs.tolist(), np.split(at[np.argsort(own, kind="stable")], cuts), strict=True):
                places.setdefault(p, []).append(own_at)
        return pairs.tolist()

    for s in range(0, n, CHUNK):
        add((np.flatnonzero(after[s : s + CHUNK] >= 0) + s).astype(np.int32), 1)
    queue = [(-count, p) for p, count in total.items()]
    heapq.heapify(queue)
    while len(tokens) < size and queue:
        count, pair = heapq.heappop(queue)
        if -count != total[pair]:
            heapq.heappush(queue, (-total[pair], pair))
            continue
        if -count < max(1, min_frequency):
            break
        a, b = pair >> 32, pair & 0xFFFFFFFF
        new = number(tokens[a] + tokens[b].removeprefix(PREFIX))
        at = np.unique(np.concatenate(places.pop(pair, [np.zeros(0, np.int32)])))
        at = at[(symbol[at] == a) & (after[at] >= 0)]
        at = at[symbol[after[at]] == b]
        if a == b and len(at):  # of a run of overlapping pairs every other one, from the left
            chained = np.zeros(len(at), bool)
            chained[1:] = after[at[:-1]] == at[1:]
            row = np.arange(len(at))
            at = at[(row - np.maximum.accumulate(np.where(chained, 0, row))) % 2 == 0]
        if not len(at):
            continue
        second = after[at]
        left, right = before[at], after[second]
        add(np.unique(np.concatenate([left[left >= 0], second[right >= 0]])), -1)
        symbol[at], symbol[second], after[at] = new, -1, right
        before[right[right >= 0]] = at[right >= 0]
        left = before[at]
        for p in add(np.unique(np.concatenate([left[left >= 0], at[right >= 0]])), 1):
            if total[p] > 0:
                heapq.heappush(queue, (-total[p], p))
    return tokens


def _sums(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, groups, values)
    return out


def first_tokens(tokens: list[str], size: int, specials: int) -> list[str]:
    """The vocabulary that training for a smaller ``size`` gives: merges come one after the other, and the alphabet is whole."""
    alphabet = next((i for i, t in enumerate(tokens) if i >= specials and len(t.removeprefix(PREFIX) or t) > 1), len(tokens))
    return tokens[: max(size, alphabet)]
