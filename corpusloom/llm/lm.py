"""LM scoring with a Brown class-based bigram model.

The model: p(w | v) = p(class w | class v) * p(w | class w). Exchange clustering gives the classes, over items: the text's
end, the ``VOCAB`` most frequent training words, each by itself, and all other words by their last three characters, the
``SUFFIXES`` largest such groups apart and the others together. So every word, seen or not, has a class.

1. The ``HEAD`` most frequent words and the groups are exchanged one by one on their bigrams, (HEAD + SUFFIXES + 2)^2
   counts at most, until a sweep gains next to nothing.
2. Then the other words of the vocabulary move, all at a time, to the class that fits their neighbours' classes best. One
   pass over the texts counts (word, side, class of the neighbour); sweeps go on until one gains less than ``GAIN`` nats a
   token, ``SWEEPS`` at most, and a sweep that loses is undone.

Transitions are smoothed by the classes' own shares. Inside a class a word seen c times has (c - D) / N(class), with
D = n1 / (n1 + 2 n2). What the classes leave, and one count more for what no class foresees, goes to all unseen words
together; among them a character model shares it out: byte n-grams with an end, learned from the training words' types,
divided by what it does not give to seen words. Over all strings of words the probabilities add up to one after every
word, so an unlikely spelling costs as much as it should.

Counts of single words are exact for all words. Those of the vocabulary are broadcast; the others of each text go through
one join with the count table. Each distinct text of a task does so once. What reaches the driver is the vocabulary and
counts over it (VOCAB x 2 x CLASSES), and the spelling table, all of them bounded by parameters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import column, keep, small_batches, text_keys, utf8

VOCAB, HEAD, SUFFIXES, CLASSES = 50_000, 300, 300, 48
SUFFIX = 3
#: Nats a token that a sweep must gain for another to follow, and how many follow at most.
GAIN, SWEEPS = 0.01, 8
BETA = 5.0
#: Of the spelling: contexts for each preceding byte, and the weight of the shorter context.
FAN, SPELL_BETA = 32, 4.0
SYMBOLS = 257
#: Entries after which a task hands on its counts, and words whose item it remembers.
FLUSH = 150_000
END, FIRST = 0, 1


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 7 is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens_of(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word: binary, n) over ``texts`` (text); tasks count first, then one aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in column(batch, "text").to_pylist():
                counts.update(tokens_of(text))
                if len(counts) >= FLUSH:
                    yield _counted(counts)
                    counts = Counter()
        if counts:
            yield _counted(counts)

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


# --- items


def suffix(word: bytes) -> bytes:
    """The last three characters."""
    return word[-SUFFIX:] if word.isascii() else word.decode("utf-8", "replace")[-SUFFIX:].encode()


@dataclass
class Items:
    """The items of words: 0 is the end, then the words of the vocabulary by rank, suffix groups and the rest."""

    words: dict[bytes, int]
    suffixes: dict[bytes, int]

    @property
    def groups(self) -> int:
        """The first item that is not a single word."""
        return FIRST + len(self.words)

    @property
    def rest(self) -> int:
        return self.groups + len(self.suffixes)

    @property
    def size(self) -> int:
        return self.rest + 1

    def group(self, word: bytes) -> int:
        return self.suffixes.get(suffix(word), self.rest)

    def finder(self):
        words, group = self.words, self.group

        class Found(dict):
            def __missing__(found, word: bytes) -> int:
                if len(found) >= FLUSH:
                    found.clear()
                item = words.get(word)
                item = found[word] = group(word) if item is None else item
                return item

        return Found().__getitem__

    def head(self, most: int) -> np.ndarray:
        """Each item's place among the end, the ``most`` most frequent words and the groups: other words have their group's."""
        words = min(most, len(self.words))
        place = np.concatenate((np.arange(FIRST + words), np.zeros(len(self.words) - words, np.int64), FIRST + words + np.arange(len(self.suffixes) + 1)))
        for word, item in self.words.items():
            if item >= FIRST + words:
                place[item] = self.group(word) - len(self.words) + words
        return place.astype(np.int64)


#: Items in a row of the table of items, at least.
ROW = 1 << 14


def item_table(texts: DataFrame, items: Items) -> DataFrame:
    """(items: binary): the items of all texts, some texts a row; each text ends with the end. Kept, two bytes
    an item where they suffice, so that texts are cut into words once."""
    kind = np.uint16 if items.size <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = items.finder(), []
        for batch in batches:
            rows = []
            for text in column(batch, "text").to_pylist():
                held += map(find, tokens_of(text))
                held.append(END)
                if len(held) > ROW:
                    rows.append(np.array(held, kind).tobytes())
                    held = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["items"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([np.array(held, kind).tobytes()], pa.binary())], ["items"])

    return keep(texts.mapInArrow(run, "items binary"), "items")


def _streams(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[np.ndarray]:
    """The rows of ``item_table``, some at a time, as one sequence that begins and ends with the end."""
    kind = np.uint16 if items.size <= 1 << 16 else np.uint32
    held, n = [np.array([END], kind)], 0
    for batch in batches:
        for row in column(batch, "items").to_pylist():
            held.append(np.frombuffer(row, kind))
            n += len(held[-1])
            if n > 1 << 20:
                yield np.concatenate(held).astype(np.int64)
                held, n = [held[0]], 0
    if n:
        yield np.concatenate(held).astype(np.int64)


def _cells(table: DataFrame, size: int, count) -> np.ndarray:
    """Sums over all rows of ``table`` of ``count(batches) -> cells``, below ``size``; tasks sum first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        for cells in count(batches):
            total += np.bincount(cells, minlength=size).astype(np.int32)
        cells = np.flatnonzero(total).astype(np.int32)
        for at in range(0, len(cells), 1 << 17):
            own = cells[at : at + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["cell", "n"])

    rows = table.mapInArrow(run, "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # ``size`` rows at most
    out = np.zeros(size, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out


def item_bigrams(table: DataFrame, items: Items, place: np.ndarray) -> np.ndarray:
    """Counts of bigrams of the items' places over the whole ``item_table``; each text starts after and ends with the end."""
    size = int(place.max()) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for s in _streams(batches, items):
            p = place[s]
            yield p[:-1] * size + p[1:]

    return _cells(table, size * size, count).reshape(size, size)


def neighbours(table: DataFrame, items: Items, own: np.ndarray, head: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Class bigrams [k, k], and for each word of the vocabulary after the ``head`` first the classes before and after it [, 2k]."""
    low, high = FIRST + min(head, len(items.words)), items.groups

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for s in _streams(batches, items):
            c = own[s]
            before, after = s[:-1], s[1:]
            second, first = (after >= low) & (after < high), (before >= low) & (before < high)
            left = k * k + (after[second] - low) * 2 * k + c[:-1][second]
            right = k * k + (before[first] - low) * 2 * k + k + c[1:][first]
            yield np.concatenate((c[:-1] * k + c[1:], left, right))

    cells = _cells(table, k * k + (high - low) * 2 * k, count)
    return cells[: k * k].reshape(k, k), cells[k * k :].reshape(high - low, 2 * k)


# --- exchange


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each item. The end has a class of its own, number 0; the others start by rank and move one by one,
    each to the class that raises the likelihood of the class bigrams most, until a sweep gains less than ``GAIN`` / 50
    nats a token."""
    m = bigrams.astype(float)
    total = m.sum(0) + m.sum(1)
    order = [i for i in np.argsort(-total, kind="stable") if i != END]
    own = np.zeros(len(m), np.int64)
    for rank, i in enumerate(order):
        own[i] = 1 + rank % classes
    k = classes + 1
    eye = np.eye(k)[own]
    n = eye.T @ m @ eye
    every = np.arange(k)
    gained = np.inf
    while gained > GAIN / 50 * total.sum():  # the likelihood has a bound, so it ends
        gained = 0.0
        for w in order:
            if not total[w]:
                continue
            a, self_ = own[w], m[w, w]
            r, q = np.bincount(own, m[w], k), np.bincount(own, m[:, w], k)
            r[a] -= self_  # its own bigrams with itself move along with it
            q[a] -= self_
            n[a] -= r
            n[:, a] -= q
            n[a, a] -= self_
            base = _f(n)
            rows = _f(n + r[None, :]) - base
            cols = _f(n + q[:, None]) - base
            both = _f(n[every, every] + r + q + self_) - base[every, every]
            out, into = n.sum(1) + q, n.sum(0) + r  # its neighbours' other sides are there whatever its class
            gain = rows.sum(1) - rows[every, every] + cols.sum(0) - cols[every, every] + both
            gain -= _f(out + r.sum() + self_) - _f(out) + _f(into + q.sum() + self_) - _f(into)
            gain[0] = -np.inf
            b = a if gain.max() <= gain[a] + 1e-6 else int(np.argmax(gain))
            gained += gain[b] - gain[a]
            n[b] += r
            n[:, b] += q
            n[b, b] += self_
            own[w] = b
    return own


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood, in nats, of the class bigrams, but for what no exchange changes."""
    n = pairs.astype(float)
    return float(_f(n).sum() - _f(n.sum(1)).sum() - _f(n.sum(0)).sum())


def best_classes(pairs: np.ndarray, around: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The best class of each word by the classes ``around`` it, all words against the same class bigrams; ties stay."""
    k = len(pairs)
    logs = np.log(np.maximum(pairs, 0.5))
    n = around[:, :k].sum(1)
    worth = around[:, :k] @ logs + around[:, k:] @ logs.T
    worth -= n[:, None] * (np.log(np.maximum(pairs.sum(0), 0.5)) + np.log(np.maximum(pairs.sum(1), 0.5)))[None, :]
    worth[:, 0] = -np.inf
    to = worth.argmax(1)
    here = np.arange(len(own))
    return np.where(worth[here, to] > worth[here, own] + 1e-9, to, own)


def cluster(table: DataFrame, items: Items, head: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each item, and the class bigrams of the whole ``item_table``."""
    k = classes + 1
    place = items.head(head)
    own = exchange(item_bigrams(table, items, place), classes)[place]
    low, high = FIRST + min(head, len(items.words)), items.groups
    best, best_own, best_pairs = -np.inf, own, None
    for sweep in range(SWEEPS + 1):
        pairs, around = neighbours(table, items, own, head, k)
        now = likelihood(pairs)
        more = now - best
        if more > 0:
            best, best_own, best_pairs = now, own, pairs
        moved = best_classes(pairs, around, own[low:high])
        if sweep == SWEEPS or more <= GAIN * max(1, pairs.sum()) or (moved == own[low:high]).all():
            break
        own = own.copy()
        own[low:high] = moved
    return best_own, best_pairs


# --- spelling


def _spelt(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells (context, symbol) of all symbols of ``words``, the end after each included, and where each word starts."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    symbols = np.full(int(sizes.sum()), SYMBOLS - 1, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(words), np.uint8)
    last = [np.concatenate(([SYMBOLS - 1], symbols[:-1]))]  # before a word stands an end
    for _ in range(2):
        before = np.concatenate(([SYMBOLS - 1], last[-1][:-1]))
        last.append(np.where(last[-1] == SYMBOLS - 1, SYMBOLS - 1, before))
    fan = ((last[1] * SYMBOLS + last[2]) * 0x9E3779B1 >> 24) % FAN
    return (last[0] * FAN + fan) * SYMBOLS + symbols, ends + 1 - sizes


def spelling(counts: DataFrame) -> np.ndarray:
    """log10 p(symbol | context) [context, symbol] over the types of ``counts`` (word), each counted once.

    Contexts are the last byte and a hash of the two before it; they back off to the last byte alone, and that to all
    bytes alike. No word is empty and none holds white space or A-Z.
    """
    contexts = SYMBOLS * FAN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(contexts * SYMBOLS, np.int64), []
        for batch in batches:
            held += column(batch, "word").to_pylist()
            if len(held) >= 50_000:
                total += np.bincount(_spelt(held)[0], minlength=len(total))
                held = []
        if held:
            total += np.bincount(_spelt(held)[0], minlength=len(total))
        own = np.flatnonzero(total)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["cell", "n"])

    rows = counts.select("word").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # contexts * SYMBOLS at most
    n = np.zeros(contexts * SYMBOLS)
    n[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    n = n.reshape(SYMBOLS, FAN, SYMBOLS)
    some = np.ones(SYMBOLS)
    some[[*range(9, 14), 32, *range(65, 91)]] = 0
    floor = np.tile(some, (SYMBOLS, 1))
    floor[-1, -1] = 0  # at the start
    floor /= floor.sum(1, keepdims=True)
    one = n.sum(1)
    one = (one + SPELL_BETA * floor) / (one.sum(1, keepdims=True) + SPELL_BETA)
    full = (n + SPELL_BETA * one[:, None, :]) / (n.sum(2, keepdims=True) + SPELL_BETA)
    with np.errstate(divide="ignore"):
        return np.log10(full.reshape(contexts, SYMBOLS)).astype(np.float32)


def spelt_log10(table: np.ndarray, words: list[bytes]) -> np.ndarray:
    """log10 of each word's probability by its spelling."""
    if not words:
        return np.zeros(0)
    cells, starts = _spelt(words)
    return np.add.reduceat(table.reshape(-1)[cells].astype(float), starts)


def spelt_share(counts: DataFrame, table: np.ndarray) -> float:
    """What the spelling gives to all words of ``counts`` together."""
    shared = counts.sparkSession.sparkContext.broadcast(table)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            total += float((10 ** spelt_log10(shared.value, column(batch, "word").to_pylist())).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["q"])

    return counts.select("word").mapInArrow(run, "q double").agg(F.coalesce(F.sum("q"), F.lit(0.0))).first()[0]


# --- model


@dataclass
class Model:
    items: Items
    classes: np.ndarray  # of items
    moves: np.ndarray  # log10 p(class | class before) - log10 of the class's tokens, but for the end
    unseen: np.ndarray  # log10 p(any unseen word | class before) - log10 of the spelling's share of unseen words
    spelling: np.ndarray
    discount: float
    train_tokens: int
    types: int
    ends: int
    counts: np.ndarray  # of the vocabulary's words, by item


def fit(docs: DataFrame, vocab: int = VOCAB, head: int = HEAD, suffixes: int = SUFFIXES, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model of ``docs`` (doc_id, text) outside the held-out fold, and the kept table of its word counts."""
    small_batches(docs.sparkSession)
    texts = docs.where(~held_out()).select("text")
    counts = keep(word_counts(texts), "word-counts")
    ends = texts.count()
    n, types, n1, n2 = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    top = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(vocab).collect()]
    tail = counts.limit(0)
    if len(top) == vocab:
        word, least = top[-1]
        tail = counts.where((F.col("n") < least) | (F.col("n") == least) & (F.col("word") > F.lit(word)))
    groups = tail.groupBy(F.right(F.col("word").cast("string"), F.lit(SUFFIX)).cast("binary").alias("s")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("t"))
    largest = groups.orderBy(F.desc("n"), "s").limit(suffixes).collect()
    items = Items({w: FIRST + i for i, (w, _) in enumerate(top)}, {bytes(r["s"]): FIRST + len(top) + i for i, r in enumerate(largest)})
    item_types = np.array([0] + [1] * len(top) + [r["t"] for r in largest] + [0], float)
    item_types[-1] = types - item_types.sum()
    own, pairs = cluster(item_table(texts, items), items, head, classes)
    k = classes + 1
    into, class_types = pairs.sum(0).astype(float), np.bincount(own, item_types, k)
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    share = into.copy()
    share[0] += 1  # a text may end even if none was seen
    to = (pairs + BETA * share[None, :] / (into.sum() + 2)) / (pairs.sum(1, keepdims=True) + BETA)
    beyond = BETA / (into.sum() + 2) / (pairs.sum(1) + BETA)  # one count for what no class foresees
    left = discount * class_types / np.maximum(into, 1)
    with np.errstate(divide="ignore"):
        moves = np.log10(to)
        moves[:, 1:] -= np.log10(np.maximum(into[1:], 1))[None, :]  # the end is its class's only word
    table = spelling(counts)
    unseen = np.log10(beyond + (to * left[None, :]).sum(1)) - np.log10(max(1e-12, 1 - spelt_share(counts, table)))
    of = np.array([ends] + [c for _, c in top], np.int64)
    return Model(items, own, moves, unseen, table, discount, int(n + ends), int(types + (ends > 0)), ends, of), counts


PARTS = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rid long, rest array<struct<word: binary, n: int, move: float, unseen: float>>"


def _parts(docs: DataFrame, model: Model) -> DataFrame:
    """What each text's words of the vocabulary and its end give, and its other words, to be joined with their counts.

    An other word comes with what its class moves give if it was seen, and what its spelling gives if not. Equal texts of a
    task share one ``rid``, and the first of them has the words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        find, classes, moves, groups = m.items.finder(), m.classes, m.moves, m.items.groups
        of_base = np.log10(m.counts + 1.0)
        of_score = np.log10(np.maximum(m.counts - m.discount, 1e-300))
        of_score[END] = 0.0
        task = TaskContext.get().partitionId() << 40
        seen: dict[tuple[int, int], int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, rows, others, steps, news, sizes = whole.slice(at, 500), [], [], [], [], []
                for doc, text, held, k1, k2 in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "text", "held_out", "k1", "k2")), strict=True):
                    words = tokens_of(text)
                    items = np.fromiter(map(find, words), np.int64, len(words))
                    items = np.append(items, END)
                    path = classes[items]
                    before = np.append(END, path[:-1])
                    step = moves[before, path]
                    known = items < groups
                    own = items[known]
                    base, score = float(of_base[own].sum()), float((step[known] + of_score[own]).sum())
                    rid = seen.get((k1, k2))
                    sizes.append(0)
                    if rid is None:
                        rid = seen[k1, k2] = len(seen)
                        rest = np.flatnonzero(~known)
                        others += [words[i] for i in rest.tolist()]
                        steps.append(step[rest])
                        news.append(m.unseen[before[rest]])
                        sizes[-1] = len(rest)
                    rows.append((doc, held, len(items), len(own) - (not m.ends), base, score, task + rid))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), _rest(others, steps, news, sizes, m.spelling)], [f.split()[0] for f in PARTS.split(", ", 7)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"), *text_keys())
    return rows.mapInArrow(run, PARTS)


def _rest(words: list[bytes], steps: list[np.ndarray], news: list[np.ndarray], sizes: list[int], spelling: np.ndarray) -> pa.ListArray:
    """The distinct other words of each text, with their number and the sums of what they give, seen or not."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    types = len(coded.dictionary)
    if not types:
        return pa.array([[] for _ in sizes], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32()), ("move", pa.float32()), ("unseen", pa.float32())])))
    row = np.repeat(np.arange(len(sizes)), sizes)
    keys, which, n = np.unique(row * types + coded.indices.to_numpy(), return_inverse=True, return_counts=True)
    spelt = spelt_log10(spelling, coded.dictionary.to_pylist())
    move = np.bincount(which, np.concatenate(steps), len(keys))
    unseen = np.bincount(which, np.concatenate(news), len(keys)) + n * spelt[keys % types]
    cols = [coded.dictionary.take(pa.array(keys % types)), pa.array(n.astype(np.int32)), pa.array(move.astype(np.float32)), pa.array(unseen.astype(np.float32))]
    ends = np.concatenate(([0], np.cumsum(np.bincount(keys // types, minlength=len(sizes)))))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(cols, ["word", "n", "move", "unseen"]))


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    A null or empty text is the end alone; a null doc_id is in the training fold; equal texts score alike, but for the
    rounding of sums. An empty table gives an empty table. Without training texts every base score is 0, and words are
    scored by their spelling alone.
    """
    parts = keep(_parts(docs, model), "lm-parts")
    rest = parts.where(F.size("rest") > 0).select("rid", F.explode("rest").alias("r")).select("rid", "r.word", F.col("r.n").alias("m"), "r.move", "r.unseen")
    c = F.coalesce(F.col("n"), F.lit(0))
    joined = rest.join(counts, "word", "left")
    sums = joined.groupBy("rid").agg(
        F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("known2"),
        F.sum(F.col("m") * F.log10(c + 1)).alias("base2"),
        F.sum(F.when(c > 0, F.col("move") + F.col("m") * F.log10(c - F.lit(model.discount))).otherwise(F.col("unseen"))).alias("score2"),
    )
    out = parts.drop("rest").join(sums, "rid", "left")
    whole = float(np.log10(model.train_tokens + model.types + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """One row for each fold: perplexity per token of the model and of the base."""
    n = F.sum("n_tokens")
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum("score") / n).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / n).alias("base_perplexity"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document scored by the model and by the smoothed word counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, *fit(docs))
