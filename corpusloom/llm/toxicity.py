"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is lower-cased and stands for itself and its character n-grams (3 to 5, with edge marks), each hashed into one of
``BUCKETS`` embeddings. A word's vector is the mean of its subwords', a text's vector the mean of its words'; a linear
layer and a softmax over two classes follow. Embeddings and layer are trained jointly in numpy with Adagrad, so a
misspelling never seen shares the vectors of the n-grams that it has in common with seen words.

Training takes a bounded sample, ``PER_CLASS`` labelled rows of either class at most, chosen by a hash of doc_id, from
rows whose crc32(doc_id as text) mod 4 is not 2. Labels, lang, source and doc_id are no inputs of a score. The settings
below come from cross-validation over the three learning folds (crc32 mod 4 of 0, 1, 3) alone. The layer after the
embeddings is linear, so a word's part in the logit is one number, kept for the words of a task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_map, boxed, column, unboxed

WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 18
DIM = 8
#: Sample texts that must hold a bucket for it to count: what one or two texts hold would only be learned by heart.
LEAST_TEXTS = 5
#: Labelled rows of each class used for training, at most.
PER_CLASS = 2000
#: Steps of 32 texts, whatever the sample's size.
STEPS = 1000
#: Text vectors are means over hundreds of words; this gain brings them to the layer's range.
GAIN = 1000.0
#: Of a word's count in its text, and words without a say in every average.
DAMP = 0.5
NEUTRAL = 200
#: Pull of every used embedding towards zero.
DECAY = 1e-5
THRESHOLD = 0.3
#: One blank text, labelled 0, is added to the sample for so many of its rows: a text that says nothing is not toxic.
BLANKS = 20
#: Words whose part is remembered in a task.
REMEMBER = 250_000


def subwords(word: str) -> list[int]:
    marked = f"<{word}>".encode("utf-8", "surrogatepass") if word.isascii() else None
    if marked is not None:
        grams = [marked] + [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    else:
        s = f"<{word}>"
        grams = [s.encode("utf-8", "surrogatepass")] + [s[i : i + n].encode("utf-8", "surrogatepass") for n in (3, 4, 5) for i in range(len(s) - n + 1)]
    return [zlib.crc32(g) & (BUCKETS - 1) for g in grams]


def weighted(words: list[str]) -> dict[str, float]:
    """The weights of a text's distinct words in its average: damped counts, with ``NEUTRAL`` words that say nothing.

    Without them a text of a few words, or of one word again and again, would be as certain as a long one.
    """
    counts = {w: n**DAMP for w, n in Counter(words).items()}
    total = NEUTRAL + sum(counts.values())
    return {w: v / total for w, v in counts.items()}


def held_out(doc_id="doc_id"):
    """True where crc32(doc_id as text) mod 4 is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    part: np.ndarray  # of each bucket in the difference of the two logits
    bias: float

    def scorer(self):
        part = self.part.tolist()

        class Parts(dict):
            def __missing__(parts, word: str) -> float:
                if len(parts) >= REMEMBER:
                    parts.clear()
                own = subwords(word)
                value = parts[word] = sum([part[b] for b in own]) / len(own)
                return value

        known = Parts()

        def score(text: str | None) -> float:
            words = WORD.findall((text or "").lower())
            logit = self.bias + sum(known[w] * v for w, v in weighted(words).items())
            return 1.0 / (1.0 + float(np.exp(-min(60.0, max(-60.0, logit)))))

        return score


def _buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their weights in its average."""
    total: dict[int, float] = {}
    for word, v in weighted(WORD.findall(text.lower())).items():
        own = subwords(word)
        v *= GAIN / len(own)
        for b in own:
            total[b] = total.get(b, 0.0) + v
    return np.fromiter(total, np.int32, len(total)), np.fromiter(total.values(), np.float32, len(total))


def train(texts: list[str], toxic: list[int], base_rate: float, steps: int = STEPS, seed: int = 7) -> Model:
    """Fit on a sample; ``base_rate`` is the share of class 1 in the labelled rows it stands for.

    Without rows of both classes the model is a constant: the base rate.
    """
    y = np.array(toxic, int)
    prior = float(np.log(max(base_rate, 1e-4) / max(1 - base_rate, 1e-4)))
    if len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS), prior)
    blank = len(texts) // BLANKS
    rows = [_buckets(text) for text in texts] + [_buckets("")] * blank
    y = np.append(y, np.zeros(blank, int))
    rng = np.random.default_rng(seed)
    embed, layer, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    seen_e, seen_l, seen_b = np.full((BUCKETS, 1), 1e-3), np.full((DIM, 2), 1e-3), np.full(2, 1e-3)
    texts_with = np.bincount(np.concatenate([own for own, _ in rows]), minlength=BUCKETS)
    rows = [(own[keep], v[keep]) for own, v in rows for keep in [texts_with[own] >= LEAST_TEXTS]]
    embed[texts_with < LEAST_TEXTS] = 0
    order = np.arange(len(rows))
    epochs = max(1, steps * 32 // len(rows))
    for epoch in range(epochs):
        rng.shuffle(order)
        rate = 0.3 * (1 - epoch / epochs)
        for lo in range(0, len(order), 32):
            own = order[lo : lo + 32]
            used, at = np.unique(np.concatenate([rows[k][0] for k in own]), return_inverse=True)
            x = np.zeros((len(own), len(used)), np.float32)
            x[np.repeat(np.arange(len(own)), [len(rows[k][0]) for k in own]), at] = np.concatenate([rows[k][1] for k in own])
            vectors = x @ embed[used]
            logits = vectors @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            d_layer, d_bias, d_embed = vectors.T @ p, p.sum(0), x.T @ (p @ layer.T) + DECAY * embed[used]
            seen_e[used] += (d_embed**2).mean(1, keepdims=True)
            seen_l += d_layer**2
            seen_b += d_bias**2
            embed[used] -= rate * d_embed / np.sqrt(seen_e[used])
            layer -= 0.3 * rate * d_layer / np.sqrt(seen_l)
            bias -= rate * d_bias / np.sqrt(seen_b)
    share = y[: len(texts)].mean()
    shift = prior - float(np.log(share / (1 - share)))  # from the sample's share of class 1 to the base rate
    return Model((embed @ (layer[:, 1] - layer[:, 0])) * GAIN, float(bias[1] - bias[0]) + shift)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Train on labelled rows outside the held-out fold: ``docs`` (doc_id, text), ``labels`` (doc_id, toxic).

    Rows with a null label or doc_id are not used; a text with several labels counts once for each.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    n0, n1 = own.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    picks = [own.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(picks[0].unionByName(picks[1]))  # at most 2 * per_class rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", F.xxhash64("text")).limit(2 * per_class)
    base_rate = n1 / max(1, n0 + n1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += [t or "" for t in column(batch, "text").to_pylist()]
            toxic += column(batch, "toxic").to_pylist()
        model = train(texts, toxic, base_rate)
        yield pa.RecordBatch.from_arrays([pa.array([model.part.tolist()], pa.list_(pa.float64())), pa.array([float(model.bias)])], ["part", "bias"])

    found = rows.select("text", "toxic").coalesce(1).mapInArrow(run, "part array<double>, bias double").toArrow()  # the bounded sample trains in one task
    if not found.num_rows:
        return train([], [], base_rate)
    return Model(found.column("part").combine_chunks().flatten().to_numpy(), found.column("bias")[0].as_py())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text; other columns are kept) with ``__score``: 0 to 1, also for null, empty or wordless texts.

    A column of that name is replaced; equal texts score alike; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.drop("__score")
    shared = spark.sparkContext.broadcast((model.part.astype(np.float32), model.bias))  # BUCKETS floats

    def make():
        rate = Model(*shared.value).scorer()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = pa.array([rate(t) for t in column(batch, "text").to_pylist()], pa.float64())
            return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, "__score"])

        return step

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["__score double"])
    return arrow_map(docs, make, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` scored under ``threshold``, with all their columns; repeated rows fare alike."""
    model = fit(docs, labels)
    return unboxed(score(boxed(docs, "text"), model).where(F.col("__score") < threshold), docs.columns, ("text",))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: doc_id, held_out, score, predicted for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
