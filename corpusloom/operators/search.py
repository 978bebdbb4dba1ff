"""Vectors, cosine search, BM25, hybrid ranking and keyphrases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.functions import text as X
from corpusloom.functions.arrays import let
from corpusloom.operators import pairs

K1, B = 1.2, 0.75


# --- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; a vector of norm under 1e-8 stays as it is."""
    n = norm(v)
    return let(F.when(n < 1e-8, 1.0).otherwise(n), lambda by: F.transform(v, lambda x: x.cast("double") / by))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n < 1e-12, 0.0).otherwise(dot(a, b) / n)


def blend(original: Column, expanded: Column, weight: float) -> Column:
    return F.zip_with(original, expanded, lambda a, b: (1 - weight) * a.cast("double") + weight * b.cast("double"))


def pooled(vectors: DataFrame, vector: str, strategy: str = "mean", order: str | None = None) -> DataFrame:
    """One row: mean or element-wise maximum of the vectors, or all of them end to end in ``order``."""
    if strategy == "concat":
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(vector).alias("v"))))
        return vectors.agg(F.flatten(F.transform(rows, lambda r: r["v"])).alias("embedding"))
    each = vectors.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg((F.avg if strategy == "mean" else F.max)(F.col("x").cast("double")).alias("x"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))  # one row for each dimension


def mean_pool(hidden: Column, mask: Column, dims: int) -> Column:
    """Mean of the token vectors under the mask; zeros if there is none."""
    used = F.filter(F.zip_with(hidden, mask, lambda h, m: F.when(m > 0, h)), lambda h: h.isNotNull())
    total = F.aggregate(used, F.array_repeat(F.lit(0.0), dims), lambda s, h: F.zip_with(s, h, lambda a, b: a + b.cast("double")))
    return F.when(F.size(used) > 0, F.transform(total, lambda x: x / F.size(used))).otherwise(F.array_repeat(F.lit(0.0), dims))


#: Queries of one search at most; more are to be handed over in blocks.
MAX_QUERIES = 10_000


def checked_queries(queries: DataFrame) -> DataFrame:
    """``queries`` for broadcast; an error if there are more than ``MAX_QUERIES``."""
    if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries: search in blocks")
    return F.broadcast(queries)


def best_of_each(scored: DataFrame, k: int, key: str, score: Column | None = None) -> DataFrame:
    """The k best rows of each query_id, ties (to nine digits) by key; tasks limit their own rows first."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col("score") if score is None else score, 9)), key)
    return scored.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def top_k(index: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "id") -> DataFrame:
    """The k rows of ``index`` nearest to each of ``queries`` (query_id, query_vector), by cosine, ties by key: query_id, score
    and the columns of ``index`` but the vector.

    Any number of queries: both sides are cut into blocks (``pairs.cells``), each cell keeps its own k best of each query.
    """
    others = [c for c in index.columns if c != vector]
    given = queries.select("query_id", "query_vector")

    def best(own: pa.Table, asked: pa.Table) -> pa.Table:
        q, r, score, own = pairs.best_in_cell(own, asked, k, vector, key)
        null = r < 0
        r = np.where(null, -1 - r, r)
        rows = own.select(others).take(pa.array(r)).append_column("query_id", asked.column("query_id").take(pa.array(q)))
        return rows.append_column("score", pa.array(score, mask=null))

    schema = T.StructType([index.schema[c] for c in others] + [given.schema["query_id"], T.StructField("score", T.DoubleType())])
    return best_of_each(pairs.cells(index.select(vector, *others), given, key, "query_id", best, schema), k, key)


def softmax_top_k(logits: Column, k: int) -> Column:
    """Structs (index, probability) of the k largest logits, probabilities among these k alone."""
    indexed = F.transform(logits, lambda x, i: F.struct((-x.cast("double")).alias("minus"), i.alias("index")))
    best = F.slice(F.array_sort(indexed), 1, k)

    def shares(best: Column) -> Column:
        top = F.get(best, F.lit(0))["minus"]
        weighted = F.transform(best, lambda b: F.struct(b["index"].alias("index"), F.exp(top - b["minus"]).alias("w")))
        total = F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x["w"])
        return let(total, lambda t: F.transform(weighted, lambda x: F.struct(x["index"].alias("index"), (x["w"] / t).alias("probability"))))

    return let(best, shares)


def compare_embeddings(a: Column, b: Column) -> Column:
    """same, close or different, by cosine over 0.99 or 0.8."""
    c = cosine(a, b)
    return F.when(c > 0.99, "same").when(c > 0.8, "close").otherwise("different")


def compared_counts(index: DataFrame, queries: DataFrame, vector: str = "embedding", key: str = "id") -> DataFrame:
    """(query_id, r, n): how many rows of ``index`` are the same, close or different, as ``compare_embeddings`` has it, for each of
    ``queries`` (query_id, query_vector); classes without rows are left out. Block by block, as ``top_k``."""
    given = queries.select("query_id", "query_vector")

    def count(own: pa.Table, asked: pa.Table) -> pa.Table:
        over = np.zeros((asked.num_rows, 2), np.int64)
        vectors = pairs.by_length(own, vector)
        for size, q in pairs.by_length(asked, "query_vector").items():
            if size in vectors:
                over[q.at] = pairs.counts_in_cell(q, vectors[size], (0.99, 0.8))
        n = np.column_stack([over[:, 0], over[:, 1] - over[:, 0], own.num_rows - over[:, 1]])
        at, r = np.nonzero(n)
        return pa.table([asked.column("query_id").take(pa.array(at)), pa.array(["same", "close", "different"]).take(pa.array(r)), pa.array(n[at, r])], ["query_id", "r", "n"])

    schema = T.StructType([given.schema["query_id"], T.StructField("r", T.StringType()), T.StructField("n", T.LongType())])
    counted = pairs.cells(index.select(vector, key), given, key, "query_id", count, schema)
    return counted.groupBy("query_id", "r").agg(F.sum("n").alias("n"))


def embedder(model_factory, dims: int):
    """An Arrow-batched embedding function: ``model_factory()`` is called once a worker and must give an object with
    ``encode(list of texts) -> array [n, dims]``. Empty texts are zeros."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_factory()
        for texts in batches:
            out = np.zeros((len(texts), dims), np.float32)
            real = [i for i, t in enumerate(texts) if t]
            if real:
                out[real] = model.encode([texts.iloc[i] for i in real])
            yield pd.Series(list(out))

    return embed


# --- keywords


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token, tf, size): one row for each word of a document."""
    own = docs.select(key, X.words(F.col(text)).alias("__w"))
    rows = own.select(key, F.size("__w").alias("size"), F.explode("__w").alias("token"))
    return rows.groupBy(key, "size", "token").agg(F.count(F.lit(1)).alias("tf"))


#: Scores (rows by queries) that are held at a time.
SCORES = 1 << 22


def query_words(docs: DataFrame, tokens: pa.Array, key: str, text: str) -> DataFrame:
    """(key, size, tokens, tfs): for each row its words in all, and which of ``tokens``, by place, it holds how often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            size = pc.list_value_length(words).cast(pa.int32())
            sizes = pc.fill_null(size, 0).to_numpy(zero_copy_only=False)
            found = pc.index_in(words.flatten(), value_set=tokens)
            held = pc.is_valid(found).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)[held]
            pair, tf = np.unique(row * max(1, len(tokens)) + found.drop_null().to_numpy(), return_counts=True)
            row, token = np.divmod(pair, max(1, len(tokens)))
            ends = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (token, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), size, *lists], [key, "size", "tokens", "tfs"])

    whole = T.ArrayType(T.IntegerType())
    schema = T.StructType([docs.schema[key], T.StructField("size", T.IntegerType()), T.StructField("tokens", whole), T.StructField("tfs", whole)])
    return docs.select(key, X.words(F.col(text)).alias("__w")).mapInArrow(count, schema)


def bm25(docs: DataFrame, queries: DataFrame, key: str = "id", text: str = "text", keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(query_id, key, score) by Okapi BM25 of ``queries`` (query_id, query), whole texts, over ``docs``.

    Only query words are counted, inside a row, and rows are scored one by one: nothing of the texts is shuffled. ``keep``
    writes a table and gives it back; without it texts are cut into words for each of the three passes. Rows of one key
    are one text, so if keys repeat, their words are put together by a shuffle.
    """
    asked = checked_queries(queries).select("query_id", F.explode(F.array_distinct(X.words(F.col("query")))).alias("token")).orderBy("token", "query_id").toArrow()
    tokens = pc.unique(asked.column("token").combine_chunks())
    own = asked.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    ids, query = own.dictionary, own.indices.to_numpy()
    fan = np.bincount(pc.index_in(asked.column("token"), value_set=tokens).to_numpy(), minlength=len(tokens))
    first = np.cumsum(fan) - fan

    found = keep(query_words(docs, tokens, key, text))
    n, mean = found.agg(F.count(F.lit(1)), F.avg("size")).first()
    repeated = found.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").limit(1).count() > 0
    if repeated:
        each = found.select(key, "size", F.explode(F.arrays_zip("tokens", "tfs")).alias("t")).groupBy(key, "size", "t.tokens").agg(F.sum("t.tfs").cast("int").alias("tf"))
        found = each.select(key, "size", F.array("tokens").alias("tokens"), F.array("tf").alias("tfs"))
    df = np.zeros(len(tokens))
    for token, count in found.select(F.explode("tokens").alias("token")).groupBy("token").count().collect():  # a row for each query word
        df[token] = count
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORES // max(1, len(ids)))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
                token, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                row = np.repeat(np.arange(len(sizes)), sizes)
                size = pc.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False).astype(float)[row]
                part = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / (mean or 1)))
                more = fan[token]
                at = np.repeat(np.arange(len(token)), more)
                cell = row[at] * len(ids) + query[first[token][at] + np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more)]
                hit = np.flatnonzero(np.bincount(cell, minlength=1))
                total = np.bincount(cell, part[at], minlength=1)[hit]
                row, q = np.divmod(hit, max(1, len(ids)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), batch.column(0).take(pa.array(row)), pa.array(total)], ["query_id", key, "score"])

    schema = T.StructType([queries.schema["query_id"], docs.schema[key], T.StructField("score", T.DoubleType())])
    scored = found.select(key, "size", "tokens", "tfs").mapInArrow(score, schema)
    return scored.groupBy("query_id", key).agg(F.sum("score").alias("score")) if repeated else scored


def paired_cosines(rows: DataFrame, queries: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` (query_id, vector and others) for each of ``queries`` (query_id, query_vector) with the row's query_id, and with
    semantic_score, the cosine as ``cosine`` has it, in place of the vector."""
    others = [c for c in rows.columns if c != vector]
    given = checked_queries(queries).select("query_id", "query_vector").toArrow()
    sides = pairs.by_length(given, "query_vector")
    numbers = rows.sparkSession.createDataFrame(pa.table([given.column("query_id"), pa.array(range(given.num_rows), pa.int32())], ["query_id", "__no"]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            no, out = table.column("__no").to_numpy(), np.full(table.num_rows, np.nan)
            null = np.ones(table.num_rows, bool)
            for size, v in pairs.by_length(table, vector).items():
                if size in sides:
                    place = np.full(given.num_rows, -1)
                    place[sides[size].at] = np.arange(len(sides[size]))
                    i = np.flatnonzero(place[no[v.at]] >= 0)
                    out[v.at[i]] = pairs.cosines(v, i, sides[size], place[no[v.at[i]]])
                    null[v.at[i]] = False
            yield from table.select(others).append_column("semantic_score", pa.array(out, mask=null)).to_batches()

    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField("semantic_score", T.DoubleType())])
    return rows.join(F.broadcast(numbers), "query_id").select(*others, vector, "__no").mapInArrow(score, schema)


def merge_candidates(hits: DataFrame, key: str = "id") -> DataFrame:
    """One row for each document of (key, seq, score, source): the best score, and the source of its first hit by seq."""
    return hits.groupBy(key).agg(F.max("score").alias("score"), F.min_by("source", "seq").alias("source"))


def keyword_share(score: Column) -> Column:
    """A score over the best one; 0 where the best is 0."""
    best = F.max(score).over(Window.partitionBy())
    return F.when(best > 0, score / best).otherwise(0.0)


def hybrid(candidates: DataFrame, k: int, semantic_weight: float = 0.6, keyword_weight: float = 0.4, key: str = "id") -> DataFrame:
    """Top k of each query of (query_id, key, semantic_score, keyword_raw_score): 0.6 semantic + 0.4 normalised keyword by
    default. Rows are matched by key, so that candidates without content can't shift the others."""
    best = candidates.groupBy("query_id").agg(F.max("keyword_raw_score").alias("__best"))
    c = candidates.join(F.broadcast(best), "query_id")  # a row for each query
    c = c.withColumn("keyword_score", F.when(F.col("__best") > 0, F.col("keyword_raw_score") / F.col("__best")).otherwise(0.0)).drop("__best")
    return best_of_each(c.withColumn("score", semantic_weight * F.col("semantic_score") + keyword_weight * F.col("keyword_score")), k, key)


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


# --- keyphrases


def ngrams(tokens: Column, n_max: int = 3) -> Column:
    """All 1- to ``n_max``-grams, space-joined, each once."""
    def grams(words: Column, n: int) -> Column:
        last = F.size(words) - n
        starts = F.when(last >= 0, F.sequence(F.lit(1), F.greatest(last + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return let(tokens, lambda words: F.array_distinct(F.concat(*[grams(words, n) for n in range(1, n_max + 1)])))


#: Texts whose n-grams are numbered at a time.
NGRAM_TEXTS = 200


def ngram_counts(docs: DataFrame, key: str, n_max: int = 3, text: str = "text") -> DataFrame:
    """(key, n): how many different 1- to ``n_max``-grams a text has, as ``ngrams`` lists them, without making their strings.

    Words are numbered, and an n-gram is the number of its beginning with its last word: two n-grams get one number only if
    they are equal.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, NGRAM_TEXTS):
                batch = whole.slice(start, NGRAM_TEXTS)
                own = batch.column(1)
                sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
                word = own.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
                kinds = int(word.max()) + 1 if len(word) else 1
                doc = np.repeat(np.arange(len(sizes)), sizes)
                left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))  # words from here to the text's end
                gram, at, n = doc, np.arange(len(word)), np.zeros(len(sizes), np.int64)
                for size in range(1, n_max + 1):
                    held = left[at] >= size
                    at = at[held]
                    _, first, gram = np.unique(gram[held] * kinds + word[at + size - 1], return_index=True, return_inverse=True)
                    n += np.bincount(doc[at[first]], minlength=len(sizes))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], [key, "n"])

    schema = T.StructType([docs.schema[key], T.StructField("n", T.LongType())])
    return docs.select(key, X.words(F.col(text)).alias("__w")).mapInArrow(count, schema)


def hashed_vector(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedding: counts of words by hash."""
    hashes = F.transform(X.words(text), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(dims)).cast("int"))
    return let(hashes, lambda own: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(own, lambda h: h == d)).cast("float")))


class HashedBags:
    """Counts of words by hash, where no neural model is given."""

    def encode(self, texts: list[str], dims: int = 256) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dims))
        for v, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                v[zlib.crc32(w.encode()) % dims] += 1
        return out


def keyphrases(docs: DataFrame, key: str, top_n: int = 5, candidates: int = 30, diversity: float = 0.5, text: str = "text", model_factory=HashedBags) -> DataFrame:
    """(key, rank, phrase, score): candidate n-grams by cosine to the document, re-ranked by maximal marginal relevance.

    Vectors come from ``model_factory()``, called once a worker, as in ``embedder``. Maximal marginal relevance is
    iterative; it runs on the ``candidates`` best phrases of a document, in Arrow batches. A text without words has none.
    """

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for batch in batches:
            rows = [(k, r["rank"], r["phrase"], r["score"]) for k, t, g in batch.itertuples(index=False) for r in mmr(t or "", list(g) if g is not None else [], top_n, candidates, diversity, model)]
            yield pd.DataFrame(rows, columns=[key, "rank", "phrase", "score"])

    grams = docs.select(key, F.col(text).alias("__t"), ngrams(X.words(F.col(text))).alias("__g"))
    return grams.mapInPandas(rank, f"`{key}` {docs.schema[key].dataType.simpleString()}, rank int, phrase string, score double")


def mmr(text: str, phrases: list[str], top_n: int, candidates: int, diversity: float, model=None) -> list[dict]:
    if not phrases:
        return []
    vectors = np.asarray((model or HashedBags()).encode([text, *phrases]), float)
    sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors /= np.where(sizes > 0, sizes, 1)
    own, vectors = vectors[0], vectors[1:]
    likeness = vectors @ own
    first = sorted(range(len(phrases)), key=lambda i: (-likeness[i], phrases[i]))[:candidates]
    chosen = [first[0]]
    while len(chosen) < min(top_n, len(first)):
        rest = [i for i in first if i not in chosen]
        gain = {i: (1 - diversity) * likeness[i] - diversity * max(vectors[i] @ vectors[j] for j in chosen) for i in rest}
        chosen.append(min(rest, key=lambda i: (-gain[i], phrases[i])))
    return [{"rank": r + 1, "phrase": phrases[i], "score": float(round(likeness[i], 6))} for r, i in enumerate(chosen)]


def marked_overlap(rows: DataFrame, key: str, in_a: Column, in_b: Column, phrase: str = "phrase") -> DataFrame:
    """(key, common): phrases that rows of both kinds give; one aggregation."""
    both = rows.groupBy(key, phrase).agg(F.max(in_a.cast("tinyint")).alias("__a"), F.max(in_b.cast("tinyint")).alias("__b")).where("__a = 1 and __b = 1")
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("common"))


def phrase_overlap(a: DataFrame, b: DataFrame, key: str, phrase: str = "phrase") -> DataFrame:
    """(key, common): phrases that both models give."""
    both = a.select(key, phrase, F.lit(True).alias("__of_a")).unionByName(b.select(key, phrase, F.lit(False).alias("__of_a")))
    return marked_overlap(both, key, F.col("__of_a"), ~F.col("__of_a"), phrase)


def noun_phrases(phrases: DataFrame, tags: str = "tags") -> DataFrame:
    """Phrases whose last tag is NOUN and that hold no VERB; ``tags`` comes from any tagger."""
    return phrases.where((F.element_at(tags, -1) == "NOUN") & ~F.array_contains(tags, "VERB"))


def clusters(vectors: DataFrame, k: int, vector: str = "embedding", dims_to: int = 2, seed: int = 42) -> DataFrame:
    """``vectors`` with cluster: k-means after projection on ``dims_to`` principal components (in place of t-SNE, which has no
    distributed form)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = vectors.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    flat = PCA(k=dims_to, inputCol="__v", outputCol="__p").fit(v).transform(v)
    out = KMeans(k=k, seed=seed, featuresCol="__p", predictionCol="cluster").fit(flat).transform(flat)
    return out.drop("__v", "__p")


def semantic_duplicates(vectors: DataFrame, threshold: float = 0.85, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b, score) of all pairs with cosine over ``threshold``, a < b: exact, block against block (``pairs.own_cells``)."""

    def near(own: pa.Table, other: pa.Table | None) -> pa.Table:
        a = pairs.by_length(own, vector)
        b = a if other is None else pairs.by_length(other, vector)
        out = [(v.at[i], b[size].at[j], s) for size, v in a.items() if size in b for i, j, s in pairs.over_in_cell(v, b[size], threshold)]
        i, j, score = (np.concatenate(p) for p in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        if other is None:  # each pair of a block comes both ways
            other = own
        first, second = own.column(key).take(pa.array(i)), other.column(key).take(pa.array(j))
        if other is not own:
            swap = pc.greater(first, second)
            first, second = pc.if_else(swap, second, first), pc.if_else(swap, first, second)
        return pa.table([first, second, pa.array(score)], ["a", "b", "score"]).filter(pc.less(first, second))

    kind = vectors.schema[key].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("score", T.DoubleType())])
    return pairs.own_cells(vectors.select(key, vector), key, near, schema).withColumn("score", F.round("score", 6))
