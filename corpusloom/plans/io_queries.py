"""Queries that go through sinks and sources: what is written is read back and compared. Also streams and hooks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import packing, profile, sampling, search, sentences, tokenization
from corpusloom.plans import sql as S
from corpusloom.plans.registry import kept, query, scratch, table
from corpusloom.plans.text_queries import WITH, books, sents
from corpusloom.plans.token_queries import _E, _Q, _V, LIMIT, best_sql, encoded, packed_sql, query_vectors, turns, vocab
from corpusloom.schema import EXAMPLE
from corpusloom.sources import readers, writers
from corpusloom.streaming import filters

@query("k02_jsonl_parts", "SELECT conv_id::VARCHAR AS book_id, turn AS position, text FROM conversations WHERE text <> ''")
def jsonl_parts(spark, d) -> DataFrame:
    """Gzipped JSON lines, books kept together, written and read back."""
    path = scratch(spark, "jsonl")
    rows = turns(spark, d).select(F.col("book_id").cast("string").alias("book_id"), F.col("position").cast("int").alias("position"), "text")
    writers.jsonl_parts(rows, path, parts=8)
    return readers.jsonl(spark, path, glob="*.json.gz").select("book_id", "position", "text")


@query("k01_sentences_by_book", "SELECT conv_id::VARCHAR AS book_id, count(*) AS n, max(turn) AS last FROM conversations WHERE text <> '' GROUP BY 1")
def sentences_by_book(spark, d) -> DataFrame:
    """A folder for each book; the book comes back from the path."""
    path = scratch(spark, "books")
    writers.sentences_by_book(turns(spark, d).select("book_id", "position", "text"), path)
    rows = spark.read.schema("book_id string, position int, text string").json(path).where("text <> ''")
    return rows.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last"))


@query("k03_corpus_text", WITH + "SELECT text, count(*) AS n FROM s GROUP BY 1")
def corpus_text(spark, d) -> DataFrame:
    """A plain-text corpus, written and read back."""
    path = scratch(spark, "corpus")
    writers.corpus_text(sentences.corpus_lines(sents(spark, d)), path)
    return readers.corpus_lines(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("k05_histogram_csv", WITH + "SELECT b || '-' || (b + 100) AS bucket, count(*) AS n FROM (SELECT (strlen(text) // 100) * 100 AS b FROM s) GROUP BY b")
def histogram_csv(spark, d) -> DataFrame:
    """A histogram as CSV."""
    path = scratch(spark, "histogram")
    writers.csv(profile.length_histogram(sents(spark, d)), path, ["bucket"])
    return readers.metrics(spark, path, "bucket string, n long")


@query("k06_file_csv", WITH + f"SELECT source, count(*) AS sentences, round(avg((({S.language()}) = 'english')::INT::DOUBLE), 4) AS english_ratio FROM s GROUP BY 1")
def file_csv(spark, d) -> DataFrame:
    """Ratios by file as CSV with four places (K6)."""
    path = scratch(spark, "files")
    writers.csv(profile.file_profile(sents(spark, d), "source").select("source", "sentences", "english_ratio"), path, ["source"])
    return readers.metrics(spark, path, "source string, sentences long, english_ratio double")


@query("k04_json_summary", WITH + "SELECT count(*) AS total_sentences, sum(strlen(text))::BIGINT AS total_chars FROM s")
def json_summary(spark, d) -> DataFrame:
    """A one-row report as JSON."""
    path = scratch(spark, "summary")
    writers.json_summary(profile.profile(sents(spark, d)), path)
    return readers.report(spark, path).select("total_sentences", "total_chars")


@query("k07_long_sentences_csv", WITH + f"SELECT book_id, position, len({S.fields()}) + 2 AS token_length, length(text) AS char_length FROM s WHERE len({S.fields()}) + 2 >= 24")
def long_sentences_csv(spark, d) -> DataFrame:
    """Long sentences as CSV (K7, K8)."""
    path = scratch(spark, "long")
    n = F.size(X.fields(F.col("text"))) + 2
    writers.csv(sents(spark, d).withColumn("token_length", n).where("token_length >= 24").select("book_id", "position", "token_length", F.length("text").alias("char_length")), path)
    return readers.metrics(spark, path, "book_id long, position long, token_length long, char_length long")


@query("k09_examples_by_split", f"WITH RECURSIVE {_V}, {_E}, {packed_sql(2, 1, 0)} SELECT CASE WHEN {S.rolling('book_id::VARCHAR')} < 95 THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM (SELECT DISTINCT book_id, group_no FROM p) GROUP BY 1")
def examples_by_split(spark, d) -> DataFrame:
    """Examples in a folder for each split, counted from the files."""
    path = scratch(spark, "examples")
    e = packing.build_examples(encoded(spark, d), LIMIT).withColumn("book_id", F.col("book_id").cast("string"))
    e = e.withColumns({"split": sampling.split(F.col("book_id")), "genre": F.lit("Unknown")})
    writers.examples(e.drop("group_no"), path, parts=4)
    return readers.examples(spark, path, EXAMPLE.add("split", "string")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("k12_vocab_file", f"WITH {_V} SELECT token, id::BIGINT AS id FROM v")
def vocab_file(spark, d) -> DataFrame:
    """A vocabulary as lines, ids from line numbers."""
    path = scratch(spark, "vocab")
    writers.vocab(vocab(spark, d), path)
    return readers.vocab(spark, path)


@query("k11_removed_scripts_log", "SELECT doc_id::VARCHAR AS filename, 'T' AS title, lang AS author, source AS genre FROM documents WHERE doc_id % 3 = 0")
def removed_scripts_log(spark, d) -> DataFrame:
    """The log of books with foreign scripts, judged before they are filtered."""
    path = scratch(spark, "scripts")
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("filename"), F.lit("T").alias("title"), F.col("lang").alias("author"), F.col("source").alias("genre"), F.concat("text", F.when(F.col("doc_id") % 3 == 0, "漢字").otherwise("")).alias("text"))
    writers.removed_scripts_log(rows, path)
    return spark.read.schema("filename string, title string, author string, genre string").option("header", "true").option("sep", "\t").csv(path)


@query("e05_index_append", f"SELECT vec_id, query_id, round(s, 6) AS score FROM (SELECT query_id, vec_id, {S.cosine('embedding', 'q')} AS s FROM embeddings, {_Q}) {best_sql('s', 10, 'vec_id')}")
def index_append(spark, d) -> DataFrame:
    """An index written in two steps and searched."""
    path, v = scratch(spark, "index"), table(spark, d, "embeddings")
    writers.embedding_index(v.where("vec_id % 2 = 0"), path)
    writers.embedding_index(v.where("vec_id % 2 <> 0"), path, append=True)
    return search.top_k(spark.read.parquet(path), query_vectors(spark, d), 10, key="vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"))


#: Texts in a file that ``s01_ingest_files`` writes, so that files do not grow with the input.
FILE_ROWS = 1000


@query("s01_ingest_files", f"SELECT count(DISTINCT source) AS folders, count(*) AS lines, sum({S.n_matches('t', '[.!?]')})::BIGINT AS approx_sentences FROM (SELECT source, unnest(list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', {S.NL}, 'g'), {S.NL}), lambda x: {S.trim('x')}), lambda x: x <> '')) AS t FROM documents)")
def ingest_files(spark, d) -> DataFrame:
    """Gzipped text files in nested folders: scan by suffix, gunzip, decode, normalise, split."""
    path = scratch(spark, "raw")
    table(spark, d, "documents").select("source", "text").write.partitionBy("source").option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)
    files = readers.books(readers.raw_files(spark, path)).where("error is null")
    lines = files.select("source", F.explode(F.split("text", "\n")).alias("t")).where("t <> ''")
    folder = F.regexp_extract("source", "source=([^/]*)/", 1)
    return lines.agg(F.countDistinct(folder).alias("folders"), F.count(F.lit(1)).alias("lines"), F.sum(X.approx_sentences(F.col("t"))).cast("long").alias("approx_sentences"))


@query("s10_ordered_books", "SELECT book_id, count(*) AS n, sum(CASE WHEN prev < position THEN 1 ELSE 0 END)::BIGINT AS in_order FROM (SELECT conv_id AS book_id, turn AS position, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY 1")
def ordered_books(spark, d) -> DataFrame:
    """Books whole and in order inside partitions: order is checked as rows come, without another sort."""
    import pyarrow as pa

    def run(batches):
        last, counts = None, {}
        for batch in batches:
            for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, ok = counts.get(b, (0, 0))
                counts[b] = (n + 1, ok + (last is not None and last[0] == b and last[1] < p))
                last = (b, p)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([v[0] for v in counts.values()]), pa.array([v[1] for v in counts.values()])], ["book_id", "n", "in_order"])

    return readers.by_book(turns(spark, d).select("book_id", "position")).mapInArrow(run, "book_id long, n long, in_order long")


@query("j01_book_metadata", WITH + "SELECT s.book_id, s.position, m.lang AS author, m.source AS genre, 'T' || s.book_id AS title FROM s JOIN documents m ON m.doc_id = s.book_id")
def book_metadata(spark, d) -> DataFrame:
    """Metadata joined onto sentences by book."""
    b = books(spark, d)
    meta = b.select("book_id", F.col("lang").alias("author"), F.col("source").alias("genre"), F.concat(F.lit("T"), "book_id").alias("title"))
    return sentences.explode_sentences(b.select("book_id", "text")).join(meta, "book_id").select("book_id", "position", "author", "genre", "title")


@query("x12_python_segmenter", "SELECT doc_id AS book_id, i - 1 AS position, l[i] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10)), chr(10)), lambda x: " + S.trim("x") + "), lambda x: x <> '') AS l FROM documents))")
def python_segmenter(spark, d) -> DataFrame:
    """The hook for a third-party splitter, with a plain one."""
    split = sentences.pandas_segmenter(lambda t: t.replace(". ", ".\n").split("\n"))
    return sentences.explode_sentences(books(spark, d).select("book_id", "text"), split)


@query("t08_first_books", WITH + "SELECT book_id, count(*) AS n FROM s WHERE book_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25) GROUP BY 1")
def first_books(spark, d) -> DataFrame:
    """A run over the first books only."""
    first = books(spark, d).orderBy("book_id").limit(25)
    return sentences.explode_sentences(first).groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))


@query("m01_stream_filter", f"SELECT coalesce({S.reason()}, 'kept') AS reason, count(*) AS n FROM conversations WHERE text <> '' GROUP BY 1")
def stream_filter(spark, d) -> DataFrame:
    """The quality filter over a stream of files, reasons counted as it runs (M1, M3)."""
    name = f"reasons_{uuid.uuid4().hex}"
    s = filters.sentence_stream(spark, f"{d}/conversations.parquet*", "conv_id long, turn long, role string, text string", kind="parquet")
    q = filters.reason_counts_stream(s, script="latin").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("m04_stream_dedup", "SELECT DISTINCT text FROM conversations WHERE text <> ''")
def stream_dedup(spark, d) -> DataFrame:
    """Deduplication as a stream; state is one hash a text (M2, M4)."""
    s = filters.sentence_stream(spark, f"{d}/conversations.parquet*", "conv_id long, turn long, role string, text string", kind="parquet")
    out = scratch(spark, "unique")
    filters.run_once(filters.unique_stream(s.where("text <> ''")).select("text"), out, scratch(spark, "unique-state"))
    return spark.read.schema("text string").parquet(out)


@query("m05_batches", "SELECT count(*) AS rows, ceil(count(*) / 64.0)::BIGINT AS least_batches FROM conversations")
def batches(spark, d) -> DataFrame:
    """Fixed-size batches for a consumer: sizes add up, none is over 64."""
    sizes = [len(b) for b in readers.example_batches(turns(spark, d).select("book_id"), 64)]
    assert max(sizes) <= 64
    return spark.createDataFrame([(sum(sizes), len(sizes))], "rows long, least_batches long")


@query("d02_vocab_sweep")
def vocab_sweep(spark, d) -> DataFrame:
    """WordPiece for several sizes, each the beginning of one training, with whole-word coverage of each. Texts are read once:
    a word lies within one token, so the distinct tokens have the words of the texts."""
    counts = kept(tokenization.word_counts(table(spark, d, "documents"), F.split(X.utrim(F.col("text")), r"\s+")))
    tokens = tokenization.train_wordpiece_vocab(counts, 4000, lowercase=True)
    words = counts.select(F.explode(X.words(F.col("token"))).alias("token"))
    return tokenization.word_coverage_by_size(words, tokens, (1000, 2000, 4000))


@query("a17_word_coverage_by_size")
def word_coverage_by_size(spark, d) -> DataFrame:
    return vocab_sweep(spark, d).select("vocab_size", "coverage")


@query("e01_embedder_hook", "SELECT doc_id, 64::BIGINT AS dims, text <> '' AS filled FROM documents")
def embedder_hook(spark, d) -> DataFrame:
    """The hook for a neural encoder, with hashed counts in its place."""
    embed = search.embedder(HashedModel, 64)
    e = table(spark, d, "documents").select("doc_id", embed("text").alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.select("doc_id", F.size("e").alias("dims"), (total > 0).alias("filled"))


class HashedModel:
    """Counts of words by hash, where a model would be."""

    def encode(self, texts: list[str]):
        import zlib

        import numpy as np

        out = np.zeros((len(texts), 64), np.float32)
        for i, t in enumerate(texts):
            for w in t.split():
                out[i, zlib.crc32(w.encode()) % 64] += 1
        return out
