"""Readers: every source of the pipeline as a DataFrame, opened by Spark's readers only (any file system it knows)."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.schema import SENTENCE, SPECIALS


def _gunzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, filename, content, error), a batch for each file: no more than one is held unpacked."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            try:
                content, error = gzip.decompress(row.column(2)[0].as_py()), None
            except Exception as e:
                content, error = None, f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["path", "filename", "content", "error"])


def raw_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".txt", ".txt.gz"), recursive: bool = True) -> DataFrame:
    """(path, filename, content, error): bytes of files by suffix, gunzipped where the name ends in .gz.

    A file that can't be unpacked gives a row with an error instead of failing the job.
    """

    def listed(own: list[str]) -> DataFrame | None:  # the glob keeps other files from being read
        if not own:
            return None
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*{{{','.join(own)}}}").load(path)
        return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content")

    plain, packed = (listed([s for s in suffixes if s.endswith(".gz") == gz]) for gz in (False, True))
    plain = plain.withColumn("error", F.lit(None).cast("string")) if plain else None
    packed = packed.mapInArrow(_gunzipped, "path string, filename string, content binary, error string") if packed else None
    return plain.unionByName(packed) if plain and packed else plain or packed


def flat_text_files(spark: SparkSession, path: str) -> DataFrame:
    """As above for *.txt of one folder."""
    return raw_files(spark, path, (".txt",), recursive=False)


def books(files: DataFrame, charset: str | None = None) -> DataFrame:
    """(id, title, author, genre, source, text, filename, error): decoded, normalised, with metadata from the file name.

    The id is the SHA-256 of the path, so that a second run gives the same books. ``charset`` names a column.
    """
    files.sparkSession.conf.set("spark.sql.legacy.javaCharsets", "true")
    meta = X.filename_metadata(F.col("filename"))
    text = X.normalize(X.to_utf8(F.col("content"), F.col(charset) if charset else None))
    rows = files.select(F.sha2("path", 256).alias("id"), meta.alias("m"), F.col("path").alias("source"), text.alias("text"), "filename", "error")
    return rows.select("id", X.title_or_name(F.col("m.title"), F.col("filename")).alias("title"), "m.author", "m.genre", "source", "text", "filename", "error")


def jsonl(spark: SparkSession, path: str, schema=SENTENCE, glob: str = "*.jsonl*") -> DataFrame:
    """Sentences from JSON lines, plain or gzipped; malformed lines and rows without a text are skipped."""
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").json(path)
    return raw.where(F.coalesce(F.col("text"), F.lit("")) != "")


def jsonl_with_fallback(spark: SparkSession, path: str, schema=SENTENCE) -> DataFrame:
    """The gzipped files if there are any, else the plain ones."""
    packed = jsonl(spark, path, schema, "*.jsonl.gz")
    return packed if packed.inputFiles() else jsonl(spark, path, schema, "*.jsonl")


def jsonl_by_file(spark: SparkSession, path: str, schema=SENTENCE) -> DataFrame:
    """Sentences with book_id from the file's stem, as older data has it."""
    stem = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.jsonl(\.gz)?$", "")
    return jsonl(spark, path, schema).withColumn("book_id", stem)


def by_book(sentences: DataFrame) -> DataFrame:
    """Whole books together and in order inside partitions."""
    return sentences.repartition("book_id").sortWithinPartitions("book_id", "position")


def corpus_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Stripped, non-empty lines; ``limit`` takes the first lines, blank ones included, as a sample."""
    lines = spark.read.text(path)
    lines = lines.limit(limit) if limit else lines
    return lines.select(X.utrim(F.col("value")).alias("text")).where(F.col("text") != "")


def vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token, id): a line's number, blank lines not counted. The file is read as one text: a vocabulary is small and ordered."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.filter(F.transform(F.split("value", "\n"), X.utrim), lambda s: s != "")).alias("id", "token"))
    return lines.select("token", "id")


def has_specials(vocabulary: DataFrame) -> bool:
    """Whether the special tokens stand where the models expect them."""
    own = dict(vocabulary.where(F.col("token").isin(*SPECIALS)).collect())  # five rows
    return own == SPECIALS


def metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def examples(spark: SparkSession, path: str, schema) -> DataFrame:
    """Training examples from JSON lines, with the split from the folder."""
    return spark.read.schema(schema).json(path)


def example_batches(rows: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of ``size``, a partition at a time on the driver: bounded memory for a consumer outside Spark."""
    batch: list = []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def run_config(text: str) -> dict:
    """A run's YAML configuration: nested ``key: value`` maps and scalars, as these files use."""
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        return _simple_yaml(text)


def _simple_yaml(text: str) -> dict:
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth, (key, _, value) = len(body) - len(body.lstrip()), body.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            stack[-1][1][key] = _scalar(value.strip())
        else:
            stack[-1][1][key] = child = {}
            stack.append((depth, child))
    return root


def _scalar(value: str):
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    named = {"true": True, "false": False, "null": None, "~": None}
    return named[value.lower()] if value.lower() in named else value.strip("\"'")
