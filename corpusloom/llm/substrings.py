"""Substring dedup by de Bruijn compaction of repeated word windows.

Windows of ``K`` consecutive words are the edges of a de Bruijn graph; its nodes are the K-1 words at either end. Only edges
that come in several texts matter, and they are found without shuffling every window:

1. Each window has an anchor, the least hash among its sub-windows of ``M`` words. Equal windows have equal anchors, and
   neighbouring windows mostly share theirs, so about one row in five windows is shuffled. Anchors that occur in two
   different texts are marked in a bitmap, sized by their count up to a bound; a full one only lets more through.
2. Windows whose anchor is marked become edges, named by the hashes of their two nodes. Those of one occurrence of an
   anchor travel as one row and are grouped by anchor, so equal edges meet; what the bitmap lets through in vain finds no
   partner. Each edge's source is its first occurrence, by document and position. Anchors with ``HOT`` occurrences or more
   take another way: sources by an aggregation that starts in each task, then a join that Spark may split, so that no task
   gets all occurrences of one passage.
3. The distinct repeated edges are the graph. Joins on the nodes link an edge to the one before it wherever the node
   between them has one edge in and one out, and the sources' coordinates verify the link: one document, the next word.
   Maximal runs of verified links are the nonbranching paths, each one row: source document, first word, edges.
4. Occurrences along one path, at one distance from it, compact into one span of the text, whose words go. Exact copies of
   a text are settled by their doc_ids alone; a second bitmap keeps all but the first of them out of the steps above.

A null doc_id counts as greater than every other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import bits_for, column, keep, key_filter, may_hold, small_batches, small_side, text_keys, words_of

K = 13
M = 5
LAST = (1 << 63) - 1
#: Occurrences of an anchor from which its sources are found by partial aggregation.
HOT = 4096
#: Words hashed at once, and words whose hash is remembered.
CHUNK = 200_000
REMEMBER = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _join(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Hashes of windows made of windows ``a`` and the windows ``b`` that start ``n`` words later."""
    m = min(len(a), len(b) - n)
    return _mix(a[:m] * np.uint64(0x9E3779B97F4A7C15) + b[n : n + m]) if m > 0 else np.zeros(0, np.uint64)


def windows(h: np.ndarray, k: int, known: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Hashes of all windows of ``k`` words from the words' hashes, by joining windows of powers of two."""
    known = {1: h} if known is None else known
    if k not in known:
        half = 1 << ((k - 1).bit_length() - 1)
        known[k] = _join(windows(h, half, known), windows(h, k - half, known), half)
    return known[k]


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` consecutive values."""
    span = 1
    while span < n:
        step = min(span, n - span)
        x = np.minimum(x[: len(x) - step], x[step:])
        span += step
    return x


def _word_hash(seed: int) -> Callable[[bytes], int]:
    class Hashes(dict):
        def __missing__(known, word: bytes) -> int:
            if len(known) >= REMEMBER:
                known.clear()
            value = known[word] = xxhash.xxh64_intdigest(word, seed)
            return value

    return Hashes().__getitem__


def _chunks(batches: Iterator[pa.RecordBatch], names: list[str], firsts: np.ndarray) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts with ``K`` words or more, some at a time: rows, start of each in the chunk, words' hashes, windows that lie in one text.

    Rows whose ``key`` isn't in the bitmap ``firsts`` surely are a copy of a text with a smaller doc_id, and are left out.
    """
    find = _word_hash(1)
    rows, parts, total = [], [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            batch = batch.filter(pa.array(may_hold(firsts, column(batch, "key").to_numpy())))
            for text, *row in zip(*(column(batch, n).to_pylist() for n in ("text", *names)), strict=True):
                words = words_of(text)
                if len(words) < K:
                    continue
                rows.append(tuple(row))
                parts.append(np.fromiter(map(find, words), np.uint64, len(words)))
                total += len(words)
                if total >= CHUNK:
                    yield _chunk(rows, parts)
                    rows, parts, total = [], [], 0
    if rows:
        yield _chunk(rows, parts)


def _chunk(rows: list[tuple], parts: list[np.ndarray]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    inside = np.ones(int(ends[-1]), bool)
    for e in ends:
        inside[e - K + 1 : e] = False
    return rows, starts, np.concatenate(parts), np.flatnonzero(inside)


def _anchors(h: np.ndarray, own: np.ndarray, known: dict[int, np.ndarray]) -> np.ndarray:
    return _least(windows(h, M, known), K - M + 1)[own]


def repeated_anchors(texts: DataFrame, firsts: np.ndarray) -> DataFrame:
    """(anchor, n) of the anchors in two or more different texts. ``texts``: (text, k1, key)."""
    shared = texts.sparkSession.sparkContext.broadcast(firsts)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, h, own in _chunks(batches, ["k1"], shared.value):
            anchors = _anchors(h, own, {1: h})
            text = np.searchsorted(starts, own, side="right") - 1
            new = _starts_of_runs(anchors, text)
            keys = np.array([r[0] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(anchors[new].view(np.int64)), pa.array(keys[text[new]])], ["anchor", "k1"])

    rows = texts.mapInArrow(run, "anchor long, k1 long")
    return rows.groupBy("anchor").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("anchor", "n")


def _starts_of_runs(anchors: np.ndarray, *others: np.ndarray) -> np.ndarray:
    new = np.ones(len(anchors), bool)
    new[1:] = anchors[1:] != anchors[:-1]
    for x in others:
        new[1:] |= x[1:] != x[:-1]
    return new


def edges(texts: DataFrame, firsts: np.ndarray, marked: np.ndarray, hot: np.ndarray) -> DataFrame:
    """(anchor, hot, doc, k1, pos, ns): windows from ``pos`` on with one anchor, as the hashes of the nodes they pass, one
    more than there are windows. ``texts``: (text, doc, k1, key).

    ``marked`` and ``hot``: bitmaps of the anchors that may come in several texts, and in very many.
    """
    shared = texts.sparkSession.sparkContext.broadcast((marked, hot, firsts))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, h, own in _chunks(batches, ["doc", "k1"], shared.value[2]):
            known = {1: h}
            anchors = _anchors(h, own, known)
            take = may_hold(shared.value[0], anchors)
            own, anchors = own[take], anchors[take]
            if not len(own):
                continue
            text = np.searchsorted(starts, own, side="right") - 1
            new = _starts_of_runs(anchors, text, own - np.arange(len(own)))  # one anchor, one text, no gap
            at = np.flatnonzero(new)
            ends = np.append(at, len(own))
            last = ends[1:] - 1
            passed = np.insert(own, ends[1:], own[last] + 1)  # the node after the last window of each run
            nodes = pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), pa.array(windows(h, K - 1, known)[passed].view(np.int64)))
            doc, k1 = np.array(rows, np.int64).T
            cols = [pa.array(anchors[at].view(np.int64)), pa.array(may_hold(shared.value[1], anchors[at])), pa.array(doc[text[at]]), pa.array(k1[text[at]]), pa.array((own - starts[text])[at].astype(np.int32)), nodes]
            yield pa.RecordBatch.from_arrays(cols, ["anchor", "hot", "doc", "k1", "pos", "ns"])

    return texts.mapInArrow(run, "anchor long, hot boolean, doc long, k1 long, pos int, ns array<long>")


def _each(rows: DataFrame) -> DataFrame:
    """(anchor, a, b, doc, k1, pos): one row for each edge."""
    pairs = F.arrays_zip(F.slice("ns", F.lit(1), F.size("ns") - 1).alias("a"), F.slice("ns", F.lit(2), F.size("ns") - 1).alias("b"))
    return rows.select("anchor", "doc", "k1", "pos", F.posexplode(pairs).alias("i", "e")).select("anchor", "e.a", "e.b", "doc", "k1", (F.col("pos") + F.col("i")).alias("pos"))


def _hits(texts: DataFrame, firsts: np.ndarray) -> DataFrame:
    """(k1, pos, source_doc, source_pos, a, b): edges that also start in a smaller document, a and b null, and their sources,
    one row for each distinct edge, with its nodes a and b."""
    anchors = keep(repeated_anchors(texts, firsts), "anchors")
    many = anchors.where(F.col("n") >= HOT)
    marked, hot = key_filter(anchors, "anchor", bits_for(anchors.count())), key_filter(many, "anchor", 20)
    own = keep(edges(texts, firsts, marked, hot), "edges")
    same = Window.partitionBy("anchor", "a", "b").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # HOT rows at most
    dealt = _each(own.where(~F.col("hot")).repartition("anchor")).withColumns({"source_doc": F.first("doc").over(same), "source_pos": F.first("pos").over(same), "top": F.last("doc").over(same)})
    hit, source = F.col("doc") > F.col("source_doc"), (F.col("doc") == F.col("source_doc")) & (F.col("pos") == F.col("source_pos")) & (F.col("top") > F.col("doc"))
    node = {n: F.when(~hit, F.col(n)) for n in ("a", "b")}
    names = ["k1", "pos", "source_doc", "source_pos", "a", "b"]
    hits = dealt.where(hit | source).withColumns(node).select(names)
    if hot.any():
        some = _each(own.where("hot"))
        first = some.groupBy("anchor", "a", "b").agg(F.min(F.struct("doc", "pos", "k1")).alias("s"), F.max("doc").alias("top")).where("s.doc < top")
        first = first.select("anchor", "a", "b", "s.k1", F.col("s.pos").alias("pos"), F.col("s.doc").alias("source_doc"), F.col("s.pos").alias("source_pos"))
        found = some.join(first.drop("k1", "pos"), ["anchor", "a", "b"]).where("doc > source_doc").withColumns({n: F.lit(None).cast("long") for n in ("a", "b")})
        hits = hits.unionByName(found.select(names)).unionByName(first.select(names))
    return hits


def paths(graph: DataFrame) -> DataFrame:
    """(source_doc, source_pos, path) of every distinct edge of ``graph`` (a, b, source_doc, source_pos): path is the source
    position of the first edge of its nonbranching path.

    An edge continues the path of another if that one is the only edge into the node between them, it is the only one
    out of it, and it comes one word later in the same source document. Equal edges have one source.
    """
    graph = keep(graph.distinct(), "graph")
    one_in = graph.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("source_doc").alias("doc_in"), F.min("source_pos").alias("pos_in")).where("n = 1").drop("n")
    one_out = graph.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("source_doc").alias("source_doc"), F.min("source_pos").alias("source_pos")).where("n = 1").drop("n")
    # links at nodes inside paths: an edge and the one before it
    linked = one_in.join(one_out, "node").where((F.col("doc_in") == F.col("source_doc")) & (F.col("pos_in") + 1 == F.col("source_pos"))).select("source_doc", "source_pos", F.lit(True).alias("goes_on"))
    places = graph.select("source_doc", "source_pos").join(linked, ["source_doc", "source_pos"], "left")
    along = Window.partitionBy("source_doc").orderBy("source_pos")  # one document's edges
    start = F.last(F.when(F.col("goes_on").isNull(), F.col("source_pos")), ignorenulls=True).over(along)
    return places.select("source_doc", "source_pos", start.alias("path"))


def _keyed(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text", *text_keys())


def repeated_spans(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(k1, start, end, source_doc, source_start): words [start, end) of the text k1 repeat a smaller document's.

    ``rows``: (doc, k1, k2) of every document, kept. Spans may overlap: each lies on one path, or on two that meet.
    """
    first = keep(rows.groupBy("k1", "k2").agg(F.min("doc").alias("doc")), "first-copies")
    firsts = key_filter(first.select(F.xxhash64("k1", "k2", "doc").alias("key")), "key", bits_for(first.count()))
    hits = keep(_hits(_keyed(docs).select("text", "doc", "k1", F.xxhash64("k1", "k2", "doc").alias("key")), firsts), "hits")
    own = first.groupBy("k1").agg(F.min("doc").alias("first"))  # a text stands for its copy with the smallest doc_id
    found = hits.where("a is null").join(own, "k1").where("source_doc < first").select("k1", "pos", "source_doc", (F.col("source_pos") - F.col("pos")).alias("shift")).distinct()
    lane = ["k1", "source_doc", "shift"]
    run = F.col("pos") - F.row_number().over(Window.partitionBy(*lane).orderBy("pos"))
    runs = found.withColumn("run", run).groupBy(*lane, "run").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    # a run of occurrences whose sources are consecutive too is cut where a path ends
    starts = paths(hits.where("a is not null").select("a", "b", "source_doc", "source_pos")).where("source_pos = path")
    starts = keep(starts.groupBy("source_doc").agg(F.array_sort(F.collect_list("path")).alias("starts")), "path-starts")  # of one document
    cuts = F.filter(F.transform("starts", lambda x: x - F.col("shift")), lambda x: (x > F.col("low")) & (x <= F.col("high")))
    pieces = runs.join(small_side(starts), "source_doc").withColumn("cuts", cuts)
    pieces = pieces.select("k1", "source_doc", "shift", "high", F.concat(F.array("low"), "cuts").alias("lows"))
    pieces = pieces.select("k1", "source_doc", "shift", F.explode(F.arrays_zip(F.col("lows").alias("low"), F.concat(F.transform(F.slice("lows", F.lit(2), F.size("lows")), lambda x: x - 1), F.array("high")).alias("high"))).alias("p"))
    return pieces.select("k1", F.col("p.low").alias("start"), (F.col("p.high") + K).alias("end"), "source_doc", (F.col("p.low") + F.col("shift")).alias("source_start"))


def _covered(n: int, spans: list[dict]) -> np.ndarray:
    cover = np.zeros(n + 1, np.int64)
    for s in spans:
        cover[s["start"]] += 1
        cover[min(n, s["end"])] -= 1
    return np.cumsum(cover)[:-1] > 0


def _kept_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    gone = _covered(len(words), spans)
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _document_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, k1, k2, n_words, whole_sha256) of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in column(batch, "text").to_pylist()]
            cols = [column(batch, n) for n in ("doc_id", "doc", "k1", "k2")]
            digests = pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words])
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(w) for w in words], pa.int64()), digests], ["doc_id", "doc", "k1", "k2", "n_words", "whole_sha256"])

    return _keyed(docs).withColumn("doc_id", F.when(F.col("doc") < LAST, F.col("doc"))).mapInArrow(run, "doc_id long, doc long, k1 long, k2 long, n_words long, whole_sha256 string")


def remove_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, texts). rows: a row for each row of ``docs`` (doc_id, text): doc_id, k1, k2, n_words, whole_sha256, state.

    state is "copy" (an equal text has a smaller doc_id, and it is long enough to go whole), "cut" (its remains are in
    ``texts``) or "whole". texts: (k1, k2, n_removed, kept_sha256, kept_text), a row for each text that is cut. Null and
    empty texts have no words; equal rows fare alike; an empty table gives empty tables.
    """
    rows = keep(_document_rows(docs), "document-rows")
    spans = keep(repeated_spans(docs, rows).groupBy("k1").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    bits = key_filter(spans, "k1", bits_for(spans.count()))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            k1, k2 = column(batch, "k1").to_numpy(), column(batch, "k2").to_numpy()
            take = []
            for i in np.flatnonzero(may_hold(shared.value, k1)).tolist():
                if (key := (k1[i], k2[i])) not in seen:
                    seen.add(key)
                    take.append(i)
            if take:
                yield batch.take(pa.array(take))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans_ in zip(column(batch, "text").to_pylist(), column(batch, "spans").to_pylist(), strict=True):
                words = words_of(text)
                kept = _kept_words(words, spans_)
                line = b" ".join(kept)
                out.append((len(words) - len(kept), hashlib.sha256(line).hexdigest(), line.decode("utf-8", "surrogatepass")))
            n, sha, text_ = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([column(batch, "k1"), column(batch, "k2"), pa.array(n, pa.int64()), pa.array(sha), pa.array(text_)], ["k1", "k2", "n_removed", "kept_sha256", "kept_text"])

    some = docs.select(F.coalesce("text", F.lit("")).alias("text"), *text_keys()).mapInArrow(pick, "text string, k1 long, k2 long")
    texts = some.join(spans, "k1").mapInArrow(cut, "k1 long, k2 long, n_removed long, kept_sha256 string, kept_text string").dropDuplicates(["k1", "k2"])
    first = rows.groupBy("k1", "k2").agg(F.min("doc").alias("first"))
    state = F.when((F.col("doc") > F.col("first")) & (F.col("n_words") >= K), "copy").when(F.col("cut"), "cut").otherwise("whole")
    marked = rows.join(first, ["k1", "k2"]).join(spans.select("k1", F.lit(True).alias("cut")), "k1", "left").withColumn("state", state)
    return marked.select("doc_id", "k1", "k2", "n_words", "whole_sha256", "state"), texts


def query(spark, sf_dir: str) -> DataFrame:
    """op9: words, removed words and the digest of the kept ones of every document."""
    rows, texts = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = rows.join(texts.select("k1", "k2", F.col("n_removed").alias("gone"), "kept_sha256"), ["k1", "k2"], "left")
    removed = F.when(F.col("state") == "copy", F.col("n_words")).when(F.col("state") == "cut", F.col("gone")).otherwise(F.lit(0))
    digest = F.when(F.col("state") == "copy", F.sha2(F.lit(""), 256)).when(F.col("state") == "cut", F.col("kept_sha256")).otherwise(F.col("whole_sha256"))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), digest.alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM i),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT g.doc_id, g.i FROM g JOIN f USING (g) WHERE f.first < g.doc_id), (SELECT unnest(range(13)) AS j)),
x AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d) ANTI JOIN c USING (doc_id, p)),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM x GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
