"""Invariants and small cases of the corpus operators."""

import collections
import gzip
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.arrays import let
from corpusloom.operators import dedup, masking, packing, profile, quality, sampling, search, sentences, tokenization
from corpusloom.schema import SPECIALS
from corpusloom.sources import readers, writers
from corpusloom.streaming import filters


def sents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select(F.col("doc_id").alias("book_id"), "source", "lang", "text")
    return sentences.explode_sentences(docs)


def test_kept_and_reasons_add_up(spark, tiny):
    s = sents(spark, tiny)
    counts = {r["reason"]: r["n"] for r in quality.reason_counts(s, script="latin").collect()}
    assert sum(counts.values()) == s.count()
    good = quality.good_sentences(s, script="latin")
    assert good.count() == counts["kept"]
    assert good.agg(F.min(F.length("text")), F.max(F.length("text"))).first()[0] >= 20


def test_dedup_is_idempotent(spark, tiny):
    s = sents(spark, tiny)
    once = dedup.exact_dedup(s)
    stats = dedup.duplicate_stats(s).first()
    assert once.count() == s.select("text").distinct().count() == stats["unique_texts"] == dedup.exact_dedup(once).count()
    assert stats["unique_texts"] + stats["exact_duplicates"] == stats["total"]


def test_percentiles_follow_the_index_rule(spark):
    df = spark.createDataFrame([(x,) for x in (10, 20, 30, 40)], "v int")
    got = {r["p"]: r["value"] for r in profile.percentiles(df, F.col("v"), (0, 25, 50, 75, 99, 100)).collect()}
    assert got == {0: 10, 25: 20, 50: 30, 75: 40, 99: 40, 100: 40}
    linear = {r["p"]: r["value"] for r in profile.interpolated_percentiles(df, F.col("v"), (0, 50, 99, 100)).collect()}
    assert linear == {0: 10, 50: 25, 99: 39, 100: 40}


def test_profile_of_nothing(spark):
    empty = spark.createDataFrame([], "book_id long, position int, text string")
    assert profile.profile(empty).first()["total_sentences"] == 0
    assert profile.length_summary(empty).first()["avg_length"] is None
    assert profile.percentiles(empty, F.length("text")).count() == 0


def test_language_classes_and_histogram_partition(spark, tiny):
    s = sents(spark, tiny)
    p = profile.profile(s).first()
    assert p["russian"] + p["english"] + p["mixed"] + p["other"] == p["total_sentences"]
    assert profile.length_histogram(s).agg(F.sum("n")).first()[0] == p["total_sentences"]


def test_garbage_ratio_may_exceed_one(spark):
    df = spark.createDataFrame([("b", "see https://x.org and mail a@b.org")], "book_id string, text string")
    assert profile.file_profile(df).first()["garbage_ratio"] == 2.0


def test_greedy_packing(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate((5, 5, 5, 20, 3))] + [(2, 0, 4)], "book_id long, position long, n long")
    got = collections.defaultdict(list)
    for r in packing.greedy_groups(df, 15).orderBy("book_id", "position").collect():
        got[r["book_id"], r["group_no"]].append(r["n"])
    assert list(got.values()) == [[5, 5], [5], [20], [3], [4]]


def test_encode_group(spark):
    df = spark.createDataFrame([([[10, 11], [12]],)], "s array<array<int>>")
    e = df.select(packing.encode_group(F.col("s"), 8).alias("e")).first()["e"]
    assert e["input_ids"] == [2, 10, 11, 3, 12, 3, 0, 0] and e["attention_mask"] == [1] * 6 + [0] * 2 and e["token_type_ids"] == [0] * 8
    cut = df.select(packing.encode_group(F.col("s"), 4).alias("e")).first()["e"]
    assert cut["input_ids"] == [2, 10, 11, 3]


def test_examples_have_one_length_and_one_book(spark):
    rows = [(b, p, list(range(5, 5 + (b * 7 + p * 13) % 40))) for b in range(6) for p in range(20)]
    df = spark.createDataFrame(rows, "book_id long, position long, ids array<int>")
    for r in packing.build_examples(df, 64).collect():
        assert len(r["input_ids"]) == len(r["attention_mask"]) == len(r["token_type_ids"]) == 64
        assert sum(r["attention_mask"]) == sum(1 for x in r["input_ids"] if x) and r["input_ids"][0] == 2
    for r in packing.build_examples_flat(df, 64).collect():
        assert len(r["input_ids"]) == len(r["labels"]) == 64


def test_split_depends_on_the_book_only(spark, tiny):
    s = sents(spark, tiny).withColumn("split", sampling.split(F.col("book_id").cast("string")))
    assert s.groupBy("book_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_samples_repeat_and_have_their_size(spark, tiny):
    s = sents(spark, tiny)
    a = sampling.sample_per_group(s, ("source",), ("book_id", "position"), 0.1)
    sizes = {r["source"]: r["count"] for r in s.groupBy("source").count().collect()}
    assert {r["source"]: r["count"] for r in a.groupBy("source").count().collect()} == {k: max(1, n // 10) for k, n in sizes.items()}
    assert a.exceptAll(sampling.sample_per_group(s, ("source",), ("book_id", "position"), 0.1)).count() == 0


def test_masking(spark):
    ids = [2, *range(10, 400), 3, 0, 0]
    df = spark.createDataFrame([(i, ids) for i in range(20)], "k long, ids array<int>")
    hit = total = masked = 0
    for r in df.select(masking.mask_tokens(F.col("ids"), F.col("k"), 1000).alias("m")).collect():
        for x, m, y in zip(ids, r["m"]["masked_ids"], r["m"]["labels"], strict=True):
            if y == -100:
                assert m == x
            else:
                assert y == x and x not in (0, 2, 3)
                hit += 1
                masked += m == SPECIALS["[MASK]"]
            total += x not in (0, 2, 3)
    assert 0.13 < hit / total < 0.17 and 0.75 < masked / hit < 0.85


def test_predictions_variations_and_pieces(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    arr = lambda *x: F.array(*map(F.lit, x))
    assert get(masking.clean_predictions(arr("[CLS]", "дом", ".", "дом,", "«кот»", "кот", "!"), 2)) == ["дом", "кот"]
    assert get(masking.usable_variations(F.lit("кот"), arr("кот", "", "коты", "слишком длинная строка", "кит"), 2)) == ["коты", "кит"]
    assert get(tokenization.subsequence_at(arr(1, 2, 3, 2, 3), arr(2, 3))) == 1
    assert get(tokenization.subsequence_at(arr(1), arr(2, 3))) == -1
    assert get(tokenization.join_pieces(arr("при", "##вет"))) == "привет"
    assert get(masking.mask_first_long_word(F.lit("да нет, пожалуй, можно"))["masked"]) == "да нет, [MASK] можно"
    assert get(let(F.lit(3), lambda x: x * x)) == 9


def test_wordpiece_equals_the_library(spark, tiny):
    df = spark.read.parquet(f"{tiny}/documents.parquet")
    counts = tokenization.word_counts(df, F.split(X.utrim(F.col("text")), r"\s+"))
    t = tokenization.train_wordpiece(counts, 1500)
    assert [t.token_to_id(k) for k in SPECIALS] == list(SPECIALS.values())
    encode = tokenization.encoder(t.to_str())
    for r in df.select("text", encode("text").alias("ids")).limit(40).collect():
        assert r["ids"] == t.encode(r["text"]).ids


def test_search(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0])], "id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id long, query_vector array<float>")
    got = {(r["query_id"], r["id"]): round(r["score"], 6) for r in search.top_k(index, queries, 3).collect()}
    assert got == {(7, 1): 1.0, (7, 4): 1.0, (7, 2): round(0.5**0.5, 6), (8, 2): round(0.5**0.5, 6), (8, 1): 0.0, (8, 3): 0.0}
    c = spark.createDataFrame([(1, "a", 0.5, 3.0), (1, "b", 0.1, 6.0), (2, "a", 0.5, 0.0)], "query_id long, id string, semantic_score double, keyword_raw_score double")
    assert {(r["query_id"], r["id"]): round(r["score"], 6) for r in search.hybrid(c, 5).collect()} == {(1, "a"): 0.5, (1, "b"): 0.46, (2, "a"): 0.3}
    docs = spark.createDataFrame([(1, "кот спит"), (2, "кот кот ест"), (3, "пёс")], "id long, text string")
    hits = search.bm25(docs, spark.createDataFrame([(7, "кот")], "query_id long, query string")).collect()
    assert {r["id"] for r in hits} == {1, 2} and max(hits, key=lambda r: r["score"])["id"] == 2
    near = spark.createDataFrame([(i, [1.0 if i % 2 else 0.0, float(i % 2 == 0), 0.001 * i]) for i in range(6)], "vec_id long, embedding array<float>")
    assert {(r["a"], r["b"]) for r in search.semantic_duplicates(near).collect()} == {(0, 2), (0, 4), (2, 4), (1, 3), (1, 5), (3, 5)}


def test_a_query_set_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_QUERIES", 1)
    with pytest.raises(ValueError):
        search.checked_queries(spark.range(2))


def test_keyphrases_are_diverse(spark):
    docs = spark.createDataFrame([(1, "кот спит дома. кот ест"), (2, ""), (3, None)], "id long, text string")
    rows = search.keyphrases(docs, "id", top_n=2).collect()
    assert [(r["id"], r["rank"]) for r in rows] == [(1, 1), (1, 2)] and len({r["phrase"] for r in rows}) == 2
    got = search.mmr("кот кот спит дом", ["кот", "кот кот", "дом", "спит"], 3, 10, 0.5)
    assert got[0]["phrase"] in ("кот", "кот кот") and len({g["phrase"] for g in got}) == 3


def test_ingest_and_sinks(spark, tmp_path):
    raw = tmp_path / "raw" / "deep"
    raw.mkdir(parents=True)
    (raw / "история_Иванов — Книга.txt").write_bytes("Раз два. Три!\r\nЧетыре".encode("cp1251"))
    (raw / "b.txt.gz").write_bytes(gzip.compress("Пять.".encode()))
    (raw / "bad.txt.gz").write_bytes(b"no gzip")
    (raw / "skip.md").write_text("x")
    books = readers.books(readers.raw_files(spark, str(tmp_path / "raw")))
    rows = {r["filename"]: r for r in books.collect()}
    assert set(rows) == {"история_Иванов — Книга.txt", "b.txt.gz", "bad.txt.gz"}
    assert rows["история_Иванов — Книга.txt"]["text"] == "Раз два. Три!\nЧетыре" and rows["история_Иванов — Книга.txt"]["author"] == "Иванов"
    assert rows["bad.txt.gz"]["error"]
    summary = sentences.ingest_summary(books.select("text", "error")).first()
    assert tuple(summary) == (3, 2, 1, 0, 3)
    s = sentences.explode_sentences(books.where("error is null").select(F.col("id").alias("book_id"), "title", "author", "genre", "text")).withColumn("created_at", F.lit(None).cast("timestamp"))
    out = str(tmp_path / "sents")
    for _ in range(2):
        writers.jsonl_parts(s, out, parts=2)
    again = readers.jsonl(spark, out, glob="*.json.gz")
    assert again.count() == s.count() == 4
    writers.corpus_text(sentences.corpus_lines(again), str(tmp_path / "corpus"), single=True)
    assert readers.corpus_lines(spark, str(tmp_path / "corpus")).count() == 4
    writers.csv(profile.length_histogram(s), str(tmp_path / "hist"), ["bucket"])
    assert readers.metrics(spark, str(tmp_path / "hist"), "bucket string, n long").agg(F.sum("n")).first()[0] == 4
    writers.json_summary(profile.profile(s), str(tmp_path / "summary"))
    assert readers.report(spark, str(tmp_path / "summary")).first()["total_sentences"] == 4


def test_json_lines_skip_what_is_malformed(spark, tmp_path):
    lines = [json.dumps({"book_id": "1", "text": "да", "position": 0}), "{oops", "", json.dumps({"book_id": "1", "text": ""}), json.dumps({"book_id": "1"})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    assert [r["text"] for r in readers.jsonl_by_file(spark, str(tmp_path)).collect()] == ["да"]
    assert readers.jsonl_with_fallback(spark, str(tmp_path)).first()["text"] == "да"


def test_vocab_file(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("\n".join([*SPECIALS, "", "слово"]))
    v = readers.vocab(spark, str(tmp_path / "vocab.txt"))
    assert dict(v.collect())["слово"] == 5 and readers.has_specials(v)


def test_config():
    got = readers._simple_yaml("model:\n  layers: 6\n  name: 'x'  # note\ntrain:\n  fp16: true\n  lr: 1e-4\n")
    assert got == {"model": {"layers": 6, "name": "x"}, "train": {"fp16": True, "lr": 1e-4}}


def test_batches(spark):
    got = list(readers.example_batches(spark.range(10).repartition(3), 4))
    assert [len(b) for b in got] == [4, 4, 2]


def test_stream_filters_like_batch_and_resumes(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    line = lambda t: json.dumps({"book_id": "1", "text": t, "position": 0})
    (src / "1.json").write_text("\n".join(map(line, ["Достаточно длинное предложение.", "мало", "Достаточно длинное предложение."])))
    go = lambda: filters.run_once(filters.unique_stream(filters.good_stream(filters.sentence_stream(spark, str(src)))), out, state)
    go()
    assert spark.read.parquet(out).count() == 1
    (src / "2.json").write_text("\n".join(map(line, ["Достаточно длинное предложение.", "Ещё одно длинное предложение."])))
    go()
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["Достаточно длинное предложение.", "Ещё одно длинное предложение."]
