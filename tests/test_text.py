"""Hand-checkable cases of the scalar functions and rules, with Cyrillic text."""

import pytest
from pyspark.sql import functions as F

from corpusloom import regexes as R
from corpusloom.functions import text as X
from corpusloom.operators.quality import reject_reason


def values(spark, rows, *cols):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i")
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*[c(F.col("t")) for c in cols]).collect()]


def test_re2_word_boundaries_and_spaces(spark):
    rows = ["УДК 1.2", "xУДК 1.2", "УДК 1.2x", " ISBN 1", "aISBN 1", "a\x0bb", "a\tb"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    has = lambda p: [r[0] for r in df.select(F.col("t").rlike(R.java(p))).collect()]
    assert has(r"\bУДК\s*\d") == [False, True, False, False, False, False, False]
    assert has(r"\bISBN") == [False, False, False, True, False, False, False]
    assert has(r"a\sb") == [False] * 6 + [True]


def test_end_of_text_is_not_end_of_line(spark):
    assert values(spark, ["a1\n", "a1"], lambda t: t.rlike(R.java(r"\d$"))) == [False, True]


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("а" * 19, "min_length"),
        ("а" * 20, None),
        ("а" * 2001, "max_length"),
        ("1. Введение в предмет курса", "list_marker"),
        ("• Первый пункт списка здесь", None),
        ("1. abc", "min_length"),
        ("УДК 1.2 и ещё много слов здесь", None),
        ("xУДК 1.2 и ещё много слов здесь", "garbage"),
        ("a" * 25, "language"),
        ("a" * 25 + "ж", None),
        ("-" * 11 + "жжжжжжжжж", "punct_ratio"),
        ("Ж" * 20, "uppercase_ratio"),
        ("Ж" * 16 + "жжжж", None),
        ("1234567 слово слово слово", None),
        ("12345678 слово слово", "digit_ratio"),
        ("Пишите на mail@example.com сегодня", "garbage"),
        ("Смотри https://example.com сегодня", "garbage"),
    ],
)
def test_quality_rules(spark, text, reason):
    assert values(spark, [text], reject_reason) == [reason]


def test_lengths_in_bytes_and_characters(spark):
    assert values(spark, ["аб"], lambda t: X.size(t, "bytes"), lambda t: X.size(t)) == [(4, 2)]


def test_hyphens_and_characters(spark):
    assert values(spark, ["внима-\n тельно"], X.join_hyphenated) == ["внимательно"]
    assert values(spark, ["«Да» — é №5"], X.filter_characters) == ["Да —  5"]
    assert values(spark, ["abc漢字ไทย д 𠀀"], X.strip_cjk_thai, X.has_cjk_thai) == [("abc д ", True)]


def test_clean(spark):
    dirty = "Глава\x07 первая\n12.\nISBN 5-1\nСлово12 и\n1234567890, 1234567890; 12\n==========\n▲текст ,  конец"
    (out,) = values(spark, [dirty], X.clean)
    assert "ISBN" not in out and "▲" not in out and "1234567890" not in out and "текст, конец" in out and "Слово" in out
    assert values(spark, ["УДК 12\nтекст\n12345\nслово7 да"], X.clean_light) == ["\nтекст\nсловода"]


def test_normalize(spark):
    assert values(spark, ["﻿ a \r\n b\r c "], X.normalize) == ["a\nb\nc"]


def test_filename_metadata(spark):
    rows = ["история_Иванов — Книга.txt.gz", "book.txt", "Иванов — Книга, 1999.txt", "а_б_в — г — д.txt"]
    got = values(spark, rows, X.filename_metadata)
    assert [tuple(r) for r in got] == [("история", "Иванов", "Книга"), ("", "Unknown", "book"), ("", "Иванов", "Книга, 1999"), ("а", "б_в", "г — д")]
    assert values(spark, rows[2:3], lambda t: X.filename_metadata(t, strip_year=True)["title"]) == ["Книга"]


def test_rolling_hash_and_words(spark):
    assert values(spark, ["abc", ""], X.rolling_hash) == [54, 0]
    assert values(spark, ["Как-то Раз x1y"], X.words) == [["как-то", "раз", "x", "y"]]
    assert values(spark, ["Раз. Два! Три?\nЧетыре 1.5 ."], X.segment) == [["Раз.", "Два!", "Три?", "Четыре 1.5 ."]]


def test_decoding(spark):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows = [("Привет".encode(), None), ("Привет".encode("cp1251"), None), ("Привет".encode("koi8-r"), "koi8-r"), ("é".encode("latin1"), "latin1")]
    df = spark.createDataFrame(rows, "c binary, n string")
    assert [r[0] for r in df.select(X.to_utf8(F.col("c"), F.col("n"))).collect()] == ["Привет", "Привет", "Привет", "é"]
