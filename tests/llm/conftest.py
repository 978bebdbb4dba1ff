import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, size string, __row string, __k1 int, fp int, target double, key string, pos int"


def frame(spark, rows):
    """(doc_id, text, source) rows as documents with extra columns whose names clash with internal ones."""
    full = [(d, t, None if i % 2 else "en", s, None if t is None else len(t), "a", None, "b", 1, 2, 0.5, None, i) for i, (d, t, s) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon", "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon", "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon", "a"),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon", None),
    (3, None, "b"),
    (4, "", None),
    (5, " \n\t ", "b"),
    (6, LONG, "c"),
    (7, LONG + " end", "c"),
    (None, None, None),
    (8, "Éa ünï ßtraße 漢字 🙂 a@b.co 1.2.3.4 +49 30 1234567; 4111 1111 1111 1111", "b"),
]


@pytest.fixture()
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture()
def empty(spark):
    return frame(spark, ODD).limit(0)
