"""Pieces of DuckDB SQL that the oracles share. Patterns stand in RE2 syntax, as DuckDB takes them."""

from __future__ import annotations

from corpusloom import regexes as R

NL = "chr(10)"


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def n_matches(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def sub(text: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {by}, 'g')"


def trim(text: str) -> str:
    return sub(text, r"^\s+|\s+$")


def share(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0.0 END)"


def sentences(table: str = "documents", book: str = "doc_id", others: str = "source, lang") -> str:
    """CTEs ending in s(book_id, others..., position, text)."""
    marked = f"regexp_replace(text, {q(R.SENTENCE_END)}, '\\1' || {NL}, 'g')"
    lines = f"list_filter(list_transform(string_split({marked}, {NL}), lambda x: {trim('x')}), lambda x: x <> '')"
    return f"""d0 AS (SELECT {book} AS book_id, {others}, {lines} AS l FROM {table}),
s AS (SELECT book_id, {others}, i - 1 AS position, l[i] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d0))"""


def digit_ratio(t: str = "text", size: str = "length") -> str:
    return share(n_matches(t, "[0-9]"), f"{size}({t})")


def punct_ratio(t: str = "text", size: str = "length") -> str:
    return share(n_matches(t, r"\p{P}"), f"{size}({t})")


def upper_ratio(t: str = "text") -> str:
    return share(n_matches(t, r"\p{Lu}"), n_matches(t, r"\p{L}"))


def garbage(t: str = "text") -> str:
    return "(" + " OR ".join(has(t, p) for p in R.GARBAGE.values()) + ")"


def reason(script: str = "latin", t: str = "text") -> str:
    """The first failing rule, NULL for none."""
    return f"""CASE WHEN length({t}) < 20 THEN 'min_length' WHEN length({t}) > 2000 THEN 'max_length'
WHEN NOT {has(t, R.SCRIPTS[script])} THEN 'language' WHEN {has(t, R.LIST_MARKER)} THEN 'list_marker' WHEN {garbage(t)} THEN 'garbage'
WHEN {digit_ratio(t)} > 0.3 THEN 'digit_ratio' WHEN {punct_ratio(t)} > 0.5 THEN 'punct_ratio' WHEN {upper_ratio(t)} > 0.8 THEN 'uppercase_ratio' END"""


def language(t: str = "text") -> str:
    ru, en = has(t, R.CYRILLIC), has(t, R.LATIN)
    return f"CASE WHEN {ru} AND {en} THEN 'mixed' WHEN {ru} THEN 'russian' WHEN {en} THEN 'english' ELSE 'other' END"


def flags(t: str = "text", size: str = "strlen") -> dict[str, str]:
    d, p, u = digit_ratio(t, size), punct_ratio(t, size), upper_ratio(t)
    own = {
        "short_20": f"{size}({t}) < 20",
        "short_50": f"{size}({t}) < 50",
        "long_1000": f"{size}({t}) > 1000",
        "long_2000": f"{size}({t}) > 2000",
        "digit_10": f"{d} > 0.1",
        "digit_30": f"{d} > 0.3",
        "digit_50": f"{d} > 0.5",
        "punct_30": f"{p} > 0.3",
        "punct_50": f"{p} > 0.5",
        "upper_50": f"{u} > 0.5",
        "upper_80": f"{u} > 0.8",
        "list_marker": has(t, R.LIST_MARKER),
    }
    return own | {f"has_{k}": has(t, v) for k, v in R.GARBAGE.items()}


def rolling(t: str) -> str:
    """(31 h + code point) mod 100 over the characters of a short text."""
    chars = f"list_transform(string_split({t}, ''), lambda c: unicode(c)::BIGINT)"
    return f"list_reduce(list_concat([0::BIGINT], {chars}), lambda h, c: (h * 31 + c) % 100)"


def ticket(*keys: str, seed: int = 42) -> str:
    return f"md5(concat_ws('|', {', '.join(f'({k})::VARCHAR' for k in keys)}, '{seed}'))"


def below(digest: str, p: float) -> str:
    return f"left({digest}, 8) < '{round(p * (1 << 32)):08x}'" if p < 1 else "true"


def hex_number(digest: str, first: int, digits: int) -> str:
    """The number of some hex digits."""
    terms = [f"(strpos('0123456789abcdef', substr({digest}, {first + i}, 1)) - 1) * {16 ** (digits - 1 - i)}" for i in range(digits)]
    return "(" + " + ".join(terms) + ")"


def percentiles(cte: str, v: str, percents: tuple, out: str = "value") -> str:
    """SELECT p, value by the index rule floor(n p / 100)."""
    ps = ", ".join(f"{float(p)}" for p in percents)
    return f"""SELECT p::DOUBLE AS p, v[least(floor(len(v) * p / 100)::BIGINT, len(v) - 1) + 1]::BIGINT AS {out}
FROM (SELECT list_sort(list({v})) AS v FROM {cte}), (SELECT unnest([{ps}]::DOUBLE[]) AS p)"""


def words(t: str = "text") -> str:
    return f"regexp_extract_all(lower({t}), {q(R.WORD)})"


def fields(t: str = "text") -> str:
    return f"list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def cosine(a: str, b: str) -> str:
    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"
