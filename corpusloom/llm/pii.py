"""PII by patterns and information-theoretic sanitisation.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers. The corpus then tells which terms
reveal them. With N distinct texts, c(e) of them with an entity e, c(t) with a term t and c(e, t) with both, wherever
they stand, disclosure is PMI(e; t) / IC(e) = log2(N c(e, t) / (c(e) c(t))) / log2(N / c(e)): 1 means that the term gives
the entity away, 0 that it tells nothing. All counts are over all texts, those without entities too. Terms seen with the
entity in ``SUPPORT`` distinct texts or more are generalised from ``GENERALISE`` on and removed from ``REMOVE`` on,
everywhere in the texts that hold that entity. Copying makes no evidence: exact copies of a text are one text, and the
``SUPPORT`` texts must differ in the words around the entity, two on either side, so that footers and near copies don't
give their ordinary words away. A text without any entity is left as it is.

A person's address seldom stands in several texts. So what is protected are, besides single entities, the kinds: that a
text holds an e-mail address, or any personal data. For a kind, p(e | t) is smoothed towards p(e), as if the term stood
in ``SMOOTH`` more texts like the others, for among millions of terms some keep to few texts of one kind by chance.
A term is generalised to the kind that it discloses most: [EMAIL_TERM], or [PERSONAL_TERM] for personal data of any kind.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_map, bits_for, boxed, column, keep, key_filter, may_hold, small_batches, small_side, text_keys, unboxed

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The kinds that terms may disclose; the last one stands for any of the others.
PROTECTED = (*KINDS, "personal")
SUPPORT = 3
GENERALISE, REMOVE = 0.7, 0.9
SMOOTH = 20
#: Counts of terms that a task holds before it hands them on.
HELD = 1 << 17
_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W\d_]{3,}")

Span = tuple[int, int, int]  # start, rank of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All matches that hold, by start and kind; of each kind the leftmost ones that don't overlap, then those that fail are dropped."""
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in _TAIL.finditer(text):  # the local part is the run of its characters before the @
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                last = m.end()
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def spans_text(spans: list[tuple[int, str, int]]) -> str:
    """kind:start:end, comma-joined, of (start, kind, end) in order."""
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def entity(text: str, span: Span) -> str:
    """What a span protects: kind and value, spelling aside."""
    start, kind, end = span
    value = text[start:end]
    return f"{KINDS[kind]}:{_NOT_DIGIT.sub('', value) if kind > 1 else value.lower()}"


def around(text: str, span: Span) -> int:
    """A hash of the two words before and the two after a span."""
    words = [*text[: span[0]].rsplit(None, 2)[-2:], "", *text[span[2] :].split(None, 2)[:2]]
    return xxhash.xxh64_intdigest(" ".join(words).lower().encode("utf-8", "surrogatepass")) - (1 << 63)


def terms(text: str, spans: list[Span]) -> list[tuple[str, int, int]]:
    """(term, start, end) of every word of three letters or more that no span touches."""
    out, i, reach = [], 0, 0
    for m in _TERM.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            reach = max(reach, spans[i][2])
            i += 1
        if reach <= m.start():
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def distinct_terms(text: str) -> tuple[set[str], int]:
    """The terms of a text, and the kinds that it holds, a bit each."""
    spans = base_spans(text)
    if not spans:
        return {t.lower() for t in set(_TERM.findall(text))}, 0
    return {t for t, _, _ in terms(text, spans)}, kinds_of(k for _, k, _ in spans)


def kinds_of(ranks) -> int:
    return sum(1 << k for k in {*ranks, len(KINDS)})


BASE = "doc_id long, k1 long, k2 long, n_email long, n_ip long, n_card long, n_phone long, base string"


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, counts, base: all base spans as text) for every row of ``docs`` (doc_id, text); no shuffle."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [base_spans(t or "") for t in column(batch, "text").to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in f) for f in found], pa.int64()) for k in range(4)]
            base = pa.array([spans_text([(a, KINDS[k], b) for a, k, b in f]) for f in found])
            return pa.RecordBatch.from_arrays([*[column(batch, n) for n in ("doc_id", "k1", "k2")], *counts, base], [x.split()[0] for x in BASE.split(", ")])

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_keys()), make, BASE)


def text_counts(docs: DataFrame) -> DataFrame:
    """(k1, k2, copies) of every distinct text; kept."""
    return keep(docs.select(*text_keys()).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")), "text-copies")


def term_counts(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, ct, and a count for each of ``PROTECTED``): in how many distinct texts of ``docs`` each term stands, and in how
    many that hold a kind. ``counts``: ``text_counts``.

    Every one of a text's m copies counts as 1 / m, and the sum is rounded: so texts need not be shuffled to be told apart.
    """
    names = ["term", "n", *PROTECTED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text, copies in zip(column(batch, "text").to_pylist(), column(batch, "copies").to_pylist(), strict=True):
                own, kinds = distinct_terms(text)
                held.update(own if copies == 1 and not kinds else ((t, copies, kinds) for t in own))
                if len(held) > HELD:
                    yield rows(held)
                    held.clear()
        if held:
            yield rows(held)

    def rows(held: Counter) -> pa.RecordBatch:
        keys = [k if isinstance(k, tuple) else (k, 1, 0) for k in held]
        n = [v / k[1] for k, v in zip(keys, held.values(), strict=True)]
        of_kinds = [pa.array([x if k[2] >> i & 1 else 0.0 for k, x in zip(keys, n, strict=True)]) for i in range(len(PROTECTED))]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array(n), *of_kinds], names)

    small_batches(docs.sparkSession)
    texts = docs.where("text is not null").select("text", *text_keys()).join(small_side(counts.where("copies > 1")), ["k1", "k2"], "left")
    found = texts.select("text", F.coalesce("copies", F.lit(1)).alias("copies")).mapInArrow(run, ", ".join(["term string", *[f"{n} double" for n in names[1:]]]))
    return found.groupBy("term").agg(F.round(F.sum("n")).cast("long").alias("ct"), *[F.round(F.sum(k)).cast("long").alias(k) for k in PROTECTED])


def entity_texts(docs: DataFrame) -> DataFrame:
    """(k1, k2, entity, ctx): the distinct entities of every distinct text, and what stands around each where it comes first."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            keys = zip(*(column(batch, n).to_pylist() for n in ("k1", "k2", "text")), strict=True)
            rows = [(k1, k2, e, around(text, s)) for k1, k2, text in keys for e, s in {entity(text, s): s for s in reversed(base_spans(text))}.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["k1", "k2", "entity", "ctx"]) if rows else None

        return step

    return arrow_map(docs.select("text", *text_keys()).where(F.col("text").rlike("[0-9@]")), make, "k1 long, k2 long, entity string, ctx long").distinct()


def text_terms(docs: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k1, k2, top, term, at: array of (start, end)) for every row of ``docs`` whose text is among ``texts`` (k1, k2, top: long).

    Terms that are surely not among ``wanted`` (term; kept) are left out.
    """
    bits = key_filter(wanted.select(F.xxhash64("term").alias("h")), "h", bits_for(wanted.count()))
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # of bounded size

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = []
            for k1, k2, top, text in zip(*(column(batch, n).to_pylist() for n in ("k1", "k2", "top", "text")), strict=True):
                at: dict[str, list[dict]] = {}
                for term, start, end in terms(text, base_spans(text)):
                    at.setdefault(term, []).append({"start": start, "end": end})
                hashes = np.array([xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 42) for term in at], np.uint64)
                at = {term: at[term] for term, may in zip(list(at), may_hold(shared.value, hashes).tolist(), strict=True) if may}
                rows += [(k1, k2, top, term, places) for term, places in at.items()]
            if not rows:
                return None
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["k1", "k2", "top", "term", "at"])

        return step

    own = docs.select("text", *text_keys()).where(F.col("text").rlike("[0-9@]")).join(small_side(texts), ["k1", "k2"])
    return arrow_map(own.select("k1", "k2", "top", "text"), make, "k1 long, k2 long, top long, term string, at array<struct<start int, end int>>")


def pairs(docs: DataFrame, entities: DataFrame, counted: DataFrame, n: int, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(k1, k2, entity, ctx, ce, term, ct, at) of the single entities and terms that share a distinct text; kept.

    ``entities``: ``entity_texts``; ``counted``: ``term_counts``; ``n``: N. Left out are only pairs that can't be
    disclosed: those with c(t) or the entity's contexts under ``support``, and, for c(e, t) is at most c(e), those with
    log2(N / c(t)) / IC(e) under ``generalise``.
    """
    often = entities.groupBy("entity", "ctx").agg(F.count(F.lit(1)).alias("c")).groupBy("entity").agg(F.sum("c").alias("ce"), F.count(F.lit(1)).alias("contexts"))
    often = keep(often.where((F.col("contexts") >= support) & (F.col("ce") < n)).drop("contexts"), "entities")
    known = keep(entities.join(small_side(often), "entity"), "known-entities")
    texts = keep(known.groupBy("k1", "k2").agg(F.max("ce").alias("top")), "known-texts")

    def can(ce: str) -> Column:
        return F.log2(n / F.col("ct")) >= generalise * F.log2(n / F.col(ce)) - 1e-9

    rare = keep(counted.join(F.broadcast(texts.agg(F.max("top").alias("top"))), can("top")).select("term", "ct"), "rare-terms")  # one row: the largest c(e)
    own = text_terms(docs, texts, rare).join(small_side(rare), "term").where(can("top")).drop("top").distinct()
    return keep(own.join(small_side(known), ["k1", "k2"]).where(can("ce")), "pairs")


def disclosures(pairs: DataFrame, n: int, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, disclosure) of the pairs at ``generalise`` or above. ``pairs``, ``n``: those of ``pairs``."""
    both = pairs.groupBy("entity", "term", "ctx").agg(F.count(F.lit(1)).alias("c"), F.first("ce").alias("ce"), F.first("ct").alias("ct"))
    both = both.groupBy("entity", "term").agg(F.sum("c").alias("c"), F.first("ce").alias("ce"), F.first("ct").alias("ct"), F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= support)
    value = F.log2(n * F.col("c") / (F.col("ce") * F.col("ct"))) / F.log2(n / F.col("ce"))
    return both.select("entity", "term", value.alias("disclosure")).where(F.col("disclosure") >= generalise)


def kind_disclosures(counted: DataFrame, holding: dict[str, int], n: int, support: int = SUPPORT, generalise: float = GENERALISE, smooth: float = SMOOTH) -> DataFrame:
    """(term, kind, bit, disclosure) at ``generalise`` or above. ``holding``: how many distinct texts hold each kind."""
    found = []
    for bit, kind in enumerate(PROTECTED):
        if 0 < holding.get(kind, 0) < n:
            p = holding[kind] / n
            value = F.log2((F.col(kind) + smooth * p) / (F.col("ct") + smooth) / p) / float(np.log2(1 / p))
            found.append(F.struct(F.lit(kind).alias("kind"), F.lit(1 << bit).cast("long").alias("bit"), F.when(F.col(kind) >= support, value).alias("disclosure")))
    if not found:
        return counted.limit(0).select("term", F.lit("").alias("kind"), F.lit(0).cast("long").alias("bit"), F.lit(0.0).alias("disclosure"))
    return counted.select("term", F.inline(F.array(*found))).where(F.col("disclosure") >= generalise)


def added_spans(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(k1, k2, added: array of (start, end, gone, kind)) for the texts where the method adds spans; kept."""
    counts = text_counts(docs)
    n = counts.count()
    entities = keep(entity_texts(docs), "entity-texts")
    counted = keep(term_counts(docs, counts).where(F.col("ct") >= support), "term-counts")
    own_kind = F.substring_index("entity", ":", 1)
    kinds = keep(entities.groupBy("k1", "k2").agg(F.bit_or(F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, kinds_of([i]))]), own_kind).cast("long")).alias("top")), "text-kinds")
    held = kinds.agg(*[F.count_if(F.col("top").bitwiseAND(F.lit(1 << i)) > 0).alias(k) for i, k in enumerate(PROTECTED)]).first().asDict()

    shared = pairs(docs, entities, counted, n, support, generalise)
    told = keep(disclosures(shared, n, support, generalise), "disclosures")
    hit = shared.join(small_side(told), ["entity", "term"]).select("k1", "k2", "term", "at", "disclosure", own_kind.alias("kind"))
    of_kinds = keep(kind_disclosures(counted, held, n, support, generalise), "kind-disclosures")
    some = text_terms(docs, kinds, of_kinds).join(small_side(of_kinds), "term").where(F.col("top").bitwiseAND(F.col("bit")) > 0)
    hit = hit.unionByName(some.select("k1", "k2", "term", "at", "disclosure", "kind"))
    most = F.max(F.struct("disclosure", "kind"))
    gone = hit.groupBy("k1", "k2", "term").agg(F.first("at").alias("at"), most.alias("m"))
    place = F.struct("p.start", "p.end", (F.col("m.disclosure") >= remove).alias("gone"), F.col("m.kind").alias("kind"))
    places = gone.select("k1", "k2", "m", F.explode("at").alias("p")).select("k1", "k2", place.alias("place"))
    return keep(places.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("place")).alias("added")), "added-spans")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` (text; other columns are kept) with personal data replaced in ``text``, and n_chars, where there is one, counted anew.

    Base spans become [EMAIL], [IP], [CARD] or [PHONE] (overlapping ones the first's), terms [EMAIL_TERM] and so on, or nothing. A null
    text stays null, a text without spans as it is. Equal rows stay equal.
    """
    k1, k2 = text_keys()
    added = added_spans(docs).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("added").alias("__added"))
    keyed = boxed(docs, "text").withColumns({"__k1": k1, "__k2": k2}).join(small_side(added), ["__k1", "__k2"], "left").select("text", "__row", "__added")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t if t is None else clean(t, a or []) for t, a in zip(column(batch, "text").to_pylist(), column(batch, "__added").to_pylist(), strict=True)]
            at = batch.schema.get_field_index("text")
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            return pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

        return step

    out = unboxed(arrow_map(keyed, make, f"text string, __row {keyed.schema['__row'].dataType.simpleString()}"), docs.columns, ("text",))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def clean(text: str, added: list[dict]) -> str:
    spans = [(s, e, f"[{KINDS[k].upper()}]") for s, k, e in base_spans(text)]
    spans += [(a["start"], a["end"], "" if a["gone"] else f"[{a['kind'].upper()}_{TERM.upper()}]") for a in added]
    out, at = [], 0
    for start, end, label in sorted(spans):
        if start >= at:
            out += [text[at:start], label]
        at = max(at, end)
    return "".join([*out, text[at:]])


def query(spark, sf_dir: str) -> DataFrame:
    """op3: base spans of every document and the spans that the corpus adds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = detect(docs).join(small_side(added_spans(docs)), ["k1", "k2"], "left")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            base = column(batch, "base").to_pylist()
            every, n = [], []
            for b, a in zip(base, column(batch, "added").to_pylist(), strict=True):
                spans = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in b.split(",") if x)]
                spans += [(x["start"], len(KINDS), x["end"]) for x in a or []]
                every.append(spans_text([(s, (*KINDS, TERM)[k], e) for s, k, e in sorted(spans)]))
                n.append(len(a or []))
            digest = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base])
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone"]
            return pa.RecordBatch.from_arrays([*[column(batch, c) for c in names], digest, pa.array(every), pa.array(n, pa.int64())], [*names, "base_sha256", "spans", "n_added"])

        return step

    return arrow_map(found, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
