"""Each operator against brute force on small tables, and on odd ones: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from tests.llm.conftest import LONG, ODD, frame

from corpusloom.llm import chat, common, editprint, lm, mixing, packing, pii, rules, simhash, substrings, toxicity
from corpusloom.llm.components import connected_components

LABELS = "doc_id long, quality int, toxic int, text string"


def docs_of(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


# --- shared


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 9), (9, 8), (7, 9), (-3, -9)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 100 for i in range(101, 161)} | {9: 7, 8: 7, -3: -9}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_key_filter_has_every_key(spark):
    keys = [xxhash.xxh64_intdigest(str(i)) - (1 << 63) for i in range(5000)]
    for bits in (20, common.FILTER_BITS):
        own = common.key_filter(spark.createDataFrame([(k,) for k in keys], "k long"), "k", bits)
        assert common.may_hold(own, np.array(keys, np.int64)).all()
        other = np.array([xxhash.xxh64_intdigest(f"no{i}") - (1 << 63) for i in range(5000)], np.int64)
        assert common.may_hold(own, other).mean() < 0.02


def test_sorted_runs_never_cut_a_short_run():
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(1).integers(0, 40, 3000))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 170])], ["k"]) for i in range(0, 3000, 170)]
    whole, parts = collections.Counter(), collections.Counter()
    for table, ok in common.sorted_runs(iter(batches), ["k"], 70):
        own = collections.Counter(table.column("k").to_pylist())
        if ok:
            assert not whole.keys() & own.keys()
            whole.update(own)
        else:
            assert len(own) == 1
            parts.update(own)
    assert whole + parts == collections.Counter(keys.tolist())
    assert not whole.keys() & parts.keys()


# --- 1


def brute_simhash(rows):
    prints = []
    for _, text, _ in rows:
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    own = list(range(len(rows)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                own[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            ids[root(i)].append(d)
    return [(d, f"{prints[i]:016x}", min(ids[root(i)], default=None)) for i, (d, _, _) in enumerate(rows)]


def out_simhash(df):
    return sorted(((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in df.collect()), key=str)


def test_simhash_odd(spark, odd, empty):
    rows = [r for r in ODD if r[1] is None or len(r[1]) < 1000]
    assert out_simhash(simhash.near_duplicate_classes(frame(spark, rows))) == sorted(brute_simhash(rows), key=str)
    assert simhash.near_duplicate_classes(empty).count() == 0 and simhash.deduplicate(empty).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["text"] and r["text"].startswith("alpha")) == [1]


def test_deduplicate_keeps_one_of_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    third = " ".join(f"u{i}" for i in range(60))
    rows = [(5, long)] * 3 + [(9, long), (None, long)] + [(None, other)] * 2 + [(7, third), (8, third)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(5, long), (None, other), (7, third)], key=str)


def test_simhash_on_documents(spark, tiny):
    df = docs_of(spark, tiny)
    rows = [(r["doc_id"], r["text"], None) for r in df.collect()]
    assert out_simhash(simhash.near_duplicate_classes(df)) == sorted(brute_simhash(rows), key=str)


@pytest.mark.parametrize("bucket", [4, 8192])
def test_covering_masks_lose_no_link(spark, bucket):
    rng = np.random.default_rng(2)
    centre = [int(x) for x in rng.integers(0, 1 << 63, 3)]
    prints = set()
    for c in centre:
        for _ in range(12):
            x = c
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            prints.add(x - (1 << 64) if x >> 63 else x)
    prints = sorted(prints)
    edges = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long"), bucket=bucket)
    own = {p: p for p in prints} | dict(connected_components(edges).collect())
    brute = {p: {p} for p in prints}
    for a in prints:
        for b in prints:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and brute[a] is not brute[b]:
                brute[a] |= brute[b]
                for x in brute[b]:
                    brute[x] = brute[a]
    assert own == {p: min(brute[p]) for p in prints}
    masks = simhash.masks()
    assert all(any(not m & (1 << a | 1 << b | 1 << c) for m in masks) for a in range(64) for b in range(a) for c in range(b))


# --- 2


def test_edit_fingerprints(spark, odd, empty):
    e = editprint.Embedder()

    def of(t):
        c = e.codes(t)
        return e.fingerprint(c, e.walk(c))

    base = "the quick brown fox jumps over the lazy dog and runs away from it " * 40
    edits = base[:300] + "X" + base[300:1200] + base[1205:]
    other = "completely different words stand here one after another without end " * 40
    assert editprint.likeness(of(base), of(base)) == 1.0 == editprint.likeness(of(""), of(""))
    assert editprint.likeness(of(base), of(edits)) > 0.75 > 0.4 > editprint.likeness(of(base), of(other))
    rows = editprint.against_next(odd).collect()
    assert len(rows) == len(ODD)
    order = sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = collections.Counter()
    for i, (d, t, _) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want[d, len(t), hashlib.sha256(edited.encode()).hexdigest(), of(t), of(edited)] += 1
        assert all(0 <= x <= 1 for x in (editprint.likeness(of(t), of(edited)),))
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in rows) == want
    assert editprint.against_next(empty).count() == 0


def test_edit_fingerprints_over_ranges(spark, tiny, monkeypatch):
    monkeypatch.setattr(editprint, "RANGE_BYTES", 50_000)
    df = docs_of(spark, tiny)
    texts = [r["text"] for r in df.orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in editprint.against_next(df).collect()}
    for i, d in enumerate(sorted(got)):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[(i + 1) % len(texts)][:half]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    long = [r for r in got.values() if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] for r in long]) > 0.5 > 0.2 > np.mean([r["near_next"] for r in long])


def test_edit_near_duplicates(spark, empty):
    base = [" ".join(f"w{(i * k) % 503}" for i in range(300)) for k in (7, 11, 13)]
    rows = [(i, b, "s") for i, b in enumerate(base)] + [(10 + i, b[:500] + "!" + b[500:], "s") for i, b in enumerate(base)]
    got = {r["doc_id"]: r["class_id"] for r in editprint.near_duplicate_classes(frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 10: 0, 11: 1, 12: 2}
    assert editprint.near_duplicate_classes(empty).count() == 0


def test_edit_bands_meet_across_levels_and_lengths():
    e = editprint.Embedder()
    rng = np.random.default_rng(7)

    def of(t):
        c = e.codes(t)
        return e.fingerprint(c, e.walk(c))

    across, front = [], []
    for size in (150, 300, 600, 1200):
        for _ in range(120):
            t = "".join(rng.choice(list("abcdefghijklmnop "), int(size * rng.uniform(0.7, 1.2))))
            at = int(rng.integers(0, len(t)))
            more = "".join(rng.choice(list("abcdefghijklmnop "), max(1, len(t) // 30)))
            for other in (t[:at] + more + t[at:], t + more):
                a, b = of(t), of(other)
                if editprint.likeness(a, b) >= editprint.SIMILARITY and a[:2] != b[:2]:
                    across.append(not set(editprint.band_keys(a)).isdisjoint(editprint.band_keys(b)))
        for _ in range(60):  # the first fifth of the samples is another
            level, x = editprint.samples(of("".join(rng.choice(list("abcdefghijklmnop "), size))))
            y = x.copy()
            y[: len(x) // 5] = (y[: len(x) // 5] + 1) % 15 + 1
            a, b = (f"{level:02x}" + v.tobytes().hex()[1::2] for v in (x, y))
            front.append(not set(editprint.band_keys(a)).isdisjoint(editprint.band_keys(b)))
    assert len(across) >= 15 and np.mean(across) >= 0.95, (len(across), np.mean(across))
    assert np.mean(front) >= 0.95, np.mean(front)


def test_edit_buckets_give_the_components_of_all_links():
    rng = np.random.default_rng(8)
    start = rng.integers(1, 16, 200).astype(np.uint8)
    chain = [start]
    for i in range(9):  # neighbours are 0.85 alike, others less than 0.8
        chain.append(chain[-1].copy())
        chain[-1][i * 20 : i * 20 + 30] = rng.integers(1, 16, 30)
    prints = ["03" + x.tobytes().hex()[1::2] for x in [*chain, *rng.integers(1, 16, (5, 200)).astype(np.uint8)]]
    near = {i: {j for j in range(len(prints)) if editprint.likeness(prints[i], prints[j]) >= 0.8} for i in range(len(prints))}
    assert not near[0] >= set(range(10))
    for _ in range(20):
        order, forest, links = rng.permutation(len(prints)), [], []
        for i in order:
            links += [(int(i), j) for j in editprint._join(forest, int(i), prints[i], 0.8)]
        assert all(b in near[a] for a, b in links) and len(links) == len(prints) - len(forest)
        assert sorted(sorted(n for n, _ in g) for g in forest) == [list(range(10)), *[[i] for i in range(10, 15)]]


# --- 3


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        doubled = [x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_pii_patterns(spark, tiny):
    odd = ["a@b.c@d.e", "x@y", "..@-.-", "a@b..c", "a@b.c.", "1.2.3.4.5", "256.1.1.1 01.002.3.4", "4111 1111-1111 1111", "4111  1111", "+1 (555) 123-4567.", "+12345", "++1 234 567 8901 ", "a@b.co1.2.3.4", "é@b.co", "a%b+c@x.y-z", ""]
    rng = np.random.default_rng(3)
    odd += ["".join(rng.choice(list("ab1234567890.@+- ()%"), 60)) for _ in range(3000)]
    texts = [r["text"] for r in docs_of(spark, tiny).collect()]
    for t in odd + texts:
        assert pii.base_spans(t) == brute_pii(t), t
    assert any(pii.base_spans(t) for t in texts)


def test_pii_terms_and_odd_rows(spark, odd, empty):
    texts = [f"filler{i} zwölf words before Moriarty writes{i} from evil@example.com often about item{i}" for i in range(6)]
    texts += [f"someone{i} writes from other{i}@example.com often" for i in range(30)] + ["Moriarty alone is left in peace"]
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all("Moriarty" not in clean[i] and "evil" not in clean[i] and "[EMAIL]" in clean[i] and "writes" in clean[i] for i in range(6))
    assert clean[36] == texts[36] and clean[10] == "someone4 writes from [EMAIL] often"
    out = pii.sanitise(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[3]["text"] is None and got[4]["text"] == "" and got[6]["text"] == LONG
    assert got[8]["text"].endswith("[EMAIL] [IP] [PHONE]; [CARD]")
    assert got[8]["n_chars"] == len(got[8]["text"])
    assert pii.sanitise(empty).count() == 0 and pii.detect(empty).count() == 0


def brute_added(texts, support=3, generalise=0.7, remove=0.9):
    """{text: [(start, end, gone, kind)]} by the definition, over all distinct texts."""
    own, kinds = {}, {}
    for t in set(texts):
        spans = pii.base_spans(t)
        words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(a < m.end() and m.start() < b for a, _, b in spans)]
        own[t] = ({pii.entity(t, s): (t[: s[0]].lower().split()[-2:], t[s[2] :].lower().split()[:2]) for s in reversed(spans)}, words)
        kinds[t] = {pii.KINDS[k] for _, k, _ in spans} | ({"personal"} if spans else set())
    c = collections.Counter(w for _, words in own.values() for w in {x[0] for x in words})
    ce = collections.Counter(e for es, _ in own.values() for e in es)
    both = collections.Counter((e, w) for es, words in own.values() for e in es for w in {x[0] for x in words})
    contexts = collections.defaultdict(set)
    for es, words in own.values():
        for e, around in es.items():
            for w in {x[0] for x in words}:
                contexts[e, w].add(str(around))
    told = {p: math.log2(len(own) * k / (ce[p[0]] * c[p[1]])) / math.log2(len(own) / ce[p[0]]) for p, k in both.items() if len(contexts[p]) >= support and ce[p[0]] < len(own)}
    share = {k: n / len(own) for k, n in collections.Counter(k for ks in kinds.values() for k in ks).items()}
    with_kind = collections.Counter((k, w) for t, (_, words) in own.items() for k in kinds[t] for w in {x[0] for x in words})
    for (k, w), n in with_kind.items():
        if n >= support and share[k] < 1:
            told[k, w] = math.log2((n + pii.SMOOTH * share[k]) / (c[w] + pii.SMOOTH) / share[k]) / math.log2(1 / share[k])
    out = {}
    for t, (es, words) in own.items():
        best = [(a, b, max([(told.get((e, w), 0), e.split(":")[0]) for e in {*es, *kinds[t]}], default=(0, ""))) for w, a, b in words]
        if hit := [(a, b, d >= remove, k) for a, b, (d, k) in best if d >= generalise - 1e-12]:
            out[t] = hit
    return out


def test_pii_kinds_are_disclosed_by_their_labels(spark):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("aeiourstln"), 6)) for _ in range(400)]
    texts = []
    for i in range(600):
        w = list(rng.choice(words, 30))
        if i < 60:
            w[3:3] = ["reachme" if i % 2 else "callme", f"x{i}@mail{i}.example.com" if i % 2 else f"+49 30 {1000000 + i}"]
        elif i < 62:
            w[3:3] = ["reachme"]
        texts.append(" ".join(w))
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[1] == re.sub(r"reachme \S+", "[EMAIL_TERM] [EMAIL]", texts[1]) and clean[60] == texts[60]
    assert clean[0] == re.sub(r"callme \S+ \S+ \S+", "[PHONE_TERM] [PHONE]", texts[0])
    keys = {tuple(r)[1:]: r["text"] for r in df.select("text", *common.text_keys()).collect()}
    assert {keys[r["k1"], r["k2"]]: [tuple(a) for a in r["added"]] for r in pii.added_spans(df).collect()} == brute_added(texts)


def test_pii_disclosure_is_over_the_whole_corpus(spark, tiny, monkeypatch):
    far = " ".join(f"w{i}" for i in range(300))
    texts = [f"Call office{i} footer at{i} boss@corp.com {far} signed Moriarty item{i}" for i in range(4)]
    texts += [f"footer item{i} office of nobody, page {i}" for i in range(80)]  # ordinary words, without any entity
    texts += texts[:3] * 5 + ["Moriarty is here, call"]
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(900, None, "s")])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "office0 footer at0 [EMAIL]" in clean[0] and "Moriarty" not in clean[0] and "item0" in clean[0]
    assert clean[4] == texts[4] and clean[len(texts) - 1] == texts[-1] and clean[900] is None
    footers = [f"{far} page{i} of it. Reach Holmes at home via mail sherlock@corp.com or call Watson instead" for i in range(9)] + texts[4:84]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, [(i, t, "s") for i, t in enumerate(footers)])).collect()}
    assert clean[0] == footers[0].replace("sherlock@corp.com", "[EMAIL]")

    monkeypatch.setattr(pii, "HELD", 50)
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "lmnr"]
    mails = [f"{x}@mail.example" for x in "abcdef"] + ["+49 30 1234567", "10.0.0.1"]
    some = []
    for _ in range(300):
        k = int(rng.integers(0, 8)) if rng.random() < 0.5 else None
        w = [words[j] for j in np.minimum(rng.geometric(0.05, 12), len(words) - 1)] + ([mails[k], f"zz{'abcdefgh'[k]}", mails[(k + 3) % 8]] if k is not None else [])
        some.append(" ".join(rng.permutation(w)))
    some += [some[int(i)] for i in rng.integers(0, 300, 200)] + [""]
    for own in (texts, some, [r["text"] for r in docs_of(spark, tiny).collect()]):
        df = frame(spark, [(i, t, "s") for i, t in enumerate(own)])
        keys = {tuple(r)[1:]: r["text"] for r in df.select("text", *common.text_keys()).distinct().collect()}
        got = {keys[r["k1"], r["k2"]]: [tuple(a) for a in r["added"]] for r in pii.added_spans(df).collect()}
        want = brute_added(own)
        assert got == want and (want or own not in (texts, some))


# --- 4


SMALL = {"vocab": 200, "head": 50, "suffixes": 20, "classes": 6}


def brute_lm(model, train, texts):
    """log10 p(text) of each text by the definition, from the training texts and the classes of the items."""
    cls = lambda w: int(model.classes[model.items.words.get(w, model.items.suffixes.get(lm.suffix(w), model.items.rest))])
    tokens = [lm.tokens_of(t) for t in train]
    n = collections.Counter(w for ws in tokens for w in ws)
    pairs, into, before = collections.Counter(), collections.Counter(), collections.Counter()
    for ws in tokens:
        path = [0, *map(cls, ws), 0]
        for a, b in zip(path, path[1:]):
            pairs[a, b] += 1
            into[b] += 1
            before[a] += 1
    types = collections.Counter(map(cls, n))
    n1, n2 = sum(c == 1 for c in n.values()), sum(c == 2 for c in n.values())
    d, total, k = n1 / (n1 + 2 * n2), sum(into.values()), len(model.moves)
    to = lambda a, c: (pairs[a, c] + lm.BETA * (into[c] + (c == 0)) / (total + 2)) / (before[a] + lm.BETA)
    far, near = collections.Counter(), collections.Counter()

    def contexts(w):
        x = [256, 256, 256, *w]
        for i, symbol in enumerate([*w, 256]):
            yield x[i + 2], ((x[i + 1] * 257 + x[i]) * 0x9E3779B1 >> 24) % lm.FAN, symbol

    for w in n:
        for last, fan, symbol in contexts(w):
            for key in ((last, fan, symbol), (last, fan)):
                far[key] += 1
            for key in ((last, symbol), (last,)):
                near[key] += 1
    none = {*range(9, 14), 32, *range(65, 91)}

    def spelt(w):
        p = 1.0
        for last, fan, symbol in contexts(w):
            floor = 0 if symbol in none or last == 256 == symbol else 1 / (257 - len(none) - (last == 256))
            one = (near[last, symbol] + lm.SPELL_BETA * floor) / (near[last,] + lm.SPELL_BETA)
            p *= (far[last, fan, symbol] + lm.SPELL_BETA * one) / (far[last, fan] + lm.SPELL_BETA)
        return p

    seen = sum(map(spelt, n))
    scores = []
    for text in texts:
        at, out = 0, 0.0
        for w in lm.tokens_of(text):
            if n[w]:
                out += math.log10(to(at, cls(w)) * (n[w] - d) / into[cls(w)])
            else:
                new = lm.BETA / (total + 2) / (before[at] + lm.BETA) + sum(to(at, c) * d * types[c] / into[c] for c in range(1, k) if into[c])
                out += math.log10(new * spelt(w) / (1 - seen))
            at = cls(w)
        scores.append(out + math.log10(to(at, 0)))
    return scores


def test_lm_scores_by_brute_force(spark, tiny):
    df = docs_of(spark, tiny)
    model, counts = lm.fit(df, **SMALL)
    got = {r["doc_id"]: r for r in lm.score(df, model, counts).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in got}
    c, ends = collections.Counter(), 0
    for r in df.collect():
        if not held[r["doc_id"]]:
            c.update(lm.tokens_of(r["text"]))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    for r in df.collect():
        w, g = lm.tokens_of(r["text"]), got[r["doc_id"]]
        want = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[r["doc_id"]], len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert g["base_score"] == pytest.approx(want, rel=1e-9)
    rows = sorted(df.collect(), key=lambda r: len(r["text"] or ""))
    train = [r["text"] for r in rows if not held[r["doc_id"]]]
    own = [r for r in rows if held[r["doc_id"]]][:12] + rows[:3] + rows[60:63]
    assert [got[r["doc_id"]]["score"] for r in own] == pytest.approx(brute_lm(model, train, [r["text"] for r in own]), rel=1e-5)
    per = {r["held_out"]: r["perplexity"] for r in lm.perplexity(lm.score(df, model, counts)).collect()}
    assert per[True] >= per[False]


def test_lm_probabilities_add_up(spark, tiny):
    model, counts = lm.fit(docs_of(spark, tiny), **(SMALL | {"vocab": 100}))
    find, words = model.items.finder(), [(bytes(r["word"]), r["n"]) for r in counts.collect()]
    left = 1 - (10 ** lm.spelt_log10(model.spelling, [w for w, _ in words])).sum()  # of the spelling, for unseen words
    for before in range(len(model.moves)):
        total = 10 ** model.moves[before, 0]  # the end
        total += sum(10 ** (model.moves[before, model.classes[find(w)]] + math.log10(n - model.discount)) for w, n in words)
        total += 10 ** model.unseen[before] * left
        assert total == pytest.approx(1, abs=1e-5)
    p = 10.0 ** model.spelling.astype(float)  # every symbol of every context: words of all lengths add up to one
    assert np.allclose(p.sum(1), 1, atol=1e-4) and (p[-lm.FAN :, -1] == 0).all() and (p[:, ord("A")] == 0).all()


def test_lm_prefers_text_to_gibberish(spark, tiny):
    model, counts = lm.fit(docs_of(spark, tiny), **SMALL)
    rng = np.random.default_rng(9)
    real = [r["text"] for r in docs_of(spark, tiny).collect() if len(r["text"] or "") > 200][:30]
    noise = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), len(w))) for w in t.split()) for t in real]
    got = lm.score(frame(spark, [(i, t, "s") for i, t in enumerate(real + noise)]), model, counts).collect()
    per = {r["doc_id"]: r["score"] / r["n_tokens"] for r in got}
    assert all(per[i] > per[i + len(real)] + 1 for i in range(len(real)))


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(0)
    m = rng.poisson(rng.gamma(0.3, 4, (30, 30)))
    own = lm.exchange(m, 4)

    def worth(own):
        eye = np.eye(5)[own]
        return lm.likelihood(eye.T @ m @ eye)

    assert max(worth(np.where(np.arange(30) == i, c, own)) for i in range(1, 30) for c in range(1, 5)) <= worth(own) + 1e-6


def test_clusters_of_the_vocabulary_fit_better(spark, tiny):
    texts = docs_of(spark, tiny).select("text")
    counts = sorted(((bytes(r["word"]), r["n"]) for r in lm.word_counts(texts).collect()), key=lambda x: (-x[1], x[0]))[:300]
    items = lm.Items({w: 1 + i for i, (w, _) in enumerate(counts)}, {b"on.": 301, b"ing": 302})
    place, table = items.head(40), lm.item_table(texts, items)
    start = lm.exchange(lm.item_bigrams(table, items, place), 6)[place]
    before, around = lm.neighbours(table, items, start, 40, 7)
    own, pairs = lm.cluster(table, items, 40, 6)
    assert lm.likelihood(pairs) > lm.likelihood(before) and (own[:41] == start[:41]).all()
    assert around.sum() == 2 * sum(n for _, n in counts[40:]) and pairs.sum() == before.sum()
    assert (lm.neighbours(table, items, own, 40, 7)[0] == pairs).all()


def test_exchange_finds_two_languages():
    rng = np.random.default_rng(4)
    m = np.zeros((41, 41))
    for a in range(1, 41):
        for b in range(1, 41):
            m[a, b] = rng.poisson(20 if (a <= 20) == (b <= 20) else 0.1)
    own = lm.exchange(m, 2)
    assert own[0] == 0 and len(set(own[1:21])) == 1 == len(set(own[21:])) and own[1] != own[40]


def test_lm_odd(spark, odd, empty):
    got = lm.score(odd, *lm.fit(odd)).collect()
    assert len(got) == len(ODD) and all(np.isfinite([r["score"], r["base_score"]]).all() for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert lm.score(empty, *lm.fit(empty)).count() == 0
    alone = frame(spark, [(d, "a b", "s") for d in range(40) if zlib.crc32(str(d).encode()) % 7 == 2])
    assert all(r["base_score"] == 0 for r in lm.score(alone, *lm.fit(alone)).collect())


# --- 5


def test_packing(spark, tiny, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    t.encode_special_tokens = True
    for df, tokens in ((docs_of(spark, tiny), 1 << 14), (odd, 1 << 20), (odd, 1)):
        rows = packing.pack(df, pool_tokens=tokens, with_ids=True).collect()
        want = collections.Counter((r["doc_id"], tuple(t.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in df.collect())
        docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            docs[r["doc_id"], r["doc_tokens"]].append(r)
            seqs[r["sequence_id"]].append(r)
            assert len(r["input_ids"]) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(r["input_ids"], "<u4").tobytes())
        for own in seqs.values():
            at = 0
            for r in sorted(own, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 2048 and own[0]["padded_tokens"] == (at if at & at - 1 == 0 else 2048)
        got = collections.Counter()
        for (doc, size), own in docs.items():
            starts = collections.defaultdict(list)
            for r in own:
                starts[r["start"]].append(r)
            copies = len(starts[0])
            for _ in range(copies):
                ids, at = [], 0
                while at < size:
                    r = starts[at].pop()
                    ids += r["input_ids"]
                    at += r["length"]
                assert at == size
                got[doc, tuple(ids)] += 1
        if df is not odd or tokens > 1:
            assert got == want
        if tokens == 1 << 14:
            assert sum(s[0]["padded_tokens"] for s in seqs.values()) < 1.2 * sum(r["length"] for r in rows)
    assert packing.pack(empty).count() == 0


def test_packing_takes_added_tokens_from_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"x  {end}  y\n", f"<{end}>", "<|endoftext|", f"don't{end}'t", f"Éa{end}🙂 <|endof text|>", " a "]
    rows = packing.pack(frame(spark, [(i, x, "s") for i, x in enumerate(texts)]), with_ids=True).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) == len(got)
    for i, x in enumerate(texts):
        want = [*t.encode(x, add_special_tokens=False).ids, 1]
        assert got[i]["input_ids"] == want and got[i]["doc_tokens"] == len(want), x
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
    assert got[0]["input_ids"] == [64, 220, 50256, 275, 1]


def test_step_groups_are_equally_large(spark, tiny):
    rows = packing.pack(docs_of(spark, tiny), step_tokens=8192).where("offset = 0").groupBy("step_group").sum("padded_tokens").collect()
    sizes = [r[1] for r in rows]
    assert max(sizes) <= 8192 and sizes.count(8192) >= len(sizes) - 4 * 5


# --- 6


def brute_chat(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark, tiny):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<|end|><!|turn|> <|<!!|"), (1, 2, "assistant", "  \n\n é🙂漢 "), (1, 2, "assistant", "  \n\n é🙂漢 "), (2, None, None, None), (2, 0, "assistant", ""), (None, 3, "as<|sistant", "<"), (None, 4, "assistant", "|x"), (3, 0, "assistant", LONG)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, block int")
    for source in (df, spark.read.parquet(f"{tiny}/conversations.parquet")):
        want = collections.defaultdict(list)
        for r in sorted(source.collect(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "")):
            want[r["conv_id"]].append((r["role"], r["text"]))
        got = {r["conv_id"]: r for r in chat.digests(source).collect()}
        assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == {k: brute_chat(v) for k, v in want.items()}
        blocks = chat.format_conversations(source).collect()
        assert all(chat.parse(r["rendered"]) == [(a or "", b or "") for a, b in want[r["conv_id"]]] for r in blocks if got[r["conv_id"]]["formatted_chars"] < chat.BLOCK)
    assert chat.digests(df.limit(0)).count() == 0 and chat.format_conversations(df.limit(0)).count() == 0


def test_chat_blocks_equal_one_encoding(spark, monkeypatch):
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"turn {i} <| text") for i in range(50)], "conv_id long, turn long, role string, text string")
    whole = chat.format_conversations(df).collect()
    monkeypatch.setattr(chat, "BLOCK", 100)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([r.asDict() for r in df.orderBy("turn").collect()])
    parts = list(chat.blocks(iter([batch]), None))
    assert len(whole) == 1 < len(parts)
    assert [i for p in parts for i in p.ids] == whole[0]["input_ids"] and [m for p in parts for m in p.mask.tolist()] == whole[0]["loss_mask"]


# --- 7


def brute_targets(sizes):
    order = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        total = sum(weight[k] for k in free)
        over = [k for k in free if left * weight[k] / total > 2 * sizes[k]]
        if not over:
            out |= {k: left * weight[k] / total for k in free}
            break
        for k in over:
            out[k] = 2.0 * sizes[k]
        left -= sum(out[k] for k in over)
        free -= set(over)
    return out


def test_mixing(spark, tiny, odd, empty):
    many = frame(spark, [(i, "w " * (i % 37), f"s{i % 5}" if i % 11 else None) for i in range(3000)] + [(9999, "x " * 40, "s1")] * 400)
    for df in (docs_of(spark, tiny), many, odd):
        rows = mixing.mixed_words(df).collect()
        source = collections.defaultdict(list)
        text = {}
        for r in df.collect():
            text[r["doc_id"]] = (len((r["text"] or "").split()), r["source"])
        assert len(rows) == df.count()
        by = collections.defaultdict(list)
        for r in rows:
            by[r["source_size"], r["target"]].append(r)
            assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        sizes = collections.Counter()
        for r in df.collect():
            sizes[r["source"]] += len([w for w in re.split(r"[ \t-\r]+", r["text"] or "") if w])
        want = brute_targets(dict(sizes))
        assert sorted(t for _, t in by) == pytest.approx(sorted({(sizes[k], round(v, 6)): v for k, v in want.items()}.values()), rel=1e-9)
        for (size, target), own in by.items():
            biggest = max(r["size"] for r in own)
            merged = sum(1 for k in sizes if sizes[k] == size)
            if df is not odd:
                assert abs(sum(r["taken"] for r in own) - merged * target) <= max(0.01 * target, 40 * 400 if df is many and biggest == 40 else 0.02 * biggest + 40)
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mixed_words(df).collect()), key=str)
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    taken = collections.Counter()
    for r in mixing.mixed_words(odd).collect():
        taken[r["doc_id"]] += r["taken"]
    got = collections.Counter()
    for r in out.collect():
        got[r["doc_id"]] += len((r["text"] or "").split())
    assert +got == +taken
    wordless = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect() if not (r["text"] or "").split())
    assert wordless(out) == wordless(odd)
    assert mixing.mixed_words(empty).count() == 0 and mixing.mix(empty).count() == 0


# --- 8


def brute_rules(text):
    t = text or ""
    w = t.encode().split()
    lines, seen, dup = t.split("\n"), set(), 0
    for s in lines:
        if s.encode().split():
            dup += s in seen
            seen.add(s)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(len(x.decode()) for x in w), sum(ch in "#*$%&|<>" for ch in t), dup, len(hit)


def test_rule_statistics(spark, tiny):
    rng = np.random.default_rng(5)
    texts = ["", None, " \n ", "a\na\n\n\na \na", "x " * 9, "x " * 8, "ab " * 30, LONG] + ["".join(rng.choice(list("ab \n"), 200)) for _ in range(200)]
    for t in texts + [r["text"] for r in docs_of(spark, tiny).collect()]:
        assert rules.statistics_of(t)[:5] == brute_rules(t)


def test_rules_learn_and_judge(spark, odd, empty):
    rng = np.random.default_rng(6)
    x = rng.random((2000, len(rules.FEATURES)))
    k = list(rules.FEATURES).index("symbol_share")
    bad = (x[:, k] > 0.7) & (x[:, 0] > 0.5)
    found = rules.learn(x, bad)
    assert (found.rejects(x) == bad).mean() > 0.97 and 1 <= len(found.rules) <= rules.MAX_RULES
    assert not rules.learn(x, np.zeros(2000, bool)).rules and not rules.learn(x[:0], bad[:0]).rules
    labels = spark.createDataFrame([(1, 1, 0, "z"), (2, 0, None, None), (None, 0, 1, "q"), (3, None, 1, "")], LABELS)
    judged = rules.judge(odd, rules.fit(odd, labels))
    got = {r["doc_id"]: r for r in judged.collect()}
    assert judged.count() == len(ODD) and got[3]["__base_failed"] and not got[4]["__kept"] and got[6]["__kept"]
    assert rules.judge(empty, rules.fit(empty, labels)).count() == 0


# --- 9


def brute_substrings(rows, k=13):
    last = 1 << 63
    first = {}
    for d, t, _ in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, last), last - 1 if d is None else d)
    out = []
    for d, t, _ in rows:
        w = (t or "").encode().split()
        own, gone = (last - 1 if d is None else d), set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < own:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def out_substrings(spark, monkeypatch, df):
    df.sparkSession.catalog.clearCache()
    monkeypatch.setattr(spark, "_read_for_test", None, raising=False)

    class Reader:
        class read:
            @staticmethod
            def parquet(path):
                return df

    return sorted(map(tuple, substrings.query(Reader, "x").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("hot", [4096, 2])
def test_substrings(spark, tiny, odd, empty, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = np.random.default_rng(7)
    shared = [" ".join(rng.choice(list("abcdefgh"), 20)) for _ in range(4)]
    made = []
    for i in range(60):
        parts = [" ".join(rng.choice([f"u{i}", "v", "w"], 5)) for _ in range(3)]
        made.append((int(rng.integers(0, 50)), " ".join([parts[0], shared[rng.integers(0, 4)], parts[1], shared[rng.integers(0, 4)][: int(rng.integers(5, 40))], parts[2]]), "s"))
    rows = [(r["doc_id"], r["text"], None) for r in docs_of(spark, tiny).collect()]
    for own, df in ((ODD, odd), (made, frame(spark, made)), (rows, docs_of(spark, tiny))):
        assert out_substrings(spark, monkeypatch, df) == brute_substrings(own)
    assert out_substrings(spark, monkeypatch, empty) == []


def test_paths_are_nonbranching_and_consecutive(spark):
    hits = [(1, 2, 5, 10), (2, 3, 5, 11), (3, 4, 5, 12), (3, 9, 6, 4), (4, 6, 5, 14), (6, 7, 5, 15), (8, 7, 5, 16), (7, 1, 5, 17), (1, 2, 5, 10)]
    df = spark.createDataFrame(hits, "a long, b long, source_doc long, source_pos int")
    got = sorted(map(tuple, substrings.paths(df).collect()))
    # 3 has two edges out, 4 to 6 comes two words later, 7 has two edges in; 7 to 1 is followed by 1 to 2, but elsewhere
    assert got == [(5, 10, 10), (5, 11, 10), (5, 12, 12), (5, 14, 14), (5, 15, 14), (5, 16, 16), (5, 17, 17), (6, 4, 4)]


def test_spans_compact_whole_passages(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a b c {passage} d e f", "s"), (2, f"x y {passage} z", "s"), (3, f"{passage} {passage}", "s")]
    df = frame(spark, rows)
    spans = substrings.repeated_spans(df, common.keep(substrings._document_rows(df), "rows"))
    keys = {r["k1"]: r["doc_id"] for r in df.select("doc_id", *common.text_keys()).collect()}
    got = sorted((keys[r["k1"]], r["start"], r["end"], r["source_doc"], r["source_start"]) for r in spans.collect())
    assert got == [(2, 2, 62, 1, 3), (3, 0, 60, 1, 3), (3, 60, 120, 1, 3)], got


# --- 10


def test_toxicity_trains_as_a_dense_network_does(monkeypatch):
    for name, value in (("BUCKETS", 256), ("DIM", 4), ("LEAST_TEXTS", 3), ("STEPS", 30)):
        monkeypatch.setattr(toxicity, name, value)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["ab", "cde", "fgh", "xyzzy" if i % 3 else "q"], 12)) for i in range(70)] + ["only here"]
    y = [int(i % 3 == 0) for i in range(71)]
    got = toxicity.train(texts, y, 0.1, steps=30)
    blank = 71 // toxicity.BLANKS
    x = np.zeros((71 + blank, 256))
    for i, t in enumerate(texts):
        for w, v in toxicity.weighted(t.split()).items():
            for b in toxicity.subwords(w):
                x[i, b] += v * toxicity.GAIN / len(toxicity.subwords(w))
    x[:, (x > 0).sum(0) < 3] = 0
    want = np.eye(2)[y + [0] * blank]
    rng = np.random.default_rng(7)
    e, w, c = rng.normal(0, 0.1, (256, 4)), rng.normal(0, 0.5, (4, 2)), np.zeros(2)
    e[(x > 0).sum(0) == 0] = 0
    se, sw, sc = np.full((256, 1), 1e-3), np.full((4, 2), 1e-3), np.full(2, 1e-3)
    order, epochs = np.arange(len(x)), 30 * 32 // len(x)
    for epoch in range(epochs):
        rng.shuffle(order)
        rate = 0.3 * (1 - epoch / epochs)
        for lo in range(0, len(x), 32):
            own = x[order[lo : lo + 32]]
            z = own @ e @ w + c
            p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            d = (p - want[order[lo : lo + 32]]) / len(own)
            used = (own > 0).any(0)[:, None]
            dw, de = (own @ e).T @ d, used * (own.T @ d @ w.T + toxicity.DECAY * e)
            se += (de**2).mean(1, keepdims=True)
            sw += dw**2
            sc += d.sum(0) ** 2
            e = e - rate * de / np.sqrt(se)
            w = w - 0.3 * rate * dw / np.sqrt(sw)
            c = c - rate * d.sum(0) / np.sqrt(sc)
    part = e @ (w[:, 1] - w[:, 0]) * toxicity.GAIN
    assert np.allclose(got.part, part, rtol=1e-2, atol=1e-2 * np.abs(part).max())


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(300)]
    bad = ["blorghex", "vranktup"]
    rows, labels = [], []
    for i in range(600):
        own = list(rng.choice(words, 60))
        if i % 4 == 0:
            own[::12] = list(rng.choice(bad, 5))
        rows.append((i, " ".join(own), "s"))
        labels.append((i, 1, int(i % 4 == 0), "t"))
    df, lab = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(df, lab)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    got = {r["doc_id"]: r["__score"] for r in toxicity.score(df, model).collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i in held]) > 0.95
    rate = model.scorer()
    clean = " ".join(words[:60])
    assert rate(clean + " blorghexx vranktupp blorghe vrankktup blorghexes") > rate(clean) + 0.2  # unseen misspellings
    assert 0 <= rate("") < 0.3 and 0 <= rate(None) < 0.3 and rate("...") == rate("")
    kept = toxicity.reject_toxic(df, lab)
    assert kept.columns == df.columns and 400 < kept.count() < 480
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(empty, model).count() == 0
    none = toxicity.fit(empty, lab.limit(0))
    assert 0 <= none.scorer()("x") < 0.3


# --- queries and pipeline


def test_pipeline_stages_by_brute_force(spark, tiny):
    """Each stage against a plain version, on all that the stage before kept."""
    import corpus_pipeline

    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    docs, kept = docs_of(spark, tiny), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.keep(stage(spark, docs, tiny), name)
        assert out.columns == docs.columns
        kept.append((docs.collect(), out.collect()))
        docs = out
    (before, after), *_ = kept
    labels = spark.read.parquet(f"{tiny}/labels.parquet").collect()
    text = {r["doc_id"]: r["text"] or "" for r in before}
    own = [(r["doc_id"], r["toxic"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    place = common_hash(spark, [d for d, _ in own])
    own.sort(key=lambda x: (place[x[0]], x[0]))
    rate = toxicity.train([text[d] for d, _ in own], [t for _, t in own], sum(t for _, t in own) / len(own)).scorer()
    assert {r["doc_id"] for r in after} == {d for d, t in text.items() if rate(t) < toxicity.THRESHOLD}
    before, after = kept[1]
    group = {d: c for d, _, c in brute_simhash([(r["doc_id"], r["text"], None) for r in before])}
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, c in group.items() if d == c)
    before, after = kept[2]
    added = brute_added([r["text"] for r in before])
    want = {r["doc_id"]: pii.clean(r["text"], [{"start": a, "end": b, "gone": g, "kind": k} for a, b, g, k in added.get(r["text"], [])]) for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == want
    before, after = kept[3]
    copies = collections.Counter(r["doc_id"] for r in after)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before:
        n = len((r["text"] or "").split())
        sizes[r["source"]] += n
        taken[r["source"]] += n * copies[r["doc_id"]]
        assert copies[r["doc_id"]] <= 2 and (n or copies[r["doc_id"]] == 1)
    most = max(len((r["text"] or "").split()) for r in before)
    assert all(abs(taken[k] - t) <= most for k, t in brute_targets(sizes).items())
    pieces = collections.Counter()
    for r in corpus_pipeline.pack(spark, docs, tiny).collect():
        pieces[r["doc_id"]] += r["length"]
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    tokens = collections.Counter()
    for r in after:
        tokens[r["doc_id"]] += len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert pieces == tokens
    assert corpus_pipeline.run(spark, tiny).count() > 0


def common_hash(spark, ids):
    """doc_id: Spark's hash of it."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(d,) for d in ids], "doc_id long")
    return {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}


def test_pipeline_on_odd_and_empty_tables(spark, tiny, odd, empty):
    import corpus_pipeline

    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = common.keep(stage(spark, docs, tiny), "odd")


def test_every_query_is_registered(spark):
    from corpusloom.llm import queries

    assert sorted(q.split("_")[0] for q in queries.QUERIES) == sorted(f"op{i}" for i in range(1, 11))
