"""The divergence audit against a dense count over all terms and sources."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from sparkloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least=3, top=200):
    counts, frequency, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = TERM.findall(lowered(text))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        frequency[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in frequency[lang].items() if n >= least]

        def shares(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, k) for k, x in enumerate(items[:most], 1)]
    return sorted(out)


SCHEMA = "text string, lang string, source string"


def documents(seed, n=500):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "THE", "été", "Été", "naïve", "x", "don't", "a1b", "漢字"] + [f"w{'abcdefghij'[k % 10]}{chr(97 + k // 10)}" for k in range(200)]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "hot", "s1", "s2", "s3", None])
        rows.append((" ".join(rng.choice(vocabulary[: rng.choice([12, 60, 210])]) for _ in range(rng.randrange(40))), lang, source))
    return rows + [(None, "en", "empty"), ("", "zz", "a"), ("once", "zz", "b"), ("12 34", "yy", "only")] + [("same same line", "en", "s1")] * 3


def answer(df, **how):
    return sorted(tuple(r) for r in divergence.divergence(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


def test_same_as_a_dense_count(spark):
    rows = documents(1)
    df = spark.createDataFrame(rows, SCHEMA)
    assert answer(df) == plain(rows)
    # a sketch so small that its counters clash rules out less, nothing else
    assert answer(df, width=4, depth=2, top=5, least=20) == plain(rows, 20, 5)


def test_sketch_never_rules_out_a_frequent_term(spark):
    rows = documents(2, 300)
    frequency = defaultdict(Counter)
    for text, lang, _ in rows:
        frequency[lang or ""].update(set(TERM.findall(lowered(text or ""))))
    for width in (6, 14):
        bits = divergence.sketch(spark.createDataFrame(rows, SCHEMA).repartition(7), least=9, depth=3, width=width)
        ruled_out = 0
        for lang, counts in frequency.items():
            terms = list(counts)
            key = divergence.keys(divergence.language_hash(lang), divergence.term_hashes([t.encode() for t in terms])) if terms else np.zeros(0, np.uint64)
            at = np.array([divergence.places(key, k, width) for k in range(3)])
            fine = [all(row[a >> 3] >> (7 - (a & 7)) & 1 for row, a in zip(bits, column)) for column in at.T]
            assert all(ok for t, ok in zip(terms, fine) if counts[t] >= 9)
            ruled_out += sum(not ok for ok in fine)
        assert ruled_out > 0 or width == 6


def test_long_texts_are_cut_between_terms():
    text = ("Ab-cd é1 " * 90_000).encode()
    pieces = list(divergence.terms_of(text, 1000))
    assert len(pieces) > 500 and [t for p in pieces for t in p] == [t.encode() for t in TERM.findall(lowered(text.decode()))]
    assert list(divergence.terms_of(b"")) == [] and [t for p in divergence.terms_of(b"x" * 5000, 100) for t in p] == [b"x" * 5000]


def test_empty_table_and_clashing_columns(spark):
    assert answer(spark.createDataFrame([], SCHEMA)) == []
    rows = documents(3, 60)
    odd = spark.createDataFrame([(*r, 1, 2, 3, "p") for r in rows], SCHEMA + ", term int, part int, n int, item string")
    assert answer(odd) == plain(rows)
