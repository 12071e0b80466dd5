"""Corpus operators against brute force, the libraries and round trips, with odd rows."""

import hashlib
import io
import random

import numpy as np
import pytest

from sparkloom.llm import ann, bpe, decontamination, jaccard, line_dedup, pii, quality, token_counts, toxicity, warc

TEXTS = [None, "", " \n ", "the cat sat on the mat and looked at the dog", "The  cat sat on the mat and looked at the DOG", "one two", "naïve Σίσυφος <|endoftext|> it's 42", "line that repeats a lot\nshort\nline that repeats a lot", "line that repeats a lot \nother long enough line", "x " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash"), (None, "line that repeats a lot", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")


def test_bpe_equals_library(docs):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(bpe.default_path())
    for r in bpe.encode_documents(docs, keep_ids=True).where("doc_id is not null").collect():
        want = theirs.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == theirs.decode(want, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_bpe_fuzz():
    from tokenizers import Tokenizer

    theirs, mine = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    rng = random.Random(3)
    for _ in range(2000):
        x = "".join(rng.choice("abcdetheining's  .!123é中😀<|endoftext|>\n") for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(mine.encode(x), "<u4").tolist() == theirs.encode(x, add_special_tokens=False).ids


def test_token_counts(docs):
    model = token_counts.load(token_counts.default_path())
    for r in token_counts.count_tokens(docs, limit=5, chunk=64).where("doc_id is not null").collect():
        text = TEXTS[r.doc_id] or ""
        assert r.n_tokens == len(model.model.encode(text)) and r.n_bytes == len(text.encode()) and r.over_limit == (r.n_tokens > 5)
    rng = random.Random(1)
    for _ in range(1500):
        x = "".join(rng.choice("ab the ing  \n é中😀<s> ▁ aa== 12") for _ in range(rng.randint(0, 200)))
        assert token_counts.tokens_of_chunks(model.spans, x, 24, 4) == len(model.model.encode(x))


def test_line_dedup(docs):
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs).where("doc_id is not null").collect()}
    key = lambda x: x.strip(" \t\n\v\f\r").lower()
    for i, t in enumerate(TEXTS):
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= 10 and min(k for k, u in enumerate(TEXTS) if key(x) in map(key, (u or "").split("\n"))) < i for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        assert (rows[i].n_lines, rows[i].n_dropped, rows[i].kept_sha256) == (len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_keeps_lines_after_the_last_dropped_one(spark):
    many = "\n".join(["a line that both have"] + [f"line number {i} of one" for i in range(20)])
    df = spark.createDataFrame([(1, "a line that both have"), (2, many)], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(df).collect()} == {1: 0, 2: 1}


def test_jaccard(spark, docs):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(w if rng.random() > 0.01 else f"z{rng.random()}" for w in base) for _ in range(30)] + [" ".join(base[:60])] * 2 + [t or "" for t in TEXTS]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.link_components(df, 3, 9, 10).collect()}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert got == dict(enumerate(root))
    assert jaccard.link_components(docs).count() == docs.count() and jaccard.link_components(docs.limit(0)).count() == 0


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(7, "sat on"), (8, "zebra"), (9, None), (10, "The cat, sat on the mat and looked at the dog")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.decontaminate(docs, items).collect()}
    assert (rows[3].n_words, rows[3].n_hit, rows[3].n_items) == (11, 11, 2)
    assert rows[3].items_sha256 == hashlib.sha256(b"10,7").hexdigest() and not rows[5].contaminated and rows[0].n_words == 0
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0


def test_decontamination_of_rows_without_id(spark, monkeypatch):
    items = spark.createDataFrame([(1, "one two three"), (2, "four five")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "x one two three"), (None, "fine"), (None, None), (42, "four five"), (43, "four six"), (43, "one two three")], "doc_id long, text string")
    for slice_ in (50_000, 1):
        monkeypatch.setattr(decontamination.phrase_slices, "__defaults__", (decontamination.WIDTH, slice_))
        found = sorted(((r.doc_id, r.n_words, r.n_hit) for r in decontamination.decontaminate(docs, items).collect()), key=repr)
        assert found == sorted([(None, 4, 3), (None, 1, 0), (None, 0, 0), (42, 2, 2), (43, 2, 0), (43, 3, 3)], key=repr)
        assert sorted(map(tuple, decontamination.clean(docs, items).collect()), key=repr) == sorted([(None, "fine"), (None, None)], key=repr)


def test_slices_of_phrases_unite(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, "cat sat"), (2, "sat on the"), (3, "looked at")], "item_id long, text string")
    whole = sorted(map(tuple, decontamination.decontaminate(docs.where("doc_id is not null"), items).collect()))
    monkeypatch.setattr(decontamination.phrase_slices, "__defaults__", (decontamination.WIDTH, 1))
    assert sorted(map(tuple, decontamination.decontaminate(docs.where("doc_id is not null"), items).collect())) == whole


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16))
    x[50:120] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.search(df, df.where("vec_id % 20 = 0"), 10).collect()
    x32 = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 400, 20):
        s = x32 @ x32[q]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-round(s[i], 9), i))[:10]
        hits += len({r.vec_id for r in found if r.query_id == q} & set(want))
    assert hits >= 0.9 * 200 and ann.search(df.limit(0), df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "ünïcode"), (5, "u", "ünïcode"), (None, "u", "same")]
    found = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect() if r.page_id}
    assert [found[i].record_type for i in (1, 2, 3, 4, 5)] == ["response", "revisit", "response", "revisit", "response"]
    assert found[2].refers_to == 1 and found[2].payload_bytes == 4 and found[4].refers_to == 3


def test_warc_reader_rejects_damage():
    good = warc.record(1, "u", b"payload") + warc.record(2, "u", b"payload", 1)
    assert [x[4] for x in warc.read_archive(io.BytesIO(good))] == ["response", "revisit"]
    with pytest.raises(warc.BadRecord):
        list(warc.read_archive(io.BytesIO(good[:-5])))
    fields = warc.record(1, "u", b"payload")
    import gzip

    with pytest.raises(warc.BadRecord):
        list(warc.read_archive(io.BytesIO(gzip.compress(gzip.decompress(fields).replace(b"payload", b"pAyload")))))


def test_pii():
    kinds = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in pii.scan(t)[1]]
    assert kinds("to bob at example dot org") == [("email", "bob at example dot org")]
    assert kinds("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ!") == [("email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ")]
    assert kinds("plus four nine one seven two five five five one two") == [("phone", "plus four nine one seven two five five five one two")]
    assert kinds("4111 1111 1111 1111 and 300.1.1.1") == [("card", "4111 1111 1111 1111")]
    assert kinds("look at the dot on that page") == []


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)
    assert toxicity.classify(docs.limit(0), labels.limit(0)).count() == 0


def test_quality_held_out(spark, docs):
    texts, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    ratings = labels.selectExpr("doc_id", "quality as grade")
    rows = quality.select(texts, ratings).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.keep == bool(r.quality) for r in rows) >= 0.9 * len(rows)
    assert quality.select(docs, ratings.limit(0)).count() == docs.count()
