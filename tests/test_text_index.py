"""The stored text index against brute force over words."""

import random

import pytest

from sparkloom.functions.stems import STOP_WORDS, lexemes, stem
from sparkloom.operators import text_index as X


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("gas", "gas"), ("this", "this"), ("kiwis", "kiwi"), ("agreed", "agre"), ("feed", "feed"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"), ("hoping", "hope"), ("happy", "happi"), ("sky", "sky"), ("say", "say"), ("by", "by"), ("cry", "cri"),
        ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("valency", "valenc"), ("digitizer", "digit"), ("radically", "radic"), ("differently", "differ"), ("vietnamization", "vietnam"), ("operator", "oper"), ("feudalism", "feudal"), ("decisiveness", "decis"),
        ("hopefulness", "hope"), ("callousness", "callous"), ("formality", "formal"), ("sensitivity", "sensit"), ("sensibility", "sensibl"), ("triplicate", "triplic"), ("formative", "format"), ("formalize", "formal"), ("electricity", "electr"), ("electrical", "electr"), ("goodness", "good"),
        ("revival", "reviv"), ("allowance", "allow"), ("inference", "infer"), ("airliner", "airlin"), ("adjustable", "adjust"), ("defensible", "defens"), ("irritant", "irrit"), ("replacement", "replac"), ("adjustment", "adjust"), ("dependent", "depend"), ("adoption", "adopt"),
        ("homologous", "homolog"), ("communism", "communism"), ("activate", "activ"), ("effective", "effect"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("skies", "sky"), ("dying", "die"), ("news", "news"), ("generate", "generat"), ("general", "general"),
        ("yelling", "yell"), ("employees", "employe"), ("policies", "polici"), ("policy", "polici"), ("running", "run"), ("quickly", "quick"), ("exceeded", "exceed"), ("2024", "2024"), ("x1s", "x1s"),
    ],
)
def test_stems(word, want):
    assert stem(word) == want


def test_positions_count_stop_words():
    assert lexemes("The cats of the Cat; catS!") == {"cat": [2, 5, 6]} and lexemes(None) == lexemes("the of") == {} and "the" in STOP_WORDS


def covers(positions):
    """(begin, end) of the shortest stretches with a position of each list, by trying all."""
    points = sorted({p for x in positions for p in x})
    holds = lambda a, b: all(any(a <= p <= b for p in x) for x in positions)
    found = [(a, b) for a in points for b in points if a <= b and holds(a, b)]
    return [(a, b) for a, b in found if not any((c, d) != (a, b) and a <= c and d <= b for c, d in found)]


def plain(questions, chunks, every, stemmed):
    out = {}
    for q, scope, text in questions:
        terms = sorted(lexemes(text, stemmed))
        for c_scope, c, content in chunks:
            held = lexemes(content, stemmed)
            hits = [held.get(t, []) for t in terms]
            if c_scope != scope or not any(hits) or (every and not all(hits)):
                continue
            if every:
                every_hit = {p for x in hits for p in x}
                rank = sum(0.1 / (1 + b - a + 1 - len([p for p in every_hit if a <= p <= b])) for a, b in covers(hits))
            else:
                rank = 0.1 * sum(map(len, hits))
            out[q, c] = round(rank, 6)
    return out


@pytest.mark.parametrize(("every", "stemmed"), [(False, True), (False, False), (True, True)])
def test_ranks(spark, every, stemmed):
    rng = random.Random(4)
    words = ["leave", "leaves", "policy", "policies", "the", "run", "running", "runner", "of", "approved", "approval", "7", "days"]
    chunks = [(rng.choice("ab"), k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for k in range(60)] + [("a", 100, None), ("b", 101, "")]
    questions = [(k, rng.choice("ab"), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for k in range(25)] + [(99, "a", "the of"), (98, "a", None), (97, "none", "leave")]
    index = X.build(spark.createDataFrame(chunks, "scope string, chunk_id int, content string"), stemmed)
    asked = spark.createDataFrame(questions, "q_id int, scope string, text string")
    got = X.search(asked, index, 1000, every, stemmed).collect()
    want = plain(questions, chunks, every, stemmed)
    assert {(r.q_id, r.chunk_id): r.lexical_rank for r in got} == pytest.approx(want) and len(got) == len(want) > 20
    best = X.search(asked, index, 2, every, stemmed).collect()
    for q in {r.q_id for r in best}:
        mine = sorted(((-v, c) for (a, c), v in want.items() if a == q))[:2]
        assert [(-r.lexical_rank, r.chunk_id) for r in sorted(best, key=lambda r: r.l_rank) if r.q_id == q] == mine


def test_stemmed_questions_meet_other_forms(spark):
    chunks = spark.createDataFrame([("a", 1, "Policies were approved"), ("a", 2, "a policy")], "scope string, chunk_id int, content string")
    asked = spark.createDataFrame([(1, "a", "approving policy")], "q_id int, scope string, text string")
    assert [(r.chunk_id, r.lexical_rank) for r in X.search(asked, X.build(chunks)).orderBy("l_rank").collect()] == [(1, 0.2), (2, 0.1)]
    assert [r.chunk_id for r in X.search(asked, X.build(chunks, False), stemmed=False).collect()] == [2]


def test_a_search_reads_the_buckets_of_its_terms(spark):
    chunks = spark.createDataFrame([("a", k, f"word{k}") for k in range(200)], "scope string, chunk_id int, content string")
    index = X.build(chunks)
    plan = index.where("bucket = 3 and term = 'word7'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,word7)" in plan


@pytest.mark.parametrize(("name", "every"), [("stemmed_rank", False), ("cover_rank", True)])
def test_queries_over_whole_tables(spark, name, every):
    from sparkloom.plans import indexes

    d = "/root/testdata/sf0.001"
    held = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id AS item_id")
    asked = [(r.item_id, "en", r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").join(held, "item_id").collect()]
    texts = [(r.lang, r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = plain(asked, texts, every, True)
    best = {}
    for (q, c), v in want.items():
        best.setdefault(q, []).append((-v, c))
    expected = {(q, c, r): -v for q, rows in best.items() for r, (v, c) in enumerate(sorted(rows)[:20], 1)}
    got = {(r.q_id, r.chunk_id, r.l_rank): r.lexical_rank for r in indexes.QUERIES[name](spark, d).collect()}
    assert got == pytest.approx(expected) and got
