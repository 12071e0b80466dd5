"""Cases that shortcuts of the corpus operators used to leave out."""

import base64
import gzip
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import ann, bpe, jaccard, pii, toxicity, warc


def kinds(text):
    return [(pii.KINDS[k], text[a:b]) for k, a, b in pii.scan(text)[1]]


@pytest.mark.parametrize(
    ("kind", "found"),
    [
        ("phone", "+49 one seven six 123 45678"),
        ("phone", "+1 five 5 five 0 one 2 three 4 five 6"),
        ("phone", "plus 49 one 7 6 123 45678"),
        ("phone", "+49 176 12 eight one"),
        ("card", "four 111 1111 1111 1111"),
        ("card", "4111 1111 one 1 1 1 1111"),
        ("ip", "one nine two dot one six eight dot one dot one"),
        ("ip", "192 dot one six eight dot 1 dot one"),
        ("ip", "one dot two dot three dot four"),
        ("ip", "one nine two [dot] one six eight [dot] 1 [dot] 1"),
    ],
)
def test_mixed_spelled_digits(kind, found):
    for text in (f"say {found} now", f"say {found} now\u200b"):
        assert (kind, found) in kinds(text), text


def test_plain_digits_do_not_hang_on_spelled_ones_elsewhere():
    plain = "4111  1111  1111  1111"
    assert kinds(plain) == [] and kinds(f"{plain} and page one 2") == []


@pytest.mark.parametrize(
    "found",
    ["jane @ example.com", "jane at example.com", "jane at example dot pl", "jane at example dot jp", "jane at example dot xyz", "jane.doe at mail.example.co.jp", "jane @ example dot berlin", "jane arroba ejemplo.es", "jane arobase exemple point paris", "jane at example dot online", "jane dot doe at example dot pl"],
)
def test_disguised_addresses(found):
    for text in (found, f"Write to {found}, please", f"({found}) and {found}."):
        assert ("email", found) in kinds(text), text


@pytest.mark.parametrize(
    "prose",
    ["look at the dot on that page", "at some point he left", "the water at boiling point turns", "at one point the dog", "visit us at example.com today", "5 apples @ 2.50 each", "stared at red dot in anger", "he stayed at home.Then he left", "at 10.am we met", "available at example.org", "it is at index.html now"],
)
def test_prose_is_no_address(prose):
    assert kinds(prose) == []


def test_scorer_reads_every_text_that_the_grammar_matches():
    grammar = toxicity.Grammar({w: (1.0, 1) for w in toxicity.SEED_INSULTS}, {b"schuf": (0.9, 1), "dégu".encode(): (0.8, 1)})
    scorer = toxicity.Scorer(grammar)
    marks = [" ", "¡", "¿", "«", "»", "、", "。", "！", "’", "…", "²", "٣", "́", "\U0001f600", "\U0001d400", "中", "_", "7", "-"]
    texts = [f"Tu es un {a}{w}{b} !" for w in ("connard", "imbecile", "Gilipollas", "cabrón", "Schufte", "dégueulasse", "kill") for a in ["", *marks] for b in ["", *marks]] + ["", "clean", "é"]
    want = [grammar.score(grammar.matches(x)) for x in texts]
    assert scorer(pa.array(texts)).tolist() == want and sum(x > want[-1] for x in want) > 1000
    assert len(set(map(bytes, map(toxicity.text_arcs, ("un connard", "un connard", "un ¡connard!"))))) == 1


def test_words_end_where_tokens_end():
    every = "".join(f"a{chr(c)}b " for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000)
    data, words = toxicity.word_table(np.frombuffer(every.encode(), np.uint8), np.array([0, len(every.encode())]))
    found = [data[a:b].tobytes().decode() for a, b in zip(words.start.tolist(), words.end.tolist())]
    assert found == [x for x in toxicity.TOKEN.findall(every) if x.isalnum()]


def naive_spans(text):
    """Base spans by the four patterns as they stand, tried at every place from the left."""
    out = []
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
            fine = (True, k == 1 and all(int(p) <= 255 for p in m[0].split(".")), 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0, 9 <= len(digits) <= 15)[k]
            if fine:
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_naive_patterns():
    rng = random.Random(8)
    parts = ["a", "b.c", "@", ".", "1", "23", "255", "256", "0", "4111 1111 1111 1111", "4111111111111111", "+", "+49 (0) 30 1234567", " ", "-", "x@y.z", "1.2.3.4", "10.0.0.1", "é", "\n", "%", "..", "7-8"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        base, spans = pii.scan(text)
        want = naive_spans(text)
        assert [(k, *x) for k, kind in enumerate(pii.KINDS) for x in base[kind]] == want, text
        assert set(want) <= set(spans)


@pytest.mark.parametrize("text", ["[at]" + " " * 500_000, "b dot " * 80_000, "ｗ" * 160_000, "one two three four " * 26_000, "1" * 500_000, "a at b dot " * 45_000, "[ " * 250_000, "a@" * 250_000, " dot" * 125_000 + "@"])
def test_hard_texts_take_linear_time(text):
    began = time.process_time()
    pii.scan(text)
    assert time.process_time() - began < 5  # half of a MB; quadratic scans took minutes


def test_pii_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "mail a@b.co now", 5), (3, "mail a@b.co now", 5), (None, "a@b.co", 5), (4, "x " * 200_000 + "a@b.co", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email long")
    got = sorted(((r.doc_id or 0, r.n_email, r.spans) for r in pii.find_pii(df).collect()))
    assert got == [(0, 1, "email:0:6"), (1, 0, ""), (2, 0, ""), (3, 1, "email:5:11"), (3, 1, "email:5:11"), (4, 1, "email:400000:400006")]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_toxicity_machine_equals_plain_rules():
    """The composed machine against the same rules told with word numbers."""
    words = {"idiot": 1.0, "scum": 0.7}
    grammar = toxicity.Grammar({w: (x, 1) for w, x in words.items()})
    rng, reach = random.Random(4), toxicity.REACH

    def plain(tokens):
        total, at = np.zeros(7), 0
        negated = told = aimed = -99
        quoted, clause = False, []

        def close():
            for k, kind, weight, rule in clause:
                ahead = any(0 < t - k <= reach for t in targets)
                if rule:
                    total[rule] += weight
                else:
                    total[(4 if kind else 0) + ahead] += weight
            total[6] += any(not rule for *_, rule in clause)

        targets = []
        for x in tokens:
            if x == '"':
                quoted = not quoted
            elif x == ".":
                close()
                clause, targets, negated, aimed = [], [], -99, -99
                told = told if quoted else -99
            else:
                at += 1
                if x in words or x == "kill":
                    rule = 2 if at - negated <= reach else 3 if at - told <= reach or (quoted and told > 0) else None
                    if x == "kill":
                        if rule is None:
                            clause.append((at, True, 1.0, 0))
                    else:
                        clause.append((at, False, words[x], rule or (1 if at - aimed <= reach else 0)))
                        if clause[-1][3] == 1:
                            clause[-1] = (at, False, 0.0, 0)
                            total[1] += words[x]
                elif x == "you":
                    aimed = at
                    targets.append(at)
                elif x == "not":
                    negated = at
                elif x == "said":
                    told = at
        close()
        return np.log1p(total)

    for _ in range(3000):
        tokens = [rng.choice(["idiot", "scum", "kill", "you", "not", "said", '"', ".", "a", "a", "a"]) for _ in range(rng.randint(0, 24))]
        assert np.allclose(grammar.matches(" ".join(tokens)), plain(tokens)), tokens


def test_toxicity_takes_linear_time():
    grammar = toxicity.Grammar({w: (1.0, 1) for w in toxicity.SEED_INSULTS})
    began = time.process_time()
    grammar.matches("idiot " * 80_000 + "you " * 80_000)
    assert time.process_time() - began < 5


def test_bpe_equals_library_on_every_code_point():
    from tokenizers import Tokenizer

    theirs, mine = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(texts), 50_000):
        for x, want in zip(texts[i : i + 50_000], theirs.encode_batch_fast(texts[i : i + 50_000], add_special_tokens=False)):
            assert np.frombuffer(mine.encode(x), "<u4").tolist() == want.ids, x


def test_warc_is_read_by_another_parser(spark, tmp_path):
    rows = [(i, f"http://x/{i}" if i % 3 else None, None if i == 5 else "same" if i % 2 else f"page {i} é" * 50) for i in range(-3, 30)] + [(None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(warc.deduplicated(pages), f"file://{tmp_path}").collect()
    ids, refers, n = {}, [], 0
    for m in manifest:
        data = gzip.decompress(open(m.path, "rb").read())
        kinds = []
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            block, data = data[: int(fields["Content-Length"])], data[int(fields["Content-Length"]) :]
            assert version == "WARC/1.1" and data[:4] == b"\r\n\r\n" and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
            assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            data = data[4:]
            kinds.append(fields["WARC-Type"])
            if kinds[-1] != "warcinfo":
                n += 1
                ids.setdefault(fields["WARC-Record-ID"], fields)
                refers += [(fields["WARC-Refers-To"], fields["WARC-Payload-Digest"])] if kinds[-1] == "revisit" else []
        assert kinds[0] == "warcinfo" and kinds.count("warcinfo") == 1
    assert n == len(rows) and refers
    for target, payload in refers:  # each revisit names a response with its payload
        assert ids[target]["WARC-Type"] == "response" and ids[target]["WARC-Payload-Digest"] == payload


def test_page_numbers_in_record_ids():
    for n in (0, 1, -1, 2**63 - 1, -(2**63), 123456789012345):
        assert warc.page_of(warc.record_id(n)) == n
    assert warc.page_of(warc.record_id(None)) is None


def test_warc_odd_tables(spark):
    schema = "page_id long, url string, html string, payload_bytes string"
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0
    long = "z" * 3_000_000
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame([(2, "u", long, "c"), (9, "u", long, "c")], schema)).collect()}
    assert got[2].payload_bytes == 3_000_000 and got[9].refers_to == 2


def test_neighbours_of_odd_rows(spark):
    inf = float("inf")
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0), (3, [0.5, 0.5], 0), (4, [1.0, 0.0, 0.0], 0), (5, [inf, 0.0], 0), (6, [], 0), (20, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (8, [1.0, None], 0), (-1, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    for how in (False, True):
        got = [(r["rank"], r.vec_id, r.score) for r in ann.search(df, df.where("vec_id = 20"), 5, exact=how).orderBy("rank").collect()]
        assert got == [(1, -1, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 0.5), (5, 1, 0.0)]
    assert ann.search(df, df.limit(0)).count() == 0 and {r.vec_id for r in ann.search(df, df.where("vec_id = 1"), 9).collect()} == {-1, 2, 3, 20}


def test_equal_vectors_beyond_k(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(i, [1.0, 0.1 * (i - 99)]) for i in range(100, 105)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 20 = 0"), 3).collect()
    for q in range(0, 100, 20):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [x for x in range(5) if x != q][:3]


def test_packed_estimates_keep_their_bounds():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((500, 64)), rng.standard_normal((70, 64))
    codes, planes = ann.Codes.of(x), ann.Planes(q)
    cosine = (q @ x.T) / planes.length[:, None] / codes.length[None, :]
    for some in (slice(0, 64), slice(64, 70)):
        estimate, rough = planes.cosines(codes, some)
        assert (np.abs(estimate - cosine[some]) > codes.error()[None, :] + ann.SIGMAS * rough).mean() < 0.01


def brute_components(texts, width, num, den):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize(("width", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_jaccard_of_chains_and_near_misses(spark, width, num, den):
    """Chains of near copies, texts around the threshold, texts that share much without being similar, short texts."""
    rng = random.Random(width)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for size in (8, 12, 20, 35, 60, 150, 400):
        base = [word() for _ in range(size)]
        for _ in range(9):
            base = [w if rng.random() > 0.6 * (1 - num / den) / width else word() for w in base] + [word() for _ in range(rng.randrange(1 + size // 60))]
            texts.append(" ".join(base))
        shared = [word() for _ in range(size)]
        texts += [" ".join([*shared, *(word() for _ in range(max(1, size // 4)))]) for _ in range(6)]
    texts += ["a b", "a b", "a", "", None, "a b c d e f g h i j k l", "a b c d e f g h i j k m"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.link_components(df, width, num, den).collect()}
    assert got == dict(enumerate(brute_components(texts, width, num, den)))


def test_every_similar_pair_shares_a_block():
    rng = np.random.default_rng(3)
    for num, den in ((9, 10), (4, 5), (1, 2)):
        ranges = jaccard.Ranges(num, den)
        for n in [*range(1, 60), 100, 300, 1000]:
            for _ in range(4):
                x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
                # as many changes as the threshold admits: d taken out, e put in
                d = int(rng.integers(0, n))
                while d and (n - d) * den < num * n:
                    d -= 1
                e = 0
                while (n - d) * den >= num * (n + e + 1):
                    e += 1
                y = np.unique(np.concatenate([rng.permutation(x)[: n - d], rng.integers(0, 2**63, e).astype(np.uint64) * np.uint64(2)]))
                if not np.array_equal(x, y):
                    assert jaccard.similar(x, [y], num, den)[0]
                    assert len(np.intersect1d(jaccard.signatures(x, ranges), jaccard.signatures(y, ranges))), (num, den, n, d, e)
