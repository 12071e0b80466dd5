"""SimHash near-duplicates against brute force over all pairs."""

import random

import xxhash

from sparkloom.llm import simhash


def plain_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    """node -> smallest node reached."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x] = root[root[x]]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in nodes}


def near(a, b):
    return (a ^ b).bit_count() <= 2


def test_fingerprint_of_odd_and_long_texts():
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(400)}" for _ in range(120_000))
    for text in (None, "", " \n\t", "One", "One two", "a b c", "A  b\x0bc\rd", "é ü x y z", long):
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text), text
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n ") == 0
    assert len(list(simhash.pieces(long.encode()))) > 1 and b"".join(simhash.pieces(long.encode())) == long.encode()


def test_pigeonhole_tables_meet_every_close_pair():
    rng = random.Random(2)
    for rest in ((1 << 64) - 1, 0x3FFFFF, 0b10110111 << 20):
        ts, bits = simhash.tables(rest), [j for j in range(64) if rest >> j & 1]
        assert all(key & left == 0 and key | left == rest for key, left in ts)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x ^ sum(1 << j for j in rng.sample(bits, 2))
            assert any((x ^ y) & key == 0 for key, _ in ts)


def found(spark, values, **how):
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "f long")
    return {frozenset((r.a % 2**64, r.b % 2**64)) for r in simhash.links(df, **how).collect()}


def test_links_are_all_close_pairs_also_under_crowded_keys(spark):
    rng = random.Random(3)
    spread = {rng.getrandbits(64) for _ in range(300)}
    spread |= {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in list(spread)[:150]}
    base, noisy = rng.getrandbits(64), rng.sample(range(64), 14)
    crowd = {base ^ sum(1 << j for j in noisy if rng.random() < 0.5) for _ in range(1500)}
    low = {base ^ x for x in range(700)}
    values = sorted(spread | crowd | low)
    exact = {frozenset((a, b)) for i, a in enumerate(values) for b in values[i + 1 :] if near(a, b)}
    assert found(spark, values) == exact
    assert found(spark, values, crowd=8) == exact


def test_rows_of_a_crowd_grow_with_the_crowd(spark):
    """Templates: fingerprints that differ in 20 bits at random. No level may hold the square of them."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    made = []
    for n in (1000, 4000):
        ts = simhash.tables((1 << 64) - 1)
        values = {base ^ sum(1 << j for j in range(20) if rng.random() < 0.5) for _ in range(n)}
        rows = 0
        for _, left in ts:
            for _, deeper in simhash.tables(left):
                keys = {}
                for v in values:
                    keys[v & ~deeper] = keys.get(v & ~deeper, 0) + 1
                assert max(keys.values()) <= 1 << deeper.bit_count() <= simhash.CROWD
                rows += sum(keys.values())
        made.append(rows / len(values))
    assert made[0] == made[1] == 225


def test_whole_operator(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    body = [rng.choice(words) for _ in range(400)]
    docs = []
    for k in range(120):
        copy = list(body)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        docs.append((1000 - k, " ".join(copy)))
    docs += [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for k in range(200)]
    docs += [(500, None), (501, ""), (502, " \n"), (None, docs[0][1]), (None, "alone in its component"), (3, docs[5][1]), (3, docs[5][1]), (777, "long " * 90_000)]
    prints = [plain_fingerprint(t) for _, t in docs]
    classes = plain_components(set(prints), near)
    least = {}
    for (doc, _), f in zip(docs, prints):
        if doc is not None:
            least[classes[f]] = min(doc, least.get(classes[f], doc))
    expected = sorted(((d, f"{f:016x}", least.get(classes[f])) for (d, _), f in zip(docs, prints)), key=str)
    df = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, f int, n int, component_id string")
    got = simhash.near_duplicates(df)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=str) == expected
    assert simhash.near_duplicates(df.limit(0)).collect() == []
