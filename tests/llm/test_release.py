"""The release operator against a plain replay, one turn after another."""

import random
import zlib

from sparkloom.llm import release


def plain(rows):
    """Outcomes of (conv_id, turn, text) rows by direct recursion on the parent."""
    conversations, out = {}, []
    for c, t, x in rows:
        conversations.setdefault(c, []).append((t, x or ""))
    for c, turns in conversations.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode())))
        done = []
        for p, (t, _) in enumerate(turns):
            h = lambda k, t=t: zlib.crc32(f"{k}:{'' if c is None else c}:{'' if t is None else t}".encode())
            at, parent = 7 * p, p - h(0) % 5
            repaired = at + h(2) % 101
            if 0 <= parent < p:
                if done[parent][0] != "delivered":
                    done.append(("blocked", 0, None, None))
                    continue
                at = max(at, done[parent][3])
            first, a = at, 1
            while h(1) % 101 < 50 and (at < repaired or h(a + 2) % 3 == 0) and a < 6:
                at, a = at + 20 * 2 ** (a - 1), a + 1
            dead = h(1) % 101 < 50 and (at < repaired or h(a + 2) % 3 == 0)
            done.append(("dead" if dead else "delivered", a, first, at))
        order = sorted((d[3], p) for p, d in enumerate(done) if d[0] == "delivered")
        numbers, state = {}, 0
        for k, (_, p) in enumerate(order, 1):
            state += k * zlib.crc32(turns[p][1].encode())
            numbers[p] = (k, (state + 2**63) % 2**64 - 2**63)
        out += [(c, turns[p][0], *d, *numbers.get(p, (None, None))) for p, d in enumerate(done)]
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, str(x)) for x in r])


SCHEMA = "conv_id long, turn long, text string"


def rows(seed):
    rng = random.Random(seed)
    small = [(c, i, None if rng.random() < 0.2 else f"x{i}") for c in range(2, 30) for i in range(rng.randrange(1, 30))]
    return [(1, i, f"t{rng.random()}") for i in range(2500)] + small + [(None, 0, "a"), (7, 3, "same"), (8, 10**9, "")] + [(50, 5, "dup")] * 40 + [(51, 5, f"v{i}") for i in range(9)]


def test_replay_with_whole_conversations_in_blocks(spark):
    data = [*rows(1), (None, None, "b"), (52, -(10**12), "far"), (52, 10**12, "far")]
    assert ordered(release.release(spark.createDataFrame(data, SCHEMA)).collect()) == ordered(plain(data))


def test_one_hot_conversation_is_cut_into_many_parts(spark):
    data = [r for r in rows(2) if r[1] < 10**6]
    df = spark.createDataFrame(data, SCHEMA)
    assert ordered(release.release(df, bits=4).collect()) == ordered(plain(data))
    turns = release.stretches(release.numbered(df, 4), 4)
    largest = turns.groupBy("conv", "g").count().agg({"count": "max"}).first()[0]
    assert turns.where("conv_id = 1").select("g").distinct().count() > 50 and largest < 300


def test_wheel_fires_in_order_over_all_levels():
    rng = random.Random(5)
    times = [rng.randrange(10 ** rng.randrange(1, 12)) for _ in range(3000)]
    wheel, seen = release.TimingWheel(0), []
    for k, t in enumerate(times):
        wheel.put(t, k)
    while fired := wheel.fire():
        seen += [wheel.now] * len(fired)
        assert all(times[k] <= wheel.now for k in fired if k < len(times))
        if len(seen) % 7 == 0 and len(times) < 4000:
            times.append(wheel.now + rng.randrange(5000))
            wheel.put(times[-1], len(times) - 1)
    assert seen == sorted(times)


def test_empty_table_and_clashing_columns(spark):
    assert release.release(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = spark.createDataFrame([(1, 0, "a", "x", 3, 9), (1, 1, "b", "y", 4, 9)], SCHEMA + ", status string, p long, b long")
    got = release.release(odd)
    assert got.columns == ["conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state"]
    assert ordered(got.collect()) == ordered(plain([(1, 0, "a"), (1, 1, "b")]))


def test_state_wraps_at_64_bits(spark):
    n, crc = 70_000, 2**32 - 1
    turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "'=1' AS conv", "id AS p", f"{crc}L AS crc", "'delivered' AS status", "1 AS attempts", "7 * id AS first_at", "7 * id AS last_at")
    last = release.released(turns).where(f"turn = {n - 1}").first()
    assert last.release_no == n and last.state == (crc * n * (n + 1) // 2 + 2**63) % 2**64 - 2**63 != crc * n * (n + 1) // 2


def test_very_long_text(spark):
    data = [(1, 0, "long " * 400_000), (1, 1, "")]
    assert ordered(release.release(spark.createDataFrame(data, SCHEMA)).collect()) == ordered(plain(data))
