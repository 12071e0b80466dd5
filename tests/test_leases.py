"""Claims and leases, and re-indexing."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sparkloom.operators import stores
from sparkloom.streaming import events, leases

START = datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp_ntz, id int, kind string, worker string"
STORY = [  # minutes, kind, worker, outcome
    (0, "claim", "a", "granted"), (0, "claim", "b", "held"), (5, "renew", "a", "renewed"), (14, "recovery", "b", "held"), (16, "recovery", "b", "granted"), (17, "finish", "a", "lost"), (17, "renew", "a", "lost"),
    (40, "renew", "b", "renewed"), (41, "fail", "b", "failed"), (42, "recovery", "c", "granted"), (43, "fail", "c", "failed"), (44, "recovery", "c", "exhausted"), (45, "claim", "c", "granted"), (46, "finish", "c", "ready"), (47, "recovery", "a", "granted"), (48, "odd", "a", "unknown"),
]


def requests(key):
    return [(key, START + timedelta(minutes=m), i, kind, worker) for i, (m, kind, worker, _) in enumerate(STORY)]


def test_one_claim_wins_and_late_writers_change_nothing(spark):
    df = spark.createDataFrame(requests("k") + requests("l") + [(None, START, 99, "claim", None), ("k", None, 98, "claim", "z")], SCHEMA)
    got = leases.decisions(df).collect()
    for key in "kl":
        mine = sorted((r.id, r.outcome) for r in got if r.key == key)
        assert mine == [(i, s[3]) for i, s in enumerate(STORY)]
    assert [(r.id, r.outcome, r.holder) for r in got if r.key is None] == [(99, "granted", "")] and len(got) == 2 * len(STORY) + 1


def test_stream_keeps_leases_between_batches(spark, tmp_path):
    for n, part in enumerate((STORY[:4], STORY[4:9], STORY[9:])):
        rows = [("k", START + timedelta(minutes=m), len(STORY[:4]) * (n > 0) + 5 * (n > 1) + i, kind, worker) for i, (m, kind, worker, _) in enumerate(part)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/part{n}.parquet")
    # one file a micro-batch, in the order they were written
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part*.parquet")
    got = events.appended(leases.decisions(stream), "leases-test").collect()
    assert sorted((r.id, r.outcome) for r in got) == [(i, s[3]) for i, s in enumerate(STORY)]


def test_reindex_twice_and_in_parts(spark):
    chunks = spark.createDataFrame([("o", 1, "a"), ("o", 2, None), ("p", 3, "c")], "owner_id string, chunk_id int, text string")
    vectors = spark.createDataFrame([("o", "new-o", 1, [1.0])], "owner_id string, generation_id string, chunk_id int, embedding array<double>")
    control = spark.createDataFrame([("o", "old-o", "active"), ("o", "new-o", "building"), ("p", "old-p", "active"), ("p", "new-p", "building")], "owner_id string, generation_id string, status string")
    embed = lambda t: F.when(t.isNotNull(), F.array(F.lit(2.0)))
    once = stores.reindexed(chunks, vectors, control, embed)
    state = lambda c: {r.generation_id: r.status for r in c.collect()}
    assert state(once[1]) == {"old-o": "active", "new-o": "building", "old-p": "retired", "new-p": "active"}
    assert sorted((r.generation_id, r.chunk_id) for r in once[0].collect()) == [("new-o", 1), ("new-p", 3)]
    twice = stores.reindexed(chunks.fillna("b", "text"), *once, embed)
    assert state(twice[1]) == {"old-o": "retired", "new-o": "active", "old-p": "retired", "new-p": "active"} and twice[0].count() == 3
    again = stores.reindexed(chunks.fillna("b", "text"), *twice, embed)
    assert again[0].count() == 3 and state(again[1]) == state(twice[1])


def test_prune_takes_whole_days_and_runs_twice(spark):
    from sparkloom.sources.shared import prune, stored

    rows = [(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03"), (4, None)]
    held = stored(spark.createDataFrame(rows, "id int, day string"), "prune-test", "day")
    assert prune(held, "day", "2024-01-03") == 2 and prune(held, "day", "2024-01-03") == 0
    assert sorted(r.id for r in spark.read.schema(held.schema).parquet(held.stored_at).collect()) == [3, 4]
