"""The vector graph against an exact scan: recall at small and large tenants, and work that grows more slowly than the data."""

import numpy as np
import pytest

from sparkloom.operators import retrieval as R
from sparkloom.operators import vector_index as V

SCHEMA = "scope string, chunk_id long, embedding array<float>"
ASKED = "scope string, q_id long, embedding array<float>"


def clustered(rng, n, size=32, clusters=40):
    centres = rng.normal(size=(clusters, size))
    return centres[rng.integers(0, clusters, n)] + 0.6 * rng.normal(size=(n, size))


def frame(spark, scopes, ids, rows, schema):
    return spark.createDataFrame([(s, int(i), [float(x) for x in r]) for s, i, r in zip(scopes, ids, rows)], schema)


def found(df):
    return {(r.q_id, r.chunk_id) for r in df.collect()}


def test_recall_at_tenant_shares(spark):
    """Tenants with 0.1, 1, 21 and 78 per cent of 6,000 vectors."""
    rng = np.random.default_rng(1)
    scopes = ["tiny"] * 6 + ["small"] * 60 + ["middle"] * 1260 + ["large"] * 4674
    x = clustered(rng, len(scopes))
    vectors = frame(spark, scopes, range(len(scopes)), x, SCHEMA)
    pick = [int(i) for i in np.concatenate([rng.integers(0, 6, 5), rng.integers(6, 66, 10), rng.integers(66, 1326, 20), rng.integers(1326, 6000, 25)])]
    asked = frame(spark, [scopes[i] for i in pick], range(len(pick)), x[pick] + 0.3 * rng.normal(size=(len(pick), x.shape[1])), ASKED)
    index = V.build(vectors)
    got, want = found(V.search(asked, index)), found(R.dense(asked, vectors))
    by = {s: [len([1 for q, c in rows if scopes[pick[q]] == s]) for rows in (got & want, want)] for s in set(scopes)}
    assert all(a >= 0.9 * b > 0 for a, b in by.values()), by
    assert all(scopes[c] == scopes[pick[q]] for q, c in got)


def test_work_grows_more_slowly_than_the_data(spark):
    rng = np.random.default_rng(2)
    visits = []
    for n in (2000, 16_000):
        x = clustered(rng, n)
        index = V.build(frame(spark, ["a"] * n, range(n), x, SCHEMA))
        asked = frame(spark, ["a"] * 20, range(20), x[:20] + 0.2, ASKED)
        visits.append(V.search(asked, index, beam=64, count_visits=True).agg({"visits": "avg"}).first()[0])
    assert visits[1] < 3 * visits[0] and visits[1] < 0.25 * 16_000, visits


def test_odd_vectors(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 0.0]), ("a", 3, None), ("a", 4, [float("nan"), 1.0]), ("a", 5, [2.0, 0.0]), ("a", 5, [2.0, 0.0]), (None, 6, [1.0, 0.0]), ("b", 7, [1.0, 1.0, 1.0])]
    index = V.build(spark.createDataFrame(rows, SCHEMA))
    asked = spark.createDataFrame([("a", 1, [3.0, 0.0]), ("b", 2, [1.0, 0.0, 0.0]), ("none", 3, [1.0]), ("a", 4, None), ("a", 5, [0.0, 1.0])], ASKED)
    got = sorted((r.q_id, r.chunk_id, r.similarity, r.v_rank) for r in V.search(asked, index).collect())
    assert got == [(1, 1, 1.0, 1), (1, 5, 1.0, 2), (2, 7, pytest.approx(0.57735), 1), (5, 1, 0.0, 1), (5, 5, 0.0, 2)]
    assert V.search(asked.limit(0), index).collect() == [] and V.build(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_equal_vectors_hide_nothing(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.tile(rng.normal(size=16), (3000, 1)), clustered(rng, 1000, 16)])
    index = V.build(frame(spark, ["a"] * 4000, range(4000), x, SCHEMA))
    asked = frame(spark, ["a"] * 10, range(10), x[3000:3010], ASKED)
    assert {(q, q + 3000) for q in range(10)} <= found(V.search(asked, index))


def test_generations_lie_in_partitions_of_their_own(spark):
    vectors = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0])], SCHEMA)
    index = V.build(vectors, "g7")
    plan = index.where("generation = 'g7'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(generation" in plan and index.select("generation").distinct().collect() == [("g7",)]
