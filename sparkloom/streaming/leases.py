"""Claims on work as a stream of requests: of two claims one wins, a worker that lost its lease changes nothing, an expired lease is taken over.

A request is (key, ts, id, kind, worker). State is a key's holder, the time of its claim or last renewal (the token that later writes must match) and how often
work was begun. Keys are dealt out and decided each on their own, so no lock is needed; a batch that runs again after a failure starts from the state
before it and decides the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Minutes of a lease, times that work is begun by itself, minutes that new work is left alone, and how much a sweep takes.
LEASE, ATTEMPTS, GRACE, SWEEP = 10, 3, 1, 10

State = tuple[str | None, int, int]
FREE: State = (None, 0, 0)


def decide(state: State, t: int, kind: str, worker: str, lease: int, most: int) -> tuple[State, str]:
    """The state (holder, token, attempts) after a request at t, and what became of it. t and lease are microseconds.

    claim: granted if nobody holds the key or the lease has run out, else held; it starts the attempts anew. recovery: the same, but adds an attempt, and is
    exhausted after `most`. renew, finish, fail: renewed, ready, failed for the holder (even past its time, if nobody took over), else lost. Finishing
    forgets the attempts, failing keeps them; both free the key. Anything else is unknown.
    """
    holder, token, attempts = state
    if kind in ("claim", "recovery"):
        if kind == "recovery" and attempts >= most:
            return state, "exhausted"
        if holder is not None and token >= t - lease:
            return state, "held"
        return (worker, t, attempts + 1 if kind == "recovery" else 1), "granted"
    if kind not in ("renew", "finish", "fail"):
        return state, "unknown"
    if holder != worker:
        return state, "lost"
    if kind == "renew":
        return (holder, t, attempts), "renewed"
    return (None, 0, 0 if kind == "finish" else attempts), "ready" if kind == "finish" else "failed"


def decisions(requests: DataFrame, minutes: float = LEASE, most: int = ATTEMPTS) -> DataFrame:
    """requests (a stream, or a table) with what became of each: key, id, outcome, and the holder and attempts after it.

    Of a micro-batch a key's requests are taken by time, then id; those of later batches are later. Null workers are one worker ''; requests without
    time are left out; requests without key share one key.
    """
    rows = requests.where("ts is not null").select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "id", F.col("kind").cast("string").alias("kind"), F.coalesce(F.col("worker").cast("string"), F.lit("")).alias("worker"))
    schema = f"key {dict(rows.dtypes)['key']}, id {dict(rows.dtypes)['id']}, outcome string, holder string, attempts int"
    lease = int(minutes * 60_000_000)

    def replay(found: pd.DataFrame, state: State) -> tuple[pd.DataFrame, State]:
        found, out = found.sort_values(["t", "id"]), []
        for t, kind, worker in zip(found["t"].tolist(), found["kind"], found["worker"]):
            state, outcome = decide(state, t, kind, worker, lease, most)
            out.append((outcome, state[0], state[2]))
        return pd.DataFrame({"key": found["key"].array, "id": found["id"].array, **{c: [x[i] for x in out] for i, c in enumerate(("outcome", "holder", "attempts"))}}), state

    if not requests.isStreaming:
        return rows.groupBy("key").applyInPandas(lambda found: replay(found, FREE)[0], schema)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, after = replay(pd.concat(list(parts)), state.get if state.exists else FREE)
        state.update(after)
        yield out

    return rows.groupBy("key").applyInPandasWithState(step, schema, "holder string, token long, attempts int", "append", GroupStateTimeout.NoTimeout)


def sweep(documents: DataFrame, now: Column, size: int = SWEEP, minutes: int = LEASE, grace: int = GRACE, most: int = ATTEMPTS) -> DataFrame:
    """What one recovery sweep looks at: document_id and action, of documents (document_id, status, claimed_at, updated_at, attempts) that are in the middle of something
    with no lease or one that ran out, and weren't touched within the grace; the longest untouched first. Those begun `most` times are abandoned, others resumed."""
    ago = lambda m: now - F.expr(f"INTERVAL {int(m)} MINUTES")
    idle = F.col("claimed_at").isNull() | (F.col("claimed_at") < ago(minutes))
    rows = documents.where(F.col("status").isin("pending", "extracting", "embedding") & idle & (F.col("updated_at") < ago(grace)))
    return rows.orderBy("updated_at", "document_id").limit(size).select("document_id", F.when(F.col("attempts") >= most, "abandon").otherwise("resume").alias("action"))
