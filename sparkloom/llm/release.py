"""Quarantine and cascading release: faulty turns wait and are tried again, turns behind them are parked and woken.

The retries of a conversation run on a hashed hierarchical timing wheel: buckets hold arrivals and backoff retries, a firing
slot delivers or fails its turns, a delivery wakes the children parked on it in the same second, a dead turn blocks them.
A wheel serves one stretch of a conversation. A turn's parent is at most REACH turns back, so wherever no turn reaches
back over a position, the conversation falls into two parts that know nothing of each other; turns are dealt out by the block
of 2^bits turns in which their part begins. A conversation with a third of all rows is spread over many tasks like this, with
nothing left out. Numbers that run through a whole conversation (a turn's position, the last cut, releases and the state
behind each) are sums or maxima over blocks of rows that are carried over blocks of blocks (`carried`), so that no window
holds more than 2^bits blocks.

Stated results for odd rows: a null conv_id is a conversation of its own, a null turn comes first in its conversation, and
either is an empty string in the hashed text. Rows that repeat (conv_id, turn) are turns of their own, in the order of
crc32(text). Null text counts as empty. An empty table gives no row, other columns are ignored. A state past 64 bits wraps.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from .common import forget, stored

GAP, REACH, MODULUS, FAULTY_BELOW, BACKOFF, ATTEMPTS = 7, 4, 101, 50, 20, 6
#: Rows of a block, as a power of two.
BITS = 12
DELIVERED, DEAD, BLOCKED = "delivered", "dead", "blocked"


class TimingWheel:
    """Entries by second. Level k has 64 slots of 64^k seconds; an entry lies on the lowest level that tells its second from now.

    Whatever is on a level comes before all that is on higher ones, so the next entry is found by the slot masks; entering a
    slot of a higher level deals its entries to lower ones.
    """

    def __init__(self, now: int):
        self.now, self.slots, self.masks = now, [], []

    def put(self, second: int, entry) -> None:
        level = max((self.now ^ second).bit_length() - 1, 0) // 6
        while len(self.slots) <= level:
            self.slots.append([[] for _ in range(64)])
            self.masks.append(0)
        slot = second >> 6 * level & 63
        self.slots[level][slot].append((second, entry))
        self.masks[level] |= 1 << slot

    def fire(self) -> list:
        """Moves to the next second with entries and takes them out; none are left where it gives an empty list."""
        while True:
            level = next((k for k, mask in enumerate(self.masks) if mask), None)
            if level is None:
                return []
            slot = (self.masks[level] & -self.masks[level]).bit_length() - 1
            found, self.slots[level][slot] = self.slots[level][slot], []
            self.masks[level] &= ~(1 << slot)
            self.now = self.now >> 6 * (level + 1) << 6 * (level + 1) | slot << 6 * level
            if not level:
                return [entry for _, entry in found]
            for second, entry in found:
                self.put(second, entry)


def replay(position: list[int], distance: list[int], repair: list[int], fails: list[int]) -> tuple[list, list, list, list]:
    """(status, attempts, first_at, last_at) of consecutive turns, none of which has its parent before them.

    distance is 0 without a parent, repair the seconds after arrival (-1: not faulty), bit a - 1 of fails says that attempt a fails.
    """
    n = len(position)
    status, tries, first, last = [None] * n, [0] * n, [None] * n, [None] * n
    parked: dict[int, list[int]] = {}
    if not n:
        return status, tries, first, last
    wheel = TimingWheel(GAP * position[0])
    for i, p in enumerate(position):
        wheel.put(GAP * p, i)

    def block(turns: list[int]) -> None:
        while turns:
            i = turns.pop()
            status[i] = BLOCKED
            turns += parked.pop(i, ())

    while fired := wheel.fire():
        t = wheel.now
        for i in sorted(fired):
            parent = i - distance[i]
            if not tries[i] and parent != i and status[parent] != DELIVERED:
                if status[parent] is None:
                    parked.setdefault(parent, []).append(i)
                else:
                    block([i])
                continue
            tries[i] += 1
            first[i] = t if tries[i] == 1 else first[i]
            last[i] = t
            if repair[i] < 0 or (t >= GAP * position[i] + repair[i] and not fails[i] >> (tries[i] - 1) & 1):
                status[i] = DELIVERED
                for child in parked.pop(i, ()):
                    wheel.put(t, child)
            elif tries[i] == ATTEMPTS:
                status[i] = DEAD
                block(parked.pop(i, []))
            else:
                wheel.put(t + BACKOFF * (1 << (tries[i] - 1)), i)
    return status, tries, first, last


def carried(blocks: DataFrame, total, bits: int = BITS) -> DataFrame:
    """blocks (conv, b, v), one row a block, with `before`: the total (F.sum or F.max) of v over the conversation's smaller b, null for the first.

    A window holds the blocks of one block of blocks, at most 2^bits; those go the same way until all lie in two neighbouring ones.
    """
    up = F.expr(f"shiftright(b, {bits})")
    ends = blocks.agg(F.min(up).alias("a"), F.max(up).alias("b")).first()
    if ends.b - ends.a <= 1:
        return blocks.select("conv", "b", total("v").over(W.partitionBy("conv").orderBy("b").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    order = W.partitionBy("conv", up).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    here = blocks.withColumn("before", total("v").over(order))
    above = carried(blocks.groupBy("conv", up.alias("b")).agg(total("v").alias("v")), total, bits)
    both = F.greatest("before", "above") if total is F.max else F.when(F.col("before").isNull(), F.col("above")).otherwise(F.col("before") + F.coalesce("above", F.lit(0)))
    here = here.withColumn("up", up).join(above.select("conv", F.col("b").alias("up"), F.col("before").alias("above")), ["conv", "up"], "left")
    return here.select("conv", "b", both.alias("before"))


def several(df: DataFrame) -> bool:
    """Whether b has two values."""
    found = df.agg(F.min("b").alias("a"), F.max("b").alias("b")).first()
    return found.a != found.b


def with_carried(df: DataFrame, block: Column, value: Column, total, bits: int) -> DataFrame:
    """df with b, its block, and `before`: the total of value over the conversation's earlier blocks."""
    df = df.withColumn("b", block)
    if not several(df.select("b")):
        return df.withColumn("before", F.lit(None).cast("long"))
    before = carried(df.groupBy("conv", "b").agg(total(value).alias("v")), total, bits)
    return df.join(before, ["conv", "b"], "left")


def numbered(conversations: DataFrame, bits: int = BITS) -> DataFrame:
    """(conv_id, turn, conv, p, distance, repair, fails, crc) of every row: its position and what its hashes say. Texts go no further."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    copies = conversations.groupBy("conv_id", "turn", F.crc32(text("text")).alias("crc")).agg(F.count("*").alias("copies"))
    # a prefix keeps the null conversation apart from one that is called ''
    copies = stored(copies.withColumn("conv", F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), text("conv_id")))), "release-turns")
    place = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))
    order = W.partitionBy("conv", "b").orderBy("turn", "crc").rowsBetween(W.unboundedPreceding, -1)
    df = with_carried(copies, F.shiftright(place, bits), F.col("copies"), F.sum, bits)
    df = df.withColumn("p", F.coalesce(F.sum("copies").over(order), F.lit(0)) + F.coalesce("before", F.lit(0))).drop("b", "before")
    # repeated rows: blocks of copies are dealt out before they are written one by one
    many = df.where("copies > 1").withColumn("k", F.explode(F.expr(f"sequence(0L, (copies - 1) div {1 << bits})"))).repartition("conv", "turn", "crc", "k")
    many = many.withColumn("p", F.explode(F.expr(f"sequence(p + k * {1 << bits}, p + least(copies, (k + 1) * {1 << bits}) - 1)")))
    df = df.where("copies = 1").drop("copies").unionByName(many.drop("copies", "k"))
    h = lambda k: F.crc32(F.concat(F.lit(f"{k}:"), text("conv_id"), F.lit(":"), text("turn")))
    back = h(0) % (REACH + 1)
    fails = sum((F.when(h(a + 2) % 3 == 0, 1 << (a - 1)).otherwise(0) for a in range(1, ATTEMPTS + 1)), F.lit(0))
    out = df.select("conv_id", "turn", "conv", "p", F.when(back <= F.col("p"), back).otherwise(0).cast("int").alias("distance"), F.when(h(1) % MODULUS < FAULTY_BELOW, h(2) % MODULUS).otherwise(-1).cast("int").alias("repair"), fails.cast("int").alias("fails"), "crc")
    out = stored(out, "release-numbered")
    forget(copies)
    return out


def stretches(turns: DataFrame, bits: int = BITS) -> DataFrame:
    """turns with g: the block of 2^bits positions in which the part of the conversation that a turn belongs to begins."""
    if not several(turns.select(F.shiftright("p", bits).alias("b"))):
        return turns.withColumn("g", F.lit(0).cast("long"))
    order = W.partitionBy("conv", F.shiftright("p", bits)).orderBy("p")
    cut = F.col("distance") == 0
    for k in range(1, REACH):  # where the block ends too early to tell, there's no cut
        cut &= F.coalesce(F.lead("distance", k).over(order), F.lit(REACH)) <= k
    turns = turns.withColumn("cut", F.when(cut | (F.col("p") == 0), F.col("p")))
    turns = with_carried(turns, F.shiftright("p", bits), F.col("cut"), F.max, bits)
    begin = F.coalesce(F.max("cut").over(W.partitionBy("conv", "b").orderBy("p").rowsBetween(W.unboundedPreceding, 0)), "before")
    return turns.withColumn("g", F.shiftright(begin, bits)).drop("cut", "b", "before")


def replayed(turns: DataFrame) -> DataFrame:
    """The outcome of every turn: conv_id, turn, conv, p, crc, status, attempts, first_at, last_at."""
    kept = ["conv_id", "turn", "conv", "p", "crc"]
    fields = [turns.schema[c] for c in kept]
    out = StructType(fields).add("status", StringType()).add("attempts", IntegerType()).add("first_at", LongType()).add("last_at", LongType())
    arrow = to_arrow_schema(out)

    def outcome(rows: pa.Table, bounds: list[int]) -> pa.Table:
        p, distance, repair, fails = (rows[c].to_pylist() for c in ("p", "distance", "repair", "fails"))
        found = [[], [], [], []]
        for s, e in zip(bounds, bounds[1:]):
            for column, more in zip(found, replay(p[s:e], distance[s:e], repair[s:e], fails[s:e])):
                column += more
        columns = [rows[c].combine_chunks() for c in kept] + [pa.array(c, f.type) for c, f in zip(found, list(arrow)[len(kept) :])]
        return pa.table(columns, schema=arrow)

    def run(batches):
        rest = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, new]) if rest is not None else new
            g, conv = rest["g"].to_pylist(), rest["conv"].to_pylist()
            bounds = [0] + [i for i in range(1, len(g)) if g[i] != g[i - 1] or conv[i] != conv[i - 1]]
            if len(bounds) > 1:  # the last stretch may go on in the next batch
                yield from outcome(rest.slice(0, bounds[-1]), bounds).to_batches()
                rest = rest.slice(bounds[-1])
        if rest is not None and rest.num_rows:
            yield from outcome(rest, [0, rest.num_rows]).to_batches()

    return turns.repartition("conv", "g").sortWithinPartitions("conv", "p").mapInArrow(run, out)


def released(outcomes: DataFrame, bits: int = BITS) -> DataFrame:
    """outcomes with release_no and state: deliveries of a conversation numbered by second, then turn, and the sums behind them."""
    order = W.partitionBy("conv", "b").orderBy("last_at", "turn", "p")
    up_to = order.rowsBetween(W.unboundedPreceding, 0)
    block = F.shiftright("last_at", bits)
    sent = with_carried(outcomes.where(f"status = '{DELIVERED}'"), block, F.lit(1), F.sum, bits)
    sent = sent.withColumn("release_no", F.row_number().over(order) + F.coalesce("before", F.lit(0)).cast("long")).drop("b", "before")
    weight = F.col("release_no").cast("decimal(19,0)") * F.col("crc").cast("decimal(10,0)")
    sent = with_carried(sent, block, weight.cast("decimal(38,0)"), F.sum, bits)
    total = F.sum(weight.cast("decimal(38,0)")).over(up_to) + F.coalesce(F.col("before").cast("decimal(38,0)"), F.lit(0))
    wrapped = F.pmod(total, F.lit(Decimal(1 << 64)))
    state = F.when(wrapped >= F.lit(Decimal(1 << 63)), wrapped - F.lit(Decimal(1 << 64))).otherwise(wrapped).cast("long")
    sent = sent.withColumn("state", state).drop("b", "before")
    rest = outcomes.where(f"status <> '{DELIVERED}'").withColumns({"release_no": F.lit(None).cast("long"), "state": F.lit(None).cast("long")})
    return sent.unionByName(rest)


def release(conversations: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per row of conversations: conv_id, turn, status, attempts, first_at, last_at, release_no, state."""
    turns = numbered(conversations, bits)
    outcomes = stored(replayed(stretches(turns, bits)), "release-outcomes")
    forget(turns)
    return released(outcomes, bits).select("conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state")
