"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has ``slots`` positions. Every shard owns ``vnodes`` of them (its virtual nodes); a key hashes to a position and
belongs to the next virtual node clockwise. Loads are bounded exactly: of N rows, a shard takes N // n_shards, and the
first N % n_shards shards take one more. Keys that find their shard full continue clockwise to the next shard with room,
so row counts differ by one at most while most keys stay with the shard that the ring gives them.

Only row counts by ring cell (slots x subs of them, whatever the input's size) reach the driver, where the overflow is
walked round the ring; the resulting intervals go back as a table of bounded size. Rows that are equal in every column
are pre-aggregated to one unit with a count, so that a repeated row does not make a hot task; different rows of one hot
key are spread over the ``subs`` cells of its position.

Cases: a null key hashes like any other value and stays; an empty table gives an empty result; fewer rows than shards
leave shards empty; ties on the ring are ordered by the key and the carried columns; repeated rows each get a slot.
"""

from __future__ import annotations

import json
from hashlib import blake2b

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import expand, table


def virtual_nodes(n_shards: int, vnodes: int, slots: int) -> dict[int, int]:
    """Ring position -> shard. A position that is taken already moves on to the next free one."""
    if n_shards * vnodes > slots:
        raise ValueError("the ring has fewer slots than virtual nodes")
    ring: dict[int, int] = {}
    for v in range(vnodes):
        for shard in range(n_shards):
            at = int.from_bytes(blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "little") % slots
            while at in ring:
                at = (at + 1) % slots
            ring[at] = shard
    return ring


def capacities(total: int, n_shards: int) -> list[int]:
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def walk_ring(counts: dict[tuple[int, int], int], ring: dict[int, int], n_shards: int) -> list[dict]:
    """Intervals of ranks of each cell (position, sub) with the shard they go to and the first slot number there.

    A virtual node serves the keys of its own arc first and those that overflowed from before it next. Two rounds suffice,
    as every shard with room is met in the second.
    """
    room, filled = capacities(sum(counts.values()), n_shards), [0] * n_shards
    cells: dict[int, list[list[int]]] = {}
    nodes = sorted(ring)
    owner, k = {}, 0
    for at in sorted({slot for slot, _ in counts}):
        while k < len(nodes) and nodes[k] < at:
            k += 1
        owner[at] = nodes[k % len(nodes)]
    for (slot, sub), n in sorted(counts.items()):
        cells.setdefault(owner[slot], []).append([slot, sub, 0, n])
    plan, carried = [], []
    for turn in range(2):
        for node in nodes:
            shard, waiting = ring[node], (cells.get(node, []) if turn == 0 else []) + carried
            carried = []
            for slot, sub, lo, hi in waiting:
                take = min(hi - lo, room[shard])
                if take:
                    plan.append({"slot": slot, "sub": sub, "lo": lo, "hi": lo + take, "shard": shard, "base": filled[shard]})
                    room[shard] -= take
                    filled[shard] += take
                if lo + take < hi:
                    carried.append([slot, sub, lo + take, hi])
    assert not carried
    return plan


def ring_shards(df: DataFrame, key: str, n_shards: int = 40, vnodes: int = 32, slots: int = 2048, subs: int = 4) -> DataFrame:
    """df with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 within a shard); the other columns stay, but for ones that
    already have these names."""
    if key in ("shard", "slot"):
        raise ValueError(f"the key can't be named {key}")
    df = df.drop("shard", "slot")
    spark, carried = df.sparkSession, df.columns
    named = df.toDF(*(f"c{i}" for i in range(len(carried))))  # the operator's own names can't clash with the caller's
    k = f"c{carried.index(key)}"
    units = (  # read twice, for the counts and for the rows: both times alike, as every step is a function of the rows
        named.groupBy(*named.columns)
        .agg(F.count("*").alias("n_equal"))
        .withColumn("at", F.pmod(F.xxhash64(F.lit(1), k), F.lit(slots)).cast("int"))
        .withColumn("sub", F.pmod(F.xxhash64(F.lit(2), *named.columns), F.lit(subs)).cast("int"))
    )
    counts = {(r["at"], r["sub"]): r["n"] for r in units.groupBy("at", "sub").agg(F.sum("n_equal").alias("n")).collect()}  # slots x subs at most
    plan = walk_ring(counts, virtual_nodes(n_shards, vnodes, slots), n_shards)
    intervals = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), "array<struct<slot:int,sub:int,lo:bigint,hi:bigint,shard:int,base:bigint>>")))
    intervals = intervals.toDF("p_at", "p_sub", "lo", "hi", "shard", "base")
    before = Window.partitionBy("at", "sub").orderBy(F.xxhash64(F.lit(3), k), *named.columns).rowsBetween(Window.unboundedPreceding, -1)
    ranked = units.withColumn("start", F.coalesce(F.sum("n_equal").over(before), F.lit(0)))
    rows = expand(ranked, "n_equal", "nth").withColumn("rank", F.col("start") + F.col("nth"))
    placed = rows.join(
        F.broadcast(intervals),  # a row for each cell and one more for each shard that fills up: bounded by slots, subs and vnodes
        (F.col("at") == F.col("p_at")) & (F.col("sub") == F.col("p_sub")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")),
    )
    out = placed.select(*named.columns, "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))
    return out.toDF(*carried, "shard", "slot")


def op9_sharding(spark, sf_dir):
    """Every document to one of 40 shards under the law `rows`."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return ring_shards(docs, "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
