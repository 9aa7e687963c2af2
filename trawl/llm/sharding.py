"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of ticks; every shard owns virtual nodes on it. A row's tick comes from
its text, so copies of a text share a point of the ring, and its home is the next virtual node clockwise.
No shard takes more than its capacity: rows that find their home full go on clockwise to the next
shard with room. With capacities that sum to the number of rows, shards differ by one row at most.

Rows of one tick are ranked inside salted slices, so the plan on the driver has only one count a tick
(a fixed number), and a text that fills a third of the corpus is dealt by many tasks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import materialise, salts, table

TICKS = 16_384
VNODES = 64


def ring(shards: int, vnodes: int, ticks: int) -> list[tuple[int, int]]:
    """Virtual nodes as (tick, shard), clockwise."""

    def place(shard: int, v: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") % ticks

    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def plan(counts: dict[int, int], nodes: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (tick, home, from rank, to rank, shard, first slot): each home takes its own rows first,
    then what overflows goes on clockwise."""
    room, used, at = list(capacity), [0] * len(capacity), [n[0] for n in nodes]
    segments, over = [], []

    def give(tick: int, home: int, start: int, n: int, shard: int) -> None:
        segments.append((tick, home, start, start + n, shard, used[shard]))
        room[shard] -= n
        used[shard] += n

    for tick in sorted(counts):
        node = bisect_left(at, tick) % len(nodes)
        home = nodes[node][1]
        n = min(counts[tick], room[home])
        if n:
            give(tick, home, 0, n, home)
        if n < counts[tick]:
            over.append((tick, node, n))
    for tick, node, start in over:
        home, left = nodes[node][1], counts[tick] - start
        while left:
            shard = nodes[node % len(nodes)][1]
            if n := min(left, room[shard]):
                give(tick, home, start, n, shard)
                start, left = start + n, left - n
            node += 1
    return segments


def shard_rows(docs: DataFrame, shards: int = 24, vnodes: int = VNODES, ticks: int = TICKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard, moved.

    Law ``rows``: shards differ by one row at most; ``slot`` counts each shard's rows from 0 without
    gaps. size is the text's UTF-8 bytes plus 8; a null text has size 8 and the checksum of an empty text.
    Equal texts share a home and stay there while it has room; ties and repeated rows take slots of
    their own. Very long texts are hashed where they are
    and never travel. Only ``doc_id`` and ``text`` are read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(ticks)).cast("int").alias("tick"),
    )
    rows = materialise(rows)
    n = rows.count()
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("salt")), F.lit(salts(n))).cast("int"))
    slices = materialise(rows.groupBy("tick", "salt").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["tick"]: r["n"] for r in slices.groupBy("tick").agg(F.sum("n").alias("n")).collect()}  # at most `ticks` rows
    capacity = [n // shards + (s < n % shards) for s in range(shards)]
    segments = docs.sparkSession.createDataFrame(
        plan(counts, ring(shards, vnodes, ticks), capacity),
        "tick int, home_shard int, first long, last long, shard int, first_slot long",
    )
    before = F.sum("n").over(Window.partitionBy("tick").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = slices.select("tick", "salt", F.coalesce(before, F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("tick", "salt").orderBy("doc_id", "text_crc32", "size"))
    ranked = rows.join(starts, ["tick", "salt"]).withColumn("rank", F.col("start") + rank - 1)
    return (
        ranked.join(F.broadcast(segments), "tick")  # bounded by ticks, virtual nodes and shards
        .where("rank >= first and rank < last")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("first_slot") + F.col("rank") - F.col("first")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "home_shard",
            (F.col("shard") != F.col("home_shard")).alias("moved"),
        )
    )


def op2_sharding(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents"))
