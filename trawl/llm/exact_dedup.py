"""Exact dedup by deterministic block naming.

Texts are cut into fixed-size blocks. Distinct blocks are sorted into integer names; then adjacent
names are paired and the distinct pairs named, again and again, until each document has one name.
Names come from sorting contents, never from hashing them alone, so equal names mean equal texts.

Only one copy of a block per input partition travels: tasks replace repeats by a reference to
the copy they have seen first, so a text that fills a third of the corpus meets its sorter once per
partition, and its documents learn their name over a join on narrow integer keys.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import keep_rows, materialise, release, ship_package, table

BLOCK_CHARS = 16_384
HELD_CHARS = 48_000_000
_BLOCKS = "rid long, doc_id long, text_sha256 string, pos int, n int, rep_rid long, rep_pos int, block string"


def _cut(block_chars: int, held_chars: int):
    def cut(batches):
        seen: dict[str, tuple[int, int]] = {}
        held = 0
        for batch in batches:
            rids, ids, shas = (batch.column(k).to_pylist() for k in ("rid", "doc_id", "text_sha256"))
            out: list[list] = [[] for _ in range(8)]
            for rid, doc_id, sha, text in zip(rids, ids, shas, batch.column("text").to_pylist(), strict=True):
                n = max(1, -(-len(text) // block_chars))
                for pos in range(n):
                    block = text if n == 1 else text[pos * block_chars : (pos + 1) * block_chars]
                    rep = seen.get(block)
                    if rep is None:
                        rep = seen[block] = (rid, pos)
                        held += len(block)
                        own = block
                    else:
                        own = None
                    for column, value in zip(out, (rid, doc_id, sha if pos == 0 else None, pos, n, *rep, own), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string())
            names = [f.split()[0] for f in _BLOCKS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
            if held > held_chars:  # the sorter also merges what two copies of a dictionary hold
                seen, held = {}, 0

    return cut


def _names(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Adds ``name``: the rank of the keys among the sorted distinct keys of their hash bucket, with the bucket above it."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*keys))
    return df.withColumn("bucket", bucket).withColumn("name", F.shiftleft("bucket", 36) + rank)


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS, held_chars: int = HELD_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Uses only ``doc_id`` and ``text``; other columns are ignored. A null text counts as empty. Of equal
    texts the row with the largest doc_id stays (a null doc_id ranks lowest; of repeated rows with the
    same doc_id just one stays). Very long texts are cut into blocks, which no task holds together. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.sha2(text, 256).alias("text_sha256"),
    )
    blocks = materialise(rows.mapInArrow(_cut(block_chars, held_chars), _BLOCKS))
    size = blocks.agg(F.count("block").alias("blocks"), F.max("n").alias("longest")).first()
    buckets = max(1024, size["blocks"] // 20_000)

    own = blocks.where(F.col("block").isNotNull()).select("rep_rid", "rep_pos", "block")
    own = _names(own, ["block"], buckets).select("rep_rid", "rep_pos", "name")
    first = blocks.select("rid", "pos", "n", "rep_rid", "rep_pos").join(own, ["rep_rid", "rep_pos"])
    first = materialise(first.select("rid", "pos", "n", "name"))
    named = [first.where("n = 1").select("rid", F.lit(0).alias("level"), "name")]
    open_, level, longest = first.where("n > 1"), 0, size["longest"] or 1
    while longest > 1:
        level, longest = level + 1, -(-longest // 2)
        pairs = open_.groupBy("rid", (F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.ceil(F.max("n") / 2).cast("int").alias("n"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = materialise(pairs)
        known = _names(pairs.select("a", "b").distinct(), ["a", "b"], buckets).select("a", "b", "name")
        done = materialise(pairs.join(known, ["a", "b"]).select("rid", "pos", "n", "name"))
        named.append(done.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        open_ = done.where("n > 1")
    identity = named[0]
    for more in named[1:]:
        identity = identity.unionByName(more)

    heads = blocks.where("pos = 0").select("rid", "doc_id", "text_sha256")
    rows = materialise(heads.join(identity, "rid"))
    release(blocks)
    groups = rows.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    groups = materialise(groups)  # so that the join deals rows of a hot group to many tasks
    return rows.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, whole."""
    return keep_rows(docs, exact_dedup(docs))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
