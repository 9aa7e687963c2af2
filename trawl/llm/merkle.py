"""A Merkle manifest of a dataset, kept as a persistent tree with path copying.

Every row is a leaf, every source a tree over its leaves in order, and the sources' roots are the leaves of a top tree. Trees are
cut into aligned blocks of ``3 ** levels`` nodes: a task builds a block's levels, the blocks' tops are the leaves of the next, much smaller
round, and so on up to one node a tree. A changed leaf makes a new version of its tree. The version shares every node that does not lie
above the leaf and copies only the ancestors inside the leaf's block; its path above the block goes on through the upper
rounds, whose untouched nodes each block learns from a join of block tops. No version holds a copy of a tree, and no task
holds more than a block and the path above it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import materialise, numpy_groups, release, ship_package, table

FANOUT, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*fields: Column) -> Column:
    """The hash of a row's fields: each its UTF-8 length, a colon and itself, or a hyphen if it is null."""

    def framed(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[framed(c) for c in fields]), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """Adds ``pos``, from 0 inside each ``tree``, by ``order``, and the tree's ``size``; both without a tree's rows in one task.

    Rows are range-partitioned and written once; a partition's rows of a tree follow those of the partitions before."""
    placed = materialise(rows.repartitionByRange(F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]).withColumn("part", F.spark_partition_id()))
    counts = materialise(placed.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("here")))  # a row for each tree that a partition holds
    before = F.sum("here").over(Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(tree).alias("at_tree"), F.col("part").alias("at_part"), F.coalesce(before, F.lit(0)).alias("offset"))
    sizes = counts.groupBy(F.col(tree).alias("of_tree")).agg(F.sum("here").alias("size"))
    turn = F.row_number().over(Window.partitionBy("part", tree).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    found = placed.withColumn("turn", turn)
    found = found.join(offsets, F.col(tree).eqNullSafe(F.col("at_tree")) & (F.col("part") == F.col("at_part")))
    found = found.join(sizes, F.col(tree).eqNullSafe(F.col("of_tree")))
    return found.withColumn("pos", F.col("offset") + F.col("turn") - 1).drop("part", "at_tree", "at_part", "of_tree", "offset", "turn")


class Block:
    """A block's nodes, level by level, and versions of it that share them."""

    def __init__(self, nodes: list[str], levels: int):
        self.levels = [nodes]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[str]:
        """What is hashed beside the path from a node, from below."""
        out = []
        for nodes in self.levels[:-1]:
            first = at - at % FANOUT
            out += [nodes[i] for i in range(first, min(first + FANOUT, len(nodes))) if i != at]
            at //= FANOUT
        return out

    def version(self, at: int, leaf: str) -> list[str]:
        """The copied path of a version with another leaf: the leaf and its ancestors, the block's new top last. All other nodes are shared."""
        path = [leaf]
        for nodes in self.levels[:-1]:
            first = at - at % FANOUT
            path.append(digest([path[-1] if i == at else nodes[i] for i in range(first, min(first + FANOUT, len(nodes)))]))
            at //= FANOUT
        return path


def height(size: int) -> int:
    """Levels over so many nodes."""
    n = 0
    while size > 1:
        size, n = -(-size // FANOUT), n + 1
    return n


def folded(top: str, above: list[tuple[list[str], list[str]]]) -> str:
    """What a node becomes at the end of a path; ``above`` has the nodes left and right of it at each level."""
    for left, right in above:
        top = digest([*left, top, *right])
    return top


_PATH = "above array<struct<left:array<string>,right:array<string>>>"


def _climb(levels: int):
    """The tops of blocks, and for each node of a block the path inside it."""

    def run(batches):
        for rows in numpy_groups(batches, ["tree", "block"]):
            order = np.argsort(rows["pos"], kind="stable")
            block = Block(rows["node"][order].tolist(), min(levels, height(int(rows["size"][0]))))
            paths = []
            for i in range(len(order)):
                path, at = [], i
                for nodes in block.levels[:-1]:
                    first = at - at % FANOUT
                    path.append({"left": nodes[first:at], "right": nodes[at + 1 : first + FANOUT]})
                    at //= FANOUT
                paths.append(path)
            n = len(order)
            columns = [rows["tree"], rows["block"], rows["pos"][order], [block.top] * n, paths]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["tree", "block", "pos", "top", "above"])

    return run


def _tops(levels: int):
    def run(batches):
        for rows in numpy_groups(batches, ["tree", "block"]):
            order = np.argsort(rows["pos"], kind="stable")
            size = int(rows["size"][0])
            block = Block(rows["node"][order].tolist(), min(levels, height(size)))
            columns = [[int(rows["tree"][0])], [int(rows["block"][0])], [-(-size // FANOUT**levels)], [block.top]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["tree", "pos", "size", "node"])

    return run


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes (tree, pos, size, node, ...) with their block, a block's side by side."""
    held = nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**levels))
    return held.repartition("tree", "block").sortWithinPartitions("tree", "block")


def upper_paths(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """For every node (tree, pos, size, node) its tree's ``root`` and the path ``above`` it: what is hashed to its left and right, a
    level after the other. Works in rounds of ``levels``; each round but the first holds one node in 3 ** levels of the last."""
    inside = materialise(_blocks(nodes, levels).select("tree", "block", "pos", "size", "node").mapInArrow(_climb(levels), f"tree long, block long, pos long, top string, {_PATH}"))
    tops = inside.groupBy("tree", "block").agg(F.first("top").alias("node"))
    sizes = nodes.select("tree", F.ceil(F.col("size") / FANOUT**levels).alias("size")).distinct()
    if sizes.where("size > 1").isEmpty():
        return inside.select("tree", "pos", F.col("top").alias("root"), "above")
    uppers = tops.join(sizes, "tree").select("tree", F.col("block").alias("pos"), "size", "node")
    upper = upper_paths(materialise(uppers), levels).select("tree", F.col("pos").alias("block"), "root", F.col("above").alias("upper"))
    return inside.join(upper, ["tree", "block"]).select("tree", "pos", "root", F.concat("above", "upper").alias("above"))


def _versions(levels: int):
    """Proofs and the roots of versions, for all leaves of a block."""
    names = ["doc_id", "tree", "pos", "leaf", "proof_sha256", "version_path", "folded_root"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]

    def run(batches):
        for rows in numpy_groups(batches, ["tree", "block"]):
            order = np.argsort(rows["pos"], kind="stable")
            block = Block(rows["node"][order].tolist(), min(levels, height(int(rows["size"][0]))))
            above = [(list(step["left"]), list(step["right"])) for step in rows["above"][0]]
            shared = [node for left, right in above for node in (*left, *right)]
            changed, out = rows["changed"][order].tolist(), [[] for _ in names]
            ids, known, trees, places = rows["doc_id"][order].tolist(), rows["known"][order].tolist(), rows["tree"].tolist(), rows["pos"][order].tolist()
            for at, leaf in enumerate(block.levels[0]):
                path = block.version(at, changed[at])
                own = (ids[at] if known[at] else None, trees[at], places[at], leaf, digest(block.siblings(at) + shared), path if changed[at] != leaf else [], folded(path[-1], above))
                for column, value in zip(out, own, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return run


def merkle_manifest(docs: DataFrame, changed_text: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, pos, leaf, subroot, root, proof_sha256, version_path, folded_root, verified.

    A row's leaf is the hash of doc_id, source, lang, n_chars and text, nulls told from empty values. A source's leaves (null is a source)
    stand in the order of doc_id, nulls first, rows of equal ids by their leaves (rows equal in all five are interchangeable); ``pos`` counts
    them from 0. Every ``FANOUT`` nodes become their hash up to ``subroot``; subroots, null first, then by UTF-8 bytes,
    become ``root``. ``proof_sha256`` is the hash of all siblings on the way. ``changed_text`` gives each row's text as it is read again:
    ``version_path`` holds the copied nodes of the version with that leaf inside its block (none if the leaf is the same),
    ``folded_root`` that version's root, ``verified`` tells if it is ``root``. Other columns are not read, whatever they are called. Very long texts
    are hashed where they are and never travel. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    own = [F.col(c) for c in FIELDS]
    own[0] = own[0].cast("long")
    changed = own[-1] if changed_text is None else changed_text
    rows = docs.select(own[0].alias("doc_id"), own[1].cast("string").alias("source"), leaf_hash(*own).alias("node"), leaf_hash(*own[:-1], changed).alias("changed"))
    rows = materialise(rows)  # texts are hashed once, not again for the bounds of ranges
    leaves = numbered(rows, "source", "doc_id", "node")

    # sources are numbered in their order, by the same means as leaves
    sources = numbered(leaves.groupBy("source").agg(F.first("size").alias("leaves")).withColumn("all", F.lit(0)), "all", "source")
    sources = materialise(sources.select(F.col("source").alias("of_source"), F.col("pos").alias("tree"), "leaves"))
    leaves = materialise(leaves.join(sources.select("of_source", "tree"), F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source"))

    first = _blocks(leaves.select("tree", "pos", "size", "node"), levels)
    tops = materialise(first.mapInArrow(_tops(levels), "tree long, pos long, size long, node string"))
    inner = materialise(upper_paths(tops, levels))  # of blocks, inside their source
    roots = materialise(inner.groupBy("tree").agg(F.first("root").alias("subroot")))
    size = roots.count()
    outer = upper_paths(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(size).cast("long").alias("size"), F.col("subroot").alias("node")), levels)
    outer = outer.select(F.col("pos").alias("tree"), F.col("root").alias("whole_root"), F.col("above").alias("outer"))
    paths = inner.join(outer, "tree").select(
        F.col("tree").alias("of_tree"), F.col("pos").alias("of_block"), F.concat("above", "outer").alias("above"), F.col("root").alias("subroot"), F.col("whole_root").alias("root")
    )
    paths = materialise(paths)

    # the path above a block goes with its first leaf alone
    held = leaves.withColumn("block", F.floor(F.col("pos") / FANOUT**levels)).withColumn("known", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    head = paths.select("of_tree", "of_block", "above").withColumn("of_pos", F.col("of_block") * FANOUT**levels)
    held = held.join(head, (F.col("tree") == F.col("of_tree")) & (F.col("pos") == F.col("of_pos")), "left")
    held = held.select("doc_id", "known", "tree", "block", "pos", "size", "node", "changed", "above")
    held = held.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    schema = "doc_id long, tree long, pos long, leaf string, proof_sha256 string, version_path array<string>, folded_root string"
    found = held.mapInArrow(_versions(levels), schema)
    ends = roots.join(outer.select("tree", "whole_root"), "tree").join(sources.select("tree", "of_source"), "tree")
    ends = materialise(ends.select("tree", F.col("of_source").alias("source"), "subroot", F.col("whole_root").alias("root")))
    release(tops)
    return found.join(ends, "tree").select("doc_id", "source", "pos", "leaf", "subroot", "root", "proof_sha256", "version_path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    read = F.when(even, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    return merkle_manifest(docs, read).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def oracle_sql(levels: int = 16) -> str:
    """The same rows in DuckDB SQL, level by level, for trees of up to 3 ** levels nodes. DuckDB has no crc32: it is a running
    remainder over the id's digits."""
    framed = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(framed(c) for c in FIELDS[:-1])} || {framed(text)})"

    def tree(name: str, base: str, partition: str) -> str:
        """From base(s, pos, node, n) to name(s, pos, root, before, folds): the levels up to a single node."""
        parts = [f"{name}0 AS (SELECT s, pos, node, n FROM {base})"]
        for k in range(levels):
            parts.append(
                f"{name}{k + 1} AS (SELECT s, pos // 3 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node, (any_value(n) + 2) // 3 AS n FROM {name}{k} GROUP BY s, pos // 3)"
            )
        return ", ".join(parts)

    def paths(name: str, start: str) -> str:
        """From start(id, s, pos, fold, proof) over the levels of name: fold and proof at the end."""
        parts = [f"{name}p0 AS (SELECT * FROM {start})"]
        for k in range(levels):
            parts.append(
                f"""{name}p{k + 1} AS (SELECT id, p.s, p.pos // 3 AS pos,
  CASE WHEN any_value(n) > 1 THEN sha256(coalesce(string_agg(l.node, '' ORDER BY l.pos) FILTER (l.pos < p.pos), '') || any_value(fold) || coalesce(string_agg(l.node, '' ORDER BY l.pos) FILTER (l.pos > p.pos), '')) ELSE any_value(fold) END AS fold,
  any_value(proof) || CASE WHEN any_value(n) > 1 THEN coalesce(string_agg(l.node, '' ORDER BY l.pos) FILTER (l.pos <> p.pos), '') ELSE '' END AS proof
FROM {name}p{k} p JOIN {name}{k} l ON l.s = p.s AND l.pos // 3 = p.pos // 3 GROUP BY id, p.s, p.pos)"""
            )
        return ", ".join(parts)

    crc = "xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(d) + 1), lambda i: ascii(substring(d, i, 1))::BIGINT)), lambda h, c: "
    step = "xor(h, c)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda y: xor(y >> 1, (y & 1) * 3988292384))[1]"
    crc += step + "))"
    return f"""WITH d AS (SELECT *, doc_id::VARCHAR AS d, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM documents),
h AS (SELECT *, {crc} AS crc FROM d),
leaf AS (SELECT doc_id AS id, s, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS pos, {leaf('text')} AS node, count(*) OVER (PARTITION BY s) AS n,
         {leaf("CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS changed FROM h),
{tree('a', 'leaf', 's')}, {paths('a', "(SELECT id, s, pos, changed AS fold, '' AS proof FROM leaf)")},
sub AS (SELECT 0 AS s, s AS pos, node, count(*) OVER () AS n FROM a{levels}),
{tree('b', 'sub', 's')}, {paths('b', f"(SELECT id, 0 AS s, s AS pos, fold, proof FROM ap{levels})")}
SELECT leaf.id AS doc_id, leaf.node AS leaf, a{levels}.node AS subroot, b{levels}.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b{levels}.node AS verified
FROM leaf JOIN a{levels} USING (s) JOIN bp{levels} ON bp{levels}.id = leaf.id, b{levels}"""
