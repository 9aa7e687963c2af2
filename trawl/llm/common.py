"""Shared pieces of the corpus operators: scratch tables, readers, grouped streams, components."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.scratch import materialise, release, ship_package

def dealt(df: DataFrame, rows: int, per_task: int, *keys: str) -> DataFrame:
    """Rows with equal ``keys`` side by side, in tasks of about ``per_task`` of the ``rows``; their number is set, so that small
    rows that cost much work are not put together in a few tasks."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task))
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys)


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, text_sha256, kept; a row for each of docs) keeps, with all their columns.

    Texts are shuffled once, unsorted, to the keys of the rows that go. Rows that repeat both doc_id and text, of which one
    stays, are the only ones that are grouped whole; each task puts forward one of them, and of all the one with the smallest hash of its
    columns stays, so that reruns agree."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))

    def key(doc_id, sha):
        return F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("-")), sha)

    plain = plain.withColumn("row_key", key(doc_id, F.sha2(F.coalesce(text, F.lit("")), 256)))
    marks = decided.groupBy(key(F.col("doc_id"), F.col("text_sha256")).alias("row_key")).agg(
        F.count_if("kept").alias("stay"), F.count(F.lit(1)).alias("n")
    )
    marks = materialise(marks.where("stay < n").select("row_key", "stay"))
    marked = plain.join(marks.hint("shuffle_hash"), "row_key", "left")
    found = marked.where("stay is null").drop("stay")
    if not marks.where("stay > 0").isEmpty():
        repeated = marked.where("stay > 0").groupBy("row_key").agg(F.min_by(F.struct(*names), row_hash(names)).alias("one"))
        found = found.select(*names).unionByName(repeated.select("one.*"))
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def row_hash(names: list[str]):
    """A hash of whole rows, by the columns in ``names``; ``to_json`` takes columns of all types."""
    return F.xxhash64(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salts(rows: int, per_salt: int = 5_000_000, least: int = 16) -> int:
    """How many salts split one hot key so that no slice of it exceeds about ``per_salt`` rows."""
    return max(least, -(-rows // per_salt))


def numpy_groups(batches, keys: list[str]):
    """Yield a dict of arrays for each run of equal ``keys`` in Arrow batches that are sorted by them. Binary columns come
    as object arrays."""
    held: list[dict[str, np.ndarray]] = []

    def joined():
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0]

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
        if held and any(held[0][k][0] != columns[k][0] for k in keys):
            yield joined()
            held = []
        new = np.zeros(n - 1, bool)
        for k in keys:
            new |= columns[k][1:] != columns[k][:-1]
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        for start, end in zip(starts, starts[1:], strict=False):
            held.append({c: v[start:end] for c, v in columns.items()})
            if end < n:
                yield joined()
                held = []
    if held:
        yield joined()


def joined_batches(batches, rows: int = 20_000):
    """The same rows in fewer, larger Arrow batches."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def text_slices(batch, chars: int):
    """(rows, texts) of an Arrow batch with a column ``text``, in slices of about ``chars`` bytes of text, a longer text alone."""
    lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    start = 0
    while start < batch.num_rows:
        within = int(np.searchsorted(np.cumsum(lengths[start : start + chars]), chars, side="right"))
        part = batch.slice(start, max(1, within))
        yield part, part.column("text").to_pylist()
        start += part.num_rows


class Forest:
    """Union-find over hashable ids."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        if x not in parent:
            parent[x] = x
            return x
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, x, y) -> bool:
        """Join the sets of x and y; False if they were one already."""
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the graph with edges (a, b): one row (node, component) per node that has an
    edge to another node; ``component`` is the smallest node of its component.

    Each round, every node hooks to its lowest neighbour (a map-side combined minimum), hooks are shortened by three
    pointer jumps, and edges are contracted to distinct edges between what is left. Lowest means smallest in odd rounds, so that
    stars around their smallest node end at once, and first under a random order in even ones, so that the edge table shrinks by a
    constant factor whatever the numbers are.
    """
    edges = materialise(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    )
    members: DataFrame | None = None
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.union(edges.select("b", "a"))
        if turn % 2:
            hooks = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("low", "a").alias("up"))
        else:

            def rank(c, turn=turn):
                return F.struct(F.xxhash64(F.lit(turn), c).alias("r"), c.alias("id"))

            hooks = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("low"))
            hooks = hooks.select(F.col("a").alias("node"), F.least(F.col("low"), rank(F.col("a"))).getField("id").alias("up"))
        direct = hooks = materialise(hooks)
        for _ in range(3):
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            hooks = hooks.join(above, "up").select("node", F.col("upper").alias("up"))
        hooks = materialise(hooks)
        if members is None:
            members, spent = hooks, [direct]
        else:
            spent = [direct, members]
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            members = materialise(members.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("up")))
        left = hooks.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right = hooks.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        contracted = edges.join(left, "a").join(right, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        spent += [edges] if hooks is members else [edges, hooks]
        edges = materialise(contracted.where("a <> b").distinct())
        release(*spent)
    if members is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    lowest = members.groupBy("up").agg(F.min("node").alias("component"))
    return members.join(lowest, "up").select("node", "component")
