"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a budget of words. Whole passes over the source cover what the budget holds of
them; for the rest, documents are counted by exact length and a number of documents is chosen for each
length: a proportional share first, then a bounded knapsack over what is left. Which documents of a
length are taken is a seeded draw.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import materialise, row_hash, salts, ship_package, table
from trawl.operators.ingest import assign_ids

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Words up to which the knapsack is solved exactly; what is above is filled in seeded order first, and in scaled words if only longer texts are left.
KNAPSACK_WORDS = 32_768
#: Up to this many, sources are joined by broadcast.
BROADCAST_SOURCES = 100_000


def share_targets(sizes: list[int], weights: list[float], epochs: int) -> list[float]:
    """Targets that sum to all sizes by weight, none above epochs * size: the excess is shared anew by weight."""
    total, target, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = total / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > epochs * sizes[i]]
        if not over:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in over:
            target[i] = float(epochs * sizes[i])
            total -= target[i]
            open_.remove(i)
    return target


def _knapsack(lengths: list[int], free: list[int], left: int, order: list[int], most: int) -> list[int]:
    """How many more of each length bring the sum nearest to ``left``; sums are looked at up to ``left`` and one more text of at most ``most``."""
    more = [0] * len(lengths)
    limit = left + min(max(lengths), most)
    mask, reach, history = (1 << (limit + 1)) - 1, 1, []
    for i in order:
        n, rest, part = lengths[i], min(free[i], limit // lengths[i]), 1
        while rest > 0:  # binary split of a bounded item
            k = min(part, rest)
            history.append((i, k, reach))
            reach |= (reach << (n * k)) & mask
            rest -= k
            part *= 2
        if reach >> left & 1:
            break
    sums = np.flatnonzero(np.unpackbits(np.frombuffer(reach.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little"))
    at = int(sums[np.argmin(np.abs(sums - left))])
    for i, k, before in reversed(history):
        if not before >> at & 1:
            more[i] += k
            at -= k * lengths[i]
    return more


def fit_budget(lengths: list[int], counts: list[int], budget: int, seed: str, knapsack: int = KNAPSACK_WORDS) -> list[int]:
    """How many documents of each length to take so that their words come as near to ``budget`` as the knapsack finds.

    If the proportional share leaves no way to hit a budget that the knapsack can solve whole, it is solved whole."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if not total or budget <= 0:
        return [0] * len(lengths)
    words = lambda taken: sum(n * t for n, t in zip(lengths, taken, strict=True))
    take = [min(c, c * budget // total) for c in counts]
    left = budget - words(take)
    order = sorted(range(len(lengths)), key=lambda i: hashlib.sha256(f"{seed}/{lengths[i]}".encode()).digest())
    for i in order:  # whole documents in seeded order, down to what the knapsack solves
        if left <= knapsack:
            break
        more = min(counts[i] - take[i], max(0, left - knapsack // 2) // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    def closer(base, unit=1):
        """``base`` and what the knapsack adds to it, over words in units."""
        gap = round((budget - words(base)) / unit)
        if gap <= 0 or gap > knapsack:
            return base
        free = [c - t for c, t in zip(counts, base, strict=True)]
        more = _knapsack([max(1, round(n / unit)) for n in lengths], free, gap, order, knapsack)
        return [t + m for t, m in zip(base, more, strict=True)]

    take = closer(take)
    if words(take) == budget:
        return take
    tries = [take]
    if budget <= knapsack:
        tries.append(closer([0] * len(lengths)))
    else:  # texts longer than what was left: in words scaled to the knapsack, from the share and from nothing
        for base in ([min(c, c * budget // total) for c in counts], [0] * len(lengths)):
            tries.append(closer(closer(base, -(-2 * (budget - words(base)) // knapsack) or 1)))
        gap, free = budget - words(take), [i for i in order if take[i] < counts[i]]
        if gap > 0 and free:
            best = min(free, key=lambda i: abs(gap - lengths[i]))
            tries.append([t + (i == best) for i, t in enumerate(take)])
    return min(tries, key=lambda t: abs(budget - words(t)))


def shared_targets(by_source: DataFrame, weights: tuple[float, ...], epochs: int) -> DataFrame:
    """``share_targets`` for any number of sources (source, source_size): adds sid, from 0 in code-point order with null last, and target.

    A source is full when the common unit, the words a weight of 1 gets, passes epochs * size / weight. The unit starts as if none were
    full and only grows, by one aggregate a round, until no more sources are full."""
    order = F.struct(F.col("source").isNull().alias("last"), F.col("source"))
    rows = assign_ids(by_source.withColumn("at", order), -1, "sid", "at").drop("at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    rows = materialise(rows.withColumn("weight", weight).withColumn("most", (epochs * F.col("source_size")).cast("double")))
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    unit, full = 0.0, -1
    while True:
        over = F.col("weight") * unit > F.col("most")
        seen = rows.agg(F.count_if(over).alias("full"), F.sum(F.when(over, F.col("most"))).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if seen["full"] == full or not seen["open"]:
            break
        full, unit = seen["full"], (total - (seen["held"] or 0.0)) / seen["open"]
    return rows.withColumn("target", F.least(F.col("most"), F.col("weight") * unit)).drop("weight", "most")


def _fit(seed: str, knapsack: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable")
        budget = int(pdf["budget"].iat[0])
        take = fit_budget(pdf["size"].tolist(), pdf["n"].tolist(), budget, f"{seed}/{pdf['sid'].iat[0]}", knapsack)
        return pd.DataFrame({"sid": pdf["sid"], "size": pdf["size"], "quota": np.array(take, dtype=np.int64)})

    return fit


def word_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark) of each row: the number of words, a null text having none, and a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    own = F.col("doc_id").cast("long"), F.col("source").cast("string")
    return docs.select(own[0].alias("doc_id"), own[1].alias("source"), size.alias("size"), F.xxhash64(text).alias("mark"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = "mix-1",
    knapsack: int = KNAPSACK_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, times, taken.

    size is the number of words (a null text has none). Sources are taken in code-point order, null
    last, and weigh ``weights`` in turn. ``times`` says how often the mix takes the row (at most
    ``max_epochs``) and ``taken`` is times * size. Empty rows are never taken. The draw depends on the seed,
    doc_id and text alone, so reruns agree; rows that repeat a doc_id are drawn one by one, and those that repeat its text, too, are alike. Only doc_id, source and text are read, whatever other columns
    are called; very long texts are rows like others. An empty table gives an empty result.
    """
    return _mixed(docs, weights, max_epochs, seed, knapsack).select("doc_id", "size", "source_size", "target", "times", "taken")


def _mixed(docs, weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed="mix-1", knapsack=KNAPSACK_WORDS) -> DataFrame:
    """The rows of ``mix`` with their source and the hash of their text."""
    ship_package(docs.sparkSession)
    rows = materialise(word_sizes(docs).withColumn("draw", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("mark"))))
    stats = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    by_source = stats.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    goals = shared_targets(by_source, weights, max_epochs)
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size") + 1e-12))).otherwise(0).cast("int")
    goals = goals.withColumn("passes", passes)
    rest = F.when(F.col("passes") < max_epochs, F.round(F.col("target") - F.col("passes") * F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("budget", F.greatest(rest.cast("long"), F.lit(0).cast("long"))).withColumnRenamed("source", "goal_source")
    goals = materialise(goals)
    total = goals.agg(F.count(F.lit(1)).alias("sources"), F.sum("rows").alias("rows")).first()
    goals = goals.drop("rows")
    if total["sources"] <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    here = F.col("source").eqNullSafe(F.col("goal_source"))
    lengths = stats.join(goals, here).where("size > 0 and budget > 0")
    quotas = lengths.select("sid", "size", "n", "budget").groupBy("sid").applyInPandas(_fit(seed, knapsack), "sid int, size long, quota long")

    slices = F.pmod("draw", F.lit(salts(total["rows"] or 0))).cast("int")
    tagged = rows.join(goals, here).withColumn("salt", slices)
    cells = tagged.where("size > 0 and budget > 0").groupBy("sid", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("before", F.coalesce(before, F.lit(0))).join(quotas, ["sid", "size"])
    cells = cells.select("sid", "size", "salt", (F.col("quota") - F.col("before")).alias("left")).where("left > 0")
    place = F.row_number().over(Window.partitionBy("sid", "size", "salt").orderBy("draw", "doc_id", "mark"))
    more = (F.col("place") <= F.coalesce("left", F.lit(0))).cast("int")
    return (
        tagged.withColumn("place", place)
        .join(cells, ["sid", "size", "salt"], "left")
        .withColumn("times", F.when(F.col("size") > 0, F.col("passes") + more).otherwise(0))
        .select("doc_id", "source", "mark", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every taken row as often as it is taken, with the columns of ``docs``, whatever they are called.

    Rows are told apart by doc_id, source and text; rows that repeat all three share what the mix takes of them, each as often as
    the next or once more, by the hash of all their columns. An empty table gives an empty one.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "source", "text")}

    def key(doc_id, source, mark):
        return F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("-")), mark, F.coalesce(F.concat(F.lit("+"), source), F.lit("-")))

    mark = F.xxhash64(F.coalesce(at["text"], F.lit("")))
    plain = docs.toDF(*names).withColumn("row_key", key(at["doc_id"].cast("long"), at["source"].cast("string"), mark))
    times = _mixed(docs, **options).groupBy(key(F.col("doc_id"), F.col("source"), F.col("mark")).alias("row_key"))
    times = times.agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("n")).where("times > 0")
    times = materialise(times.select("row_key", F.floor(F.col("times") / F.col("n")).cast("int").alias("each"), (F.col("times") % F.col("n")).alias("over")))
    found = plain.join(times.hint("shuffle_hash"), "row_key")
    out = found.where("over = 0").withColumn("copies", F.col("each"))
    if not times.where("over > 0").isEmpty():
        turn = F.row_number().over(Window.partitionBy("row_key").orderBy(row_hash(names)))
        out = out.unionByName(found.where("over > 0").withColumn("copies", F.col("each") + (turn <= F.col("over")).cast("int")))
    out = out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op9_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
