"""Secret scans with multipart credential linking, in DataFrame functions only.

Patterns that are secrets by themselves are reported wherever they match. Parts that are weak alone - an
account name, a long random-looking string, an endpoint - are reported only when complementary parts
stand within one scope: spans are put into position bins and joined on (row, bin) under the interval
condition, as semi and anti joins, so that no pairs are emitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import materialise, table

#: Kind, pattern, capture group that the length is asked of, least length.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Parts that are weak alone.
WEAK = [
    ("part_id", r"""(?i)(?:client_id|key_id|account|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", 0, 0),
    ("part_secret", r"[A-Za-z0-9+/]{32,}={0,2}", 0, 0),
    ("part_endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?", 0, 0),
]
#: A row is searched with a pattern only if this holds for it; each is implied by a match.
MIGHT = {
    "assign": lambda t: _any(F.lower(t), "password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": lambda t: F.contains(t, F.lit("AKIA")),
    "hex": lambda t: t.rlike("[0-9a-f]{24}"),
    "part_id": lambda t: _any(F.lower(t), "client_id", "key_id", "account", "user", "login"),
    "part_secret": lambda t: t.rlike("[A-Za-z0-9+/]{32}"),
    "part_endpoint": lambda t: F.contains(t, F.lit("://")),
}
KINDS = [k for k, *_ in BASE + WEAK]
SCOPE = 400


def _any(text, *words):
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return found


def _pieces(kind: str, pattern: str, group: int, least: int):
    """Matches of a pattern in order: the text's length before each, counted from the match before, its own length, and if it holds."""
    text = F.col("text")
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), sizes.alias("own")),
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("i"),
            F.char_length(x["gap"]).alias("gap"),
            F.char_length(x["hit"]).alias("hit"),
            (F.char_length(x["own"]) >= least).alias("holds"),
        ),
    )
    return F.when(MIGHT[kind](text), rows).otherwise(F.array())


def _near(spans: DataFrame, scope: int) -> DataFrame:
    """The spans under other names, each put into its own bin and the two beside it."""
    bins = F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1))
    return spans.select("rid", bins.alias("bin"), F.col("start").alias("near_start")).distinct()


def link_parts(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Of spans (rid, kind, start, end), the weak ones that are confirmed: an identifier by a secret in scope, a
    secret by an identifier, an endpoint by both. In scope means that starts lie at most ``scope`` code points
    apart. A weak secret that overlaps a base span is not reported again."""
    spans = spans.withColumn("bin", F.floor(F.col("start") / scope).cast("long"))
    of = lambda *names: spans.where(F.col("kind").isin([KINDS.index(n) for n in names]))
    in_scope = F.abs(F.col("start") - F.col("near_start")) <= scope

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        near = _near(right, scope)
        return left.join(near, (left["rid"] == near["rid"]) & (left["bin"] == near["bin"]) & in_scope, "left_semi")

    def covering(spans: DataFrame) -> DataFrame:
        """The spans in every bin that they reach into: two that overlap meet in one, however long they are."""
        return spans.withColumn("bin", F.explode(F.sequence(F.col("bin"), F.floor(F.col("end") / scope).cast("long"))))

    base = covering(of("assign", "access", "hex")).select("rid", "bin", F.col("start").alias("near_start"), F.col("end").alias("near_end"))
    weak = covering(of("part_secret"))
    overlap = (F.col("start") < F.col("near_end")) & (F.col("near_start") < F.col("end"))
    covered = weak.join(base, (weak["rid"] == base["rid"]) & (weak["bin"] == base["bin"]) & overlap, "left_semi").select("rid", "start", "end").distinct()
    secrets = of("part_secret").join(covered, ["rid", "start", "end"], "left_anti")
    ids = of("part_id", "access")
    any_secret = of("assign", "hex").unionByName(secrets)
    linked = [
        beside(of("part_id"), any_secret),
        beside(secrets, ids),
        beside(beside(of("part_endpoint"), ids), any_secret),
    ]
    return linked[0].unionByName(linked[1]).unionByName(linked[2]).drop("bin")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then kind; ``base_sha256`` is the
    digest of the base ones alone. A null text counts as empty and has no spans; repeated rows are
    scanned one by one. Only doc_id and text are read; an empty table gives an empty result.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    pieces = F.concat(*[_pieces(*p) for p in BASE + WEAK])
    rows = materialise(rows.select("rid", "doc_id", pieces.alias("pieces")))
    each = rows.where(F.size("pieces") > 0).select("rid", F.explode("pieces").alias("p")).select("rid", "p.*")
    so_far = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("hit")).over(so_far)
    spans = each.withColumn("end", end).where("holds").select("rid", "kind", (F.col("end") - F.col("hit")).alias("start"), "end")
    spans = materialise(spans)
    base = spans.where(F.col("kind") < len(BASE))
    found = base.unionByName(link_parts(spans, scope))
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(part):
        said = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(part, said), ",")

    def count(kind):
        return F.count_if(F.col("kind") == KINDS.index(kind)).alias(f"n_{kind}")

    per_row = found.groupBy("rid").agg(
        *[count(k) for k, *_ in BASE],
        F.count_if(F.col("kind") >= len(BASE)).alias("n_linked"),
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    every = F.coalesce(F.col("all"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    return rows.select("rid", "doc_id").join(per_row, "rid", "left").select(
        "doc_id",
        zero("n_assign"),
        zero("n_access"),
        zero("n_hex"),
        F.sha2(listed(F.filter(every, lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        zero("n_linked"),
    )


def op10_secrets(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))
