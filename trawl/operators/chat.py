"""Chat logs and prompts in bulk.

Exchanges are (id, session_id, user_message, ai_response, timestamp). Turns are (session_id, turn, role, content, detail).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.scratch import materialise
from trawl.functions.text import strip
from trawl.operators.ingest import assign_ids
from trawl.operators.search import search_records

HISTORY, PART_TURNS = 20, 4_096
DEFAULT_SYSTEM, HEADER, NO_MATCH = "You answer from the records given.", "\n\nRecords:\n", "No record matches."


def append_exchanges(log: DataFrame, new: DataFrame, high_water: int) -> DataFrame:
    """The log with new exchanges (pos, session_id, user_message, ai_response), numbered and stamped."""
    rows = assign_ids(new, high_water, "id").withColumn("timestamp", F.current_timestamp())
    return log.unionByName(rows.select(log.columns))


def recent(exchanges: DataFrame, limit: int = HISTORY) -> DataFrame:
    """The last exchanges of every session; all but ``limit`` rows of a session are gone before anything is gathered."""
    order = Window.partitionBy("session_id").orderBy(F.desc("id"))
    return exchanges.withColumn("back", F.row_number().over(order)).where(F.col("back") <= limit)


def recent_history(exchanges: DataFrame, limit: int = HISTORY) -> DataFrame:
    """(session_id, turns, history): exchanges oldest first."""
    listed = F.sort_array(F.collect_list(F.struct("id", "user_message", "ai_response")))
    return recent(exchanges, limit).groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), listed.alias("history"))


def pair_turns(turns: DataFrame) -> DataFrame:
    """Exchanges of a turn-level log: a user's message and the assistant's turn right after it. The id is the message's turn."""
    order = Window.partitionBy("session_id").orderBy("turn")
    paired = turns.withColumn("next_role", F.lead("role").over(order)).withColumn("answer", F.lead("content").over(order))
    return paired.where("role = 'user' and next_role = 'assistant'").select(
        "session_id", F.col("turn").alias("id"), F.col("content").alias("user_message"), F.col("answer").alias("ai_response")
    )


def split_roles(turns: DataFrame) -> DataFrame:
    """(session_id, system, spoken, profiles): system texts with a newline before each, user and assistant turns in order, profiles as JSON."""
    of = lambda c, v: F.sort_array(F.collect_list(F.when(c, F.struct("turn", v.alias("v")))))
    role = F.col("role")
    said = F.struct("role", "content")
    profile = F.to_json("detail") if "detail" in turns.columns else F.lit(None).cast("string")
    gathered = turns.groupBy("session_id").agg(
        of(role == "system", F.concat(F.lit("\n"), F.coalesce("content", F.lit("")))).alias("system"),
        of(role.isin("user", "assistant"), said).alias("spoken"),
        of((role == "userprofile") & profile.isNotNull(), profile).alias("profiles"),
    )
    values = lambda c: F.transform(c, lambda x: x["v"])
    return gathered.select(
        "session_id", F.array_join(values("system"), "").alias("system"), values("spoken").alias("spoken"), values("profiles").alias("profiles")
    )


def last_question(split: DataFrame) -> DataFrame:
    """Adds question (the last turn if it is a user's, else empty) and earlier (the turns before, a line each)."""
    n = F.size("spoken")
    last = F.element_at("spoken", -1)
    question = F.when((n > 0) & (last["role"] == "user"), F.coalesce(last["content"], F.lit(""))).otherwise(F.lit(""))
    earlier = F.array_join(F.transform(F.slice("spoken", 1, F.greatest(n - 1, F.lit(0))), lambda t: F.coalesce(t["content"], F.lit(""))), "\n")
    return split.withColumn("question", question).withColumn("earlier", earlier)


def questions(turns: DataFrame) -> DataFrame:
    """(session_id, system, question, profiles) as ``last_question`` has them, without a session's turns in a row: of what was spoken only
    the last turn is kept, by a partial aggregate."""
    said = F.when(F.col("role").isin("user", "assistant"), F.struct("turn", "role", "content"))
    last = turns.groupBy("session_id").agg(F.max(said).alias("last"))
    kept = split_roles(turns.where(~F.col("role").isin("user", "assistant"))).drop("spoken").withColumnRenamed("session_id", "__session")
    question = F.when(F.col("last.role") == "user", F.coalesce("last.content", F.lit(""))).otherwise(F.lit(""))
    return last.select("session_id", question.alias("question")).join(kept, F.col("session_id").eqNullSafe(F.col("__session")), "left").select(
        "session_id", F.coalesce("system", F.lit("")).alias("system"), "question", F.coalesce("profiles", F.array().cast("array<string>")).alias("profiles")
    )


def earlier_parts(turns: DataFrame, size: int = PART_TURNS) -> DataFrame:
    """(session_id, part, turns, text): what was said before the last turn of a session, a line each, in parts of ``size`` turns numbered
    from 0; joined by newlines they are ``earlier`` of ``last_question``.

    Turns are dealt in ranges of (session, turn) and written with their range's number, so a long session is in many tasks; its counts a range
    give the turns' places, and no row holds more than a part. Turns of one number go by role and content; null contents are empty lines. A
    session of fewer than two spoken turns has no part."""
    said = turns.where(F.col("role").isin("user", "assistant")).select("session_id", "turn", "role", "content")
    placed = materialise(said.repartitionByRange("session_id", "turn").withColumn("__range", F.spark_partition_id()))
    session = Window.partitionBy("session_id")
    counts = placed.groupBy("session_id", "__range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(session.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        F.col("session_id").alias("__session"), F.col("__range").alias("__at"), F.coalesce(before, F.lit(0)).alias("__before"), F.sum("n").over(session).alias("__total")
    )
    turn = F.row_number().over(Window.partitionBy("session_id", "__range").orderBy("turn", "role", "content"))
    numbered = placed.withColumn("__turn", turn).join(offsets, F.col("session_id").eqNullSafe(F.col("__session")) & (F.col("__range") == F.col("__at")))
    place = F.col("__before") + F.col("__turn") - 1
    kept = numbered.withColumn("place", place).where("place < __total - 1").withColumn("part", F.floor(F.col("place") / size).cast("long"))
    lines = F.sort_array(F.collect_list(F.struct("place", F.coalesce("content", F.lit("")).alias("line"))))
    text = F.array_join(F.transform(lines, lambda t: t["line"]), "\n")
    return kept.groupBy("session_id", "part").agg(F.count(F.lit(1)).alias("turns"), text.alias("text"))


def last_questions(turns: DataFrame, size: int = PART_TURNS) -> DataFrame:
    """(session_id, system, question, profiles, earlier) as ``last_question`` has them, from the parts of what was said earlier: the only row
    that a session's turns meet in is the result's. Sessions too long for that take ``questions`` and ``earlier_parts`` as they are."""
    listed = F.sort_array(F.collect_list(F.struct("part", "text")))
    whole = earlier_parts(turns, size).groupBy(F.col("session_id").alias("__session")).agg(F.array_join(F.transform(listed, lambda p: p["text"]), "\n").alias("earlier"))
    joined = questions(turns).join(whole, F.col("session_id").eqNullSafe(F.col("__session")), "left").drop("__session")
    return joined.withColumn("earlier", F.coalesce("earlier", F.lit("")))


def build_context(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds context: the profiles' JSON, then all hits as one JSON array, a line each; and how many hits there are."""
    fields = F.struct("rank", "data_id", "disease", "symptoms", "cause", "treatment", "score")
    found = hits.groupBy(F.col("query_id").alias("session_id")).agg(F.sort_array(F.collect_list(fields)).alias("hits"))
    joined = questions.join(found, "session_id", "left")
    listed = F.transform("hits", lambda h: h.dropFields("rank"))
    return joined.withColumn("context", F.concat_ws("\n", F.array_join("profiles", "\n"), F.to_json(listed))).withColumn(
        "n_hits", F.when(F.col("hits").isNull(), 0).otherwise(F.size("hits"))
    ).drop("hits").withColumn("context", F.regexp_replace("context", "^\n", ""))


def build_prompts(asked: DataFrame, history: DataFrame, default: str = DEFAULT_SYSTEM, header: str = HEADER, no_match: str = NO_MATCH) -> DataFrame:
    """(session_id, messages): the system prompt with its context, past exchanges as pairs, the question."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    system = F.concat(
        F.when(F.col("system") == "", F.lit(default)).otherwise(F.col("system")),
        F.lit(header),
        F.when(F.col("context") == "", F.lit(no_match)).otherwise(F.col("context")),
    )
    past = F.flatten(F.transform("history", lambda h: F.array(message("user", h["user_message"]), message("assistant", h["ai_response"]))))
    joined = asked.join(history.select("session_id", "history"), "session_id", "left")
    none = F.array().cast("array<struct<role:string,content:string>>")
    messages = F.concat(F.array(message("system", system)), F.coalesce(past, none), F.array(message("user", strip(F.col("question")))))
    return joined.select("session_id", messages.alias("messages"), "n_hits")


def describe_prompt(prompts: DataFrame) -> DataFrame:
    """Adds index and length to every message."""
    described = F.transform(
        "messages",
        lambda m, i: F.struct(i.alias("index"), m["role"].alias("role"), F.char_length(m["content"]).alias("chars"), m["content"].alias("content")),
    )
    return prompts.withColumn("messages", described)


def prompt_stats(prompts: DataFrame) -> DataFrame:
    described = describe_prompt(prompts)
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + m["chars"])
    turns = F.floor((F.size("messages") - 2) / 2).cast("long")
    return described.select("session_id", turns.alias("history_turns"), F.col("n_hits").cast("long").alias("n_hits"), chars.alias("total_chars"))


def batch_rag(turns: DataFrame, records: DataFrame, k: int | None = None, min_similarity: float | None = None, limit: int = HISTORY) -> DataFrame:
    """The prompts of a whole table of sessions: question, search, context, history, messages. Answered turns are the history."""
    asked = questions(turns)
    hits = search_records(asked.select(F.col("session_id").alias("query_id"), F.col("question").alias("query")), records, k, min_similarity)
    return build_prompts(build_context(asked, hits), recent_history(pair_turns(turns), limit))
