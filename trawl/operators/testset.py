"""Labelled test cases made from records.

Every draw is a function of md5(seed|record|position|tag), so cases do not depend on partitions or runs.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import split_phrases, strip

SEED = 42

# Terms of the records and what owners say instead, in this order.
COLLOQUIAL = [
    ("ปัสสาวะ", ["ฉี่", "เยี่ยว"]),
    ("อุจจาระ", ["อึ", "ขี้"]),
    ("อาเจียน", ["อ้วก", "ขย้อน"]),
    ("เบื่ออาหาร", ["ไม่กินข้าว", "ไม่ยอมกิน"]),
    ("น้ำหนักลด", ["ผอมลง", "ซูบลง"]),
    ("ซึม", ["ไม่ร่าเริง", "นอนทั้งวัน"]),
    ("หายใจลำบาก", ["หอบ", "หายใจแรง"]),
    ("ขนร่วง", ["ขนหลุด", "ขนบาง"]),
    ("คัน", ["เกาบ่อย", "เกาไม่หยุด"]),
    ("ท้องเสีย", ["ถ่ายเหลว", "ท้องร่วง"]),
    ("เหงือก", ["ขอบฟัน"]),
    ("ผิวหนัง", ["หนัง"]),
]
# What a question may begin and end with.
PREFIXES = ["แมว", "แมวของฉัน", "น้องแมว", "แมวที่บ้าน", ""]
SUFFIXES = ["", " เป็นอะไร", " ควรทำยังไง", " อันตรายไหม", " หลายวันแล้ว"]
# Questions that no record answers.
NEGATIVES = [
    "วันนี้อากาศดีมาก",
    "ราคาอาหารแมวยี่ห้อนี้เท่าไหร่",
    "ช่วยแนะนำร้านกาแฟแถวอโศก",
    "รถยนต์ไฟฟ้ารุ่นไหนดี",
    "สอนวิธีเขียนโปรแกรม python",
    "แมวชอบนอนตรงไหนมากที่สุด",
    "พรุ่งนี้ฝนจะตกไหม",
    "อยากเปลี่ยนงานใหม่",
    "ทรายแมวยี่ห้อไหนดีที่สุด",
    "ขอสูตรทำขนมเค้ก",
]


def draw(tag: str, *keys: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys], F.lit(tag)))


def pick(options: list[str], tag: str, *keys: Column, seed: int = SEED) -> Column:
    """One of the options, by the first seven hexadecimal digits of the draw."""
    number = F.conv(F.substring(draw(tag, *keys, seed=seed), 1, 7), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(o) for o in options]), (number % len(options) + 1).cast("int"))


def phrases(records: DataFrame) -> DataFrame:
    """(data_id, pos, phrase, n): a record's phrases, n of them."""
    split = split_phrases(F.col("cause"))
    return records.withColumn("phrases", split).select("data_id", F.posexplode("phrases").alias("pos", "phrase"), F.size("phrases").alias("n"))


def decorate(text: Column, *keys: Column, seed: int = SEED) -> Column:
    return strip(F.concat(pick(PREFIXES, "prefix", *keys, seed=seed), text, pick(SUFFIXES, "suffix", *keys, seed=seed)))


def _case(query: Column, expected: Column, category: str, note: Column) -> list[Column]:
    return [query.alias("query"), expected.alias("expected_data_id"), F.lit(category).alias("category"), note.alias("note")]


def cases_exact(records: DataFrame) -> DataFrame:
    return records.select(*_case(strip(F.col("cause")), F.col("data_id"), "exact", F.col("symptoms")))


def first_drawn(records: DataFrame, tag: str, seed: int, most: int) -> DataFrame:
    """(data_id, draw, pos, phrase, n): the ``most`` phrases of each row that are drawn first, chosen inside the row; nothing is shuffled."""
    key = lambda p, i: F.struct(draw(tag, F.col("data_id"), i, seed=seed).alias("draw"), i.alias("pos"), p.alias("phrase"))
    split = records.withColumn("phrases", split_phrases(F.col("cause")))
    first = F.slice(F.sort_array(F.transform("phrases", key)), 1, most)
    return split.select("data_id", F.explode(first).alias("p"), F.size("phrases").alias("n")).select("data_id", "p.*", "n")


def _drawn(records: DataFrame, tag: str, seed: int, most: int) -> DataFrame:
    """The ``most`` phrases of each record that are drawn first, with their turn; a record may have several rows."""
    order = Window.partitionBy("data_id").orderBy("draw", "pos")
    return first_drawn(records, tag, seed, most).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most)


def cases_single(records: DataFrame, per_record: int = 3, seed: int = SEED) -> DataFrame:
    drawn = _drawn(records, "single", seed, per_record)
    text = decorate(F.col("phrase"), F.col("data_id"), F.col("pos"), seed=seed)
    return drawn.select(*_case(text, F.col("data_id"), "single", F.col("phrase")))


def cases_partial(records: DataFrame, seed: int = SEED) -> DataFrame:
    drawn = _drawn(records, "partial", seed, 3).where("n >= 3")
    joined = drawn.groupBy("data_id").agg(F.sort_array(F.collect_list(F.struct("turn", "phrase"))).alias("three"))
    text = F.array_join(F.transform("three", lambda t: t["phrase"]), " ")
    return joined.select(*_case(decorate(text, F.col("data_id"), F.lit("partial"), seed=seed), F.col("data_id"), "partial", F.lit("")))


def colloquialise(text: Column, *keys: Column, terms: list[tuple[str, list[str]]] = COLLOQUIAL, seed: int = SEED) -> Column:
    """Terms are replaced one after the other, each by one drawn variant, also in what was replaced before."""
    for term, variants in terms:  # a text without the term is left as it is, so each step names the one before just once
        text = F.replace(text, F.lit(term), pick(variants, term, *keys, seed=seed))
    return text


def cases_colloquial(records: DataFrame, terms: list[tuple[str, list[str]]] = COLLOQUIAL, seed: int = SEED) -> DataFrame:
    keys = F.col("data_id"), F.col("pos")
    some = reduce(or_, [F.contains(F.col("phrase"), F.lit(term)) for term, _ in terms], F.lit(False))  # nothing changes the others, so nothing is drawn for them
    changed = phrases(records).where(some).withColumn("casual", colloquialise(F.col("phrase"), *keys, terms=terms, seed=seed)).where("casual <> phrase")
    text = decorate(F.col("casual"), *keys, F.lit("c"), seed=seed)
    return changed.select(*_case(text, F.col("data_id"), "colloquial", F.concat(F.lit("from: "), "phrase")))


def add_typos(text: Column, seed: Column, rate: float = 0.08) -> Column:
    """Drops, doubles or swaps characters, one edit after the other, at least one, as many as the rate asks for. Texts of fewer than
    three characters stay. Place and kind of an edit are digits of md5(seed|its number)."""

    def edit(t: Column, turn: Column) -> Column:
        digits = F.md5(F.concat_ws("|", seed, turn.cast("string")))
        number = lambda start: F.conv(F.substring(digits, start, 7), 16, 10).cast("long")
        n = F.char_length(t)
        at = (number(1) % F.greatest(n - 1, F.lit(1))).cast("int")
        first, second = F.substr(t, at + 1, F.lit(1)), F.substr(t, at + 2, F.lit(1))
        kind = number(8) % 3
        middle = F.when(kind == 0, second).when(kind == 1, F.concat(first, first, second)).otherwise(F.concat(second, first))
        return F.when(n < 3, t).otherwise(F.concat(F.substr(t, F.lit(1), at), middle, F.substr(t, at + 3)))

    edits = F.greatest(F.lit(1), F.floor(F.char_length(text) * rate).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), edits), text, edit)


def cases_typo(records: DataFrame, rate: float = 0.08, seed: int = SEED) -> DataFrame:
    keys = F.col("data_id"), F.col("pos")
    one = _drawn(records, "typo", seed, 1).withColumn("noisy", add_typos(F.col("phrase"), draw("noise", *keys, seed=seed), rate))
    return one.select(*_case(decorate(F.col("noisy"), *keys, F.lit("t"), seed=seed), F.col("data_id"), "typo", F.col("phrase")))


def cases_negative(records: DataFrame, negatives: list[str] = NEGATIVES) -> DataFrame:
    return records.sparkSession.createDataFrame([(n, -1, "negative", "") for n in negatives], "query string, expected_data_id long, category string, note string")


def make_testset(records: DataFrame, per_record: int = 3, seed: int = SEED) -> DataFrame:
    every = cases_exact(records)
    for more in (cases_single(records, per_record, seed), cases_partial(records, seed), cases_colloquial(records, seed=seed), cases_typo(records, seed=seed), cases_negative(records)):
        every = every.unionByName(more)
    return every.where(strip(F.col("query")) != "")


def category_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")
