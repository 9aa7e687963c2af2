"""Language identification with language-bitmask n-gram filters.

A model is one bit-sliced Bloom filter: tables of bitmasks with a bit a language, a table for every 64 languages.
A lookup ANDs the masks of an n-gram's slots, which gives all languages of a table that contain it in one go. A text's n-grams are
counted per language, the hits that the filter's known fill lets through by chance are taken off, and
the language with most is predicted.

Training reads a bounded sample of labelled rows (``per_language`` rows of each of the ``languages`` commonest in
expectation, drawn by a hash), and every n-gram of it goes into the filter, which tasks fill: what reaches the driver are slots, not
n-grams. Prediction reads every row and whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import materialise, release, ship_package, table

GRAMS = (2, 3, 4)
SLOTS = 1 << 20
HASHES = 3
PER_LANGUAGE = 2_000
LANGUAGES = 1_024
#: Slots for each n-gram that the fullest language contains.
SLOTS_PER_GRAM = 4
#: A language contains an n-gram if its share of the language's n-grams is at least this part of the largest share.
KEEP_SHARE = 0.35
WORD_BITS = 64
BATCH_CHARS = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)

_fold: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """Lower-case code point of every letter, 0 for what is no letter."""
    if not _fold:
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        fold = np.zeros(0x110000, np.uint32)
        for m in regex.finditer(r"\p{L}", every):
            low = m[0].lower()
            fold[ord(m[0])] = ord(low) if len(low) == 1 else ord(m[0])
        _fold.append(fold)
    return _fold[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed n-grams of all texts, the text that each is of, and which texts have a letter.

    N-grams are taken within words: runs of letters, lower-cased, with a space at either end."""
    joined = " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    folded = _folding()[points].astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    letter = folded > 0
    lettered = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the space after a word also begins the next one
    chars, owner = folded[keep], owner[keep]
    chars = np.concatenate([[np.uint64(0)], chars, np.zeros(8, np.uint64)])
    owner = np.concatenate([owner[:1], owner, np.full(8, -1)]) if len(owner) else np.full(9, -1)
    codes, owners = [], []
    for n in GRAMS:
        code = np.full(len(owner), n, np.uint64)
        inside = np.ones(len(owner), bool)
        for k in range(n):
            shifted = chars[k:] if k else chars
            code[: len(shifted)] = code[: len(shifted)] * _P + shifted + np.uint64(1)
            if 0 < k < n - 1:  # a space only at the ends
                inside[: len(shifted)] &= shifted > 0
        last = np.full(len(owner), -1)
        last[: len(owner) - n + 1] = owner[n - 1 :]
        inside &= last >= 0
        inside[len(owner) - n + 1 :] = False
        if n == 2:
            inside[: len(owner) - 1] &= (chars[:-1] > 0) | (chars[1:] > 0)
        codes.append(_mix(code[inside]))
        owners.append(last[inside])
    return np.concatenate(codes), np.concatenate(owners), lettered


def _batched(texts: list[str]):
    """Slices of texts with at most BATCH_CHARS characters, or one text."""
    start = 0
    while start < len(texts):
        end, held = start, 0
        while end < len(texts) and (end == start or held + len(texts[end]) < BATCH_CHARS):
            held += len(texts[end])
            end += 1
        yield start, end
        start = end


def _count_grams(batches):
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text").to_pylist()
        for a, b in _batched(texts):
            codes, owners, _ = gram_codes(texts[a:b])
            for lang in set(langs[a:b]):
                own = codes[np.isin(owners, np.flatnonzero(langs[a:b] == lang))]
                values, counts = np.unique(own.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(values), pa.string()), "gram": values, "n": counts})


def places(codes: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slots of each n-gram, by hash."""
    step = (codes >> np.uint64(40)) | np.uint64(1)
    return [((codes + np.uint64(k) * step) % np.uint64(slots)).astype(np.int64) for k in range(HASHES)]


def _fill(slots: int):
    """(slot, word, mask) of n-grams and the languages that contain them."""

    def run(batches):
        for batch in batches:
            codes, bits = batch.column("gram").to_numpy().view(np.uint64), batch.column("bit").to_numpy().astype(np.int64)
            mask = (np.uint64(1) << (bits % WORD_BITS).astype(np.uint64)).view(np.int64)
            for at in places(codes, slots):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits // WORD_BITS), pa.array(mask)], ["slot", "word", "mask"])

    return run


class LanguageFilter:
    """The bit-sliced Bloom filter and the shares of false positives."""

    def __init__(self, langs: list[str], grams: np.ndarray, masks: np.ndarray, slots: int = SLOTS, tables: list[np.ndarray] | None = None):
        self.langs, self.slots = langs, slots
        masks = masks[:, None] if masks.ndim == 1 else masks  # a column for every WORD_BITS languages
        self.tables = tables or [np.zeros(slots, np.uint64) for _ in range(-(-len(langs) // WORD_BITS))]
        for at in places(grams.view(np.uint64), slots):
            for table, column in zip(self.tables, masks.T, strict=True):
                np.bitwise_or.at(table, at, column)
        full = [(self.tables[i // WORD_BITS] >> np.uint64(i % WORD_BITS) & np.uint64(1)).mean() for i in range(len(langs))]
        self.false = np.array(full) ** HASHES

    def languages(self, codes: np.ndarray, word: int = 0) -> np.ndarray:
        """The bitmask of the languages that contain each n-gram, of those in table ``word``."""
        first, *more = places(codes, self.slots)
        mask = self.tables[word][first]
        for at in more:
            mask &= self.tables[word][at]
        return mask

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for a, b in _batched(texts):
            codes, owners, lettered = gram_codes(texts[a:b])
            n = np.bincount(owners, minlength=b - a).astype(float)
            hits = np.zeros((b - a, len(self.langs)), np.int64)
            for i in range(len(self.langs)):
                if i % WORD_BITS == 0:
                    mask = self.languages(codes, i // WORD_BITS)
                hits[:, i] = np.bincount(owners[(mask >> np.uint64(i % WORD_BITS) & np.uint64(1)) > 0], minlength=b - a)
            true = np.clip((hits - n[:, None] * self.false) / (1 - self.false), 0, None)
            best = true.argmax(axis=1)
            share = np.where(n > 0, true.max(axis=1) / np.maximum(n, 1), 0.0)
            names += [self.langs[i] if ok else "und" for i, ok in zip(best, lettered, strict=True)]
            scores.append(np.where(lettered, np.clip(share, 0, 1), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> LanguageFilter | None:
    """A filter from rows (key, lang, text); ``key`` only draws the sample. None if no row has a language.

    Of more than ``languages`` different values of lang the commonest are learnt, ties by code point. The driver and every task hold
    a table for each 64 of them."""
    ship_package(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null")
    totals = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not totals:
        return None
    spark = labelled.sparkSession
    langs = [r["lang"] for r in totals]  # ties of scores go to the commoner
    known = spark.createDataFrame([(r["lang"], i, per_language / r["n"]) for i, r in enumerate(totals)], "lang string, bit int, share double")
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "key"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(F.broadcast(known), "lang").where(draw < F.col("share")).select("lang", "text")
    counts = materialise(sample.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    sums = counts.groupBy("lang").agg(F.sum("n").cast("double").alias("total"))
    sized = counts.join(F.broadcast(sums), "lang").join(F.broadcast(known.select("lang", "bit")), "lang")  # a row a language, both
    of = F.collect_list(F.struct((F.col("n") / F.col("total")).alias("share"), "bit"))
    grams = sized.groupBy("gram").agg(of.alias("of")).withColumn("most", F.array_max("of.share"))
    has = F.transform(F.filter("of", lambda x: x["share"] >= F.col("most") * KEEP_SHARE), lambda x: x["bit"])
    contained = materialise(grams.select("gram", F.explode(has).alias("bit")))
    fullest = contained.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    slots = max(SLOTS, 1 << (SLOTS_PER_GRAM * fullest - 1).bit_length()) if fullest else SLOTS
    filled = contained.mapInArrow(_fill(slots), "slot long, word long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    filled = filled.toArrow()
    word, slot, mask = (filled[c].to_numpy() for c in ("word", "slot", "mask"))
    tables = [np.zeros(slots, np.uint64) for _ in range(-(-len(langs) // WORD_BITS))]
    for i, one in enumerate(tables):
        one[slot[word == i]] = mask[word == i].view(np.uint64)
    release(counts, contained)
    return LanguageFilter(langs, np.zeros(0, np.int64), np.zeros((0, len(tables)), np.uint64), slots, tables)


def _predictor(model):
    def run(batches):
        for batch in batches:
            names, scores = model.value.predict(batch.column("trawl_text").to_pylist())
            kept = [c for c in batch.schema.names if c != "trawl_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    return run


def predict(rows: DataFrame, model: LanguageFilter | None) -> DataFrame:
    """Adds lang_pred and score to (key columns, trawl_text). Without a model every row is ``und``, score 0."""
    kept = [f for f in rows.schema.fields if f.name != "trawl_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    ship_package(rows.sparkSession)
    if model is None:
        return rows.drop("trawl_text").withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    shared = rows.sparkSession.sparkContext.broadcast(model)  # SLOTS words of 8 bytes for every 64 languages
    return rows.mapInArrow(_predictor(shared), f"{schema}, lang_pred string, score double")


def is_held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def identify(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Rows whose crc32(doc_id) mod 4 is 2 are held out; the filter learns from the others' text and lang,
    where both are there. A prediction sees the text alone. A null text and one without a letter are
    ``und`` with score 0; so is everything if no row has a language. The score is the corrected share
    of n-grams that the language contains; of languages with equal scores the one with more labelled rows is predicted, then the first by code
    point. Very long texts are read whole, one at a time. Repeated rows are predicted one by one; an empty
    table gives an empty result.
    """
    key = F.col("doc_id").cast("long")
    held_out = is_held_out(key)
    model = train(docs.where(~held_out).select(key.alias("key"), F.col("lang").cast("string").alias("lang"), "text"), **options)
    rows = docs.select(key.alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("trawl_text"))
    return predict(rows, model)


def keep_identified(docs: DataFrame, least: float = 0.2, **options) -> DataFrame:
    """The rows of ``docs`` whose language can be told: not ``und``, and with a score of ``least`` or more."""
    key = F.col("doc_id").cast("long")
    model = train(docs.where(~is_held_out(key)).select(key.alias("key"), F.col("lang").cast("string").alias("lang"), "text"), **options)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("trawl_text", F.coalesce(F.col(names[docs.columns.index("text")]), F.lit("")))
    told = predict(rows, model)
    kept = told.where((F.col("lang_pred") != "und") & (F.col("score") >= least)) if model else told.where("lang_pred <> 'und'")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op4_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
