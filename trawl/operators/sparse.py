"""Lexical vectors of chunks and their scores, made where the chunks are.

A gram is a 64-bit code: up to three code points exactly, four by a hash. Chunks are (data_id, chunk_id, text). A task cuts its chunks into grams,
counts and weighs them, multiplies them with the weights of the queries and cuts the lists to their best k, so that
what is shuffled is one number a distinct gram and a task, and k hits a query and a task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.scratch import materialise, ship_package, spread_small
from trawl.functions.text import WHITE_SPACE, padded

#: Code points that are cut into grams at once; grams of a vocabulary, entries of queries, and cells of a matrix of some of these, that a task may hold.
SLICE_CHARS, HELD_GRAMS, HELD_ENTRIES, HELD_CELLS = 50_000, 2_000_000, 4_000_000, 4_000_000
#: Cells of a matrix of chunks that are multiplied at once.
SLICE_CELLS = 4_000_000
#: Chunks that wait to be scored at once where there are many queries.
WAITING_ROWS = 512
#: Texts and grams are counted in a table while it has so many cells a gram that was cut at most.
CELLS_A_GRAM = 8
#: Texts of so many code points at most are scored once, however many chunks are equal; so many of them a task holds before it hands them on.
SHARED_CHARS, SHARED_TEXTS = 64, 1_000_000
#: A product of two entries costs as much as so many cells of dense matrices.
ENTRY_CELLS = 100
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Grams:
    """Windows of ``sizes`` code points: inside lower-cased words, each between two spaces, or of the whole stripped text between
    two spaces, which is one gram if it is shorter."""

    sizes: tuple[int, ...]
    words: bool

    def prepared(self, texts: DataFrame, column: str, *keys: str) -> DataFrame:
        text = F.lower(F.coalesce(F.col(column), F.lit(""))) if self.words else padded(F.col(column))
        return spread_small(texts.select(*keys, text.alias("text")))


WORD_GRAMS = Grams((2, 3, 4), True)
_SPACE = np.zeros(0x110000, bool)
_SPACE[[ord(c) for c in WHITE_SPACE]] = True
_BREAK = re.compile(f"[{WHITE_SPACE}]")


def text_grams(n: int) -> Grams:
    return Grams((n,), False)


def _words(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words, each between two spaces and with a zero after it, and the text of each code point."""
    inside = ~_SPACE[points]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
    at = np.flatnonzero(inside)
    word = np.cumsum(start)[at] - 1
    lengths = np.bincount(word)
    offset = np.cumsum(lengths + 3) - lengths - 3
    out = np.zeros(int((lengths + 3).sum()), np.uint64)
    first = np.cumsum(lengths) - lengths
    out[offset[word] + 1 + np.arange(len(at)) - first[word]] = points[at]
    out[offset] = out[offset + lengths + 1] = 32
    return out, np.repeat(owner[start], lengths + 3)


def _codes(points: np.ndarray, n: int) -> np.ndarray:
    m = len(points) - n + 1
    code = points[:m].copy()
    for k in range(1, min(n, 3)):
        code |= points[k : k + m] << np.uint64(21 * k)
    for k in range(3, n):
        code = (code ^ (code >> np.uint64(30))) * _MIX[0]
        code = (code ^ (code >> np.uint64(27))) * _MIX[1] + points[k : k + m]
    return code


def _pieces(text: str, grams: Grams):
    """Parts of a text and the grams to cut from each, so that each gram of the text is in one of them: whole words, and windows
    that overlap of a word that is longer than a slice, or of the whole text."""
    if not grams.words:
        for n in grams.sizes:
            for start in range(0, len(text) - n + 1, SLICE_CHARS):
                yield text[start : start + SLICE_CHARS + n - 1], Grams((n,), False)
        return
    start = 0
    while start < len(text):
        end = start + SLICE_CHARS
        cut = len(text) if end >= len(text) else max(text.rfind(c, start, end) for c in WHITE_SPACE) + 1
        if cut:
            yield text[start:cut], grams
        else:
            found = _BREAK.search(text, end)
            cut = found.start() if found else len(text)
            yield from _pieces(f" {text[start:cut]} ", Grams(grams.sizes, False))
        start = cut


def _counted_long(text: str, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of a text that is longer than a slice; beside the text, what is held grows with its distinct grams."""

    def merged(parts):
        names, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return names, np.bincount(at, np.concatenate([p[1] for p in parts]), len(names)).astype(np.int64)

    parts, waiting = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    for piece, own in _pieces(text, grams):
        _, code, count = _counted([piece], own)
        parts.append((code.view(np.uint64), count))
        waiting += len(code)
        if waiting > max(len(parts[0][0]), 4 * SLICE_CHARS):
            parts, waiting = [merged(parts)], 0
    names, count = merged(parts)
    return names.view(np.int64), count


def counted_grams(texts: list[str], grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, code, count) of the distinct grams of each text, by text and code. Texts longer than a slice are counted in parts."""
    if all(len(t) <= SLICE_CHARS for t in texts):
        return _counted(texts, grams)
    found = [_counted_long(t, grams) if len(t) > SLICE_CHARS else _counted([t], grams)[1:] for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(code) for code, _ in found])
    return owner, np.concatenate([code for code, _ in found]), np.concatenate([count for _, count in found])


def _counted(texts: list[str], grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends, owner = np.cumsum(lengths), np.repeat(np.arange(len(texts)), lengths)
    zeros = None
    if grams.words:
        points, owner = _words(points, owner)
        zeros = np.concatenate([[0], np.cumsum(points == 0)])
    owners, codes = [], []
    for n in grams.sizes:
        if len(points) >= n:
            own = owner[: len(points) - n + 1]
            ok = np.arange(len(own)) + n <= ends[own] if zeros is None else zeros[n:] == zeros[:-n]
            codes.append(_codes(points, n)[ok])
            owners.append(own[ok])
    if not grams.words:
        for i in np.flatnonzero(lengths < min(grams.sizes)).tolist():
            own = points[ends[i] - lengths[i] : ends[i]]
            codes.append(_codes(own, len(own)) if len(own) else np.zeros(1, np.uint64))
            owners.append(np.array([i]))
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    names, code = _ranked(np.concatenate(codes))
    pair = np.concatenate(owners) * max(len(names), 1) + code
    if len(texts) * len(names) <= CELLS_A_GRAM * len(pair):
        cells = np.bincount(pair, minlength=1)
        pair = np.flatnonzero(cells)
        count = cells[pair]
    else:
        pair, count = np.unique(pair, return_counts=True)
    return pair // max(len(names), 1), names[pair % max(len(names), 1)].view(np.int64), count


def _ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, and the place of each code among them; only the distinct ones are sorted."""
    seen, names = pd.factorize(codes)
    order = np.argsort(names)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return names[order], place[seen]


def _slices(batches, *keys: str):
    """Rows of the batches with about SLICE_CHARS of text: the key columns, lists of ids as they are, then the texts."""
    for batch in batches:
        texts, start = batch.column("text").to_pylist(), 0
        columns = [batch.column(k) if k == "ids" else batch.column(k).to_numpy() for k in keys]
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and (end == start or held + len(texts[end]) <= SLICE_CHARS):
                held += len(texts[end])
                end += 1
            yield [c[start:end] for c in columns], texts[start:end]
            start = end


def _found(names: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``codes`` in the sorted ``names``, and whether they are there."""
    at = np.minimum(np.searchsorted(names, codes), max(len(names) - 1, 0))
    return at, (names[at] == codes if len(names) else np.zeros(len(codes), bool))


def gram_frequencies(chunks: DataFrame, grams: Grams, only: np.ndarray | None = None) -> DataFrame:
    """(code, df): how many chunks hold each gram, also of ``shared_texts``; of ``only`` these codes, if given."""
    ship_package(chunks.sparkSession)
    keys = ["times"] if is_shared(chunks) else []

    def run(batches):
        for times, texts in _slices(batches, *keys):
            owner, code, _ = counted_grams(texts, grams)
            names, place = _ranked(code)
            n = np.bincount(place, times[0][owner] if times else None, len(names)).astype(np.int64)
            if only is not None:
                held = _found(only, names)[1]
                names, n = names[held], n[held]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(n, pa.int64())], ["code", "df"])

    found = grams.prepared(chunks, "text", *keys).mapInArrow(run, "code long, df long")
    return found.groupBy("code").agg(F.sum("df").alias("df"))


def is_shared(chunks: DataFrame) -> bool:
    """Whether these are ``shared_texts``."""
    return "ids" in chunks.columns


def shared_texts(chunks: DataFrame, k: int) -> DataFrame:
    """(text, times, ids): each text of up to SHARED_CHARS code points once, with the number of chunks that are it and the k lowest of their data_ids;
    longer texts as they are. Equal texts score alike, so a record that has a text and is not among these ids comes after k others by it, and
    searches for k find the same. Texts are counted in tasks before they are shuffled."""
    ship_package(chunks.sparkSession)

    def merged(text, times, of, data):
        """Texts and their numbers of chunks, and which of them the ids belong to, by text and id."""
        coded = text.dictionary_encode()
        place = coded.indices.to_numpy()
        times, of = np.bincount(place, times, len(coded.dictionary)).astype(np.int64), place[of]
        order = np.lexsort((data, of))
        of, data = of[order], data[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (data[1:] != data[:-1])
        of, data = of[new], data[new]
        low = np.arange(len(of)) - np.searchsorted(of, of) < k
        return coded.dictionary, times, of[low], data[low]

    def batch(text, times, of, data):
        offsets = pa.array(np.searchsorted(of, np.arange(len(text) + 1)), pa.int32())
        return pa.RecordBatch.from_arrays([text, pa.array(times, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(data, pa.int64()))], ["text", "times", "ids"])

    def run(batches):
        none = np.zeros(0, np.int64)
        empty = (pa.array([], pa.string()), none, none, none)
        held, waiting, rows = empty, [], 0

        def joined():
            first = np.cumsum([len(held[0])] + [len(t) for t, _ in waiting])
            text = pa.concat_arrays([held[0], *(t for t, _ in waiting)])
            times = np.concatenate([held[1], np.ones(first[-1] - first[0], np.int64)])
            return merged(text, times, np.concatenate([held[2], np.arange(first[0], first[-1])]), np.concatenate([held[3], *(d for _, d in waiting)]))

        for one in batches:
            text, data = one.column("text"), one.column("data_id").to_numpy()
            short = pc.less_equal(pc.utf8_length(text), SHARED_CHARS)
            long = pc.filter(text, pc.invert(short))
            if len(long):
                yield batch(long, np.ones(len(long), np.int64), np.arange(len(long)), data[~short.to_numpy(zero_copy_only=False)])
            waiting.append((pc.filter(text, short), data[short.to_numpy(zero_copy_only=False)]))
            rows += len(waiting[-1][0])
            if rows > max(SHARED_TEXTS // 4, len(held[0])):
                held, waiting, rows = joined(), [], 0
                if len(held[0]) > SHARED_TEXTS:
                    yield batch(*held)
                    held = empty
        yield batch(*joined())

    chunks = chunks.where(F.col("data_id").isNotNull()).select(F.col("data_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    parts = materialise(chunks.mapInArrow(run, "text string, times long, ids array<long>"))
    short = F.char_length("text") <= SHARED_CHARS
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k)  # k a task that has the text
    return parts.where(~short).unionByName(materialise(parts.where(short).groupBy("text").agg(F.sum("times").alias("times"), ids.alias("ids"))))


def _spelled(codes: np.ndarray, texts: list[str], grams: Grams) -> list[str]:
    """The grams of these codes, each of which is in one of the texts."""
    out: dict[int, str] = {}
    wanted = np.sort(codes.view(np.uint64))
    for text in texts:
        for piece, own in _pieces(text, grams) if len(text) > SLICE_CHARS else ((text, grams),):
            points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            whole = [len(points)] if not own.words and len(points) < min(own.sizes) else []
            if own.words:
                points, _ = _words(points, np.zeros(len(points), np.int64))
            for n in [*own.sizes, *whole]:
                if 0 < n <= len(points):
                    cut = _codes(points, n)
                    at = np.flatnonzero(_found(wanted, cut)[1])
                    names, first = np.unique(cut[at], return_index=True)
                    rows = points[at[first][:, None] + np.arange(n)].astype(np.uint32)
                    fresh = (rows != 0).all(axis=1)  # a zero stands between words
                    for name, row in zip(names[fresh].tolist(), rows[fresh], strict=True):
                        out.setdefault(name, row.tobytes().decode("utf-32-le", "surrogatepass"))
    return [out[c] for c in codes.view(np.uint64).tolist()]


def named_frequencies(chunks: DataFrame, grams: Grams) -> DataFrame:
    """(gram, df): how many chunks hold each gram. A task counts codes and spells each of them once; HELD_GRAMS of them are held at most."""
    ship_package(chunks.sparkSession)

    def run(batches):
        known, total, parts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            names, place = _ranked(np.concatenate([known, *(p[0] for p in parts)]))
            return names, np.bincount(place, np.concatenate([total, *(p[1] for p in parts)]), len(names)).astype(np.int64)

        def batch(code, spelled, df):
            return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(spelled, pa.string()), pa.array(df, pa.int64())], ["code", "gram", "df"])

        spelled_codes = np.zeros(0, np.int64)
        for _, texts in _slices(batches):
            _, code, _ = counted_grams(texts, grams)
            names, n = np.unique(code, return_counts=True)
            new = names[~_found(spelled_codes, names)[1]]
            if len(new):
                yield batch(new, _spelled(new, texts, grams), np.zeros(len(new), np.int64))
                spelled_codes = np.union1d(spelled_codes, new)
            parts.append((names, n))
            waiting += len(names)
            if waiting > 1_000_000:
                known, total = merged()
                parts, waiting = [], 0
                if len(known) > HELD_GRAMS:
                    yield batch(known, [None] * len(known), total)
                    known, total, spelled_codes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        known, total = merged()
        yield batch(known, [None] * len(known), total)

    found = grams.prepared(chunks, "text").mapInArrow(run, "code long, gram string, df long")
    return found.groupBy("code").agg(F.max("gram").alias("gram"), F.sum("df").alias("df")).select("gram", "df")


@dataclass(frozen=True)
class Weights:
    """How counts become values: unit vectors of tf * idf, or BM25's impacts. ``codes`` are sorted; other grams count nothing. With
    ``keep`` only values of these codes are given out."""

    codes: np.ndarray
    idf: np.ndarray
    keep: np.ndarray | None = None
    bm25: tuple[float, float, float] | None = None  # k1, b, average length

    @cached_property
    def kept(self) -> np.ndarray:
        """Which of ``codes`` are given out."""
        return _found(self.keep, self.codes)[1]

    def values(self, owner, code, count, n, norms=None):
        """Without ``norms``, ``codes`` must be the whole vocabulary for unit vectors to be some."""
        at, known = _found(self.codes, code)
        lengths = np.bincount(owner, count, minlength=n)
        owner, code, count, at = owner[known], code[known], count[known], at[known]
        if self.bm25:
            k1, b, average = self.bm25
            damp = count + k1 * (1 - b + b * lengths[owner] / max(average, 1e-9))
            value = self.idf[at] * count * (k1 + 1) / damp
        else:
            value = count * self.idf[at]
            norm = np.sqrt(np.bincount(owner, value * value, minlength=n)) if norms is None else norms
            value = value / norm[owner]
        if self.keep is not None:
            held = self.kept[at]
            owner, code, value = owner[held], code[held], value[held]
        return owner, code, value


_ENCODED = "data_id long, chunk_id long, codes array<long>, `values` array<double>"


def encode(chunks: DataFrame, grams: Grams, weights: Weights, rare_first: bool = False, norm: str | None = None) -> DataFrame:
    """Sparse vectors (data_id, chunk_id, codes, values) of the chunks, by code, or by falling idf and then by code. ``norm`` names a column
    with the chunks' norms, where ``weights`` is a part of the vocabulary only."""
    ship_package(chunks.sparkSession)
    held = chunks.sparkSession.sparkContext.broadcast(weights)
    keys = ["data_id", "chunk_id", *([norm] if norm else [])]

    def run(batches):
        for (data, chunk, *norms), texts in _slices(batches, *keys):
            owner, code, value = held.value.values(*counted_grams(texts, grams), len(texts), *norms)
            if rare_first:
                order = np.lexsort((code, -held.value.idf[_found(held.value.codes, code)[0]], owner))
                owner, code, value = owner[order], code[order], value[order]
            offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
            columns = [pa.array(data, pa.int64()), pa.array(chunk, pa.int64())]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(code, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(value, pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["data_id", "chunk_id", "codes", "values"])

    return grams.prepared(chunks, "text", *keys).mapInArrow(run, _ENCODED)


def counts(chunks: DataFrame, grams: Grams, *keys: str) -> DataFrame:
    """(*keys, code, n) of the chunks' grams; keys are longs."""
    ship_package(chunks.sparkSession)

    def run(batches):
        for columns, texts in _slices(batches, *keys):
            owner, code, count = counted_grams(texts, grams)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*(c[owner] for c in columns), code, count)], [*keys, "code", "n"])

    return grams.prepared(chunks, "text", *keys).mapInArrow(run, ", ".join(f"{k} long" for k in (*keys, "code", "n")))


def encode_joined(chunks: DataFrame, grams: Grams, vocabulary: DataFrame) -> DataFrame:
    """The unit vectors of ``encode``, rare grams first, for a vocabulary (code, idf) that no task can hold: counts meet it in a join."""
    raw = counts(chunks, grams, "data_id", "chunk_id").join(vocabulary.select("code", "idf"), "code")
    raw = raw.select("data_id", "chunk_id", "code", (-F.col("idf")).alias("rank"), (F.col("n") * F.col("idf")).alias("w"))
    found = raw.groupBy("data_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("rank", "code", "w"))).alias("found"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return found.select("data_id", "chunk_id", F.col("found.code").alias("codes"), F.transform("found.w", lambda w: w / F.col("norm")).alias("values"))


def with_norms(chunks: DataFrame, grams: Grams, vocabulary: DataFrame) -> DataFrame:
    """Chunks, written, with the norm of their tf * idf, for a vocabulary (code, idf) that no task can hold. Chunks without a gram go."""
    chunks = materialise(chunks.select(*(["ids"] if is_shared(chunks) else ["data_id"]), "text").withColumn("uid", F.monotonically_increasing_id()))
    raw = counts(chunks, grams, "uid").join(vocabulary.select("code", "idf"), "code").withColumn("w", F.col("n") * F.col("idf"))
    return materialise(chunks.join(raw.groupBy("uid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "uid").drop("uid"))


@dataclass(frozen=True)
class Asked:
    """Queries by row: those of ``ids[i]`` are ``codes`` and ``weights`` from ``starts[i]`` to ``starts[i + 1]``."""

    ids: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    weights: np.ndarray

    def blocks(self) -> list[tuple[int, int, np.ndarray]]:
        """(start, end, codes) of consecutive queries whose matrix over the codes that they have takes HELD_CELLS cells at most, or one column."""
        out, start, n = [], 0, len(self.ids)
        while start < n:
            own = lambda end, start=start: np.unique(self.codes[self.starts[start] : self.starts[end]])
            low, step = start + 1, 1  # the cells grow with the end
            while low + step <= n and len(own(low + step)) * (low + step - start) <= HELD_CELLS:
                low, step = low + step, 2 * step
            high = min(low + step - 1, n)
            while low < high:
                end = (low + high + 1) // 2
                low, high = (end, high) if len(own(end)) * (end - start) <= HELD_CELLS else (low, end - 1)
            out.append((start, low, own(low)))
            start = low
        return out


class Sheet:
    """The weights of the queries from start to end by gram, a column for each query."""

    def __init__(self, asked: Asked, start: int, end: int, names: np.ndarray):
        entries = slice(asked.starts[start], asked.starts[end])
        self.start, self.width, self.names = start, end - start, names
        place = np.searchsorted(names, asked.codes[entries])
        self.asked, self.starts = (place, asked.weights[entries]), asked.starts[start : end + 1] - asked.starts[start]
        order = np.argsort(place, kind="stable")
        self.column = np.repeat(np.arange(self.width), np.diff(asked.starts[start : end + 1]))[order]
        self.place, self.weight = place[order], asked.weights[entries][order]
        self.first = np.searchsorted(self.place, np.arange(len(names) + 1))

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self.names), self.width))
        out[self.place, self.column] = self.weight
        return out

    def products(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, rows: int, held: np.ndarray | None) -> np.ndarray:
        """The product of a sparse matrix, its entries by row, and these weights, ``held`` as a matrix: entry by entry where few entries meet, as
        those of short texts, else as dense matrices."""
        sizes = self.first[at + 1] - self.first[at]
        total = int(sizes.sum())
        if total > SLICE_CELLS or ENTRY_CELLS * total > rows * len(self.names) * self.width:
            matrix = np.zeros((rows, len(self.names)))
            matrix[row, at] = value
            return matrix @ (self.matrix() if held is None else held)
        each = np.repeat(np.arange(len(at)), sizes)
        own = np.arange(total) - (np.cumsum(sizes) - sizes)[each] + self.first[at][each]
        cells = np.bincount(row[each] * self.width + self.column[own], value[each] * self.weight[own], minlength=rows * self.width)
        return cells.reshape(rows, self.width)

    def is_dense(self, at: np.ndarray, rows: int) -> bool:
        """Whether ``products`` of these entries are made as dense matrices."""
        total = int((self.first[at + 1] - self.first[at]).sum())
        return total > SLICE_CELLS or ENTRY_CELLS * total > rows * len(self.names) * self.width

    def rough(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, float]:
        """The products in single precision, and how far they may be off, as a part of the exact ones: none of the factors is below zero, and a product
        sums no more of them than a query has entries."""
        matrix, weights = np.zeros((rows, len(self.names)), np.float32), np.zeros((len(self.names), self.width), np.float32)
        matrix[row, at], weights[self.place, self.column] = value, self.weight
        return matrix @ weights, (float(np.diff(self.starts).max(initial=0)) + 8) * 2.0**-23

    def exact(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, of: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The products of rows ``of`` and the queries beside them, about SLICE_CELLS entries at once. Entries stand by row and gram."""
        keys = row * len(self.names) + at
        place, weight = self.asked
        sizes, out, start = np.diff(self.starts)[query], np.zeros(len(of)), 0
        done = np.cumsum(sizes)
        while start < len(of):
            before = done[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(done, before + SLICE_CELLS, side="right")))
            each = np.repeat(np.arange(start, end), sizes[start:end])
            own = np.arange(len(each)) + before - (done - sizes)[each] + self.starts[query[each]]
            found, there = _found(keys, of[each] * len(self.names) + place[own])
            out[start:end] = np.bincount(each[there] - start, weight[own[there]] * value[found[there]], minlength=end - start)
            start = end
        return out


def query_grams(queries: DataFrame, grams: Grams) -> DataFrame:
    """(query_id, code, qn); rows that repeat a query_id are one query of all their grams."""
    found = counts(queries.select("query_id", F.col("query").alias("text")), grams, "query_id")
    return found.groupBy("query_id", "code").agg(F.sum("n").alias("qn"))


def columns(rows: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of numbers, brought to the driver as such: eight bytes a value, no row objects."""
    found = rows.select(*names).toArrow()
    return [found.column(c).to_numpy() for c in names]


def query_passes(weighed: DataFrame):
    """The queries' weights (query_id, code, w) in parts of about HELD_ENTRIES, one at a time; the table is read once a part."""
    parts = max(1, -(-weighed.count() // HELD_ENTRIES))
    for part in range(parts):
        own = weighed if parts == 1 else weighed.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        query, code, w = columns(own, "query_id", "code", "w")  # HELD_ENTRIES or little more
        order = np.lexsort((code, query))
        query, code, w = query[order], code[order], w[order]
        ids, starts = np.unique(query, return_index=True)
        if len(ids):
            yield Asked(ids.astype(np.int64), np.append(starts, len(query)), code.astype(np.int64), w.astype(float))


def _best(k: int, query: np.ndarray, data: np.ndarray, score: np.ndarray):
    """The best k records of each query, a record at its best."""
    order = np.lexsort((-score, data, query))
    query, data, score = query[order], data[order], score[order]
    first = np.ones(len(query), bool)
    first[1:] = (query[1:] != query[:-1]) | (data[1:] != data[:-1])
    query, data, score = query[first], data[first], score[first]
    order = np.lexsort((data, -np.round(score, 6), query))
    query, data, score = query[order], data[order], score[order]
    turn = np.arange(len(query)) - np.searchsorted(query, query)
    return query[turn < k], data[turn < k], score[turn < k]


class Lists:
    """The best k records of each query among the chunks that are scored one after the other."""

    def __init__(self, queries: Asked, k: int):
        self.queries, self.k, self.sheets = queries, k, [Sheet(queries, *block) for block in queries.blocks()]
        self.names = np.unique(queries.codes)
        self.held = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)] for _ in self.sheets]
        self.kth = np.zeros(len(queries.ids))
        self.only = self.sheets[0].matrix() if len(self.sheets) == 1 else None
        self.waiting, self.rows, self.entries = [], 0, 0

    def add(self, data: np.ndarray, row: np.ndarray, code: np.ndarray, value: np.ndarray, of: np.ndarray | None = None) -> None:
        """As ``score``, but where queries take several sheets, each of which is made into a matrix anew for all chunks that meet it, chunks wait until
        WAITING_ROWS of them can be scored at once."""
        if len(self.sheets) < 2:
            self.score(data, row, code, value, of)
            return
        of = np.arange(len(data)) if of is None else of
        n = int(of[-1]) + 1 if len(of) else 0
        self.waiting.append((data, row + self.rows, code, value, of + self.rows))
        self.rows, self.entries = self.rows + n, self.entries + len(code)
        if self.rows >= WAITING_ROWS or self.entries >= HELD_ENTRIES:
            self.flush()

    def flush(self) -> None:
        """Scores the chunks that wait."""
        if self.waiting:
            parts, self.waiting, self.rows, self.entries = self.waiting, [], 0, 0
            self.score(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def score(self, data: np.ndarray, row: np.ndarray, code: np.ndarray, value: np.ndarray, of: np.ndarray | None = None) -> None:
        """Chunks by their entries, which stand by row. Chunk i is of the record ``data[i]``, or of all records ``data`` where ``of``, in order, is i."""
        of = np.arange(len(data)) if of is None else of
        n = int(of[-1]) + 1 if len(of) else 0
        name, known = _found(self.names, code)
        row, name, value = row[known], name[known], value[known]
        cells = SLICE_CELLS
        if self.only is None:  # single precision, see ``rough``
            cells, keys = 2 * SLICE_CELLS, row * len(self.names) + name
            if (keys[1:] < keys[:-1]).any():
                order = np.argsort(keys)
                row, name, value = row[order], name[order], value[order]
        place = np.empty(len(self.names), np.int64)
        for number, sheet in enumerate(self.sheets):
            place[:] = -1
            place[np.searchsorted(self.names, sheet.names)] = np.arange(len(sheet.names))
            at = place[name]
            known = at >= 0
            own_row, own_at, own_value = row[known], at[known], value[known]
            rows = max(1, cells // max(len(sheet.names), sheet.width))
            for first in range(0, n, rows):
                a, b = np.searchsorted(own_row, [first, first + rows])
                c, d = np.searchsorted(of, [first, first + rows])
                entries, height = (own_row[a:b] - first, own_at[a:b], own_value[a:b]), min(rows, n - first)
                order = c + np.argsort(data[c:d], kind="stable")
                heads = np.flatnonzero(np.append(True, data[order][1:] != data[order][:-1]))
                if self.only is None and sheet.is_dense(own_at[a:b], height):
                    self._screen(number, entries, height, of[order] - first, data[order], heads)
                    continue
                scores = sheet.products(*entries, height, self.only)[of[order] - first]
                if len(heads) < len(order):
                    scores = np.maximum.reduceat(scores, heads, axis=0)  # a record at its best chunk
                self._keep(number, data[order][heads], scores)

    def _screen(self, number: int, entries: tuple, height: int, of: np.ndarray, data: np.ndarray, heads: np.ndarray) -> None:
        """Only what single precision cannot tell from the best k is scored in double precision."""
        sheet = self.sheets[number]
        rough, off = sheet.rough(*entries, height)
        rough = rough[of]
        pooled = np.maximum.reduceat(rough, heads, axis=0) if len(heads) < len(of) else rough
        least = self.kth[sheet.start : sheet.start + sheet.width] - 2e-6  # ranks go by six digits
        if len(heads) > self.k and np.count_nonzero(pooled >= least) > 2 * self.k * sheet.width:
            least = np.maximum(least, np.partition(pooled, len(heads) - self.k, axis=0)[len(heads) - self.k].astype(float) - 2e-6)
        at, query = np.nonzero((rough > 0) & (rough >= (least * (1 - 2 * off) - 2e-6).astype(np.float32)))
        if len(at):
            self._merge(number, query, data[at], sheet.exact(*entries, of[at], query))

    def _keep(self, number: int, part: np.ndarray, scores: np.ndarray) -> None:
        start = self.sheets[number].start
        least = self.kth[start : start + scores.shape[1]]
        above = (scores > 0) & (scores >= least - 2e-6)  # ranks go by six digits
        if len(part) > self.k and np.count_nonzero(above) > 2 * self.k * scores.shape[1]:
            above &= scores >= np.partition(scores, len(part) - self.k, axis=0)[len(part) - self.k] - 2e-6
        at, query = np.nonzero(above)
        if len(at):
            self._merge(number, query, part[at], scores[at, query])

    def _merge(self, number: int, query: np.ndarray, data: np.ndarray, score: np.ndarray) -> None:
        query = query + self.sheets[number].start
        self.held[number] = list(_best(self.k, *(np.concatenate(x) for x in zip(self.held[number], (query, data, score), strict=True))))
        query, _, score = self.held[number]
        heads = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        full = np.diff(np.append(heads, len(query))) >= self.k
        self.kth[query[heads][full]] = np.minimum.reduceat(score, heads)[full]

    def found(self) -> pa.RecordBatch:
        self.flush()
        query, data, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        columns = [pa.array(self.queries.ids[query], pa.int64()), pa.array(data, pa.int64()), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "data_id", "score"])


def local_lists(chunks: DataFrame, grams: Grams, weights: Weights, asked: Asked, k: int, norm: str | None = None) -> DataFrame:
    """(query_id, data_id, score): the best k records of each query in each task, scores above zero only. Chunks, or ``shared_texts`` of k ids, are weighed
    as by ``encode`` and scored in the same task."""
    ship_package(chunks.sparkSession)
    context = chunks.sparkSession.sparkContext
    held, shared = context.broadcast(weights), context.broadcast(asked)
    keys = ["ids" if is_shared(chunks) else "data_id", *([norm] if norm else [])]

    def run(batches):
        lists = Lists(shared.value, k)
        for (data, *norms), texts in _slices(batches, *keys):
            of = None
            if keys[0] == "ids":
                of, data = np.repeat(np.arange(len(texts)), data.value_lengths().to_numpy()), data.flatten().to_numpy()
            lists.add(data, *held.value.values(*counted_grams(texts, grams), len(texts), *norms), of)
        yield lists.found()

    return grams.prepared(chunks, "text", *keys).mapInArrow(run, "query_id long, data_id long, score double")
