"""Exact products of all pairs of sparse unit vectors, in blocks that meet without a shuffle.

Rows are packed where they are made: a block is one row of a table, with up to BLOCK_ROWS vectors by gram, their counts in a byte or two each where they
fit. The table is written once. Each pair of blocks is a row of its cartesian product, whose sides are both read from that table, so that
nothing is shuffled or written for it, and a task holds two blocks, whatever the number of rows. Grams that many rows of a
block hold are multiplied as a dense matrix, the others entry by entry.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.scratch import materialise, ship_package
from trawl.operators import sparse
from trawl.operators.index import tfidf_vocabulary, tfidf_weights

BLOCK_ROWS = 512
#: Entries of a block after which it takes no more rows.
BLOCK_ENTRIES = 2_000_000
#: Grams of so many rows of a block at most are multiplied entry by entry.
RARE = 16
#: Cells of a dense matrix, or pairs of entries, that a task multiplies at once.
CELLS = 4_000_000
#: Ranks go by six digits.
SLACK = 2e-6
#: Scores that are differences are zero below this.
NOISE = 1e-12
#: Blocks of a file.
FILE_BLOCKS = 16
_PARTS = ("data", "scale", "names", "idf", "sizes", "rows", "counts")
BLOCKS = f"block long, {', '.join(f'{p} binary' for p in _PARTS)}"
#: What a text has more than its record asks with, as a block of its own, and how much longer its vector is.
_LESS = tuple(f"less_{p}" for p in _PARTS)
TWIN_BLOCKS = f"{BLOCKS}, {', '.join(f'{p} binary' for p in _LESS)}, factor binary"


def unit_vectors(texts: DataFrame, vocabulary: DataFrame, weights: sparse.Weights | None) -> DataFrame:
    """TF-IDF unit vectors (data_id, chunk_id, codes, values) of texts (data_id, chunk_id, text), rare grams first."""
    if weights is None:
        return sparse.encode_joined(texts, sparse.WORD_GRAMS, vocabulary)
    return sparse.encode(texts, sparse.WORD_GRAMS, weights, rare_first=True)


def tfidf_model(chunks: DataFrame) -> tuple[DataFrame, sparse.Weights | None]:
    """The vocabulary of the chunks, written, and as weights if a task can hold it."""
    vocabulary = materialise(tfidf_vocabulary(chunks))
    return vocabulary, tfidf_weights(vocabulary)


def _pressed(part: np.ndarray) -> bytes:
    """Eight bytes of size, then the part compressed: a task's JVM holds many blocks."""
    return part.nbytes.to_bytes(8, "little") + pa.compress(part.tobytes(), "zstd", asbytes=True)


def _plain(part) -> pa.Buffer:
    part = memoryview(part)
    return pa.decompress(pa.py_buffer(part[8:]), int.from_bytes(part[:8], "little"), "zstd")


def _packed(parts: list, number: int) -> pa.RecordBatch:
    """One block of parts (data_ids, scales, owner, code, count, idf)."""
    first = np.cumsum([0, *(len(p[0]) for p in parts)])
    data, scale = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    row = np.concatenate([p[2] + f for p, f in zip(parts, first, strict=False)])
    code, count, idf = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5))
    order = np.argsort(code, kind="stable")
    names, start, sizes = np.unique(code[order], return_index=True, return_counts=True)
    kind = next(t for t in (np.uint8, np.uint16, float) if (count == count.astype(t)).all())
    columns = [data.astype(np.int64), scale.astype(float), names.astype(np.int64), idf[order][start].astype(float), sizes.astype(np.int32), row[order].astype(np.int32 if len(data) > 65_536 else np.uint16), count[order].astype(kind)]
    block = (TaskContext.get().partitionId() << 33) + number
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([_pressed(c)], pa.binary()) for c in columns)], ["block", *_PARTS])


def _packing(parts, block_rows: int):
    """Blocks of the rows of all parts, in their order."""
    held, rows, entries, number = [], 0, 0, 0
    for data, scale, owner, code, count, idf in parts:
        start = 0
        while start < len(data):
            end = min(len(data), start + block_rows - rows)
            a, b = np.searchsorted(owner, [start, end])
            held.append((data[start:end], scale[start:end], owner[a:b] - start, code[a:b], count[a:b], idf[a:b]))
            rows, entries, start = rows + end - start, entries + b - a, end
            if rows >= block_rows or entries >= BLOCK_ENTRIES:
                yield _packed(held, number)
                held, rows, entries, number = [], 0, 0, number + 1
    if held:
        yield _packed(held, number)


def packed(texts: DataFrame, vocabulary: DataFrame, weights: sparse.Weights | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The unit vectors of texts (data_id, chunk_id, text) in blocks, written. A value is a count, weighed by its gram's idf and its row's scale; if no
    task can hold the vocabulary, values come as they are from a join."""
    ship_package(texts.sparkSession)
    if weights is None:
        vectors = unit_vectors(texts, vocabulary, None)

        def joined(batches):
            for batch in batches:
                codes, n = batch.column("codes"), batch.num_rows
                owner = np.repeat(np.arange(n), codes.value_lengths().to_numpy())
                code = codes.flatten().to_numpy()
                yield batch.column("data_id").to_numpy(), np.ones(n), owner, code, batch.column("values").flatten().to_numpy(), np.ones(len(code))

        return materialise(vectors.mapInArrow(lambda batches: _packing(joined(batches), block_rows), BLOCKS), FILE_BLOCKS)
    held = texts.sparkSession.sparkContext.broadcast(weights)

    def counted(batches):
        known = held.value
        for (data,), rows in sparse._slices(batches, "data_id"):
            owner, code, count = sparse.counted_grams(rows, sparse.WORD_GRAMS)
            at, there = sparse._found(known.codes, code)
            owner, code, count, idf = owner[there], code[there], count[there], known.idf[at[there]]
            norm = np.sqrt(np.bincount(owner, (count * idf) ** 2, minlength=len(rows)))
            yield data, 1 / np.where(norm == 0, 1, norm), owner, code, count, idf

    return materialise(sparse.WORD_GRAMS.prepared(texts, "text", "data_id").mapInArrow(lambda batches: _packing(counted(batches), block_rows), BLOCKS), FILE_BLOCKS)


def _twins(rows: DataFrame, weights: sparse.Weights, block_rows: int) -> DataFrame:
    """Rows (data_id, text, own) in blocks of the texts' unit vectors, each with what is to be taken away from them to have those of ``own``, written."""
    ship_package(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(weights)

    def known(texts):
        owner, code, count = sparse.counted_grams(texts, sparse.WORD_GRAMS)
        at, there = sparse._found(held.value.codes, code)
        owner, count, at = owner[there], count[there], at[there]
        return owner, at, count, np.sqrt(np.bincount(owner, (count * held.value.idf[at]) ** 2, minlength=len(texts)))

    def counted(batches):
        codes, idf = held.value.codes, held.value.idf
        for batch in batches:
            own, start = batch.column("own").to_pylist(), 0
            for (data,), texts in sparse._slices([batch], "data_id"):
                for first in range(0, len(texts), block_rows):
                    some = texts[first : first + block_rows]
                    asked, n = own[start : start + len(some)], len(some)
                    start += n
                    owner, at, count, norm = known(some)
                    asker, place, times, length = known(asked)
                    pair, of = np.unique(np.concatenate([owner * len(codes) + at, asker * len(codes) + place]), return_inverse=True)
                    more = np.bincount(of, np.concatenate([count, -times]), len(pair))
                    pair, more = pair[more != 0], more[more != 0]
                    scale, less = (1 / np.where(x == 0, np.inf, x) for x in (norm, length))
                    vector = data[first : first + n], scale, owner, codes[at], count, idf[at]
                    at = pair % max(len(codes), 1)
                    yield vector, (data[first : first + n], less, pair // max(len(codes), 1), codes[at], more, idf[at]), norm * less

    def run(batches):
        waiting, n, entries, number = [], 0, 0, 0

        def packed():
            vectors, less, factor = zip(*waiting, strict=True)
            whole, rest = _packed(list(vectors), number), _packed(list(less), number)
            columns = [*whole.columns, *rest.columns[1:], pa.array([_pressed(np.concatenate(factor))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", *_PARTS, *_LESS, "factor"])

        for part in counted(batches):
            size = len(part[2])
            if waiting and (n + size > block_rows or entries >= BLOCK_ENTRIES):
                yield packed()
                waiting, n, entries, number = [], 0, 0, number + 1
            waiting.append(part)
            n, entries = n + size, entries + len(part[0][2])
        if waiting:
            yield packed()

    lower = lambda c: F.lower(F.coalesce(c, F.lit(""))).alias(c)
    return materialise(sparse.spread_small(rows.select("data_id", lower("text"), lower("own"))).mapInArrow(run, TWIN_BLOCKS), FILE_BLOCKS)


class _Nearest:
    """The best k texts for each row of a block, among the blocks that it meets one after the other."""

    def __init__(self, owner: np.ndarray, k: int):
        self.owner, self.k, self.held, self.kth = owner, k, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], np.zeros(len(owner))

    def meet(self, score: np.ndarray, data: np.ndarray, least: float = 0.0) -> None:
        n, k = len(data), self.k
        near = (score > least) & (score >= self.kth[:, None] - SLACK)
        if n > k and np.count_nonzero(near) > 2 * k * len(self.owner):
            near &= score >= np.partition(score, n - k, axis=1)[:, n - k, None] - SLACK
        i, j = np.nonzero(near)
        if len(i):
            self.held = list(sparse._best(k, *(np.concatenate(x) for x in zip(self.held, (i, data[j], score[i, j]), strict=True))))
            heads = np.flatnonzero(np.append(True, self.held[0][1:] != self.held[0][:-1]))
            full = np.diff(np.append(heads, len(self.held[0]))) >= k
            self.kth[self.held[0][heads][full]] = np.minimum.reduceat(self.held[2], heads)[full]

    def found(self) -> pa.RecordBatch:
        query, data, score = self.held
        return pa.RecordBatch.from_arrays([pa.array(self.owner[query], pa.int64()), pa.array(data, pa.int64()), pa.array(score, pa.float64())], ["query_id", "data_id", "score"])


def compared(rows: DataFrame, weights: sparse.Weights, k: int, cut: float | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows (data_id, text, own) all compared with each other once, for both: (query_id, data_id, score), the k texts nearest to each row's ``own``, zero
    scores left out; and, with ``cut``, one row (n, total), how many pairs of different data_ids have texts with a cosine above it, and the sum
    of these. The product of two blocks of texts gives the pairs, and less what the texts have more than ``own`` the lists of both blocks."""
    table = _twins(rows, weights, block_rows)

    def run(batches):
        number, left, lists, others, n, total = None, None, None, {}, 0, 0.0
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}

            def block(i, side, columns=columns):
                parts = [Block(*(columns[side + p][i].as_buffer() for p in names)) for names in (_PARTS, _LESS)]
                return *parts, np.frombuffer(_plain(columns[f"{side}factor"][i].as_buffer()))

            for i in range(batch.num_rows):
                mine, other = columns["block"][i].as_py(), columns["other_block"][i].as_py()
                if mine != number:
                    if lists is not None:
                        yield lists.found()
                    left, number = block(i, ""), mine
                    lists = _Nearest(left[0].data, k)
                right = left if mine == other else block(i, "other_")
                cosine = left[0].products(right[0])
                if cut is not None:
                    keep = (cosine > cut) & (left[0].data[:, None] != right[0].data)
                    some = cosine[np.triu(keep, 1) if mine == other else keep]
                    n, total = n + len(some), total + float(some.sum())
                lists.meet(left[2][:, None] * cosine - left[1].products(right[0]), right[0].data, NOISE)
                if mine != other:
                    if other not in others:
                        others[other] = _Nearest(right[0].data, k)
                    others[other].meet(right[2][:, None] * cosine.T - right[1].products(left[0]), left[0].data, NOISE)
        if lists is not None:
            yield lists.found()
        for one in others.values():
            yield one.found()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64()), pa.array([total])], ["query_id", "data_id", "score"])

    found = materialise(meetings(table, table, True).mapInArrow(run, "query_id long, data_id long, score double"))
    pairs = found.where("query_id is null").agg(F.coalesce(F.sum("data_id"), F.lit(0)).alias("n"), F.sum("score").alias("total"))
    return _cut(found.where("query_id is not null"), k), pairs


def _cut(lists: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "data_id")
    return lists.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k).drop("turn")


class Block:
    """The vectors of a block by gram."""

    def __init__(self, *parts: bytes):
        data, scale, names, idf, sizes, rows, counts = map(_plain, parts)
        self.data, self.scale, self.names = np.frombuffer(data, np.int64), np.frombuffer(scale), np.frombuffer(names, np.int64)
        self.n, self.sizes = len(self.data), np.frombuffer(sizes, np.int32).astype(np.int64)
        self.starts, total = np.cumsum(self.sizes) - self.sizes, int(self.sizes.sum())
        self.rows = np.frombuffer(rows, np.uint16 if len(rows) == 2 * total else np.int32).astype(np.int64)
        counts = np.frombuffer(counts, {1: np.uint8, 2: np.uint16, 8: float}[len(counts) // max(total, 1) or 8])
        self.values = counts * np.repeat(np.frombuffer(idf), self.sizes) * self.scale[self.rows]

    @cached_property
    def common(self) -> np.ndarray:
        """Places of the grams that more than RARE rows hold."""
        return np.flatnonzero(self.sizes > RARE)

    @cached_property
    def rare(self) -> np.ndarray:
        return np.flatnonzero(self.sizes <= RARE)

    @cached_property
    def slices(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Places of common grams, as many as a dense matrix may have columns, with that matrix while there are few."""
        width = max(1, CELLS // max(self.n, 1))
        cut = [self.common[a : a + width] for a in range(0, len(self.common), width)]
        return [(c, self.matrix(c, np.arange(len(c)), len(c)) if len(cut) <= 4 else None) for c in cut]

    def entries(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``places`` an entry belongs to, and where it stands, for all entries of the grams at these places."""
        sizes = self.sizes[places]
        of = np.repeat(np.arange(len(places)), sizes)
        return of, np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of] + self.starts[places][of]

    def matrix(self, places: np.ndarray, columns: np.ndarray, width: int) -> np.ndarray:
        of, at = self.entries(places)
        out = np.zeros((self.n, width))
        out[self.rows[at], columns[of]] = self.values[at]
        return out

    def products(self, other: Block) -> np.ndarray:
        """A row for each vector of this block, a column for each of the other."""
        out = np.zeros((self.n, other.n))
        for places, matrix in self.slices:
            column, there = sparse._found(self.names[places], other.names)
            if matrix is None:
                matrix = self.matrix(places, np.arange(len(places)), len(places))
            out += matrix @ other.matrix(np.flatnonzero(there), column[there], len(places)).T
        at, there = sparse._found(self.names[self.rare], other.names)
        mine, theirs = self.rare[at[there]], np.flatnonzero(there)
        pairs = np.cumsum(self.sizes[mine] * other.sizes[theirs])
        first = 0
        while first < len(mine):  # grams with about CELLS pairs of entries
            done = pairs[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(pairs, done + CELLS, side="right")))
            of, at = other.entries(theirs[first:end])
            times = self.sizes[mine[first:end]][of]
            each = np.repeat(np.arange(len(of)), times)
            own = self.starts[mine[first:end]][of][each] + np.arange(len(each)) - (np.cumsum(times) - times)[each]
            cell = self.rows[own] * other.n + other.rows[at[each]]
            out += np.bincount(cell, self.values[own] * other.values[at[each]], minlength=out.size).reshape(out.shape)
            first = end
        return out


def meetings(left: DataFrame, right: DataFrame, halved: bool) -> DataFrame:
    """A row for each pair of blocks, or with ``halved`` for each pair that is not ordered, dealt evenly. Spark makes it from both tables as a cartesian
    product; of the left one a task takes the blocks one by one."""
    left = left.coalesce(2 * left.sparkSession.sparkContext.defaultParallelism)
    right = right.select(*[F.col(c).alias(f"other_{c}") for c in right.columns])
    if not halved:
        return left.crossJoin(right)
    a, b = F.col("block"), F.col("other_block")
    return left.join(right, (a == b) | ((a < b) == (F.pmod(F.xxhash64(a.bitwiseXOR(b)), F.lit(2)) == 0)))


def _blocks(batches):
    """Pairs of blocks, whether the first is another one than before, and whether their numbers are equal."""
    left, last = None, None
    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        for i in range(batch.num_rows):
            number, other = columns["block"][i].as_py(), columns["other_block"][i].as_py()
            fresh = number != last
            if fresh:
                left, last = Block(*(columns[p][i].as_buffer() for p in _PARTS)), number
            right = Block(*(columns[f"other_{p}"][i].as_buffer() for p in _PARTS))
            yield left, right, fresh, number == other


def similar_pairs(texts: DataFrame, cut: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, similarity) of all rows (data_id, chunk_id, text) with a TF-IDF cosine above ``cut``, a < b."""
    table = packed(texts, *tfidf_model(texts), block_rows)

    def run(batches):
        for left, right, _, same in _blocks(batches):
            cosine = left.products(right)
            keep = (cosine > cut) & (left.data[:, None] != right.data)
            i, j = np.nonzero(np.triu(keep, 1) if same else keep)
            x, y = left.data[i], right.data[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(cosine[i, j])], ["a", "b", "similarity"])

    return meetings(table, table, True).mapInArrow(run, "a long, b long, similarity double")


def nearest(asked: DataFrame, texts: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, data_id, score): lists of the k texts nearest to each text of ``asked`` by TF-IDF cosine, zero scores left out; both are
    (data_id, chunk_id, text), and data_ids tell rows of each apart. A task cuts the lists of a block of queries to k over all blocks that it is given."""
    vocabulary, weights = tfidf_model(texts)
    queries, table = packed(asked, vocabulary, weights, block_rows), packed(texts, vocabulary, weights, block_rows)

    def run(batches):
        lists = None
        for left, right, fresh, _ in _blocks(batches):
            if fresh:
                if lists is not None:
                    yield lists.found()
                lists = _Nearest(left.data, k)
            lists.meet(left.products(right), right.data)
        if lists is not None:
            yield lists.found()

    return _cut(meetings(queries, table, False).mapInArrow(run, "query_id long, data_id long, score double"), k)
