"""Maximal repetitions of words, from the longest common extensions of suffix trees.

A text's words get Ukkonen trees of themselves and of their reversal. An Euler tour of each, with block-wise minima, answers the
longest common extension of any two places in constant time, as the depth of their leaves' lowest common ancestor. Every run
of exponent two or more has a root that is the longest Lyndon word where it begins, under some order of words or the reverse
order; so the longest Lyndon words of both orders, which follow from the order of leaves, are all the candidates there are,
and each is extended to both sides.

Words that no run can hold get no tree: inside a run every short sequence of words comes at least twice, so sequences that a text
holds once cut it into stretches that are looked at on their own. No run crosses such a cut, and none ends at one that it could pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import ship_package, table, text_slices
from trawl.llm.words import mix

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_EXPONENT = 24, 3
#: Bytes of text whose words are coded at once; the longest sequence of words that stretches are cut by; places whose minima are kept together.
SLICE_BYTES, MOST_GRAM, BLOCK = 2_000_000, 16, 32


class Minima:
    """Minima of ranges of an array, in constant time each: within and between blocks of places."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // BLOCK)
        held = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        held[: len(values)] = values
        self.grid = held.reshape(blocks, BLOCK)
        self.before = np.minimum.accumulate(self.grid, axis=1)
        self.after = np.minimum.accumulate(self.grid[:, ::-1], axis=1)[:, ::-1]
        self.powers = [self.grid.min(axis=1)]
        while 2 << (len(self.powers) - 1) <= blocks:
            last, half = self.powers[-1], 1 << (len(self.powers) - 1)
            self.powers.append(np.minimum(last[:-half], last[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least value from a to b, both included, of each pair of places."""
        a, b = np.minimum(a, b), np.maximum(a, b)
        first, last = a // BLOCK, b // BLOCK
        out = np.minimum(self.after[first, a % BLOCK], self.before[last, b % BLOCK])
        same = np.flatnonzero(first == last)
        if len(same):
            place = np.arange(BLOCK)
            inside = (place >= (a[same] % BLOCK)[:, None]) & (place <= (b[same] % BLOCK)[:, None])
            out[same] = np.where(inside, self.grid[first[same]], np.iinfo(np.int32).max).min(axis=1)
        gap = last - first - 1
        power = np.frexp(np.maximum(gap, 1))[1] - 1
        for k in np.unique(power[gap > 0]).tolist():
            on = np.flatnonzero((gap > 0) & (power == k))
            held = self.powers[k]
            out[on] = np.minimum(out[on], np.minimum(held[first[on] + 1], held[last[on] - (1 << k)]))
        return out


class SuffixTree:
    """Ukkonen's tree of a sequence of codes from 1; a 0 behind it ends every suffix in a leaf of its own."""

    def __init__(self, codes: list[int]):
        self.n = len(codes)
        self.codes = [*codes, 0]
        self.width = max(self.codes) + 1
        self._build()
        self._order()

    def _build(self) -> None:
        codes, width, size = self.codes, self.width, len(self.codes)
        start, stop, link, edge = [0], [0], [0], {}
        node = at = length = left = 0
        for i, code in enumerate(codes):
            left += 1
            unlinked = 0
            while left:
                if not length:
                    at = i
                key = node * width + codes[at]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(start)
                    start.append(i)
                    stop.append(size)
                    link.append(0)
                    inner = node
                else:
                    span = stop[child] - start[child]
                    if length >= span:
                        at, length, node = at + span, length - span, child
                        continue
                    middle = start[child] + length
                    if codes[middle] == code:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    inner = len(start)
                    edge[key] = inner
                    start += [start[child], i]
                    stop += [middle, size]
                    link += [0, 0]
                    start[child] = middle
                    edge[inner * width + code] = inner + 1
                    edge[inner * width + codes[middle]] = child
                if unlinked:
                    link[unlinked] = inner
                unlinked = inner
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - left + 1
        keys = np.fromiter(edge.keys(), np.int64, len(edge))
        self.child = np.fromiter(edge.values(), np.int64, len(edge))
        self.parent, self.symbol = keys // width, keys % width
        self.span = np.array(stop, np.int64) - np.array(start, np.int64)

    def _children(self, symbol: np.ndarray) -> tuple[list[int], list[int]]:
        """All nodes' children by ``symbol``, and where each node's begin."""
        order = np.lexsort((symbol, self.parent))
        heads = np.searchsorted(self.parent[order], np.arange(len(self.span) + 1))
        return self.child[order].tolist(), heads.tolist()

    def _order(self) -> None:
        """The Euler tour, and the ranks of suffixes by ascending codes; an end comes before all codes."""
        children, heads = self._children(self.symbol)
        span = self.span.tolist()
        tour, seen, ranks = [], [0] * (self.n + 1), [0] * (self.n + 1)
        rank, size = 0, self.n + 1
        path, depths, nexts = [0], [0], [heads[0]]
        tour.append(0)
        while path:
            node, place = path[-1], nexts[-1]
            if place == heads[node + 1]:
                path.pop()
                depths.pop()
                nexts.pop()
                if path:
                    tour.append(depths[-1])
                continue
            nexts[-1] = place + 1
            child = children[place]
            depth = depths[-1] + span[child]
            if heads[child] == heads[child + 1]:
                suffix = size - depth
                seen[suffix], ranks[suffix] = len(tour), rank
                rank += 1
                tour += (depth, depths[-1])
            else:
                path.append(child)
                depths.append(depth)
                nexts.append(heads[child])
                tour.append(depth)
        self.seen, self.ranks = np.array(seen, np.int64), ranks
        self.minima = Minima(np.array(tour, np.int32))

    def turned_ranks(self) -> list[int]:
        """The ranks of suffixes by descending codes; an end still comes before all codes."""
        children, heads = self._children(np.where(self.symbol == 0, -self.width, -self.symbol))
        span, size = self.span.tolist(), self.n + 1
        out, rank, open_ = [0] * size, self.n, [(0, 0)]
        while open_:  # the last child comes first here, so ranks are dealt from the end
            node, depth = open_.pop()
            depth += span[node]
            if heads[node] == heads[node + 1]:
                out[size - depth] = rank
                rank -= 1
            else:
                open_ += [(child, depth) for child in children[heads[node] : heads[node + 1]]]
        return out

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes the suffixes from each two different places share."""
        return self.minima.of(self.seen[a], self.seen[b]).astype(np.int64)


def longest_lyndon(ranks: list[int], n: int) -> np.ndarray:
    """The end of the longest Lyndon word that begins at each place: where the next smaller suffix begins."""
    ends = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j = i + 1
        while j < n and ranks[j] > ranks[i]:
            j = ends[j]
        ends[i] = j
    return np.array(ends[:n], np.int64)


def find_runs(codes: list[int], least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least`` codes and ``exponent`` periods or more, by start and period."""
    n = len(codes)
    if n < least:
        return []
    tree, back = SuffixTree(codes), SuffixTree(codes[::-1])
    i = np.arange(n)
    ends = [longest_lyndon(ranks, n) for ranks in (tree.ranks, tree.turned_ranks())]
    i, end = np.concatenate([i, i]), np.concatenate(ends)
    period = end - i
    right = tree.extension(i, end)
    left = back.extension(n - i, n - end)
    start, length = i - left, left + period + right
    held = np.flatnonzero(length >= np.maximum(least, exponent * period))
    return sorted(set(zip(start[held].tolist(), length[held].tolist(), period[held].tolist(), strict=True)), key=lambda run: (run[0], run[2]))


def gram_size(least: int, exponent: int) -> int:
    """The longest sequence of words that comes twice wherever it lies in a run: a run of period q holds 2q - 1 more words at least."""
    q = least // exponent
    return max(1, min(MOST_GRAM, least - 2 * q + 1, (exponent - 2) * (q + 1) + 1))


def repeated_stretches(codes: np.ndarray, bounds: np.ndarray, size: int, least: int) -> list[tuple[int, int, int]]:
    """(text, start, end) of the stretches of words that all lie in sequences of ``size`` which their text holds more than once. Equal
    hashes of different sequences only lengthen a stretch."""
    n = len(codes) - size + 1
    if n < 1:
        return []
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    word, hashes = mix(codes.astype(np.uint64) + np.uint64(1)), np.zeros(n, np.uint64)
    for k in range(size):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    places = np.flatnonzero(owner[:n] == owner[size - 1 :])
    hashes = mix(hashes[places] ^ mix(owner[places].astype(np.uint64)))
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(len(places), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, places[again], 1)
    np.add.at(cover, places[again] + size, -1)
    covered = np.cumsum(cover)[:-1] > 0
    first = covered.copy()
    first[1:] &= ~covered[:-1] | (owner[1:] != owner[:-1])
    last = covered.copy()
    last[:-1] &= ~covered[1:] | (owner[1:] != owner[:-1])
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    held = stops - starts >= least
    return list(zip(owner[starts[held]].tolist(), starts[held].tolist(), stops[held].tolist(), strict=True))


def runs_of_texts(words: list[list[bytes]], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words."""
    names: dict[bytes, int] = {}
    codes = np.array([names.setdefault(w, len(names)) for own in words for w in own], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(own) for own in words])]).astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for text, start, stop in repeated_stretches(codes, bounds, gram_size(least, exponent), least):
        own = np.unique(codes[start:stop], return_inverse=True)[1] + 1
        offset = start - int(bounds[text])
        out[text] += [(offset + a, length, period) for a, length, period in find_runs(own.tolist(), least, exponent)]
    return out


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _finder(least: int, exponent: int):
    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, SLICE_BYTES):
                words = [t.encode().split() for t in texts]  # at ASCII white space, as WORD does
                runs = runs_of_texts(words, least, exponent)
                kept = []
                for own, found in zip(words, runs, strict=True):
                    gone = np.zeros(len(own), bool)
                    for start, length, period in found:
                        gone[start + period : start + length] = True
                    kept.append(b" ".join([own[i] for i in np.flatnonzero(~gone)] if found else own).decode())
                listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
                columns = [pa.array([len(w) for w in words], pa.int64()), pa.array(listed, _RUNS), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, collapsed.

    ``runs`` are (start, length, period) of all stretches of words that repeat with their smallest period and that no
    neighbouring word extends, of ``least`` words and ``exponent`` (2 or more) periods at least, by start, then period; ``collapsed``
    is the text's words without those that any run holds behind its first period, joined by spaces. A null text has no words. Only
    doc_id and text are read, whatever other columns are called. A text is looked at whole: one of n repeated words takes n steps
    and about a kilobyte a word in its task. Repeated rows are looked at one by one; ties do not arise; an empty table gives an empty
    result. No shuffle.
    """
    if exponent < 2:
        raise ValueError("runs repeat twice at least")
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(_finder(least, exponent), "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by the crc32 of its id repeats some of its words from some place on."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        every = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, at(i)))
        return F.when(n > 0, F.array_join(every, " ")).otherwise("")

    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    changed = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longer = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda held, r: F.when(longer(held, r), r).otherwise(held))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
