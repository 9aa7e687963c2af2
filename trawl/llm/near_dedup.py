"""MinHash near-dedup by BagMinHash.

A document is the multiset of its five-word shingles. Its signature comes from Poisson processes over
(shingle, weight level, time): weight levels are split into dyadic layers, every layer of a shingle has a
process of its own whose points carry a time, a level and a component, and a document sees those points whose
level lies below the shingle's count. Component c keeps its earliest point, so two documents agree
in it with a probability equal to their weighted Jaccard similarity. Layers are only opened as far as counts reach
and processes only run up to the time by which every component is filled.

Signatures are banded. In each bucket a document is offered one parent, the nearest of the bucket's leaders by
signature, and takes the nearest of all offers; these links, one a document at most, are verified first and join most copies of a text.
Then the buckets that still hold several clusters are gone through in full: pairs of documents of different clusters whose
signatures are near enough are verified in blocks, every pair in the first bucket that it shares, until their clusters are
joined or all pairs have failed. Verification is the exact overlap of the multisets of shingles, each shingle as 64 bits of hash.
What is shuffled of a text is that, once for its parent and once for each block in which it has a pair left. Copies of one text are one
document throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import Forest, connected_components, dealt, joined_batches, keep_rows, materialise, numpy_groups, release, ship_package, table
from trawl.llm.words import MULTIPLIER as _P
from trawl.llm.words import mix as _mix
from trawl.llm.words import word_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
COMPONENTS = BANDS * ROWS
#: Shares of components that differ: of a document and the leader it follows at most; of two documents of which one may be linked to the other.
LEADER_GAP, LINK_GAP = 0.15, 0.35
#: A bucket of more documents is first dealt in salted slices, whose leaders then meet.
HOT_BUCKET = 2_000
#: Documents and shingles of a block of those that are gone through in full, about.
BLOCK_DOCS, BLOCK_SHINGLES = 2_048, 2_000_000
BATCH_BYTES = 1_500_000


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each shingle. A text of fewer words is one shingle."""
    hashes, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    n = len(hashes)
    code = np.zeros(n, np.uint64)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    length = np.minimum(counts, words)[owner] if n else np.zeros(0, int)
    for k in range(words):
        inside = k < length
        code = np.where(inside, code * np.uint64(_P) + padded[k : k + n], code)
    last = np.cumsum(counts)
    keep = np.arange(n) + length <= last[owner]
    return _mix(code[keep] + length[keep].astype(np.uint64)), owner[keep]


def shingle_keys(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """Sorted text number * 2**44 + 44 bits of the hash of each shingle."""
    code, owner = shingle_hashes(texts, words)
    return np.sort(owner.astype(np.uint64) << np.uint64(44) | code >> np.uint64(20))


def bags(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Each text's multiset of shingles as a set: the k-th repeat of a shingle has a hash of its own."""
    code, owner = shingle_hashes(texts, words)
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    n = len(code)
    first = np.ones(n, bool)
    first[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    turn = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    code = np.where(turn > 0, _mix(code + turn.astype(np.uint64) * np.uint64(_P)), code)
    ends = np.searchsorted(owner, np.arange(len(texts)), side="right")
    return [np.sort(part) for part in np.split(code, ends[:-1])]


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets from ``bags``."""
    if not len(a) or not len(b):
        return 0.0
    both = np.sort(np.concatenate([a, b]))
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / (len(a) + len(b) - same)


def signatures(keys: np.ndarray, n: int, m: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """BagMinHash signatures (n, m) of the multisets in ``keys``, and their total weights."""
    elements, weights = np.unique(keys, return_counts=True)
    owner = (elements >> np.uint64(44)).astype(np.int64)
    total = np.bincount(owner, weights, minlength=n)
    out = np.full((n, m), np.inf)
    code = _mix(elements & np.uint64((1 << 44) - 1))
    layers = [np.arange(len(elements))]
    while len(layers[-1]):  # layer k > 0 holds the levels from 2**(k-1) to 2**k
        layers.append(layers[-1][weights[layers[-1]] > (1 << (len(layers) - 1))])
    which = np.concatenate(layers)
    layer = np.repeat(np.arange(len(layers)), [len(x) for x in layers])
    low = np.where(layer > 0, np.exp2(layer - 1), 0.0)
    width = np.where(layer > 0, np.exp2(layer - 1), 1.0)
    seed = _mix(code[which] + layer.astype(np.uint64) * np.uint64(_P))
    todo, reach = np.flatnonzero(total > 0), np.log(m) + 3.0
    while len(todo):
        limit = np.zeros(n)
        limit[todo] = reach / total[todo]
        live = np.flatnonzero(limit[owner[which]] > 0)
        time, drawn, block = np.zeros(len(live)), 0, 2
        while len(live):
            steps = np.arange(drawn, drawn + block, dtype=np.uint64)
            draw = _mix(seed[live, None] + (steps + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
            gaps = -np.log1p(-((draw >> np.uint64(11)).astype(float) / (1 << 53)))
            times = time[:, None] + np.cumsum(gaps, axis=1) / (width[live, None] * m)
            docs = owner[which[live]]
            extra = _mix(draw ^ np.uint64(0xA0761D6478BD642F))
            level = low[live, None] + width[live, None] * ((extra >> np.uint64(32)).astype(float) / (1 << 32))
            hit = (times <= limit[docs, None]) & (level < weights[which[live], None])
            at = docs[:, None] * m + ((extra & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(out.reshape(-1), at[hit], times[hit])
            time = times[:, -1]
            more = time <= limit[docs]
            live, time = live[more], time[more]
            drawn, block = drawn + block, min(64, block * 2)
        reach *= 2  # texts with an unfilled component run on; what they have stays the earliest
        todo = todo[np.isinf(out[todo]).any(axis=1)]
    return out, total


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Keys (n, BANDS) of the buckets of signatures, of one byte a component."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(sig), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * np.uint64(_P) + parts[:, :, r])
    return key.view(np.int64)


_SIGNED = "rid long, doc_id long, text_sha256 binary, weight long, bands array<long>, sig binary"


def _in_batches(batches, make):
    """Calls ``make`` with slices of batches that hold about BATCH_BYTES of text."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        start = 0
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and (end == start or held + len(texts[end]) < BATCH_BYTES):
                held += len(texts[end])
                end += 1
            yield make(batch.slice(start, end - start), texts[start:end])
            start = end


def _sign(batches):
    def make(rows, texts):
        n = len(texts)
        sig, total = signatures(shingle_keys(texts), n)
        sig = (_mix(sig.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(band_keys(sig).reshape(-1)))
        columns = [rows.column("rid"), rows.column("doc_id"), rows.column("sha"), pa.array(total.astype(np.int64)), bands]
        columns.append(pa.array([row.tobytes() for row in sig], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "text_sha256", "weight", "bands", "sig"])

    yield from _in_batches(batches, make)


def _bag(batches):
    def make(rows, texts):
        return pa.RecordBatch.from_arrays([rows.column("rid"), pa.array([b.tobytes() for b in bags(texts)], pa.binary())], ["rid", "bag"])

    yield from _in_batches(batches, make)


def _matrix(sigs: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.tolist()), np.uint8).reshape(len(sigs), -1)


def _comparable(weights: np.ndarray, weight: int, similarity: float) -> np.ndarray:
    """Whether multisets of such sizes can overlap enough."""
    return np.minimum(weights, weight) >= similarity * np.maximum(weights, weight)


_OFFERS = "rid long, parent long, gap int, key long, sig binary, weight long"


def _offers(similarity: float):
    """In each slice of a bucket: every document that another one may be near to, with the nearest leader before it as a parent if
    that is near enough; and the leaders of hot buckets, with their key, for the next turn."""

    def run(batches):
        for group in numpy_groups(batches, ["key", "salt"]):
            order = np.argsort(group["rid"])
            ids, weights, hot = group["rid"][order], group["weight"][order], bool(group["hot"][0])
            sig, n = _matrix(group["sig"][order]), len(ids)
            best, parent = np.full(n, COMPONENTS + 1, np.int32), np.zeros(n, np.int64)
            near, follows = np.full(n, hot), np.zeros(n, bool)
            for x in range(n):
                if follows[x]:
                    continue
                gaps = np.count_nonzero(sig[x + 1 :] != sig[x], axis=1).astype(np.int32)
                fits = _comparable(weights[x + 1 :], weights[x], similarity)
                in_range = gaps <= (LINK_GAP + LEADER_GAP) * COMPONENTS
                near[x] |= in_range.any()
                near[x + 1 :] |= in_range
                closer = fits & (gaps <= LINK_GAP * COMPONENTS) & (gaps < best[x + 1 :])
                best[x + 1 :][closer], parent[x + 1 :][closer] = gaps[closer], ids[x]
                follows[x + 1 :] |= fits & (gaps <= LEADER_GAP * COMPONENTS)
            out, none = np.flatnonzero(near), np.zeros(n, bool)
            yield _offer_rows(ids[out], parent[out], best[out], best[out] > COMPONENTS, None, none[out], none[out])
            if hot:
                own = np.flatnonzero(~follows)
                missing = np.ones(len(own), bool)
                yield _offer_rows(ids[own], own, own.astype(np.int32), missing, group["key"][own], group["sig"][order][own], weights[own])

    return lambda batches: joined_batches(run(batches))


def _offer_rows(ids, parent, gap, missing, key, sig, weight):
    n = len(ids)
    turn = [pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.int64())]
    if key is not None:
        turn = [pa.array(key, pa.int64()), pa.array(sig.tolist(), pa.binary()), pa.array(weight, pa.int64())]
    columns = [pa.array(ids, pa.int64()), pa.array(parent, pa.int64(), mask=missing), pa.array(gap, pa.int32(), mask=missing), *turn]
    return pa.RecordBatch.from_arrays(columns, ["rid", "parent", "gap", "key", "sig", "weight"])


def candidates(members: DataFrame, similarity: float, hot_bucket: int) -> DataFrame:
    """(rid, parent): all documents that may be linked to another one, with the nearest parent offered in any bucket, null if none was.

    A hot bucket's slices are a short cut that may miss the nearest parent, not a pair: parents only decide what is verified first."""
    found, salt, spent, hot = [], 0, [], not members.where(F.col("n") > hot_bucket).isEmpty()
    while True:
        slices = F.ceil(F.col("n") / hot_bucket)
        salted = members.select("key", F.pmod(F.xxhash64("rid", "key", F.lit(salt)), slices).cast("int").alias("salt"), (slices > 1).alias("hot"), "rid", "sig", "weight")
        turn = dealt(salted, members.count(), 20_000, "key", "salt").mapInArrow(_offers(similarity), _OFFERS)
        turn = materialise(turn) if hot else turn
        found.append(turn.where("key is null").select("rid", "parent", "gap"))
        if not hot:
            break
        spent.append(turn)
        left = turn.where("key is not null").select("key", "rid", "sig", "weight")
        fewer = left.groupBy("key").agg(F.count(F.lit(1)).alias("now"))
        before = members.select("key", F.col("n").alias("before")).distinct()
        going = fewer.join(before, "key").where((F.col("now") > 1) & (F.col("now") < 0.7 * F.col("before")))
        members = materialise(left.join(going.select("key", F.col("now").alias("n")), "key"))
        spent.append(members)
        hot = not members.where(F.col("n") > hot_bucket).isEmpty()
        salt += 1
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    nearest = F.min(F.when(F.col("parent").isNotNull(), F.struct("gap", "parent"))).alias("nearest")
    out = materialise(every.groupBy("rid").agg(nearest).select("rid", "nearest.parent"))
    release(*spent)
    return out


def _verify_parents(similarity: float):
    """A parent, then its offspring: those that are similar enough, as links."""

    def run(batches):
        at, base = None, None
        for batch in batches:
            links = []
            parents, parts, rids, raws = (batch.column(c).to_pylist() for c in ("parent", "part", "rid", "bag"))
            for parent, part, rid, raw in zip(parents, parts, rids, raws, strict=True):
                bag = np.frombuffer(raw, np.uint64)
                if rid == parent:
                    at, base = (parent, part), bag
                elif at == (parent, part) and overlap(base, bag) >= similarity:
                    links.append((parent, rid))
            columns = list(zip(*links, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return run


def _parent_links(found: DataFrame, bag: DataFrame, similarity: float, block_docs: int) -> DataFrame:
    """Verified links of documents and their parents. A parent of many is dealt to several parts."""
    rows = found.where("parent is not null")
    sizes = rows.groupBy("parent").agg(F.ceil(F.count(F.lit(1)) / block_docs).cast("int").alias("parts"))
    young = rows.join(sizes, "parent").select("parent", F.pmod(F.xxhash64("rid"), "parts").cast("int").alias("part"), "rid")
    old = sizes.select("parent", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("parent").alias("rid"))
    every = young.union(old).join(bag.select("rid", "bag"), "rid").select("parent", "part", (F.col("rid") != F.col("parent")).alias("after"), "rid", "bag")
    tasks = max(every.sparkSession.sparkContext.defaultParallelism, -(-found.count() // 5_000))
    every = every.repartition(tasks, "parent", "part").sortWithinPartitions("parent", "part", "after")
    return every.drop("after").mapInArrow(_verify_parents(similarity), "a long, b long")


def _blocks(members: DataFrame, clusters: DataFrame, block_docs: int) -> DataFrame:
    """Blocks of the buckets with several clusters: (key, block, side, rid, cluster, sig, weight). A bucket's documents are dealt in
    parts and all pairs of parts are blocks. A cluster that fills parts has lanes of its own, whose parts meet those of other
    lanes only; the bucket's other documents share lane -1."""
    named = members.join(clusters.select(F.col("node").alias("rid"), F.col("component").alias("cluster")), "rid", "left")
    named = named.select("key", "rid", F.coalesce("cluster", "rid").alias("cluster"), "sig", "weight")
    counts = materialise(named.groupBy("key", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")))
    several = counts.groupBy("key").agg(F.count(F.lit(1)).alias("clusters")).where("clusters > 1").select("key")
    fill = F.greatest(F.col("n") / block_docs, F.col("weight") / BLOCK_SHINGLES)
    laned = counts.join(several, "key").withColumn("lane", F.when(fill >= 1, F.col("cluster")).otherwise(F.lit(-1))).withColumn("fill", fill)
    lanes = laned.groupBy("key", "lane").agg(F.ceil(F.sum("fill")).cast("int").alias("parts"))
    placed = named.join(laned.select("key", "cluster", "lane"), ["key", "cluster"]).join(lanes, ["key", "lane"])
    placed = placed.withColumn("own", F.struct("lane", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part"))).drop("parts")
    others = lanes.select("key", F.col("lane").alias("lane2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    others = others.select("key", "lane2", F.struct(F.col("lane2").alias("lane"), "part").alias("other"))
    met = placed.join(others, "key").where("lane <> lane2 or lane = -1")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    out = met.select(
        "key",
        F.concat_ws("/", low["lane"], low["part"], high["lane"], high["part"]).alias("block"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
        "rid",
        "cluster",
        "sig",
        "weight",
    )
    out = materialise(out)
    release(counts)
    return out


def _open_pairs(group: dict, similarity: float):
    """Of a block: (i, j, gap) of the documents of different clusters that may be linked and share no bucket before this one."""
    clusters, sides, weights = group["cluster"], group["side"], group["weight"]
    sig, key = _matrix(group["sig"]), group["key"][0]
    bands = band_keys(sig)
    first, second, apart = [], [], []
    for i in range(len(sig) - 1):
        rest = slice(i + 1, len(sig))
        ok = _comparable(weights[rest], weights[i], similarity) & (clusters[rest] != clusters[i])
        if sides[i]:  # documents of one side meet in that side's own block
            ok &= sides[rest] != sides[i]
        at = np.flatnonzero(ok) + i + 1
        gaps = np.count_nonzero(sig[at] != sig[i], axis=1)
        at, gaps = at[gaps <= LINK_GAP * COMPONENTS], gaps[gaps <= LINK_GAP * COMPONENTS]
        if len(at):
            shared = bands[at] == bands[i]
            own = bands[i][shared.argmax(axis=1)] == key
            at, gaps = at[own], gaps[own]
            first.append(np.full(len(at), i))
            second.append(at)
            apart.append(gaps)
    if not first:
        return (np.zeros(0, int),) * 3
    return np.concatenate(first), np.concatenate(second), np.concatenate(apart)


def _with_pairs(similarity: float):
    """The documents of each block that have a pair to be verified."""

    def run(batches):
        for group in numpy_groups(batches, ["key", "block"]):
            i, j, _ = _open_pairs(group, similarity)
            if len(i):
                kept = np.unique(np.concatenate([i, j]))
                types = {"key": pa.int64(), "block": pa.string(), "side": pa.int32(), "rid": pa.int64(), "cluster": pa.int64(), "sig": pa.binary(), "weight": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(group[c][kept], t) for c, t in types.items()], list(types))

    return lambda batches: joined_batches(run(batches))


def _verify_blocks(similarity: float):
    """Links of clusters, as many as join what was apart."""

    def run(batches):
        for group in numpy_groups(batches, ["key", "block"]):
            i, j, gaps = _open_pairs(group, similarity)
            clusters, raw = group["cluster"].tolist(), group["bag"]
            forest, links = Forest(), []
            for at in np.argsort(gaps, kind="stable").tolist():
                x, y = clusters[i[at]], clusters[j[at]]
                if forest.root(x) != forest.root(y):
                    if overlap(np.frombuffer(raw[i[at]], np.uint64), np.frombuffer(raw[j[at]], np.uint64)) >= similarity:
                        forest.join(x, y)
                        links.append((x, y))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return lambda batches: joined_batches(run(batches))


_BLOCK = "key long, block string, side int, rid long, cluster long, sig binary, weight long"


def _linked(rows: DataFrame, heads: DataFrame, similarity: float, block_docs: int, hot_bucket: int) -> tuple[DataFrame, list[DataFrame]]:
    """(node, component) of all documents that are linked to others, and the scratch tables that it reads."""
    banded = heads.where("weight > 0").select("rid", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sharing = materialise(banded.join(shared, "key"))
    members = materialise(sharing.join(heads.select("rid", "sig", "weight"), "rid"))
    found = candidates(members, similarity, hot_bucket)
    wanted = found.join(heads.select("rid", "doc_id", "text_sha256"), "rid")
    wanted = wanted.select("rid", F.col("doc_id").alias("head_id"), F.col("text_sha256").alias("head_sha"))
    wanted = wanted.hint("shuffle_hash")  # one row a text at most on that side, at any size
    texts = rows.join(wanted, (F.col("sha") == F.col("head_sha")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    bag = materialise(texts.select("rid", "text").dropDuplicates(["rid"]).mapInArrow(_bag, "rid long, bag binary"))

    clusters = materialise(connected_components(_parent_links(found, bag, similarity, block_docs)))
    blocks = _blocks(members, clusters, block_docs)
    n = blocks.count()
    open_ = dealt(blocks, n, 20_000, "key", "block").mapInArrow(_with_pairs(similarity), _BLOCK)
    across = dealt(open_.join(bag, "rid"), n, 5_000, "key", "block").mapInArrow(_verify_blocks(similarity), "a long, b long")
    joined = materialise(connected_components(across).select(F.col("node").alias("cluster"), F.col("component").alias("whole")))
    names = clusters.select("node", F.col("component").alias("cluster"))
    release(sharing, members, found, bag, blocks)
    lone = joined.join(names.select(F.col("node").alias("cluster")), "cluster", "left_anti").select(F.col("cluster").alias("node"), "cluster")
    every = names.unionByName(lone).join(joined, "cluster", "left").select("node", F.coalesce("whole", "cluster").alias("component"))
    return every, [clusters, joined]


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, block_docs: int = BLOCK_DOCS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, group_id, group_size, kept, text_sha256.

    Rows are linked when the weighted Jaccard similarity of their multisets of five-word shingles is
    ``similarity`` or more (words are runs of anything but ASCII white space, taken as they are); a group is what links reach.
    group_id is the group's smallest doc_id (null only if it has no other); of its rows one with that doc_id is kept, that with the first sha256 of
    its text if several texts have it.
    Texts of fewer words are one shingle; a text without words (null, empty, blank) is linked only to rows with
    exactly its text, null counting as empty. Very long texts are taken whole, at eight bytes a word where they are compared. Rows may
    repeat a doc_id. Other columns are ignored, whatever their names; an empty table gives an empty result.

    At a similarity of 0.8 a pair shares no bucket with probability (1 - 0.8**5)**24 = 7.3e-5, and has more than 42 of 120 components
    apart with probability 3.7e-5, so that a link at the threshold itself is missed with a probability of 1.1e-4; others less.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"))
    signed = materialise(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_sign, _SIGNED))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256", "rid")).alias("head")
    classes = signed.groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes.select("text_sha256", "head.rid", "head.doc_id", "copies"))
    # one document a text from here on; its number is that of its class's first row
    heads = materialise(signed.join(classes.select("rid"), "rid"))
    linked, read = _linked(rows, heads, similarity, block_docs, hot_bucket)

    several = classes.join(linked, classes["rid"] == linked["node"])
    several = materialise(several.select("text_sha256", "component", "copies", "doc_id", "rid"))
    totals = several.groupBy("component").agg(F.sum("copies").alias("group_size"), first)
    totals = totals.select("component", "group_size", F.col("head.doc_id").alias("group_id"), F.col("head.rid").alias("keep_rid"))
    several = materialise(several.join(totals, "component").select("text_sha256", "group_id", "group_size", "keep_rid", F.lit(True).alias("grouped")))
    joined = classes.join(several, "text_sha256", "left")

    def choose(group, own):
        return F.when(F.col("grouped"), F.col(group)).otherwise(F.col(own)).alias(group)

    of_text = materialise(joined.select("text_sha256", choose("group_id", "doc_id"), choose("group_size", "copies"), choose("keep_rid", "rid")))
    plain = materialise(signed.select("rid", "doc_id", "text_sha256"))
    release(signed, classes, heads, several, *read)
    out = plain.join(of_text, "text_sha256")
    return out.select(
        "doc_id", "group_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256")
    )


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of ``docs``, whole."""
    return keep_rows(docs, near_duplicates(docs, **options))


def op6_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: list_aggregate(words[i:i + 4], 'string_agg', ' '))) AS shingle
  FROM w WHERE len(words) > 0
), bag AS (SELECT doc_id, shingle, count(*) AS n FROM s GROUP BY 1, 2),
total AS (SELECT doc_id, sum(n) AS weight FROM bag GROUP BY 1),
both_ AS (
  SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS n FROM bag a JOIN bag b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM both_ JOIN total p ON p.doc_id = x JOIN total q ON q.doc_id = y WHERE n::DOUBLE / (p.weight + q.weight - n) >= 0.8
  UNION SELECT min(doc_id) OVER (PARTITION BY text), doc_id FROM w
), way AS (SELECT x, y FROM link UNION SELECT y, x FROM link UNION SELECT x, x FROM link),
reach AS (SELECT x, y FROM way UNION SELECT r.x, v.y FROM reach r JOIN way v ON r.y = v.x),
g AS (SELECT x AS doc_id, min(y) AS group_id FROM reach GROUP BY 1)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size,
       doc_id = group_id AS kept, sha256(text) AS text_sha256
FROM g JOIN w USING (doc_id)
"""
