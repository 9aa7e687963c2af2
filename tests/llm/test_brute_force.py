"""The ring of op2 row by row, and the links of op10 pair by pair."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from trawl.llm import secrets, sharding


def test_op2_against_a_ring_walked_row_by_row(spark):
    rng, shards, vnodes, ticks = random.Random(3), 6, 8, 64
    rows = [(i, rng.choice(["hot", f"t{i % 37}", f"x{i}", None])) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in sharding.shard_rows(docs, shards, vnodes, ticks).collect()}
    tick = {r.doc_id: r.t for r in docs.select("doc_id", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(ticks)).alias("t")).collect()}
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % ticks
    nodes = sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    clockwise = lambda t: [s for n, s in nodes if n >= t] + [s for n, s in nodes if n < t]
    want, homeless = Counter(), []
    for i in sorted(tick, key=lambda i: tick[i]):
        home = clockwise(tick[i])[0]
        assert got[i].home_shard == home and got[i].moved == (got[i].shard != home)
        if room[home]:
            room[home] -= 1
            want[tick[i], home] += 1
        else:
            homeless.append(i)
    for i in homeless:
        shard = next(s for s in clockwise(tick[i]) if room[s])
        room[shard] -= 1
        want[tick[i], shard] += 1
    assert len(homeless) > 50 and Counter((tick[i], r.shard) for i, r in got.items()) == want


def test_op10_links_against_all_pairs(spark):
    rng, scope = random.Random(5), 40
    names = {n: secrets.KINDS.index(n) for n in ("assign", "access", "hex", "part_id", "part_secret", "part_endpoint")}
    spans = []
    for rid in range(300):
        for _ in range(rng.randint(0, 9)):
            start = rng.randint(0, 300)
            spans.append((rid, rng.choice(list(names.values())), start, start + rng.choice([5, 9, 90])))
    spans = sorted(set(spans))
    got = secrets.link_parts(spark.createDataFrame(spans, "rid long, kind int, start long, end long").repartition(5), scope)
    of = lambda rid, *kinds: [s for s in spans if s[0] == rid and s[1] in {names[k] for k in kinds}]
    near = lambda a, others: any(abs(a[2] - b[2]) <= scope for b in others)
    want = []
    for rid in range(300):
        base = of(rid, "assign", "access", "hex")
        weak = [s for s in of(rid, "part_secret") if not any(s[2] < b[3] and b[2] < s[3] for b in base)]
        ids, found = of(rid, "part_id", "access"), of(rid, "assign", "hex") + weak
        want += [s for s in of(rid, "part_id") if near(s, found)] + [s for s in weak if near(s, ids)]
        want += [s for s in of(rid, "part_endpoint") if near(s, ids) and near(s, found)]
    rows = Counter((r.rid, r.kind, r.start, r.end) for r in got.collect())
    assert rows == Counter(want) and len(want) > 150


def test_op10_a_long_weak_span_is_covered_by_a_base_span_far_from_its_start(spark):
    """A run of letters over five scopes, its only base span in the last one: no identifier beside its start reports it."""
    kind = secrets.KINDS.index
    base = [(0, kind("part_id"), 0, 20), (0, kind("part_secret"), 30, 530)]
    late, apart = [(0, kind("access"), 495, 520)], [(1, k, s, e) for _, k, s, e in base] + [(1, kind("access"), 530, 550)]
    got = secrets.link_parts(spark.createDataFrame(base + late + apart, "rid long, kind int, start long, end long"), 100).collect()
    assert sorted((r.rid, r.kind, r.start, r.end) for r in got) == apart[:2]
