"""Periodic runs, byte-level BPE and the Merkle manifest against brute force and the library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from trawl.llm import byte_bpe, merkle, periodic_runs

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, size string, tree int, block int, node string, runs int, part int, above string, packed_ids int"
EXTRA = (1, "s", 2, 3, "n", 4, 5, "a", 6)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(170):
        words = rng.choices(["la", "le", "lu", "été", "x" * 9], k=rng.randint(0, 120))
        if i % 3 == 0 and words:
            a = rng.randrange(len(words))
            p = 1 + (len(words) - a) // rng.randint(3, 9)
            words = [words[j if j < a else a + (j - a) % p] for j in range(len(words))]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for w in words)
        out.append((i * 7, text, rng.choice(["en", None]), rng.choice(["a", "a", "a", "b", "é", "", None]), rng.choice([i, None])))
    out += [out[5], out[5], (out[5][0], "other\n", "en", out[5][3], 1), (None, None, None, None, None), (None, "no id\n", None, "a", 3), (None, "", "", "", 0)]
    out += [(5000, "la " * 9000, "en", "a", 1), (5001, "x" * 50_000, "en", "b", 1), (5002, "\n \x0b\x1c   y", "en", "only", 9)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(5)


def brute_runs(w, least, exponent):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            own = w[i : j + q]
            if len(own) >= max(least, exponent * q) and not any(all(own[k] == own[k + r] for k in range(len(own) - r)) for r in range(1, q)):
                out.add((i, len(own), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_find_runs():
    rng, found = random.Random(1), 0
    for _ in range(600):
        w = rng.choices(range(1, rng.choice([2, 3, 4, 20])), k=rng.randint(0, 70))
        for least, exponent in ((2, 2), (5, 2), (24, 3), (10, 3), (9, 5)):
            want = brute_runs(w, least, exponent)
            found += len(want)
            assert periodic_runs.find_runs(w, least, exponent) == want
            text = [str(x).encode() for x in w]
            assert periodic_runs.runs_of_texts([text, [b"z"], text], least, exponent) == [want, [], want]
    assert found > 3000


def test_minima():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1000, 3333)
    held = periodic_runs.Minima(values)
    a, b = rng.integers(0, 3333, (2, 4000))
    assert held.of(a, b).tolist() == [values[min(x, y) : max(x, y) + 1].min() for x, y in zip(a, b, strict=True)]


def words_of(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i if i < a else a + (i - a) % p] for i in range(n)]


def test_op11(spark, docs, rows, tmp_path):
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want, with_runs, planted = [], 0, 0
    for doc_id, text, *_ in rows:
        w = words_of(doc_id, text)
        planted += w != (text or "").encode().split()
        runs = [(0, 9000, 1)] if len(w) == 9000 else brute_runs(w, 24, 3)
        with_runs += bool(runs)
        best, gone = (None,) * 4, set()
        for s, n, q in runs:
            gone.update(range(s + q, s + n))
            if best[0] is None or n * best[2] > best[1] * q:
                best = (s, n, q, 1000 * n // q)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=repr) and with_runs > 20 and planted > 5
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, exponent=1)


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    import tiktoken

    with open(P.path(request.param), "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.Vocabulary(ranks, P.PATTERN), library


def test_encodes_as_the_library(both):
    own, library = both
    rng, tokens = random.Random(4), list(own.ranks)
    texts = ["", "<|endoftext|>", "a" * 30_000, " " * 5_000 + "x", "".join(rng.choices("abcd", k=40_000)), "é" * 9_000]
    for _ in range(4_000):
        texts.append(b"".join(rng.choices(tokens, k=rng.randint(1, 6))).decode("utf-8", "ignore"))
        texts.append("".join(rng.choices("abteAn'1. \n", k=rng.randint(0, 40))))
        texts.append("".join(chr(rng.choice([rng.randint(0, 0x24F), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(1, 12))))
    packed = own.encode(texts)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == library.encode_ordinary_batch(texts)
    assert [own.decode(p) for p in packed] == [t.encode() for t in texts]


def test_remembers_within_bounds(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(byte_bpe, "HELD_WORDS", 50)
    monkeypatch.setattr(byte_bpe, "HELD_PAIRS", 20)
    rng = random.Random(6)
    for _ in range(40):
        texts = [" ".join("".join(rng.choices("etaoin", k=rng.randint(1, 90))) for _ in range(6)) for _ in range(3)]
        assert [np.frombuffer(p, "<u4").tolist() for p in own.encode(texts)] == library.encode_ordinary_batch(texts)
        assert len(own.words) <= 50 and len(own.agreed) <= 20


def test_op12(spark, docs, rows, both, tmp_path):
    library = both[1]
    path = P.path("byte_bpe_50k.tiktoken")
    found = byte_bpe.encode_decode(docs, path, P.PATTERN)
    got = {(r.doc_id, bytes(r.decoded).decode()): r for r in found.withColumn("ids", byte_bpe.unpacked(found.packed_ids)).collect()}
    assert set(got) == {(r[0], r[1] or "") for r in rows} and found.count() == len(rows)
    if library.n_vocab and both[0].ranks == byte_bpe.read_ranks(open(path, "rb").read()):
        assert all(r.ids == library.encode_ordinary(text) and r.n_tokens == len(r.ids) for (_, text), r in got.items())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in byte_bpe.op12_byte_bpe(spark, str(tmp_path)).collect():
        own = [g for (i, _), g in got.items() if i == r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in {(g.n_tokens, hashlib.sha256(g.packed_ids).hexdigest(), hashlib.sha256(g.decoded).hexdigest()) for g in own}
    assert byte_bpe.encode_decode(docs.limit(0), path, P.PATTERN).count() == 0


def test_ranks_out_of_order():
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 4}, P.PATTERN)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields):
    return H(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def grown(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def climbed(levels, at, fold):
    beside = []
    for nodes in levels[:-1]:
        first = at - at % 3
        run = range(first, min(first + 3, len(nodes)))
        beside += [nodes[i] for i in run if i != at]
        fold = H(*[fold if i == at else nodes[i] for i in run])
        at //= 3
    return beside, fold


def brute_manifest(rows, changed):
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf_of((doc_id, source, lang, n_chars, text))
        by_source[source].append((doc_id is not None, doc_id or 0, own, leaf_of((doc_id, source, lang, n_chars, changed(doc_id, text)))))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grown([r[2] for r in sorted(by_source[s])]) for s in order}
    top = grown([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for at, (known, doc_id, own, other) in enumerate(sorted(by_source[s])):
            below, fold = climbed(trees[s], at, other)
            above, fold = climbed(top, place, fold)
            out.append((doc_id if known else None, own, trees[s][-1][0], top[-1][0], H(*below, *above), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def tampered(doc_id, text):
    return text if text is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 2 else text.replace("\n", "")


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_op13(docs, rows, levels, spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.merkle_manifest(docs, changed, levels)
    got = sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)
    want = brute_manifest(rows, tampered)
    assert got == want and 20 < sum(r[-1] for r in want) < len(want) - 20
    for r in found.collect():
        assert bool(r.version_path) == (not r.verified) and r.version_path[:1] != [r.leaf]
    if levels == 7:
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        assert sorted((tuple(r) for r in merkle.op13_merkle(spark, str(tmp_path)).collect()), key=repr) == want


def test_op13_small(docs):
    one = docs.where("doc_id = 5002")
    r = merkle.merkle_manifest(one).collect()
    assert len(r) == 1 and r[0].leaf == r[0].subroot == r[0].root == r[0].folded_root and r[0].proof_sha256 == H() and r[0].verified
    assert merkle.merkle_manifest(docs.limit(0)).count() == 0


def test_op13_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(9)
    rows = [(i * 13, rng.choice(["a\nb", "ab", None, "é\n"]), "en", rng.choice(["x", "y", "é", None]), i) for i in range(90)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    got = con.sql(merkle.oracle_sql(6)).fetchall()
    assert sorted(got, key=repr) == brute_manifest(rows, tampered)
