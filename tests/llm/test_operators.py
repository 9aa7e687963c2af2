"""Every corpus operator against brute force or its library, on small tables with the awkward cases in them."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import embedding_dedup, exact_dedup, language_id, license_scan, mixing, near_dedup, secrets, sentencepiece, sharding, token_counts
from trawl.llm.common import connected_components

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rid long, key string, score double"
SYLLABLES = {"en": ["the", "ing", "tion", "er", "an"], "de": ["sch", "ung", "ei", "ß", "en"], "fr": ["eau", "é", "ou", "que", "ai"]}


def words(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(160):
        lang = rng.choice(list(SYLLABLES))
        out.append([i, words(rng, lang, rng.randint(1, 90)), lang if i % 9 else None, rng.choice(["a", "b", None])])
    base = words(rng, "en", 200)
    changed = base.split()
    changed[100] = "changed"
    out += [[160, base, "en", "a"], [161, base, "en", "b"], [162, " ".join(changed), "en", "a"], [162, " ".join(changed), "en", "a"]]
    out += [[163, None, None, None], [164, "", "en", "a"], [165, " \n\t ", "de", "b"], [166, "123 !!", "de", "b"], [None, "no id here at all", "en", "c"], [None, None, None, None]]
    out += [[167, words(rng, "fr", 9000), "fr", "a"], [168, "x" * 40_000, "en", "a"], [169, "a b", "en", "b"], [170, "a b", None, "b"]]
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "k", 0.5) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_op1_counts_as_the_library(docs, none, rows):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    hf = Tokenizer.from_file(path)
    got = Counter(map(tuple, token_counts.count_tokens(docs, path).collect()))
    want = Counter()
    for doc_id, text, *_ in rows:
        n = len(hf.encode(text or "", add_special_tokens=False).ids)
        want[doc_id, len((text or "").encode()), n, n > 1024] += 1
    assert got == want
    assert token_counts.count_tokens(none, path).count() == 0


def test_op1_awkward_texts():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    hf, own = Tokenizer.from_file(path), token_counts.Tokenizer(open(path).read())
    rng = random.Random(2)
    alphabet = " '\n\t stmdrvleabX1.,<|é　 漢🎉"
    texts = ["", "don't 're 'rx 'l", "a<|endoftext|>b", "\n\n  x", "-" * 999] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["a" + "b ".join(every[i : i + 400]) for i in range(0, len(every), 4000)]
    assert own.count([t.encode() for t in texts]).tolist() == [len(e.ids) for e in hf.encode_batch(texts, add_special_tokens=False)]


def test_op1_states_are_bounded(monkeypatch):
    path = P.path("byte_bpe_50k.json")
    own = token_counts.Tokenizer(open(path).read())
    text = [words(random.Random(9), "en", 3000).encode()]
    want = own.count(text).tolist()
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    own._empty()
    assert own.count(text).tolist() == want


def test_op2_rows_law(docs, none, rows):
    got = sharding.shard_rows(docs, shards=7).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.home_shard)
    assert all(len(h) == 1 for h in homes.values())
    assert sharding.shard_rows(none).count() == 0


def test_op2_plan_is_bounded_and_moves_only_overflow():
    rng = random.Random(1)
    counts = {t: rng.randint(1, 30) for t in range(0, 1000, 3)} | {7: 4000}
    total, shards = sum(counts.values()), 5
    nodes, capacity = sharding.ring(shards, 16, 1000), [total // shards + (s < total % shards) for s in range(shards)]
    segments = sharding.plan(counts, nodes, capacity)
    load, placed = Counter(), Counter()
    for tick, _home, a, b, shard, _slot in segments:
        load[shard] += b - a
        placed[tick] += b - a
    assert [load[s] for s in range(shards)] == capacity and placed == counts
    natural = Counter()
    for tick, home, a, b, _, _ in segments:
        natural[home] += b - a
    moved = sum(b - a for _, home, a, b, shard, _ in segments if home != shard)
    assert moved == sum(max(0, natural[s] - capacity[s]) for s in range(shards))


def test_op3_encodes_and_decodes_as_the_library(docs, none, rows):
    from sentencepiece import SentencePieceProcessor

    path = P.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    got = Counter((r.doc_id, tuple(r.piece_ids), r.n_pieces, r.decoded) for r in sentencepiece.encode_decode(docs, path).collect())
    want = Counter()
    for i, text, *_ in rows:
        ids = sp.encode(text or "")
        want[i, tuple(ids), len(ids), sp.decode(ids)] += 1
    assert got == want
    assert sentencepiece.encode_decode(none, path).count() == 0


def test_op3_awkward_texts():
    from sentencepiece import SentencePieceProcessor

    path = P.path("piece_bpe_32k.model")
    sp, own = SentencePieceProcessor(model_file=path), sentencepiece.Pieces(open(path, "rb").read())
    rng = random.Random(3)
    texts = ["", " ", "   ", " a  b ", "a▁b", "\x00a", "x<unk></s>", "<0x41>", "a" * 700, "=" * 50] + [
        "".join(rng.choices(" \nabcdeorthings1.,é　▁漢🎉=-", k=rng.randint(1, 40))) for _ in range(2000)
    ]
    ids, counts = own.encode(texts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == sp.encode(texts)
    assert own.decode(ids, counts) == [sp.decode(x) for x in sp.encode(texts)]


def test_op4_held_out_accuracy_and_rules(docs, none, rows):
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    truth = {i: (t, lang) for i, t, lang, _ in rows}
    right = total = 0
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        text, lang = truth.get(r.doc_id, (None, None))
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", text or ""))
        if r.held_out and lang and r.lang_pred != "und" and len(text) > 20:
            total, right = total + 1, right + (r.lang_pred == lang)
    assert total > 20 and right / total >= 0.95
    assert language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang,'') lang")).collect()} == {"und"}


def test_op4_filter_has_every_gram_and_corrects_for_chance():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 62, 5000).astype(np.int64)
    masks = rng.integers(1, 8, 5000).astype(np.uint64)
    model = language_id.LanguageFilter(["a", "b", "c"], grams, masks, slots=1 << 14)
    assert ((model.languages(grams.view(np.uint64)) & masks) == masks).all()
    other = rng.integers(0, 1 << 62, 200_000).astype(np.int64).view(np.uint64)
    seen = np.array([((model.languages(other) >> np.uint64(i)) & np.uint64(1)).mean() for i in range(3)])
    assert np.abs(seen - model.false).max() < 0.02


def test_op4_more_than_64_languages(spark):
    rng = random.Random(8)
    stock = {f"l{k:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(12)] for k in range(130)}
    rows = [(i, " ".join(rng.choices(stock[lang], k=25)), lang) for i, lang in enumerate(list(stock) * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language_id.identify(df).collect()
    held = [r.lang_pred == rows[r.doc_id][2] for r in got if r.held_out]
    assert len(got) == len(rows) and len(held) > 200 and sum(held) / len(held) > 0.95
    few = spark.createDataFrame([(1, "a b", "x"), (3, None, "y"), (4, "c d", None)], "doc_id long, text string, lang string")
    assert language_id.identify(few).count() == 3  # no n-gram is met often enough


def test_op5_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    vectors = [(i, (base[i % 20] + rng.normal(size=8) * 0.05 * (i % 4)).tolist(), i % 3 if i % 10 else None) for i in range(240)]
    vectors += [(240, [0.0] * 8, 1), (241, None, 1), (242, [1.0, None] + [0.0] * 6, 1), (243, [math.nan] * 8, 1), (244, [math.inf] + [0.0] * 7, 1), (245, [], 1), (246, [1.0, 2.0], 1), (247, [2.0, 4.0], 1)]
    vectors += [(248, [1e300] * 8, 2), (249, [1e-300] * 8, 2), (5, vectors[5][1], vectors[5][2])]
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in vectors], "vec_id long, embedding array<double>, label int, unit string").withColumn("rid", F.lit(1)).withColumn("head", F.lit("h")).repartition(4)
    got = Counter(map(tuple, embedding_dedup.near_vectors(df, block=16).collect()))

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v) / np.abs(v).max()
        return x / np.linalg.norm(x)

    units, n = [unit(v) for _, v, _ in vectors], len(vectors)
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j])
              and vectors[i][2] is not None and vectors[i][2] == vectors[j][2] and float(units[i] @ units[j]) >= 0.98] for i in range(n)]
    want = Counter()
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(vectors[j][0] for j in seen)
        want[vectors[i][0], len(links[i]), low, vectors[i][0] == low] += 1
    assert got == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dims", [4, 64])
def test_op5_counts_both_ends_with_several_codes(spark, dims):
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(40, dims)))
    x = unit(centres[rng.integers(0, 40, 1000)] + rng.normal(size=(1000, dims)) * 0.3 / dims**0.5)
    toward = centres[rng.integers(0, 40, 1000)]
    side = unit(toward - (toward * x).sum(1, keepdims=True) * x)
    cosine = rng.uniform(0.98, 0.99, (1000, 1))  # copies moved towards another cluster
    x = np.concatenate([x, cosine * x + (1 - cosine**2) ** 0.5 * side])
    linked = unit(x) @ unit(x).T >= 0.98
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = (linked.sum(1) - 1).tolist()
    found = embedding_dedup.near_vectors(df, cell_rows=1)  # about 45 codes a half
    assert {r.vec_id: r.n_links for r in found.collect()} == dict(enumerate(want))
    less = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df, cell_rows=1, recall=0.95).collect()}
    assert all(less[i] <= n for i, n in enumerate(want)) and sum(less.values()) % 2 == 0
    assert sum(less.values()) >= 0.9 * sum(want)


def test_op5_recall_at_the_default(spark):
    rng = np.random.default_rng(3)
    for dims in (8, 16, 64):
        x = rng.normal(size=(600, dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side = rng.normal(size=x.shape)
        side -= (side * x).sum(1, keepdims=True) * x
        y = 0.981 * x + (1 - 0.981**2) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)
        z = np.concatenate([x, y, x[:1].repeat(300, axis=0)])  # planted twins, and a vector that fills a fifth of the rows
        df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(z)], "vec_id long, embedding array<double>, label int")
        want = ((z @ z.T >= 0.98).sum(1) - 1).tolist()
        assert [r.n_links for r in embedding_dedup.near_vectors(df).orderBy("vec_id").collect()] == want


def test_op5_traversal_is_ordered_and_whole():
    rng = np.random.default_rng(1)
    a, b = rng.random(9), rng.random(7)
    got = list(embedding_dedup.traverse(a, b, 0.9))
    far = [f for _, _, f in got]
    assert far == sorted(far) and len({(i, j) for i, j, _ in got}) == len(got)
    assert {(i, j) for i, j, _ in got} == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.9}


def shingles(text, n=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    return Counter(tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))) if found else Counter()


def weighted_jaccard(a, b):
    both = sum(min(n, b[s]) for s, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_groups(rows):
    bags = [shingles(t or "") for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (bags[i] and bags[j] and weighted_jaccard(bags[i], bags[j]) >= 0.8):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return list(groups.values())


@pytest.mark.parametrize("hot", [near_dedup.HOT_BUCKET, 2])
def test_op6_groups_as_brute_force(spark, docs, none, rows, hot):
    rng = random.Random(8)
    text = words(rng, "de", 120).split()
    more = []
    for i in range(300, 340):  # a family of copies with a few words changed in each
        own = list(text)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(9)}"
        more.append((i, " ".join(own), "de", "a"))
    repeated = "one two three four five " * 50
    more += [(400, repeated, "en", "a"), (401, repeated + "one two three four five " * 4, "en", "a"), (402, repeated * 3, "en", "a")]
    every = [*rows, *more]
    schema = "doc_id long, text string, side int, rid string, bag string, `key` int"
    df = spark.createDataFrame([(i, t, 1, "a", "b", 3) for i, t, *_ in every], schema).repartition(3)
    got = near_dedup.near_duplicates(df, block_docs=16, hot_bucket=hot).collect()
    want = Counter()
    for group in brute_groups(every):
        ids = [every[i][0] for i in group]
        low = min((x for x in ids if x is not None), default=None)
        for i in ids:
            want[i, low, len(group)] += 1
    assert Counter((r.doc_id, r.group_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(brute_groups(every))
    assert all(r.doc_id == r.group_id for r in got if r.kept)
    assert near_dedup.near_duplicates(none).count() == 0


def test_op6_overlap_of_bags_is_weighted_jaccard():
    texts = ["a b c d e f " * 9 + "g", "a b c d e f " * 5 + "h i", "a b", "", "a b", "x " * 50_000]
    found = near_dedup.bags([t.encode() for t in texts])
    for i, x in enumerate(texts):
        assert len(found[i]) == sum(shingles(x).values())
        for j, y in enumerate(texts):
            want = weighted_jaccard(shingles(x), shingles(y)) if x and y else 0.0
            assert near_dedup.overlap(found[i], found[j]) == pytest.approx(want)


def test_op6_signatures_estimate_weighted_jaccard():
    a, b = "one two three four five six " * 20 + "x y z " * 7, "one two three four five six " * 29 + "x y q " * 9
    keys = near_dedup.shingle_keys([a.encode(), b.encode()])
    runs = []
    for shift in range(40):  # other shingles, the same counts
        salted = near_dedup._mix(keys & np.uint64((1 << 44) - 1) ^ np.uint64(shift * 7919)) >> np.uint64(20)
        sig, _ = near_dedup.signatures(np.sort((keys >> np.uint64(44) << np.uint64(44)) | salted), 2)
        runs.append((sig[0] == sig[1]).mean())
    truth = weighted_jaccard(shingles(a), shingles(b))
    assert abs(np.mean(runs) - truth) < 0.03


@pytest.mark.parametrize("block,held", [(exact_dedup.BLOCK_CHARS, exact_dedup.HELD_CHARS), (7, 200)])
def test_op7_against_brute_force(docs, none, rows, block, held):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    got = exact_dedup.exact_dedup(docs, block, held).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = groups[t or ""]
        want[i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_op8_against_brute_force(spark, docs, none):
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, "MIT"), (4, "Released under the MIT license!")]
    for i, text in enumerate(license_scan.TEMPLATES.values()):
        around = words(rng, "en", rng.randint(0, 60)), words(rng, "fr", rng.randint(0, 60))
        rows.append((10 + i, f"{around[0]}\n{text.upper()} {around[1]}"))
        cut = text.split()
        cut[len(cut) // 2] = "else"
        rows.append((50 + i, f"{around[0]} {' '.join(cut)} {around[1]}"))
    rows += [(90, words(rng, "en", 20_000) + " " + license_scan.TEMPLATES["gpl-3.0"]), (4, rows[3][1])]
    want = Counter()
    shingled = lambda t: [tuple(w[i : i + 5]) for w in [re.findall("[a-z0-9]+", t.lower())] for i in range(len(w) - 4)]
    for i, text in rows:
        s = shingled(text or "")
        for name, template in license_scan.TEMPLATES.items():
            own = set(shingled(template))
            span = 1 << (len(own) - 1).bit_length()
            width = 2 * span if span > 1 else 1
            held = [(len(own & set(s[a : a + width])) / len(own), a) for a in range(0, len(s), span)]
            held = [h for h in held if h[0] >= 0.8]
            if held:
                best = max(h for h, _ in held)
                want[i, name, best, min(a for h, a in held if h == best), len(held)] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, license_scan.scan_licenses(df).collect())) == want
    assert license_scan.scan_licenses(none).count() == 0


def test_op8_short_notices_and_clauses(spark):
    from trawl.llm.registry import QUERIES

    assert "op8_license_notices" in QUERIES
    every = license_scan.catalogue()
    wanted = {"all-rights-reserved": "All rights reserved.", "mit-license": "MIT License", "five": "one two three four five"}
    rows = [(1, "all RIGHTS reserved"), (2, "Licensed under the MIT License. x MIT license"), (3, "rights reserved all"), (4, "MIT"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = license_scan.scan_licenses(df, wanted).collect()
    assert sorted(map(tuple, got)) == [(1, "all-rights-reserved", 1.0, 0, 1), (2, "mit-license", 1.0, 3, 2)]
    rng = random.Random(3)
    rows = [(i, words(rng, "en", rng.randint(0, 400)) + "\n" + text) for i, text in enumerate(every.values())]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), every).collect()
    full = {(r.doc_id, r.license) for r in found if r.containment == 1.0}
    assert {(i, name) for i, name in enumerate(every)} <= full


def test_op9_any_number_of_sources_shares_as_the_plain_rule(spark):
    rng = random.Random(6)
    sizes = [(None if i == 17 else f"s{i:03d}é", rng.choice([0, 3, 900, 40_000])) for i in range(60)]
    df = spark.createDataFrame(sizes, "source string, source_size long").repartition(5)
    got = mixing.shared_targets(df, mixing.WEIGHTS, 3).orderBy("sid").collect()
    order = sorted(sizes, key=lambda r: (r[0] is None, (r[0] or "").encode()))
    assert [r.source for r in got] == [s for s, _ in order] and [r.sid for r in got] == list(range(60))
    want = mixing.share_targets([n for _, n in order], [mixing.WEIGHTS[i % 3] for i in range(60)], 3)
    assert [r.target for r in got] == pytest.approx(want)


def test_op9_long_texts_alone_are_fitted_too():
    lengths, counts = [54_000, 56_000, 60_000], [1, 1, 1]
    take = mixing.fit_budget(lengths, counts, 110_000, "s")
    assert sum(n * t for n, t in zip(lengths, take, strict=True)) == 110_000
    rng = random.Random(4)
    for _ in range(20):
        lengths = sorted(rng.sample(range(40_000, 90_000), 8))
        budget = sum(rng.sample(lengths, 4))
        take = mixing.fit_budget(lengths, [1] * 8, budget, "s")
        assert max(take) <= 1 and abs(sum(n * t for n, t in zip(lengths, take, strict=True)) - budget) <= budget * 0.01


def test_op9_rows_that_repeat_an_id(spark):
    text = lambda n, w="w": " ".join([w] * n)
    rows = [(1, text(10), "a"), (1, text(10), "a"), (1, text(10), "a"), (1, text(7, "v"), "a"), (None, text(9), "b"), (None, text(9), None)] + [(i, text(5), "b") for i in range(9, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r.doc_id, r.size] += r.times
    got = Counter((r.doc_id, len(r.text.split())) for r in mixing.mixed_documents(df).collect())
    assert got == +taken


def test_op9_mix(docs, none, rows):
    got = mixing.mix(docs).collect()
    sizes = {s: sum(len(re.findall(mixing.WORD, t or "")) for _, t, _, x in rows if x == s) for s in ("a", "b", "c", None)}
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = dict(zip(order, mixing.share_targets([sizes[s] for s in order], [5, 2, 1, 5], 3), strict=True))
    source = {(i, len(re.findall(mixing.WORD, t or ""))): s for i, t, _, s in rows}
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(re.findall(mixing.WORD, t or ""))) for i, t, *_ in rows)
    taken = Counter()
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken == r.times * r["size"] and 0 <= r.times <= 3
        taken[s] += r.taken
    for s in order:  # as near as whole documents can come
        sums, passes = {0}, min(3, int(target[s] // sizes[s]))
        for _, t, _, x in rows:
            sums |= {n + len(re.findall(mixing.WORD, t or "")) for n in sums} if x == s and passes < 3 else set()
        assert abs(taken[s] - target[s]) <= min(abs(passes * sizes[s] + n - target[s]) for n in sums) + 1, s
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()), key=str)
    assert mixing.mix(none).count() == 0


def test_op9_targets_and_budgets():
    got = mixing.share_targets([100, 100, 1000], [5, 2, 1], 3)
    assert got == pytest.approx([300, 300, 600])
    rng = random.Random(4)
    for _ in range(60):
        lengths = rng.sample(range(1, 60), rng.randint(1, 6))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(n * c for n, c in zip(lengths, counts, strict=True)))
        take = mixing.fit_budget(lengths, counts, budget, "s")
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums |= {s + n * k for s in sums for k in range(c + 1)}
        reached = sum(n * t for n, t in zip(lengths, take, strict=True))
        assert abs(reached - budget) == min(abs(s - budget) for s in sums)
    big = mixing.fit_budget(list(range(1, 3000)), [500] * 2999, 1_234_567_891, "s")
    assert sum(n * t for n, t in zip(range(1, 3000), big, strict=True)) == 1_234_567_891


BASE = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def test_op10_base_spans_and_links(spark, none):
    key, blob = "AKIA" + "ABCDEFGHIJKLMNOP", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY00"
    far = "lorem ipsum " * 60
    rows = [
        (1, None), (2, ""), (3, "token = 'abc123def' é🎉 Password:hunter22 api_key=short"), (4, f"🎉 {key} x {'0a' * 12} {'f' * 23}"),
        (5, "secret: token: abcdefgh"), (6, "token=secret=abcdefgh TOKEN = \"" + "ab" * 20 + "\""), (7, f"id {key} then {blob} end"), (8, f"alone {blob} here"),
        (9, f"{key} {far} {blob}"), (10, f"username: bob99\nhttps://db.example.com/x {blob}"), (11, "see https://example.com only"), (12, "user = bob99 " + far),
        (13, (far + f"token={'9' * 8} ") * 30), (4, f"🎉 {key} x {'0a' * 12} {'f' * 23}"), (14, "AKIAKIA" + "Z" * 14 + " AKIA1"),
    ]
    got = secrets.find_secrets(spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kind string").repartition(3)).collect()
    want = Counter()
    for i, t in rows:
        spans = [(m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(BASE.items()) for m in p.finditer(t or "") if ok(m)]
        said = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        n = Counter(s[2] for s in spans)
        want[i, n["assign"], n["access"], n["hex"], hashlib.sha256(said.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    linked = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("part_")] for r in got}
    at = lambda i, sub: dict(rows)[i].index(sub)
    assert linked[7] == [f"part_secret:{at(7, blob)}:{at(7, blob) + 40}"]
    assert linked[8] == linked[9] == linked[11] == linked[12] == []
    assert [s.split(":")[0] for s in linked[10]] == ["part_id", "part_endpoint", "part_secret"]
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("part_")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
    assert secrets.find_secrets(none).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(80)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.component) for r in got.collect()} == {(x, root(x)) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_texts_without_spaces_count_and_encode_as_the_libraries():
    import sentencepiece as library
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ["".join(rng.choices("กขคงจฉชซนมยรลวอาีเ", k=200_000)), "x" * 5_000_000, "ab" * 30_000 + " c " + "ß" * 40_000, "short one"]
    path = P.path("byte_bpe_50k.json")
    counter, hf = token_counts.Tokenizer(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    began = time.perf_counter()
    assert counter.count([t.encode() for t in texts]).tolist() == [len(hf.encode(t, add_special_tokens=False).ids) for t in texts]
    model = open(P.path("piece_bpe_32k.model"), "rb").read()
    pieces, sp = sentencepiece.Pieces(model), library.SentencePieceProcessor(model_proto=model)
    texts = [texts[0], texts[2], texts[3]]
    ids, counts = pieces.encode(texts)
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == sp.encode(texts[0])
    assert ids.tolist() == [i for t in texts for i in sp.encode(t)]
    assert time.perf_counter() - began < 120
