"""op1 and op7 against brute force, and what odd rows give."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import cap_filters, simhash
from pagemill.llm.components import connected_components

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain_fingerprint(text, width):
    words = text.encode().translate(FOLD).split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    out = [None, "", "  \n", "one", "One\ttwo", "É a b c", "x " * 70_000]
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(40, 300))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out + [out[9]] * 30


def test_op1_equals_brute_force(spark):
    rows = [(3 * i + 1, t, "x", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id int").repartition(4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t or "", 3) for _, t, _, _ in rows]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    label = plain_components(len(fps), near)
    assert got == {rows[i][0]: (f"{fps[i]:016x}", rows[label[i]][0]) for i in range(len(rows))}
    assert len({c for _, c in got.values()}) < len(rows) - 60


def test_op1_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(7, 7), (7, 7), (9, 9), (None, 7)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("options", [{"leaf": 64}, {"leaf": 64, "max_leaves": 2, "shard_rows": 700}])
def test_links_find_every_pair(spark, options):
    """Also where leaves are few and far above the size of a shard, so that they are compared in pairs of blocks."""
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = fps[rng.integers(0, 3000, 3000)] ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64))
    all_fps = np.unique(np.concatenate([fps, near]))
    df = spark.createDataFrame([(int(f).to_bytes(8, "big"), i) for i, f in enumerate(all_fps)], "fp binary, rep bigint").select(F.col("fp").cast("binary"), "rep")
    found = connected_components(simhash.links(df, **options)).toPandas()
    distance = np.stack([np.bitwise_count(all_fps ^ f) <= 3 for f in all_fps])
    label = np.arange(len(all_fps))
    while True:
        new = np.array([label[row].min() for row in distance])
        if (new == label).all():
            break
        label = new
    want = {int(i): int(label[i]) for i in range(len(label)) if distance[i].sum() > 1}
    assert dict(zip(found.node, found.component, strict=True)) == want


@pytest.mark.parametrize("shared", [0.85, 0.95])
def test_stage_finds_similar_texts(spark, shared):
    """Pairs whose five-word shingles are similar to 0.85 and 0.95: the share found by 128-bit fingerprints."""
    rng, rows = random.Random(1), []
    for i in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        same = round(600 * 2 * shared / (1 + shared))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:same] + [f"v{rng.randrange(10**6)}" for _ in range(600 - same)]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.keep_one_per_group(docs).collect()}
    assert kept >= {2 * i for i in range(150)}
    assert len(kept) - 150 <= (15 if shared < 0.9 else 2)


def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        v = rng.standard_normal(32)
        rows.append((v, i % 3))
        for _ in range(i % 4):
            rows.append((v + rng.standard_normal(32) * 0.12, i % 3))
    rows += [(rows[0][0] * 2, 0)] * 4 + [(rows[1][0], 2), (rows[1][0], None), (np.zeros(32), 1), (np.zeros(32), 1)]
    out = [(10 * i + 5, [float(x) for x in v], label, 1) for i, (v, label) in enumerate(rows)]
    return out + [(1, None, 1, 1), (2, [float("nan")] * 32, 1, 1), (3, [None] * 32, 1, 1), (4, [float("inf")] + [0.0] * 31, 1, 1), (6, [], 1, 1)]


@pytest.mark.parametrize("bucket", [2048, 16])
def test_op7_equals_brute_force(spark, bucket):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cap_filters.near_duplicates(df, bucket=bucket).collect()}
    rows.sort()
    good = [v is not None and len(v) == 32 and None not in v and np.isfinite(v).all() and any(v) and label is not None for _, v, label, _ in rows]
    x = [np.float32(v).astype(float) if ok else None for (_, v, _, _), ok in zip(rows, good, strict=True)]
    near = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and good[i] and good[j] and rows[i][2] == rows[j][2] and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.98]
    label = plain_components(len(rows), near)
    n = [0] * len(rows)
    for i, _ in near:
        n[i] += 1
    assert got == {r[0]: (n[i], rows[label[i]][0], label[i] == i) for i, r in enumerate(rows)}
    assert cap_filters.near_duplicates(df.limit(0)).collect() == []


def similar_texts(rng, n, words, shared):
    """n pairs of texts of that many words whose five-word shingles are similar to about `shared`."""
    rows = []
    for _ in range(n):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        same = round((words - 4) * 2 * shared / (1 + shared)) + 4
        rows += [" ".join(base), " ".join(base[:same] + [f"v{rng.randrange(10**6)}" for _ in range(words - same)])]
    return rows


def shingle_set(text):
    words = (text or "").encode().translate(FOLD).split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force_kept(rows):
    """The doc_ids that stay where texts with a shingle similarity of at least 0.8, or no words, are linked."""
    sets = [shingle_set(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    label = plain_components(len(rows), linked)
    return {rows[k][0] for k in set(label)}


def test_stage_keeps_texts_that_are_not_similar(spark):
    rng = random.Random(4)
    texts = [t for shared in (0.5, 0.6, 0.65, 0.7, 0.75) for t in similar_texts(rng, 40, 400, shared)]
    texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (1, 3, 5, 6, 8) for _ in range(120)]
    texts += [None, "", " \n\t", "one two three four five six", "One  two three four five six"]
    base = [f"b{k}" for k in range(500)]
    texts += [" ".join(base[:k] + ["edit"] + base[k + 1 :]) for k in range(0, 500, 5)]  # a group of near copies
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = {r.doc_id for r in simhash.keep_one_per_group(docs).collect()}
    assert kept == brute_force_kept(rows) and len(rows) - len(kept) == 2 + 1 + 99


def test_stage_repeated_and_missing_ids(spark):
    a, b = similar_texts(random.Random(6), 2, 300, 0.9)[::2]
    rows = [(5, a + " end"), (7, a), (7, b), (9, b), (None, a), (None, b), (9, "other words stay")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one_per_group(docs).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[4], rows[5], rows[6]], key=str)
    assert simhash.keep_one_per_group(docs.limit(0)).collect() == []


def test_stage_recall_at_the_required_similarity(spark):
    """300 pairs at or just above 0.8; the trees that searched one bit in 16 within 24 bits found 86% of such pairs."""
    texts = similar_texts(random.Random(12), 300, 600, 0.802)
    rows = list(enumerate(texts))
    assert len(brute_force_pairs(rows)) == 300
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id bigint, text string")).count()
    assert 600 - kept >= 297


def brute_force_pairs(rows):
    return [i for i in range(0, len(rows), 2) if 5 * len(shingle_set(rows[i][1]) & shingle_set(rows[i + 1][1])) >= 4 * len(shingle_set(rows[i][1]) | shingle_set(rows[i + 1][1]))]


def test_components_of_stars_chains_and_pairs(spark, monkeypatch):
    from pagemill.llm import components

    monkeypatch.setattr(components, "LARGE_HUB", 20)
    monkeypatch.setattr(components, "BROADCAST_HUBS", 1)
    pairs = [(0, k) for k in range(100, 190)] + [(k, 50) for k in range(200, 260)] + [(50, 7), (7, 0)] + [(300 + k, 301 + k) for k in range(40)] + [(400, 401), (403, 402), (405, 404), (404, 406)]
    pairs += [(5, 5), (None, 3), (500, 499), (500, 498), (501, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs * 2, "src bigint, dst bigint")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    nodes = sorted({x for p in real for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    label = plain_components(len(nodes), [(at[a], at[b]) for a, b in real])
    assert got == {x: nodes[label[at[x]]] for x in nodes}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).collect() == []


@pytest.mark.parametrize("options", [{"dense": 2}, {"dense": 8}])
def test_stage_compares_dense_clusters_exactly(spark, options, monkeypatch):
    """Variants of one text with many pairs refused and some similar, in clusters of several blocks, against brute force."""
    monkeypatch.setattr(simhash.similar_in_clusters, "__defaults__", (40, 3000))
    rng = random.Random(15)
    base, edits = [f"b{k}" for k in range(150)], [(k, f"e{k}") for k in range(3, 150, 7)]
    texts = []
    for _ in range(220):
        own = list(base)
        for k, w in rng.sample(edits, rng.randint(1, 6)):
            own[k] = w
        texts.append(" ".join(own))
    rows = list(enumerate(texts + similar_texts(rng, 20, 150, 0.85)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {r.doc_id for r in simhash.keep_one_per_group(docs, **options).collect()}
    assert kept == brute_force_kept(rows) and 20 < len(rows) - len(kept) < 240


def test_clusters_of_many_blocks_give_few_links(spark):
    """400 near copies in blocks of about 40: links were given again by every pair of blocks, with the square of the size."""
    base = list(range(1000, 1100))
    rows = [(i, [*base, i]) for i in range(400)] + [(400, [1, 2, 3])]
    sets = spark.createDataFrame(rows, "node bigint, shingles array<bigint>")
    clusters = sets.select("node", F.lit(0).cast("bigint").alias("component"))
    links = simhash.similar_in_clusters(clusters, sets, 80, 40).toPandas()
    assert 399 <= len(links) <= 500
    label = plain_components(401, list(zip(links.src, links.dst, strict=True)))
    assert label == [0] * 400 + [400]


@pytest.mark.parametrize("near", [0, 1])
def test_forest_loses_no_pair_within_its_bits(near):
    """Fingerprints within `near` of a tree's bits meet in one of its leaves; leaves hold few rows, and all of them."""
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, (1500, 2), np.uint64)
    fps[500:1000] = fps[:500] ^ (np.uint64(1) << rng.integers(0, 64, (500, 2)).astype(np.uint64))
    positions = simhash.sampled_bits(128, 6, 12)
    forest = simhash.Forest(fps[:800], positions, 16, near)
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)
    for chosen, (row, leaf) in zip(positions, forest.route(fps), strict=True):
        inside = np.zeros((len(fps), leaf.max() + 1), np.float32)
        inside[row, leaf] = 1
        close = (bits[:, None, chosen] != bits[None, :, chosen]).sum(2) <= near
        assert set(row) == set(range(len(fps))) and (inside @ inside.T)[close].all()
        assert inside.sum(0).max() < (120 if near == 0 else 800) and (near or len(row) == len(fps))


def test_stage_finds_its_pairs_by_vantage_point_trees(spark, monkeypatch):
    """With trees that send nothing anywhere no pair is found, with one tree of all rows in one leaf each pair is."""
    rows = list(enumerate(similar_texts(random.Random(31), 30, 200, 0.9)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert simhash.keep_one_per_group(docs, tables=1).count() == 30
    grow = simhash.grown
    apart = np.zeros(0, np.int64)
    monkeypatch.setattr(simhash, "grown", lambda *a: type("Apart", (), {"route": lambda self, fps: iter([(apart, apart)])})() if grow(*a) else None)
    assert simhash.keep_one_per_group(docs).count() == 60


def test_components_of_few_links_stay_in_few_partitions(spark):
    """Each partition writes files of its own in every round; few links don't need as many as the session's shuffles have."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = spark.createDataFrame([(k, k + 1) for k in range(30)], "src bigint, dst bigint")
        got = connected_components(links)
        assert {r.node: r.component for r in got.collect()} == dict.fromkeys(range(31), 0)
        from pagemill.llm import components

        pairs = links.select("src", "dst").toDF("u", "v")
        labels = components._label(pairs.union(pairs.select("v", "u")), components.LEAST_PARTS)
        assert labels.rdd.getNumPartitions() <= components.LEAST_PARTS
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
