"""op2, op4, op9, op10 and the pipeline: held-out accuracy, plain versions, and what odd rows give."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from pagemill.llm import line_dedup, mixing, quality, queries, toxicity

DATA = Path(os.environ.get("PAGEMILL_TEST_DATA", "/root/testdata/sf0.001")).parent / "sf0.01"
needs_data = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


def labels_of(spark, column):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


@needs_data
@pytest.mark.parametrize(("name", "label", "threshold", "right"), [("op2_quality_classifier", "quality", 0.3, 0.9), ("op9_toxicity", "toxic", 0.5, 0.9)])
def test_held_out_rows(spark, name, label, threshold, right):
    rows, truth = queries.queries()[name](spark, str(DATA)).collect(), labels_of(spark, label)
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    kept = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in kept) >= right * len(kept) > 40
    again = queries.queries()[name](spark, str(DATA)).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in rows}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_odd_tables(spark, module):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (2, "a b " * 50_000, 2), (None, "x", 2)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = module.classify(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert len(module.classify(docs, labels.limit(0)).collect()) == 4
    assert module.classify(docs.limit(0), labels).collect() == []


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)


def test_op4(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "b", "b", "b", "é", "z"] + [None]), "w " * rng.randint(0, 400)) for i in range(3000)]
    rows += [(5000, "empty", None), (5001, "empty", ""), (6000, "tiny", "one\x0btwo"), (None, "a", "x y z")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id bigint, source string, text string, size int, draws string")
    plan = mixing.plan_mix(docs).cache()
    got = plan.collect()
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    targets, taken, longest = plain_targets(sizes), Counter(), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.size * len(r.draws)
        longest[r.source] = max(longest[r.source], r.size)
        assert len(r.draws) <= 2
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(longest[s], 1)
    again = {(r.doc_id, str(r.draws)) for r in mixing.plan_mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, str(r.draws)) for r in got}
    drawn = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert drawn == Counter({r.doc_id: len(r.draws) for r in got if len(r.draws)})
    assert mixing.plan_mix(docs.limit(0)).collect() == []
    plan.unpersist()


def test_op4_shards_are_exact(spark):
    quotas = spark.createDataFrame([("a", 700), ("b", 31), (None, 1), ("c", 0)], "source string, quota int")
    got = defaultdict(list)
    for r in mixing.split_quotas(quotas, 4, 42).collect():
        got[r.source].append(r.quota)
    assert {s: sum(q) for s, q in got.items()} == {"a": 700, "b": 31, None: 1, "c": 0}
    assert all(len(q) == 16 and min(q) >= 0 for q in got.values())
    totals = [sum(q[i] for q in got.values()) for i in range(16)]
    assert max(totals) - min(totals) <= 1


def plain_lines(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for line in (t or "").split("\n"):
            first.setdefault(key(line), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_op10(spark):
    rng = random.Random(8)
    pool = [f"{'Line' * rng.randint(1, 4)} {k % 40}" for k in range(90)] + ["", " \t", "short", "ÄÖ long enough line", "äö long enough line", "x\x0b"]
    rows = [(7 * i % 1009, "\n".join(rng.choice([" ", "", "\t"]) + rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    rows += [(2000, None), (2001, ""), (None, "LineLineLine 3\nown own own own"), rows[5], (3000, "\n".join(pool) * 300), (3001, "common line of all\n" * 5)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, kept string, n_lines int").repartition(5)
    for batches in (1, 4, 9):
        got = line_dedup.dedup_lines(docs, batches=batches).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got), key=str) == plain_lines(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


@needs_data
def test_op10_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({queries.OP10_SQL})").fetchall()
    got = queries.op10_line_dedup(spark, str(DATA)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@needs_data
def test_pipeline_stages(spark):
    """Each stage keeps columns and works on what its predecessor kept; the last returns ids that decode to the texts."""
    import numpy as np
    import public_tokenizers

    from pagemill.llm import byte_bpe

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(DATA)).cache()
        seen.append((name, docs.count()))
        if name == "quality classifier":
            scores = {r.doc_id: r.score for r in queries.op2_quality_classifier(spark, str(DATA)).collect()}
            assert {r.doc_id for r in docs.collect()} == {d for d, s in scores.items() if s >= 0.3}
        elif name == "line dedup":
            own = [(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect()]
            assert sorted(own) == [(i, h) for i, _, _, h in sorted(plain_lines([(r.doc_id, r.text) for r in before.collect()]))]
        elif name == "SimHash near-dedup":
            assert {r.doc_id for r in docs.collect()} < {r.doc_id for r in before.collect()}
        elif name != "byte-level BPE encoding":
            assert docs.count() > before.count() and max(Counter(r.doc_id for r in docs.collect()).values()) <= 2
        else:
            texts = {r.doc_id: r.text or "" for r in before.collect()}
            codec = byte_bpe.codec(public_tokenizers.path(corpus_pipeline.RANKS), public_tokenizers.PATTERN)
            for r in docs.collect():
                assert codec.decode(r.ids).decode() == texts[r.doc_id] and r.n_tokens == len(np.frombuffer(r.ids, "<u4"))
            continue
        assert docs.columns == columns
    assert len(seen) == 5 and all(n for _, n in seen)


def test_pipeline_decodes_its_ids(spark):
    """The last stage returns the digest of the decoded ids; ids of another text are an error."""
    docs = spark.createDataFrame([(1, "a", "Hello  wörld\n"), (2, "a", None), (3, "b", "")], "doc_id bigint, source string, text string")
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.encode(spark, docs, "").collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in ((1, "Hello  wörld\n"), (2, None), (3, ""))}
    bad = spark.createDataFrame([(1, "a", b"\0\0\0\0", hashlib.sha256(b"x").hexdigest(), hashlib.sha256(b"y").hexdigest())], "doc_id bigint, source string, ids binary, _sha256 string, decoded_sha256 string")
    with pytest.raises(Exception, match="don't decode"):
        corpus_pipeline.checked(bad).collect()


def test_op4_hypergeometric_draws(spark):
    """Draws at evenly spaced u have the exact distribution's frequencies, in its whole range and far from its ends."""
    from math import comb

    from pyspark.sql import functions as F

    for k, n, total in ((5, 4, 12), (0, 3, 9), (7, 7, 7), (30, 50, 60), (400, 900, 1800)):
        u = (F.col("id") + 0.5) / 4000
        got = Counter(r.x for r in spark.range(4000).select(mixing.hypergeometric(F.lit(k), F.lit(n), F.lit(total), u).alias("x")).collect())
        want = {x: comb(k, x) * comb(total - k, n - x) / comb(total, n) for x in range(max(0, n + k - total), min(k, n) + 1)}
        assert set(got) <= set(want) and all(abs(got[x] / 4000 - p) < 0.001 for x, p in want.items())


def test_op4_many_sources(spark):
    """More sources than a node's row holds are split in groups; quotas and shard sizes stay exact."""
    rows = [(f"s{i:03}", (i * 37) % 50) for i in range(150)] + [(None, 9000)]
    got = defaultdict(dict)
    for r in mixing.split_quotas(spark.createDataFrame(rows, "source string, quota int"), 3, 7).collect():
        got[r.source][r.shard] = r.quota
    assert {s: sum(q.values()) for s, q in got.items()} == dict(rows)
    totals = [sum(q[i] for q in got.values()) for i in range(8)]
    assert max(totals) - min(totals) <= 1 and all(min(q.values()) >= 0 for q in got.values())


def test_op4_shards_follow_the_size(spark, monkeypatch):
    """The number of shards grows with the words, each shard has a partition of its own, and the tree's quotas are what is drawn."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "abc"[i % 3] if i % 2 else "a", "w " * (i % 90)) for i in range(4000)], "doc_id bigint, source string, text string")
    sizes = []
    for words in (4_000_000, 40_000):
        monkeypatch.setattr(mixing, "SHARD_WORDS", words)
        mixed = mixing.mix(docs)
        seen = [(r.p, r.mix_shard, r.n) for r in mixed.groupBy(F.spark_partition_id().alias("p"), "mix_shard").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()]
        assert len({s for _, s, _ in seen}) == len(seen) and len({p for p, _, _ in seen}) == len(seen)
        sizes.append(sorted(n for _, _, n in seen))
    assert len(sizes[0]) == 1 and len(sizes[1]) == 8 and sizes[1][-1] < 1.3 * sizes[1][0]
    plan = mixing.plan_mix(docs).collect()
    places = Counter((r.source, d.epoch, d.block, d.shard) for r in plan for d in r.draws)
    assert len({p[:3] for p in places}) == len(places)  # a block of a pass goes to one shard


def plain_ngrams(text, bits):
    """Unigrams, bigrams and repeats of the runs of letters and of marks, counted one by one, by the module's own hash of each run."""
    from pagemill.llm import wordhash

    import numpy as np

    runs, kind = [], None
    for b in text.lower():
        now = 0 if b <= 32 else 1 if chr(b).isalnum() and b < 128 or b >= 128 else 2
        if now and now == kind:
            runs[-1] += bytes([b])
        elif now:
            runs.append(bytes([b]))
        kind = now
    h = [int(wordhash.tokens([r])[0][0]) for r in runs]
    two = [int(wordhash.mixed(np.array([(3 * a + b) % 2**64], np.uint64))[0]) for a, b in zip(h, h[1:])]
    return Counter(x >> 64 - bits for x in h + two + [0x5EED for a, b in zip(h, h[1:]) if a == b])


def test_op2_equals_a_plain_version(spark):
    """The same FTRL steps and dot products with dictionaries, one coordinate at a time."""
    from math import exp, sqrt

    import numpy as np

    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("good fine nice bad, junk!! $$$ É".split()) for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(500, None), (501, "junk " * 3000)]
    labels = [(i, int((t or "").count("junk") < 4)) for i, t in rows if i % 3]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    sparse = {i: plain_ngrams((t or "").encode(), quality.BITS) for i, t in rows}
    learnt = sorted(i for i, _ in labels if zlib.crc32(str(i).encode()) % 5)
    order, truth = [learnt[k] for k in np.random.default_rng(11).permutation(len(learnt))], dict(labels)
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        return 0.0 if abs(z[k]) <= 0.1 else -(z[k] - (0.1 if z[k] > 0 else -0.1)) / ((1 + sqrt(n[k])) / 0.5 + 1)

    def vector(i):
        total = max(1, sum(sparse[i].values()))
        return [*((k, c / sqrt(total)) for k, c in sparse[i].items()), ("bias", 1.0)]

    for i in order * 4:
        x = vector(i)
        w = {k: weight(k) for k, _ in x}
        error = 1 / (1 + exp(-sum(w[k] * v for k, v in x))) - truth[i]
        for k, v in x:
            g = error * v
            z[k] += g - (sqrt(n[k] + g * g) - sqrt(n[k])) / 0.5 * w[k]
            n[k] += g * g
    for i, _ in rows:
        assert got[i] == pytest.approx(1 / (1 + exp(-sum(weight(k) * v for k, v in vector(i)))), abs=1e-4)


def test_op9_risk_equals_a_plain_version():
    """The non-negative risk's steps with dense matrices, on the same bootstrap."""
    import numpy as np

    rng = np.random.default_rng(3)
    labels = (np.arange(300) % 6 == 0).astype(int)
    x = (rng.random((300, 7)) < np.where(labels[:, None], 0.4, 0.1)).astype(float)
    row, column = np.nonzero(x)
    got = toxicity.nnpu(row, column, labels, 1 / 6, steps=120, seed=5)
    draw = np.random.default_rng(5)
    pos = x[draw.choice(np.flatnonzero(labels), 50)]
    unl = x[draw.choice(np.arange(300), 300)]
    w, m, v = np.append(np.zeros(7), -1.0), np.zeros(8), np.zeros(8)
    one = lambda a: np.hstack([a, np.ones((len(a), 1))])
    flips = 0
    for t in range(1, 121):
        sp, su = (1 / (1 + np.exp(-one(a) @ w)) for a in (pos, unl))
        gp, gu = (one(a).T @ (s * (1 - s)) / len(a) for a, s in ((pos, sp), (unl, su)))
        negative = su.mean() - sp.mean() / 6
        flips += negative < 0
        g = gu - gp / 3 if negative >= 0 else gp / 6 - gu
        g[:-1] += 1e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(np.append(*got), w, atol=1e-6)


def test_classifiers_take_a_row_for_each_labelled_id(spark):
    from pagemill.llm.wordhash import labelled_sample

    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None), (3, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None)], "doc_id bigint, toxic int")
    got = [(r.doc_id, r.label) for r in labelled_sample(docs, labels, "toxic", 10).collect()]
    assert sorted(got) == sorted((i, 1) for i in (1, 2) if zlib.crc32(str(i).encode()) % 5)
