"""SimHash near-duplicates: 64-bit fingerprints linked through a forest of vantage-point trees.

A tree splits the fingerprints at each node by their Hamming distance to a vantage point. Two fingerprints at most
`radius` bits apart are at most radius // parts bits apart on one of `parts` equal parts of the bits, so there is one
tree for each part, whose nodes measure that part; a node that can't be split there measures all 64 bits. By the triangle
inequality a query at distance d from the vantage point needs the inner side only if d - r <= mu and the outer side
only if d + r > mu. Each fingerprint has one home shard (leaf) per tree and visits the other shards whose bounds it
overlaps; shards are searched exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import connected_components
from pagemill.llm.shared import cut, slices

_LANES = np.uint64(0x0001000100010001)


def _hashes(text: bytes, width: int) -> np.ndarray:
    words = text.lower().split()  # bytes.lower() changes A-Z only; bytes.split() cuts at \x20 and \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, 42)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(line)]
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def _word(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes that decide a fingerprint's k-th 64 bits: h itself, then further mixes of it."""
    if not k:
        return h
    h = (h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(texts: list[bytes], width: int = 3, words: int = 1, distinct: bool = False) -> np.ndarray:
    """Fingerprints (texts x words of 64 bits): a bit is set if it is set in over half of the hashes of a text's (distinct) shingles."""
    each = [np.unique(h) if distinct else h for h in (_hashes(t, width) for t in texts)]
    n = np.array([len(h) for h in each], np.int64)
    out = np.zeros((len(texts), words), np.uint64)
    if not n.sum():
        return out
    all_h = np.concatenate(each)
    # Four 16-bit counters share a word, so no run that is summed at once may be longer than 65535.
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    cuts, owner = [], []
    for i in np.flatnonzero(n):
        part = np.arange(begin[i], begin[i] + n[i], 65535)
        cuts.append(part)
        owner.append(np.full(len(part), i))
    cuts, owner = np.concatenate(cuts), np.concatenate(owner)
    for k in range(words):
        h = _word(all_h, k)
        for j in range(16):
            sums = np.add.reduceat((h >> np.uint64(j)) & _LANES, cuts)
            for lane in range(4):
                count = np.bincount(owner, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.float64), len(texts))
                out[:, k] |= (2 * count > n).astype(np.uint64) << np.uint64(16 * lane + j)
    return out


def _to_arrow(fps: np.ndarray) -> pa.Array:
    """Fingerprints as big-endian binary."""
    size = 8 * fps.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(fps), [None, pa.py_buffer(fps.astype(">u8").tobytes())]).cast(pa.binary())


def _from_arrow(fps: pa.Array | pa.ChunkedArray, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(fps.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def with_fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 3, words: int = 1) -> DataFrame:
    """The columns in keep and fp, the fingerprint as binary; a null text counts as empty (fingerprint 0)."""
    kept = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            fps = [fingerprints(texts.slice(at, n).to_pylist(), width, words) for at, n in slices(texts)]
            fp = np.concatenate(fps) if fps else np.empty((0, words), np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _to_arrow(fp)], [*keep, "fp"])

    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep) + ", fp binary"
    return kept.mapInArrow(run, schema)


def distance(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Differing bits of fingerprints, of those in mask only if it is given."""
    differ = a ^ b if mask is None else (a ^ b) & mask
    return np.bitwise_count(differ).sum(-1, dtype=np.int16)


def part_masks(words: int, parts: int) -> list[np.ndarray]:
    """Masks that deal a fingerprint's bits into equal runs; parts is a power of two and at least words."""
    size = 64 * words // parts
    run = np.uint64((1 << size) - 1)
    masks = np.zeros((parts, words), np.uint64)
    for k in range(parts):
        masks[k, k * size // 64] = run << np.uint64(k * size % 64)
    return list(masks)


class VantageTree:
    """A tree over 64-bit fingerprints; it is built from a sample, which decides only how evenly the shards fill."""

    def __init__(self, sample: np.ndarray, measures: list[tuple[np.ndarray | None, int]], leaf: int, seed: int = 42):
        """measures: (mask, radius) pairs, the first that splits a node is taken."""
        self.nodes: list[tuple] = []  # (vantage, mask, radius, mu, inner, outer)
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(sample, measures, leaf, rng, 0)

    def _grow(self, x: np.ndarray, measures: list[tuple[np.ndarray | None, int]], leaf: int, rng, depth: int) -> int:
        """A node's number, or -1 - its number for a leaf."""
        if len(x) > leaf and depth < 40:
            for mask, r in measures:
                best = None
                for vantage in x[rng.integers(0, len(x), 6)]:
                    d = distance(x, vantage, mask)
                    mu = int(np.median(d))
                    mu -= int((d <= mu).mean() > 0.75 and mu > 0)
                    inner = int((d <= mu).sum())
                    overlap = int(((d - r <= mu) & (d + r > mu)).sum())
                    if min(inner, len(x) - inner) * 8 >= len(x) and (best is None or overlap < best[0]):
                        best = (overlap, vantage, mu, d <= mu)
                if best is not None:
                    _, vantage, mu, near = best
                    at = len(self.nodes)
                    self.nodes.append(())
                    inner = self._grow(x[near], measures, leaf, rng, depth + 1)
                    outer = self._grow(x[~near], measures, leaf, rng, depth + 1)
                    self.nodes[at] = (vantage, mask, r, mu, inner, outer)
                    return at
        self.leaves += 1
        return -self.leaves

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) for each fingerprint's home and for the shards after it that its bounds overlap."""
        found, work = [], [(self.root, np.arange(len(fps)), np.ones(len(fps), bool))]
        while work:
            node, rows, home = work.pop()
            if not len(rows):
                continue
            if node < 0:
                found.append((rows, np.full(len(rows), -1 - node), home))
                continue
            vantage, mask, r, mu, inner, outer = self.nodes[node]
            d = distance(fps[rows], vantage, mask)
            for child, visit, own in ((inner, d - r <= mu, d <= mu), (outer, d + r > mu, d > mu)):
                work.append((child, rows[visit], (home & own)[visit]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        rows, leaf, home = (np.concatenate(x) for x in zip(*found, strict=True))
        own = np.zeros(len(fps), np.int64)
        own[rows[home]] = leaf[home]
        keep = leaf >= own[rows]  # a pair in two shards is found in the later one
        return rows[keep], leaf[keep], home[keep]


class _Sets:
    """Disjoint sets over 0..n-1, joined by whole arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(jump := label[label], label):
                label[:] = jump


def search(members: np.ndarray, queries: np.ndarray, fps: np.ndarray, radius: int, found, rng=None) -> None:
    """Call found(a, b) with arrays of positions in fps of all pairs (query, member) within radius, in blocks.

    A local vantage-point tree: large sets are split by a vantage point on all 64 bits until pruning no longer pays.
    """
    rng = rng or np.random.default_rng(7)
    work = [(members, queries)]
    while work:
        m, q = work.pop()
        if not len(m) or not len(q):
            continue
        if len(m) > 512 and len(m) * len(q) > 4_000_000:
            vantage = fps[m[rng.integers(len(m))]]
            dm, dq = distance(fps[m], vantage), distance(fps[q], vantage)
            mu = int(np.median(dm))
            inner, outer = dm <= mu, dm > mu
            qi, qo = dq - radius <= mu, dq + radius > mu
            if inner.sum() * qi.sum() + outer.sum() * qo.sum() < 0.9 * len(m) * len(q):
                work += [(m[inner], q[qi]), (m[outer], q[qo])]
                continue
        step = max(1, 2_000_000 // len(m))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            differ = sum(np.bitwise_count(fps[part, k][:, None] ^ fps[m, k][None, :]).astype(np.uint8) for k in range(fps.shape[1]))
            a, b = np.nonzero(differ <= radius)
            found(part[a], m[b])


def links(fps: DataFrame, radius: int = 3, words: int = 1, parts: int = 2, near: int | None = None, leaf: int = 128, sample: int = 16384, max_leaves: int = 4096, shard_rows: int = 2_000_000) -> DataFrame:
    """(src, dst) links that span the components of fps(fp, rep), whose fp are distinct and rep are its node numbers.

    Each tree searches its part of the bits within `near` bits, radius // parts unless given; with that, no pair is missed.
    The bounded sample of fingerprints (those with the smallest hash) only places the cuts. A leaf that more than
    shard_rows fingerprints reach, because there are very many or because they lie close together, is compared in pairs
    of blocks, each a shard of its own; inside a shard a local tree goes on splitting. Each shard joins what it finds and
    returns at most one link for each of its fingerprints, never all pairs.
    """
    n = fps.count()
    rows = fps.select("fp").orderBy(F.xxhash64(F.lit(5), "fp"), "fp").limit(sample).toArrow()
    drawn = _from_arrow(rows.column("fp"), words)
    size = max(4, len(drawn) // max(1, min(max_leaves, -(-n // leaf))))
    near = radius // parts if near is None else near
    trees = [VantageTree(drawn, [(mask, near), (None, radius)], size) for mask in part_masks(words, parts)]

    def routed(counted: bool):
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 20000):
                    part = b.slice(at, 20000)
                    fp, rep = _from_arrow(part.column(0), words), np.asarray(part.column(1))
                    for k, tree in enumerate(trees):
                        i, shard, home = tree.route(fp)
                        if counted:
                            found, each = np.unique(shard * len(trees) + k, return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(each)], ["shard", "rows"])
                        else:
                            yield pa.RecordBatch.from_arrays([pa.array(shard * len(trees) + k), _to_arrow(fp[i]), pa.array(rep[i]), pa.array(home)], ["shard", "fp", "rep", "home"])

        return route

    def pairs(group: pa.Table) -> pa.Table:
        rep, home = np.asarray(group.column("rep")), np.asarray(group.column("home").combine_chunks())
        order = np.argsort(rep, kind="stable")  # so that a set's label is its smallest node
        fp, rep, home = _from_arrow(group.column("fp"), words)[order], rep[order], home[order]
        sets = _Sets(len(fp))
        search(np.flatnonzero(home), np.arange(len(fp)), fp, radius, sets.join)
        moved = np.flatnonzero(sets.label != np.arange(len(fp)))
        return pa.table({"src": pa.array(rep[moved]), "dst": pa.array(rep[sets.label[moved]])})

    sizes = fps.select("fp", "rep").mapInArrow(routed(True), "shard bigint, rows bigint").groupBy("shard").agg(F.sum("rows").alias("rows"))
    large = cut(sizes.filter(F.col("rows") > shard_rows).select("shard", F.ceil(F.col("rows") / shard_rows).cast("int").alias("blocks")))
    rows = fps.select("fp", "rep").mapInArrow(routed(False), "shard bigint, fp binary, rep bigint, home boolean")
    if not (n_large := large.count()):
        return rows.groupBy("shard").applyInArrow(pairs, "src bigint, dst bigint")
    known = rows.join(F.broadcast(large) if n_large <= 10_000 else large, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64(F.lit(9), "rep"), "blocks").cast("int")
    spread = known.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = spread.select("shard", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp", "rep", "home")
    return paired.groupBy("shard", "lo", "hi").applyInArrow(pairs, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, words: int = 1, parts: int = 2, near: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits for each word) and component_id of every row of docs.

    A text's words are runs of anything but \\x20 and \\x09-\\x0D after lower-casing A-Z; a text shorter than a shingle is
    one shingle; a null or empty text has fingerprint zero and is linked like any other. component_id is the smallest
    doc_id reachable over links. Repeated rows each come back; a row without a doc_id comes back with the component of
    its fingerprint and is never a component's name (null if no row with an id is reachable). Other columns are not read.
    """
    signed = cut(with_fingerprint(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), width=width, words=words))
    distinct = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = connected_components(links(distinct.filter("rep is not null"), radius, words, parts, near))
    named = cut(distinct.join(groups, distinct.rep == groups.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return signed.join(named, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _signed(docs: DataFrame, width: int, words: int) -> DataFrame:
    """doc_id, raw (a hash of the stored text), node (a hash of its words) and fp over distinct shingles, of every row."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("raw"), F.coalesce("text", F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in slices(b.column(2)):
                part = b.slice(at, n)
                texts = part.column(2).to_pylist()
                nodes = np.array([xxhash.xxh64_intdigest(b" ".join(t.lower().split()), 43) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes), _to_arrow(fingerprints(texts, width, words, distinct=True))], ["doc_id", "raw", "node", "fp"])

    return kept.mapInArrow(run, "doc_id bigint, raw bigint, node bigint, fp binary")


def sampled_bits(bits: int, tables: int, size: int, seed: int = 42) -> np.ndarray:
    """(tables x size) positions of the bits that each tree measures, without repetition inside a tree."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(bits)[:size] for _ in range(tables)])


class Forest:
    """Vantage-point trees over sampled bits of fingerprints, grown and passed a level at a time for all rows at once.

    A tree's distance is the number of differing bits among those at its row of `positions`. A query at distance d from a
    node's vantage point visits the inner side only if d - near <= bound and the outer side only if d + near > bound, so
    fingerprints within `near` bits there meet in a leaf. The drawn fingerprints decide only how evenly the leaves fill.
    """

    def __init__(self, drawn: np.ndarray, positions: np.ndarray, leaf: int, near: int = 0, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.positions, self.near = positions, near
        self.trees = [self._grow(key, leaf, rng) for key in self._keys(drawn)] if len(drawn) else []

    def _keys(self, fps: np.ndarray) -> Iterator[np.ndarray]:
        bits, weights = _bits(fps), 2.0 ** np.arange(self.positions.shape[1])
        return ((bits[:, chosen] @ weights).astype(np.uint32) for chosen in self.positions)

    @staticmethod
    def _grow(x: np.ndarray, leaf: int, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vantage point, bound, the inner and the outer child) of each node; a child is a node or -1 - a leaf's number."""
        if len(x) <= leaf:
            return x[:1], np.array([64], np.int16), np.array([[-1, -2]], np.int32)  # all on the inner side
        vantage, bounds, children = [], [], []
        group, n, nodes, leaves = np.zeros(len(x), np.int64), 1, 1, 0
        while n:
            order = np.argsort(group, kind="stable")
            x, group = x[order], group[order]
            start = np.searchsorted(group, np.arange(n + 1))
            size = np.diff(start)
            vantage.append(x[start[:-1] + rng.integers(0, size)])
            d = np.bitwise_count(x ^ vantage[-1][group]).astype(np.int16)
            order = np.lexsort((d, group))
            x, d = x[order], d[order]
            farthest = d[start[1:] - 1]
            bounds.append(np.minimum(d[start[:-1] + (size - 1) // 2], farthest - 1))
            side = 2 * group + (d > bounds[-1][group])
            grows = (np.bincount(side, minlength=2 * n) > leaf) & np.repeat(farthest > 0, 2)
            children.append(np.where(grows, nodes + np.cumsum(grows) - 1, -leaves - np.cumsum(~grows)).reshape(-1, 2))
            goes = grows[side]
            x, group, n = x[goes], (np.cumsum(grows) - 1)[side[goes]], int(grows.sum())
            nodes, leaves = nodes + n, leaves + len(grows) - n
        return np.concatenate(vantage), np.concatenate(bounds).astype(np.int16), np.concatenate(children).astype(np.int32)

    def route(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each tree (row, leaf) of all leaves that the fingerprints visit."""
        for key, (vantage, bound, children) in zip(self._keys(fps), self.trees, strict=True):
            row, node, found = np.arange(len(key)), np.zeros(len(key), np.int64), []
            while len(row):
                d = np.bitwise_count(key[row] ^ vantage[node]).astype(np.int16)
                inner, outer = d - self.near <= bound[node], d + self.near > bound[node]
                row, node = np.concatenate([row[inner], row[outer]]), np.concatenate([children[node[inner], 0], children[node[outer], 1]])
                ends = node < 0
                found.append((row[ends], -1 - node[ends]))
                row, node = row[~ends], node[~ends]
            yield tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (row, node)

    def first(self, differ: np.ndarray) -> np.ndarray:
        """The first tree that surely puts a pair into one leaf, by the pairs' differing bits; -1 if none does."""
        inside = np.zeros((differ.shape[1], len(self.positions)), np.float32)
        inside[self.positions.T, np.arange(len(self.positions))] = 1
        sure = differ.astype(np.float32) @ inside <= self.near
        return np.where(sure.any(1), sure.argmax(1), -1)


def _bits(fps: np.ndarray) -> np.ndarray:
    """The fingerprints' bits, one a byte."""
    return np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)


def grown(fps: DataFrame, n: int, words: int, tables: int, size: int, near: int = 0, leaf: int = 128, sample: int = 16384) -> Forest:
    """The forest for the n rows of fps(fp); the bounded sample has the fingerprints with the smallest hash."""
    rows = fps.select("fp").orderBy(F.xxhash64(F.lit(5), "fp"), "fp").limit(sample).toArrow()
    drawn = _from_arrow(rows.column("fp"), words)
    return Forest(drawn, sampled_bits(64 * words, tables, size), max(4, len(drawn) * leaf // max(1, n)), near)


def _in_leaves(fps: DataFrame, n: int, words: int, forest: Forest) -> DataFrame:
    """Each row of fps(fp, node, label) in the leaves that it visits; a shard holds neighbouring leaves of one tree."""
    shift = min(10, max(0, (n // 4096).bit_length()))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 20000):
                part = b.slice(at, 20000)
                for t, (row, leaf) in enumerate(forest.route(_from_arrow(part.column(0), words))):
                    shard = (t << 20) + (leaf >> shift)
                    columns = [c.take(pa.array(row)) for c in part.columns]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(np.full(len(row), t, np.int32)), *columns], ["shard", "leaf", "t", "fp", "node", "label"])

    return fps.select("fp", "node", "label").mapInArrow(route, "shard int, leaf int, t int, fp binary, node bigint, label bigint")


def _search_leaves(group: pa.Table, words: int, found) -> None:
    """Call found(fp, node, label, rows, differ) for blocks of rows of each leaf: their bits differing from all of its rows."""
    node, key = np.asarray(group.column("node")), np.asarray(group.column("leaf"))
    order = np.lexsort((node, key))
    node, key, fp, label = node[order], key[order], _from_arrow(group.column("fp"), words)[order], np.asarray(group.column("label"))[order]
    ends = [*(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    for a, b in zip([0, *ends], ends):
        step = max(1, 2_000_000 // max(1, b - a))
        for at in range(a, b if b - a > 1 else a, step):
            rows = np.arange(at, min(b, at + step))
            differ = sum(np.bitwise_count(fp[rows, k][:, None] ^ fp[a:b, k][None, :]).astype(np.uint8) for k in range(words))
            found(fp[a:b], node[a:b], label[a:b], rows - a, differ)


def closest_candidates(fps: DataFrame, n: int, radius: int, words: int, forest: Forest) -> DataFrame:
    """(node, other, near): every node that shares a leaf with another within radius, the closest with a smaller number, and how many at most."""

    def run(group: pa.Table) -> pa.Table:
        out = []

        def found(fp, node, label, rows, differ):
            hit = differ <= radius
            hit[np.arange(len(rows)), rows] = False
            near = hit.sum(1)
            some = near > 0
            if some.any():
                lower = np.where(hit & (np.arange(len(node))[None, :] < rows[:, None]), differ, 255)[some]
                best = lower.argmin(1)
                out.append((node[rows[some]], node[best], lower[np.arange(len(best)), best].astype(np.int32), near[some].astype(np.int32)))

        _search_leaves(group, words, found)
        a, b, d, near = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32))
        return pa.table({"node": pa.array(a), "other": pa.array(b, mask=d == 255), "differ": pa.array(d), "near": pa.array(near)})

    each = _in_leaves(fps, n, words, forest).groupBy("shard").applyInArrow(run, "node bigint, other bigint, differ int, near int")
    return each.groupBy("node").agg(F.min_by("other", "differ").alias("other"), F.max("near").alias("near"))


def open_candidates(fps: DataFrame, n: int, radius: int, words: int, forest: Forest) -> DataFrame:
    """(src, dst, dense) of all pairs within radius that share a leaf and have different labels.

    A pair comes from the first tree that surely finds it, a pair that no tree surely finds from each that does.
    A label is twice the number of a node's group, or for a dense node twice that of its cluster and one more. Pairs of
    dense nodes don't come: a leaf gives links that span them instead, marked dense, at most one for each node.
    """

    def run(group: pa.Table) -> pa.Table:
        out, t = [], int(group.column("t")[0].as_py())

        def found(fp, node, label, rows, differ):
            dense = (label & 1).astype(bool)
            i, j = np.nonzero((differ <= radius) & (label[rows][:, None] != label[None, :]) & (np.arange(len(node))[None, :] < rows[:, None]))
            both = dense[rows[i]] & dense[j]
            if both.any():
                sets = _Sets(len(node))
                sets.join(rows[i[both]], j[both])
                moved = np.flatnonzero(sets.label != np.arange(len(node)))
                out.append((node[moved], node[sets.label[moved]], np.ones(len(moved), bool)))
                i, j = i[~both], j[~both]
            for at in range(0, len(i), 20000):
                a, b = rows[i[at : at + 20000]], j[at : at + 20000]
                tree = forest.first(_bits(fp[a] ^ fp[b]))
                first = (tree == t) | (tree < 0)
                out.append((node[a[first]], node[b[first]], np.zeros(int(first.sum()), bool)))

        _search_leaves(group, words, found)
        a, b, d = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        return pa.table({"src": pa.array(a), "dst": pa.array(b), "dense": pa.array(d)})

    return _in_leaves(fps, n, words, forest).groupBy("shard").applyInArrow(run, "src bigint, dst bigint, dense boolean")


def similar_in_clusters(clusters: DataFrame, sets: DataFrame, percent: int, block: int = 1024, shingles: int = 4_000_000) -> DataFrame:
    """(src, dst) links that span the similar texts of each cluster of clusters(node, component), compared exactly.

    A cluster of more than `block` texts, or of more than so many shingles, is compared in pairs of blocks, each a group
    of its own; a group counts shared shingles by products of 0-1 matrices and returns links that span its texts. Two
    different blocks give only those that their own links, which each block gives once, don't make needless.
    """

    def run(group: pa.Table) -> pa.Table:
        node = np.asarray(group.column("node"))
        order = np.argsort(node, kind="stable")
        node, own, lists = node[order], np.asarray(group.column("own"))[order], group.column("shingles").combine_chunks()
        each = [np.asarray(lists[int(i)].values) for i in order]
        n = np.array([len(x) for x in each])
        row = np.repeat(np.arange(len(n)), n)
        token, column, held_by = np.unique(np.concatenate(each) if each else np.empty(0, np.int64), return_inverse=True, return_counts=True)
        real = held_by[column] > 1
        row, column = row[real], (np.cumsum(held_by > 1) - 1)[column[real]]
        by_column = np.argsort(column, kind="stable")
        row, column = row[by_column], column[by_column]
        shared = np.zeros((len(n), len(n)), np.float32)
        for at in range(0, int(column.max(initial=-1)) + 1, 2048):
            a, b = np.searchsorted(column, (at, at + 2048))
            ones = np.zeros((len(n), 2048), np.float32)
            ones[row[a:b], column[a:b] - at] = 1
            shared += ones @ ones.T
        inside, sets_of = _Sets(len(n)), _Sets(len(n))
        for at in range(0, len(n), 256):
            part = shared[at : at + 256].astype(np.float64)
            a, b = np.nonzero((part > 0) & (100 * part >= percent * (n[at : at + 256, None] + n[None, :] - part)))
            a, b = a[a + at < b] + at, b[a + at < b]
            sets_of.join(a, b)
            if (own != own[0]).any():
                same = own[a] == own[b]
                inside.join(a[same], b[same])
        # A set of several blocks is a star of its blocks' own sets: their smallest texts.
        moved = np.flatnonzero((sets_of.label != np.arange(len(n))) & (inside.label == np.arange(len(n))))
        return pa.table({"src": pa.array(node[moved]), "dst": pa.array(node[sets_of.label[moved]])})

    rows = clusters.join(sets, "node").select("component", "node", "shingles")
    sizes = rows.groupBy("component").agg(F.count("*").alias("m"), F.sum(F.size("shingles")).alias("all"))
    dealt = cut(sizes.select("component", F.ceil(F.greatest(F.col("m") / block, F.col("all") / shingles)).cast("int").alias("blocks")))
    known = rows.join(dealt, "component").withColumn("own", F.pmod(F.xxhash64(F.lit(4), "node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = known.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "own", "shingles")
    return paired.groupBy("component", "lo", "hi").applyInArrow(run, "src bigint, dst bigint")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of texts(node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in slices(b.column(1)):
                part = b.slice(at, n)
                sets = [np.unique(_hashes(t, width)).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("node", F.coalesce("text", F.lit("")).cast("binary")).mapInArrow(run, "node bigint, shingles array<bigint>")


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs(src, dst) whose sets' shared shingles are at least percent of all their shingles."""
    a, b = sets.select(F.col("node").alias("src"), F.col("shingles").alias("_a")), sets.select(F.col("node").alias("dst"), F.col("shingles").alias("_b"))
    both = pairs.join(a, "src").join(b, "dst").withColumn("_n", F.size(F.array_intersect("_a", "_b")))
    return both.filter((F.col("_n") > 0) & (100 * F.col("_n") >= percent * (F.size("_a") + F.size("_b") - F.col("_n")))).select("src", "dst")


def keep_one_per_group(docs: DataFrame, width: int = 5, percent: int = 80, radius: int = 34, words: int = 2, tables: int = 64, size: int = 10, dense: int = 64) -> DataFrame:
    """The rows of docs, in their own columns, of one document of each near-duplicate group: its smallest doc_id.

    Two texts are linked if their words are the same, or if they share at least `percent` of all their distinct shingles
    of five words; groups are the components of these links, and texts without words are linked to each other only.
    128-bit fingerprints choose the pairs that are compared: those within `radius` bits that meet in a leaf of one of
    `tables` vantage-point trees, each over `size` sampled bits. At a similarity of 0.8 fingerprints differ in 19 bits
    with a deviation of 4; fingerprints that agree on a tree's bits surely meet in it. First each text is compared with
    the closest one before it, then all pairs that aren't in one group yet. Texts with `dense` or more others that close
    in one leaf don't give pairs: the clusters that they make are compared exactly, block by block, and give spanning
    links. Rows that repeat the kept doc_id with a text of its group stay, and so do rows without a doc_id, which no rule
    can choose between.
    """
    signed = cut(_signed(docs, width, words))
    distinct = cut(signed.filter("doc_id is not null").groupBy("node", "fp").agg(F.min("doc_id").alias("rep"), F.min_by("raw", "doc_id").alias("raw")))
    n = distinct.count()
    forest = grown(distinct, n, words, tables, size)
    closest = cut(closest_candidates(distinct.withColumn("label", F.col("node")), n, radius, words, forest))
    held = distinct.join(closest.select("node"), "node").select("node", "rep", F.col("raw").alias("_raw"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("_raw"), "text").join(held, ["rep", "_raw"])
    sets = cut(shingle_sets(texts.dropDuplicates(["node"]), width))
    sure = cut(similar_pairs(closest.filter("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")), sets, percent))
    groups = connected_components(sure)
    # Dense texts are first put into clusters by the closest one before each; what the clusters hold is compared exactly.
    thick = cut(closest.filter(F.col("near") >= dense).select("node", "other"))
    near_links = cut(thick.join(thick.select(F.col("node").alias("other")), "other").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    first = connected_components(near_links).withColumnRenamed("component", "cluster")
    label = F.when(F.col("near") >= dense, F.shiftleft(F.coalesce("cluster", "node"), 1) + 1).otherwise(F.shiftleft(F.coalesce("component", "node"), 1))
    rest = distinct.join(closest.select("node", "near"), "node").join(groups, "node", "left").join(first, "node", "left").select("fp", "node", label.alias("label"))
    open_pairs = cut(open_candidates(cut(rest), n, radius, words, forest))
    more = similar_pairs(open_pairs.filter("not dense").select("src", "dst"), sets, percent)
    clusters = connected_components(near_links.unionByName(open_pairs.filter("dense").select("src", "dst")))
    more = more.unionByName(similar_in_clusters(clusters, sets, percent))
    groups = connected_components(sure.unionByName(more))
    named = cut(distinct.join(groups, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")))
    least = cut(named.groupBy("component").agg(F.min("rep").alias("kept")))
    kept = cut(named.join(least, "component").select("node", "kept"))
    gone = cut(signed.join(kept, "node").filter("doc_id <> kept").select(F.col("doc_id").alias("_gone"), F.col("raw").alias("_raw")).distinct())
    return docs.join(gone, (docs.doc_id == gone._gone) & (F.xxhash64(docs.text) == gone._raw), "left_anti")
