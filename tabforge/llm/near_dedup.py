"""Near-duplicate groups by an LSH forest over MinHash signatures, with links confirmed on full shingle sets.

Documents with equal shingle sets become one node.  The forest holds TREES sorted orders of the nodes; the order of a
tree is that of its own slice of the signature, then of the values after it.  Nodes that share the first DEPTH values of
a tree form a region.  Its depth adapts: a region of at most LEAF nodes is one leaf, in a denser one the prefix grows
value by value until as few nodes share it.  Those of a leaf have the longest common prefixes with each other: each takes
the likeliest before and after it, and where leaves meet the next NEIGHBOURS in order are taken.  Pairs are
confirmed on their full sets and joined into components.  What neighbours can miss is then looked up exactly: in every
region that still holds more than one component, all nodes outside its largest component are compared by signature
with all nodes of other components, in blocks of bounded size.  Nodes that look like one of another component are then
compared on full sets, again in blocks.  No region is capped, and pairs are only listed where nodes are neighbours: what
a block finds is a row for each of its rows at most.

A pair at the similarity bound shares a region with probability 1 - (1 - t^DEPTH)^TREES, above 0.9999 at t = 0.8.

Defined results: a document without words has an empty set and links with nothing; with fewer words than a shingle its
whole sequence is its one shingle; rows that repeat a doc_id are one document that has the links of each of its texts; rows
without doc_id link with nothing, have no component and are kept; null text counts as empty; an empty table gives an
empty table.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import scratch, small_batches, sub_batches, tidy, written

TREES, DEPTH, NEIGHBOURS, BLOCK = 20, 4, 3, 128
#: Nodes of a leaf at most, and rows of a sorted order that a worker looks at together.
LEAF, ROWS_AT_ONCE = 16, 4096
#: A pair is confirmed if its share of equal signature values is at most this much below the bound: 4.5 standard errors.
SLACK = 0.2
#: Ids of this many nodes at most are broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_M = TREES * DEPTH
_RANDOM = np.random.default_rng(20240229)
_XOR, _MUL = _RANDOM.integers(0, 2**63, _M, np.uint64) * np.uint64(2) + np.uint64(1), _RANDOM.integers(0, 2**63, _M, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _RANDOM.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for k, b in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; A-Z are lower-cased, words are what white space parts."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    up, down = _power(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * up[:-1], dtype=np.uint64, out=total[1:])
    space = _SPACE[flat]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    word = _mixed((total[end] - total[start]) * down[start])
    doc_ends = np.cumsum([len(r) + 1 for r in raw])
    upto = np.searchsorted(start, doc_ends)
    n = max(0, len(word) - words + 1)
    joint = np.zeros(n, np.uint64)
    for k in range(words):
        joint += word[k : k + n] * _PLACE[k]
    joint, out, a = _mixed(joint), [], 0
    for b in upto.tolist():
        if b - a >= words:
            out.append(np.unique(joint[a : b - words + 1]))
        elif b > a:
            out.append(_mixed((word[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.array([b - a], np.uint64) * _PLACE[-1:]))
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signature of each nonempty set: 16 bits of the element that is least under each of the hash orders."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), _M), np.uint16)
    for j in range(_M):
        out[:, j] = (np.minimum.reduceat((flat ^ _XOR[j]) * _MUL[j], at) >> np.uint64(20)).astype(np.uint16)
    return out


def sketches(docs: DataFrame, key: str, text_col: str, words: int) -> DataFrame:
    """doc_id, n_shingles, set_id (null: empty set) and signature of every row."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for i, j in sub_batches(texts):
                sets = shingle_sets(texts[i:j], words)
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full)) if full else iter(())
                names = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sigs = [next(sig).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(map(len, sets), pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_id", "sig"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_shingles long, set_id binary, sig binary")


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    def column(n):
        c = batch.column(n)
        if n in ("sig", "rest"):
            return np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(c), -1)
        if n == "members":
            out = np.empty(len(c), object)
            out[:] = [np.frombuffer(x, np.uint64) for x in c.to_pylist()]
            return out
        return c.to_numpy(zero_copy_only=False)

    return [column(n) for n in names]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])


def _agreeing(n1, n2, s1, s2, t: float) -> np.ndarray:
    """Equal places of the signatures where sizes allow the similarity and signatures suggest it, else 0."""
    ok = np.minimum(n1, n2) >= t * np.maximum(n1, n2)
    out = np.zeros(len(ok), np.int64)
    if ok.any():
        i = np.flatnonzero(ok)
        equal = (s1[i] == s2[i]).sum(1)
        # Counted, since 0.8 - 0.2 is a little above 0.6 and would ask for one place more.
        out[i] = np.where(equal >= int((t - SLACK) * _M + 1e-6), equal, 0)
    return out


def _alike(n1, n2, s1, s2, t: float) -> np.ndarray:
    """Whether sizes allow the similarity and signatures suggest it."""
    return _agreeing(n1, n2, s1, s2, t) > 0


def leaves(bucket: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """First row of every row's leaf: the shallowest prefix from DEPTH on that LEAF rows at most share; rows of which more
    share all values stand alone.  Rows are in the order of bucket and rest, the values that follow the first DEPTH."""
    same = np.logical_and.accumulate(rest[1:] == rest[:-1], axis=1).sum(1)
    depth = np.where(bucket[1:] == bucket[:-1], DEPTH + same, 0)
    leaf = np.full(len(bucket), -1)
    for d in range(DEPTH, DEPTH + rest.shape[1] + 1):
        new = np.r_[True, depth < d]
        group = np.cumsum(new) - 1
        fits = (leaf < 0) & (np.bincount(group)[group] <= LEAF)
        leaf[fits] = np.flatnonzero(new)[group[fits]]
    return np.where(leaf < 0, np.arange(len(leaf)), leaf)


def _candidates(cols: list[np.ndarray], done: int, upto: int, t: float):
    """Pairs of rows: the likeliest before and after each in its leaf, and NEIGHBOURS places on across leaves of a region.

    Leaves that end after done and by upto, and pairs whose later row is from done and before upto, are read."""
    bucket, rest, ids, n, sig = cols
    leaf = leaves(bucket, rest)
    end = np.searchsorted(leaf, leaf, "right")
    ready = (end > done) & (end <= upto)
    best = np.zeros((2, len(ids)), np.int64)
    partner = np.zeros((2, len(ids)), np.int64)
    for lag in range(1, LEAF):
        i = np.flatnonzero(ready[: len(ids) - lag] & (leaf[: len(ids) - lag] == leaf[lag:]))
        if not len(i):
            break
        j = i + lag
        score = np.where(ids[i] == ids[j], 0, _agreeing(n[i], n[j], sig[i], sig[j], t))
        for side, x, y in ((0, j, i), (1, i, j)):
            better = score > best[side, x]
            best[side, x[better]], partner[side, x[better]] = score[better], y[better]
    side, x = np.nonzero(best)
    yield ids[x], ids[partner[side, x]]
    for lag in range(1, NEIGHBOURS + 1):
        j = np.arange(max(done, lag), upto)
        i = j - lag
        i = i[(bucket[i] == bucket[j]) & (leaf[i] != leaf[j]) & (ids[i] != ids[j])]
        if len(i):
            i = i[_alike(n[i], n[i + lag], sig[i], sig[i + lag], t)]
            yield ids[i], ids[i + lag]


def _in_order(chunks, t: float):
    """The candidates of sorted rows that come in chunks; holds few more rows at once than ROWS_AT_ONCE and a chunk."""
    held, new, done = None, [], 0
    for chunk in chain(chunks, [None]):
        if chunk is not None:
            new.append(chunk)
            if sum(len(c[0]) for c in new) < ROWS_AT_ONCE:
                continue
        parts = ([held] if held else []) + new
        if not parts:
            return
        cols, new = [np.concatenate(x) for x in zip(*parts, strict=True)], []
        # What LEAF rows follow and precede is known to be whole, or to be denser than a leaf.
        upto = len(cols[0]) if chunk is None else max(done, len(cols[0]) - LEAF)
        yield from _candidates(cols, done, upto, t)
        drop = max(0, upto - 2 * LEAF)
        held, done = [c[drop:] for c in cols], upto - drop


def neighbours(rows: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) of nodes that look alike: neighbours by longest common prefix in a sorted order.

    The depth adapts to the region: where LEAF nodes at most share the first DEPTH values these are one leaf, in a denser
    region the prefix grows until as few share it.  A node takes the likeliest before and after it in its leaf; where
    leaves of a region meet, nodes within NEIGHBOURS places are paired too.
    """
    names = ["bucket", "rest", "id", "n", "sig"]

    def run(batches):
        for a, b in _in_order((_columns(batch, names) for batch in batches), t):
            yield _pairs(a, b)

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, "bucket", "rest", "id").sortWithinPartitions("bucket", "rest", "id")
    return ordered.select(*names).mapInArrow(tidy(run), "a long, b long").distinct()


def _by_block(batches, names: list[str], each):
    """each(columns of one block) over batches that are sorted by block; a block that goes on is held."""
    held = None
    for batch in batches:
        new = _columns(batch, names)
        cols = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        cuts = np.flatnonzero(np.diff(cols[0])) + 1
        for a, b in zip(np.r_[0, cuts[:-1]] if len(cuts) else (), cuts, strict=True):
            yield from each([c[a:b] for c in cols])
        last = cuts[-1] if len(cuts) else 0
        held = [c[last:] for c in cols]
    if held is not None and len(held[0]):
        yield from each(held)


def across(blocks: DataFrame, t: float) -> DataFrame:
    """block, id, probe, root: the probe and base rows of a block that look alike by signature though their components differ.

    root names the rows of a block that hang together, so there is one row for each row of the block at most, however many
    pairs look alike.  Two nodes that share several regions are compared in that of their first tree only, and two that are
    both outside the largest component only from the one of the smaller component.
    """

    def suspects(block):
        name, ids, comp, n, sig, probe, tree, top = block
        root = np.arange(len(ids))

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        hit = np.zeros(len(ids), bool)
        for p in np.flatnonzero(probe):
            i = np.flatnonzero(~probe & ((comp > comp[p]) | (comp == top) & (comp != comp[p])))
            if len(i):
                i = i[_alike(n[i], n[p], sig[i], np.broadcast_to(sig[p], (len(i), _M)), t)]
                shared = (sig[i] == sig[p]).reshape(len(i), TREES, DEPTH).all(2)
                for x in i[shared.argmax(1) == tree[p]]:
                    hit[[x, p]] = True
                    root[find(x)] = find(p)
        at = np.flatnonzero(hit)
        if len(at):
            least: dict[int, int] = {}
            for x in at:
                least[r] = min(least.get(r := find(x), ids[x]), ids[x])
            yield pa.RecordBatch.from_arrays([pa.array(name[at], pa.int64()), pa.array(ids[at], pa.int64()), pa.array(probe[at], pa.bool_()), pa.array([least[find(x)] for x in at], pa.int64())], names=["block", "id", "probe", "root"])

    names = ["block", "id", "comp", "n", "sig", "probe", "tree", "top"]
    dealt = blocks.repartition("block").sortWithinPartitions("block")
    return dealt.select(*names).mapInArrow(tidy(lambda batches: _by_block(batches, names, suspects)), "block long, id long, probe boolean, root long")


def _dealt(suspects: DataFrame, comps: DataFrame) -> DataFrame:
    """id, comp, probe, also and block of the rows to compare: each suspect pair meets in a block.

    Suspects that hang together over all blocks are a cluster.  A cluster is dealt out as one grid of blocks of about BLOCK
    nodes and BLOCK probes, or its rows stay in the blocks in which they were found, whichever takes fewer rows: the one
    bounds what a dense cluster costs, the other what a long chain does.  also: the node of a base row is a probe of the
    grid too, so its pairs with other probes need comparing from one side only.
    """
    cluster = components(suspects.select(F.col("id").alias("a"), F.col("root").alias("b")))
    rows = written(suspects.select("block", "id", "probe").distinct().join(cluster.select("id", F.col("comp").alias("cluster")), "id", "left").withColumn("cluster", F.coalesce("cluster", "id")), "suspects")
    nodes = written(rows.groupBy("id", "cluster").agg(F.max("probe").alias("also")), "members")
    sizes = nodes.groupBy("cluster").agg(F.count("*").alias("c"), F.count_if("also").alias("p"))
    sizes = sizes.select("cluster", F.ceil(F.col("c") / BLOCK).cast("int").alias("base"), F.ceil(F.col("p") / BLOCK).cast("int").alias("probes"), (F.col("c") * F.ceil(F.col("p") / BLOCK) + F.col("p") * F.ceil(F.col("c") / BLOCK)).alias("cost"))
    sizes = written(sizes.join(rows.groupBy("cluster").agg(F.count("*").alias("found")), "cluster"), "sizes")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    grid = nodes.join(sizes.filter("cost <= found"), "cluster")
    as_base = grid.select("cluster", "id", own("base").alias("i"), F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("j"), F.lit(False).alias("probe"), "also")
    as_probe = grid.filter("also").select("cluster", "id", F.explode(F.sequence(F.lit(0), F.col("base") - 1)).alias("i"), own("probes").alias("j"), F.lit(True).alias("probe"), "also")
    placed = as_base.union(as_probe).select("id", "probe", "also", F.xxhash64("cluster", "i", "j").alias("block"))
    left = rows.join(sizes.filter("cost > found").select("cluster"), "cluster").select("id", "probe", F.lit(False).alias("also"), "block")
    return placed.union(left).join(comps.select("id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def searched(suspects: DataFrame, comps: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text_col: str, words: int, t: float) -> DataFrame:
    """Links (a, b) between components: suspect pairs that reach the similarity on full sets.

    Inside a block signatures tell which sets to compare, the likeliest first, and components that a link has joined aren't
    compared again.
    """
    with scratch(docs.sparkSession):
        rows = written(_dealt(suspects, comps), "search", outer=True)
    sets = _sets(rows.select(F.col("id").alias("doc_id")).distinct(), docs, key, text_col, words)
    full = rows.join(nodes.select("id", "n", "sig"), "id").join(sets.select(F.col("doc_id").alias("id"), "members"), "id")
    percent = round(100 * t)

    def links(block):
        _, ids, comp, n, sig, members, probe, also = block
        base, out, parent = np.flatnonzero(~probe), [], {}

        def top(x):
            while (y := parent.get(x, x)) != x:
                x = y
            return x

        for p in np.flatnonzero(probe):
            own = top(comp[p])
            others = base[(comp[base] != comp[p]) & (~also[base] | (comp[base] > comp[p]))]
            alike = others[_alike(n[others], n[p], sig[others], np.broadcast_to(sig[p], (len(others), _M)), t)]
            for i in alike[np.argsort(-(sig[alike] == sig[p]).sum(1), kind="stable")]:
                if (other := top(comp[i])) == own:
                    continue
                x, y = members[i], members[p]
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out.append((ids[p], comp[i]))
                    parent[other] = own
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    names = ["block", "id", "comp", "n", "sig", "members", "probe", "also"]
    return full.repartition("block").sortWithinPartitions("block").select(*names).mapInArrow(tidy(lambda batches: _by_block(batches, names, links)), "a long, b long").distinct()


def _sets(ids: DataFrame, docs: DataFrame, key: str, text_col: str, words: int) -> DataFrame:
    """doc_id and members (sorted hashes of the shingles, 8 bytes each) of the documents with these ids."""
    ids = written(ids, "ids")
    small = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids) if small else ids.hint("merge"), "doc_id", "left_semi")

    def run(batches):
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for i, j in sub_batches(texts):
                sets = shingle_sets(texts[i:j], words)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "members"])

    return texts.mapInArrow(tidy(run), "doc_id long, members binary").filter(F.octet_length("members") > 0)


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text_col: str, words: int, t: float) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity: size of the intersection >= t * size of the union."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs, key, text_col, words)
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("ma")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("mb")), "b").select("a", "b", "ma", "mb")
    percent = round(100 * t)

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(run), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and comp (smallest id reachable) of every node with an edge (a, b), by alternating large-star and small-star steps;
    the smallest node of a component has no row."""
    with scratch(edges.sparkSession):
        e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
        state = None
        while True:
            both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
            # Written, so that the join below exchanges both its sides and a node with very many edges can be split.
            least = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
            large = both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
            e = written(small.distinct(), "edges")
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
            if now == state:
                return written(e.select(F.col("u").alias("id"), F.col("v").alias("comp")), "components", outer=True)
            state = now


def _regions(reps: DataFrame) -> DataFrame:
    """bucket, id, n, sig and rest (the order within the region) of every node and tree whose region holds another node."""
    slices = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda k: F.struct(k.alias("tree"), F.xxhash64(k, F.substring(F.col("sig"), k * 2 * DEPTH + 1, F.lit(2 * DEPTH))).alias("bucket")))
    rows = reps.select("id", F.explode(slices).alias("x")).select("id", "x.tree", "x.bucket")
    shared = written(rows.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket"), "shared")  # so a large region can be split
    both = rows.join(shared, "bucket").join(reps.select("id", F.col("n_shingles").alias("n"), "sig"), "id")
    return both.withColumn("rest", F.substring(F.concat("sig", "sig"), F.col("tree") * 2 * DEPTH + 1 + 2 * DEPTH, F.lit(6 * DEPTH)))


def _blocks(regions: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the regions with more than one component, dealt out in blocks of at most about BLOCK base and BLOCK probe rows.

    Probes are the nodes outside a region's largest component; each meets every node of the region once.
    """
    rows = regions.select("bucket", "tree", "id", "n", "sig").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    open_ = sizes.groupBy("bucket").agg(F.sum("k").alias("c"), F.max(F.struct("k", "comp")).alias("top")).filter("top.k < c")
    open_ = written(open_.select("bucket", F.col("top.comp").alias("top"), F.ceil(F.col("c") / BLOCK).cast("int").alias("base"), F.ceil((F.col("c") - F.col("top.k")) / BLOCK).cast("int").alias("probes")), "open")
    r = rows.join(open_, "bucket")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    as_base = r.select("bucket", "tree", "top", "id", "comp", "n", "sig", own("base").alias("i"), F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("j"), F.lit(False).alias("probe"))
    as_probe = r.filter("comp != top").select("bucket", "tree", "top", "id", "comp", "n", "sig", F.explode(F.sequence(F.lit(0), F.col("base") - 1)).alias("i"), own("probes").alias("j"), F.lit(True).alias("probe"))
    return as_base.union(as_probe).withColumn("block", F.xxhash64("bucket", "i", "j")).drop("bucket", "i", "j")


def near_groups(docs: DataFrame, key: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept, as a written table.

    The tables made on the way are deleted.
    """
    with scratch(docs.sparkSession), small_batches(docs.sparkSession):
        sk, of = _grouped(docs, key, text_col, words, similarity)
        out = sk.select("doc_id", "n_shingles", "set_id").join(of, "set_id", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return written(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "groups", outer=True)


def _grouped(docs: DataFrame, key: str, text_col: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Sketches of the rows, and the component of every set."""
    sk = written(sketches(docs, key, text_col, words), "sketches")
    linked = sk.filter("doc_id IS NOT NULL AND set_id IS NOT NULL")
    reps = linked.groupBy("set_id").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("r")).select("set_id", F.col("r.doc_id").alias("id"), "r.n_shingles", "r.sig")
    reps = written(reps, "nodes")
    regions = written(_regions(reps), "regions")
    near = written(neighbours(regions, similarity), "neighbours")
    # A document with several texts is one node: its sets are tied together.
    several = linked.select("set_id", F.col("doc_id").alias("b")).distinct().join(reps.select("set_id", F.col("id").alias("a")), "set_id").filter("a != b").select("a", "b")
    several = several.join(linked.groupBy("doc_id").agg(F.count_distinct("set_id").alias("k")).filter("k > 1").select(F.col("doc_id").alias("b")), "b", "left_semi")
    first = components(confirmed(near, docs, key, text_col, words, similarity).union(several.select("a", "b")))
    rest = written(across(_blocks(regions, first), similarity), "suspects")
    comps = first
    if not rest.isEmpty():
        nodes = reps.select("id", F.col("n_shingles").alias("n"), "sig")
        more = searched(rest, first, nodes, docs, key, text_col, words, similarity)
        comps = components(first.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(more))
    return sk, written(reps.join(comps, "id", "left").select("set_id", F.coalesce("comp", "id").alias("component_id")), "components")
