"""Near duplicates by an LSH forest: sorted signature orders with neighbours as candidates.

Every distinct shingle set gets TREES independent signatures of DEPTH min-hashes.  Each tree is a
sorted order of its signatures.  Rows next to each other in an order share their longest common
prefix, so each row's candidates are its REACH successors, as long as they share LEAST_DEPTH
hashes.  In sparse regions that is every row with the same short prefix; in crowded regions the
neighbours are those that agree deepest, so depth adapts to the region and candidates stay
linear.  Candidates are compared by all their min-hashes, then confirmed on full sets, best pairs
first and then whatever still joins two components, and links become components by star contraction.
Runs of one short prefix that are longer than REACH reaches (crowds) and still hold more than one
component are then compared on full sets, every row with every row of another component: blocks of
rows meet in pairs, each pair of blocks in one task, and blocks of one component are not compared with
each other.  Exact copies are one class from the start.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, partitions, table

TREES, DEPTH, LEAST_DEPTH, REACH = 20, 5, 3, 4
#: A pair is confirmed on full sets if at least this share of its min-hashes agrees; for a
#: similarity of 0.8 over 100 hashes this is 5 standard deviations below the mean.
LEAST_AGREEMENT = 0.6
#: Rows of a crowd in a block, about; columns of a block's incidence matrix at a time.
CROWD_BLOCK, CROWD_COLUMNS = 512, 4096
#: Trees whose crowds are compared in one round: what early ones join, later ones need not compare.
ROUNDS = ((0, 1), (1, TREES))
CACHE_ENTRIES = 400_000
#: Links that one task joins.
FEW_LINKS = 1_000_000
PREFIX = 1 + 4 * LEAST_DEPTH

_random = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = _random.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_WEIGHTS = _random.integers(0, 1 << 63, 16, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


class _Words(dict):
    limit = CACHE_ENTRIES

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


@functools.lru_cache(1)
def _words() -> _Words:
    """Hashes of the words that a Python worker has met."""
    return _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: dict, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles.  Fewer words than width: the whole sequence is one; none: empty."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    n = min(width, len(h))
    out = h[: len(h) - n + 1] * _WEIGHTS[0]
    for k in range(1, n):
        out = out + _mix(h[k : len(h) - n + 1 + k]) * _WEIGHTS[k]
    out = np.sort(_mix(out + np.uint64(n)))
    return out if len(out) < 2 else out[np.concatenate(([True], out[1:] != out[:-1]))]


def signature(s: np.ndarray) -> bytes:
    """TREES * DEPTH min-hashes of 32 bits, big-endian so that bytes sort as numbers."""
    out = np.full(len(_MULTIPLY), np.uint64((1 << 64) - 1))
    for lo in range(0, len(s), 512):
        x = s[lo : lo + 512, None] * _MULTIPLY[None, :]
        np.minimum(out, (x ^ (x >> np.uint64(32))).min(axis=0), out=out)
    return (_mix(out) >> np.uint64(32)).astype(">u4").tobytes()


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, key (null for an empty set) and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words = _words()
        for batch in batches:
            n, keys, sigs = [], [], []
            for x in batch.column(1).to_pylist():
                s = shingles(x, words, width)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "key", "signature"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id bigint, n_shingles bigint, key binary, signature binary")


def _neighbours(path: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids at most REACH apart in the order that share the prefix."""
    out = []
    for d in range(1, REACH + 1):
        same = (path[:-d, :PREFIX] == path[d:, :PREFIX]).all(axis=1) if len(ids) > d else np.empty(0, bool)
        a, b = ids[: len(same)][same], ids[d : d + len(same)][same]
        out.append((np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]))
    return out


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs among the sorted rows of a task; edge rows (the first and last REACH) for the seams."""
    names, width = ["a", "b", "path"], 1 + 4 * DEPTH
    path, ids, head = np.empty((0, width), np.uint8), np.empty(0, np.int64), 0

    def edge(p: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(i, pa.int64()), pa.nulls(len(i), pa.int64()), pa.array([x.tobytes() for x in p], pa.binary())], names)

    for batch in batches:
        raw = batch.column(0)
        new = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, width)
        if head < REACH and len(new):
            yield edge(new[: REACH - head], batch.column(1).to_numpy()[: REACH - head])
            head += min(len(new), REACH - head)
        path, ids = np.concatenate([path, new]), np.concatenate([ids, batch.column(1).to_numpy()])
        for a, b in _neighbours(path, ids):
            yield pa.record_batch([pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary())], names)
        path, ids = path[-REACH:], ids[-REACH:]
    if len(ids):
        yield edge(path, ids)


def candidates(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes (rep, signature) that are neighbours in some order."""
    width = 4 * DEPTH
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    paths = classes.select("rep", "signature", tree).select(F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(signature, tree * {width} + 1, {width})")).alias("path"), "rep")
    n = partitions(classes.sparkSession)
    ordered = paths.repartitionByRange(n, "path", "rep").sortWithinPartitions("path", "rep")
    found = scratch.save("neighbours", ordered.mapInArrow(_in_order, "a bigint, b bigint, path binary"))
    # Rows at the seams between tasks: a fixed number for each task, so one task can hold them all.
    seams = found.where("path is not null").select("path", F.col("a").alias("rep")).distinct().coalesce(1).sortWithinPartitions("path", "rep")
    across = seams.mapInArrow(_in_order, "a bigint, b bigint, path binary")
    return found.where("path is null").unionByName(across.where("path is null")).select("a", "b").distinct()


def _agreement(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u4").reshape(-1, TREES * DEPTH) for k in (2, 3))
            share = (x == y).mean(axis=1)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(share)], ["a", "b", "share"]).filter(pa.array(share >= LEAST_AGREEMENT))

    return pairs.mapInArrow(run, "a bigint, b bigint, share double")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def crowds(classes: DataFrame) -> DataFrame:
    """tree, bucket (tree and short prefix) and rep of the rows in runs that REACH does not cover."""
    width = 4 * DEPTH
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    bucket = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(signature, tree * {width} + 1, {PREFIX - 1})")).alias("bucket")
    rows = classes.select("rep", "signature", tree).select("tree", bucket, "rep")
    large = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > REACH + 1).select("bucket")
    return rows.join(large.hint("merge"), "bucket").select("tree", "bucket", "rep")


def _meetings(members: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """meeting (id of a pair of blocks), side, rep and root of crowd members (bucket, rep, root).

    A component of CROWD_BLOCK rows or more in a bucket has blocks of its own; the others share
    blocks.  Every two blocks of a bucket meet, and each shared block meets itself; blocks of the same
    component do not.
    """
    own = members.groupBy("bucket", "root").agg(F.count("*").alias("n")).withColumn("shared", F.col("n") < CROWD_BLOCK)
    own = scratch.save(f"{tag}-own", own.withColumn("part", F.when(F.col("shared"), 0).otherwise(F.col("root"))))
    sizes = own.groupBy("bucket", "shared", "part").agg(F.ceil(F.sum("n") / CROWD_BLOCK).cast("int").alias("blocks"), F.count("*").alias("roots"))
    sizes = scratch.save(f"{tag}-sizes", sizes)
    each = sizes.select("bucket", "shared", "part", "roots", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    x, y = (each.select("bucket", F.struct("shared", "part", "k").alias(s), F.col("roots").alias(f"roots_{s}")) for s in "xy")
    one = (F.col("x.shared") == F.col("y.shared")) & (F.col("x.part") == F.col("y.part"))
    met = x.join(y, "bucket").where((F.col("x") <= F.col("y")) & (~one | (F.col("x.shared") & (F.col("roots_x") > 1))))
    here, there, itself = (F.struct(F.lit(n).alias("side"), F.col(s).alias("block")) for n, s in ((0, "x"), (1, "y"), (2, "x")))
    sides = F.when(F.col("x") == F.col("y"), F.array(itself)).otherwise(F.array(here, there))
    places = met.select("bucket", F.xxhash64("bucket", "x", "y").alias("meeting"), F.explode(sides).alias("s")).select("bucket", "meeting", "s.side", "s.block.*")
    placed = members.join(own.select("bucket", "root", "shared", "part").hint("merge"), ["bucket", "root"]).join(sizes.drop("roots").hint("merge"), ["bucket", "shared", "part"])
    placed = placed.withColumn("k", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    return placed.join(places.hint("merge"), ["bucket", "shared", "part", "k"]).select("meeting", "side", "rep", "root")


def _forest(ids: np.ndarray, roots: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join what the similar pairs of other sides (side 2: of the block itself) and other roots join."""
    n, sizes = len(ids), np.array([len(s) for s in sets])
    x, y = (np.flatnonzero(sides != other) for other in (1, 0))
    if not len(x) or not len(y):
        return []
    token, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.where(shared, np.cumsum(shared) - 1, -1)[column]
    row = np.repeat(np.arange(n), sizes)
    row, place = row[place >= 0], place[place >= 0]
    by = np.argsort(place, kind="stable")
    row, place = row[by], place[by]
    both = np.zeros((len(x), len(y)), np.float64)
    for lo in range(0, int(shared.sum()), CROWD_COLUMNS):
        a, b = np.searchsorted(place, (lo, lo + CROWD_COLUMNS))
        held = np.zeros((n, CROWD_COLUMNS), np.float32)
        held[row[a:b], place[a:b] - lo] = 1
        both += held[x] @ held[y].T
    near = np.zeros((n, n), bool)
    near[np.ix_(x, y)] = (100 * both >= percent * (sizes[x][:, None] + sizes[y][None, :] - both)) & (roots[x][:, None] != roots[y][None, :])
    near |= near.T
    out, new = [], np.ones(n, bool)
    for start in np.flatnonzero(near.any(axis=1)):
        todo = [start] if new[start] else []
        new[start] = False
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(near[i] & new):
                new[j] = False
                out.append((int(ids[i]), int(ids[j])))
                todo.append(j)
    return out


def _crowd_links(meetings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in meetings (meeting, side, rep, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def links() -> pa.RecordBatch:
            ids, roots, sides = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 1))
            found = _forest(ids, roots, sides, [np.frombuffer(r[4], np.uint64) for r in rows], percent)
            return pa.record_batch([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][0] != r[0]:
                    yield links()
                    rows.clear()
                rows.append(r)
        if rows:
            yield links()

    dealt = meetings.join(sets.hint("merge"), "rep").select("meeting", "side", "rep", "root", "shingles")
    dealt = dealt.repartition(partitions(meetings.sparkSession), "meeting").sortWithinPartitions("meeting")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root of all links of a task: the larger root is hung below the smaller until none is left to hang."""
    ends = [np.empty((2, 0), np.int64), *(np.stack([c.to_numpy() for c in batch.columns]) for batch in batches)]
    nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.record_batch([pa.array(nodes[below]), pa.array(nodes[root[below]])], ["node", "root"])


def components(links: DataFrame, scratch: Scratch, tag: str, few: int = FEW_LINKS) -> DataFrame:
    """node, root for every node of links (a, b) that is not its own root: root is the smallest node reachable.

    Up to `few` links (16 bytes each) are joined in one task, which a shuffle for every step would only delay.
    More go through large-star and small-star contraction: each round points every node at the smallest
    neighbour; the number of rounds is logarithmic.  Only counts reach the driver.
    """
    if links.count() <= few:
        return scratch.save(f"{tag}-joined", links.select("a", "b").coalesce(1).mapInArrow(_joined, "node bigint, root bigint"))
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    seen, k = None, 0
    edges = scratch.save(f"{tag}-0", edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(f"{tag}-{k}l", large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        small = small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        k += 1
        new = scratch.save(f"{tag}-{k}", small)
        scratch.drop(f"{tag}-{k - 1}", f"{tag}-{k - 1}l")
        edges = new
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Sets hold the distinct shingles of `width` words, A-Z lower-cased.  Documents are linked if
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable.  Null
    and empty texts have no shingles and are linked with nothing.  Rows with the same doc_id and
    text are one node; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    own = scratch.save("own", _sets(docs, width))
    classes = scratch.save("classes", own.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")))
    keys = scratch.save("keys", own.select("doc_id", "n_shingles", "key"))
    scratch.drop("own")
    pairs = candidates(classes, scratch)
    sig = classes.select("rep", "signature")
    close = pairs.join(sig.select(F.col("rep").alias("a"), F.col("signature").alias("x")).hint("merge"), "a").join(sig.select(F.col("rep").alias("b"), F.col("signature").alias("y")).hint("merge"), "b")
    close = scratch.save("close", _agreement(close.select("a", "b", "x", "y")))
    reps = scratch.save("reps", classes.select("key", "rep"))
    crowded = scratch.save("crowded", crowds(classes))
    scratch.drop("neighbours", "classes")

    needed = close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = scratch.save("sets", _full_sets(_texts(docs, needed), width))

    left, roots = close, None
    for step in ("best", "next", "rest"):
        if step != "rest":
            ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "share"))
            best = ends.groupBy("a").agg(F.max_by("b", F.struct("share", -F.col("b"))).alias("b"))
            tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            tried = left
        tried = scratch.save(f"tried-{step}", tried.select("a", "b"))
        found = _confirmed(tried, sets, percent)
        found = scratch.save(f"links-{step}", found)
        roots = components(found if roots is None else found.union(roots), scratch, step)
        if step == "rest":
            break
        a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        left = left.join(tried, ["a", "b"], "left_anti").join(a, "a", "left").join(b, "b", "left")
        left = left.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b", "share")
        left = scratch.save(f"left-{step}", left)
        if left.isEmpty():
            break
    scratch.drop("sets", "close")
    sets = None
    for lo, hi in ROUNDS:
        members = crowded.where(F.col("tree").between(lo, hi - 1)).join(roots.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
        several = members.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
        members = scratch.save(f"members-{lo}", members.join(several.hint("merge"), "bucket").select("bucket", "rep", "root"))
        if members.isEmpty():
            continue
        if sets is None:
            # Later rounds may need other rows of the crowds.
            sets = scratch.save("crowd-sets", _full_sets(_texts(docs, crowded.select(F.col("rep").alias("doc_id")).distinct()), width))
        found = scratch.save(f"crowd-links-{lo}", _crowd_links(_meetings(members, scratch, f"crowd-{lo}"), sets, percent).distinct())
        if not found.isEmpty():
            roots = components(found.union(roots), scratch, f"crowd-{lo}")
    scratch.drop("crowded", "crowd-sets")
    by_key = scratch.save("by_key", reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("root", "rep").alias("root")))
    out = keys.join(by_key, "key", "left")
    root = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", root.alias("component_id"), (root == F.col("doc_id")).alias("kept"))


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """One row for each needed doc_id."""
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]).join(needed.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _full_sets(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words()
        for batch in batches:
            out = [shingles(x, words, width).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["rep", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(run, "rep bigint, shingles binary")


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
