"""Near duplicates: BagMinHash signatures of word-shingle multisets, banding, exact multiset verification.

The features of a text are its word shingles with their counts. A signature register matches with
probability J = sum(min) / sum(max) of the counts (weighted Jaccard), without bias. Defined results:

* null doc_id: not looked at; it is in no group. Null, empty or wordless text: no features, in no group.
* repeated rows (one doc_id, one text) are one document; one doc_id with several texts joins the groups of each to one.
* equal multisets are one group, whatever their number; ties for the one to keep go to the least doc_id.
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .textkeys import U, bags, mix, shingle_hashes, word_hashes

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 40, 4, 0.5
#: Texts hashed at once; bags() keeps 64 - BITS bits of a shingle's hash.
BATCH, BITS = 1024, 10
#: Members that one task compares with a leader's text.
STAR = 256
#: Edges (16 bytes each) up to which one task finds the components; more are contracted and go through distributed rounds first.
LOCAL_EDGES = 4_000_000
_LEFT, _RIGHT, _SIDE, _REGISTER = (mix(np.array([k], U))[0] for k in (11, 12, 13, 14))


def _exponential(seed: np.ndarray) -> np.ndarray:
    return -np.log((seed >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)


def _points(doc: np.ndarray, elem: np.ndarray, weight: np.ndarray, until: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, register, time) of all points up to until[doc], of the processes below each element's weight.

    The weights' axis falls into the blocks [0,1), [1,2), [2,4), [4,8), ..., each with a Poisson process of its
    own; a block longer than 1 yields its first point, then halves, and the point falls into either half. So a
    point depends on the element alone, and an element of a lesser weight has a part of the same points.
    """
    side = 0
    while True:
        size = 1 if side == 0 else 1 << (side - 1)
        low = 0 if side == 0 else size
        own = weight > low
        if not own.any():
            return
        d, w = doc[own], weight[own]
        seed, at, lo = mix(elem[own] ^ mix(np.array([side + 1], U))[0]), np.zeros(len(d)), np.full(len(d), low)
        todo = {size: [(d, w, seed, at, lo)]}
        while todo:
            size = max(todo)
            d, w, seed, at, lo = (np.concatenate(x) for x in zip(*todo.pop(size), strict=True))
            while len(d):
                seed = mix(seed)
                at = at + _exponential(seed) / size
                near = at <= until[d]
                d, w, seed, at, lo = d[near], w[near], seed[near], at[near], lo[near]
                if size == 1:
                    yield d, (mix(seed ^ _REGISTER) % U(m)).astype(np.int64), at
                    continue
                # the point goes down to a unit interval; each half passed by starts a process of its own here
                part = size
                while part > 1 and len(d):
                    part //= 2
                    right = (mix(seed ^ _SIDE) & U(1)) == 1
                    other = np.where(right, lo, lo + part)
                    use = other < w
                    todo.setdefault(part, []).append((d[use], w[use], mix(seed ^ np.where(right, _LEFT, _RIGHT))[use], at[use], other[use]))
                    lo, seed = np.where(right, lo + part, lo), mix(seed ^ np.where(right, _RIGHT, _LEFT))
                    inside = lo < w
                    d, w, seed, at, lo = d[inside], w[inside], seed[inside], at[inside], lo[inside]
                yield d, (mix(seed ^ _REGISTER) % U(m)).astype(np.int64), at
                todo.setdefault(1, []).append((d, w, seed, at, lo))
                break
        side += 1


def signatures(doc: np.ndarray, elem: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m: the least point time of each register, as bits of a double; a text without elements has the greatest integer.

    All points up to a time at which every register is likely to be hit are made; texts that lack one get twice the time.
    """
    out = np.full((n, m), np.inf)
    total = np.bincount(doc, weight, n)
    with np.errstate(divide="ignore"):
        until = m * (np.log(m) + 3) / total
    open_ = total > 0
    while open_.any():
        own = open_[doc]
        for d, register, at in _points(doc[own], elem[own], weight[own], until, m):
            np.minimum.at(out.reshape(-1), d * m + register, at)
        open_ &= np.isinf(out).any(axis=1)
        until = until * 2
    bits = out.view(U).copy()
    bits[total == 0] = U((1 << 64) - 1)
    return bits


def digests(doc: np.ndarray, elem: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each multiset, in any order of its elements."""
    out = []
    with np.errstate(over="ignore"):
        one = mix(elem ^ mix(weight.astype(U)))
        for k in (one, mix(one ^ _SIDE)):
            total = np.zeros(n, U)
            np.add.at(total, doc, k)
            out.append(total.view(np.int64))
    return out[0], out[1]


def _bags(texts: list, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return bags(*shingle_hashes(*word_hashes(texts), shingle), BITS)


def _sign(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), BATCH):
                batch = whole.slice(k, BATCH)
                n = len(batch)
                doc, elem, weight = _bags(batch.column("text").to_pylist(), shingle)
                sig = signatures(doc, elem, weight, n, bands * rows).reshape(n, bands, rows)
                keys = np.zeros((n, bands), U)
                for r in range(rows):
                    keys = mix(keys ^ sig[:, :, r])
                keys = mix(keys ^ np.arange(bands, dtype=U))  # a key holds its band
                some = np.bincount(doc, weight, n) > 0
                lo, hi = digests(doc, elem, weight, n)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lo), pa.array(hi), flat], names=["doc_id", "lo", "hi", "bands"]).filter(pa.array(some))

    return run


def _overlap(shingle: int, threshold: float):
    """Compares a leader's text with its members' by the overlap of their multisets."""

    def run(group: pa.Table) -> pa.Table:
        keep, jaccard = [], []
        leader = group.column("leader")[0].as_py()
        nodes, los, his = (group.column(c).to_numpy() for c in ("node", "lo", "hi"))
        a, parts = None, []
        for k in range(0, len(nodes), BATCH):
            doc, elem, weight = _bags(group.column("text").slice(k, BATCH).to_pylist(), shingle)
            n = min(BATCH, len(nodes) - k)
            lo, hi = digests(doc, elem, weight, n)
            for i in np.flatnonzero((lo == los[k : k + n]) & (hi == his[k : k + n])):  # else another text of that doc_id
                s, e = np.searchsorted(doc, [i, i + 1])
                if nodes[k + i] == leader:
                    a = elem[s:e], weight[s:e]
                else:
                    parts.append((nodes[k + i], elem[s:e], weight[s:e]))
        if a is not None:
            size = a[1].sum()
            for b, elem, weight in parts:
                at = np.minimum(np.searchsorted(a[0], elem), len(a[0]) - 1)
                both = np.minimum(a[1][at], weight)[a[0][at] == elem].sum()
                j = float(both) / float(size + weight.sum() - both)
                if j >= threshold:
                    keep.append(b), jaccard.append(j)
        return pa.table({"a": pa.array([leader] * len(keep), pa.int64()), "b": pa.array(keep, pa.int64()), "jaccard": pa.array(jaccard, pa.float64())})

    return run


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs (a, b) of nodes that reach the threshold; each text travels to its leaders once for STAR members."""
    large = pairs.groupBy("a").count().filter(F.col("count") > STAR).select("a", F.ceil(F.col("count") / STAR).alias("parts"))
    members = pairs.join(large, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    ends = members.select(F.col("a").alias("leader"), "part", F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string")).filter("rep is not null and text is not null")
    return (
        ends.join(classes.select("node", "rep", "lo", "hi"), "node")
        .join(texts, "rep")
        .groupBy("leader", "part")
        .applyInArrow(_overlap(shingle, threshold), "a long, b long, jaccard double")
        .distinct()
    )


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) of the edges (u, v)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[x], root[y]
        open_ = a != b
        if not open_.any():
            return nodes, nodes[root]
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around the least node of each of their components."""
    u, v, held = [], [], 0

    def star() -> tuple[np.ndarray, np.ndarray]:
        nodes, root = roots(np.concatenate(u), np.concatenate(v))
        return nodes[nodes != root], root[nodes != root]

    for batch in batches:
        u.append(batch.column(0).to_numpy()), v.append(batch.column(1).to_numpy())
        held += len(batch)
        if held > LOCAL_EDGES:
            u, v = ([x] for x in star())
            if len(u[0]) > LOCAL_EDGES // 2:  # a forest that doesn't get smaller
                yield pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(v[0])], names=["u", "v"])
                u, v = [], []
            held = sum(map(len, u))
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in star()], names=["u", "v"])


def components(scratch: Scratch, edges: DataFrame, *, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, root): root is the least node of the component. Edges are contracted within partitions; while more than local are left, large-star and small-star steps alternate until nothing changes."""
    now = scratch.keep(edges.select("a", "b").filter("a <> b").mapInArrow(_contract, "u long, v long"), "star")
    last = None
    while True:
        size = now.count()
        if size <= local:
            return scratch.keep(now.coalesce(1).mapInArrow(_contract, "u long, v long").toDF("node", "root"), "roots")
        mark = tuple(now.select(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0))).first())
        if mark == last:
            return now.toDF("node", "root")
        last = mark
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        now = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = now.join(now.groupBy("u").agg(F.min("v").alias("m")), "u")
        now = lower.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = scratch.keep(now, "star")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, *, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, local: int = LOCAL_EDGES, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, keeper): each document that has a near duplicate of a lesser doc_id in its group, and the least doc_id of the group.

    Equal multisets are one node. Groups are the connected components of the nodes that share a band and reach the threshold,
    or a doc_id. Within a bucket first all members are verified against the least one; then every pair still in different
    groups is, so that no pair that could join two groups is left out, while pairs inside a group that is already joined cost nothing.
    """
    scratch = scratch or Scratch(spark)
    signed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null").mapInArrow(_sign(shingle, bands, rows), "doc_id long, lo long, hi long, bands array<long>")
    signed = scratch.keep(signed, "signed")
    classes = signed.groupBy("lo", "hi").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).select(F.monotonically_increasing_id().alias("node"), "lo", "hi", "rep", "size")
    classes = scratch.keep(classes, "classes")
    # the bands come from the row of the representative; one doc_id may have several rows of a class
    named = signed.join(classes.select("node", "lo", "hi", F.col("rep").alias("doc_id")), ["lo", "hi", "doc_id"])
    bucket = scratch.keep(named.select("node", F.explode("bands").alias("bucket")), "rows")
    shared = bucket.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("bucket", "least")
    bucket = scratch.keep(bucket.join(shared, "bucket"), "bucket")
    stars = scratch.keep(bucket.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    edges = scratch.keep(verified(docs, classes, stars, shingle, threshold).select("a", "b"), "edges")
    # nodes of a doc_id that has several texts; a class of one row takes part in this too
    members = signed.select("doc_id", "lo", "hi").join(classes.select("node", "lo", "hi", "rep"), ["lo", "hi"]).select("doc_id", "node")
    members = scratch.keep(members, "members")
    several = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a < most").select("doc_id", "a")
    same = scratch.keep(members.join(several, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b"), "same")
    edges = edges.union(same)
    groups = components(scratch, edges, local=local)
    rooted = bucket.join(groups, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("bucket")
    mixed = scratch.keep(rooted.join(open_, "bucket").distinct(), "mixed")
    x, y = mixed.alias("x"), mixed.alias("y")
    rest = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")))
    rest = rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    rest = scratch.keep(verified(docs, classes, scratch.keep(rest, "pairs"), shingle, threshold).select("a", "b"), "edges")
    final = components(scratch, edges.union(rest), local=local)
    placed = members.join(final, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    keeper = placed.groupBy("root").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("most")).filter("keeper < most").select("root", "keeper")
    result = scratch.keep(placed.join(keeper, "root").filter("doc_id <> keeper").select("doc_id", "keeper").distinct(), "near")
    scratch.drop("signed", "classes", "rows", "bucket", "pairs", "edges", "members", "same", "mixed", "star", "roots")
    return result


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The documents without those that near_duplicates() would drop; of rows that repeat a doc_id the one of the least text stays.

    Rows with a null doc_id all stay.
    """
    gone = near_duplicates(spark, docs, **options).select("doc_id")
    known = docs.filter("doc_id is not null").join(gone, "doc_id", "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *[F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")]))
    known = known.withColumn("__first", first).filter("__first = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
    return known.unionByName(docs.filter("doc_id is null"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))
