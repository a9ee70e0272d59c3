"""SimHash fingerprints, and all pairs of them within a Hamming radius by permuted block tables.

Every occurrence of a shingle votes for the 64 bits of its hash, so a term's weight is its count. For the
radius r the bits are cut into r + FREE blocks; two fingerprints within r differ in at most r blocks, so they
agree on FREE at least, and one of the C(r + FREE, FREE) tables, each keyed by FREE blocks, brings them together: none
is missed. Within a key all pairs are compared in numpy.

The pairs grow with the square of the corpus, so the query returns a row for each document: its class, which are the
documents of one fingerprint, and its links, which are all other fingerprints within the radius. within_radius() has the pairs.

The radius is chosen by the distances of near copies, which are pairs whose multisets of 3-word shingles overlap by 0.5
or more: on sf0.01 it has 94 of the 99 that are not equal (3 bits had 6), and no other pair.

* null doc_id, and null, empty or wordless texts: no fingerprint.
* a bit whose votes tie is 0. Repeated rows count once; one doc_id with several texts has several fingerprints.
* equal fingerprints, however many, are one entry of the tables: each of their documents is paired with the least doc_id.
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .textkeys import U, shingle_hashes, word_hashes

SHINGLE, RADIUS, FREE = 2, 12, 2
BATCH = 1024
#: Pairs that are compared at once.
TILE = 1 << 21
#: Bits of a key that number its table.
TABLE_BITS = 16
#: Terms added up before a 16-bit lane could overflow.
RUN = 1 << 15
#: The 4 bits of a number in 16-bit lanes.
_LANES = np.array([sum(((x >> b) & 1) << (16 * b) for b in range(4)) for x in range(16)], U)


def fingerprints(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have terms, their fingerprints)."""
    some = np.flatnonzero(np.diff(offsets))
    if not len(some):
        return some, np.zeros(0, U)
    cuts = np.union1d(offsets[some], np.arange(0, len(hashes), RUN))
    owner = np.searchsorted(offsets[some], cuts, "right") - 1
    votes = np.zeros((len(some), 64), np.int64)
    for lane in range(16):
        sums = np.add.reduceat(_LANES[(hashes >> U(4 * lane)) & U(15)], cuts)
        for b in range(4):
            np.add.at(votes[:, 4 * lane + b], owner, ((sums >> U(16 * b)) & U(0xFFFF)).astype(np.int64))
    bits = 2 * votes > np.diff(offsets)[some][:, None]
    return some, np.packbits(bits, axis=1, bitorder="little").view(U).reshape(-1)


def _fingerprint(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), BATCH):
                batch = whole.slice(k, BATCH)
                some, fp = fingerprints(*shingle_hashes(*word_hashes(batch.column("text").to_pylist()), shingle))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), pa.array(fp.view(np.int64))], names=["doc_id", "fingerprint"])

    return run


def simhash(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null").mapInArrow(_fingerprint(shingle), "doc_id long, fingerprint long")


def masks(radius: int) -> list[int]:
    """The bits that each table's key keeps, as signed integers."""
    n = radius + FREE
    ends = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:], strict=False)]
    return [x - (1 << 64) if x >> 63 else x for x in (sum(c) for c in combinations(blocks, FREE))]


def _close(doc: np.ndarray, fp: np.ndarray, table: int, keep: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_a, doc_b, distance) of the pairs of one key that are within the radius and that no earlier table has."""
    step = max(1, TILE // len(doc))
    for k in range(0, len(doc), step):
        differ = fp[k : k + step, None] ^ fp[None, k + 1 :]
        x, y = np.nonzero(np.bitwise_count(differ) <= radius)
        x, y = x[y >= x], y[y >= x]
        d = differ[x, y]
        mine = (d & keep[table]) == 0
        for m in keep[:table]:
            mine &= (d & m) != 0
        a, b = doc[k + x[mine]], doc[k + 1 + y[mine]]
        yield np.minimum(a, b), np.maximum(a, b), np.bitwise_count(d[mine]).astype(np.int32)


def _by_key(columns: list[str], rows):
    """Gives rows() the columns of whole keys; the first is the key, by which the rows come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[list[np.ndarray]] = []  # rows of the key that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in columns]
            last = int(np.searchsorted(new[0], new[0][-1]))
            if last or (open_ and open_[0][0][0] != new[0][0]):
                yield from rows(*[np.concatenate(c) for c in zip(*open_, [x[:last] for x in new], strict=True)])
                open_ = []
            open_.append([x[last:] for x in new])
        if open_:
            yield from rows(*[np.concatenate(c) for c in zip(*open_, strict=True)])

    return run


def _keys(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, table) of each key of several rows."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    many = np.flatnonzero(np.diff(edge) > 1)
    for start, end in zip(edge[many].tolist(), edge[many + 1].tolist(), strict=True):
        yield start, end, int(key[start]) & ((1 << TABLE_BITS) - 1)


def _compare(radius: int):
    keep = np.array(masks(radius), np.int64).view(U)

    def rows(key: np.ndarray, doc: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start, end, table in _keys(key):
            for a, b, d in _close(doc[start:end], fp[start:end].view(U), table, keep, radius):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["doc_a", "doc_b", "distance"])

    return _by_key(["key", "doc_id", "fingerprint"], rows)


def _count(radius: int):
    """(fingerprint, links) of the keys that a task has: what their pairs add to each fingerprint."""
    keep = np.array(masks(radius), np.int64).view(U)

    def rows(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        links = np.zeros(len(key), np.int64)
        for start, end, table in _keys(key):
            for a, b, _ in _close(np.arange(end - start), fp[start:end].view(U), table, keep, radius):
                links[start:end] += np.bincount(np.concatenate([a, b]), minlength=end - start)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array(links[some])], names=["fingerprint", "links"])

    return _by_key(["key", "fingerprint"], rows)


def _entries(prints: DataFrame, radius: int) -> DataFrame:
    """The columns of prints with the key of each table; a key's rows come together."""
    keys = F.array(*[F.shiftleft(F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(m))), TABLE_BITS).bitwiseOR(F.lit(i).cast("long")) for i, m in enumerate(masks(radius))])
    return prints.select(F.explode(keys).alias("key"), *prints.columns).repartition("key").sortWithinPartitions("key")


def _ranked(docs: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """(doc_id, fingerprint, rep): rep is the least doc_id of the fingerprint."""
    return scratch.keep(simhash(docs, shingle=shingle).distinct().withColumn("rep", F.min("doc_id").over(Window.partitionBy("fingerprint"))), "ranked")


def linked(spark: SparkSession, docs: DataFrame, *, radius: int = RADIUS, shingle: int = SHINGLE, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, fingerprint, class_id, links) of every document that has a fingerprint: the least doc_id with that fingerprint, and how many other fingerprints are within the radius.

    One doc_id with several fingerprints has a row for each; a class is told by its fingerprint, as a doc_id may be the least of several.
    """
    ranked = _ranked(docs, shingle, scratch or Scratch(spark))
    entry = _entries(ranked.filter("doc_id = rep").select("fingerprint"), radius)
    links = entry.mapInArrow(_count(radius), "fingerprint long, links long").groupBy("fingerprint").agg(F.sum("links").alias("links"))
    return ranked.join(links, "fingerprint", "left").select("doc_id", "fingerprint", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def within_radius(spark: SparkSession, docs: DataFrame, *, radius: int = RADIUS, shingle: int = SHINGLE, scratch: Scratch | None = None) -> DataFrame:
    """(doc_a, doc_b, distance): every document with its fingerprint's least doc_id (distance 0), and all pairs of those within the radius."""
    ranked = _ranked(docs, shingle, scratch or Scratch(spark))
    entry = _entries(ranked.filter("doc_id = rep").select("doc_id", "fingerprint"), radius)
    pairs = entry.mapInArrow(_compare(radius), "doc_a long, doc_b long, distance int").filter("doc_a <> doc_b")  # one doc_id may have several fingerprints
    same = ranked.filter("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(0).cast("int").alias("distance"))
    return pairs.union(same)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, table(spark, sf_dir, "documents"))
