"""Packing of documents into windows by lexical retrieval: a sharded BM25 index returns a seed's unused neighbours.

The seeds are the documents whose doc_id is divisible by EVERY. Their queries (every distinct term of the text) go in
blocks of a bounded size to all shards of an inverted index over the whole corpus, and the DEPTH best neighbours of
all shards come back: exact BM25, no candidate is left out before it is scored. The documents are searched in parts, each
STEP times as large as all before it; the DEPTH-th best score of a seed so far bounds the score of what the next part has to
send for it, so a seed gets some STEP * DEPTH rows from a part, in however many tasks it is searched. Rows equal in doc_id
and text are scored once, as queries and within a batch as documents. A document is offered to the seed
that scores it highest, and a seed takes its offers in order of score while they fit; what is refused goes to the next
seed that has it in its list, until nothing moves. What the seeds don't take is packed within topical shards of about SHARD
documents, each with an index of its own: first the seeds' windows are filled up, then the longest unused document is
the seed of the next window and its neighbours by BM25 (exact within the shard) fill it, those that do not fit being
passed over. A shard follows from a consistent sample of the terms weighted by idf; one that grows too large is split
by a second sample, and only documents equal in both by hash. Tokens are the words of textkeys.

Document frequencies and the average length are counted over the whole corpus. The seeds' are by 32-bit term; within
shards terms share 2**20 counters, so what is broadcast does not grow.

* a text longer than the window fills whole windows by itself; what is left of it is packed like a document.
* null, empty or wordless texts have no tokens, hence no row. Null doc_id: packed, with a null doc_id in the result; it is no seed.
* repeated rows are packed each, but a window never holds two pieces equal in doc_id and text. Ties in length or score
  go to the smaller doc_id, then to the row's digest. Scores are rounded to three decimals.
* a window has neighbours of a score above 0 only. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .textkeys import U, bags, mix, word_hashes

WINDOW, SHARD, K1, B = 2048, 512, 1.2, 0.75
#: A search's queries are the documents of every so many ids; so many neighbours come back for each.
EVERY, DEPTH = 50, 32
#: Most queries and most of their terms in a block, which is broadcast; scores that a task holds at once.
QUERIES, POSTINGS, CELLS = 8192, 1 << 22, 1 << 20
#: Documents of the first part of a search at most, and of a task of it; how much larger each further part is than all before it.
FIRST, FIRST_TASK, STEP = 1 << 14, 2048, 16
#: Postings (12 bytes each) that a task of the search holds until it scores the candidates in double precision.
KEPT = 1 << 22
#: What rounding to three decimals, and sums of float32 in another order, may change of a score: absolute, and as a share of it.
SLACK = 1e-3, 2e-6
#: Terms in this share of a group are scored by a matrix product, the others through posting lists; groups of queries.
COMMON, GROUPS = 1 / 20, 8
BATCH, BITS = 1024, 10
COUNTERS = 1 << 20
#: Split shards (some 40 bytes each) up to which their list is broadcast; beyond, it is joined by shuffle.
BROADCAST_SHARDS = 100_000
BAGS = "row long, doc_id long, ident long, n_tokens long, digest long, terms binary, counts binary"
TERMS = "row long, doc_id long, ident long, n_tokens long, key long, second long, digest long, terms binary, counts binary"
HITS = "seed long, row long, doc_id long, ident long, n_tokens long, score double"
PIECES = "window string, slot int, doc_id long, start long, n_tokens long, score double, digest long"


def _terms(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, text, 32-bit term, count)."""
    offsets, hashes = word_hashes(texts)
    doc, term, count = bags(offsets, (hashes >> U(32)) << U(32), BITS)
    return np.diff(offsets), doc, (term >> U(32 - BITS)).astype(np.uint32), count


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, x in it) of a stable sort of 32-bit x; sorting 64-bit keys is several times faster than a stable argsort."""
    keys = np.sort((x.astype(U) << U(32)) | np.arange(len(x), dtype=U))
    return (keys & U((1 << 32) - 1)).astype(np.int64), (keys >> U(32)).astype(np.uint32)


def _summed(term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, term = _sorted(term)
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    return term[first], np.add.reduceat(count[order], first) if len(first) else count


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, terms, df) of a partition: a row for each part of the terms, by their first 8 bits; part -1 has its documents and words as df."""
    term, df, fresh, docs, length = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0, 0
    for whole in batches:
        docs, length = docs + len(whole), length + int(whole.column("n_tokens").to_numpy().sum())
        fresh.append(np.frombuffer(b"".join(whole.column("terms").to_pylist()), np.uint32))
        if sum(map(len, fresh)) > 1 << 21:
            term, df = _summed(np.concatenate([term, *fresh]), np.concatenate([df, np.ones(sum(map(len, fresh)), np.int64)]))
            fresh = []
    term, df = _summed(np.concatenate([term, *fresh]), np.concatenate([df, np.ones(sum(map(len, fresh)), np.int64)]))
    if docs:
        cuts = np.searchsorted(term, np.arange(257, dtype=np.int64) << 24)
        cuts = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]
        terms, dfs = ([x[a:b].tobytes() for _, a, b in cuts] for x in (term, df))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *(k for k, _, _ in cuts)], pa.int32()), pa.array([b"", *terms], pa.binary()), pa.array([np.array([docs, length], np.int64).tobytes(), *dfs], pa.binary())], names=["part", "terms", "df"])


def _merge_counts(group: pa.Table) -> pa.Table:
    """(term, df) of a part; terms -1 and -2 have the documents and words, term -3 - c the sum of counter c."""
    df = np.frombuffer(b"".join(group.column("df").to_pylist()), np.int64)
    if group.column("part")[0].as_py() < 0:
        term, df = np.array([-1, -2]), df.reshape(-1, 2).sum(axis=0)
    else:
        term, df = _summed(np.frombuffer(b"".join(group.column("terms").to_pylist()), np.uint32), df)
        first = np.flatnonzero(np.concatenate([[True], term[1:] >> 12 != term[:-1] >> 12]))
        term = term.astype(np.int64)
        term, df = np.concatenate([-3 - (term[first] >> 12), term]), np.concatenate([np.add.reduceat(df, first), df])
    return pa.table({"term": term, "df": df})


def corpus_statistics(docs: DataFrame, scratch: Scratch) -> tuple[int, float, np.ndarray, DataFrame]:
    """(documents, average length, document frequency by counter, (term, df)) of texts, or of their BAGS: the counters are of a size that does not depend on the corpus."""
    if "terms" not in docs.columns:
        docs = docs.select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(_bags, BAGS)
    counts = docs.select("n_tokens", "terms").mapInArrow(_count_terms, "part int, terms binary, df binary")
    counts = scratch.keep(counts.groupBy("part").applyInArrow(_merge_counts, "term long, df long"), "df")
    of = {r.term: r.df for r in counts.filter("term in (-1, -2)").collect()}
    n, df = of.get(-1, 0), np.zeros(COUNTERS, np.int64)
    sums = counts.filter("term < -2").toArrow()  # COUNTERS rows at most
    df[-3 - sums.column("term").to_numpy()] = sums.column("df").to_numpy()
    return n, of.get(-2, 0) / max(n, 1), df, counts.filter("term >= 0")


def _idf(n: int, df: np.ndarray) -> np.ndarray:
    df = np.minimum(df, n)
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


def idf(n: int, df: np.ndarray) -> np.ndarray:
    return _idf(n, df).astype(np.float32)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of BAGS for each document with tokens."""
    for whole in batches:
        for k in range(0, len(whole), BATCH):
            batch = whole.slice(k, BATCH)
            n, doc, term, count = _terms(batch.column("text").to_pylist())
            some = np.flatnonzero(n)
            if not len(some):
                continue
            start = np.searchsorted(doc, some)
            end = np.append(start[1:], len(doc))
            with np.errstate(over="ignore"):
                digest = np.add.reduceat(mix(mix(term.astype(U)) ^ mix(count.astype(U))), start)
            ids = batch.column("doc_id").take(pa.array(some))
            ident = mix(digest ^ mix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(U))).view(np.int64)
            terms, counts = term.tobytes(), count.astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(some)), ids, pa.array(ident), pa.array(n[some]), pa.array(digest.view(np.int64))]
                + [pa.array([x[4 * a : 4 * b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary()) for x in (terms, counts)],
                names=["row", "doc_id", "ident", "n_tokens", "digest", "terms", "counts"],
            )


def _keys(weights):
    """Bags with key and second. key: the term with the least Exp(idf) of its hash, so a pair meets by the idf-weighted overlap of its terms; second: another such sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for whole in batches:
            for k in range(0, len(whole), BATCH):
                batch = whole.slice(k, BATCH)
                raw = batch.column("terms").to_pylist()
                term, size = np.frombuffer(b"".join(raw), np.uint32), np.array([len(t) // 4 for t in raw], np.int64)
                start = np.cumsum(size) - size
                h, own = mix(term.astype(U)), w[term >> 12]
                keys = []
                for g in (h, mix(h)):
                    rank = -np.log((g >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / own
                    at = np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, start), size))
                    keys.append(mix(h[at[np.searchsorted(at, start)]]).view(np.int64))  # the first of equal ones
                names = [c for c in batch.schema.names if c != "terms" or "counts" in batch.schema.names]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, keys)], names=[*names, "key", "second"])

    return run


def _index(weights):
    """A row of TERMS for each document with tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _keys(weights)(_bags(batches)):
            yield batch.select(["row", "doc_id", "ident", "n_tokens", "key", "second", "digest", "terms", "counts"])

    return run


def _flat(terms: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of binary term lists."""
    size = np.array([len(t) // 4 for t in terms], np.int64)
    return np.repeat(np.arange(len(terms)), size), np.frombuffer(b"".join(terms), np.uint32), np.frombuffer(b"".join(counts), np.uint32)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("terms").to_pylist()
        doc, term, _ = _flat(raw, raw)
        yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(doc)), pa.array(term.astype(np.int64))], names=["row", "term"])


def impact(count: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    return count * (K1 + 1) / (count + K1 * (1 - B + B * length / average))


class Queries:
    """A block of queries as an inverted index, in GROUPS groups of similar queries (by their common terms).

    Documents fall into the same groups. A term that many queries of group g and many of group l have is a column of the
    matrix product of the queries of g and the documents of l; all other pairs of a term meet through posting lists.
    Groups only decide which way a pair is scored, so every pair is, whatever the groups.
    """

    def __init__(self, found: pa.Table, n: int) -> None:
        order = np.argsort(found.column("row").to_numpy())
        found = found.take(pa.array(order))
        lists = found.column("terms").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        term, df = flat.field("term").to_numpy().astype(np.uint32), flat.field("df").to_numpy()
        query = np.repeat(np.arange(len(size)), size)
        order = np.argsort(term, kind="stable")
        term, df, query = term[order], df[order], query[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        self.term, self.size = term[first], np.diff(np.append(first, len(term)))
        self.weight, self.entry = idf(n, df[first]), np.repeat(np.arange(len(first), dtype=np.int32), self.size)
        self.bucket = np.searchsorted(self.term, np.arange((1 << 20) + 1, dtype=np.int64) << 12).astype(np.int32)
        common = np.flatnonzero(df[first] >= n * COMMON)
        self.label = np.full(len(first), -1, np.int32)  # column of the terms that tell the group
        self.label[common] = np.arange(len(common))
        has = np.zeros((len(size), len(common)), np.float32)
        own = self.label[self.entry]
        has[query[own >= 0], own[own >= 0]] = 1
        self.centres = _centres(has)
        group = self.groups(has)
        order = np.argsort(group, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.ident = found.column("ident").to_numpy()[order]
        self.query, self.start = rank[query], np.searchsorted(group[order], np.arange(len(self.centres) + 1))
        self.of = group[order].astype(np.int8)
        k = len(self.centres)
        often = np.bincount(self.entry.astype(np.int64) * k + self.of[self.query], minlength=len(first) * k).reshape(-1, k)
        members = np.diff(self.start)
        self.dense = (often >= np.maximum(members * COMMON, 2)).T.copy()  # group x term
        self.plans: dict[int, tuple] = {}
        order = np.argsort(self.query, kind="stable")
        self.rank, self.fine = np.empty(len(first), np.int64), _idf(n, df[first])  # frequent terms have neighbouring ranks, for the cache's sake
        self.rank[np.argsort(-self.size, kind="stable")] = np.arange(len(first))
        self.listed = self.rank[self.entry[order]]  # the terms of each query
        self.begin = np.searchsorted(self.query[order], np.arange(len(self.ident) + 1))
        self.lists: list[np.ndarray] = []

    def groups(self, has: np.ndarray) -> np.ndarray:
        """Nearest centre of each row of has (which of the common terms it has)."""
        return np.argmax(has @ self.centres.T, axis=1) if has.shape[1] else np.zeros(len(has), np.int64)

    def lookup(self, term: np.ndarray) -> np.ndarray:
        """Place of each term, -1 for those in no query."""
        out, todo, high = np.full(len(term), -1, np.int64), np.arange(len(term)), term >> 12
        at, end = self.bucket[high], self.bucket[high + 1]
        while True:
            left = np.flatnonzero(at < end)
            if not len(left):
                return out
            todo, at, end = todo[left], at[left], end[left]
            hit = self.term[at] == term[todo]
            out[todo[hit]] = at[hit]
            at = np.where(hit, end, at + 1)

    def plan(self, group: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
        """For documents of a group: column of each term, (columns, queries x columns) by the queries' group, and the posting lists of what is left."""
        if group not in self.plans:
            mine = self.dense[group]
            column = np.full(len(self.term), -1, np.int32)
            column[mine] = np.arange(mine.sum())
            wide = mine[self.entry] & self.dense[self.of[self.query], self.entry]
            parts = []
            for g, (lo, hi) in enumerate(zip(self.start[:-1], self.start[1:], strict=True)):
                both = np.flatnonzero(mine & self.dense[g])
                place = np.full(len(self.term), -1, np.int32)
                place[both] = np.arange(len(both))
                own = np.flatnonzero(wide & (self.of[self.query] == g))
                part = np.zeros((hi - lo, len(both)), np.float32)
                part[self.query[own] - lo, place[self.entry[own]]] = self.weight[self.entry[own]]
                parts.append((column[both], part))
            size = np.bincount(self.entry[~wide], minlength=len(self.term))
            self.plans[group] = column, parts, self.query[~wide], size, np.cumsum(size) - size
        return self.plans[group]

    def scores(self, group: int, doc: np.ndarray, at: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        """Queries x documents of one group: BM25 of every pair; at has the places of the documents' terms, own their impacts."""
        column, parts, query, many, first = self.plan(group)
        out = np.zeros((len(self.ident), n), np.float32)
        wide = np.flatnonzero(column[at] >= 0)
        block = np.zeros((int(column.max(initial=-1)) + 1, n), np.float32)
        block[column[at[wide]], doc[wide]] = own[wide]
        for g, (columns, part) in enumerate(parts):
            if len(columns) and len(part):
                out[self.start[g] : self.start[g + 1]] = part @ (block if len(columns) == len(block) else block[columns])
        size = many[at]
        some = np.flatnonzero(size)
        size, doc, at = size[some], doc[some], at[some]
        own = own[some] * self.weight[at]
        done = np.concatenate([[0], np.cumsum(size)])
        cuts = np.unique(np.searchsorted(done, np.arange(0, done[-1] + CELLS, CELLS), "left").clip(0, len(size)))
        flat = out.reshape(-1)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            length = size[lo:hi]
            spot = np.repeat(first[at[lo:hi]] - (done[lo:hi] - done[lo]), length) + np.arange(length.sum())
            np.add.at(flat, query[spot].astype(np.int64) * n + np.repeat(doc[lo:hi], length), np.repeat(own[lo:hi], length))
        return out

    def exact(self, hit: np.ndarray, to: np.ndarray, at: np.ndarray, own: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The scores of pairs (query, document) in double precision, so that they don't depend on what else was scored with them; document d has the terms cuts[d] to cuts[d + 1]."""
        out, score = np.zeros(len(hit)), np.zeros(len(self.term))
        order = np.argsort(to, kind="stable")
        hit, to = hit[order], to[order]
        edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist()
        size, hits = self.begin[hit + 1] - self.begin[hit], hit.tolist()
        if not self.lists:
            self.lists = np.split(self.listed, self.begin[1:-1])
        for lo, hi in zip(edge, [*edge[1:], len(hit)], strict=True):
            mine = at[cuts[to[lo]] : cuts[to[lo] + 1]]
            mine, fine = self.rank[mine], self.fine[mine]
            score[mine] = own[cuts[to[lo]] : cuts[to[lo] + 1]] * fine
            spot = np.concatenate([self.lists[h] for h in hits[lo:hi]])
            out[order[lo:hi]] = np.add.reduceat(score[spot], np.cumsum(size[lo:hi]) - size[lo:hi])
            score[mine] = 0
        return out


def _centres(has: np.ndarray) -> np.ndarray:
    """Unit vectors of GROUPS groups at most: farthest-first beginnings, then a few steps of spherical k-means."""
    norm = np.maximum(np.sqrt(has.sum(axis=1, keepdims=True)), 1)
    x = has / norm
    if not len(x) or not x.shape[1]:
        return np.zeros((1, has.shape[1]), np.float32)
    pick, near = [int(np.argmax(has.sum(axis=1)))], np.full(len(x), -1.0, np.float32)
    while len(pick) < min(GROUPS, len(x)):
        near = np.where(norm[:, 0] > 1, np.maximum(near, x @ x[pick[-1]]), 2)
        if near.min() >= 1 - 1e-6:
            break
        pick.append(int(np.argmin(near)))
    centres = x[pick]
    for _ in range(6):
        group = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[group == g].sum(axis=0) for g in range(len(centres))])
        size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.maximum(size, 1e-9), centres)
    return centres.astype(np.float32)


def _lowered(score: np.ndarray) -> np.ndarray:
    """A bound that no score equal to this one when rounded is below."""
    return (score - np.maximum(SLACK[0], SLACK[1] * score)).astype(np.float32)


def _search(block, known_least: np.ndarray, average: float, depth: int):
    """The depth best documents of this shard (the task's rows) for every query, of those that reach the query's known_least."""

    def best(found: list[tuple], spare: bool = False) -> list[np.ndarray]:
        """The depth best of each query, and what ties with the last of them; with spare also what may be as good if scored exactly."""
        query, score, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort((query.astype(np.int64) << 42) | ((1 << 42) - 1 - np.round(score * 1000.0).astype(np.int64).clip(0, (1 << 42) - 1)))
        query, score = query[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        size = np.diff(np.append(first, len(query)))
        last = score[first + np.minimum(size, depth) - 1]
        good = score >= np.repeat(_lowered(_lowered(last)) if spare else last, size)
        return [query[good], score[good], *(x[order[good]] for x in rest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = block.value
        step = max(16, CELLS // max(1, len(q.ident)))
        least, rough, held, settled = known_least.copy(), [], 0, []
        docs: list[tuple] = []  # what rough points into
        seen = postings = 0

        def settle() -> None:
            """Scores in double precision what is left of rough."""
            nonlocal rough, held, settled, docs, seen, postings
            if held:
                hit, _, to = best(rough, True)
                at, own, size, ids, known, ident, length, many, every = (np.concatenate(x) for x in zip(*docs, strict=True))
                score = np.round(q.exact(hit, to, at, own, np.concatenate([[0], np.cumsum(size)])), 3)
                start, size = np.cumsum(many) - many, np.minimum(many, depth)[to]  # of equal rows the first by row come first
                row = every[np.repeat(start[to] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                hit, to, score = np.repeat(hit, size), np.repeat(to, size), np.repeat(score, size)
                settled = [tuple(best([*settled, (hit, score, row, ids[to], known[to], ident[to], length[to])]))]
            rough, held, docs, seen, postings = [], 0, [], 0, 0

        for whole in batches:
            for k in range(0, len(whole), 8 * step):
                batch = whole.slice(k, 8 * step)
                every = batch.column("row").to_numpy()
                _, first, same = np.unique(batch.column("ident").to_numpy(), return_index=True, return_inverse=True)
                every = every[np.lexsort((every, same))]  # rows of each ident, one after the other
                batch = batch.take(pa.array(first))
                length, ident = (batch.column(c).to_numpy() for c in ("n_tokens", "ident"))
                ids = batch.column("doc_id")
                known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(np.iinfo(np.int64).max).to_numpy()
                doc, term, count = _flat(batch.column("terms").to_pylist(), batch.column("counts").to_pylist())
                at = q.lookup(term)
                own = np.flatnonzero(at >= 0)
                doc, at, count = doc[own], at[own], count[own]
                own = impact(count, length[doc], average)
                docs.append((at.astype(np.int32), own, np.bincount(doc, minlength=len(batch)), ids, known, ident, length, np.bincount(same, minlength=len(first)), every))
                own = own.astype(np.float32)
                has = np.zeros((len(batch), q.centres.shape[1]), np.float32)
                told = q.label[at]
                has[doc[told >= 0], told[told >= 0]] = 1
                group = q.groups(has)
                cuts = np.searchsorted(doc, np.arange(len(batch) + 1))
                for g in np.unique(group).tolist():
                    members = np.flatnonzero(group == g)
                    for j in range(0, len(members), step):
                        d = members[j : j + step]
                        size = cuts[d + 1] - cuts[d]
                        spot = np.repeat(cuts[d] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        s = q.scores(g, np.repeat(np.arange(len(d)), size), at[spot], own[spot], len(d))
                        hit, to = np.nonzero(s >= least[:, None])
                        other = ident[d[to]] != q.ident[hit]
                        hit, to = hit[other], to[other]
                        if len(hit) > 2 * len(least) and len(d) > depth + 1:  # one may be the query itself
                            least = np.maximum(least, _lowered(np.partition(s, len(d) - depth - 1, axis=1)[:, len(d) - depth - 1]))
                            high = s[hit, to] >= least[hit]
                            hit, to = hit[high], to[high]
                        rough.append((hit, s[hit, to], seen + d[to]))
                        held += len(hit)
                        if held > max(CELLS // 2, 4 * depth * len(q.ident)):
                            rough = [tuple(best(rough, True))]
                            held = len(rough[0][0])
                seen, postings = seen + len(batch), postings + len(at)
                if postings > KEPT:
                    settle()
        settle()
        if settled:
            hit, score, row, ids, known, ident, length = settled[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(q.ident[hit]), pa.array(row), pa.array(ids, pa.int64(), mask=~known), pa.array(ident), pa.array(length), pa.array(score)], names=["seed", "row", "doc_id", "ident", "n_tokens", "score"]
            )

    return run


def _parts(rows: DataFrame, n: int, scratch: Scratch) -> list[DataFrame]:
    """rows in parts that don't overlap: some FIRST rows at most, then each part STEP times as large as all before it; the samples are by hash of the row."""
    steps = max(0, ceil(log(max(1, n / FIRST), STEP)))
    parts = []
    for k in range(1, steps + 1):
        inside = F.pmod(F.xxhash64("row"), F.lit(STEP**k)) == 0
        parts.append(rows.filter(~inside))
        rows = scratch.keep(rows.filter(inside), "sample")
    return [rows.coalesce(max(1, ceil(n / STEP**steps / FIRST_TASK))), *reversed(parts)]


def search(spark: SparkSession, rows: DataFrame, seeds: DataFrame, df: DataFrame, n: int, average: float, *, depth: int = DEPTH, queries: int = QUERIES, scratch: Scratch) -> DataFrame:
    """(seed, row, doc_id, ident, n_tokens, score): the depth best neighbours among rows of each of the seeds, both of which are of TERMS."""
    one = seeds.groupBy("ident").agg(F.min("row").alias("row"), F.min_by("terms", "row").alias("terms"))
    terms = one.select("row", "terms").mapInArrow(_unpack, "row long, term long").join(df.filter("df > 1"), "term")  # a term of the seed alone finds nothing
    given = terms.groupBy("row").agg(F.collect_list(F.struct("term", "df")).alias("terms")).join(seeds.select("row", "ident"), "row")
    given = scratch.keep(given, "queries")
    count, postings = given.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(ceil(count / queries), ceil(postings / POSTINGS))
    if not blocks:
        return spark.createDataFrame([], HITS)
    parts, found = _parts(rows.select("row", "doc_id", "ident", "n_tokens", "terms", "counts"), n, scratch), []
    order = Window.partitionBy("seed").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "ident", "row")
    for k in range(blocks):
        q = Queries(given.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).toArrow(), n)
        block, least, best = spark.sparkContext.broadcast(q), np.full(len(q.ident), 1e-6, np.float32), None
        by_ident = np.argsort(q.ident)
        for part in parts:
            hits = scratch.keep(part.mapInArrow(_search(block, least, average, depth), HITS), "hits")
            hits = hits if best is None else best.union(hits)
            best = scratch.keep(hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= depth).drop("place"), "best")
            scratch.drop("hits")
            if part is not parts[-1]:
                full = best.groupBy("seed").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") == depth).select("seed", "score").toArrow()
                at = by_ident[np.searchsorted(q.ident, full.column("seed").to_numpy(), sorter=by_ident)]
                least[at] = np.maximum(least[at], _lowered(full.column("score").to_numpy()))
        block.destroy()
        found.append(best)
    scratch.drop("sample")
    of = seeds.select(F.col("row").alias("own"), F.col("ident").alias("seed"))
    return reduce(DataFrame.union, found).join(of, "seed").select(F.col("own").alias("seed"), "row", "doc_id", "ident", "n_tokens", "score")


def assign(spark: SparkSession, hits: DataFrame, seeds: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(seed, row, ident, left, score): the documents that seeds take. A row is offered to the seed that scores it highest; a seed takes offers while they fit."""
    space = seeds.select(F.col("row").alias("seed"), F.col("doc_id").alias("seed_id"), (window - F.col("n_tokens") % window).alias("space"))
    one = Window.partitionBy("seed", "ident").orderBy("row")  # of equal rows a window takes one
    pairs = hits.join(seeds.select("row"), "row", "left_anti").withColumn("left", F.col("n_tokens") % window).filter("left > 0")
    pairs = pairs.withColumn("one", F.row_number().over(one)).filter("one = 1").join(space, "seed").filter("left <= space")
    pairs = scratch.keep(pairs.select("seed", "seed_id", "space", "row", "doc_id", "ident", "left", "score"), "pairs")
    taken = []
    kind = "array<struct<down:double,doc_id:bigint,ident:bigint,row:bigint,left:bigint>>"
    while not pairs.isEmpty():
        best = pairs.groupBy("row").agg(F.max(F.struct("score", (-F.col("seed_id")).alias("a"), (-F.col("seed")).alias("b"), "seed", "space", "doc_id", "ident", "left")).alias("o"))
        offers = best.groupBy("o.seed", "o.space").agg(F.array_sort(F.collect_list(F.struct((-F.col("o.score")).alias("down"), F.coalesce("o.doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "o.ident", "row", "o.left"))).alias("offers"))
        start = F.struct(F.col("space").alias("space"), F.array().cast(kind).alias("taken"))
        step = lambda s, x: F.when(x["left"] <= s["space"], F.struct((s["space"] - x["left"]).alias("space"), F.concat(s["taken"], F.array(x)).cast(kind).alias("taken"))).otherwise(s)
        done = scratch.keep(offers.select("seed", F.aggregate("offers", start, step).alias("s")).select("seed", "s.space", "s.taken"), "done")
        now = done.select("seed", F.explode("taken").alias("t")).select("seed", "t.row", "t.ident", "t.left", (-F.col("t.down")).alias("score"))
        taken.append(now)
        rest = pairs.join(now.select("row"), "row", "left_anti").join(done.select("seed", F.col("space").alias("now")), "seed", "left")
        pairs = scratch.keep(rest.withColumn("space", F.coalesce("now", "space")).drop("now").filter("left <= space"), "pairs")
    return scratch.keep(reduce(DataFrame.union, taken), "taken") if taken else spark.createDataFrame([], "seed long, row long, ident long, left long, score double")


def pack_shard(
    n: np.ndarray, left: np.ndarray, ident: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], weight: np.ndarray, average: float, window: int, begun: dict[int, tuple[int, int, set[int]]] | None = None
) -> list[tuple[int, int, int, float | None]]:
    """(seed, slot, document, score) over the documents of one shard, which come in the order of their ties; begun: (space, slots, idents) of the windows to fill up, by seed."""
    begun, size = begun or {}, np.array([len(t) for t in terms])
    flat, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float64)
    doc = np.repeat(np.arange(len(n)), size)
    own = weight[flat >> 12] * impact(tf, n[doc], average)
    order, ordered = _sorted(flat)
    posting_doc, posting = doc[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    vocabulary, last = ordered[first], np.append(first[1:], len(order))
    rows, unused = [], np.ones(len(n), bool)
    unused[list(begun)] = False
    for seed in [*begun, *(d for d in np.lexsort((np.arange(len(n)), -left)).tolist() if d not in begun)]:
        if seed in begun:
            space, slot, have = begun[seed]
        elif unused[seed]:
            unused[seed] = False
            rows.append((seed, 0, seed, None))
            space, slot, have = window - int(left[seed]), 1, {int(ident[seed])}
        else:
            continue
        fits = unused & (left <= space)
        if not fits.any():
            continue
        at = np.searchsorted(vocabulary, terms[seed])
        lo, length = first[at], last[at] - first[at]
        spot = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        score = np.round(np.bincount(posting_doc[spot], posting[spot], len(n)), 3)
        near = np.flatnonzero(fits & (score > 0))
        near = near[np.argsort(-score[near], kind="stable")]
        least = int(left[near].min()) if len(near) else 0
        for d, take in zip(near.tolist(), left[near].tolist(), strict=True):
            if take <= space and int(ident[d]) not in have:
                have.add(int(ident[d]))
                unused[d] = False
                rows.append((seed, slot, d, float(score[d])))
                space, slot = space - take, slot + 1
            if space < least:
                break
    return rows


def _pack(weights, average: float, window: int):
    def run(group: pa.Table) -> pa.Table:
        ids = np.array([(1 << 63) - 1 if i is None else i for i in group.column("doc_id").to_pylist()], np.int64)
        group = group.take(pa.array(np.lexsort((group.column("row").to_numpy(), group.column("digest").to_numpy(), ids))))
        n, left, ident, row = (group.column(c).to_numpy() for c in ("n_tokens", "left", "ident", "row"))
        terms, counts = ([np.frombuffer(x, np.uint32) for x in group.column(c).to_pylist()] for c in ("terms", "counts"))
        begun = {k: (space, len(have) + 1, {*have, int(ident[k])}) for k, (space, have) in enumerate(zip(group.column("space").to_pylist(), group.column("have").to_pylist(), strict=True)) if space is not None}
        rows = pack_shard(n, left, ident, terms, counts, weights.value, average, window, begun)
        seed, slot, d, score = zip(*rows, strict=True) if rows else ((), (), (), ())
        d = np.array(d, np.int64)
        return pa.table(
            {
                "window": pa.array([f"row-{row[s]}" for s in seed], pa.string()),
                "slot": pa.array(slot, pa.int32()),
                "doc_id": group.column("doc_id").take(pa.array(d)),
                "start": pa.array(n[d] - left[d], pa.int64()),
                "n_tokens": pa.array(left[d], pa.int64()),
                "score": pa.array(score, pa.float64()),
                "digest": group.column("digest").take(pa.array(d)),
            }
        )

    return run


def _split(rows: DataFrame, by: list[str], into: str, at, shard: int, few: int, scratch: Scratch) -> DataFrame:
    """rows with the column into: which part of its group a row is in; groups of over twice the size of a shard have several."""
    large = scratch.keep(rows.groupBy(*by).count().filter(F.col("count") > 2 * shard).select(*by, F.ceil(F.col("count") / shard).alias("parts")), "large")
    rows = rows.join(F.broadcast(large) if large.count() <= few else large.hint("merge"), by, "left")
    return rows.withColumn(into, F.when(F.col("parts").isNull(), 0).otherwise(at(F.col("parts"))).cast("long")).drop("parts")


def pack(
    spark: SparkSession, docs: DataFrame, *, window: int = WINDOW, shard: int = SHARD, every: int = EVERY, depth: int = DEPTH, queries: int = QUERIES, broadcast_shards: int = BROADCAST_SHARDS, scratch: Scratch | None = None
) -> DataFrame:
    """PIECES of each window; the seed, or a whole window of one text, is in slot 0 and has no score. doc_id and digest (of the text's words) name a text."""
    scratch = scratch or Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_bags, BAGS), "terms")
    n, average, df, by_term = corpus_statistics(rows, scratch)
    weights = spark.sparkContext.broadcast(idf(n, df))
    bits = max(0, ceil(log2(max(1, n / shard))))
    left = F.col("n_tokens") % window
    some = rows.filter(left > 0)
    seeds = some.filter(F.col("doc_id") % every == 0)
    hits = search(spark, some, seeds, by_term, n, average, depth=depth, queries=queries, scratch=scratch)
    taken = assign(spark, hits, seeds, window, scratch)

    whole = rows.filter(F.col("n_tokens") >= window).select("row", "doc_id", "digest", F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_tokens") / window) - 1)).alias("k", "at"))
    whole = whole.select(F.concat_ws("-", F.lit("whole"), "row", "k").alias("window"), F.lit(0).alias("slot"), "doc_id", (F.col("at") * window).alias("start"), F.lit(window).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("score"), "digest")
    name = lambda c: F.concat(F.lit("row-"), F.col(c).cast("string")).alias("window")
    first = seeds.select(name("row"), F.lit(0).alias("slot"), "doc_id", (F.col("n_tokens") - left).alias("start"), left.alias("n_tokens"), F.lit(None).cast("double").alias("score"), "digest")
    slot = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "ident", "row"))
    near = rows.select("row", "doc_id", "n_tokens", "digest").join(taken.select("seed", "row", "ident", "score"), "row")
    near = near.select(name("seed"), slot.alias("slot"), "doc_id", (F.col("n_tokens") - left).alias("start"), left.alias("n_tokens"), "score", "digest")

    begun = seeds.select("row", (window - left).alias("room")).join(taken.groupBy(F.col("seed").alias("row")).agg(F.sum("left").alias("used"), F.collect_list("ident").alias("have")), "row", "left")
    begun = begun.select("row", (F.col("room") - F.coalesce("used", F.lit(0))).alias("space"), F.coalesce("have", F.array().cast("array<bigint>")).alias("have"))
    keys = scratch.keep(some.select("row", "digest", "terms").mapInArrow(_keys(weights), "row long, digest long, key long, second long"), "keys")
    place = keys.join(taken.select("row"), "row", "left_anti").withColumn("shard", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long"))
    high = F.shiftrightunsigned("second", 32)
    place = _split(place, ["shard"], "part", lambda parts: F.floor(high * parts / F.lit(1 << 32)), shard, broadcast_shards, scratch)
    place = _split(place, ["shard", "part"], "piece", lambda parts: F.pmod(F.xxhash64("digest", "row"), parts), shard, broadcast_shards, scratch)
    place = scratch.keep(place.select("row", "shard", "part", "piece"), "place")
    rest = some.join(place, "row").join(begun, "row", "left").withColumn("left", left)
    rest = rest.groupBy("shard", "part", "piece").applyInArrow(_pack(weights, average, window), PIECES)
    return whole.union(first).union(near).union(rest)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
