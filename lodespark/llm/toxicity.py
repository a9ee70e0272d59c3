"""Toxic passages: all maximal scoring segments of token log-odds, kept when extreme-value statistics call them significant.

Model: for each word of toxic labelled documents the log-odds of toxic against clean, with an informative Dirichlet
prior spread like the corpus and worth ALPHA of the labelled words. Toxic words are counted once per context (pair of neighbouring words other
than itself), so that copies of one document or a run of one word don't make it toxic. A word enters if its log-odds is
Z standard deviations above 0 and it has MIN_CONTEXTS contexts; all other words share one score, their common log-odds.
DRIFT is taken from every token's score, which ends passages. A word of score s that is the k-th of its own in reach
scores s/k and 1 - 1/k of what another word does; its reach is the s over the common score tokens up to it, beyond which
a word can't bridge the gap to itself. So a run of one word adds little, and a later passage counts in full.

Search: the linear-time algorithm for all maximal scoring subsequences, over whole texts. A segment of score S in n
tokens is expected K n exp(-lambda S) times by chance: lambda solves E[exp(lambda s)] = 1 over clean words. K is the
least that covers the clean labelled documents held out of the model (one of HELD by hash), wherever LEVEL of them or
more reach a score. A document is toxic if P = 1 - exp(-that), of its best segment, is at
most LEVEL; each of its segments that is itself significant is returned.

* null doc_id, null, empty or wordless text: no row. Labels that are null or of unknown documents don't count; a
  doc_id labelled both ways counts as toxic. Repeated rows (doc_id, text) count once, in the fit too.
* all labels are used, however many; over BROADCAST_LABELS they are joined by shuffle. No toxic label, or an empty table: nothing is toxic, the result is empty. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .textkeys import U, mix, word_hashes

ALPHA, Z, MIN_CONTEXTS, DRIFT, LEVEL, HELD = 0.01, 3.0, 3, 0.5, 0.005, 5
#: Labels (12 bytes each) that are broadcast; more are joined by shuffle, with the same result.
BROADCAST_LABELS = 200_000
#: Classes of a score of 1, in the fit of K.
CLASSES = 8
#: Candidates of lambda in one pass.
RATES = 32
#: Repeated (doc_id)s up to which they are broadcast to be looked at; with more, the whole table is shuffled.
BROADCAST_REPEATS = 100_000
#: Words of a model that is broadcast (16 bytes each); a larger one is joined with the tokens.
BROADCAST_WORDS = 1_000_000
BATCH = 1024
_WORD = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+")
SEGMENTS = "doc_id long, digest long, n_tokens long, start_token long, end_token long, score double, passage string"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, context, corpus, clean, toxic): for toxic documents one row per word and pair of neighbours, else one per word. toxic is null for those outside the fit."""
    for whole in batches:
        for k in range(0, len(whole), BATCH):
            batch = whole.slice(k, BATCH)
            offsets, h = word_hashes(batch.column("text").to_pylist())
            if not len(h):
                continue
            label = batch.column("toxic")
            toxic = np.repeat(pc.fill_null(label, False).to_numpy(zero_copy_only=False), np.diff(offsets))
            clean = np.repeat(pc.fill_null(pc.invert(label), False).to_numpy(zero_copy_only=False), np.diff(offsets))
            some = np.diff(offsets) > 0  # a text's first and last word have no neighbour in another text
            before, after = np.concatenate([[U(0)], h[:-1]]), np.concatenate([h[1:], [U(0)]])
            before[offsets[:-1][some]], after[offsets[1:][some] - 1] = U(0), U(0)
            with np.errstate(over="ignore"):
                context = mix(before * U(3) + after)
            own = (before == h) | (after == h)
            context = np.where(toxic, np.where(own, U(1), (context | U(1)) ^ U(2)), U(0))
            order = np.lexsort((context, h))
            w, c = h[order], context[order]
            first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])]))
            n = np.diff(np.append(first, len(w)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(w[first].view(np.int64)), pa.array(c[first].view(np.int64)), pa.array(n), pa.array(np.add.reduceat(clean[order].astype(np.int64), first)), pa.array(np.where(c[first] != 0, n, 0))],
                names=["word", "context", "corpus", "clean", "toxic"],
            )


class Model:
    """Scores of the significant words, sorted by hash, and the score of every other word."""

    def __init__(self, words: np.ndarray, scores: np.ndarray, other: float, rate: float) -> None:
        order = np.argsort(words)
        self.words, self.scores, self.other, self.rate = words[order], scores[order], other, rate

    def of(self, h: np.ndarray) -> np.ndarray:
        """The score of each word; NaN for the others."""
        out = np.full(len(h), np.nan)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            out[self.words[at] == h] = self.scores[at[self.words[at] == h]]
        return out


def log_odds(docs: DataFrame, *, alpha: float = ALPHA, z: float = Z, min_contexts: int = MIN_CONTEXTS, drift: float = DRIFT, scratch: Scratch) -> tuple[DataFrame, float, float]:
    """((word, score) of the significant words, score of the others, lambda). docs has text and toxic, null where a document is not fitted on."""
    counts = docs.mapInArrow(_count, "word long, context long, corpus long, clean long, toxic long")
    counts = counts.groupBy("word", "context").agg(*[F.sum(c).alias(c) for c in ("corpus", "clean", "toxic")])
    counts = counts.groupBy("word").agg(
        F.sum("corpus").alias("corpus"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if((F.col("toxic") > 0) & (F.col("context") != 1)).alias("contexts")
    )
    counts = scratch.keep(counts.withColumn("clean", F.col("clean").cast("double")), "counts")
    n, n0, n1 = (float(x or 0) for x in counts.agg(F.sum("corpus"), F.sum("clean"), F.sum("toxic")).first())
    alpha *= n0 + n1
    prior = F.lit(alpha / max(n, 1)) * F.col("corpus")
    p1, p0 = (F.col("toxic") + prior) / max(n1 + alpha, 1e-9), (F.col("clean") + prior) / max(n0 + alpha, 1e-9)
    odds = F.log(p1 / p0)
    spread = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    model = counts.filter((F.col("contexts") >= min_contexts) & (F.col("toxic") > 0)).select("word", odds.alias("odds"), p1.alias("p1"), p0.alias("p0"), (odds / spread).alias("z"))
    model = scratch.keep(model.filter((F.col("z") >= z) & (F.col("odds") > drift)), "model")
    m1, m0 = (float(x or 0) for x in model.agg(F.sum("p1"), F.sum("p0")).first())
    other = log(max(1 - m1, 1e-9) / max(1 - m0, 1e-9)) - drift
    # sum of p0 exp(rate (odds - drift)) is 1 at 0 and at lambda, which is 1 at least, as the drift is not negative
    low, high = 1.0, 64.0
    for _ in range(3 if m1 > 0 else 0):  # each pass over the model sums up RATES candidates at once
        rates = [low + (high - low) * (k / RATES) ** 2 for k in range(RATES + 1)]
        sums = model.agg(*[F.sum(F.col("p0") * F.exp(F.lit(r) * (F.col("odds") - drift))) for r in rates]).first()
        below = [k for k, (r, v) in enumerate(zip(rates, sums, strict=True)) if float(v or 0) + (1 - m0) * exp(r * other) < 1]
        k = min(below[-1] if below else 0, RATES - 1)
        low, high = rates[k], rates[k + 1]
    low = low if m1 > 0 else 1.0
    return model.select("word", (F.col("odds") - drift).alias("score")), other, low


def maximal_segments(scores: list[tuple[int, float]], n: int, other: float) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments of n tokens. scores: (position, score) of those above 0; every other one has the negative score other.

    Runs of other tokens are one step each, so the time is linear in the tokens above 0.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, the last one below it in sum before or -1
    total, at = 0.0, 0
    for position, score in scores:
        total += (position - at) * other
        start, before = position, total
        total += score
        at = end = position + 1
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= before:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= total:
                stack.append((start, end, before, total, k))
                break
            start, before = stack[k][0], stack[k][2]
            del stack[k:]
    return [(start, end, after - before) for start, end, before, after, _ in stack]


def fade(h: np.ndarray, scores: np.ndarray, offsets: np.ndarray, other: float) -> np.ndarray:
    """The scores, less for a word that is repeated within its reach; those that are not above 0 any more are NaN."""
    at = np.flatnonzero(~np.isnan(scores))
    if len(at):
        doc = np.searchsorted(offsets, at, "right")
        order = np.lexsort((at, h[at], doc))
        d, w, place, s = doc[order], h[at][order], at[order], scores[at[order]]
        group = np.cumsum(np.concatenate([[False], (d[1:] != d[:-1]) | (w[1:] != w[:-1])]))
        far = len(h) + 1
        reach = np.minimum(np.ceil(s / max(-other, 1e-9)), far - 1).astype(np.int64)
        key = group * far + place
        nth = np.arange(len(at)) - np.searchsorted(key, np.maximum(key - reach, group * far)) + 1
        s = s / nth + other * (1 - 1 / nth)
        scores[place] = np.where(s > 1e-9, s, np.nan)
    return scores


def _digest(h: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(np.sum(mix(h ^ mix(np.arange(len(h), dtype=U))), dtype=U).astype(np.int64)) if len(h) else 0


def _rows(doc_id: int, text: str, h: np.ndarray, s: np.ndarray, other: float) -> list[tuple]:
    at = np.flatnonzero(~np.isnan(s))
    found = maximal_segments(list(zip(at.tolist(), s[at].tolist(), strict=True)), len(s), other)
    spans = [m.span() for m in _WORD.finditer(text)]
    mark = _digest(h)
    return [(doc_id, mark, len(s), a, b, score, text[spans[a][0] : spans[b - 1][1]] if len(spans) == len(s) else None) for a, b, score in found]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.float64(), pa.string()]
    names = ["doc_id", "digest", "n_tokens", "start_token", "end_token", "score", "passage"]
    columns = zip(*rows, strict=True) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _segments(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for k in range(0, len(whole), BATCH):
                batch = whole.slice(k, BATCH)
                texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
                offsets, h = word_hashes(texts)
                s = fade(h, m.of(h), offsets, m.other)
                hit = np.unique(np.searchsorted(offsets, np.flatnonzero(~np.isnan(s)), "right") - 1)
                yield _table([r for i in hit.tolist() for r in _rows(ids[i], texts[i], h[offsets[i] : offsets[i + 1]], s[offsets[i] : offsets[i + 1]], m.other)])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, len(whole), BATCH):
            batch = whole.slice(k, BATCH)
            offsets, h = word_hashes(batch.column("text").to_pylist())
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("doc_id").to_numpy(), n)), pa.array(np.arange(len(h)) - np.repeat(offsets[:-1], n)), pa.array(h.view(np.int64))], names=["doc_id", "position", "word"]
            )


def segments(spark: SparkSession, docs: DataFrame, words: DataFrame, other: float, *, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """SEGMENTS of all documents that have a word of the model."""
    if words.count() <= broadcast_words:
        rows = words.toPandas()
        model = Model(rows["word"].to_numpy(np.int64).view(U), rows["score"].to_numpy(np.float64), other, 0)
        return docs.mapInArrow(_segments(spark.sparkContext.broadcast(model)), SEGMENTS)
    # too many words to send to each executor: the tokens meet them in a join, and only texts with such words are read again
    found = docs.mapInArrow(_tokens, "doc_id long, position long, word long").join(words, "word")
    found = found.groupBy("doc_id").agg(F.collect_set("word").alias("words"), F.max_by("score", "word").alias("any")).select("doc_id", "words")
    scored = found.select("doc_id", F.explode("words").alias("word")).join(words, "word").groupBy("doc_id").agg(F.collect_list(F.struct("word", "score")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own = Model(np.array([x["word"] for x in r["own"]], np.int64).view(U), np.array([x["score"] for x in r["own"]]), other, 0)
                _, h = word_hashes([r["text"]])
                s = fade(h, own.of(h), np.array([0, len(h)]), other)
                if not np.isnan(s).all():
                    rows += _rows(r["doc_id"], r["text"], h, s, other)
            yield _table(rows)

    return docs.join(scored, "doc_id").select("doc_id", "text", "own").mapInArrow(run, SEGMENTS)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, len(whole), BATCH):
            offsets, _ = word_hashes(whole.slice(k, BATCH).column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"tokens": pa.array([int(offsets[-1])], pa.int64()), "docs": pa.array([len(offsets) - 1], pa.int64())})


def once(docs: DataFrame, scratch: Scratch, *, broadcast_repeats: int = BROADCAST_REPEATS) -> DataFrame:
    """docs (doc_id, text) without repeated rows; only the rows of repeated ids move."""
    again = scratch.keep(docs.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    n = again.count()
    if n > broadcast_repeats:
        return docs.repartition("doc_id").dropDuplicates(["doc_id", "text"])
    if not n:
        return docs
    return docs.join(F.broadcast(again), "doc_id", "left_anti").union(docs.join(F.broadcast(again), "doc_id", "left_semi").repartition("doc_id").dropDuplicates(["doc_id", "text"]))


def toxic_passages(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, *, level: float = LEVEL, alpha: float = ALPHA, z: float = Z, drift: float = DRIFT, broadcast_labels: int = BROADCAST_LABELS, broadcast_words: int = BROADCAST_WORDS, broadcast_repeats: int = BROADCAST_REPEATS, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, start_token, end_token, score, expected, p_value, passage): the significant passages of toxic documents, p_value being the document's."""
    scratch = scratch or Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null and text is not null")
    docs = once(docs, scratch, broadcast_repeats=broadcast_repeats)
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    labels = scratch.keep(labels, "labels")
    small = F.broadcast if labels.count() <= broadcast_labels else lambda df: df
    held = (F.col("toxic") <= 0) & (F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0)
    words, other, rate = log_odds(docs.join(small(labels.filter(~held)), "doc_id", "left").select("text", (F.col("toxic") > 0).alias("toxic")), alpha=alpha, z=z, drift=drift, scratch=scratch)
    found = scratch.keep(segments(spark, docs, words, other, broadcast_words=broadcast_words).distinct(), "segments")
    clean = small(labels.filter(held).select("doc_id"))
    sizes = docs.join(clean, "doc_id").select("text").mapInArrow(_sizes, "tokens long, docs long")  # tokens as in n_tokens
    tokens, size = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    # documents by the class of their best score, of width 1 / CLASSES: a bounded number of rows
    best = found.join(clean, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("score").alias("score"))
    k, above, least = 0.0, 0, words.agg(F.min("score")).first()[0] or 0.0
    for r in best.groupBy(F.floor(F.col("score") * CLASSES).alias("class")).count().orderBy(F.desc("class")).collect():
        above += r["count"]
        if above >= level * size:
            k = max(k, above / max(tokens, 1) * exp(min(rate * (r["class"] + 1) / CLASSES, 600.0)))
    k = k or (above + 1) / max(tokens, 1) * exp(min(rate * least, 600.0))
    expected = F.lit(k) * F.col("n_tokens") * F.exp(-F.lit(rate) * F.col("score"))
    found = found.withColumn("expected", expected)
    best = F.min("expected").over(Window.partitionBy("doc_id"))
    result = found.withColumn("p_value", -F.expm1(-best)).filter((F.col("p_value") <= level) & (F.col("expected") <= level))
    result = scratch.keep(result.select("doc_id", "start_token", "end_token", "score", "expected", "p_value", "passage"), "toxic")
    scratch.drop("counts", "model", "segments", "labels", "again")
    return result


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_passages(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
