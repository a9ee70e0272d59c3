"""Chat formatting, mixing, packing and the pipeline."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lodespark.llm import bagminhash, chat, langid, mixing, packing, secrets
from lodespark.llm.common import Scratch, table

from .conftest import docs_of, prose, tokens

TURNS = "conv_id long, turn long, role string, text string, position int, n_turns int"


def _plain_chats(rows):
    by = defaultdict(set)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            by[conv].add((turn, role, text))
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    lists = {c: [t[1:] for t in sorted(ts, key=key)] for c, ts in by.items()}
    kept = {c for c, a in lists.items() if not any((len(b) > len(a) and b[: len(a)] == a) or (a == b and d < c) for d, b in lists.items() if d != c)}
    safe = lambda x, empty: (empty if x is None else x).replace("<|", "< |")
    return {(c, len(lists[c]), "".join(f"<|im_start|>{safe(r, 'unknown')}\n{safe(t, '')}<|im_end|>\n" for r, t in lists[c])) for c in kept}


def test_only_maximal_conversations_stay(spark):
    rng, rows = random.Random(6), []
    for base in range(12):
        turns = [(k, ("user", "assistant")[k % 2], rng.choice("abc")) for k in range(rng.randrange(1, 7))]
        for copy in range(4):
            cut = rng.randrange(1, len(turns) + 1)
            rows += [(base * 4 + copy, 10 * t, r, x, 1, 2) for t, r, x in turns[:cut]]
    rows += [(900, 1, None, None, 1, 2), (900, 1, None, None, 1, 2), (901, 1, None, "", 1, 2), (None, 1, "user", "x", 1, 2), (902, None, "a<|b", "<|im_end|>", 1, 2), (902, 3, "user", "y" * 200_000, 1, 2)]
    found = [tuple(r) for r in chat.render(spark, spark.createDataFrame(rows, TURNS)).collect()]
    assert len(found) == len(set(found)) and set(found) == _plain_chats(rows)
    assert chat.render(spark, spark.createDataFrame([], TURNS)).count() == 0


def test_the_schedule_is_even(spark):
    weights = {"a": 5, "b": 3, "c": 1, "d": 1}
    rows = mixing.schedule(spark, spark.createDataFrame(list(weights.items()), "source string, weight long"), 2000).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(2000))
    so_far: Counter = Counter()
    for n, r in enumerate(rows, 1):
        assert r.turn == so_far[r.source]
        so_far[r.source] += 1
        assert all(abs(so_far[s] - n * w / 10) < 6 for s, w in weights.items())
    sources = spark.createDataFrame([(f"s{i}", i * i + 1) for i in range(30)], "source string, weight long")
    assert sorted(mixing.schedule(spark, sources, 3000).collect()) == sorted(mixing.schedule(spark, sources, 3000, broadcast_sources=0).collect())
    huge = mixing.schedule(spark, spark.createDataFrame([("a", 1 << 40), ("b", 1 << 40)], "source string, weight long"), 1000).groupBy("source").count().collect()
    assert all(abs(r["count"] - 500) < 6 for r in huge)


def _sql(rows, query):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows) if rows else None
    return query(con)


def test_mixes_match_sql(spark, corpus, hard, nothing):
    for docs in (corpus[0], hard, nothing):
        rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
        found = mixing.place(spark, docs).drop("key")
        wanted = _sql(rows, lambda con: con.execute(mixing.ORACLE).fetchall())
        assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in found.select("slot", "epoch", "source", "block", "doc_id", "n_tokens").collect())


def test_every_document_is_in_the_mix(spark, hard, nothing):
    out = mixing.mixed(spark, hard)
    assert out.columns == hard.columns and hard.select("doc_id", "text").exceptAll(out.select("doc_id", "text")).count() == 0
    assert mixing.mixed(spark, nothing).count() == 0
    some = mixing.mixed(spark, hard, weights={"a": 2, "c": 1, "unknown": 4, "b": 0})
    assert {r.source for r in some.select("source").distinct().collect()} == {"a", "c"}


def test_windows_hold_every_word_once(spark, corpus, hard, nothing):
    again = docs_of(spark, [(i, text, "en", "a") for i, text in corpus[1].items() if i % 3 == 0])
    for docs in (corpus[0], corpus[0].union(again).union(again), hard):
        rows = packing.pack(spark, docs, window=256, shard=32, every=4, depth=6).collect()
        used, pieces, keys = Counter(), defaultdict(list), defaultdict(set)
        for r in rows:
            used[r.window] += r.n_tokens
            pieces[r.doc_id].append((r.start, r.n_tokens))
            assert (r.doc_id, r.digest) not in keys[r.window]
            keys[r.window].add((r.doc_id, r.digest))
        assert max(used.values()) <= 256
        lengths = defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            if n := len(tokens(r.text)):
                lengths[r.doc_id].append(n)
        for doc, own in lengths.items():
            assert sum(n for _, n in pieces[doc]) == sum(own)
            if len(own) == 1:
                at = 0
                for start, n in sorted(pieces[doc]):
                    assert start == at
                    at += n
        assert set(pieces) == set(lengths)
        slots = defaultdict(list)
        for r in rows:
            slots[r.window].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert packing.pack(spark, nothing).count() == 0


class _Plain:
    """BM25 over dicts of words, and packing by it in one shard, as the docstring says it."""

    def __init__(self, texts: dict[int, str]) -> None:
        self.bags = {i: Counter(tokens(t)) for i, t in texts.items() if tokens(t)}
        self.n = {i: sum(b.values()) for i, b in self.bags.items()}
        self.average = sum(self.n.values()) / len(self.n)
        self.lists = defaultdict(list)
        for i, bag in self.bags.items():
            for w, c in bag.items():
                self.lists[w].append((i, c))

    def scores(self, seed: int) -> dict[int, float]:
        out: dict[int, float] = defaultdict(float)
        for w in self.bags[seed]:
            weight = math.log(1 + (len(self.n) - len(self.lists[w]) + 0.5) / (len(self.lists[w]) + 0.5))
            for i, c in self.lists[w]:
                out[i] += weight * c * (packing.K1 + 1) / (c + packing.K1 * (1 - packing.B + packing.B * self.n[i] / self.average))
        out.pop(seed)
        return {i: round(s, 3) for i, s in out.items()}

    def pack(self, window: int, every: int, depth: int) -> set[tuple]:
        left = {i: n % window for i, n in self.n.items() if n % window}
        seeds = sorted(i for i in left if i % every == 0)
        found = {s: self.scores(s) for s in seeds}
        ranked = {s: [d for d in sorted(found[s], key=lambda d: (-found[s][d], d)) if d in left][:depth] for s in seeds}
        windows, space, unused = {s: [s] for s in seeds}, {s: window - left[s] for s in seeds}, set(left) - set(seeds)
        while True:
            offers = defaultdict(list)
            for d in unused:
                wanted = [s for s in seeds if d in ranked[s] and left[d] <= space[s]]
                if wanted:
                    offers[min(wanted, key=lambda s: (-found[s][d], s))].append(d)
            if not offers:
                break
            for s, own in offers.items():
                for d in sorted(own, key=lambda d: (-found[s][d], d)):
                    if left[d] <= space[s]:
                        windows[s].append(d)
                        space[s] -= left[d]
                        unused.discard(d)
        for s in seeds + sorted(left, key=lambda i: (-left[i], i)):
            if s not in windows:
                if s not in unused:
                    continue
                unused.discard(s)
                windows[s], space[s] = [s], window - left[s]
            scores = self.scores(s)
            for d in sorted(unused & set(scores), key=lambda d: (-scores[d], d)):
                if left[d] <= space[s]:
                    windows[s].append(d)
                    space[s] -= left[d]
                    unused.discard(d)
        return {tuple(sorted(w)) for w in windows.values()} | {(i,) * (n // window) for i, n in self.n.items() if n >= window}


def test_packing_matches_a_plain_model(spark, corpus):
    texts = {i: t for i, t in corpus[1].items() if list(corpus[1].values()).index(t) == list(corpus[1]).index(i)}  # equal texts tie but for rounding
    docs, wanted = docs_of(spark, [(i, t, "en", "a") for i, t in texts.items()]), _Plain(texts).pack(300, 4, 6)
    for queries in (packing.QUERIES, 7):  # one block or several
        windows, whole = defaultdict(list), defaultdict(int)
        for r in packing.pack(spark, docs, window=300, shard=1000, every=4, depth=6, queries=queries).collect():
            if r.window.startswith("whole"):
                whole[r.doc_id] += 1
            else:
                windows[r.window].append(r.doc_id)
        assert {tuple(sorted(w)) for w in windows.values()} | {(i,) * k for i, k in whole.items()} == wanted


def test_neighbours_are_those_of_the_whole_corpus(spark):
    """Recall of the ten best against plain BM25 over all documents, for every seed."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    plain = _Plain({r.doc_id: r.text for r in docs.filter("text is not null").collect()})
    scratch = Scratch(spark)
    n, average, df, by_term = packing.corpus_statistics(docs, scratch)
    weights = spark.sparkContext.broadcast(packing.idf(n, df))
    rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(packing._index(weights), packing.TERMS), "terms")
    hits = packing.search(spark, rows, rows.filter("doc_id % 50 = 0"), by_term, n, average, scratch=scratch)
    found = defaultdict(set)
    for r in hits.join(rows.select(F.col("row").alias("seed"), F.col("doc_id").alias("seed_id")), "seed").collect():
        found[r.seed_id].add(r.doc_id)
    recall = []
    for seed in (i for i in plain.n if i % 50 == 0):
        scores = plain.scores(seed)
        best = sorted(scores, key=lambda d: (-scores[d], d))[:10]
        recall.append(sum(d in found[seed] for d in best) / len(best))
    assert len(recall) == 200 and np.mean(recall) >= 0.99


def _searched(spark, docs, monkeypatch, depth=4):
    """Seeds' neighbours, and the rows that the tasks of the search sent."""
    sent, keep = [], Scratch.keep

    def spy(self, df, name):
        out = keep(self, df, name)
        if name == "hits":
            sent.append(out.count())
        return out

    with monkeypatch.context() as m:
        m.setattr(Scratch, "keep", spy)
        scratch = Scratch(spark)
        n, average, df, by_term = packing.corpus_statistics(docs, scratch)
        weights = spark.sparkContext.broadcast(packing.idf(n, df))
        rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(packing._index(weights), packing.TERMS), "terms")
        hits = packing.search(spark, rows, rows.filter("doc_id % 50 = 0"), by_term, n, average, depth=depth, scratch=scratch)
        ids = rows.select(F.col("row").alias("seed"), F.col("doc_id").alias("seed_id"))
        return sorted((r.seed_id, r.doc_id, r.score) for r in hits.join(ids, "seed").collect()), sum(sent)


def test_what_a_search_sends_does_not_grow_with_its_tasks(spark, monkeypatch):
    """Every task used to send depth rows for each seed, which made hits grow as tasks x seeds: 16 x 32 x 4 rows here."""
    rng = random.Random(31)
    docs = docs_of(spark, [(i, prose(rng, rng.randrange(20, 60)), "en", "a") for i in range(800)]).select("doc_id", "text")
    wanted, _ = _searched(spark, docs.coalesce(1), monkeypatch)  # in one part, of one task
    monkeypatch.setattr(packing, "FIRST", 20, raising=False)
    monkeypatch.setattr(packing, "STEP", 4, raising=False)
    docs.repartition(32).write.parquet(path := f"{Scratch(spark).base}/many")
    was, cost = 16 * 32 * 4, spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
    try:
        found, sent = _searched(spark, spark.read.parquet(path), monkeypatch)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert len(found) == 16 * 4 and found == wanted
    assert sent < was / 2


def test_copies_of_a_row_are_neighbours_each(spark, monkeypatch):
    rng = random.Random(32)
    rows = [(i, prose(rng, 40), "en", "a") for i in range(1, 301)]
    rows += [r for r in rows if r[0] % 3 == 0 for _ in range(2)]
    docs = docs_of(spark, rows).select("doc_id", "text").coalesce(1)
    plain = _Plain(dict(enumerate(t for _, t, *_ in rows)))
    wanted = []
    for k, (seed, *_) in enumerate(rows):
        if seed % 50 == 0:
            scores = {d: s for d, s in plain.scores(k).items() if rows[d][0] != seed}
            best = sorted(scores, key=lambda d: (-scores[d], rows[d][0], d))[:8]
            wanted += [(seed, rows[d][0]) for d in best]
    for first in (packing.FIRST, 100):
        monkeypatch.setattr(packing, "FIRST", first)
        found, _ = _searched(spark, docs, monkeypatch, depth=8)
        assert [(a, b) for a, b, _ in found] == sorted(wanted)


def test_statistics_are_of_the_whole_corpus(spark, corpus):
    docs, texts = corpus
    n, average, df, by_term = packing.corpus_statistics(docs, Scratch(spark))
    assert n == len(texts) and abs(average - np.mean([len(tokens(t)) for t in texts.values()])) < 1e-9
    _, _, term, _ = packing._terms(list(texts.values()))
    assert (df == np.bincount(term >> 12, minlength=packing.COUNTERS)).all()
    assert {r.term: r.df for r in by_term.collect()} == Counter(term.tolist())


def test_packing_reads_each_text_once(spark, corpus):
    """Texts used to be split into words twice, for the document frequencies and for the index."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    docs = corpus[0].select("doc_id", "text").mapInArrow(count, "doc_id long, text string")
    assert packing.pack(spark, docs, window=256, shard=32, every=4, depth=6).count() >= len(corpus[1])
    assert read.value == len(corpus[1])


def test_statistics_of_bags_are_those_of_their_texts(spark, corpus, hard):
    for docs in (corpus[0], hard):
        scratch = Scratch(spark)
        bags = docs.filter("text is not null").withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInArrow(packing._bags, packing.BAGS)
        one, two = (packing.corpus_statistics(x, scratch) for x in (docs, bags))
        assert one[:2] == two[:2] and (one[2] == two[2]).all() and sorted(one[3].collect()) == sorted(two[3].collect())


def test_split_shards_are_the_same_either_way(spark, corpus):
    sets = [sorted(map(str, packing.pack(spark, corpus[0], shard=4, broadcast_shards=n).collect())) for n in (0, 1000)]
    assert sets[0] == sets[1]


def test_packing_brings_related_documents_together(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 30) + " " + " ".join(f"topic{i % 50}word{k}" for k in range(30)), "en", "a") for i in range(400)]
    windows = defaultdict(list)
    for r in packing.pack(spark, docs_of(spark, rows), window=256, shard=64).collect():
        windows[r.window].append(r.doc_id % 50)
    together = np.mean([len(set(w)) < len(w) for w in windows.values() if len(w) > 1])
    assert together > 0.6


def test_stages_on_hard_cases(spark, hard, nothing):
    for docs in (hard, nothing):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, "unused")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert rows.columns == docs.columns, name
            rows.count()


def test_the_pipeline_is_its_stages(spark):
    """run() against each stage's plain version: what classify() accepts, least ids of groups, redacted texts, and windows of the mix's words."""
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    content = langid.dictionaries(docs)
    wanted = {r.doc_id for r in langid.classify(docs, content).filter("accepted").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in wanted}
    near = {r.doc_id for r in bagminhash.near_duplicates(spark, docs.filter(F.col("doc_id").isin(sorted(wanted)))).collect()}
    stayed = {i: t for i, t in texts.items() if i not in near}
    clean = {i: spark.createDataFrame([(t,)], "text string").select(secrets.redacted(F.col("text"))).first()[0] if "AKIA" in t or "oken" in t or "assw" in t else t for i, t in stayed.items()}
    rows = corpus_pipeline.run(spark, folder).collect()
    packed = Counter()
    for r in rows:
        packed[r.doc_id] += r.n_tokens
    assert set(packed) <= set(stayed) and set(packed) == {i for i, t in clean.items() if tokens(t)}
    assert all(packed[i] % len(tokens(clean[i])) == 0 for i in packed)
