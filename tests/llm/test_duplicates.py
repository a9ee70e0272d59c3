"""Near duplicates and fingerprints against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lodespark.llm import bagminhash, simhash
from lodespark.llm.common import table
from lodespark.llm.textkeys import word_hashes

from .conftest import docs_of, jaccard, prose, shingles, tokens


def _groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes if find(n) != n}


def test_near_duplicates_match_all_pairs(spark, corpus):
    docs, texts = corpus
    bags = {i: shingles(t, bagminhash.SHINGLE) for i, t in texts.items()}
    pairs = [(a, b) for a in bags for b in bags if a < b and jaccard(bags[a], bags[b]) >= bagminhash.THRESHOLD]
    found = {r.doc_id: r.keeper for r in bagminhash.near_duplicates(spark, docs).collect()}
    wanted = _groups(pairs, bags)
    assert found == wanted  # whole groups and their keepers; the bands miss no group of this corpus
    assert found == {r.doc_id: r.keeper for r in bagminhash.near_duplicates(spark, docs, local=0).collect()}
    kept = {r.doc_id for r in bagminhash.drop_near_duplicates(spark, docs).collect()}
    assert kept == set(texts) - set(found)


def test_signatures_estimate_the_weighted_overlap():
    rng, texts = random.Random(3), []
    for share in (0.2, 0.5, 0.8):
        a = prose(rng, 200).split()
        b = [w if rng.random() < share else rng.choice(("zz", "yy", "xx")) for w in a]
        texts += [" ".join(a * 3), " ".join(b * 2)]
    doc, elem, weight = bagminhash._bags(texts, 1)
    sig = bagminhash.signatures(doc, elem, weight, len(texts), 2048)
    for k in range(0, len(texts), 2):
        true = jaccard(shingles(texts[k], 1), shingles(texts[k + 1], 1))
        assert abs(float(np.mean(sig[k] == sig[k + 1])) - true) < 0.05


def test_near_duplicates_of_hard_cases(spark, hard, nothing):
    found = {r.doc_id: r.keeper for r in bagminhash.near_duplicates(spark, hard).collect()}
    assert found == {2: 1, 8: 7}
    kept = bagminhash.drop_near_duplicates(spark, hard)
    assert kept.columns == hard.columns and kept.filter("doc_id is null").count() == 2
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13]
    assert bagminhash.near_duplicates(spark, nothing).count() == 0 == bagminhash.drop_near_duplicates(spark, nothing).count()


def test_a_document_of_several_texts_joins_their_groups(spark):
    rng = random.Random(21)
    one, two, three = (prose(rng, 60) for _ in range(3))
    rows = [(1, one, "en", "a"), (1, two, "en", "a"), (2, one + " extra", "en", "a"), (3, two + " extra", "en", "a"), (4, three, "en", "a")]
    assert {(r.doc_id, r.keeper) for r in bagminhash.near_duplicates(spark, docs_of(spark, rows)).collect()} == {(2, 1), (3, 1)}
    rows = [(5, one, "en", "a"), (5, two, "en", "a"), (6, two + " extra", "en", "a"), (7, one + " more", "en", "a"), (7, three + " more", "en", "a"), (2, three, "en", "a")]
    assert {(r.doc_id, r.keeper) for r in bagminhash.near_duplicates(spark, docs_of(spark, rows)).collect()} == {(5, 2), (6, 2), (7, 2)}


@pytest.mark.parametrize("local", [0, 1000])
def test_components_match_union_find(spark, local):
    from lodespark.llm.common import Scratch

    rng = random.Random(22)
    pairs = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(50)] + [(300, 300 + k) for k in range(30)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    found = {r.node: r.root for r in bagminhash.components(Scratch(spark), edges, local=local).collect()}
    assert found == _groups(pairs, {x for p in pairs for x in p})


def test_many_copies_are_one_group(spark):
    rows = [(i, "the very same words in every copy of it", "en", "a") for i in range(2000)]
    found = bagminhash.near_duplicates(spark, docs_of(spark, rows)).collect()
    assert len(found) == 1999 and {r.keeper for r in found} == {0}


def test_a_lost_folder_is_refused_on_a_cluster(spark, monkeypatch):
    from lodespark.llm import common

    class Context:
        master = "spark://somewhere"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_fingerprints_within_the_radius(spark, corpus, radius):
    docs, _ = corpus
    prints = {r.doc_id: r.fingerprint & (2**64 - 1) for r in simhash.simhash(docs).collect()}
    least = {}
    for i in sorted(prints):
        least.setdefault(prints[i], i)
    reps = sorted(least.values())
    wanted = {(a, b, (prints[a] ^ prints[b]).bit_count()) for a in reps for b in reps if a < b and (prints[a] ^ prints[b]).bit_count() <= radius}
    wanted |= {(least[p], i, 0) for i, p in prints.items() if least[p] != i}
    found = [tuple(r) for r in simhash.within_radius(spark, docs, radius=radius).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


@pytest.mark.parametrize("radius", [3, 12])
def test_links_of_every_document(spark, corpus, hard, nothing, radius):
    """A row for each document, so that rows grow as the documents do and not as their pairs."""
    for docs in (corpus[0], hard):
        prints = {(r.doc_id, r.fingerprint & (2**64 - 1)) for r in simhash.simhash(docs).collect()}
        fps = {p for _, p in prints}
        wanted = {(i, p, min(j for j, o in prints if o == p), sum(o != p and (o ^ p).bit_count() <= radius for o in fps)) for i, p in prints}
        found = [(r.doc_id, r.fingerprint & (2**64 - 1), r.class_id, r.links) for r in simhash.linked(spark, docs, radius=radius).collect()]
        assert len(found) == len(wanted) and set(found) == wanted
        assert docs is hard or any(r[3] for r in found)
    assert simhash.linked(spark, nothing, radius=radius).count() == 0


def test_texts_of_one_id_are_linked(spark):
    """Classes of one least doc_id: the pairs of representatives had no link between them."""
    words = prose(random.Random(13), 200).split()
    one, two = " ".join(words), " ".join(["changed", *words[1:]])
    rows = [(1, one, "en", "a"), (1, two, "en", "a"), (2, one, "en", "a"), (3, two, "en", "a")]
    found = sorted((r.doc_id, r.class_id, r.links) for r in simhash.linked(spark, docs_of(spark, rows)).collect())
    assert found == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_the_query_has_a_row_for_each_document(spark):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    found = simhash.op8_simhash(spark, folder).collect()
    assert len(found) == simhash.simhash(docs).distinct().count()
    fps, classes = {r.fingerprint for r in found}, {(r.fingerprint, r.class_id) for r in found}
    assert len(fps) == len(classes)
    links = {r.fingerprint: r.links for r in found}
    assert sum(links.values()) == 2 * sum(r.distance > 0 for r in simhash.within_radius(spark, docs).collect())


def test_edited_copies_are_found(spark):
    """One word in 50 changed: most of the copies' fingerprints differ by more than 3 bits."""
    rng = random.Random(12)
    rows = []
    for i in range(100):
        words = prose(rng, 200).split()
        copy = [f"edited{i}x{k}" if k % 50 == 25 else w for k, w in enumerate(words)]
        rows += [(i, " ".join(words), "en", "a"), (1000 + i, " ".join(copy), "en", "a")]
        assert jaccard(shingles(rows[-2][1], 3), shingles(rows[-1][1], 3)) >= 0.5
    found = {(r.doc_a, r.doc_b) for r in simhash.within_radius(spark, docs_of(spark, rows)).collect()}
    assert sum((i, 1000 + i) in found for i in range(100)) >= 95
    assert all(b == 1000 + a for a, b in found)


def test_a_fingerprint_is_the_vote_of_its_terms():
    text = "a b c a b d"
    offsets, hashes = word_hashes([text])
    _, (fp,) = simhash.fingerprints(offsets, hashes)
    votes = [sum(1 if int(h) >> b & 1 else -1 for h in hashes) for b in range(64)]
    assert int(fp) == sum(1 << b for b in range(64) if votes[b] > 0)


def test_fingerprints_of_hard_cases(spark, hard, nothing):
    found = {tuple(r) for r in simhash.within_radius(spark, hard).collect()}
    assert (1, 2, 0) in found and not any(i in pair[:2] for pair in found for i in (3, 4, 5, 6, None))
    assert simhash.within_radius(spark, nothing).count() == 0


def test_words_are_hashed_alike_wherever_they_stand():
    rng = random.Random(1)
    short, long = prose(rng, 50), prose(rng, 300_000)
    offsets, hashes = word_hashes([short, None, "", long, "x" * 3_000_000, short])
    assert np.diff(offsets).tolist() == [50, 0, 0, 300_000, 1, 50]
    by_word = {}
    for w, h in zip(tokens(short) + tokens(long), [*hashes[:50], *hashes[50:300_050]], strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word) and (hashes[:50] == hashes[-50:]).all()
