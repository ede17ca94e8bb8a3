"""The methods' own parts: tiles, covers, labels, held-out accuracy."""

import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import near_dedup, nearest, suffix_dedup, toxicity, weak_quality
from barline.llm.common import documents, table
from barline.llm.storage import components

SF = "/root/testdata/sf0.1"


def removed(texts):
    seen, out = set(), {}
    for k, text in enumerate(texts):
        data, gone = text.encode(), set()
        for i in range(len(data) - 99):
            piece = data[i : i + 100]
            if piece in seen:
                gone |= set(range(i, i + 100))
            seen.add(piece)
        out[k] = len(gone)
    return out


@pytest.mark.parametrize("hot", [1, 2048])
def test_shared_passages_in_many_contexts(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcd efg") for _ in range(n))
    passages = [text(60), text(150), text(400)]
    texts = [text(rng.randint(0, 200)) + rng.choice(passages) + text(rng.randint(0, 200)) for _ in range(60)]
    texts += ["ab" * 200, "x" * 99, "x" * 100, "x" * 101, texts[0], texts[1] + texts[2]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df).collect()} == removed(texts)


def test_passage_in_unlike_documents_stays_out_of_one_group(spark, monkeypatch):
    original, limit = suffix_dedup._repeats, 16

    def watched(batches):
        sizes = {}

        def counted():
            for batch in batches:
                for key in batch.column(0).to_pylist():
                    sizes[key] = sizes.get(key, 0) + 1
                yield batch

        yield from original(counted())
        if sizes and max(sizes.values()) > limit:
            raise AssertionError(f"{max(sizes.values())} triples in one group")

    monkeypatch.setattr(suffix_dedup, "HOT", limit)
    monkeypatch.setattr(suffix_dedup, "_repeats", watched)
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    passage = text(180)
    texts = [text(rng.randint(100, 300)) + passage + text(rng.randint(100, 300)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df).collect()} == removed(texts)


def test_texts_without_doc_id_are_cut_one_by_one(spark):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(150)
    texts = [text(130 * k) + passage + text(900 - 130 * k) for k in range(4)]
    df = spark.createDataFrame([(None, t) for t in texts * 2], "doc_id bigint, text string").repartition(3)
    rows = suffix_dedup.remove_repeats(df).collect()
    assert all(r.doc_id is None and r.n_bytes == 1050 for r in rows)
    # the first of the texts keeps the passage, in both of its rows
    assert sorted(r.n_removed for r in rows)[:2] == [0, 0] and all(150 <= n < 160 for n in sorted(r.n_removed for r in rows)[2:])


def test_anchor_of_a_string_depends_on_the_string_alone():
    rng = random.Random(1)
    body = "".join(rng.choice("ab ") for _ in range(100)).encode()
    found = set()
    for lead in (b"", b"zzz", b"b" * 50):
        data = np.frombuffer(lead + body + b"q" * 7, np.uint8)
        _, _, place, shift, count = suffix_dedup.anchors(data, np.array([0, len(data)]))
        owner = [p for p, s, c in zip(place, shift, count) if p - s <= len(lead) < p - s + c]
        found.add(int(owner[0]) - len(lead))
    assert len(found) == 1


def near_copies():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    texts = []
    for k in range(90):
        copy = list(base)
        for _ in range(k // 9):
            copy[rng.randrange(120)] = word()
        texts.append(" ".join(copy))
    return texts


def test_crowded_group_of_near_copies(spark, monkeypatch):
    texts = near_copies()
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert [r.component_id for r in near_dedup.near_duplicates(df).orderBy("doc_id").collect()] == root


@pytest.mark.parametrize("percent", [80, 85])
def test_screens_lose_few_pairs_at_the_threshold(percent):
    by, p = near_dedup.screen(percent), percent / 100
    assert (1 - p**by.band) ** (140 // by.band) <= 1e-7
    below = sum(comb(140, k) * p**k * (1 - p) ** (140 - k) for k in range(by.least_equal))
    assert below <= 1e-6 < below + comb(140, by.least_equal) * p**by.least_equal * (1 - p) ** (140 - by.least_equal)


def test_pairs_between_two_thresholds(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(40):  # 196 shingles, 20 of them changed: 176 of 216 shared, 0.815
        base = [word() for _ in range(200)]
        copy = list(base)
        for place in (20, 60, 100, 140):
            copy[place] = word()
        texts += [" ".join(base), " ".join(copy)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for percent, step in ((80, 2), (85, 1)):
        got = [r.component_id for r in near_dedup.near_duplicates(df, percent).orderBy("doc_id").collect()]
        assert got == [k // step * step for k in range(80)]


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 4999), (4999, 5001)]
    random.Random(2).shuffle(links)
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint").repartition(7)).collect()}
    want = {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1100)} | {4999: 4999, 5000: 4999, 5001: 4999}
    assert got == want


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(2**63, size=600).astype(np.uint64)
    b = np.concatenate([a[:540], rng.integers(2**63, size=60).astype(np.uint64)])
    both = near_dedup.sketches(np.concatenate([a, b, a[:3]]), np.repeat([0, 1, 2], [600, 600, 3]), 3)
    assert (both != np.iinfo(np.uint64).max).all()
    assert abs((both[0] == both[1]).mean() - 540 / 660) < 0.12


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]),
            (7, []), (8, [float("inf"), 0.0]), (9, [1.0, 0.0, 0.0]), (20, [2.0, 1.0]), (20, [2.0, 1.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = nearest.nearest_neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [
        (0, 1, 20, 2.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0)]
    assert nearest.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_tiles_lose_nothing_to_quantisation():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 70)) * rng.lognormal(sigma=2, size=(3000, 1))
    ids = np.arange(3000)
    found = nearest.search_tile(ids[:40], vectors[:40], ids, vectors, 20)
    for q in range(40):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        assert {i for k, i, _ in found if k == q} == set(np.argsort(-scores)[:20].tolist())


def test_toxicity_on_held_out_rows(spark):
    scored = toxicity.toxicity(documents(spark, SF), table(spark, SF, "labels"))
    rows = scored.where("held_out").join(table(spark, SF, "labels"), "doc_id").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.65 * len(toxic)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * (len(rows) - len(toxic))


def test_weak_labels_agree_with_the_given_ones(spark):
    rows = weak_quality.op10_weak_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").collect()
    for quality in (0, 1):
        own = [r for r in rows if r.quality == quality]
        assert sum(r.kept == bool(quality) for r in own) >= 0.95 * len(own)
