"""Trees of several widths and chunk heights against a recursive brute force."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from barline.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def top(nodes, width, paths):
    """The remaining node; `paths` of each leaf get [(left siblings, right siblings)]."""
    owners = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, above_owners = [], []
        for first in range(0, len(nodes), width):
            run = nodes[first : first + width]
            for slot in range(len(run)):
                for k in owners[first + slot]:
                    paths[k].append((run[:slot], run[slot + 1 :]))
            above.append(h(*run))
            above_owners.append([k for o in owners[first : first + width] for k in o])
        nodes, owners = above, above_owners
    return nodes[0]


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    values = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute(rows, tampered, width):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    held, paths = {}, {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        paths[lang] = [[] for _ in mine]
        held[lang] = mine, top([leaf(r) for r in mine], width, paths[lang])
    upper = [[] for _ in langs]
    root = top([held[lang][1] for lang in langs], width, upper)
    out = []
    for place, lang in enumerate(langs):
        mine, subroot = held[lang]
        for k, row in enumerate(mine):
            path = paths[lang][k] + upper[place]
            digest = leaf(row, 1 if tampered(row[0]) else 0)
            for left, right in path:
                digest = h(*left, digest, *right)
            out.append((row[0], leaf(row), subroot, root, h(*(s for left, right in path for s in left + right)), digest, digest == root))
    return out


def some_rows(n, langs, seed=2):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 10 * n), "text é " * rng.randint(0, 5), rng.choice(langs), rng.choice([None, "web", ""]), rng.choice([None, 5])) for _ in range(n)]
    return rows + rows[:3] + [(None, None, None, None, None), (None, "x", langs[0], "s", 1)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("n, langs, width, levels", [
    (300, ["en", "de", None, "fr", "", "日"], 2, 3), (200, ["en"], 2, 2), (150, ["en", "xx"], 3, 2), (60, ["a", "b"], 2, 12), (40, list("abcdefghijklmnop"), 2, 2),
])
def test_trees(spark, n, langs, width, levels):
    rows = some_rows(n, langs)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.manifest(docs, F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)), width, levels).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, lambda i: i is not None and i % 3 == 0, width), key=repr)


def test_single_row_and_unbroadcast_offsets(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SMALL", 0)
    for rows in ([(7, "x", "en", "web", 1)], some_rows(50, ["en", "de"])):
        got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), F.lit(False), 2, 2).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, lambda i: False, 2), key=repr)
        assert all(r.verified for r in got)


def test_a_fold_hashes_only_the_child_and_what_lies_right_of_it(monkeypatch):
    digests = [h(str(k)).encode() for k in range(11)]
    nodes, states = merkle.build(digests, merkle.height(11, 4), 4)
    monkeypatch.setattr(merkle, "hashlib", None)  # no state is begun anew
    assert all(merkle.fold(nodes, states, k, digests[k], 4) == nodes[-1][0] for k in range(11))
    assert merkle.fold(nodes, states, 5, digests[6], 4) != nodes[-1][0]
