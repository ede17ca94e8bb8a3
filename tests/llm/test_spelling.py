"""Near words and their groups against brute force."""

import random
import zlib
from collections import Counter

import pytest

from barline.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(p != q for p, q in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def some_words(letters, n, longest, seed=3):
    rng = random.Random(seed)
    found = {}
    while len(found) < n:
        word = "".join(rng.choice(letters) for _ in range(rng.randint(5, longest)))
        found[word] = rng.randint(3, 40)
    return found


@pytest.mark.parametrize("hot", [1, 30, spelling.HOT])
@pytest.mark.parametrize("letters, longest", [("ab", 8), ("abcé", 7), ("aÿ", 11)])
def test_pairs_are_those_of_all_comparisons(spark, letters, longest, hot):
    words = some_words(letters, 220, longest)
    pairs = spelling.near_pairs(spark.createDataFrame(list(words.items()), "word string, n bigint"), hot).collect()
    met = [frozenset((r.x, r.y)) for r in pairs]
    assert len(met) == len(set(met))
    assert set(met) == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert all(words[r.x] == r.xn and words[r.y] == r.yn for r in pairs)


def test_a_prefix_shared_by_all_words_is_split(spark, monkeypatch):
    words = {f"commonbeginning{k:04d}".translate(str.maketrans("0123456789", "abcdefghij")): 3 for k in range(1500)}
    monkeypatch.setattr(spelling, "SMALL", 0)
    pairs = spelling.near_pairs(spark.createDataFrame(list(words.items()), "word string, n bigint"), 500)
    assert pairs.count() == sum(one_edit(a, b) for a in words for b in words if a < b)


def test_forms_and_roots(spark):
    words = {"colour": 100, "color": 40, "colors": 20, "colorx": 9, "colouur": 3, "other": 5, "othen": 5, "lonely": 4, "cplour": 50}
    rows = {r.word: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()}
    assert {w: (r.form, r.root, r.n_near) for w, r in rows.items()} == {
        "colour": (None, "colour", 3), "color": ("colour", "colour", 3), "colors": ("color", "colour", 2), "colorx": ("color", "colour", 2),
        "colouur": ("colour", "colour", 1), "other": (None, "other", 1), "othen": (None, "othen", 1), "lonely": (None, "lonely", 0),
        "cplour": ("colour", "colour", 1),
    }
    assert rows["color"].form_n == 100 and rows["other"].form_n is None


def test_long_chains_reach_their_root(spark):
    chain = [chr(97 + k % 26) * 5 + "z" * k for k in range(12)]
    forms = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {chain[-1]}


def test_words_and_planted_deletions(spark):
    rng = random.Random(1)
    texts = [(k, " ".join(rng.choice(["Straße", "ÉCOLE", "naïve", "a1plus", "x×y÷zzz", "Zürich-see", "tiny"]) for _ in range(300))) for k in range(30)]
    texts += [(None, "Null-null nulls " * 50), (99, None), (100, "")]
    want = Counter()
    for doc_id, text in texts:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                want[run] += 1
                run = ""
    got = spelling.vocabulary(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r.word: r.n for r in got} == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
