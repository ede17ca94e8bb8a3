"""The stages against a brute-force version written without Spark."""

import hashlib
import math
import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from barline.llm.bpe import tokenizer_path
from barline.llm.common import documents
from barline.llm.personal_data import find_spans, masked
from barline.llm.quality_rules import PHRASES
from barline.llm.storage import stored

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGE = dict(corpus_pipeline.STAGES)


def clean(text):
    """Text of the lines that pass, or None for a document that goes."""
    lines, seen, kept, total, left = text.split("\n"), set(), [], 0, 0
    for line in lines:
        words = WORD.findall(line)
        if not words:
            kept.append(line)
            continue
        chars = sum(map(len, words))
        bad = line in seen or len(words) <= 30 and any(p in re.sub("[A-Z]", lambda m: m[0].lower(), line) for p in PHRASES)
        bad |= 4 * sum(w in ("|", ">", "/") for w in words) >= len(words) or 10 * sum(c in "#*$%&|<>" for c in line) > chars
        bad |= 10 * sum(w.endswith(("!!", "??")) for w in words) >= 3 * len(words)
        bad |= len(words) < 3 and not words[-1].endswith((*".!?:;\"')]", "…", "”", "’", "»"))
        seen.add(line)
        total += chars
        if not bad:
            kept.append(line)
            left += chars
    words = WORD.findall(text)
    grams, covered = {}, set()
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in grams.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(8)}
    if len(words) < 20 or 100 * len(covered) > 30 * len(words) or 2 * left < total:
        return None
    return "\n".join(kept)


def groups(texts):
    """Smallest id of each text's group of near copies."""
    sets = {}
    for k, text in texts.items():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in sets}


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    below = p
    while below <= u:
        k += 1
        p *= rate / k
        below += p
    return k


def test_stages_equal_brute_force(spark):
    docs = documents(spark, SF, "*")
    rows = {r.doc_id: r for r in docs.collect()}
    texts = {k: t for k, r in rows.items() if (t := clean(r.text or "")) is not None}
    cleaned = stored(STAGE["quality rules"](spark, docs, SF))
    assert {r.doc_id: r.text for r in cleaned.collect()} == texts and cleaned.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in cleaned.collect())

    tops = groups(texts)
    texts = {k: t for k, t in texts.items() if tops[k] == k}
    unique = stored(STAGE["near duplicates"](spark, cleaned, SF))
    assert {r.doc_id: r.text for r in unique.collect()} == texts and unique.columns == docs.columns

    texts = {k: masked(t, find_spans(t)) for k, t in texts.items()}
    private = stored(STAGE["personal data"](spark, unique, SF))
    assert {r.doc_id: r.text for r in private.collect()} == texts and private.columns == docs.columns
    assert not any(find_spans(t) for t in texts.values())

    sources = [rows[k].source for k in texts]
    weight = {s: math.sqrt(sources.count(s)) for s in set(sources)}
    copies = {}
    for k in texts:
        s = rows[k].source
        rate = weight[s] / sum(weight.values()) * len(texts) / sources.count(s)
        copies[k] = poisson(int(hashlib.md5(f"17:{k}".encode()).hexdigest()[:13], 16) / 2**52, rate)
    mixed = stored(STAGE["mixing"](spark, private, SF))
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: n for k, n in copies.items() if n} and mixed.columns == docs.columns

    library = Tokenizer.from_file(tokenizer_path())
    for r in STAGE["encoding"](spark, mixed, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_unlike_texts_of_one_id_stay(spark):
    rng = np.random.default_rng(3)
    one, two = (" ".join(f"w{k}" for k in rng.integers(0, 5000, 60)) for _ in range(2))
    rows = [(1, one, "a", 1), (1, two, "a", 2), (1, one, "b", 3), (2, one, "a", 4), (3, two + " more", "a", 5), (None, one, "a", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _mix_rows int")
    kept = STAGE["near duplicates"](spark, docs, None).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, one), (1, two), (0, one)])
    mixed = STAGE["mixing"](spark, docs, None)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= set(rows)


def test_odd_rows(spark, odd, repeated, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{repeated}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs_after = stored(stage(spark, docs, repeated))
        if name != "encoding":
            assert docs_after.columns == docs.columns
        docs = docs_after
    assert corpus_pipeline.run(spark, odd).count() > 0
