"""A quality classifier from weak labels.

Nine overlapping heuristics vote good, bad or nothing on every document. The counts of all vote
patterns over all documents (at most 3**9 rows) go to expectation-maximisation, which estimates
each heuristic's votes given a good or a bad document, and so every pattern's posterior. The
posteriors of a bounded sample train a linear scorer on hashed features of word forms, which
judges every document by its own text and not by the heuristics' thresholds.

Null and empty texts get the votes of an empty text. An empty table gives no rows; nothing is
learned from it. Repeated rows count as often as they come and get equal scores. Other columns,
labels among them, are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytes_of_text import LOWER, WHITE, mix, per_row_key, seeded, span_hashes, words
from .common import documents, map_texts, per_row
from .quality_rules import judge

LABELLERS = ("length", "symbols", "repetition", "lines", "capitals", "separators", "marks", "word_length", "variety")
#: About how many documents the scorer learns from, chosen by a hash of their texts.
SAMPLE = 12_000
BITS, EPOCHS, RATE, L2 = 12, 300, 0.5, 1e-5
ROUNDS, KEEP = 200, 0.5


def _judged(values, bad, good):
    """1 for good, 2 for bad, 0 for no vote."""
    return np.where(bad, 2, np.where(good, 1, 0)).astype(np.int64) + 0 * values


def _forms(data, offsets):
    """Per word: its start, end, row and whether it is in capitals, ends in a run of marks, is a lone sign."""
    starts, ends, rows = words(data, offsets, WHITE)
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 0x41) & (data <= 0x5A), out=upper[1:])
    small = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80), out=small[1:])
    capitals = (upper[ends] - upper[starts] >= 2) & (small[ends] == small[starts])
    size = ends - starts
    last = data[ends - 1] if len(ends) else data[:0]
    marked = (size >= 2) & np.isin(last, list(b"!?#*$%&<>|")) & (data[np.maximum(ends - 2, 0)] == last) if len(ends) else size > 0
    lone = (size == 1) & (upper[ends] == upper[starts]) & (small[ends] == small[starts])
    return starts, ends, rows, capitals, marked, lone


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x LABELLERS votes."""
    n = len(offsets) - 1
    measures, _ = judge(data, offsets)
    n_words, chars, symbols, dup_lines, repeats, lines, failed_lines, kept_chars = measures
    starts, ends, rows, capitals, marked, lone = _forms(data, offsets)
    lower = LOWER[data]
    _, first = np.unique(per_row_key(span_hashes(lower, starts, ends), rows), return_index=True)
    distinct = per_row(np.ones(len(first)), rows[first], n)
    n_capitals, n_marked, n_lone = (per_row(x, rows, n) for x in (capitals, marked, lone))
    some = np.maximum(n_words, 1)
    return np.stack([
        _judged(n_words, n_words < 20, n_words >= 40),
        _judged(symbols, 10 * symbols > chars, 100 * symbols <= chars),
        _judged(repeats, 10 * repeats > 3 * n_words, 100 * repeats <= n_words),
        _judged(lines, 2 * kept_chars < chars, 10 * kept_chars >= 9 * chars),
        _judged(n_capitals, 2 * n_capitals > n_words, 10 * n_capitals <= n_words),
        _judged(n_lone, 5 * n_lone >= some, 50 * n_lone <= n_words),
        _judged(n_marked, 10 * n_marked >= 3 * some, 50 * n_marked <= n_words),
        _judged(chars, (chars < 2 * n_words) | (chars > 15 * some), (chars >= 3 * n_words) & (chars <= 12 * some)),
        _judged(distinct, (10 * distinct < 2 * n_words) & (n_words >= 50), 10 * distinct >= 4 * n_words),
    ], axis=1)


_PLACES = 3 ** np.arange(len(LABELLERS), dtype=np.int64)


def label_model(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of a good document for each pattern (patterns x labellers), vote tables, and the prior.

    Votes are taken as independent given the class. Classes are named by the heuristics: the first
    round starts from the share of good among a pattern's votes.
    """
    good, bad = (patterns == 1).sum(axis=1), (patterns == 2).sum(axis=1)
    posterior = (good + 1) / (good + bad + 2)
    posterior = np.where(2 * bad >= good, np.minimum(posterior, 0.5), np.maximum(posterior, 0.5))
    weight = counts / max(counts.sum(), 1)
    tables, prior = np.zeros((2, patterns.shape[1], 3)), 0.5
    for _ in range(ROUNDS):
        shares = (posterior, 1 - posterior)
        for c, share in enumerate(shares):
            mass = weight * share
            for v in range(3):
                tables[c, :, v] = ((patterns == v) * mass[:, None]).sum(axis=0)
        tables = (tables + 1e-4) / (tables + 1e-4).sum(axis=2, keepdims=True)
        prior = float(np.clip((weight * posterior).sum(), 1e-4, 1 - 1e-4))
        at = np.arange(patterns.shape[1])[None, :]
        logs = np.log(tables[0][at, patterns]).sum(axis=1) - np.log(tables[1][at, patterns]).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(logs + np.log(prior / (1 - prior)), -60, 60)))
        if np.abs(new - posterior).max() < 1e-9:
            return new, tables, prior
        posterior = new
    return posterior, tables, prior


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x 2**BITS shares of hashed word forms."""
    n, size = len(offsets) - 1, 1 << BITS
    starts, ends, rows, capitals, marked, lone = _forms(data, offsets)
    lower = LOWER[data]
    keys = span_hashes(lower, starts, ends)
    length = np.minimum(ends - starts, 20)
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (rows[1:] == rows[:-1])
    seen = np.ones(len(keys), bool)
    _, first = np.unique(per_row_key(keys, rows), return_index=True)
    seen[first] = False
    form = capitals * 1 + marked * 2 + lone * 4 + same * 8
    last = data[ends - 1].astype(np.int64) if len(ends) else length
    n_words = per_row(np.ones(len(rows)), rows, n)
    out = np.zeros((n, size), np.float32)
    flat, share = out.reshape(-1), (1 / np.maximum(n_words, 1))[rows]
    for k, values in enumerate((form, form * 32 + length, last, seen * 1 + same * 2)):
        hashed = mix(values.astype(np.uint64) ^ seeded(60 + k, 1)[0]) >> np.uint64(64 - BITS)
        np.add.at(flat, rows * size + hashed.astype(np.int64), share)
    # the text's length in powers of two, and that a text has no word at all
    scale = np.floor(np.log2(np.maximum(n_words, 1))).astype(np.uint64) + (n_words > 0).astype(np.uint64)
    hashed = mix(scale ^ seeded(70, 1)[0]) >> np.uint64(64 - BITS)
    out[np.arange(n), hashed.astype(np.int64)] += 1
    return out


def fit(x: np.ndarray, posterior: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for soft labels, by accelerated gradient steps on used columns."""
    weights = np.zeros(x.shape[1], np.float32)
    if not len(x):
        return weights, 0.0
    used = np.flatnonzero((x != 0).any(axis=0))
    z = x[:, used].astype(np.float64)
    scale = np.sqrt((z**2).mean(axis=0)) + 1e-3
    z /= scale
    w, b = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, EPOCHS + 1):
        off = 1 / (1 + np.exp(-np.clip(z @ w + b, -60, 60))) - posterior
        grad = np.append(z.T @ off / len(z) + L2 * w, off.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE / np.sqrt(step) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights[used] = w / scale
    return weights, float(b)


def _codes(data, offsets):
    return [votes(data, offsets) @ _PLACES]


def _used_features(data, offsets):
    x = features(data, offsets)
    places = [np.flatnonzero(row) for row in x]
    return [
        votes(data, offsets) @ _PLACES,
        pa.array([at.astype("<u2").tobytes() for at in places], pa.binary()),
        pa.array([row[at].tobytes() for row, at in zip(x, places)], pa.binary()),
    ]


def learn(docs: DataFrame):
    """Posterior by vote pattern code, and the scorer's weights and bias."""
    found = map_texts(docs, _codes, "code bigint", ()).groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()
    codes = np.array([r.code for r in found], np.int64)
    counts = np.array([r.n for r in found], np.float64)
    if not len(codes):
        return {}, np.zeros(1 << BITS, np.float32), 0.0
    posterior, _, _ = label_model(codes[:, None] // _PLACES[None, :] % 3, counts)
    by_code = dict(zip(codes.tolist(), posterior.tolist()))
    share = int(1_000_000 * min(1.0, SAMPLE / counts.sum()))
    sample = docs.where(F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit("sample")), F.lit(1_000_000)) < share)
    fields = "code bigint, places binary, shares binary"
    rows = sorted(map_texts(sample, _used_features, fields, ()).collect(), key=lambda r: (r.places, r.shares))
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for line, r in zip(x, rows):
        line[np.frombuffer(r.places, "<u2")] = np.frombuffer(r.shares, np.float32)
    return by_code, *fit(x, np.array([by_code[r.code] for r in rows]))


def score(docs: DataFrame, by_code: dict, weights: np.ndarray, bias: float, keep=("doc_id",), column="text") -> DataFrame:
    """Columns `keep`, the vote pattern (a digit per labeller), its posterior, the score and the verdict."""

    def run(data, offsets):
        cast = votes(data, offsets)
        codes = cast @ _PLACES
        # summed row by row in a fixed order, so that equal texts get equal scores
        total = (features(data, offsets) * weights).sum(axis=1, dtype=np.float64) + bias
        patterns = ["".join(map(str, row)) for row in cast.tolist()]
        return [patterns, np.array([by_code.get(c, 0.5) for c in codes.tolist()]), 1 / (1 + np.exp(-np.clip(total.astype(float), -60, 60)))]

    scored = map_texts(docs, run, "votes string, posterior double, score double", keep, column)
    return scored.withColumn("kept", F.col("score") >= KEEP)


def op10_weak_quality(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, *learn(docs))
