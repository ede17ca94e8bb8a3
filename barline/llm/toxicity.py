"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; any text outside the held-out third is unlabelled. A
linear classifier on hashed features (distinct words and their leading 4, 5 and 6 bytes, ASCII
lower-cased) minimises prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]) with the
sigmoid loss: the negatives' risk is what the unlabelled risk leaves after the positives' share
is taken out, and is kept from falling below zero. The class prior is the toxic share of all
training labels. Training runs on the driver over a bounded sample; scoring runs in tasks.

Rows whose crc32(doc_id as text) mod 3 is 1 are held out: neither their labels nor their texts are
learned from. doc_id, lang, source and labels are no features. Null and empty texts have no
features and get the bias alone; without any positive every score is 0. A row without doc_id is
not held out and not labelled. Repeated rows get equal scores. Other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytes_of_text import LOWER, per_row_key, span_hashes, words
from .common import documents, map_texts, table

#: Bounds of the sample that is learned from, in texts (about, as hashes choose them).
POSITIVES, UNLABELLED = 4_000, 12_000
PREFIXES, LEAST_TEXTS, SCREEN = (4, 5, 6), 6, 6.0
EPOCHS, BATCH, RATE, L1 = 30, 512, 0.05, 1e-3
THRESHOLD, HELD_OUT = 0.7, 1
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers (32 bits of a hash) and their text numbers, texts in order."""
    lower = LOWER[data]
    starts, ends, rows = words(lower, offsets, _SEPARATOR)
    keys = span_hashes(lower, starts, ends)
    _, first = np.unique(per_row_key(keys, rows), return_index=True)
    starts, ends, rows, keys = starts[first], ends[first], rows[first], keys[first]
    found, owners = [keys], [rows]
    for size in PREFIXES:
        long = ends - starts >= size
        found.append(span_hashes(lower, starts[long], starts[long] + size, 50 + size))
        owners.append(rows[long])
    paired = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(32)) | (np.concatenate(found) >> np.uint64(32)))
    return paired.astype(np.uint32), (paired >> np.uint64(32)).astype(np.int64)


def _listed(data, offsets):
    numbers, owners = features(data, offsets)
    ends = np.searchsorted(owners, np.arange(len(offsets)))
    raw = numbers.astype("<u4")
    return [pa.array([raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _places(used: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each number would stand in the sorted `used`, and whether it stands there."""
    at = np.minimum(np.searchsorted(used, numbers), len(used) - 1)
    return at, used[at] == numbers


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """The features in use (sorted), their weights, and the bias; both lists hold each text's feature numbers."""
    if not positive or not unlabelled:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32), -np.inf
    # screening: only features whose share differs clearly between the two samples get a weight
    tallies = [np.unique(np.concatenate(part), return_counts=True) for part in (positive, unlabelled)]
    numbers = np.union1d(tallies[0][0], tallies[1][0])
    among, other = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    for count, (seen, times) in zip((among, other), tallies):
        count[np.searchsorted(numbers, seen)] = times
    share = (among + other) / (len(positive) + len(unlabelled))
    spread = np.sqrt(share * (1 - share) * (1 / len(positive) + 1 / len(unlabelled))) + 1e-12
    apart = np.abs(among / len(positive) - other / len(unlabelled)) / spread
    wide = (among + other >= LEAST_TEXTS) & (apart >= SCREEN)
    used = numbers[wide]
    del tallies, numbers, among, other, share, spread, apart, wide
    if not len(used):
        return used, np.zeros(0, np.float32), float(np.log(prior / (1 - prior)))
    texts = [at[hit] for part in (positive, unlabelled) for at, hit in (_places(used, t) for t in part)]
    sizes = np.array([len(t) for t in texts])
    column, ends = np.concatenate(texts), np.concatenate([[0], np.cumsum(sizes)])
    rng = np.random.default_rng(seed)
    w, b = np.zeros(len(used)), np.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0

    def scored(chosen):
        at = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in chosen]) if len(chosen) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(chosen)), sizes[chosen])
        return at, owner, np.bincount(owner, weights=w[column[at]], minlength=len(chosen)) + b

    n_p, n_u, step = len(positive), len(unlabelled), 0
    batches = max(1, -(-(n_p + n_u) // BATCH))
    for _ in range(EPOCHS):
        p_order, u_order = rng.permutation(n_p), rng.permutation(n_u) + n_p
        for k in range(batches):
            chosen_p, chosen_u = p_order[k::batches], u_order[k::batches]
            if not len(chosen_p):
                chosen_p = p_order[rng.integers(n_p, size=1)]
            if not len(chosen_u):
                continue
            at_p, owner_p, g_p = scored(chosen_p)
            at_u, owner_u, g_u = scored(chosen_u)
            s_p, s_u = _sigmoid(g_p), _sigmoid(g_u)
            # the loss l(g) = 1 - s is bounded, so no certain text outweighs the others; d/dg of l(-g) = s is s (1 - s)
            slope_p, slope_u = s_p * (1 - s_p) / len(g_p), s_u * (1 - s_u) / len(g_u)
            if s_u.mean() - prior * s_p.mean() >= 0:
                d_p, d_u = -2 * prior * slope_p, slope_u
            else:  # step back along the negative part alone
                d_p, d_u = prior * slope_p, -slope_u
            grad = np.bincount(column[at_p], weights=d_p[owner_p], minlength=len(used))
            grad += np.bincount(column[at_u], weights=d_u[owner_u], minlength=len(used))
            grad_b, step = d_p.sum() + d_u.sum(), step + 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            mb, vb = 0.9 * mb + 0.1 * grad_b, 0.999 * vb + 0.001 * grad_b**2
            scale = RATE / (1 - 0.9**step)
            w -= scale * m / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
            b -= scale * mb / (np.sqrt(vb / (1 - 0.999**step)) + 1e-6)
            w = np.sign(w) * np.maximum(np.abs(w) - RATE * L1, 0)
    return used, w.astype(np.float32), float(b)


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == HELD_OUT, F.lit(False))


def _chosen(name: str, bound: int, rows: float):
    """True for about `bound` of `rows` rows, chosen by a hash of their id."""
    return F.pmod(F.xxhash64(F.lit(name), "doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, bound / max(rows, 1))))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, weights and bias from the texts and labels outside the held-out third."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~_held_out())
    count = known.agg(F.count("*").alias("rows"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    if not count["toxic"]:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32), -np.inf
    prior = min(max(count["toxic"] / count["rows"], 1e-4), 0.9)
    positive = known.where("toxic = 1").where(_chosen("positive", POSITIVES, count["toxic"])).select("doc_id").distinct()
    open_docs = docs.where(~_held_out())
    total = open_docs.count()
    marked = (
        open_docs.join(F.broadcast(positive.withColumn("positive", F.lit(True))), "doc_id", "left")  # at most about POSITIVES ids
        .select("text", F.coalesce("positive", F.lit(False)).alias("positive"), _chosen("unlabelled", UNLABELLED, total).alias("unlabelled"))
        .where("positive OR unlabelled")
    )
    rows = map_texts(marked, _listed, "listed binary", ("positive", "unlabelled")).collect()
    read = lambda r: np.frombuffer(r.listed, "<u4")
    rows.sort(key=lambda r: r.listed)
    return train([read(r) for r in rows if r.positive], [read(r) for r in rows if r.unlabelled], prior)


def score(docs: DataFrame, used: np.ndarray, weights: np.ndarray, bias: float, keep=("doc_id",), column="text") -> DataFrame:
    """Columns `keep` and each text's score."""

    def run(data, offsets):
        numbers, owners = features(data, offsets)
        total = np.zeros(len(offsets) - 1)
        if len(used):
            at, hit = _places(used, numbers)
            total = np.bincount(owners[hit], weights=weights[at[hit]], minlength=len(offsets) - 1)
        return [_sigmoid(total + bias)]

    return map_texts(docs, run, "score double", keep, column)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score(docs, *learn(docs, labels)).select(
        "doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op9_toxicity(spark, sf_dir) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
