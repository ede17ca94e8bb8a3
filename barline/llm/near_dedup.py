"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct five-word shingles (64-bit hashes) after lower-casing A-Z.
Documents are linked where their sets have a Jaccard similarity of PERCENT per cent or more, or of the
percentage that the caller names.

* Sketching: in round i every shingle is thrown into a bin (rounds T to 2T - 1 serve one bin each),
  and a bin keeps its smallest (round, hash) value, so after 2T rounds no bin is empty and a text
  of n shingles needs about n + T log T throws. Two sketches agree in a bin with probability J.
* Banding: bands of the most bins for which a pair at the threshold shares none with probability
  NO_BAND at most: 28 of 5 at 85 per cent (7e-8), 35 of 4 at 80 (1e-8).
* Equal sets are one class, told by 128 bits, so copies never meet in pairs.
* A bucket's members are first verified against its smallest document only. Only members of
  different components are then verified with each other. In crowded buckets a document is first
  dropped where too many of its shingles occur in no other crowded document: no partner in a
  crowded bucket could reach the threshold. Every drop is exact.
* Pairs are verified only where their sketches agree in as many bins as a pair at the threshold
  reaches but with probability FEW_EQUAL: 97 of 140 at 85 per cent, 88 at 80.
* Verification intersects the full shingle sets of both texts.

Texts without words (null, empty, blank) have an empty set and are linked with nothing. Rows that
share a doc_id count as one document whose links are pooled. A row without doc_id takes no part:
its component is null and it is kept. Other columns are not read.
"""

from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytes_of_text import LOWER, WHITE, chunks, combine, column_bytes, mix, per_row_key, seeded, span_hashes, words
from .common import bound_batches, documents, map_texts
from .storage import components, stored

SHINGLE, BINS, PERCENT, CROWD, BLOCK = 5, 140, 85, 16, 256
#: Probabilities that a pair at the threshold is missed by the bands and by the test of the sketches.
NO_BAND, FEW_EQUAL = 1e-7, 1e-6


class Screen(NamedTuple):
    """A threshold in per cent, bins of a band, and bins in which the sketches of a pair must agree."""

    percent: int
    band: int
    least_equal: int


def screen(percent: int) -> Screen:
    p, below, least = percent / 100, 0.0, 0
    band = max(w for w in range(1, BINS + 1) if BINS % w == 0 and (1 - p**w) ** (BINS // w) <= NO_BAND)
    for k in range(BINS):
        below += comb(BINS, k) * p**k * (1 - p) ** (BINS - k)
        if below > FEW_EQUAL:
            break
        least = k + 1
    return Screen(percent, band, least)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their text numbers, texts in order."""
    lower = LOWER[data]
    starts, ends, rows = words(lower, offsets, WHITE)
    hashes = span_hashes(lower, starts, ends)
    grams = combine(hashes, SHINGLE)
    at = np.flatnonzero(rows[: len(grams)] == rows[SHINGLE - 1 :]) if len(grams) else np.zeros(0, np.int64)
    n_words = np.bincount(rows, minlength=len(offsets) - 1)
    short = n_words[rows] < SHINGLE
    first = np.cumsum(n_words) - n_words
    place = np.flatnonzero(short)
    factors = seeded(23, SHINGLE) | np.uint64(1)
    whole = np.zeros(len(offsets) - 1, np.uint64)
    np.add.at(whole, rows[place], hashes[place] * factors[place - first[rows[place]]])
    few = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    values = np.concatenate([grams[at], mix(whole[few] + n_words[few].astype(np.uint64))])
    owners = np.concatenate([rows[at], few])
    _, kept = np.unique(per_row_key(values, owners), return_index=True)
    kept = kept[np.argsort(owners[kept], kind="stable")]
    return values[kept], owners[kept]


def sketches(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """An n x BINS array of fast similarity sketches."""
    out = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    seeds = seeded(31, 2 * BINS)
    for r in range(2 * BINS):
        drawn = mix(values ^ seeds[r])
        bins = (drawn >> np.uint64(32)) % np.uint64(BINS) if r < BINS else np.full(len(values), r - BINS, np.uint64)
        level = (np.uint64(r) << np.uint64(48)) | (mix(drawn) >> np.uint64(16))
        np.minimum.at(out, owners * BINS + bins.astype(np.int64), level)
        open_rows = (out.reshape(n, BINS) == np.iinfo(np.uint64).max).any(axis=1)
        left = open_rows[owners]
        if not left.any():
            break
        values, owners = values[left], owners[left]
    return out.reshape(n, BINS)


def _describe(data, offsets, band: int):
    n, n_bands = len(offsets) - 1, BINS // band
    values, owners = shingle_sets(data, offsets)
    sizes = np.bincount(owners, minlength=n).astype(np.int64)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(one, owners, mix(values + np.uint64(1)))
    np.add.at(two, owners, mix(values ^ np.uint64(0xD6E8FEB86659FD93)))
    sketch = sketches(values, owners, n).reshape(n, n_bands, band)
    bands = mix((sketch * (seeded(41, band) | np.uint64(1))).sum(axis=2, dtype=np.uint64) ^ seeded(43, n_bands))
    filled = sizes > 0
    ends = np.concatenate([[0], np.cumsum(filled * n_bands)]).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[filled].ravel().view(np.int64)))
    # two bytes of each bin's mixed value are enough to estimate a similarity
    short = mix(sketch.reshape(n, BINS)[filled].ravel()).astype(np.uint16).view(np.int16)
    ends = np.concatenate([[0], np.cumsum(filled * BINS)]).astype(np.int32)
    return [sizes, one.view(np.int64), two.view(np.int64), listed, pa.ListArray.from_arrays(pa.array(ends), pa.array(short))]


def describe(docs: DataFrame, band: int) -> DataFrame:
    """doc_id, set size, 128-bit set key, band keys and two bytes of each sketch bin, of each document."""
    return map_texts(
        docs, lambda data, offsets: _describe(data, offsets, band), "n_shingles bigint, key_one bigint, key_two bigint, bands array<bigint>, sketch array<smallint>"
    )


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; `texts` has doc_id and text."""
    bound_batches(pairs.sparkSession)
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def check(batches):
        for batch in batches:
            (data_a, at_a), (data_b, at_b) = (
                column_bytes(batch.column(batch.schema.get_field_index(name))) for name in ("text_a", "text_b")
            )
            good = np.zeros(batch.num_rows, bool)
            for i, j in chunks(at_a + at_b):
                sets = [shingle_sets(d[o[i] : o[j]], o[i : j + 1] - o[i]) for d, o in ((data_a, at_a), (data_b, at_b))]
                keys_a, keys_b = (per_row_key(values, owners) for values, owners in sets)
                _, place, _ = np.intersect1d(keys_a, keys_b, assume_unique=True, return_indices=True)
                both = np.bincount(sets[0][1][place], minlength=j - i)
                sizes = np.bincount(sets[0][1], minlength=j - i) + np.bincount(sets[1][1], minlength=j - i)
                good[i:j] = 100 * both >= percent * (sizes - both)
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"])
            yield rows.filter(pa.array(good))

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(check, "a bigint, b bigint")


def _worth_checking(a: str, b: str, by: Screen):
    """Sizes allow the threshold, and so do the sketches."""
    size_a, size_b = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    equal = F.size(F.filter(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: x == y), lambda same: same))
    return (100 * F.least(size_a, size_b) >= by.percent * F.greatest(size_a, size_b)) & (equal >= by.least_equal)


def _first_shared(a: str, b: str):
    """The band at hand is the first that both have, so that a pair comes from one bucket only."""
    before = F.col(f"{a}.place")
    same = F.zip_with(F.slice(f"{a}.bands", F.lit(1), before), F.slice(f"{b}.bands", F.lit(1), before), lambda x, y: x == y)
    return ~F.exists(same, lambda x: x)


def _distinct_shingles(data, offsets):
    values, owners = shingle_sets(data, offsets)
    return [owners, values.view(np.int64)]


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `ids`; a merge join at every size, as the ids grow with the documents."""
    return docs.where("doc_id IS NOT NULL").hint("merge").join(ids, "doc_id", "left_semi")


def _open_members(members: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Members of buckets, without those of crowded buckets that can have no partner there."""
    crowded = members.where(F.col("size") >= CROWD)
    ids = stored(crowded.select(F.col("rep").alias("doc_id"), "n_shingles").distinct())
    if ids.isEmpty():
        return members
    shingles = map_texts(_texts_of(docs, ids.select("doc_id")), _distinct_shingles, "shingle bigint", explode=True)
    alone = (
        shingles.groupBy("shingle").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
        .where("n = 1").groupBy("doc_id").agg(F.count("*").alias("alone"))
    )
    closed = stored(
        alone.join(ids, "doc_id").where(100 * (F.col("n_shingles") - F.col("alone")) < percent * F.col("n_shingles"))
        .select(F.col("doc_id").alias("rep"))
    )
    return members.where(F.col("size") < CROWD).unionByName(crowded.join(closed, "rep", "left_anti").select(members.columns))


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _tile_links(side: np.ndarray, cross: bool, reps, roots, sizes, bands, sketch, data, offsets, by: Screen):
    """Links between members of different roots in a tile, at most one for each pair of roots that meet."""
    order = np.argsort(side, kind="stable")
    first = order[: int((side == side.min()).sum())] if cross else order
    rest = order[len(first) :] if cross else order
    sets, up = {}, {}

    def shingles(k):
        if k not in sets:
            sets[k] = shingle_sets(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))[0]
            sets[k].sort()
        return sets[k]

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    found = []
    for n, i in enumerate(first.tolist()):
        others = rest if cross else order[n + 1 :]
        likely = (roots[others] != roots[i]) & (100 * np.minimum(sizes[others], sizes[i]) >= by.percent * np.maximum(sizes[others], sizes[i]))
        others = others[likely]
        others = others[(bands[others] == bands[i]).any(axis=1)]
        others = others[(sketch[others] == sketch[i]).sum(axis=1) >= by.least_equal]
        for j in others.tolist():
            a, b = top(int(roots[i])), top(int(roots[j]))
            if a == b:
                continue
            both = len(np.intersect1d(shingles(i), shingles(j), assume_unique=True))
            if 100 * both >= by.percent * (sizes[i] + sizes[j] - both):
                up[max(a, b)] = min(a, b)
                found.append((int(reps[i]), int(reps[j])))
    return found


def _crowded_links(rest: DataFrame, texts: DataFrame, by: Screen) -> DataFrame:
    """Links between members of different roots that share a crowded bucket.

    Members meet in tiles of two blocks of those that have a leader in common, so no pair is ever
    a row, and no task holds more than two blocks.
    """
    bound_batches(rest.sparkSession)
    groups = stored(
        rest.groupBy("lead", "rep")
        .agg(*[F.any_value(c).alias(c) for c in ("root", "n_shingles", "bands", "sketch")])
    )
    counts = stored(groups.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    dealt = (
        groups.join(counts, "lead").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        .join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    )

    def tile(group: pa.Table) -> pa.Table:
        data, offsets = column_bytes(group["text"])
        numbers = {c: group[c].to_numpy() for c in ("own", "rep", "root", "n_shingles", "low", "high")}
        cross = numbers["low"][0] != numbers["high"][0]
        found = []
        if not cross or len(np.unique(numbers["own"])) == 2:
            found = _tile_links(
                numbers["own"], cross, numbers["rep"], numbers["root"], numbers["n_shingles"],
                _matrix(group["bands"], BINS // by.band), _matrix(group["sketch"], BINS), data, offsets, by,
            )
        return pa.table({k: pa.array([f[n] for f in found], pa.int64()) for n, k in enumerate(("a", "b"))})

    return dealt.groupBy("lead", "low", "high").applyInArrow(tile, "a bigint, b bigint")


def link(docs: DataFrame, described: DataFrame, by: Screen) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (key_one, key_two, n_shingles, rep), and the components (id, root) of linked reps."""
    classes = stored(
        described.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key_one", "key_two", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    )
    banded = classes.select("rep", "n_shingles", F.posexplode("bands").alias("place", "band"))
    shared = stored(banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"))
    members = stored(banded.join(shared, "band").select("band", "place", "rep", "n_shingles", "size"))
    members = _open_members(members, docs, by.percent)
    leaders = members.groupBy("band").agg(F.min("rep").alias("lead"), F.count("*").alias("size")).where("size > 1")
    looks = classes.select(F.col("rep").alias("look"), "bands", "sketch")
    led = stored(members.drop("size").join(stored(leaders), "band").join(looks, F.col("rep") == F.col("look")).drop("look"))
    texts = stored(_texts_of(docs, led.select(F.col("rep").alias("doc_id")).distinct()))

    heads = led.where("rep = lead").alias("h")
    star = stored(
        led.where("rep <> lead").alias("m").join(heads, (F.col("m.band") == F.col("h.band")) & _worth_checking("m", "h", by))
        .select(F.col("h.rep").alias("a"), F.col("m.rep").alias("b")).distinct()
    )
    first = stored(_verified(star, texts, by.percent))
    roots = components(first)

    placed = led.where("rep <> lead").join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    rest = stored(placed.join(mixed, "band", "left_semi"))
    few = rest.where(F.col("size") < CROWD)
    across = stored(
        few.alias("m").join(
            few.alias("o"),
            (F.col("m.band") == F.col("o.band")) & (F.col("m.root") < F.col("o.root")) & _first_shared("m", "o") & _worth_checking("m", "o", by),
        )
        .select(F.least("m.rep", "o.rep").alias("a"), F.greatest("m.rep", "o.rep").alias("b")).distinct()
    )
    second = stored(_verified(across, texts, by.percent).unionByName(_crowded_links(rest.where(F.col("size") >= CROWD), texts, by)))
    if not second.isEmpty():
        roots = components(first.unionByName(second))
    return classes, roots


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; `docs` has doc_id and text."""
    docs, by = docs.select("doc_id", "text"), screen(percent)
    described = stored(describe(docs, by.band))
    classes, roots = link(docs, described, by)
    named = stored(
        classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left")
        .select("key_one", "key_two", "n_shingles", F.coalesce("root", "rep").alias("component"))
    )
    return described.drop("bands", "sketch").join(named, ["key_one", "key_two", "n_shingles"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_minhash_near_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM tokens WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both, any_value(x.n) AS na, any_value(y.n) AS nb
  FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
), reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id FROM documents) JOIN roots USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
