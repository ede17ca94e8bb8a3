"""Removal of repeated 100-byte strings by sorting suffixes of a content-defined difference cover.

A byte goes if it lies in a 100-byte string that also starts earlier (smaller doc_id, or the same
document at a smaller start). Suffixes need to be told apart only to a depth of 100 bytes.

* Cover. As in the difference-cover construction, only sampled positions are sorted first, and the
  sample is such that equal strings have a sampled position at the same shift: of the 77 24-byte
  substrings in a 100-byte string the one with the smallest hash is its anchor, the leftmost of
  equal ones. Residues modulo three would sample two thirds of all positions; this takes one in
  forty, and every start belongs to exactly one anchor, the one its string is sampled at.
* Triples. A sampled suffix is named by what lies before the anchor, the anchor, and what lies
  behind it, as far as the strings of its starts reach. Anchors that occur once in the whole input
  drop out first. Tasks combine equal triples before the shuffle: all but the first are repeats.
* Merge. Triples of one anchor are sorted together; the remaining suffixes, their starts, follow
  from them. Suffixes are ordered by 128 bits of their first 100 bytes, adjacent ones compared, and
  all but the first of equal ones are repeats. A recursion on names isn't needed: at a depth of 100
  bytes the names are final.

An anchor may be in any share of the documents: counting it sends one row per task, and an anchor
with more than HOT triples is dealt on by the 75 bytes that suffixes of near shifts have in common.
Where more than HOT triples share these too (a passage with a different surrounding in each
document), their strings are told apart one by one: the smallest start of each is a partial
aggregate, joined back to find the later ones. So no group of more than HOT triples meets in a task.

Null and empty texts have no bytes. Rows that share a doc_id count as one document that starts at
the same place, so repeated rows don't remove each other. Rows without doc_id sort before all
others, by a hash of their text; each text is a document of its own. Other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytes_of_text import CHUNK_BYTES, chunks, column_bytes, mix, seeded, span_hashes
from .common import bound_batches, documents
from .storage import stored

LENGTH, GRAM = 100, 24
GRAMS = LENGTH - GRAM + 1
#: Anchors, and bytes of triples, that a task holds at a time while it combines equal ones.
HELD_ANCHORS, HELD_BYTES = 1_000_000, 48 << 20
HOT, SHIFTS = 2_048, 26
_NO_ID = -(2**63)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM bytes from each position."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = int(seeded(9, 1)[0]) | 5
    eight = seeded(3, 256)[data]
    for width in (1, 2, 4):
        eight = eight[:-width] * np.uint64(pow(base, width, 2**64)) + eight[width:]
    out = eight[:n] * np.uint64(pow(base, 16, 2**64)) + eight[8 : 8 + n] * np.uint64(pow(base, 8, 2**64)) + eight[16 : 16 + n]
    return mix(out)


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Anchors of all texts: hash, text number, position, shift of their first start, number of starts."""
    grams = _gram_hashes(data)
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none, none
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = GRAMS - width
    least = np.minimum(least[:-rest], least[rest:]) if rest else least
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # a start belongs to a text if its whole string does
    edge = np.zeros(len(data) + 2, np.int64)
    long = np.diff(offsets) >= LENGTH
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge)[:n] > 0)
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none, none
    new = np.ones(len(starts), bool)
    new[1:] = (at[starts[1:]] != at[starts[:-1]]) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    low, count = starts[first], np.diff(np.append(first, len(starts)))
    place = at[low]
    rows = np.searchsorted(offsets, low, side="right") - 1
    return grams[place], rows, place - offsets[rows], place - low, count


def _pack(place, shift, count):
    return (place << 16) | (shift << 8) | count


def _unpack(packed):
    return packed >> 16, (packed >> 8) & 0xFF, packed & 0xFF


def _asked(batches):
    """An anchor's question whether it occurs elsewhere, once per task; anchors repeated here need no answer.

    kind 0 asks; 1 only tells others; 2 is a repeated anchor that passes, its key turned by its document.
    """
    held, size = [], 0

    def flush():
        hashes, ids, packed = (np.concatenate([h[k] for h in held]) for k in range(3))
        _, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        told = first[counts > 1]
        keys = np.concatenate([hashes[~again], hashes[told], hashes[again] ^ mix(ids[again].view(np.uint64) + packed[again].view(np.uint64))])
        kinds = np.repeat(np.array([0, 1, 2], np.int8), [int((~again).sum()), len(told), int(again.sum())])
        columns = [keys.view(np.int64), np.concatenate([ids[~again], 0 * ids[told], ids[again]])]
        columns += [np.concatenate([packed[~again], 0 * packed[told], packed[again]]), kinds]
        held.clear()
        for a in range(0, len(kinds), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in columns], ["key", "id", "packed", "kind"])

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = column_bytes(batch.column(1))
        for a, b in chunks(offsets):
            hashes, rows, place, shift, count = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            held.append((hashes, ids[a:b][rows], _pack(place, shift, count)))
            size += len(hashes)
        if size > HELD_ANCHORS:
            yield from flush()
            size = 0
    if held:
        yield from flush()


def _answered(batches):
    """The anchors that occur more than once: hash, document, place. Keys come in order."""
    waiting: list[tuple] = []

    def settle(parts):
        keys, ids, packed, kinds = (np.concatenate([p[k] for p in parts]) for k in range(4))
        passing = kinds == 2
        _, inverse, counts = np.unique(keys[~passing], return_inverse=True, return_counts=True)
        asking = (counts[inverse] > 1) & (kinds[~passing] == 0)
        turned = keys[passing] ^ mix(ids[passing].view(np.uint64) + packed[passing].view(np.uint64))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([keys[~passing][asking], turned]).view(np.int64)),
                pa.array(np.concatenate([ids[~passing][asking], ids[passing]])),
                pa.array(np.concatenate([packed[~passing][asking], packed[passing]])),
            ],
            ["hash", "id", "packed"],
        )

    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        keys = columns[0].view(np.uint64)
        if not len(keys):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last key may go on in the next batch
        if cut:
            waiting.append((keys[:cut], *(c[:cut] for c in columns[1:])))
            yield settle(waiting)
            waiting = []
        waiting.append((keys[cut:], *(c[cut:] for c in columns[1:])))
    if waiting:
        yield settle(waiting)


def _triples(batches):
    """Named triples of repeated anchors (kind 0), and the starts of those named before (kind 1).

    Input: id, text, hashes, places.
    """
    held, size = [], 0
    names = ["kind", "hash", "id", "packed", "bytes"]

    def flush():
        hashes, ids, packed, spans = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2, 3))
        bodies = [b for h in held for b in h[4]]
        place, shift, count = _unpack(packed)
        order = np.lexsort((place, ids))
        key = mix(spans ^ mix(hashes + (shift * 256 + count).astype(np.uint64)))[order]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        lead = order[first][inverse]
        mine = np.empty(len(order), np.int64)
        mine[order] = lead
        named = np.zeros(len(order), bool)
        named[order[first]] = True
        gone = ~named & ((ids != ids[mine]) | (place != place[mine]))
        held.clear()
        for kind, chosen in ((0, np.flatnonzero(named)), (1, np.flatnonzero(gone))):
            for a in range(0, len(chosen), 20_000):
                at = chosen[a : a + 20_000]
                body = pa.array([bodies[k] if kind == 0 else None for k in at.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), kind, np.int8)), pa.array(hashes[at].view(np.int64)), pa.array(ids[at]), pa.array(packed[at]), body], names
                )

    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.concatenate([[0], np.array([len(x) for x in batch.column(2)], np.int64)]))
        all_hashes = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        all_packed = batch.column(3).flatten().to_numpy(zero_copy_only=False)
        for i, j in chunks(offsets):
            part = data[offsets[i] : offsets[j]]
            rows = np.repeat(np.arange(i, j), np.diff(ends[i : j + 1]))
            hashes, packed = all_hashes[ends[i] : ends[j]], all_packed[ends[i] : ends[j]]
            place, shift, count = _unpack(packed)
            at = place + offsets[rows] - offsets[i]
            # a place may belong to another text under the same doc_id
            fits = (place - shift + count - 1 + LENGTH <= np.diff(offsets)[rows]) & (place + GRAM <= np.diff(offsets)[rows])
            grams = _gram_hashes(part)
            fits[fits] = grams[at[fits]] == hashes[fits]
            hashes, packed, rows, at, shift, count = (x[fits] for x in (hashes, packed, rows, at, shift, count))
            low, high = at - shift, at - shift + count - 1 + LENGTH
            raw = part.tobytes()
            held.append((hashes, ids[rows], packed, span_hashes(part, low, high), [raw[x:y] for x, y in zip(low.tolist(), high.tolist())]))
            size += int((high - low).sum())
            if size > HELD_BYTES:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def _repeats(batches):
    """Runs of starts whose string starts earlier: id and start << 8 | number of starts - 1. Keys come in order."""

    def settle(parts):
        ids, packed = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        bodies = [b for p in parts for b in p[2]]
        place, shift, count = _unpack(packed)
        low = place - shift
        order = np.lexsort((low, ids))
        ids, low, count = ids[order], low[order], count[order]
        data = np.frombuffer(b"".join([bodies[k] for k in order.tolist()]), np.uint8)
        base = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
        owner = np.repeat(np.arange(len(order)), count)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        starts, real = base[owner] + step, low[owner] + step
        one, two = (span_hashes(data, starts, starts + LENGTH, seed) for seed in (1, 5))
        sorted_at = np.argsort(one, kind="stable")
        same = np.zeros(len(owner), bool)
        same[1:] = (one[sorted_at[1:]] == one[sorted_at[:-1]]) & (two[sorted_at[1:]] == two[sorted_at[:-1]])
        run = np.maximum.accumulate(np.where(same, 0, np.arange(len(owner))))
        first = sorted_at[run]
        gone = np.zeros(len(owner), bool)
        gone[sorted_at] = same & ((ids[owner[sorted_at]] != ids[owner[first]]) | (real[sorted_at] != real[first]))
        at = np.flatnonzero(gone)
        if not len(at):
            return None
        new = np.ones(len(at), bool)
        new[1:] = (owner[at[1:]] != owner[at[:-1]]) | (np.diff(at) != 1)
        head = np.flatnonzero(new)
        sizes = np.diff(np.append(head, len(at)))
        return pa.RecordBatch.from_arrays([pa.array(ids[owner[at[head]]]), pa.array((real[at[head]] << 8) | (sizes - 1))], ["id", "run"])

    waiting, size, last = [], 0, None
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)]
        bodies = batch.column(3).to_pylist()
        for a, b in _spans_of_keys(keys):
            if size > 4 * CHUNK_BYTES and keys[a] != last:
                if (made := settle(waiting)) is not None:
                    yield made
                waiting, size = [], 0
            waiting.append((rows[0][a:b], rows[1][a:b], bodies[a:b]))
            size += sum(map(len, bodies[a:b]))
            last = keys[b - 1]
    if waiting and (made := settle(waiting)) is not None:
        yield made


def _strings(batches):
    """Every start of the triples: 128 bits of its string, id and place."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        place, shift, count = _unpack(batch.column(1).to_numpy(zero_copy_only=False))
        data = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8)
        offsets = np.append(0, np.cumsum(count + LENGTH - 1))
        for a, b in chunks(offsets):
            part, counts = data[offsets[a] : offsets[b]], count[a:b]
            owner = np.repeat(np.arange(a, b), counts)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = offsets[owner] - offsets[a] + step
            one, two = (span_hashes(part, starts, starts + LENGTH, seed) for seed in (1, 5))
            columns = [one.view(np.int64), two.view(np.int64), ids[owner], place[owner] - shift[owner] + step]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["one", "two", "id", "start"])


def _spans_of_keys(keys: np.ndarray, rows: int = 512):
    """Cuts of a sorted array into pieces of whole keys, about `rows` long."""
    edges = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, int)
    a = 0
    while a < len(keys):
        b = int(edges[min(np.searchsorted(edges, a + rows), len(edges) - 1)])
        yield a, b
        a = b


def _cut(batches):
    """Per text: id, bytes, removed bytes, removed runs and the digest of the rest, from all its runs of starts."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        runs = batch.column(2)
        sizes = np.array([len(r) if r.is_valid else 0 for r in runs], np.int64)
        packed = runs.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.append(0, sizes))
        raw, made = data.tobytes(), []
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            whole = raw[a:b]
            mine = np.sort(packed[ends[k] : ends[k + 1]])
            if not len(mine):
                made.append((b - a, 0, 0, hashlib.sha256(whole).hexdigest()))
                continue
            low, high = mine >> 8, (mine >> 8) + (mine & 0xFF) + LENGTH
            high = np.maximum.accumulate(high)
            new = np.append(True, low[1:] > high[:-1])
            span_low, span_high = low[new], high[np.append(np.flatnonzero(new)[1:] - 1, len(high) - 1)]
            pieces = [whole[x:y] for x, y in zip(np.append(0, span_high).tolist(), np.append(span_low, b - a).tolist())]
            made.append((b - a, int((span_high - span_low).sum()), len(span_low), hashlib.sha256(b"".join(pieces)).hexdigest()))
        columns = [pa.array([m[k] for m in made], pa.string() if k == 3 else pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(id, run): runs of starts (start << 8 | number - 1) of strings that start earlier; `docs` has id and text."""
    bound_batches(docs.sparkSession)
    asked = docs.mapInArrow(_asked, "key bigint, id bigint, packed bigint, kind tinyint")
    repeated = asked.repartition("key").sortWithinPartitions("key").mapInArrow(_answered, "hash bigint, id bigint, packed bigint")
    lists = repeated.groupBy("id").agg(F.collect_set(F.struct("hash", "packed")).alias("found"))
    met = docs.hint("merge").join(lists, "id").select("id", "text", F.col("found.hash").alias("hashes"), F.col("found.packed").alias("places"))
    triples = stored(met.mapInArrow(_triples, "kind tinyint, hash bigint, id bigint, packed bigint, bytes binary"))
    named = triples.where("kind = 0").select("hash", "id", "packed", "bytes")
    # the few crowded anchors are told apart without moving the others' bytes
    hot = stored(named.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("hash"))
    plain = named.join(hot, "hash", "left_anti").select(F.col("hash").alias("key"), "id", "packed", "bytes")
    dealt = stored(_dealt_on(named.join(hot, "hash", "left_semi")))
    crowded = stored(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"))
    grouped = plain.unionByName(dealt.join(crowded, "key", "left_anti"))
    runs = grouped.repartition("key").sortWithinPartitions("key").mapInArrow(_repeats, "id bigint, run bigint")
    runs = runs.unionByName(_later_starts(dealt.join(crowded, "key", "left_semi")))
    place, shift, count = (F.shiftright("packed", 16), F.shiftright("packed", 8).bitwiseAND(F.lit(255)), F.col("packed").bitwiseAND(F.lit(255)))
    earlier = triples.where("kind = 1").select("id", (F.shiftleft(place - shift, 8) + count - 1).alias("run"))
    return runs.unionByName(earlier)


def _later_starts(crowded: DataFrame) -> DataFrame:
    """Like _repeats, for triples of which any number share a key: no group of them meets in a task."""
    strings = crowded.select("id", "packed", "bytes").mapInArrow(_strings, "one bigint, two bigint, id bigint, start bigint")
    first = strings.groupBy("one", "two").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a merge join at every size, of inputs shuffled for it alone, so that adaptive execution can split the starts of one string
    met = strings.hint("merge").join(stored(first), ["one", "two"]).where(F.struct("id", "start") != F.col("first"))
    return met.select("id", F.shiftleft("start", 8).alias("run"))


def _dealt_on(hot: DataFrame) -> DataFrame:
    """Triples of crowded anchors in parts of SHIFTS neighbouring shifts, keyed by the bytes their strings share."""
    shift, count = F.shiftright("packed", 8).bitwiseAND(F.lit(255)), F.col("packed").bitwiseAND(F.lit(255))
    parts = hot.withColumn("_shift", shift.cast("int")).withColumn("_least", (F.col("_shift") - count + 1).cast("int"))
    parts = parts.withColumn("_part", F.explode(F.sequence(F.floor(F.col("_least") / SHIFTS).cast("int"), F.floor(F.col("_shift") / SHIFTS).cast("int"))))
    top = F.least(F.col("_shift"), F.col("_part") * SHIFTS + SHIFTS - 1)  # largest and smallest shift of the part
    low = F.greatest(F.col("_least"), F.col("_part") * SHIFTS)
    shared = F.expr(f"substring(bytes, _shift - _part * {SHIFTS} + 1, {LENGTH - SHIFTS + 1})")
    parts = parts.withColumn("_top", top.cast("int")).withColumn("_low", low.cast("int")).withColumn("_shared", shared)
    place = F.shiftright("packed", 16)
    return parts.select(
        F.xxhash64("hash", "_part", "_shared").alias("key"), "id",
        (F.shiftleft(place, 16) + F.col("_top") * 256 + F.col("_top") - F.col("_low") + 1).alias("packed"),
        F.expr(f"substring(bytes, _shift - _top + 1, _top - _low + {LENGTH})").alias("bytes"),
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; `docs` has doc_id and text."""
    own = F.lit(_NO_ID) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    docs = docs.select("doc_id", F.coalesce("doc_id", own).alias("id"), "text")
    lists = repeated_starts(docs.select("id", "text")).groupBy("id").agg(F.collect_set("run").alias("runs"))
    met = docs.hint("merge").join(lists, "id", "left").select("doc_id", "text", "runs")
    return met.mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op2_suffix_array_dedup(spark, sf_dir) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM docs)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS copy FROM strings) WHERE copy > 1
), marked AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS fresh FROM again
), numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, span, min(i) AS low, max(i) + 100 AS high FROM numbered GROUP BY doc_id, span),
pieces AS (
  SELECT doc_id, low, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS since FROM spans
  UNION ALL SELECT doc_id, len(h) // 2, coalesce(max(high), 0) FROM docs LEFT JOIN spans USING (doc_id) GROUP BY doc_id, h
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (low - since)), '' ORDER BY low, since) AS rest FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id
), summed AS (SELECT doc_id, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM docs JOIN kept USING (doc_id) LEFT JOIN summed USING (doc_id)
"""
