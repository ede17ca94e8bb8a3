"""A manifest of a dataset as a tree of hashes: per-language subtrees under one root, with proofs.

Leaves are numbered by a range sort and prefix offsets of partition counts, so a language of any
size is numbered and climbed in parallel. A chunk of `SPAN` neighbouring leaves is one small group:
its task hashes the chunk's parents bottom-up and keeps, for every parent, a copy of the running
hash before each child slot. Replacing a child resumes the copy of its slot with the new digest
and the siblings to its right; what lies left of it is never hashed again. Chunk digests are the
next round's leaves; rounds follow the logarithm of the row count to the base of SPAN.

Hash objects can't leave a process, so a chunk gets the parents above it as (left, right) sibling
digests, restores each one's state from the left ones once, and resumes copies of it for its rows.

Defined results: a null field is `-`; rows without doc_id are never tampered with; rows without lang form a language of their own, before the
others; within a language rows without doc_id come first, and rows with one doc_id are ordered by
leaf digest (equal rows have equal leaves; one row per input row is returned). An empty table has
no rows and no root. Only doc_id, source, lang, n_chars and text are read.
"""

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import documents
from .storage import stored

#: Children of a parent, levels of a chunk, and so the leaves of a chunk.
WIDTH, HEIGHT = 2, 12
#: Rows of partition counts up to which they are broadcast.
SMALL = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "g string, pos bigint, left array<string>, right array<string>, subroot string, root string"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row's FIELDS, some of them replaced."""
    return F.sha2(F.concat(*[_field(changed.get(name, F.col(name))) for name in FIELDS]), 256)


def height(n: int, width: int) -> int:
    """Levels between n nodes and the one that remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // width), levels + 1
    return levels


def build(digests: list[bytes], levels: int, width: int):
    """Nodes by level, and of each level's parents the hash states before their child slots."""
    nodes, states = [digests], []
    for _ in range(levels):
        above, kept = [], []
        for first in range(0, len(nodes[-1]), width):
            running, before = hashlib.sha256(), []
            for child in nodes[-1][first : first + width]:
                before.append(running.copy())
                running.update(child)
            kept.append(before)
            above.append(running.hexdigest().encode())
        nodes.append(above)
        states.append(kept)
    return nodes, states


def fold(nodes, states, at: int, digest: bytes, width: int) -> bytes:
    """The top digest once leaf `at` is replaced: states resumed with the new child and those right of it."""
    for level, kept in enumerate(states):
        parent, slot = divmod(at, width)
        running = kept[parent][slot].copy()
        running.update(digest)
        running.update(b"".join(nodes[level][at + 1 : (parent + 1) * width]))
        digest, at = running.hexdigest().encode(), parent
    return digest


def siblings(nodes, at: int, width: int) -> tuple[list[str], list[str]]:
    """Digests left and right of a leaf's path, level by level, each level's joined."""
    left, right = [], []
    for level in nodes[:-1]:
        first = at // width * width
        left.append(b"".join(level[first:at]).decode())
        right.append(b"".join(level[at + 1 : first + width]).decode())
        at //= width
    return left, right


def numbered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, int]:
    """Rows with `pos`, their place in their group by `order`, and `n`, its size; and the largest size.

    One range sort over all groups, then counts per partition and group are summed up in front of
    each partition. A group of any size spreads over partitions; equal rows are told apart by
    where they were read.
    """
    keys = [F.col(group), *map(F.col, order)]
    spread = rows.withColumn("turn", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("turn"))
    sorted_rows = stored(spread.sortWithinPartitions(*keys, "turn").drop("turn").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = sorted_rows.groupBy(group, part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    in_front = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select(
        group, "part", "first", F.coalesce(F.sum("held").over(in_front), F.lit(0)).alias("offset"),
        F.sum("held").over(Window.partitionBy(group)).alias("n"),
    ))
    size, largest = offsets.agg(F.count(F.lit(1)), F.max("n")).first()
    if size <= SMALL:
        offsets = F.broadcast(offsets)
    placed = sorted_rows.withColumn("part", part).join(offsets, [group, "part"])
    return placed.withColumn("pos", F.expr("at - first + offset")).drop("part", "at", "first", "offset"), largest or 0


def _chunked(nodes: DataFrame, span: int) -> DataFrame:
    return nodes.withColumn("chunk", F.expr(f"pos div {span}"))


def _in_order(table: pa.Table):
    """Positions of a chunk's rows in order, its digests so ordered, and its levels' count limit."""
    places = table.column("pos").to_numpy()
    order = places.argsort(kind="stable")
    return order, [d.encode() for d in table.column("digest").take(pa.array(order)).to_pylist()], table.column("n")[0].as_py()


def climb(nodes: DataFrame, largest: int, width: int = WIDTH, levels: int = HEIGHT) -> list[DataFrame]:
    """Rounds (g, pos, n, digest) from `nodes` up to one node per group `g`."""
    span = width**levels

    def top(table: pa.Table) -> pa.Table:
        _, digests, n = _in_order(table)
        above, _ = build(digests, min(levels, height(n, width)), width)
        return pa.table({
            "g": table.column("g").slice(0, 1), "pos": table.column("chunk").slice(0, 1),
            "n": pa.array([-(-n // span)], pa.int64()), "digest": [above[-1][0].decode()],
        })

    rounds = [nodes]
    while largest > 1:
        chunks = _chunked(rounds[-1].select("g", "pos", "n", "digest"), span).groupBy("g", "chunk")
        rounds.append(stored(chunks.applyInArrow(top, "g string, pos bigint, n bigint, digest string")))
        largest = -(-largest // span)
    return rounds


def descend(rounds: list[DataFrame], paths: DataFrame, width: int = WIDTH, levels: int = HEIGHT) -> DataFrame:
    """`paths` of the groups' tops down to the nodes of rounds[0]: sibling digests, nearest level first."""
    span = width**levels

    def down(table: pa.Table, above: pa.Table) -> pa.Table:
        order, digests, n = _in_order(table)
        nodes, _ = build(digests, min(levels, height(n, width)), width)
        up = above.to_pylist()[0]
        sides = [siblings(nodes, at, width) for at in range(len(digests))]
        size = len(digests)
        return pa.table([
            table.column("g"), table.column("pos").take(pa.array(order)),
            pa.array([left + up["left"] for left, _ in sides], pa.list_(pa.string())),
            pa.array([right + up["right"] for _, right in sides], pa.list_(pa.string())),
            pa.array([up["subroot"]] * size, pa.string()), pa.array([up["root"]] * size, pa.string()),
        ], ["g", "pos", "left", "right", "subroot", "root"])

    for nodes in reversed(rounds[:-1]):
        met = _chunked(nodes.select("g", "pos", "n", "digest"), span).groupBy("g", "chunk")
        paths = met.cogroup(paths.withColumnRenamed("pos", "chunk").groupBy("g", "chunk")).applyInArrow(down, _PATH)
    return paths


def manifest(docs: DataFrame, tampered: Column, width: int = WIDTH, levels: int = HEIGHT) -> DataFrame:
    """One row per row of `docs`: leaf, subroot, root, the proof's digest, and the root folded from its proof.

    `tampered` marks rows whose n_chars is read as one more when the root is folded again.
    """
    span = width**levels
    leaves = docs.select(*FIELDS).select(
        "doc_id", F.coalesce(F.concat(F.lit(":"), F.col("lang")), F.lit("")).alias("g"), leaf_digest().alias("digest"),
        F.when(tampered & F.col("n_chars").isNotNull(), leaf_digest(n_chars=F.col("n_chars") + 1)).alias("changed"),
    )
    rows, largest = numbered(leaves, "g", ["doc_id", "digest"])
    rounds = climb(rows, largest, width, levels)
    subroots = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "digest")
    tops, groups = numbered(subroots, "g", ["of"])
    top_rounds = climb(tops, groups, width, levels)
    root = top_rounds[-1].select(
        "g", F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<string>").alias("left"),
        F.array().cast("array<string>").alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
    )
    to_subroots = descend(top_rounds, root, width, levels).drop("g", "subroot").withColumnRenamed("pos", "place")
    tops = tops.select(F.col("pos").alias("place"), F.col("of").alias("g"), F.col("digest").alias("subroot"))
    paths = stored(tops.join(to_subroots, "place").select("g", F.lit(0).cast("bigint").alias("pos"), "left", "right", "subroot", "root"))
    paths = stored(descend(rounds[1:], paths, width, levels)) if len(rounds) > 2 else paths

    def prove(table: pa.Table, above: pa.Table) -> pa.Table:
        order, digests, n = _in_order(table)
        nodes, states = build(digests, min(levels, height(n, width)), width)
        up = above.to_pylist()[0]
        upper = [(hashlib.sha256(left.encode()), right.encode()) for left, right in zip(up["left"], up["right"])]
        upper_proof = "".join(left + right for left, right in zip(up["left"], up["right"])).encode()
        ordered = table.take(pa.array(order))
        proofs, roots, known = [], [], {}
        for at, changed in enumerate(ordered.column("changed").to_pylist()):
            proof = hashlib.sha256()
            for left, right in zip(*siblings(nodes, at, width)):
                proof.update((left + right).encode())
            proof.update(upper_proof)
            proofs.append(proof.hexdigest())
            chunk = fold(nodes, states, at, digests[at] if changed is None else changed.encode(), width)
            if chunk not in known:
                digest = chunk
                for state, right in upper:
                    running = state.copy()
                    running.update(digest)
                    running.update(right)
                    digest = running.hexdigest().encode()
                known[chunk] = digest.decode()
            roots.append(known[chunk])
        size = len(digests)
        return pa.table([
            ordered.column("doc_id"), ordered.column("digest"), pa.array([up["subroot"]] * size, pa.string()),
            pa.array([up["root"]] * size, pa.string()), pa.array(proofs, pa.string()), pa.array(roots, pa.string()),
            pa.array([r == up["root"] for r in roots], pa.bool_()),
        ], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return _chunked(rows, span).groupBy("g", "chunk").cogroup(paths.withColumnRenamed("pos", "chunk").groupBy("g", "chunk")).applyInArrow(
        prove, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; rows whose id's crc32 is divisible by 7 are folded with n_chars one more."""
    docs = documents(spark, sf_dir, *FIELDS)
    return manifest(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)))


def _sql_leaf(chars: str = "n_chars") -> str:
    fields = [chars if name == "n_chars" else name for name in FIELDS]
    return "sha256(" + " || ".join(
        f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR END" for x in fields
    ) + ")"


#: crc32 of a BIGINT list of bytes `{bytes}`, folded over the 256-entry table that CRC_TABLE_SQL makes.
CRC_TABLE_SQL = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS c"""
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda h, b: xor(h >> 8, c[(xor(h, b) & 255) + 1])), 4294967295)"

SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
hashed AS (
  SELECT doc_id, coalesce(':' || lang, '') AS g, {_sql_leaf()} AS leaf, {_sql_leaf("n_chars + 1")} AS more,
    doc_id IS NOT NULL AND n_chars IS NOT NULL AND {CRC_SQL.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 7 = 0 AS tampered
  FROM documents, crc),
leaves AS (
  SELECT doc_id, g, leaf, CASE WHEN tampered THEN more ELSE leaf END AS changed,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM hashed),
nodes AS (
  SELECT g, 0 AS lvl, pos AS idx, n, leaf AS d FROM leaves
  UNION ALL
  SELECT g, lvl + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(d, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY g, lvl, idx // 2),
tops AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
uppers AS (
  SELECT 0 AS lvl, pos AS idx, n, d FROM tops
  UNION ALL
  SELECT lvl + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(d, '' ORDER BY idx)) FROM uppers WHERE n > 1 GROUP BY lvl, idx // 2),
low AS (
  SELECT l.g, l.pos, string_agg(s.d, '' ORDER BY s.lvl) AS proof
  FROM leaves l JOIN nodes s ON s.g = l.g AND s.n > 1 AND s.idx = xor(l.pos >> s.lvl, 1) GROUP BY l.g, l.pos),
high AS (
  SELECT t.g, string_agg(s.d, '' ORDER BY s.lvl) AS proof FROM tops t JOIN uppers s ON s.n > 1 AND s.idx = xor(t.pos >> s.lvl, 1) GROUP BY t.g),
folded AS (
  SELECT g, pos, 0 AS lvl, n, changed AS d FROM leaves
  UNION ALL
  SELECT f.g, f.pos, f.lvl + 1, (f.n + 1) // 2, sha256(CASE WHEN (f.pos >> f.lvl) & 1 = 0 THEN f.d || coalesce(s.d, '') ELSE s.d || f.d END)
  FROM folded f LEFT JOIN nodes s ON s.g = f.g AND s.lvl = f.lvl AND s.idx = xor(f.pos >> f.lvl, 1) WHERE f.n > 1),
raised AS (
  SELECT f.g, f.pos, t.pos AS place, 0 AS lvl, t.n AS n, f.d FROM folded f JOIN tops t USING (g) WHERE f.n = 1
  UNION ALL
  SELECT f.g, f.pos, f.place, f.lvl + 1, (f.n + 1) // 2, sha256(CASE WHEN (f.place >> f.lvl) & 1 = 0 THEN f.d || coalesce(s.d, '') ELSE s.d || f.d END)
  FROM raised f LEFT JOIN uppers s ON s.lvl = f.lvl AND s.idx = xor(f.place >> f.lvl, 1) WHERE f.n > 1)
SELECT l.doc_id, l.leaf, t.d AS subroot, u.d AS root, sha256(coalesce(low.proof, '') || coalesce(high.proof, '')) AS proof_sha256,
  r.d AS folded_root, r.d = u.d AS verified
FROM leaves l JOIN tops t ON t.g = l.g JOIN uppers u ON u.n = 1 JOIN raised r ON r.g = l.g AND r.pos = l.pos AND r.n = 1
LEFT JOIN low ON low.g = l.g AND low.pos = l.pos LEFT JOIN high ON high.g = l.g
"""
