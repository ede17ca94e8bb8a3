"""Groups of spelling variants: words one edit apart, and the form that each is a variant of.

Asymmetric chunk join. Of two words one edit apart the shorter (of equal ones, either) gives two
disjoint chunks, its halves; the edit leaves one of them whole. The other gives its positional
grams: a chunk whole in front of the edit stands at the same place there, one behind it is shifted
by the difference of the lengths, none or one, so of all grams just those of a chunk's length
within that shift are made, for both lengths a partner can have. Length, chunk, and gram make
the join key; met words are verified by their edit distance.

A chunk that many words share would meet as many grams. Its pairs differ by one edit in what is
left of them, so the same split applies to the rest: keys that would make more than `HOT` pairs
are extended by a half of the rest, and so on until no key is hot. When a rest is down to
one code point, the words of a key differ just there and are as many as there are letters.

A pair is taken at one key only: where the first difference lies within the rest.

Defined results: texts of null or no words give none; copies and ties count as they occur; a null
doc_id is the empty text in the hash that places deletions; an empty table has no rows. Only doc_id
and text are read.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents
from .merkle import CRC_SQL, CRC_TABLE_SQL
from .storage import stored

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points and occurrences that make a word; deletions are planted in one of so many runs.
LEAST_CHARS, LEAST_COUNT, PLANTED = 5, 3, 97
#: Pairs that a key may make before it is extended.
HOT = 2_000
#: Hot keys up to which they are broadcast.
SMALL = 200_000
#: A form has at least this many times its variant's occurrences.
TIMES = 2


def vocabulary(docs: DataFrame, planted: int = PLANTED) -> DataFrame:
    """(word, n) of the lower-cased runs of letters, a code point deleted where `planted` divides the hash."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(f"({LETTERS})"), F.lit(1))).alias("run"))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = runs.withColumn("h", F.crc32(named.cast("binary")))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % planted == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _split(rows: DataFrame) -> DataFrame:
    """Each row once per half of its chunk word's rest: the key extended by the half, the rest less it.

    `chars` is the length of the chunk word, whose rest is [a, b); the row's own word is longer by
    `shift` behind the edit.
    """
    halves = rows.withColumn("mid", F.expr("a + (b - a) div 2")).withColumn("half", F.explode(F.array(F.lit(1), F.lit(2))))
    gram = F.expr("CASE WHEN half = 1 THEN substring(word, a + 1, mid - a) ELSE substring(word, mid + shift + 1, b - mid) END")
    return halves.withColumn("key", F.xxhash64("key", "chars", "half", gram)).withColumns({
        "a": F.expr("CASE WHEN half = 1 THEN mid ELSE a END"), "b": F.expr("CASE WHEN half = 1 THEN b ELSE mid END"),
    }).drop("mid", "half")


def _parts(rows: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.join(hot, "key", "left_anti"), rows.join(hot, "key", "left_semi")


def near_pairs(words: DataFrame, hot_pairs: int = HOT) -> DataFrame:
    """(x, xn, y, yn): each unordered pair of words that one edit tells apart, once. `words` is (word, n)."""
    base = words.select("word", "n", F.length("word").alias("size"), F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("a"))
    chunks = base.select("key", "word", "n", F.col("size").alias("chars"), F.lit(0).alias("shift"), "a", F.col("size").alias("b"))
    grams = base.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1)))).where("size > shift").select(
        "key", "word", "n", F.expr("size - shift").alias("chars"), "shift", "a", F.expr("size - shift").alias("b")
    )
    found = []
    while True:
        chunks, grams = stored(_split(chunks)), stored(_split(grams))
        sides = chunks.select("key", F.lit(1).alias("c"), F.lit(0).alias("g"), F.expr("b - a").alias("rest")).unionByName(
            grams.select("key", F.lit(0).alias("c"), F.lit(1).alias("g"), F.lit(0).alias("rest"))
        )
        hot = stored(
            sides.groupBy("key").agg(F.sum("c").alias("c"), F.sum("g").alias("g"), F.max("rest").alias("rest"))
            .where(F.expr(f"rest > 1 AND c * g > {hot_pairs}")).select("key")
        )
        many = hot.count()
        mark = F.broadcast(hot) if many <= SMALL else hot
        (chunks, hot_chunks), (grams, hot_grams) = (_parts(rows, mark) for rows in (chunks, grams)) if many else ((chunks, None), (grams, None))
        x = chunks.select("key", F.col("word").alias("x"), F.col("n").alias("xn"), "chars", "a", "b")
        y = grams.select("key", F.col("word").alias("y"), F.col("n").alias("yn"), "shift")
        met = x.join(y, "key").where("shift = 1 AND length(y) = chars + 1 OR shift = 0 AND length(y) = chars AND x < y")
        met = met.where("left(x, a) = left(y, a) AND (b = chars OR left(x, b) <> left(y, b))").where("levenshtein(x, y, 1) = 1")
        found.append(stored(met.select("x", "xn", "y", "yn")))
        if not many:
            break
        chunks, grams = hot_chunks, hot_grams
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last of the words that forms lead to, by pointer jumping."""
    up = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        joined = up.join(above, "root", "left")
        if joined.where("top IS NOT NULL").isEmpty():
            return up
        up = stored(joined.select("word", F.coalesce("top", "root").alias("root")))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of (word, n)."""
    pairs = near_pairs(words)
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("near"), F.col("yn").alias("near_n")).unionByName(
        pairs.select(F.col("y").alias("word"), F.col("x").alias("near"), F.col("xn").alias("near_n"))
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    joined = words.join(best, "word", "left").withColumn("of", F.expr(f"CASE WHEN -best.less >= {times} * n THEN best END"))
    formed = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("of.near").alias("form"), (-F.col("of.less")).alias("form_n")
    ))
    led = roots(formed.where("form IS NOT NULL"))
    return formed.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its form, root and near words."""
    return variants(stored(vocabulary(documents(spark, sf_dir))))


SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LETTERS}')) AS run FROM documents),
counted AS (SELECT run, id || ':' || run AS s, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, k, {CRC_SQL.format(bytes="list_transform(range(strlen(s)), lambda i: ('0x' || substr(hex(s), 2 * i + 1, 2))::BIGINT)")} AS h FROM counted, crc),
words AS (
  SELECT CASE WHEN h % {PLANTED} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST_CHARS} AND sum(k) >= {LEAST_COUNT}),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= {TIMES} * w.n THEN r.near END AS form,
    CASE WHEN r.near_n >= {TIMES} * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
led AS (
  SELECT word, word AS at FROM formed
  UNION ALL
  SELECT l.word, f.form FROM led l JOIN formed f ON f.word = l.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN led l ON l.word = f.word JOIN formed t ON t.word = l.at AND t.form IS NULL
"""
