"""Line-first cleaning of documents.

Every line is tested by itself; failing lines go, and a document that loses too much of its text
goes as a whole. The document-level measures of the usual quality rules come from the same pass.

Lines are split at line feeds; a line without a word is neither tested nor counted. Words are
runs of anything but blanks and ASCII white space. A line fails if

* boilerplate: it equals an earlier line, or it has at most 30 words and one of `PHRASES`;
* navigation: a quarter or more of its words are separators such as a lone `|`;
* symbols: more than a tenth as many symbols `#*$%&|<>` as characters in words;
* punctuation: 30 % or more of its words end in `!!` or `??`, or it has fewer than three words
  and no closing punctuation.

Null and empty texts have no words: all counts are 0, they fail the base rule and are not kept.
Repeated rows are judged one by one. Other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytes_of_text import LOWER, WHITE, combine, per_row_key, span_hashes, words
from .common import documents, map_texts, per_row

PHRASES = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum",
    "privacy policy", "read more", "sign up for", "subscribe to", "terms of service",
)
PHRASE_WORDS, WINDOW, LOSS_PERCENT = 30, 8, 50
SYMBOLS, SEPARATORS, CLOSING = b"#*$%&|<>", b"|>/", b".!?:;\"')]"
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_SEPARATOR = np.isin(np.arange(256), list(SEPARATORS))
_CLOSING = np.isin(np.arange(256), list(CLOSING))
#: Closing marks outside ASCII, as their last UTF-8 bytes: … ” ’ »
_CLOSING_WIDE = ("…".encode(), "”".encode(), "’".encode(), "»".encode())
FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_lines bigint, n_failed_lines bigint, kept_chars bigint"
)


def _later_copies(keys: np.ndarray) -> np.ndarray:
    """Marks every key that has been seen at a smaller index."""
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return later


def _repeat_words(hashes, rows, n):
    """Words that lie in windows of WINDOW words found at least twice in their text."""
    grams = combine(hashes, WINDOW)
    whole = rows[: len(grams)] == rows[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return np.zeros(n, np.int64)
    keys = per_row_key(grams[at], rows[at])
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    at = at[counts[inverse] > 1]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return per_row((np.cumsum(edge[:-1]) > 0).astype(np.int64), rows, n)


def _phrase_lines(data, line_starts, line_ends):
    lower, hit = LOWER[data].tobytes(), np.zeros(len(line_starts), bool)
    for phrase in PHRASES:
        sought, at = phrase.encode(), -1
        while (at := lower.find(sought, at + 1)) >= 0:
            line = np.searchsorted(line_starts, at, side="right") - 1
            hit[line] |= at + len(sought) <= line_ends[line]
    return hit


def judge(data: np.ndarray, offsets: np.ndarray):
    """Per text the measures of FIELDS; beside them all lines and which of them fail."""
    n = len(offsets) - 1
    starts, ends, rows = words(data, offsets, WHITE)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = lead[ends] - lead[starts]
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])

    # lines in order of text: an empty text has one empty line, so starts alone don't tell the text
    breaks = np.flatnonzero(data == 0x0A)
    in_text = np.diff(np.searchsorted(breaks, offsets))
    line_rows = np.repeat(np.arange(n), in_text + 1)
    first = np.cumsum(in_text + 1) - in_text - 1
    line_starts = np.empty(len(line_rows), np.int64)
    inner = np.ones(len(line_rows), bool)
    inner[first] = False
    line_starts[first], line_starts[inner] = offsets[:-1], breaks + 1
    line_ends = np.empty(len(line_rows), np.int64)
    final = first + in_text
    inner[:] = True
    inner[final] = False
    line_ends[final], line_ends[inner] = offsets[1:], breaks
    lines = len(line_starts)
    word_line = np.searchsorted(line_starts, starts, side="right") - 1
    line_words = per_row(np.ones(len(starts)), word_line, lines)
    line_chars = per_row(chars, word_line, lines)
    line_symbols = symbols[line_ends] - symbols[line_starts]
    has_word = line_words > 0

    hashes = span_hashes(data, starts, ends)
    line_keys = per_row_key(span_hashes(data, line_starts, line_ends, 11), line_rows)
    copies = np.zeros(lines, bool)
    held = np.flatnonzero(has_word)
    copies[held] = _later_copies(line_keys[held])

    lone = (ends - starts == 1) & _SEPARATOR[data[starts]] if len(starts) else np.zeros(0, bool)
    last, long = data[ends - 1] if len(ends) else data[:0], ends - starts >= 2
    shout = long & ((last == 0x21) | (last == 0x3F)) & (data[np.maximum(ends - 2, 0)] == last) if len(ends) else long
    last_word = np.zeros(lines, np.int64)
    last_word[word_line] = np.arange(len(starts))
    closed = np.zeros(lines, bool)
    if len(starts):
        closing = _CLOSING[last]
        for mark in _CLOSING_WIDE:
            ok = ends - starts >= len(mark)
            for k, byte in enumerate(mark):
                ok = ok & (data[np.maximum(ends - len(mark) + k, 0)] == byte)
            closing = closing | ok
        closed = closing[last_word]
    phrased = _phrase_lines(data, line_starts, line_ends) & (line_words <= PHRASE_WORDS)
    failed = has_word & (
        copies | phrased
        | (4 * per_row(lone, word_line, lines) >= line_words)
        | (10 * line_symbols > line_chars)
        | (10 * per_row(shout, word_line, lines) >= 3 * line_words)
        | ((line_words < 3) & ~closed)
    )
    measures = [
        per_row(np.ones(len(starts)), rows, n), per_row(chars, rows, n), symbols[offsets[1:]] - symbols[offsets[:-1]],
        per_row(copies, line_rows, n), _repeat_words(hashes, rows, n),
        per_row(has_word, line_rows, n), per_row(failed, line_rows, n),
        per_row(np.where(failed, 0, line_chars), line_rows, n),
    ]
    return measures, (line_starts, line_ends, line_rows, failed)


def _clean(data, offsets):
    measures, (starts, ends, rows, failed) = judge(data, offsets)
    raw, texts = data.tobytes(), []
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    lost = np.add.reduceat(np.append(failed, False), bounds[:-1]) if len(offsets) > 1 else []
    for k in range(len(offsets) - 1):
        a, b = bounds[k], bounds[k + 1]
        if not lost[k]:
            texts.append(raw[offsets[k] : offsets[k + 1]])
        else:
            texts.append(b"\n".join(raw[starts[i] : ends[i]] for i in range(a, b) if not failed[i]))
    return [*measures, pa.array(texts, pa.binary()).cast(pa.string())]


def _verdict(df: DataFrame) -> DataFrame:
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    enough = 100 * F.col("kept_chars") >= (100 - LOSS_PERCENT) * F.col("word_chars")
    return df.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & enough)


def measure(docs: DataFrame, keep=("doc_id",), column="text") -> DataFrame:
    """Columns `keep`, the measures, base_failed and kept of each document."""
    return _verdict(map_texts(docs, lambda d, o: judge(d, o)[0], FIELDS, keep, column))


def clean(docs: DataFrame, keep=("doc_id",), column="text") -> DataFrame:
    """As `measure`, with the text of the lines that passed as `clean_text`."""
    return _verdict(map_texts(docs, _clean, FIELDS + ", clean_text string", keep, column))


def op5_quality_rules(spark, sf_dir) -> DataFrame:
    return measure(documents(spark, sf_dir))


_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS body FROM documents
), words AS (SELECT k, doc_id, body, {_WORDS.format('body')} AS w FROM docs),
counts AS (
  SELECT k, doc_id, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols
  FROM words
), grams AS (
  SELECT k, i, array_to_string(w[i:i + 7], ' ') AS gram
  FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM words)
), hits AS (
  SELECT DISTINCT k, i + j AS place FROM (
    SELECT k, i FROM grams QUALIFY count(*) OVER (PARTITION BY k, gram) > 1
  ), (SELECT unnest(range(0, 8)) AS j)
), repeats AS (SELECT k, count(*) AS n_repeat_words FROM hits GROUP BY k),
lines AS (
  SELECT k, line, {_WORDS.format('line')} AS w, row_number() OVER (PARTITION BY k, line ORDER BY place) AS copy
  FROM (SELECT k, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS place FROM docs)
), tested AS (
  SELECT k, copy > 1 AS dup, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars,
    copy > 1
    OR len(w) <= {PHRASE_WORDS} AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{'|'.join(PHRASES)}')
    OR 4 * len(list_filter(w, lambda x: x IN ('|', '>', '/'))) >= len(w)
    OR 10 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > list_sum(list_transform(w, lambda x: length(x)))
    OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '(!!|\?\?)$'))) >= 3 * len(w)
    OR len(w) < 3 AND NOT regexp_matches(w[-1], '[.!?:;"'')\]…”’»]$') AS failed
  FROM lines WHERE len(w) > 0
), by_line AS (
  SELECT k, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines,
         coalesce(sum(chars) FILTER (NOT failed), 0)::BIGINT AS kept_chars
  FROM tested GROUP BY k
), joined AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(kept_chars, 0) AS kept_chars,
         n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed
  FROM counts LEFT JOIN repeats USING (k) LEFT JOIN by_line USING (k)
)
SELECT *, NOT base_failed AND 100 * kept_chars >= {100 - LOSS_PERCENT} * word_chars AS kept FROM joined
"""
