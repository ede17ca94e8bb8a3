"""Every operator and the pipeline on odd tables: against SQL where there is some, else for defined results."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from barline.llm.catalog import ORACLES, QUERIES
from tools.check import compare

ON_DOCUMENTS = [name for name in QUERIES if not name.startswith(("op7_", "op11_"))]
#: Their results depend on how often a row occurs.
COUNTING = ("op6_mix_sources", "op9_toxicity", "op10_weak_quality", "op12_spelling_variants", "op13_merkle_manifest")


def key(row):
    return repr(tuple(row))


@pytest.mark.parametrize("name", [n for n in ON_DOCUMENTS if n in ORACLES and n != "op6_mix_sources"])
def test_odd_texts_match_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet')")
    text, good = compare(spark, con, odd, name, QUERIES[name], ORACLES[name])
    assert good, text


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_merkle_manifest"])
def test_repeated_and_unnamed_rows_match_sql(spark, repeated, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{repeated}/documents.parquet')")
    text, good = compare(spark, con, repeated, name, QUERIES[name], ORACLES[name])
    assert good, text


@pytest.mark.parametrize("name", [n for n in ON_DOCUMENTS if n not in COUNTING])
def test_repeated_rows_get_the_same_result(spark, odd, repeated, name):
    once = sorted(key(r) for r in QUERIES[name](spark, odd).collect())
    rows = QUERIES[name](spark, repeated).collect()
    named = sorted(key(r) for r in rows if r.doc_id is not None)
    assert len(rows) == len(named) // 2 * 3
    if name != "op2_suffix_array_dedup":  # there the rows without doc_id come first and hold the first copies
        assert named == sorted(once * 2)


def test_training_operators_on_repeated_rows(spark, repeated):
    for name in ("op9_toxicity", "op10_weak_quality"):
        rows = QUERIES[name](spark, repeated).collect()
        assert len(rows) == 72 and all(0 <= r.score <= 1 for r in rows)
        by_id = {}
        for r in rows:
            if r.doc_id is not None:
                by_id.setdefault(r.doc_id, set()).add(r.score)
        assert all(len(s) == 1 for s in by_id.values())


def test_mixing_on_odd_rows(spark, repeated):
    rows = QUERIES["op6_mix_sources"](spark, repeated).collect()
    counts = {}
    for r in rows:
        if r.doc_id is not None:
            counts[(r.doc_id, r.source, r.copy)] = counts.get((r.doc_id, r.source, r.copy), 0) + 1
    assert rows and {n for (d, s, c), n in counts.items() if (d % 7 == 0) == ((d + 24) % 7 == 0)} <= {1, 2}


def test_entry_lists_them():
    assert {*QUERIES, "pipeline"} <= set(entry_point.queries())
