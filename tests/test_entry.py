import re

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "keywords_seqm" in names
    assert not [n for n in names if not re.fullmatch(r"\w+", n)]


def test_queries_follow_sql(spark):
    import os

    import duckdb
    import pytest

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    for name in ("tokenize_documents", "candidate_scores_documents", "topk_no_dedup", "candidate_scores", "stopword_set_algebra", "sim_seqm", "sim_jaro", "dedup_levs", "candidate_order", "keywords_items_seqm", "date_sections", "html_text"):
        ours = entry.queries()[name](spark, folder).toPandas()
        theirs = con.execute(entry.oracle_sql()[name]).df()[list(ours.columns)]
        a, b = ({tuple(map(str, r)) for r in x.itertuples(index=False)} for x in (ours, theirs))
        assert a == b, name


def test_keywords_take_one_pass(spark):
    folder = "/root/testdata/sf0.001"
    plan = entry.queries()["topk_no_dedup"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "hashpartitioning" not in plan
