from collections import Counter, defaultdict

from keystrata.llm import frequency

SCHEMA = "result_id string, id string, normalizedKeyword string, occurrences int, term string, n int"


def brute(rows):
    once, occ, docs = {}, Counter(), defaultdict(set)
    for i, r in enumerate(rows):
        once[r[0] if r[0] is not None else i] = r
    for _, d, t, n, *_ in once.values():
        if t is not None and t.strip():
            occ[t] += n or 0
            docs[t] |= {d} - {None}
    return {(t, occ[t], len(docs[t])) for t in occ}


def test_term_frequencies(spark):
    rows = [(f"r{i}", f"d{i % 37}", "hot" if i % 3 == 0 else f"t{i % 101}", i % 4 or None, "clash", 1) for i in range(3000)]
    rows += [("r5", "d5", "t5", 1, "again", 2), (None, "d1", "t1", 2, None, None), (None, "d1", "t1", 2, None, None), ("x1", None, "lonely", 3, None, None)]
    rows += [("x2", "d1", None, 3, None, None), ("x3", "d1", "  ", 3, None, None), ("x4", "d1", "long" * 20_000, 3, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for per_block, slices in ((20_000, 8), (7, 3)):
        found = {tuple(r) for r in frequency.term_frequencies(df, terms_per_block=per_block, slices=slices).collect()}
        assert found == brute(rows)


def test_marks_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert frequency.term_frequencies(empty).count() == 0 and frequency.count_records(empty) == 0
    f = spark.createDataFrame([("both", 2, 5), ("none", 3, 2), ("rare", 0, 0)], "term string, occurrences long, records long")
    assert {tuple(r) for r in frequency.mark_terms(f, 100).collect()} == {("both", "rare"), ("both", "common"), ("rare", "rare")}


def test_dictionary_is_stable(spark):
    terms = spark.range(500).selectExpr("concat('t', id) AS term")
    a, b = (sorted(map(tuple, frequency.term_dictionary(t, blocks=4).collect())) for t in (terms, terms.repartition(7)))
    assert a == b and len({r[3] for r in a}) == 500


def test_arrays_are_given_out_block_by_block():
    import pandas as pd

    rows = pd.DataFrame({"block": [0, 0, 0, 1, 1, 2], "part": [0, 0, 1, 0, 0, 3], "slot": [0, 5, 1, 2, 2, 0], "occurrences": [1, 2, 3, 4, 5, 6], "records": [1] * 6})
    made = pd.concat(frequency._accumulate(iter([rows[:1], rows[1:4], rows[4:]])))
    assert [(b, p, int(o.sum()), int(h.sum())) for b, p, o, h in made.itertuples(index=False)] == [(0, 0, 3, 2), (0, 1, 3, 1), (1, 0, 9, 2), (2, 3, 6, 1)]
    assert not list(frequency._accumulate(iter([])))


def test_queries_follow_sql(spark):
    import os

    import duckdb
    import pytest

    from keystrata.llm import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW kaggle_excerpt AS SELECT * FROM '{folder}/kaggle_excerpt.parquet'")
    for name, sql in queries.oracle_sql().items():
        ours = queries.queries()[name](spark, folder).toPandas()
        theirs = con.execute(sql).df()[list(ours.columns)]
        assert sorted(map(str, ours.itertuples(index=False, name=None))) == sorted(map(str, theirs.itertuples(index=False, name=None)))
