import duckdb
import pytest

import __spark_entry__ as entry
from prosemill import queries as prose

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return found


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple("" if r[k] is None else f"{r[k]:.6g}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(prose.ORACLE_SQL))
def test_oracle(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_make_rows(spark):
    assert not [n for n in sorted(prose.ORACLE_SQL) if entry.queries()[n](spark, SF).isEmpty()]


def test_long_documents_fit(spark):
    """20,000 words of which every one begins a term."""
    from prosemill.operators import native

    docs = spark.createDataFrame([(1, "the of " * 10_000)], "doc_id long, text string")
    terms = spark.createDataFrame([("the of", "a"), ("of the", "b"), ("the", "c")], "term string, entry_id string")
    assert native.vocab_hits(docs, terms, 2).count() == 19_999
    assert native.spans(docs, "the").agg({"start": "max"}).first()[0] == 7 * 9_999


def test_kernel_counts_agree_with_native(spark):
    a = {str(r.doc_id): r.words for r in entry.queries()["doc_word_count"](spark, SF).collect()}
    b = {r.path: r.word_count for r in entry.queries()["doc_stats"](spark, SF).collect()}
    assert sum(a[k] != b[k] for k in a) <= 0.02 * len(a)  # masked code and URLs are no words
