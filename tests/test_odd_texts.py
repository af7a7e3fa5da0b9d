"""Queries beside their SQL on texts that the test tables don't hold."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry


def both(spark, folder, name, texts):
    """A query's rows and its SQL's over documents of these texts."""
    at = f"{folder}/documents.parquet"
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), at)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{at}')")
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, str(folder)).select(*columns)
    return sorted(map(tuple, got.collect()), key=str), sorted(want.fetchall(), key=str)


# sentences of one word and one of many: a variation of 4.35 but for the last bits of a sum
SUMS = ["Lee. " * 25 + "Reen " * 175, "Lee. " * 25 + "\n\n" + "reen " * 174 + "end."]


@pytest.mark.parametrize("name", ["metric_findings"])
def test_last_bits_show_nowhere(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, SUMS)
    assert got == want and any(r[-1] == "4.3 is much" for r in got)


EMPTY = [None, "", " ", "\n", "x", "Plain text of a document."]


@pytest.mark.parametrize("name", ["markdown_mask", "visible_prose", "visible_runs"])
def test_empty_texts_in_markup(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, EMPTY)
    assert got == want


def test_backticks_that_nothing_closes_are_text():
    from prosemill.functions.markdown import build_regions

    assert build_regions("a `` b").masked == "a `` b"
    assert build_regions("a `` b `c`", empty_code=True).masked == "a `\0 b `\0\0"
