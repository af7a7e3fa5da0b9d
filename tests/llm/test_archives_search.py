import gzip
import hashlib
import io
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemill.llm import topk, warc


def test_round_trip(spark, tmp_path):
    big, eol = "<p>" + "x" * 5_000, "a\r\n\r\nWARC/1.1\r\n\r\nb" * 10
    data = [(5, "http://a/1", big, 1), (3, "http://a/2", big, 1), (9, None, big, 1), (1, "u v\r\n", "small", 1), (2, "", "small", 1), (4, "é", None, 1), (6, "x", "", 1), (7, "y", eol, 1), (8, "z", eol, 1), (None, "n", big, 1), (3, "http://a/2", big, 1), (10, "w", "é" * 60, 1)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, refers_to int")
    folder = str(tmp_path / "warc")
    manifest = warc.archived(pages, folder)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(data)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, folder + "2").collect())
    want = []
    for page, _, text, _ in data:
        payload = (text or "").encode()
        same = [p for p, _, t, _ in data if (t or "").encode() == payload and p is not None]
        first = min(same) if same and len(payload) >= 100 and page is not None else page
        want.append((str(page), len(payload), hashlib.sha256(payload).hexdigest(), "response" if first == page else "revisit", None if first == page else first))
    assert got == sorted(want)
    chunks = warc.chunk_table(manifest, size=1000).where("record_type = 'response'").orderBy("record_id", "chunk_no").collect()
    # the id that stands twice has two responses
    assert sorted(r.chunk_no for r in chunks if r.record_id == 3) == sorted([*range(6)] * 2) and all(len(r.data) <= 1000 for r in chunks)
    assert b"".join(bytes(r.data) for r in chunks if r.record_id == 7) == eol.encode() and b"".join(bytes(r.data) for r in chunks if r.record_id is None) == big.encode()
    assert warc.round_trip(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_many_archives_have_many_readers(spark, tmp_path):
    pages = spark.range(400).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 40) as html").repartition(16)
    manifest = warc.archived(pages, str(tmp_path / "warc"))
    table = warc.chunk_table(manifest)
    assert manifest.count() == 16 and table.where("is_last").count() == 400
    assert table.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_damage_is_found():
    digest = hashlib.sha256(b"payload").hexdigest()
    head, http = warc.head(1, "http://a", 7, digest, None, warc.DATE)
    whole = head + http + b"payload\r\n\r\n"
    stream = lambda b: io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(b))))
    assert [c[3] for c in warc.chunks(stream(whole * 2), 3)] == [3, 6, 7] * 2
    for bad in (whole.replace(b"payload", b"payl0ad"), whole[:-8]):
        with pytest.raises(ValueError):
            list(warc.chunks(stream(bad), 3))


def best_slow(rows, k):
    fine = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_search(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice([rng.uniform(-2, 2), 0.5, -0.25]) for _ in range(6)]) for k in range(700)]
    rows += [(k, rows[7][1]) for k in range(700, 760)]  # many ties
    rows += [(800, None), (900, []), (1000, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1100, [float("nan")] * 6), (1200, [float("inf")] * 6), (1300, [1.0, 2.0]), (1301, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string").repartition(7)
    got = topk.searched(df, df.where("vec_id % 100 = 0"))
    assert sorted(map(tuple, got.collect())) == best_slow(rows, 10)
    assert topk.searched(df.limit(0), df.limit(0)).count() == 0 and topk.searched(df, df.limit(0)).count() == 0


def test_large_products_stay_exact():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**20, 2.0]])
    assert topk.products(a, b).tolist() == [[2**60 + 1, 2**60 + 2]]
    with pytest.raises(OverflowError):
        topk.products(np.array([[2.0**50]]), np.array([[2.0**50]]))


def test_search_by_sql(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    db = duckdb.connect()
    db.execute("create view embeddings as select * from read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    got = topk.searched(rows, rows.where("vec_id % 100 = 0")).collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(topk.SQL).fetchall())
