import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemill.llm.encoding import encoder, pieces
from prosemill.llm.packing import CAPACITY, fill, packed, sequences
from prosemill.llm.token_counts import by_bytes, token_counts

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a  b\n\n c ", "don't we're 'tis ''s", "x<|endoftext|>y", "中文 и русский ñ é", "tab\t\ttab \n", "a" * 3000, "1234567 89", "é \xa0 \x85 nbsp"]


def rows(spark):
    data = [(1, "two words", "x"), (2, None, "y"), (3, "", "z"), (1, "two words", "x"), (None, "no id", "w"), (4, "word " * 5000, "v")]
    return spark.createDataFrame(data, "doc_id long, text string, n_tokens string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_ids_are_the_librarys(name):
    e = encoder(name)
    rng = random.Random(1)
    made = ["".join(rng.choice("ab '\n\t.,1é—s") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for text in ODD + made:
        assert list(e.ids(text)) == list(e.slow(text)), text


def test_every_common_character():
    e = encoder("byte_bpe_50k.json")
    for c in [*range(0x20), *range(0x20, 0x250), *range(0x2010, 0x2060), 0x20AC, 0x3000, 0x1F600]:
        for text in (chr(c), f"a{chr(c)}b", f" {chr(c)} ", f"1{chr(c)}{chr(c)}x"):
            assert list(e.ids(text)) == list(e.slow(text)), hex(c)


def test_long_texts_are_cut_safely():
    text = "ab cd's\n\n  e " * 400
    parts = list(pieces(text, 100))
    e = encoder("byte_bpe_50k.json")
    assert "".join(parts) == text and len(parts) > 20
    assert [i for p in parts for i in e.slow(p)] == list(e.slow(text)) and list(pieces("x" * 500, 100)) == ["x" * 500]


def test_counts(spark):
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_counts(rows(spark)).collect()}
    e = encoder("byte_bpe_50k.json")
    assert got[(1, 9)] == (len(e.slow("two words")), False) and got[(2, 0)] == (0, False) and got[(4, 25000)][1] and (None, 5) in got
    assert token_counts(rows(spark)).count() == 6 and token_counts(rows(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_a_whole_table(spark, name):
    """Against the library itself, whole texts one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    e = encoder(name)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, vocabulary=name).collect()}
    want = {r.doc_id: (len((r.text or "").encode()), n := len(e.slow(r.text or "")), n > 1024) for r in docs.collect()}
    assert got == want


def test_batch_lengths_with_special_strings():
    e = encoder("byte_bpe_50k.json")
    long = " ".join(f"w{k} <|endoftext|>" if k % 900 == 7 else f"w{k}'s\n" for k in range(60_000))
    assert len(e.parts(long)) > 1
    assert e.lengths([*ODD, long]).tolist() == [len(e.slow(t)) for t in [*ODD, long]] and e.lengths([]).tolist() == []


def test_batches_are_balanced():
    import pyarrow as pa

    got = list(by_bytes(pa.array(["a" * 10, None, "b" * 30, "c", "é" * 10]), 20))
    assert got == [["a" * 10, ""], ["b" * 30], ["c"], ["é" * 10]] and list(by_bytes(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("seed", range(20))
def test_fill_is_closest(seed):
    rng = random.Random(seed)
    lengths = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
    capacity = rng.randint(0, 60)
    sums = {0}
    for n, k in lengths.items():
        sums = {s + n * i for s in sums for i in range(k + 1)}
    chosen = fill(lengths, capacity)
    assert all(0 < k <= lengths[n] for n, k in chosen.items())
    assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= capacity)


def test_sequences_hold_every_id_once():
    rng = np.random.default_rng(2)
    docs = [(k, rng.integers(0, 9, rng.integers(1, 3000)).astype(np.uint32)) for k in range(300)]
    found = list(sequences(iter(docs), CAPACITY))
    by_doc = {}
    for pieces_ in found:
        size = sum(len(p[2]) for p in pieces_)
        assert size == CAPACITY or size & (size - 1) == 0
        for doc, start, ids, n in pieces_:
            by_doc.setdefault(doc, []).append((start, ids))
            assert n == len(docs[doc][1])
    for doc, ids in docs:
        parts = sorted(by_doc[doc], key=lambda p: p[0])
        assert np.array_equal(np.concatenate([p[1] for p in parts]), ids) and parts[0][0] == 0


def test_packed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = packed(docs).toPandas()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    e = encoder("byte_bpe_50k.json")
    for doc, part in out.groupby("doc_id"):
        ids = np.append(np.asarray(e.slow(texts[doc] or ""), np.uint32), 0)
        at = 0
        for r in part.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and (s.length.sum() == 1024 or s.length.sum() & (s.length.sum() - 1) == 0)
    edge = packed(rows(spark)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in edge}[2] == 1 and packed(rows(spark).limit(0)).count() == 0
    assert packed(rows(spark), with_ids=True).where("size(ids) <> length").count() == 0
