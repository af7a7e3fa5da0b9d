import math
import random

import numpy as np
import pytest

from prosemill.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def segments_slow(scores):
    """All maximal-scoring segments by their definition: take the best, then both sides; ties to the shortest, first."""
    def best(lo, hi):
        top = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 1e-12 and (top is None or total > top[0] + 1e-12):
                    top = (total, i, j + 1)
        if top is None:
            return []
        return best(lo, top[1]) + [(top[1], top[2], top[0])] + best(top[2], hi)

    return best(0, len(scores))


@pytest.mark.parametrize("seed", range(60))
def test_maximal_segments(seed):
    rng = random.Random(seed)
    scores = np.array([rng.uniform(-3, 2) for _ in range(rng.randint(0, 25))])
    got = toxicity.segments(scores)
    want = segments_slow(scores)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_the_scan_is_linear():
    """Text that drifts downwards: every run's search would go back to the start."""
    import time

    scores = np.tile([1.0, -1.5], 60_000)
    began = time.perf_counter()
    assert toxicity.segments(scores) == [(2 * k, 2 * k + 1, 1.0) for k in range(60_000)]
    assert time.perf_counter() - began < 2


def test_toxicity_scores_by_brute_force():
    """Evidence and score of texts, from the definition of segments and the law of their maxima."""
    model = toxicity.Model({"vile": 1.5, "foul": 0.8, "kind": -0.6, "vile*": 0.9}, rate=0.9, k=0.2, bias=-1.0, slope=1.3)
    value = {"vile": 1.5, "foul": 0.8, "kind": -0.6, "vilest": 0.9, "table": toxicity.UNKNOWN}
    rng, scorer = random.Random(6), toxicity.Scorer(model)
    for n in [0, 1, 2, 8, 20, 24]:
        words = [rng.choice(list(value)) for _ in range(n)]
        met, scores = {}, []
        for w in words:
            if value[w] > 0:
                met[w] = met.get(w, 0) + 1
            scores.append(value[w] / met.get(w, 1) if value[w] > 0 else value[w])
        excess = [0.9 * s - math.log(0.2 * n) for _, _, s in segments_slow(scores)]
        want = sum(x for x in excess if x > 0)
        evidence, kept = scorer.evidence(" ".join(words))
        assert evidence == pytest.approx(want) and len(kept) == sum(x > 0 for x in excess)
        assert scorer.score(evidence) == pytest.approx(1 / (1 + math.exp(1.0 - 1.3 * math.log1p(want))))


def test_rate_solves_its_equation():
    s, p = np.array([-1.0, 2.0]), np.array([0.9, 0.1])
    rate = toxicity.solved_rate(s, p)
    assert math.isclose(float(p @ np.exp(rate * s)), 1.0, rel_tol=1e-6)


def test_log_odds_need_evidence():
    assert toxicity.log_odds(200, 0, 10_000, 90_000) > 2 > toxicity.log_odds(2, 1, 10_000, 90_000)
    assert toxicity.log_odds(10, 90, 10_000, 90_000) < 0


def edge(spark):
    rows = [(1, "fine words here", 1, 0.0), (2, None, 0, 0.0), (3, "", 0, 0.0), (None, "x", 0, 0.0), (1, "fine words here", 1, 0.0), (5, "w " * 50_000, 1, 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, predicted int, score double")


def held(out, labels, name):
    x = out.join(labels, "doc_id").where("held_out").toPandas()
    y, s = x[name].to_numpy(), x.score.to_numpy()
    pairs = (s[y == 1][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).mean()
    return pairs, (x.predicted == x[name]).mean()


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fitted(docs, labels)
    auc, accuracy = held(quality.scored(docs, model), labels, "quality")
    assert auc > 0.9 and accuracy > 0.85
    got = quality.scored(edge(spark), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    assert quality.scored(edge(spark), model, keep=True).columns.count("score") == 1 and quality.scored(edge(spark).limit(0), model).count() == 0


def test_quality_scores_whole_texts():
    model = quality.trained([(["good", "prose"], 1), (["bad!!", "junk!!"], 0)] * 40)
    s = quality.Scorer(model)
    good, mixed, bad = s.scores(["good prose " * 500, "good prose " * 500 + "bad!! junk!! " * 2000, "bad!! junk!!"])
    assert good > 0.5 > mixed > bad and s.scores(["good prose"])[0] == pytest.approx(good)


def test_quality_scores_by_brute_force(spark):
    """The mean over words and marks of the mean weight of each word's features, word by word, over a whole table."""
    rng = np.random.default_rng(4)
    model = quality.Model(rng.normal(0, 3, quality.BUCKETS).astype(np.float32), -0.2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    for r in docs.collect():
        words = (r.text or "").split()
        each = {w: float(np.mean(model.weights[quality.features([w])[1]].astype(float))) for w in set(words)}
        parts = [each[w] for w in words] + [float(model.weights[quality.REPEATED])] * sum(a == b for a, b in zip(words, words[1:]))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, model.bias + (sum(parts) / len(parts) if parts else 0))))), abs=1e-6)


def test_quality_learns_from_whole_texts(spark):
    """Long texts that differ only between sixteen evenly spread runs of sixteen words."""
    rng = random.Random(8)
    runs = {a + k for a in np.linspace(0, 984, 16).astype(int).tolist() for k in range(16)}
    text = lambda mark: " ".join(f"word{rng.randrange(50)}" if k in runs else mark for k in range(1000))
    rows = [(k, text("prose" if k % 2 else "junk"), k % 2) for k in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, label) for k, _, label in rows], "doc_id long, quality int")
    good, bad = quality.Scorer(quality.fitted(docs, labels)).scores([text("prose"), text("junk")])
    assert good > 0.8 and bad < 0.2


def test_training_again_gives_the_same():
    rows = [(["a", "b"], 1), (["c"], 0), ([], 1)] * 5
    a, b = quality.trained(rows), quality.trained(rows)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_toxicity(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fitted(docs, labels)
    auc, accuracy = held(toxicity.scored(docs, model), labels, "toxic")
    assert auc > 0.95 and accuracy > 0.95
    got = toxicity.scored(edge(spark), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and toxicity.scored(edge(spark).limit(0), model).count() == 0


def test_empty_labels(spark):
    docs = edge(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.scored(docs, quality.fitted(docs, labels)).count() == 6
    assert toxicity.scored(docs, toxicity.fitted(docs, labels)).count() == 6


def test_held_out_labels_are_not_learnt(spark):
    import zlib

    ids = [k for k in range(300) if zlib.crc32(str(k).encode()) % 3 == 1]
    docs = spark.createDataFrame([(k, f"word{k}") for k in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in ids], "doc_id long, quality int, toxic int")
    assert quality.fitted(docs, labels).bias == 0 and not toxicity.fitted(docs, labels).scores
