"""Held-out accuracy, determinism and edge cases of the toxicity scores."""

import math

from pyspark.sql import functions as F

from tidemark.llm import toxicity

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    got = toxicity.classify(docs, labels)
    assert got.count() == docs.count()
    test = got.where("held_out").join(labels, "doc_id").where("toxic is not null")
    n, right = test.count(), test.where("predicted = toxic").count()
    assert right / n >= 0.95
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_ftrl_equals_plain_formula():
    m = toxicity.Ftrl(4)
    z, n = [0.0] * 17, [0.0] * 17
    import numpy as np
    for x, y in ([1, 2], 1.0), ([2, 5], 0.0), ([1], 1.0), ([1, 2, 5], 1.0):
        m.learn(np.array(x), y)
        at = [*x, 16]
        w = {}
        for i in at:
            l1 = 0.0 if i == 16 else toxicity.L1
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.SMOOTH + math.sqrt(n[i])) / toxicity.RATE + toxicity.L2)
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.RATE * w[i]
            n[i] += g * g
    assert np.allclose(m.z, z) and np.allclose(m.n, n)


def test_cases(spark):
    rows = [(i, "you moron idiot" if i % 2 else "fine words here", "x") for i in range(60)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "Moron " * 40000, "x"), (102, "Moron " * 40000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert all(got[i].predicted == i % 2 for i in range(60)) and got[102].predicted == 1
    assert got[100].score == got[101].score and 0 <= got[100].score <= 1
    model = toxicity.fit(docs, labels)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(0, 60, 2))
    assert toxicity.classify(docs, labels.limit(0)).where("score != 0.5").count() == 0
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert toxicity.held_out is not None and F is not None
