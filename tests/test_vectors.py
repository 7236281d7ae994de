import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.errors import ClusteringError
from sylvan.functions import vectors as V
from sylvan.operators import clustering as K


def test_cosine_distance(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [0.0, 2.0]), (3, [0.0, 0.0], [1.0, 1.0]), (4, [1.0], [1.0, 2.0]), (5, None, [1.0]), (6, [float("nan")], [1.0]), (7, [float("inf")], [1.0]), (8, [1.0, 1.0], [-1.0, -1.0])]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "k int, a array<double>, b array<double>").select("k", F.round(V.cosine_distance(F.col("a"), F.col("b")), 9)).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 1.0, 4: None, 5: None, 6: None, 7: None, 8: 2.0}


def test_soft_assignment(spark):
    p = [[0.9, 0.1], [0.9, 0.1], [0.45, 0.55], [0.1, 0.9], [0.1, 0.9], [0.1, 0.9]]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(p)] + [(2, 0, [0.0, 0.0, 0.0])], "doc_id long, ord int, p array<double>")
    got = sorted((r.doc_id, r.cluster_id, r.ord) for r in K.soft_membership(rows, ["doc_id"], "ord", "p", 0.4).collect())
    assert got == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 1, 2), (1, 1, 3), (1, 1, 4), (1, 1, 5), (2, 0, 0)]


def test_forced_reduction(spark):
    m = spark.createDataFrame([(1, i, i) for i in range(3)] + [(2, i, i) for i in range(20)] + [(3, i // 2, i) for i in range(4)] + [(4, 0, 0)], "doc_id long, cluster_id int, ord int")
    n = m.groupBy("doc_id").agg(F.count("*").alias("n"))
    got = {(r.doc_id, r.cluster_id, r.stuck) for r in K.forced(m, n, ["doc_id"]).collect()}
    assert got == {(1, 0, False), (3, 0, False), (3, 1, False), (4, 0, False)} | {(2, i, True) for i in range(20)}


def test_mixture_separates_blobs(spark):
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal(c, 0.1, (10, 2)) for c in ((0, 0), (5, 5), (10, 0))])
    rows = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)] + [(2, i, [1.0, 2.0]) for i in range(5)], "doc_id long, ord int, embedding array<float>")
    p = K.mixture(rows, n_clusters=3)
    got = {}
    for r in K.soft_membership(p, ["doc_id"], "ord", "probabilities").collect():
        got.setdefault((r.doc_id, r.cluster_id), set()).add(r.ord)
    assert sorted(map(sorted, (v for k, v in got.items() if k[0] == 1))) == [list(range(10)), list(range(10, 20)), list(range(20, 30))]
    assert got[(2, 0)] == set(range(5))
    assert K.choose_k(K.reduce(x)) >= 2


def test_large_groups_go_the_distributed_way(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(1, i, rng.normal(i % 2 * 9, 0.1, 8).tolist()) for i in range(40)], "doc_id long, ord int, embedding array<float>")
    p = K.mixture(rows, n_clusters=2, large=10)
    groups = {}
    for r in K.soft_membership(p, ["doc_id"], "ord", "probabilities").collect():
        groups.setdefault(r.cluster_id, set()).add(r.ord)
    assert sorted(map(sorted, groups.values())) == [list(range(0, 40, 2)), list(range(1, 40, 2))]


@pytest.mark.parametrize("bad", [[float("nan"), 0.1], [float("inf"), 0.1], [0.1], None])
def test_unusable_vectors_raise(spark, bad):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, bad)], "doc_id long, ord int, embedding array<float>")
    with pytest.raises(ClusteringError, match="NaN or Infinity"):
        K.mixture(rows)


def test_bic_counts_parameters():
    assert math.isclose(K.bic(-10.0, 100, 2, 3), 20 + (3 * 3 + 3 * 2 + 2) * math.log(100))
