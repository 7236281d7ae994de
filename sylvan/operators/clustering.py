"""Grouping of a level's nodes: routing by size, hard and soft assignment, mixture models.

A group (one level of one document) within ``large`` nodes is fitted in one task; larger ones go, all
of them together, through principal components and k-means made of sums by document, so no task
holds an unbounded group and the driver sees none of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.errors import ClusteringError
from sylvan.functions import vectors as V
from sylvan.session import cut, drop

#: At most this many nodes form one cluster without a model.
TRIVIAL = 5
#: Below this, a level that clustering did not shrink is merged whole; from it on, it stops.
FORCE_BELOW = 20


def route(n: Column, large: int = 20_000) -> Column:
    """How a level of ``n`` nodes is clustered."""
    return F.when(n == 0, "none").when(n <= TRIVIAL, "single").when(n > large, "approximate").otherwise("mixture")


def check_vectors(rows: DataFrame, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """``key, vectors, missing, not_finite, dim_min, dim_max, usable`` for each group: dimensions must be
    positive and the same, elements finite as float32."""
    e = F.col(vector).cast("array<float>")
    bad = e.isNotNull() & ~V.finite(e)
    g = rows.groupBy(key).agg(
        F.count("*").alias("vectors"),
        F.sum(e.isNull().cast("long")).alias("missing"),
        F.sum(bad.cast("long")).alias("not_finite"),
        F.min(F.size(e)).alias("dim_min"),
        F.max(F.size(e)).alias("dim_max"),
    )
    ok = (F.col("missing") == 0) & (F.col("not_finite") == 0) & (F.col("dim_min") > 0) & (F.col("dim_min") == F.col("dim_max"))
    return g.withColumn("usable", F.coalesce(ok, F.lit(False)))


def hard_groups(labels: DataFrame, keys: list[str], label: str, node: str) -> DataFrame:
    """``keys, label, members``: the sorted members of each label."""
    return labels.groupBy(*keys, label).agg(F.sort_array(F.collect_list(node)).alias("members"), F.count("*").alias("size"))


def soft_membership(rows: DataFrame, keys: list[str], node: str, probabilities: str, threshold: float = 0.1) -> DataFrame:
    """``keys, node, cluster_id, probability``: every cluster whose probability reaches the threshold;
    where none does, the first of the most probable ones."""
    # one row for each probability; the best of a node and the node's others meet again by its key
    each = rows.where(F.size(probabilities) > 0).select(*keys, node, F.array_max(probabilities).alias("top"), F.posexplode(probabilities).alias("cluster_id", "probability"))
    first = F.min(F.when(F.col("probability") == F.col("top"), F.col("cluster_id"))).over(Window.partitionBy(*keys, node))
    kept = (F.col("probability") >= threshold) | ((F.col("top") < threshold) & (F.col("cluster_id") == F.col("first")))
    return each.withColumn("first", first).where(kept).select(*keys, node, "cluster_id", "probability")


def forced(members: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Members with ``cluster_id`` 0 where as many clusters as nodes (more than one, fewer than
    :data:`FORCE_BELOW`) came out, and ``stuck`` where there are too many to merge."""
    k = members.groupBy(*keys).agg(F.countDistinct("cluster_id").alias("k"))
    same = (F.col("k") == F.col("n")) & (F.col("n") > 1)
    m = members.join(k, keys).join(counts.select(*keys, "n"), keys)
    return m.withColumn("cluster_id", F.when(same & (F.col("n") < FORCE_BELOW), 0).otherwise(F.col("cluster_id"))).withColumn("stuck", same & (F.col("n") >= FORCE_BELOW)).drop("k", "n")


def best_k(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The cluster number of least criterion, the smallest on ties."""
    return scores.groupBy(*keys).agg(F.min(F.struct("bic", "k")).alias("m")).select(*keys, F.col("m.k").alias("k"))


def by_order(size: int = 5) -> Callable[[DataFrame], DataFrame]:
    """The deterministic clusterer: ``size`` neighbours in order form a cluster."""
    return lambda nodes: nodes.withColumn("cluster_id", F.floor(F.col("ord") / size).cast("int"))


def reduce(x: np.ndarray, components: int = 2) -> np.ndarray:
    """Principal components of the rows, signs fixed."""
    y = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(y, full_matrices=False)
    vt = vt[:components]
    vt *= np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])[:, None]
    return y @ vt.T


def fit_mixture(x: np.ndarray, k: int, seed: int = 42, rounds: int = 100, ridge: float = 1e-6, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Responsibilities and total log-likelihood of a full-covariance Gaussian mixture."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    centre = [x[rng.integers(n)]]
    for _ in range(k - 1):
        gap = np.min([((x - c) ** 2).sum(axis=1) for c in centre], axis=0)
        centre.append(x[rng.choice(n, p=gap / gap.sum())] if gap.sum() > 0 else x[rng.integers(n)])
    mu = np.array(centre)
    for _ in range(10):
        label = ((x[:, None] - mu[None]) ** 2).sum(axis=2).argmin(axis=1)
        mu = np.array([x[label == j].mean(axis=0) if (label == j).any() else mu[j] for j in range(k)])
    r = np.eye(k)[label]
    before, total = -np.inf, np.zeros(n)
    for _ in range(rounds):
        weight = r.sum(axis=0) + 1e-10
        mu = r.T @ x / weight[:, None]
        log = np.empty((n, k))
        for j in range(k):
            y = x - mu[j]
            cov = (r[:, j, None] * y).T @ y / weight[j] + ridge * np.eye(d)
            chol = np.linalg.cholesky(cov)
            z = np.linalg.solve(chol, y.T)
            log[:, j] = np.log(weight[j] / n) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(chol)).sum() - 0.5 * d * np.log(2 * np.pi)
        top = log.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        r = np.exp(log - total[:, None])
        if abs(total.mean() - before) < tolerance:
            break
        before = total.mean()
    return r, float(total.sum())


def bic(likelihood: float, n: int, d: int, k: int) -> float:
    return -2 * likelihood + (k * d * (d + 1) / 2 + k * d + k - 1) * np.log(n)


def choose_k(x: np.ndarray, seed: int = 42) -> int:
    """Number of components of least criterion among 2 to min(20, n); 1 if a fit fails."""
    n, d = x.shape
    if n < 2:
        return 1
    try:
        scores = [(bic(fit_mixture(x, k, seed)[1], n, d, k), k) for k in range(2, min(20, n) + 1)]
    except np.linalg.LinAlgError:
        return 1
    return min(scores)[1]


def mixture_probabilities(x: np.ndarray, n_clusters: int | None = None, components: int = 2, seed: int = 42) -> np.ndarray:
    y = reduce(x, components)
    return fit_mixture(y, n_clusters or choose_k(y, seed), seed)[0]


def mixture(rows: DataFrame, n_clusters: int | None = None, seed: int = 42, large: int = 20_000, components: int = 2) -> DataFrame:
    """``doc_id, ord, probabilities`` for ``doc_id, ord, embedding``: groups within :data:`TRIVIAL` get one
    certain cluster, others a mixture over their principal components. Unusable vectors raise."""
    if not check_vectors(rows).where("not usable").isEmpty():
        raise ClusteringError("Embeddings contain NaN or Infinity values, are missing or differ in dimension")
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    fit = rows.join(sizes.where(F.col("n") <= large).select("doc_id"), "doc_id", "left_semi").select("doc_id", "ord", "embedding")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        x = np.array(pdf["embedding"].tolist(), dtype=np.float64)
        p = np.ones((len(x), 1)) if len(x) <= TRIVIAL else mixture_probabilities(x, n_clusters, components, seed)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "ord": pdf["ord"], "probabilities": list(p)})

    small = fit.groupBy("doc_id").applyInPandas(run, "doc_id long, ord int, probabilities array<double>")
    big = sizes.where(F.col("n") > large).select("doc_id")
    if big.isEmpty():
        return small
    labels = pca_kmeans(rows.join(big, "doc_id", "left_semi"), n_clusters, components, seed)
    k = labels.groupBy("doc_id").agg((F.max("label") + 1).alias("k"))
    one = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: (i == F.col("label")).cast("double"))
    return small.union(labels.join(k, "doc_id").select("doc_id", "ord", one.alias("probabilities")))


#: Rounds of k-means at most, and points of a document that its first centres are chosen from.
KMEANS_ROUNDS, START_POINTS = 20, 256


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each document in a batch: its rows, and as arrays their sum and the sum of their products by pairs."""
    for pdf in batches:
        out = []
        for doc, part in pdf.groupby("doc_id"):
            x = np.array(part["embedding"].tolist(), np.float64)
            out.append((doc, len(x), np.concatenate([x.sum(axis=0), (x.T @ x).ravel()])))
        yield pd.DataFrame(out, columns=["doc_id", "n", "sums"])


def _principal(components: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A document's mean and first components, from its summed moments."""
        v = pdf.sort_values("pos")["v"].to_numpy()
        d = int(np.sqrt(len(v) + 0.25))
        n = pdf["n"].iloc[0]
        mean = v[:d] / n
        values, axes = np.linalg.eigh(v[d:].reshape(d, d) / n - np.outer(mean, mean))
        axes = axes[:, np.argsort(-values, kind="stable")[:components]].T
        axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "n": [n], "mean": [mean.tolist()], "axes": [axes.tolist()]})

    return run


def _first_centres(n_clusters: int | None, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Far points of a bounded number of a document's, the first centres of its clusters."""
        x = np.array(pdf.sort_values("salt")["y"].tolist())
        n = int(pdf["n"].iloc[0])
        k = n_clusters or max(1, min(int(n**0.5), 50))
        rng = np.random.default_rng(seed)
        centre = [x[0]]
        while len(centre) < k:
            gap = np.min([((x - c) ** 2).sum(axis=1) for c in centre], axis=0)
            if gap.sum() == 0:
                break
            centre.append(x[rng.choice(len(x), p=gap / gap.sum())])
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "centres": [[c.tolist() for c in centre]]})

    return run


def pca_kmeans(rows: DataFrame, n_clusters: int | None = None, components: int = 2, seed: int = 42) -> DataFrame:
    """``doc_id, ord, label`` of ``doc_id, ord, embedding``, all documents at once: the approximate way
    for many nodes; k is min(sqrt(n), 50) if not given (fewer where points coincide).

    Moments, centres and counts are sums by document, combined before each shuffle; a document's
    own state is its covariance and its centres. Labels are without gaps."""
    some = rows.select("doc_id", "ord", "embedding")
    part = some.mapInPandas(_moments, "doc_id long, n long, sums array<double>")
    sums = part.select("doc_id", F.posexplode("sums").alias("pos", "v")).groupBy("doc_id", "pos").agg(F.sum("v").alias("v"))
    count = part.groupBy("doc_id").agg(F.sum("n").alias("n"))
    basis = sums.join(count, "doc_id").groupBy("doc_id").applyInPandas(_principal(components), "doc_id long, n long, mean array<double>, axes array<array<double>>")
    y = F.transform("axes", lambda a: F.aggregate(F.zip_with(a, F.zip_with("embedding", "mean", lambda e, m: e - m), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v))
    points = cut(some.join(basis, "doc_id").select("doc_id", "ord", "n", y.alias("y")))
    salt = F.pmod(F.xxhash64(F.lit(seed), "ord"), F.lit(START_POINTS)).alias("salt")
    start = points.groupBy("doc_id", salt).agg(F.min_by("y", "ord").alias("y"), F.first("n").alias("n"))
    centres = cut(start.groupBy("doc_id").applyInPandas(_first_centres(n_clusters, seed), "doc_id long, centres array<array<double>>"))

    def nearest(centres: DataFrame) -> DataFrame:
        gap = F.transform("centres", lambda c: F.aggregate(F.zip_with(c, "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
        both = points.join(centres, "doc_id").withColumn("gap", gap)
        return both.select("doc_id", "ord", "y", (F.array_position("gap", F.array_min("gap")) - 1).cast("int").alias("label"))

    for _ in range(KMEANS_ROUNDS):
        own = nearest(centres).groupBy("doc_id", "label").agg(F.array(*[F.avg(F.get("y", i)) for i in range(components)]).alias("c"))
        grown = own.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("label", "c"))), lambda s: F.filter(s["c"], lambda v: v.isNotNull())).alias("centres"))
        moved = cut(grown)
        done = moved.join(centres.withColumnRenamed("centres", "before"), "doc_id").where("centres <> before").isEmpty()
        drop(centres)
        centres = moved
        if done:
            break
    return nearest(centres).select("doc_id", "ord", "label")
