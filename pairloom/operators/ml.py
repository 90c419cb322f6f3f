"""Vectors and small models: scalers, PCA, probes, neighbours, centroids, medoids, density clusters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import vectors as V
from pairloom.operators import density

MOST_POINTS = 10_000


def scaler(df: DataFrame, vector: str) -> DataFrame:
    """(k, mean, std) of each coordinate, population std, 1 for a constant one."""
    e = df.select(F.posexplode(vector).alias("k", "x"))
    return e.groupBy("k").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("_s")).select("k", "mean", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0).alias("std"))


def scaled(df: DataFrame, vector: str, fitted: DataFrame, out: str = "scaled") -> DataFrame:
    """df with (x - mean) / std of each coordinate; the fitted rows are one for each coordinate."""
    rows = fitted.orderBy("k").collect()
    mean, std = F.array(*[F.lit(r["mean"]) for r in rows]), F.array(*[F.lit(r["std"]) for r in rows])
    return df.withColumn(out, F.zip_with(F.zip_with(F.col(vector), mean, lambda x, m: x.cast("double") - m), std, lambda x, s: x / s))


def centroids(df: DataFrame, vector: str, by: str) -> DataFrame:
    """(by, centroid)."""
    e = df.select(by, F.posexplode(vector).alias("k", "x")).groupBy(by, "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return e.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda z: z["x"]).alias("centroid"))


def medoids(df: DataFrame, vector: str, name: str, by: str) -> DataFrame:
    """(by, medoid, distance): the row nearest to the centroid, ties by name. The centroids, one a group, meet the rows by a join."""
    d = df.join(centroids(df, vector, by), by).withColumn("_d", V.euclidean(F.col(vector), F.col("centroid")))
    best = d.groupBy(by).agg(F.min(F.struct(F.round("_d", 9).alias("d"), F.col(name).alias("name"))).alias("b"))
    return best.select(by, F.col("b.name").alias("medoid"), F.col("b.d").alias("distance"))


def nearest_known(candidates: DataFrame, known: DataFrame, name: str, vector: str, bound: int = 20_000) -> DataFrame:
    """(candidate, nearest, nearest_class, distance): exact nearest known vector, ties by its name.

    Known vectors are annotated structures; they are held by tasks in blocks of `bound` at most. A batch of candidates meets a block in one
    matrix product, and only those within its rounding of the least are measured anew, so no pairs are made.
    """
    spark, rows = known.sparkSession, known.select(name, "class", vector)
    blocks, parts = max(1, -(-known.count() // bound)), []
    types = dict(rows.dtypes)
    schema = f"candidate {dict(candidates.dtypes)[name]}, nearest {types[name]}, nearest_class {types['class']}, distance double"
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64(name), F.lit(blocks)) == b).toPandas().sort_values(name)
        shared = spark.sparkContext.broadcast((own[name].tolist(), own["class"].tolist(), np.stack(own[vector].to_numpy()).astype(float) if len(own) else None))

        def run(batches, shared=shared):
            names, classes, k = shared.value
            for pdf in batches:
                if k is None or not len(pdf):
                    continue
                out = []
                for i in range(0, len(pdf), max(1, (1 << 22) // len(k))):
                    part = pdf.iloc[i : i + max(1, (1 << 22) // len(k))]
                    x = np.stack(part[vector].to_numpy()).astype(float)
                    size = (x * x).sum(1)[:, None] + (k * k).sum(1)
                    apart = size - 2 * x @ k.T
                    near = apart <= apart.min(1, keepdims=True) + 1e-9 * (1 + size)
                    for r, c in enumerate(part[name].tolist()):
                        at = np.flatnonzero(near[r])
                        d = np.round(np.sqrt(((k[at] - x[r]) ** 2).sum(1)), 9)
                        best = int(at[np.argmin(d)])  # names ascend
                        out.append((c, names[best], classes[best], float(d.min())))
                yield pd.DataFrame(out, columns=["candidate", "nearest", "nearest_class", "distance"])

        parts.append(candidates.select(name, vector).mapInPandas(run, schema))
    if len(parts) == 1:
        return parts[0]
    best = reduce(DataFrame.unionByName, parts).groupBy("candidate").agg(F.min(F.struct("distance", "nearest", "nearest_class")).alias("b"))
    return best.select("candidate", "b.nearest", "b.nearest_class", "b.distance")


def pca95(df: DataFrame, vector: str, share: float = 0.95) -> tuple[DataFrame, list[float]]:
    """df with pca, centred coordinates on the fewest components that explain the share; and the explained shares."""
    v = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    n = len(df.select(vector).first()[0])
    model = PCA(k=n, inputCol="_v", outputCol="_p").fit(v)
    explained = model.explainedVariance.toArray()
    k = int(np.searchsorted(np.cumsum(explained), share - 1e-12) + 1)
    mean = [r["mean"] for r in scaler(df, vector).orderBy("k").collect()]
    shift = np.array(mean) @ model.pc.toArray()
    out = model.transform(v).withColumn("pca", F.zip_with(F.slice(vector_to_array("_p"), 1, k), F.array(*[F.lit(float(x)) for x in shift[:k]]), lambda x, m: x - m))
    return out.drop("_v", "_p"), explained[:k].tolist()


def linear_reconstruction_error(train: DataFrame, df: DataFrame, vector: str, share: float = 0.95) -> DataFrame:
    """df with error: mean squared residual of the vector off the principal components of the training rows. A linear autoencoder."""
    _, explained = pca95(train, vector, share)
    v = train.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=len(explained), inputCol="_v", outputCol="_p").fit(v)
    mean = np.array([r["mean"] for r in scaler(train, vector).orderBy("k").collect()])
    pc = model.pc.toArray()

    @F.pandas_udf("double")
    def error(x: pd.Series) -> pd.Series:
        c = np.stack(x.to_numpy()).astype(float) - mean
        return pd.Series(((c - c @ pc @ pc.T) ** 2).mean(1))

    return df.withColumn("error", error(F.col(vector)))


def probe(train: DataFrame, test: DataFrame, vector: str, label: str, c: float = 1.0) -> DataFrame:
    """test with probability: balanced L2 logistic regression."""
    n = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    total, k = sum(n.values()), len(n)
    weight = F.coalesce(*[F.when(F.col(label) == key, F.lit(total / (k * count))) for key, count in n.items()])
    to = lambda d: d.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = LogisticRegression(featuresCol="features", labelCol=label, weightCol="_w", standardization=False, regParam=1 / (c * total), maxIter=200).fit(to(train).withColumn("_w", weight))
    return model.transform(to(test)).withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


def distances(x: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows, by blocks of rows."""
    return np.concatenate([np.sqrt(((x[i : i + 256, None] - x[None]) ** 2).sum(2)) if x.shape[1] <= 8 else np.sqrt(np.maximum(0, (x[i : i + 256] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[i : i + 256] @ x.T)) for i in range(0, len(x), 256)] or [np.zeros((0, 0))])


#: Least cluster size and samples of the primary run and of both sensitivity runs.
SETTINGS = ((5, 5), (8, 5), (5, 8))


def density_runs(df: DataFrame, name: str, vector: str) -> DataFrame:
    """(least_size, least_samples, points, clusters, noise, silhouette, ari, mean_membership) of each setting; ari against the first one, on all points.

    Vectors are centred and taken to the fewest principal components with 95 % of the variance. Any number of candidates.
    """
    return density.density_runs(df, name, vector, SETTINGS)


def rand_index(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted Rand index of two labelings."""
    table = np.zeros((len(np.unique(a)), len(np.unique(b))))
    np.add.at(table, (np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]), 1)
    pairs = lambda n: float((n * (n - 1) / 2).sum())
    left, right, both, every = pairs(table.sum(1)), pairs(table.sum(0)), pairs(table), len(a) * (len(a) - 1) / 2
    chance = left * right / every if every else 0.0
    return 1.0 if (left + right) / 2 == chance else (both - chance) / ((left + right) / 2 - chance)


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean Euclidean silhouette of clustered points."""
    d = distances(x)
    out = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() < 2:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][labels == o].mean() for o in np.unique(labels) if o != c) if len(np.unique(labels)) > 1 else 0.0
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out)) if out else 0.0


def hdbscan(x: np.ndarray, least_size: int = 5, least_samples: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1 is noise) and membership: mutual reachability, minimum spanning tree, condensed tree, excess of mass
    (Campello, Moulavi and Sander 2013). The plain form for few points in memory, over MOST_POINTS is an error; `density` does any number on Spark."""
    n = len(x)
    if n > MOST_POINTS:
        raise ValueError(f"{n} points; distances of at most {MOST_POINTS} fit on the driver")
    if n < max(2, least_size):
        return np.full(n, -1), np.zeros(n)
    d = distances(x)
    core = np.sort(d, axis=1)[:, min(n - 1, least_samples - 1)]
    edges = density.spanning_tree(d, core)
    # single linkage: node n + k joins two nodes at a height
    root, kids, height, size = list(range(n)), {}, {}, {i: 1 for i in range(n)}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for h, a, b in sorted(edges):
        a, b, new = find(a), find(b), len(root)
        root.append(new)
        root[a] = root[b] = new
        kids[new], height[new], size[new] = (a, b), h, size[a] + size[b]

    def leaves(k: int) -> list[int]:
        out, todo = [], [k]
        while todo:
            k = todo.pop()
            if k < n:
                out.append(k)
            else:
                todo += kids[k]
        return out

    clusters = [{"birth": 0.0, "points": [], "kids": [], "stability": 0.0}]
    todo = [(len(root) - 1, 0)]
    while todo:
        node, c = todo.pop()
        while node >= n:
            lam = 1 / max(height[node], 1e-12)
            big = [k for k in kids[node] if size[k] >= least_size]
            for k in kids[node]:
                if size[k] < least_size:
                    clusters[c]["points"] += [(p, lam) for p in leaves(k)]
            if len(big) == 2:
                for k in big:
                    clusters[c]["stability"] += (lam - clusters[c]["birth"]) * size[k]
                    clusters.append({"birth": lam, "points": [], "kids": [], "stability": 0.0})
                    clusters[c]["kids"].append(len(clusters) - 1)
                    todo.append((k, len(clusters) - 1))
                break
            if not big:
                break
            node = big[0]
    chosen, mass = {}, {}
    for c in range(len(clusters) - 1, -1, -1):
        own = clusters[c]["stability"] + sum(lam - clusters[c]["birth"] for _, lam in clusters[c]["points"])
        below = sum(mass[k] for k in clusters[c]["kids"])
        chosen[c], mass[c] = c > 0 and own >= below, max(own, below) if c > 0 else below
    labels, member, todo, k = np.full(n, -1), np.zeros(n), [0], 0
    while todo:
        c = todo.pop(0)
        if not chosen[c]:
            todo += clusters[c]["kids"]
            continue
        points, under = [], [c]
        while under:
            u = under.pop()
            points += clusters[u]["points"]
            under += clusters[u]["kids"]
        top = max(lam for _, lam in points)
        for p, lam in points:
            labels[p], member[p] = k, lam / top
        k += 1
    return labels, member


def encode(df: DataFrame, vector: str, width: int, encoder=None) -> DataFrame:
    """df with encoded: what an encoder makes of batches of vectors (rows of a matrix). The default pools neighbouring values by mean to
    len / width numbers; a trained network fits in its place."""
    pool = encoder or (lambda x: x.reshape(len(x), -1, width).mean(2))

    def run(batches):
        for pdf in batches:
            x = np.stack(pdf[vector].to_numpy()).astype(float) if len(pdf) else np.zeros((0, width))
            yield pdf.assign(encoded=list(pool(x)))

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", encoded array<double>")
