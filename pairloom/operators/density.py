"""Density clusters of any number of points (HDBSCAN; Campello, Moulavi and Sander 2013), exact, as Spark jobs.

Points are numbered and cut into blocks of BLOCK; every two blocks meet in a cell, one task's matrix product. Cells give the nearest
distances of each point (with that core distances), then the minimum spanning tree of their own points: an edge that is in no cell's
tree is in no tree of all points, so what is left is a sparse graph. On it, components of fewer than least_size points merge by rounds of
lightest edges, as in the sequential tree, at most least_size rounds; what hangs on a larger component falls to it by pointer doubling.
Left are the edges between the components that reached least_size by themselves: the condensed tree, one row a candidate cluster. Only
that is on the driver. Edges are ordered by (weight, points), so that ties give one result whatever the blocks are.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranges import Rounds, numbered

BLOCK = 2048
EDGE = "w double, u long, v long"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances; those that are small against the vectors are taken from the differences, so that equal rows have 0."""
    a, b = (x * x).sum(1), (y * y).sum(1)
    out = x @ y.T
    out *= -2
    out += a[:, None]
    out += b
    for r in range(0, len(x), 256):
        i, j = np.nonzero(out[r : r + 256] <= 1e-9 * (a[r : r + 256, None] + b))
        for k in range(0, len(i), 1 << 15):
            p, q = i[k : k + (1 << 15)] + r, j[k : k + (1 << 15)]
            out[p, q] = ((x[p] - y[q]) ** 2).sum(1)
    return out


def spanning_tree(d: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """(weight, a, b), a < b, of the minimum spanning tree of mutual reachability in the order of (weight, a, b), by Prim's algorithm."""
    n, place = len(d), np.arange(len(d))
    near, parent, left = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    left[0], out, j = False, [], 0
    for _ in range(n - 1):
        reach = np.maximum(d[j], np.maximum(core, core[j]))
        closer = left & (reach < near)
        same = np.flatnonzero(left & (reach == near))
        if len(same):
            old, new = (np.minimum(p, same) * n + np.maximum(p, same) for p in (parent[same], j))
            closer[same[new < old]] = True
        near[closer], parent[closer] = reach[closer], j
        least = np.flatnonzero(near == near.min())
        if len(least) > 1:
            p = parent[least]
            least = least[[np.argmin(np.minimum(p, least) * n + np.maximum(p, least))]]
        j = int(least[0])
        a, b = sorted((j, int(parent[j])))
        out.append((float(near[j]), a, b))
        left[j], near[j] = False, np.inf
    return out


def centred(df: DataFrame, name: str, vector: str, share: float) -> DataFrame:
    """(id, x): rows numbered from 0 by name, vectors centred and taken to the fewest principal components with the share of the variance."""
    rows = numbered(df.select(name, F.col(vector).cast("array<double>").alias("x")), [F.col(name), F.col("x")], F.col(name)).select((F.col("rank") - 1).alias("id"), "x")
    mean = np.array([r["m"] for r in rows.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m")).orderBy("k").collect()])

    def scatter(batches):
        total = np.zeros((len(mean), len(mean)))
        for pdf in batches:
            if len(pdf):
                c = np.stack(pdf["x"].to_numpy()) - mean
                total += c.T @ c
        yield pd.DataFrame({"k": np.arange(len(mean)), "row": list(total)})

    parts = rows.select("x").mapInPandas(scatter, "k int, row array<double>").select("k", F.posexplode("row").alias("c", "v")).groupBy("k", "c").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((len(mean), len(mean)))
    for k, c, v in parts:  # one row for each two coordinates
        total[k, c] = v
    size, axes = np.linalg.eigh(total)
    size, axes = np.maximum(size[::-1], 0), axes[:, ::-1]
    axes = axes[:, : int(np.searchsorted(np.cumsum(size) / max(1e-300, size.sum()), share - 1e-12)) + 1]

    def project(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "x": list((np.stack(pdf["x"].to_numpy()) - mean) @ axes)})

    return rows.mapInPandas(project, "id long, x array<double>")


def in_blocks(rows: DataFrame, place: str, block: int, more: list[str] = ()) -> DataFrame:
    """(block, x, ids and each of more): one row a block, in the order of the place (0, 1, ...), vectors as bytes and the rest as arrays."""
    kinds = dict(rows.dtypes)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        return pd.DataFrame({"block": pdf["block"][:1].to_list(), "x": [np.stack(pdf["x"].to_numpy()).tobytes()], "ids": [pdf["id"].to_list()], **{c: [pdf[c].to_list()] for c in more}})

    own = rows.select((F.col(place) / block).cast("long").alias("block"), F.col(place).alias("_place"), "id", "x", *more)
    return own.groupBy("block").applyInPandas(pack, ", ".join(["block long, x binary, ids array<long>", *[f"{c} array<{kinds[c]}>" for c in more]]))


def met(blocks: DataFrame, many: int, own: bool) -> DataFrame:
    """A row for every two of the blocks, and for each one with itself if own says so, spread over tasks; columns end in 1 and 2."""
    pairs = blocks.sparkSession.range(many * many).select(F.expr(f"id div {many}").alias("block1"), (F.col("id") % many).alias("block2"))
    pairs = pairs.where("block1 <= block2" if own else "block1 < block2")
    side = lambda k: blocks.withColumnsRenamed({c: f"{c}{k}" for c in blocks.columns})
    count = many * (many + 1) // 2
    return pairs.join(side(1), "block1").join(side(2), "block2").repartition(max(1, min(count, 2000)), "block1", "block2")


def matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(n, -1)


def cores(blocks: DataFrame, many: int, samples: list[int], n: int) -> DataFrame:
    """(id, core_<samples>): the distance to the samples-th nearest point, the point itself the first."""
    most = min(n, max(samples))

    def nearest(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                d = squared(matrix(r.x1, len(r.ids1)), matrix(r.x2, len(r.ids2)))
                for ids, m in ((r.ids1, d),) if r.block1 == r.block2 else ((r.ids1, d), (r.ids2, d.T)):
                    k = min(most, m.shape[1])
                    got = np.concatenate([np.partition(m[i : i + 256], k - 1, axis=1)[:, :k] for i in range(0, len(m), 256)])
                    yield pd.DataFrame({"id": ids, "d": list(np.sqrt(got))})

    every = met(blocks, many, True).mapInPandas(nearest, "id long, d array<double>")
    sorted_ = every.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("d"))).alias("d"))
    return sorted_.select("id", *[F.get("d", F.lit(min(n, k) - 1)).alias(f"core_{k}") for k in samples])


def sparse_edges(blocks: DataFrame, many: int, core: str) -> DataFrame:
    """(w, u, v), u < v: the edges of the spanning trees of all cells, which hold that of all points."""

    def trees(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                two = r.block1 != r.block2
                x, ids, c = matrix(r.x1, len(r.ids1)), np.asarray(r.ids1), np.asarray(getattr(r, f"{core}1"))
                if two:
                    x, ids, c = np.concatenate((x, matrix(r.x2, len(r.ids2)))), np.concatenate((ids, r.ids2)), np.concatenate((c, getattr(r, f"{core}2")))
                d = squared(x, x)
                np.sqrt(d, out=d)
                t = spanning_tree(d, c)
                if t:
                    a, b = (np.array([e[k] for e in t]) for k in (1, 2))
                    w = np.maximum(np.sqrt(((x[a] - x[b]) ** 2).sum(1)), np.maximum(c[a], c[b]))
                    yield pd.DataFrame({"w": w, "u": ids[a], "v": ids[b]})

    return met(blocks, many, many == 1).mapInPandas(trees, EDGE).distinct()


def lightest(edges: DataFrame, small: DataFrame) -> DataFrame:
    """(c, n, w, u, v, to) of each small component (c, n): its lightest edge and where that leads."""
    ends = edges.select(F.col("cu").alias("c"), F.col("cv").alias("to"), "w", "u", "v").unionByName(edges.select(F.col("cv").alias("c"), F.col("cu").alias("to"), "w", "u", "v"))
    return ends.join(small, "c").groupBy("c").agg(F.first("n").alias("n"), F.min(F.struct("w", "u", "v", "to")).alias("e")).select("c", "n", "e.*")


def relabelled(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges between components after moves (c, new); inner ones go."""
    for k in ("cu", "cv"):
        edges = edges.join(moves.select(F.col("c").alias(k), F.col("new").alias("_new")), k, "left").withColumn(k, F.coalesce("_new", k)).drop("_new")
    return edges.where("cu <> cv")


def grown(points: DataFrame, edges: DataFrame, least: int, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """Points (id, c, w, u, v) with the component of at least `least` points that they come to and the edge by which they do, and the edges
    (cu, cv, w, u, v) left between those components. There are at least `least` points, and edges join them all."""
    nodes = points.select("id", F.col("id").alias("c"), F.lit(None).cast("struct<w:double,u:long,v:long>").alias("e"))
    edges = edges.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "w", "u", "v")
    while True:
        small = nodes.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") < least)
        light = rounds.hand_on(lightest(edges, small))
        other = light.select(F.col("c").alias("to"), F.col("n").alias("n2"), "u", "v")
        pairs = light.join(other, ["to", "u", "v"]).where("c < to").select(F.array("c", "to").alias("both"), F.col("c").alias("new"), (F.col("n") + F.col("n2") >= least).alias("born"), F.struct("w", "u", "v").alias("at"))
        moves = rounds.hand_on(pairs.select(F.explode("both").alias("c"), "new", "born", "at"))
        if moves.isEmpty():
            break
        nodes = nodes.join(moves, "c", "left").select("id", F.coalesce("new", "c").alias("c"), F.when(F.col("born"), F.col("at")).otherwise(F.col("e")).alias("e"))
        nodes, edges = rounds.hand_on(nodes), rounds.hand_on(relabelled(edges, moves))
    # every small component leads, over ever lighter edges, to a large one
    way = light.select("c", F.col("to").alias("new"))
    while not (open_ := way.select(F.col("new").alias("c")).join(way, "c", "left_semi")).isEmpty():
        way = rounds.hand_on(way.join(way.select(F.col("c").alias("new"), F.col("new").alias("next")), "new", "left").select("c", F.coalesce("next", "new").alias("new")))
    moves = light.select("c", F.struct("w", "u", "v").alias("at")).join(way, "c")
    nodes = nodes.join(moves, "c", "left").select("id", F.coalesce("new", "c").alias("c"), F.coalesce("e", "at").alias("e")).select("id", "c", "e.*")
    return rounds.hand_on(nodes), relabelled(edges, moves)


def forest(edges: list[tuple]) -> list[tuple]:
    """Of (w, u, v, a, b) those that join two components of the a and b, in their order."""
    root: dict = {}

    def find(i):
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for e in sorted(edges):
        a, b = find(e[3]), find(e[4])
        if a != b:
            root[a] = b
            out.append(e)
    return out


def between(edges: DataFrame) -> list[tuple]:
    """(w, u, v, a, b) of the spanning tree of the large components, one row less than they are; tasks leave out what their own rows join before."""

    def run(batches):
        kept: list = []
        for pdf in batches:
            kept = forest(kept + list(pdf.itertuples(index=False, name=None)))
        yield pd.DataFrame(kept, columns=["w", "u", "v", "a", "b"])

    e = edges.groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.min(F.struct("w", "u", "v")).alias("e")).select("e.*", "a", "b")
    for parts in (64, 8, 1):
        e = e.repartition(parts).mapInPandas(run, EDGE + ", a long, b long")
    return forest([tuple(r) for r in e.collect()])


class Condensed:
    """The condensed tree of large components (leaves 0 .. k - 1, in the order of their names) and the edges between them: node k + i is the i-th merge."""

    def __init__(self, names: list[int], edges: list[tuple]):
        self.k, self.keys = len(names), [e[:3] for e in edges]
        total = self.k + len(edges)
        at = {c: i for i, c in enumerate(names)}
        root, self.up, self.kids = list(range(total)), np.arange(total), {}

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, e in enumerate(edges):
            two = find(at[e[3]]), find(at[e[4]])
            self.kids[self.k + i] = two
            for c in two:
                root[c] = self.up[c] = self.k + i
        self.split = {self.k + i: 1 / max(e[0], 1e-12) for i, e in enumerate(edges)}
        self.birth = np.array([self.split[int(self.up[i])] if self.up[i] != i else 0.0 for i in range(total)])
        self.names = names
        self.jumps = [self.up]
        while (self.jumps[-1] != total - 1).any():
            self.jumps.append(self.jumps[-1][self.jumps[-1]])

    def nodes_at(self, c: np.ndarray, keys: list[tuple]) -> np.ndarray:
        """The node in which a point that comes to component c by an edge is: the last above it whose merge is before the edge."""
        node = np.searchsorted(np.asarray(self.names), c)
        rank = np.array([bisect_left(self.keys, e) for e in keys], dtype=np.int64) + self.k
        for jump in reversed(self.jumps):
            to = jump[node]
            node = np.where(to < rank, to, node)
        return node

    def chosen(self, falls: dict[int, tuple[int, float, float]]) -> dict[int, tuple[int, float]]:
        """(label, its largest lambda) of every node at or below a cluster of most excess of mass; falls: points, excess and largest lambda by node."""
        total = len(self.up)
        size, mass, top, pick = np.zeros(total), np.zeros(total), np.zeros(total), np.zeros(total, dtype=bool)
        for c in range(total):  # kids come first
            n, own, most = falls.get(c, (0, 0.0, 0.0))
            kids = list(self.kids.get(c, ()))
            inner = sum(size[k] for k in kids)
            size[c], top[c] = n + inner, max([most, *top[kids]])
            own, below = own + (self.split[c] - self.birth[c]) * inner if kids else own, sum(mass[k] for k in kids)
            pick[c] = c < total - 1 and own >= below
            mass[c] = max(own, below)
        label = {}
        for c in range(total - 1, -1, -1):
            above = label.get(int(self.up[c])) if c < total - 1 else None
            if above or pick[c]:
                label[c] = above or (c, float(top[c]))
        return label


def clusters(points: DataFrame, edges: DataFrame, n: int, least: int, rounds: Rounds) -> DataFrame:
    """(id, label, member); label -1 and member 0 are noise."""
    if n < max(2, least):
        return points.select("id", F.lit(-1).cast("long").alias("label"), F.lit(0.0).alias("member"))
    nodes, left = grown(points, edges, least, rounds)
    tree = Condensed(sorted(r["c"] for r in nodes.select("c").distinct().collect()), between(left))
    shared = nodes.sparkSession.sparkContext.broadcast(tree)

    def place(batches):
        t = shared.value
        for pdf in batches:
            node = t.nodes_at(pdf["c"].to_numpy(), list(zip(pdf["w"], pdf["u"], pdf["v"])))
            lam = 1 / np.maximum(pdf["w"].to_numpy(), 1e-12)
            yield pd.DataFrame({"id": pdf["id"], "node": node, "lam": lam, "excess": lam - t.birth[node]})

    placed = rounds.hand_on(nodes.mapInPandas(place, "id long, node long, lam double, excess double"))
    falls = {r["node"]: (r["n"], r["x"], r["m"]) for r in placed.groupBy("node").agg(F.count("*").alias("n"), F.sum("excess").alias("x"), F.max("lam").alias("m")).collect()}
    label = [(c, k, m) for c, (k, m) in tree.chosen(falls).items()]
    table = nodes.sparkSession.createDataFrame(label, "node long, label long, top double")
    return placed.join(F.broadcast(table), "node", "left").select("id", F.coalesce("label", F.lit(-1)).cast("long").alias("label"), F.coalesce(F.col("lam") / F.col("top"), F.lit(0.0)).alias("member"))


def rand_index(labels: DataFrame, a: str, b: str) -> float:
    """Adjusted Rand index of two labelings of all rows."""
    pairs = lambda *by: float(labels.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2.0)).first()[0] or 0.0)
    left, right, both, n = pairs(a), pairs(b), pairs(a, b), labels.count()
    every = n * (n - 1) / 2
    chance = left * right / every if every else 0.0
    return 1.0 if (left + right) / 2 == chance else (both - chance) / ((left + right) / 2 - chance)


def silhouette(points: DataFrame, labels: DataFrame, block: int, rounds: Rounds) -> float:
    """Mean Euclidean silhouette of the clustered points (label >= 0) of at least two clusters.

    Blocks follow the labels, so that most clusters are whole in one: of these a cell gives each point's least mean distance only, of the
    others, two a block at most, and of its own cluster the sums.
    """
    kept = labels.where("label >= 0")
    kept = kept.join(F.broadcast(kept.groupBy("label").agg(F.count("*").alias("size"))), "label")
    placed = numbered(kept.select("id", "label", "size"), [F.col("label"), F.col("id")], F.col("label"))
    rows = rounds.hand_on(placed.select("id", "label", "size", (F.col("rank") - 1).alias("place")).join(points, "id"))
    blocks = rounds.hand_on(in_blocks(rows, "place", block, ["label", "size"]))

    def side(d, ids, own, own_size, labels, sizes):
        at = np.flatnonzero(np.concatenate(([True], labels[1:] != labels[:-1])))
        names, sizes, inside = labels[at], sizes[at], np.diff(np.concatenate((at, [len(labels)])))
        sums = np.add.reduceat(d, at, axis=1)
        whole = inside == sizes
        mine = own[:, None] == names
        means = np.where(mine | ~whole, np.inf, sums / sizes)
        best = means.min(1)
        yield pd.DataFrame({"id": ids, "label": -1, "own": False, "size": 1, "value": best})[np.isfinite(best)]
        i, j = np.nonzero(mine | ~whole)
        yield pd.DataFrame({"id": ids[i], "label": names[j], "own": mine[i, j], "size": sizes[j], "value": sums[i, j]})

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                one, two = ([np.asarray(getattr(r, f"{c}{k}")) for c in ("ids", "label", "size")] for k in (1, 2))
                d = np.sqrt(squared(matrix(r.x1, len(one[0])), matrix(r.x2, len(two[0]))))
                yield from side(d, *one, *two[1:])
                if r.block1 != r.block2:
                    yield from side(np.ascontiguousarray(d.T), *two, *one[1:])

    many = blocks.count()
    parts = met(blocks, many, True).mapInPandas(run, "id long, label long, own boolean, size long, value double")
    each = parts.groupBy("id", "label", "own", "size").agg(F.sum("value").alias("s"), F.min("value").alias("m"))
    mean = F.when(F.col("label") < 0, F.col("m")).otherwise(F.col("s") / F.col("size"))
    ab = each.groupBy("id").agg(F.max(F.when(F.col("own"), F.col("s") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("a"), F.min(F.when(~F.col("own"), mean)).alias("b"), F.max(F.when(F.col("own"), F.col("size"))).alias("n"))
    value = F.when((F.col("n") > 1) & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return ab.agg(F.avg(value)).first()[0]


def density_runs(df: DataFrame, name: str, vector: str, settings, share: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(least_size, least_samples, points, clusters, noise, silhouette, ari, mean_membership) of each setting; ari against the first one, on all points.

    Vectors are centred and taken to the fewest principal components with the share of the variance.
    """
    spark, out, first = df.sparkSession, [], None
    schema = "least_size int, least_samples int, points long, clusters int, noise long, silhouette double, ari double, mean_membership double"
    if df.isEmpty():
        return spark.createDataFrame([(*s, 0, 0, 0, None, 1.0, None) for s in settings], schema)
    with Rounds(spark) as rounds:
        points = rounds.hand_on(centred(df, name, vector, share))
        n = points.count()
        many = -(-n // block)
        samples = sorted({s for _, s in settings})
        core = rounds.hand_on(cores(rounds.hand_on(in_blocks(points, "id", block)), many, samples, n))
        blocks = rounds.hand_on(in_blocks(points.join(core, "id"), "id", block, [f"core_{s}" for s in samples]))
        edges = {s: rounds.hand_on(sparse_edges(blocks, many, f"core_{s}")) for s in samples}
        for least, own in settings:
            labels = rounds.hand_on(clusters(points, edges[own], n, least, rounds))
            first = labels.select("id", F.col("label").alias("first")) if first is None else first
            r = labels.agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("many"), F.count_if(F.col("label") < 0).alias("noise"), F.avg("member").alias("mean")).first()
            score = silhouette(points, labels, block, rounds) if r["many"] > 1 else None
            out.append((least, own, n, r["many"], r["noise"], score, rand_index(labels.join(first, "id"), "first", "label"), r["mean"]))
    return spark.createDataFrame(out, schema)
