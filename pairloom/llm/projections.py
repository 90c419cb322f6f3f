"""Near-duplicate vectors: passes that order them by concatenated random hashes, compare neighbours and unite what is verified.

A hash of a vector is the one of DIRECTIONS random directions, with its sign, that the vector points along most; HASHES of them, side by side, are a
pass's sort key. Vectors at a small angle share a prefix of the key with a probability that only the angle decides, so they stand near each other in
some pass. Every vector is compared with the WINDOW that follow it, as matrix products of tiles. The links of all passes are united, and inside
each component, where every link must lie, all pairs are compared once to count them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import common as C
from pairloom.llm.graph import components

#: Least cosine of a link.
SIMILAR = 0.95
#: Random directions of a hash (each with two signs, so 7 bits) and hashes of a key.
DIRECTIONS, HASHES, BITS = 64, 4, 7
#: Neighbours after each vector that it is compared with, and vectors of a block (which also holds the WINDOW after it).
WINDOW, BLOCK = 1024, 4096
#: The share of pairs at the threshold that no pass may bring together, and passes that are sorted in one job.
MISS, TOGETHER = 1e-4, 4


def agreement(cosine: float, seed: int = 5) -> float:
    """The probability that two vectors with this cosine have the same hash, by 20,000 draws (their projections are normal with this correlation)."""
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((2, 20_000, DIRECTIONS))
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b
    i, j = np.abs(a).argmax(1), np.abs(b).argmax(1)
    at = np.arange(len(a))
    return float(((i == j) & (np.sign(a[at, i]) == np.sign(b[at, j]))).mean())


def keys(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    """The sort key of pass `number` for each row of x: HASHES hashes, the first one in the highest bits."""
    out = np.zeros(len(x), dtype=np.int64)
    for k in range(HASHES):
        y = x @ np.random.default_rng([seed, number, k, x.shape[1]]).standard_normal((x.shape[1], DIRECTIONS))
        at = np.abs(y).argmax(1)
        out = out << BITS | (2 * at + (y[np.arange(len(x)), at] > 0))
    return out


def directions(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors in doubles) of the rows of a list column, by length of the list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, end = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(size)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        x = flat[(end[at] - n)[:, None] + np.arange(n)]
        x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
        yield at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lowers the labels (each the least place known of its class) so that a[i] and b[i] share theirs."""
    while len(a):
        p, q = label[a], label[b]
        apart = p != q
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label[:] = label[label]


def runs(batches, by: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal `by` columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        new = np.any([x[1:] != x[:-1] for x in own], axis=0)
        cut = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for i, j in zip(cut, cut[1:]):
            key = tuple(x[i] for x in own)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def vector_classes(rows: DataFrame, vec_col: str) -> DataFrame:
    """(c, v, n, low) of the distinct usable vectors, stored: a number, the components in doubles, the rows that have them and the least identifier."""
    usable = rows.where(usable_vector(F.col(vec_col)))
    distinct = usable.groupBy(F.col(vec_col).alias("v")).agg(F.count("*").alias("n"), F.min("d").alias("low"))
    return C.stored(distinct.withColumn("c", F.monotonically_increasing_id()), "vectors")


def usable_vector(v: Column) -> Column:
    """Whether a vector has components, all of them finite and not all zero."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))


def sorted_passes(vectors: DataFrame, numbers: list[int], seed: int) -> DataFrame:
    """(number, dim, key, c, v, rank) of each vector in each of the passes, stored; ranks go on from pass to pass."""
    spark = vectors.sparkSession

    def run(batches):
        for batch in batches:
            for at, x in directions(batch.column("v")):
                own = batch.take(pa.array(at))
                for number in numbers:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int32)), pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array(keys(x, number, seed)), own.column("c"), own.column("v")], ["number", "dim", "key", "c", "v"])

    kind = dict(vectors.dtypes)["v"]
    keyed = vectors.select("c", "v").mapInArrow(run, f"number int, dim int, key long, c long, v {kind}")
    order = ["number", "dim", "key", "c"]
    placed = keyed.repartitionByRange(C.partitions(spark), *order).sortWithinPartitions(*order)
    placed = C.stored(placed.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "passes")
    before, table = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("part").count().collect())):  # a row a partition
        table.append((part, before))
        before += n
    offsets = spark.createDataFrame(table, "part int, before long")
    return placed.join(F.broadcast(offsets), "part").select(*order, "v", (F.col("before") + F.col("place")).alias("rank"))


def passes_needed(vectors: DataFrame, window: int, similar: float, seed: int) -> int:
    """Passes after which at most MISS of the pairs at the threshold stood within the window in none, as far as prefixes tell.

    Two vectors that agree in the shortest prefix of the key that at most `window` vectors have are compared for certain. How long that
    prefix is, is counted over all vectors with the first pass's keys, so that dense regions count as they are.
    """

    def run(batches):
        for batch in batches:
            for at, x in directions(batch.column("v")):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array(keys(x, 0, seed))], ["dim", "key"])

    full = C.stored(vectors.select("v").mapInArrow(run, "dim int, key long").groupBy("dim", "key").count(), "key-counts")
    total = full.agg(F.sum("count")).first()[0]
    if not total:
        return 1
    p, chance, below = agreement(similar), 0.0, 0
    for m in range(HASHES + 1):
        prefixes = full.groupBy("dim", F.shiftright("key", BITS * (HASHES - m)).alias("key")).agg(F.sum("count").alias("n"))
        found = (prefixes.where(F.col("n") <= window).agg(F.sum("n")).first()[0] or 0) if m < HASHES else total
        chance += p**m * (found - below) / total
        below = found
    return 1 if chance >= 1 - MISS else math.ceil(math.log(MISS) / math.log(1 - chance))


def neighbour_links(ranked: DataFrame, window: int, block: int, similar: float) -> DataFrame:
    """Links (a, b) that join what the verified pairs with ranks at most `window` apart, of one pass and length, join."""
    spark = ranked.sparkSession

    def run(batches):
        for rows in runs(batches, ["block", "number", "dim"]):
            ids = rows.column("c").to_numpy()
            x = next(iter(directions(rows.column("v"))))[1]
            label = np.arange(len(ids))
            for t in range(0, len(ids), window):
                i, j = np.nonzero(x[t : t + window] @ x[t : t + 2 * window].T >= similar)
                united(label, t + i[i < j], t + j[i < j])
            at = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]])], ["a", "b"])

    own = F.floor(F.col("rank") / block).cast("long")
    blocks = ranked.withColumn("block", F.explode(F.when((F.col("rank") % block < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))))
    return blocks.repartition(C.partitions(spark), "block").sortWithinPartitions("block", "rank").mapInArrow(run, "a long, b long")


def link_counts(vectors: DataFrame, roots: DataFrame, similar: float, part: int) -> DataFrame:
    """(c, links): the rows that have another vector which is linked with vector c. All pairs of a component are compared, none is written.

    A component of over `part` vectors is cut into parts, and every two parts meet in a cell, so that no task gets a large component.
    """
    spark = vectors.sparkSession

    def run(batches):
        for rows in runs(batches, ["root", "one", "two"]):
            ids, n, mine = (rows.column(c).to_numpy() for c in ("c", "n", "part"))
            x, one, two = next(iter(directions(rows.column("v"))))[1], rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
            a, b = np.flatnonzero(mine == one), np.flatnonzero(mine == two)
            links = np.zeros(len(ids), dtype=np.int64)
            for t in range(0, len(a), part):
                i = a[t : t + part]
                near = x[i] @ x[b].T >= similar
                near &= i[:, None] != b
                links[i] += near @ n[b]
                if one != two:
                    links[b] += n[i] @ near
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], ["c", "links"])

    sizes = C.stored(roots.groupBy("root").agg(F.ceil(F.count("*") / part).alias("parts")), "component-sizes")
    own = roots.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.select("root", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", F.col("node").alias("c")).join(vectors.select("c", "v", "n"), "c")
    cells = cells.repartition(C.partitions(spark), "root", "one", "two").sortWithinPartitions("root", "one", "two", "c")
    return cells.mapInArrow(run, "c long, links long").groupBy("c").agg(F.sum("links").alias("links"))


def near_vectors(table: DataFrame, similar: float = SIMILAR, window: int = WINDOW, block: int = BLOCK, passes: int | None = None, seed: int = 12, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of the table.

    n_links: other rows with a cosine of at least `similar` to this one; component_id: the least identifier reachable by links, its own included; kept:
    whether that is its own. Every link is verified in doubles; a pair at the threshold that no other vector joins is missed with a probability of
    at most about MISS (`passes_needed`; `passes` sets their number instead). Vectors that are null, empty, zero or hold null, NaN or infinite components
    link with nothing, vectors of different lengths don't link. Rows with equal vectors are one in all passes and linked. A null
    identifier is the largest; a component of such rows only has a null component_id, and they are kept. Repeated rows give repeated rows,
    an empty table gives an empty one, other columns are ignored.
    """
    C.arrow_rows(table.sparkSession)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(C.NO_ID)).alias("d"), F.col(vec_col).alias("v"))
    if "float" not in dict(rows.dtypes)["v"]:
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    vectors = vector_classes(rows, "v")
    count = passes or passes_needed(vectors, window, similar, seed)
    links = None
    for first in range(0, count, TOGETHER):
        ranked = sorted_passes(vectors, list(range(first, min(first + TOGETHER, count))), seed)
        found = C.stored(neighbour_links(ranked, window, block, similar), "neighbours")
        links = found if links is None else links.unionByName(found)
    roots = C.stored(components(links), "components")
    counts = link_counts(vectors, roots, similar, window)
    low = roots.join(vectors.select(F.col("c").alias("node"), "low"), "node").groupBy("root").agg(F.min("low").alias("all_low"))
    of = roots.join(low, "root").select(F.col("node").alias("c"), "all_low").join(counts, "c")
    known = vectors.join(of, "c", "left").select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("all_low", "low").alias("low"))
    out = rows.withColumn("v", F.when(usable_vector(F.col("v")), F.col("v"))).join(known, "v", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.nullif(F.coalesce("low", "d"), F.lit(C.NO_ID)).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""
