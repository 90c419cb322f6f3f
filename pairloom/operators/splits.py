"""Group-aware splits, blocked background splits, folds and leakage audits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.operators.intervals import range_join

#: Shares of train, validation and test; weight of the rare class in the smaller splits.
SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}
RARE, RARE_WEIGHT = "CHID", 2.0
MASTER = ("train", "validation", "calibration")


def in_block(df: DataFrame, block: int, start: str = "w_start", end: str = "w_end") -> DataFrame:
    """Rows that lie whole in one block, with its block number."""
    b = F.expr(f"{start} div {block}")
    return df.withColumn("block", b).where(F.col(end) <= (F.col("block") + 1) * block)


def block_name(chrom: Column, center: Column, block: int = 128000) -> Column:
    return F.concat(chrom, F.lit(":"), F.floor(center / block).cast("string"))


def hash_block_split(blocks: DataFrame, block_id: str, seed: int, shares=(0.70, 0.15)) -> DataFrame:
    """blocks (one row each) with split: in hash order the first round(0.70 n) are train, the next round(0.15 n) val, the rest test.

    round is to the even neighbour. Whole blocks only, so no window is in two splits.
    """
    order = W.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), block_id), 256), block_id)  # one row a block
    placed = blocks.withColumns({"_n": F.count("*").over(W.partitionBy()), "_r": F.row_number().over(order)})
    train, val = F.bround(F.col("_n") * shares[0]), F.bround(F.col("_n") * shares[1])
    return placed.withColumn("split", F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + val, "val").otherwise("test")).drop("_n", "_r")


def master_blocks(chrom: str, size: int, block: int, seed: int, eligible: dict[str, set[int]] | None = None, attempts: int = 10_000) -> list[tuple]:
    """(chrom, block_index, block_id, block_start, block_end, split, attempt) of every block of a chromosome.

    A seeded permutation of the blocks: the first round(70 %) are train, round(15 %) validation, the rest calibration, one of each at least.
    eligible: blocks by scale; then the first permutation that gives each scale blocks of all three splits. A table of blocks, for the driver.
    """
    n = -(-size // block)
    if n < 3 or any(len(b) < 3 for b in (eligible or {}).values()):
        raise ValueError("three blocks at least, of each scale too, are needed")
    train = min(max(1, round(SHARES["train"] * n)), n - 2)
    validation = min(max(1, round(SHARES["val"] * n)), n - train - 1)
    name = np.repeat(MASTER, (train, validation, n - train - validation))
    draw = np.random.default_rng(seed)
    for attempt in range(1, attempts + 1 if eligible else 2):
        split = np.empty(n, dtype=object)
        split[draw.permutation(n)] = name
        if all(set(split[[b for b in blocks if b < n]]) == set(MASTER) for blocks in (eligible or {}).values()):
            return [(chrom, k, f"{chrom}:{k}", k * block, min((k + 1) * block, size), str(split[k]), attempt) for k in range(n)]
    raise ValueError(f"no permutation of {attempts} gives every scale all splits")


def master_split(sizes: DataFrame, block: int, seed: int, eligible: DataFrame | None = None) -> DataFrame:
    """master_blocks of every chromosome of sizes(chrom, size_bp); eligible: (chrom, scale, block) of background windows."""
    own: dict[str, dict[str, set[int]]] = {}
    for r in eligible.distinct().collect() if eligible is not None else ():  # at most blocks by scales
        own.setdefault(r["chrom"], {}).setdefault(r["scale"], set()).add(int(r["block"]))
    rows = [x for r in sizes.orderBy("chrom").collect() for x in master_blocks(r["chrom"], r["size_bp"], block, seed, own.get(r["chrom"]))]
    return sizes.sparkSession.createDataFrame(rows, "chrom string, block_index long, block_id string, block_start long, block_end long, split string, attempt int")


def diagnostics(df: DataFrame, group: str, kind: str, split: str) -> DataFrame:
    """(split, class, groups, n, share): rows and groups of each split by class and over all, and the split's share of the class."""
    g = df.groupingSets([[split, kind], [split]], split, kind).agg(F.grouping(kind).alias("_all"), F.count_distinct(group).alias("groups"), F.count("*").alias("n"))
    g = g.select(F.col(split).alias("split"), F.when(F.col("_all") == 1, "ALL").otherwise(F.col(kind)).alias("class"), "groups", "n")
    return g.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("class")))  # a few rows a class


def solve_groups(groups: list[dict], classes: list[str], seed: int = 20260920) -> tuple[dict[str, str], float]:
    """A split for each group (counts by class) with little weighted deviation from the shares, every class in every split if it can be.

    Largest groups first to where they cost least, then moves and swaps while they help. groups is one row a group of annotated
    structures, a few hundred; the optimum is not guaranteed, the value is returned.
    """
    names = list(SHARES)
    total = {c: sum(g[c] for g in groups) for c in classes}
    want = np.array([[total[c] * SHARES[s] for c in classes] for s in names])
    weight = np.array([[(RARE_WEIGHT if c == RARE and s != "train" else 1.0) / max(1.0, total[c] * SHARES[s]) for c in classes] for s in names])
    rng = np.random.default_rng(seed)
    order = sorted(range(len(groups)), key=lambda i: (-sum(groups[i][c] for c in classes), groups[i]["group"]))
    x = np.array([[g[c] for c in classes] for g in groups], dtype=float)
    have, at = np.zeros_like(want), np.full(len(groups), -1)
    cost = lambda h: float((np.abs(h - want) * weight).sum() + 10.0 * ((h == 0) & (np.array([total[c] for c in classes]) >= 3)).sum())
    for i in order:
        options = []
        for s in range(3):
            have[s] += x[i]
            options.append(cost(have))
            have[s] -= x[i]
        at[i] = int(np.argmin(options))
        have[at[i]] += x[i]
    best, better = cost(have), True
    while better:
        better = False
        for i in rng.permutation(len(groups)).tolist():
            for s in range(3):
                if s != at[i]:
                    have[at[i]] -= x[i]
                    have[s] += x[i]
                    if (c := cost(have)) < best - 1e-12:
                        best, at[i], better = c, s, True
                    else:
                        have[s] -= x[i]
                        have[at[i]] += x[i]
    return {groups[i]["group"]: names[at[i]] for i in range(len(groups))}, best


def group_split(structures: DataFrame, group: str, kind: str, classes: list[str]) -> DataFrame:
    """structures with split: one split a group. The table of counts by group is what comes to the driver."""
    counts = structures.groupBy(F.col(group).cast("string").alias("group")).pivot(kind, classes).count().na.fill(0)
    split, _ = solve_groups([r.asDict() for r in counts.orderBy("group").collect()], classes)
    rows = structures.sparkSession.createDataFrame(list(split.items()) or [], "group string, split string")
    return structures.join(rows.withColumnRenamed("group", "_g"), F.col(group).cast("string") == F.col("_g")).drop("_g")


def groups_in_two_splits(df: DataFrame, group: str, split: str) -> DataFrame:
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def leakage(df: DataFrame, bucket: int, keys: list[str] = (), start: str = "w_start", end: str = "w_end") -> DataFrame:
    """(keys, left_split, right_split, pairs) of intervals in different splits that overlap."""
    right = df.select("chrom", F.col(start).alias("_s"), F.col(end).alias("_e"), F.col("split").alias("right_split"), *[F.col(k).alias(f"_{k}") for k in keys])
    pairs = range_join(df.withColumnRenamed("split", "left_split"), right, bucket, (start, end), ("_s", "_e")).where("left_split < right_split")
    for k in keys:
        pairs = pairs.where(F.col(k) == F.col(f"_{k}"))
    return pairs.groupBy(*keys, "left_split", "right_split").agg(F.count("*").alias("pairs"))


def group_folds(groups: DataFrame, name: str, size: str, folds: int) -> DataFrame:
    """groups (one row each) with fold: the largest first, each to the fold with the fewest rows so far; groups are blocks of a genome."""
    load, out = [0] * folds, []
    for r in groups.select(F.col(name).cast("string").alias("g"), F.col(size).alias("n")).orderBy(F.desc("n"), "g").collect():
        k = min(range(folds), key=lambda i: (load[i], i))
        load[k] += r["n"]
        out.append((r["g"], k))
    rows = groups.sparkSession.createDataFrame(out, "_g string, fold int")
    return groups.join(rows, F.col(name).cast("string") == F.col("_g")).drop("_g")


def purge(train: DataFrame, test: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Training rows that overlap no test row."""
    t = test.select("chrom", F.col("w_start").alias("_s"), F.col("w_end").alias("_e"))
    return train.join(range_join(train, t, bucket, ("w_start", "w_end"), ("_s", "_e")).select(*keys).distinct(), keys, "left_anti")


def class_weights(df: DataFrame, unit: str, kind: str) -> DataFrame:
    """(class, n, weight = all / (classes * n)) over distinct units."""
    c = df.select(unit, kind).distinct().groupBy(kind).agg(F.count("*").alias("n"))
    every = W.partitionBy()
    return c.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))
