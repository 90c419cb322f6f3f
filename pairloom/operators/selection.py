"""Ranks, top fractions, greedy selection and coverage budgets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions import ids
from pairloom.operators.intervals import gap_islands, islands
from pairloom.operators.ranges import Rounds, attach, numbered, settled


def ranked(df: DataFrame, order: list[Column], keys: list[str] = (), rank: str = "rank", by: Column | None = None) -> DataFrame:
    """df with rank 1.. and percentile 1 - (rank - 1) / n; the order must be total.

    by: a number that never falls along the order; with it the rows are ranked in ranges of it. Without it the rows of equal keys are one
    task, which is for tables with few rows a key.
    """
    if by is not None:
        return numbered(df, order, by, keys, rank, "_total").withColumn("percentile", 1 - (F.col(rank) - 1) / F.col("_total")).drop("_total")
    w = W.partitionBy(*keys)
    return df.withColumn(rank, F.row_number().over(w.orderBy(*order))).withColumn("percentile", 1 - (F.col(rank) - 1) / F.count("*").over(w))


def fraction_count(n: Column, fraction: Column | float) -> Column:
    """min(n, max(1, ceil(n * fraction)))."""
    return F.least(n, F.greatest(F.lit(1), F.ceil(F.round(n * fraction, 9))))


def top_fraction(df: DataFrame, order: list[Column], fraction: float, keys: list[str] = (), by: Column | None = None, rank: str | None = None) -> DataFrame:
    """The first min(n, max(1, ceil(n * fraction))) rows; with their rank, if it has a name. by is that of `ranked`."""
    r = rank or "_rank"
    if by is not None:
        out = numbered(df, order, by, keys, r, "_n")
    else:
        out = ranked(df, order, keys, r).withColumn("_n", F.count("*").over(W.partitionBy(*keys))).drop("percentile")
    out = out.where(F.col(r) <= fraction_count(F.col("_n"), fraction)).drop("_n")
    return out if rank else out.drop("_rank")


#: Rows of a chain that are selected in one pass over it; longer chains are cut by rounds first (the result is the same at any value).
CHAIN_MOST = 20_000


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], rank: str, center: str, radius: str, wide: float) -> DataFrame:
    """(keys, rank, least): the best rank in right that is less than a radius from each row of left, which meet in tiles of the largest radius."""
    tile = lambda c: F.floor(F.col(c) / wide).cast("long")
    a = left.select(*keys, F.col(rank).alias("_ra"), F.col(center).alias("_ca"), F.col(radius).alias("_wa"), tile(center).alias("_tile"))
    b = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(rank).alias("_rb"), F.col(center).alias("_cb"), F.col(radius).alias("_wb"), F.explode(F.array(*[tile(center) + j for j in (-1, 0, 1)])).alias("_at"))
    on = (F.col("_tile") == F.col("_at")) & (F.abs(F.col("_ca") - F.col("_cb")) < F.greatest("_wa", "_wb"))
    for i, k in enumerate(keys):
        on = on & a[k].eqNullSafe(F.col(f"_k{i}"))
    return a.join(b, on).groupBy(*keys, F.col("_ra").alias(rank)).agg(F.min("_rb").alias("least"))


def peaks_by_rounds(rows: DataFrame, keys: list[str], rank: str, center: str, radius: str, wide: float, most: int = CHAIN_MOST) -> tuple[DataFrame, int]:
    """(keys, rank, center, radius) of the peaks that `greedy` selects, and the rounds it took.

    In a round every row that has no better one near it is a peak, and what is near it drops out: the same set as the pass in order of rank
    gives, as a row's fate hangs on better rows near it alone. Chains that are short by then are passed over at once.
    """
    key = [*keys, rank]
    with Rounds(rows.sparkSession) as tables:
        left, found, rounds = tables.hand_on(rows.select(*key, center, radius)), [], 0
        while True:
            chains = tables.hand_on(gap_islands(left, center, wide, [rank], keys, least=True).withColumnRenamed("island", "_chain"))
            sizes = tables.hand_on(chains.groupBy(*keys, "_chain").agg(F.count("*").alias("_size")))
            chains = tables.hand_on(attach(chains, sizes, [*keys, "_chain"]))
            short = one_pass(chains.where(F.col("_size") <= most).drop("_size"), keys, rank, center, radius)
            found.append(short.where("is_peak").select(*key, center, radius))
            long = chains.where(F.col("_size") > most).drop("_size", "_chain")
            if long.isEmpty():
                return tables.hand_on(reduce(DataFrame.unionByName, found), keep=True), rounds
            rounds += 1
            best = tables.hand_on(near_pairs(long, long, keys, rank, center, radius, wide).where(F.col("least") == F.col(rank)))
            peaks = tables.hand_on(attach(long, best, key).where("least IS NOT NULL").drop("least"))
            found.append(peaks)
            near = tables.hand_on(near_pairs(long, peaks, keys, rank, center, radius, wide))
            left = tables.hand_on(attach(long, near, key).where("least IS NULL").drop("least"))


def one_pass(chained: DataFrame, keys: list[str], rank: str, center: str, radius: str) -> DataFrame:
    """Rows (with _chain) and is_peak and owner, chain by chain in order of rank, with peaks found by their place in tiles of one radius."""

    def select(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(rank, kind="stable")
        at, size, ranks = group[center].to_numpy(float), group[radius].to_numpy(float), group[rank].to_numpy()
        tile = max(1.0, float(size.max()) if len(size) else 1.0)
        peaks: dict[int, list[int]] = {}
        owner = np.empty(len(group), dtype=np.int64)
        for i in range(len(group)):
            t = int(at[i] // tile)
            near = [k for s in (t - 1, t, t + 1) for k in peaks.get(s, ()) if abs(at[k] - at[i]) < max(size[k], size[i])]
            owner[i] = ranks[min(near)] if near else ranks[i]
            if not near:
                peaks.setdefault(t, []).append(i)
        return group.assign(is_peak=owner == ranks, owner=owner).drop(columns="_chain")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chained.drop("_chain").schema)
    return chained.groupBy(*keys, "_chain").applyInPandas(select, schema + ", is_peak boolean, owner long")


def greedy(df: DataFrame, keys: list[str], rank: str, center: str, radius: str, most: int = CHAIN_MOST) -> DataFrame:
    """Non-maximum suppression: rows in ascending rank become peaks unless they are less than a radius from a better peak of the keys.

    The radius of a pair is the larger of the two rows' (a column); ranks are unique by keys. Returns df with is_peak and owner (the rank of the best peak
    near the row, its own for a peak). Rows can only meet over chains of centers that are less than the largest radius apart. Chains of up to `most`
    rows are a group each; if there are longer ones, peaks are found by rounds of range joins first, and rows meet the peaks near them.
    """
    df = settled(df)
    wide = float(df.agg(F.max(radius)).first()[0] or 1.0)
    chained = settled(gap_islands(df, center, wide, [rank], keys, least=True).withColumnRenamed("island", "_chain"))
    longest = chained.groupBy(*keys, "_chain").count().agg(F.max("count")).first()[0] or 0
    if longest <= most:
        return one_pass(chained, keys, rank, center, radius)
    peaks, _ = peaks_by_rounds(df, keys, rank, center, radius, wide, most)
    owners = near_pairs(df, peaks, keys, rank, center, radius, wide).withColumnRenamed("least", "owner")
    return attach(df, owners, [*keys, rank]).withColumns({"is_peak": F.col("owner") == F.col(rank), "owner": F.col("owner").cast("long")}).select(*df.columns, "is_peak", "owner")


def regions(suppressed: DataFrame, keys: list[str], rank: str, start: str, end: str, step: int) -> DataFrame:
    """One region a peak: the stretch of its members around it in which neighbouring starts are at most a step apart."""
    w = W.partitionBy(*keys, "owner").orderBy(start)
    jump = F.when(F.col(start) - F.lag(start).over(w) > step, 1).otherwise(0)
    part = suppressed.withColumn("_jump", jump).withColumn("_part", F.sum("_jump").over(w.rowsBetween(W.unboundedPreceding, 0)))
    peak = part.where("is_peak").select(*keys, "owner", F.col("_part").alias("_own"))
    return part.join(peak, [*keys, "owner"]).where("_part = _own").groupBy(*keys, "owner").agg(F.min(start).alias("r_start"), F.max(end).alias("r_end"), F.count("*").alias("members")).withColumnRenamed("owner", "peak_rank")


def within_budget(cumulative: DataFrame, budget_bp: Column, rank: str, keys: list[str] = ()) -> DataFrame:
    """Whole ranked regions until their union reaches the budget; the overshoot stays, a budget of 0 selects none."""
    before = F.coalesce(F.lag("cumulative_bp").over(W.partitionBy(*keys).orderBy(rank)), F.lit(0))
    return cumulative.withColumn("_before", before).where(F.col("_before") < budget_bp).drop("_before")


def min_gap(df: DataFrame, keys: list[str], at: str, order: list[str], gap: float) -> DataFrame:
    """Greedy from the left: a row stays if it is at least `gap` behind the last one that stayed.

    A row at least `gap` behind its neighbour stays whatever is before it, so every stretch without such a gap is a group of its own.
    """
    w = W.partitionBy(*keys).orderBy(at, *order)
    chained = df.withColumn("_new", F.coalesce((F.col(at) - F.lag(at).over(w) >= gap).cast("int"), F.lit(1))).withColumn("_chain", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group, last, kept = group.sort_values([at, *order], kind="stable"), None, []
        for i, v in enumerate(group[at].tolist()):
            if last is None or v - last >= gap:
                kept.append(i)
                last = v
        return group.iloc[kept].drop(columns=["_new", "_chain"])

    return chained.groupBy(*keys, "_chain").applyInPandas(pick, df.schema)


def disjoint(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The most intervals that do not overlap: by earliest end, each that starts at or after the last one's end. Islands are groups of their own."""
    island = islands(df, start, end, [], keys)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group, last, kept = group.sort_values([end, start], kind="stable"), None, []
        for i, (a, b) in enumerate(zip(group[start].tolist(), group[end].tolist())):
            if last is None or a >= last:
                kept.append(i)
                last = b
        return group.iloc[kept].drop(columns="island")

    return island.groupBy(*keys, "island").applyInPandas(pick, df.schema)


def thin(df: DataFrame, count: int, at: str, seed: int, name: str) -> DataFrame:
    """The `count` rows that leave the least redundancy: rows with the nearest neighbours go first, ties by hash; one sort, deterministic."""
    w = W.partitionBy("chrom").orderBy(at, name)
    near = F.least(F.coalesce(F.col(at) - F.lag(at).over(w), F.lit(float("inf"))), F.coalesce(F.lead(at).over(w) - F.col(at), F.lit(float("inf"))))
    return df.withColumn("_near", near).orderBy(F.desc("_near"), F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(name)), 256)).limit(count).drop("_near")


#: Fixed value: the paired tail probability up to which a window is proposed.
PROPOSED_P = 0.05


def channel_proposals(scores: DataFrame, branches: tuple = ("density", "shape"), threshold: float = PROPOSED_P) -> DataFrame:
    """Peaks of each channel (scale and branch) among windows whose paired p, sqrt(p1 p2), is within the threshold.

    scores: window_id, scale, window_bp, chrom, w_start, w_end, center, rep{1,2}_zero_axis and rep{1,2}_{branch}_p. Best paired p first, then the larger of
    the smaller anomalies, then coordinates and identifier; a peak keeps off others of its channel that are less than half a window away.
    """
    p = lambda r, b: F.col(f"{r}_{b}_p")
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("branch"), F.sqrt(p("rep1", b) * p("rep2", b)).alias("pair_p"), F.greatest(p("rep1", b), p("rep2", b)).alias("worst_p"), (p("rep1", b) <= threshold).alias("rep1_supported"), (p("rep2", b) <= threshold).alias("rep2_supported")) for b in branches]))
    rows = scores.select("window_id", "scale", "window_bp", "chrom", "w_start", "w_end", "center", (F.col("rep1_zero_axis") | F.col("rep2_zero_axis")).alias("zero_axis"), each.alias("z")).select("*", "z.*").drop("z").where(F.col("pair_p") <= threshold)
    order = [F.col("pair_p"), F.col("worst_p"), F.col("chrom"), F.col("w_start"), F.col("w_end"), F.col("window_id")]
    r = ranked(rows, order, ["scale", "branch"], by=F.col("pair_p")).withColumns({"rank": F.col("rank").cast("long"), "radius": F.col("window_bp") / 2}).drop("percentile")
    out = greedy(r, ["scale", "branch", "chrom"], "rank", "center", "radius").where("is_peak").drop("is_peak", "owner", "radius")
    return out.withColumns({"channel": F.concat_ws("_", "scale", "branch"), "min_anomaly": -F.log10("worst_p")})


def merged_proposals(proposals: DataFrame, scales: tuple[str, ...], branches: tuple = ("density", "shape")) -> DataFrame:
    """One region for each stretch of overlapping proposals of all channels: place, the best proposal's window, which channels it comes from and what supports it."""
    best = F.min_by(F.struct("window_id", "center", "pair_p", "scale", "branch"), F.struct("pair_p", "worst_p", "chrom", "w_start", "w_end", "window_id", "channel"))
    found = islands(proposals, "w_start", "w_end", ["window_id", "channel"], ["chrom"]).groupBy("chrom", "island").agg(
        F.min("w_start").alias("r_start"), F.max("w_end").alias("r_end"), best.alias("b"), F.count_distinct("channel").alias("support_channels"), F.count("*").alias("members"),
        *[F.bool_or(F.col("channel") == f"{s}_{b}").alias(f"from_{s}_{b}") for s in scales for b in branches],
        F.count_if("rep1_supported").alias("rep1_support"), F.count_if("rep2_supported").alias("rep2_support"), F.bool_or("zero_axis").alias("zero_axis"),
    )
    found = found.select("chrom", "r_start", "r_end", F.col("b.window_id").alias("window_id"), F.col("b.center").alias("center"), F.col("b.pair_p").alias("best_p"), F.col("b.scale").alias("best_scale"), F.col("b.branch").alias("best_branch"), *[c for c in found.columns if c not in ("chrom", "island", "r_start", "r_end", "b")])
    return found.withColumn("region_id", ids.region_id(F.col("chrom"), F.col("r_start"), F.col("r_end"), F.col("window_id")))
