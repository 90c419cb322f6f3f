"""Ranks, running sums and quantiles of whole tables in range partitions, where a window without keys, or one a chromosome, would be one task.

A column of numbers is cut into ranges of about equally many rows. Rows are ordered inside ranges only; what the ranges before them
hold is a table of RANGES rows (by keys) that is added. Where the ranges are cut decides only which task a row is in, never a result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of a table, and with that the most rows that come to the driver.
RANGES = 64
#: Base pairs of a tile of `segments`.
TILE = 1 << 22


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, as its ranges need it more than once and must meet the same rows again.

    A local session that names no spark.checkpoint.dir computes df again instead; on a cluster that is an error, as its rows might differ then.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return df


class Rounds:
    """Tables that the rounds of a loop hand on, as Parquet below the checkpoint folder; leaving it deletes all but what is kept.

    A checkpoint keeps the estimate of its plan's size, and estimates of joins multiply: after some rounds of joins they are numbers of millions of digits.
    A table that is read again has the size of its files.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
        self.spark, self.base, self.kept = spark, f"{base.rstrip('/')}/rounds-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Rounds:
        settled(self.spark.range(0))  # a cluster without a shared folder is an error
        return self

    def hand_on(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """df, written and read again; what is kept outlives the loop."""
        self.kept += 1
        path = f"{self.base}{'-result' if keep else ''}/{self.kept}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *error) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def in_ranges(df: DataFrame, by: str, ranges: int = RANGES) -> DataFrame:
    """df with _range, ascending with the number `by`; equal numbers are in one range, nulls in the first."""
    cuts = [k / ranges for k in range(1, ranges)]
    at = df.agg(F.percentile_approx(F.col(by).cast("double"), cuts, F.lit(1000)).alias("at")).first()["at"]
    bounds = F.array(*[F.lit(float(b)) for b in sorted(set(at or [0.0]))])
    value = F.col(by).cast("double")
    return df.withColumn("_range", F.size(F.filter(bounds, lambda b: b < value)))


def before_ranges(placed: DataFrame, sums: dict[str, str], keys: list[str], descending: bool) -> DataFrame:
    """(keys, _range) with, for each sum, before_<name> (of the ranges before, in the direction) and all_<name>."""
    each = placed.groupBy(*keys, "_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    if keys:
        w = W.partitionBy(*keys)
        up = w.orderBy(F.desc("_range") if descending else F.asc("_range")).rowsBetween(W.unboundedPreceding, -1)
        return each.select(*keys, "_range", *[c for n in sums for c in (F.coalesce(F.sum(n).over(up), F.lit(0)).alias(f"before_{n}"), F.sum(n).over(w).alias(f"all_{n}"))])
    rows = sorted((r.asDict() for r in each.collect()), key=lambda r: -r["_range"] if descending else r["_range"])  # at most RANGES
    run, out = dict.fromkeys(sums, 0), []
    for r in rows:
        out.append((r["_range"], *[run[n] for n in sums]))
        run = {n: run[n] + (r[n] or 0) for n in sums}
    kind = {n: "long" if dict(each.dtypes)[n] in ("bigint", "int") else "double" for n in sums}
    schema = "_range int, " + ", ".join(f"before_{n} {kind[n]}" for n in sums)
    cast = {n: int if kind[n] == "long" else float for n in sums}
    table = placed.sparkSession.createDataFrame([(r, *[cast[n](x) for n, x in zip(sums, v)]) for r, *v in out], schema)
    return F.broadcast(table.withColumns({f"all_{n}": F.lit(cast[n](run[n])) for n in sums}))


def running_sums(df: DataFrame, by: str, sums: dict[str, str], keys: list[str] = (), descending: bool = False) -> DataFrame:
    """df with, for each name and column of `sums`, name (the sum over all rows of the keys up to and with those of the row's `by`) and all_<name>."""
    placed = in_ranges(settled(df), by)
    offsets = before_ranges(placed, sums, list(keys), descending)
    w = W.partitionBy(*keys, "_range").orderBy(F.desc(by) if descending else F.asc(by)).rangeBetween(W.unboundedPreceding, 0)
    out = placed.join(offsets, [*keys, "_range"]).withColumns({n: F.col(f"before_{n}") + F.sum(c).over(w) for n, c in sums.items()})
    return out.drop("_range", *[f"before_{n}" for n in sums])


def numbered(df: DataFrame, order: list[Column], by: Column, keys: list[str] = (), rank: str = "rank", total: str = "_n") -> DataFrame:
    """df with rank 1.. in the (total) order and the number of all rows, by keys. by: a number that never falls along the order."""
    placed = in_ranges(settled(df.withColumns({"_by": by, "_one": F.lit(1).cast("long")})), "_by")
    offsets = before_ranges(placed, {"rows": "_one"}, list(keys), False)
    own = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order))
    out = placed.join(offsets, [*keys, "_range"]).withColumn(rank, (F.col("before_rows") + own).cast("long")).withColumn(total, F.col("all_rows").cast("long"))
    return out.drop("_by", "_one", "_range", "before_rows", "all_rows")


def attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right's row of its keys; null keys are equal."""
    own = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(own[f"_k{i}"]) for i, k in enumerate(keys)])
    return left.join(own, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def segments(df: DataFrame, keys: list[str], at: str, order: list, value: Column, opens: Callable[[Column], Column], name: str, tile: int = TILE) -> DataFrame:
    """df with the number, from 1, of the segment that a row is in, by keys along (at, order).

    A segment opens at the first row and where opens(largest `value` of all rows before) holds. Rows are ordered inside tiles of `at` only; what the
    tiles before one hold, their largest value and how many segments they open, is a table of one row a tile that is carried on.
    """
    k, before, upto = [*keys, "_tile"], (W.unboundedPreceding, -1), (W.unboundedPreceding, 0)
    x = settled(df.withColumns({"_tile": F.floor(F.col(at) / tile).cast("long"), "_value": value}))
    along = W.partitionBy(*keys).orderBy("_tile").rowsBetween(*before)  # one row a tile
    tops = x.groupBy(*k).agg(F.max("_value").alias("_top")).select(*k, F.max("_top").over(along).alias("_before"))
    w = W.partitionBy(*k).orderBy(at, *order)
    seen = F.greatest("_before", F.max("_value").over(w.rowsBetween(*before)))
    x = attach(x, tops, k).withColumn("_seen", seen).withColumn("_new", F.when(F.col("_seen").isNull() | opens(F.col("_seen")), 1).otherwise(0))
    opened = x.groupBy(*k).agg(F.sum("_new").alias("_n")).select(*k, F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_offset"))
    return attach(x, opened, k).withColumn(name, (F.col("_offset") + F.sum("_new").over(w.rowsBetween(*upto))).cast("long")).drop("_tile", "_value", "_before", "_seen", "_new", "_offset")


def product(a: Column, b: Column) -> tuple[Column, Column]:
    """a * b as a double and what that leaves out (Dekker 1971)."""
    halves = lambda x: ((h := x * 134217729.0 - (x * 134217729.0 - x)), x - h)
    p, (ah, al), (bh, bl) = a * b, halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def mixed(low: Column, high: Column, share: Column) -> Column:
    """low * (1 - share) + high * share with one rounding after the first product, as the SQL engine's quantiles have it: values of few decimals
    give quantiles that end in a 5 where they are rounded, and the last bit decides. Values too large for the halves of a product are added plainly."""
    (p, left_out), c = product(low, 1 - share), high * share
    s = p + c
    z = s - p
    exact = s + (left_out + ((p - (s - z)) + (c - z)))
    return F.when(share == 0, low).when((F.abs(low) < 1e290) & (F.abs(high) < 1e290), exact).otherwise(s)


def quantiles(df: DataFrame, value: str, shares: dict[str, float], keys: list[str] = (), zeros: DataFrame | None = None) -> DataFrame:
    """(keys, the named exact quantiles), linear between neighbours, all shares in one pass. Nulls and not-a-numbers are left out.

    zeros(keys, zeros): so many more rows of 0 that df doesn't have, for statistics over masks; keys with nothing else are there too. Only the
    ranges that hold a neighbour of a quantile are sorted, each key's by itself; what is known of each key is a row.
    """
    own = list(keys) or ["_all"]
    rows = df.withColumn("_all", F.lit(0)) if not keys else df
    rows = settled(rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*own, F.col(value).cast("double").alias("_v"), F.lit(1).cast("long").alias("_one")))
    placed = in_ranges(rows, "_v")
    each = before_ranges(placed, {"rows": "_one"}, own, False)
    total = rows.groupBy(*own).agg(F.count("*").alias("_n"), F.count_if(F.col("_v") < 0).alias("_less"))
    if zeros is not None:
        more = zeros if keys else zeros.withColumn("_all", F.lit(0))
        total = total.join(more.select(*own, F.col("zeros").cast("long").alias("_z")), own, "full")
    total = total.select(*own, *[F.coalesce(F.col(c) if c in total.columns else F.lit(None), F.lit(0)).cast("long").alias(c) for c in ("_n", "_less", "_z")]).where("_n + _z > 0")
    share = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in shares.items()])).alias("s")
    asked = total.select("*", share).withColumn("_h", (F.col("_n") + F.col("_z") - 1) * F.col("s.q"))
    side = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), f("_h").cast("long").alias("place")) for n, f in (("low", F.floor), ("high", F.ceil))])).alias("p")
    place = F.col("p.place")
    stored = F.when(place < F.col("_less"), place).when(place >= F.col("_less") + F.col("_z"), place - F.col("_z"))
    asked = asked.select("*", side).select(*own, F.col("s.name").alias("name"), F.col("p.side").alias("side"), (F.col("_h") - F.floor("_h")).alias("_f"), stored.alias("_k"))
    size = placed.groupBy(*own, "_range").agg(F.count("*").alias("_size"))
    hold = each.select(*own, "_range", "before_rows").join(size, [*own, "_range"])
    meet = asked.select(*own, "_k").distinct().join(hold, own).where("before_rows <= _k AND before_rows + _size > _k").select(*own, "_range", "before_rows").distinct()
    order = F.row_number().over(W.partitionBy(*own, "_range").orderBy("_v"))
    found = placed.join(meet, [*own, "_range"]).select(*own, (F.col("before_rows") + order - 1).alias("_k"), "_v")
    known = asked.join(found, [*own, "_k"], "left").withColumn("_v", F.when(F.col("_k").isNull(), 0.0).otherwise(F.col("_v")))
    pick = lambda n, e: F.max(F.when((F.col("name") == n) & (F.col("side") == e), F.col("_v")))
    part = lambda n: F.max(F.when(F.col("name") == n, F.col("_f")))
    return known.groupBy(*own).agg(*[c.alias(f"_{e}_{n}") for n in shares for e, c in (("low", pick(n, "low")), ("high", pick(n, "high")), ("part", part(n)))]).select("*", *[mixed(F.col(f"_low_{n}"), F.col(f"_high_{n}"), F.col(f"_part_{n}")).alias(n) for n in shares]).select(*keys, *shares)


def quantile(df: DataFrame, value: str, share: float, keys: list[str] = (), name: str = "quantile") -> DataFrame:
    """(keys, name): one exact quantile."""
    return quantiles(df, value, {name: share}, keys)
