"""The domain's tables over the general test tables: pixels, windows, structures, cells and scores, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import ids
from pairloom.operators import contacts as K
from pairloom.operators import intervals as I

#: Width of a bucket of the range joins, of a block, and of the masked diagonal band.
BUCKET, BLOCK, GAP = 6400, 12800, 2
N = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    bin2 = F.col("l_partkey") + F.col("l_quantity").cast("long") - 1
    return li.select(F.when(F.col("l_linestatus") == "F", "rep1").otherwise("rep2").alias("replicate"), F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("bin1"), bin2.alias("bin2")).groupBy("replicate", "chrom", "bin1", "bin2").agg(F.count("*").cast("double").alias("cnt"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("chrom")).agg(((F.max(F.col("l_partkey") + F.col("l_quantity").cast("long") - 1) + 1) * 100).alias("size_bp"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.windows(sizes(spark, sf_dir))


def medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).where("scale = 'medium'")


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey % 61 = 0")
    return p.select(
        F.col("p_partkey").cast("long").alias("structure"),
        F.when(F.col("p_size") <= 25, "CHIN").when(F.col("p_size") <= 40, "OPCID").otherwise("CHID").alias("type"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END").alias("chrom"),
        (F.col("p_partkey").cast("long") * 100).alias("s_start"),
        (F.col("p_partkey").cast("long") * 100 + F.col("p_size") * 100).alias("s_end"),
        (F.col("p_partkey") * 100 + F.col("p_size") * F.lit(50.0)).alias("s_center"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of medium windows."""
    return K.window_cells(pixels(spark, sf_dir), sizes(spark, sf_dir), (K.SCALES[1],)).withColumn("n", F.lit(N))


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.expected(pixels(spark, sf_dir), sizes(spark, sf_dir), ["replicate", "chrom"], N)


def oe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the genome-wide O/E. Pixels meet their expectation (N rows for each replicate and chromosome) before windows multiply them."""
    px = pixels(spark, sf_dir).withColumn("d", F.expr("CAST(bin2 - bin1 AS INT)")).join(expected(spark, sf_dir), ["replicate", "chrom", "d"])
    px = px.withColumn("oe", K.genome_oe(F.col("cnt"), F.col("expected"))).drop("d")
    return K.window_cells(px, sizes(spark, sf_dir), (K.SCALES[1],), ("expected", "oe")).withColumn("n", F.lit(N))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every medium window with density and shape of both replicates: masked mean O/E, and masked mean squared distance of O/E from 1.

    One aggregation by window has the sums of both replicates; windows without cells get what zeros give.
    """
    m, own = K.mask_size(F.lit(N), GAP), {}
    for r in ("rep1", "rep2"):
        v = F.when(F.col("replicate") == r, F.col("oe"))
        own[f"{r}_density"] = F.coalesce(F.sum(v), F.lit(0.0)) / m
        own[f"{r}_shape"] = (F.coalesce(F.sum(F.pow(v - 1, F.lit(2.0))), F.lit(0.0)) + m - F.count(v)) / m
    wide = oe(spark, sf_dir).where(F.col("d") > GAP).groupBy("chrom", "w_start").agg(*[c.alias(k) for k, c in own.items()])
    all_ = medium(spark, sf_dir).join(wide, ["chrom", "w_start"], "left")
    return all_.select("chrom", "w_start", "w_end", "center", *[F.coalesce(c, F.lit(0.0 if c.endswith("density") else 1.0)).alias(c) for c in own])


def split_of() -> Column:
    """Known windows apart; background windows by blocks, which start elsewhere on each chromosome: of eight, five train, one val, two cal."""
    at = (F.expr(f"w_start div {BLOCK}") + F.expr("CASE chrom WHEN 'A' THEN 0 WHEN 'N' THEN 4 ELSE 6 END")) % 8
    return F.when(F.col("known"), "known").when(at <= 4, "train").when(at == 5, "val").otherwise("cal")


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scores with known (overlaps a structure), block and split."""
    s = scores(spark, sf_dir)
    hit = I.range_join(s.select("chrom", "w_start", "w_end"), structures(spark, sf_dir), BUCKET).select("chrom", "w_start").distinct().withColumn("_k", F.lit(True))
    out = s.join(hit, ["chrom", "w_start"], "left").withColumn("known", F.coalesce("_k", F.lit(False))).drop("_k")
    return out.withColumns({"block": F.expr(f"w_start div {BLOCK}"), "split": split_of()})


def scale_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of all three scales: identifier, density and shape of both replicates as in `scores`, rows and columns without a count, split."""
    most = max(w for _, w, _ in K.SCALES) // K.BIN
    e = K.expected(pixels(spark, sf_dir), sizes(spark, sf_dir), ["replicate", "chrom"], most)
    px = pixels(spark, sf_dir).withColumn("d", F.expr("CAST(bin2 - bin1 AS INT)")).join(e, ["replicate", "chrom", "d"]).withColumn("oe", K.genome_oe(F.col("cnt"), F.col("expected"))).drop("d", "expected")
    own = {}
    for r in ("rep1", "rep2"):
        mine = F.col("replicate") == r
        v = F.when(mine & (F.col("d") > GAP), F.col("oe"))
        own |= {f"{r}_sum": F.sum(v), f"{r}_off": F.sum(F.pow(v - 1, F.lit(2.0)) - 1), f"{r}_axes": F.size(F.array_union(F.collect_set(F.when(mine, F.col("i"))), F.collect_set(F.when(mine, F.col("j")))))}
    wide = K.window_cells(px, sizes(spark, sf_dir), K.SCALES, ("oe",)).groupBy("scale", "chrom", "w_start").agg(*[c.alias(k) for k, c in own.items()])
    s = windows(spark, sf_dir).join(wide, ["scale", "chrom", "w_start"], "left")
    n = F.expr(f"CAST(window_bp div {K.BIN} AS INT)")
    m = K.mask_size(n, GAP)
    values = {}
    for r in ("rep1", "rep2"):
        values |= {f"{r}_density": F.coalesce(f"{r}_sum", F.lit(0.0)) / m, f"{r}_shape": (F.coalesce(f"{r}_off", F.lit(0.0)) + m) / m, f"{r}_zero_axis": F.coalesce(f"{r}_axes", F.lit(0)) < n}
    key = ["scale", "chrom", "w_start"]
    hit = I.range_join(windows(spark, sf_dir), structures(spark, sf_dir), BUCKET).select(*key).distinct().withColumn("_k", F.lit(True))
    s = s.withColumns(values).join(hit, key, "left").withColumn("known", F.coalesce("_k", F.lit(False)))
    name = ids.scale_window_id(F.col("scale"), F.col("chrom"), F.col("w_start"), F.col("w_end"))
    return s.withColumn("split", split_of()).select(*key, "w_end", "center", "window_bp", name.alias("window_id"), *values, "known", "split")


def r6(c: Column | str) -> Column:
    """Six decimals as the SQL rounds them: the millionfold as a double, not the shortest decimal, decides what is nearer (values of nine decimals
    often end in a 5 at the seventh). Not a number is null."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.when(~F.isnan(c), c)
    scaled = c * 1e6
    near = F.rint(scaled)  # of two equally near, the even one; the SQL takes the one away from zero
    near = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near)
    return F.when(F.abs(scaled) < 2.0**52, near / 1e6).otherwise(F.round(c, 6)) + F.lit(0.0)


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six decimals and integers to longs, as the SQL gives them."""
    return df.select(*[r6(f"`{n}`").alias(n) if t in ("double", "float") else F.col(f"`{n}`").cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes])


SQL = f"""
WITH fx_pixels AS (
  SELECT CASE l_linestatus WHEN 'F' THEN 'rep1' ELSE 'rep2' END AS replicate, l_returnflag AS chrom, l_partkey AS bin1,
         l_partkey + CAST(l_quantity AS BIGINT) - 1 AS bin2, CAST(COUNT(*) AS DOUBLE) AS cnt FROM lineitem GROUP BY 1, 2, 3, 4),
fx_sizes AS (SELECT chrom, (MAX(bin2) + 1) * 100 AS size_bp FROM fx_pixels GROUP BY chrom),
fx_scales AS (SELECT * FROM (VALUES ('small', 3200, 400), ('medium', 6400, 800), ('large', 12800, 1600)) t(scale, window_bp, step_bp)),
fx_windows AS (
  SELECT scale, chrom, s AS w_start, s + window_bp AS w_end, s + window_bp // 2 AS center, CAST(window_bp AS BIGINT) AS window_bp, CAST(step_bp AS BIGINT) AS step_bp
  FROM (SELECT scale, window_bp, step_bp, chrom, unnest(range(0, size_bp - window_bp + 1, step_bp)) AS s FROM fx_sizes CROSS JOIN fx_scales WHERE size_bp >= window_bp)),
fx_medium AS (SELECT * FROM fx_windows WHERE scale = 'medium'),
fx_structures AS (
  SELECT CAST(p_partkey AS BIGINT) AS structure, CASE WHEN p_size <= 25 THEN 'CHIN' WHEN p_size <= 40 THEN 'OPCID' ELSE 'CHID' END AS type,
         CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS chrom, CAST(p_partkey AS BIGINT) * 100 AS s_start,
         CAST(p_partkey AS BIGINT) * 100 + p_size * 100 AS s_end, p_partkey * 100 + p_size * CAST(50 AS DOUBLE) AS s_center FROM part WHERE p_partkey % 61 = 0),
fx_cells AS (
  SELECT w.chrom, w.w_start, p.replicate, p.bin1 - w.w_start // 100 AS i, p.bin2 - w.w_start // 100 AS j, p.bin2 - p.bin1 AS d, p.cnt AS value
  FROM fx_pixels p JOIN fx_medium w ON p.chrom = w.chrom AND p.bin1 * 100 >= w.w_start AND (p.bin2 + 1) * 100 <= w.w_end),
fx_expected AS (
  SELECT g.replicate, g.chrom, g.d, coalesce(t.total / (g.n_bins - g.d), 0) AS expected
  FROM (SELECT DISTINCT p.replicate, p.chrom, s.size_bp // 100 AS n_bins, x.d FROM fx_pixels p JOIN fx_sizes s USING (chrom), (SELECT unnest(range({N})) AS d) x) g
  LEFT JOIN (SELECT replicate, chrom, bin2 - bin1 AS d, sum(cnt) AS total FROM fx_pixels GROUP BY 1, 2, 3) t ON g.replicate = t.replicate AND g.chrom = t.chrom AND g.d = t.d),
fx_oe AS (SELECT c.*, CASE WHEN e.expected > 0 THEN c.value / e.expected ELSE 0 END AS oe, e.expected FROM fx_cells c JOIN fx_expected e USING (replicate, chrom, d)),
fx_own AS (SELECT chrom, w_start, replicate, sum(oe) / 1891.0::DOUBLE AS density, (sum((oe - 1) * (oe - 1)) + 1891 - count(*)) / 1891.0::DOUBLE AS shape FROM fx_oe WHERE d > 2 GROUP BY 1, 2, 3),
fx_scores AS (
  SELECT w.chrom, w.w_start, w.w_end, w.center, coalesce(a.density, 0) AS rep1_density, coalesce(a.shape, 1) AS rep1_shape, coalesce(b.density, 0) AS rep2_density, coalesce(b.shape, 1) AS rep2_shape
  FROM fx_medium w LEFT JOIN fx_own a ON a.chrom = w.chrom AND a.w_start = w.w_start AND a.replicate = 'rep1' LEFT JOIN fx_own b ON b.chrom = w.chrom AND b.w_start = w.w_start AND b.replicate = 'rep2'),
fx_marked AS (
  SELECT *, CASE WHEN known THEN 'known' WHEN (block + CASE chrom WHEN 'A' THEN 0 WHEN 'N' THEN 4 ELSE 6 END) % 8 <= 4 THEN 'train' WHEN (block + CASE chrom WHEN 'A' THEN 0 WHEN 'N' THEN 4 ELSE 6 END) % 8 = 5 THEN 'val' ELSE 'cal' END AS split
  FROM (SELECT s.*, EXISTS (SELECT 1 FROM fx_structures t WHERE t.chrom = s.chrom AND s.w_start < t.s_end AND s.w_end > t.s_start) AS known, s.w_start // {BLOCK} AS block FROM fx_scores s))
"""
#: The medium windows with every cell of the upper triangle in place, zeros written out: what statistics over masks are held against. fx_both has both
#: triangles; fx_held the windows of a replicate that hold a cell.
DENSE = SQL + f""", fx_axis AS (SELECT unnest(range({N})) AS i), fx_up AS MATERIALIZED (SELECT a.i, b.i AS j, b.i - a.i AS d FROM fx_axis a JOIN fx_axis b ON b.i >= a.i),
fx_dense AS MATERIALIZED (SELECT g.*, coalesce(c.value, 0)::DOUBLE AS value, coalesce(c.oe, 0)::DOUBLE AS oe
  FROM (SELECT w.chrom, w.w_start, r.replicate, u.i, u.j, u.d FROM fx_medium w CROSS JOIN (VALUES ('rep1'), ('rep2')) r(replicate) CROSS JOIN fx_up u) g
  LEFT JOIN fx_oe c USING (chrom, w_start, replicate, i, j)),
fx_held AS (SELECT DISTINCT chrom, w_start, replicate FROM fx_cells),
fx_both AS (SELECT * FROM fx_dense UNION ALL SELECT * FROM fx_dense WHERE d > 0)"""
#: The windows of all scales with both branches of both replicates, as `scale_scores` gives them.
SCALED = f"""fx_all AS MATERIALIZED (SELECT w.scale, w.chrom, w.w_start, p.replicate, p.bin1 - w.w_start // 100 AS i, p.bin2 - w.w_start // 100 AS j, p.bin2 - p.bin1 AS d, p.cnt, CASE WHEN e.expected > 0 THEN p.cnt / e.expected ELSE 0 END AS oe
  FROM fx_pixels p JOIN fx_windows w ON p.chrom = w.chrom AND p.bin1 * 100 >= w.w_start AND (p.bin2 + 1) * 100 <= w.w_end JOIN fx_expected e ON e.replicate = p.replicate AND e.chrom = p.chrom AND e.d = p.bin2 - p.bin1),
fx_axes AS (SELECT scale, chrom, w_start, replicate, count(DISTINCT a) AS axes FROM (SELECT scale, chrom, w_start, replicate, unnest([i, j]) AS a FROM fx_all) GROUP BY ALL),
fx_sums AS (SELECT scale, chrom, w_start, replicate, sum(oe) AS s, sum((oe - 1) * (oe - 1) - 1) AS o FROM fx_all WHERE d > {GAP} GROUP BY ALL),
fx_scaled AS (SELECT *, CASE WHEN known THEN 'known' WHEN (w_start // {BLOCK} + CASE chrom WHEN 'A' THEN 0 WHEN 'N' THEN 4 ELSE 6 END) % 8 <= 4 THEN 'train' WHEN (w_start // {BLOCK} + CASE chrom WHEN 'A' THEN 0 WHEN 'N' THEN 4 ELSE 6 END) % 8 = 5 THEN 'val' ELSE 'cal' END AS split,
  'WIN_' || scale || '_' || sha256(scale || '|' || chrom || '|' || w_start || '|' || w_end)[1:16] AS window_id
  FROM (SELECT w.scale, w.chrom, w.w_start, w.w_end, w.center, w.window_bp, {", ".join(f"coalesce({r}.s, 0) / m AS rep{k}_density, (coalesce({r}.o, 0) + m) / m AS rep{k}_shape, coalesce({r}x.axes, 0) < w.window_bp // 100 AS rep{k}_zero_axis" for k, r in ((1, "a"), (2, "b")))},
    EXISTS (SELECT 1 FROM fx_structures t WHERE t.chrom = w.chrom AND w.w_start < t.s_end AND w.w_end > t.s_start) AS known
  FROM (SELECT *, (window_bp // 100 - {GAP} - 1) * (window_bp // 100 - {GAP}) / 2.0::DOUBLE AS m FROM fx_windows) w
  {" ".join(f"LEFT JOIN fx_{t} {r}{x} ON {r}{x}.scale = w.scale AND {r}{x}.chrom = w.chrom AND {r}{x}.w_start = w.w_start AND {r}{x}.replicate = 'rep{k}'" for k, r in ((1, "a"), (2, "b")) for t, x in (("sums", ""), ("axes", "x")))}))"""
