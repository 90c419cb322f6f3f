"""Annotation tables: CSV and BED with encodings, header aliases and type detection; raw file inventories; archives' members."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.schema import normalized_name

#: Header aliases and encodings, in the order they are tried.
ALIASES = {"chrom": ("chrom", "chr", "chromosome", "seqname"), "start": ("start", "chromstart", "begin"), "end": ("end", "chromend", "stop"), "center": ("center", "centre", "midpoint")}
ENCODINGS = ("UTF-8", "GB18030")
#: Classes of structures in the order their identifier columns are looked for, and key words of file names.
KINDS = ("OPCID", "CHIN", "CHID")
KEYWORDS = ("WT", "37C", "rep1", "rep2", "HNS", "FIS", "muk", "stpA", "bleo", "novo", "cipro", "net", "NoLig", "RT", "fix", "CHIN", "OPCID", "CHID")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header; a byte order mark is dropped. Text that is not UTF-8 is decoded as GB18030, which Spark's reader does not know."""
    raw = spark.read.format("binaryFile").load(path)
    if raw.where(~F.is_valid_utf8(F.col("content").cast("string"))).isEmpty():
        return spark.read.option("header", True).csv(path)

    def lines(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                own = content.decode(ENCODINGS[1]).splitlines()
                yield pa.RecordBatch.from_pydict({"n": list(range(len(own))), "line": own}, schema=pa.schema([("n", pa.int32()), ("line", pa.string())]))

    text = raw.select("content").mapInArrow(lines, "n int, line string")
    names = next(csv.reader([text.where("n = 0").first()["line"]]))
    schema = ", ".join(f"`{name}` string" for name in names)
    return text.where("n > 0").select(F.from_csv("line", schema).alias("r")).select("r.*")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end and name of a BED file; comment lines are left out."""
    rows = spark.read.option("sep", "\t").option("comment", "#").csv(path)
    names = ["chrom", "start", "end", "name"][: len(rows.columns)]
    return rows.toDF(*names, *rows.columns[len(names) :]).select("chrom", F.col("start").try_cast("long").alias("start"), F.col("end").try_cast("long").alias("end"), *(["name"] if "name" in names else []))


def column_for(df: DataFrame, wanted: str) -> str | None:
    """The column whose normalized header is an alias of the wanted one."""
    plain = {"".join(ch for ch in c.lower().lstrip("﻿") if ch.isalnum()): c for c in df.columns}
    return next((plain[a] for a in ALIASES[wanted] if a in plain), None)


def standardize(df: DataFrame, kind: Column, tolerance: tuple[float, float] = (1e-8, 1e-5)) -> DataFrame:
    """type, chrom, start, end, center, length_bp and whether a given center differs from (start + end) / 2; rows without values go."""
    cols = {k: column_for(df, k) for k in ALIASES}
    if not all(cols[k] for k in ("chrom", "start", "end")):
        raise ValueError("no chromosome, start or end column")
    s, e = F.col(f"`{cols['start']}`").try_cast("double").cast("long"), F.col(f"`{cols['end']}`").try_cast("double").cast("long")
    mid = (s + e) / 2
    given = F.col(f"`{cols['center']}`").try_cast("double") if cols["center"] else F.lit(None).cast("double")
    rows = df.select(kind.alias("type"), F.trim(F.col(f"`{cols['chrom']}`")).alias("chrom"), s.alias("start"), e.alias("end"), mid.alias("center"), (e - s).alias("length_bp"), F.coalesce(F.abs(given - mid) > tolerance[0] + tolerance[1] * F.abs(mid), F.lit(False)).alias("center_mismatch"))
    return rows.where("chrom IS NOT NULL OR start IS NOT NULL OR `end` IS NOT NULL")


def kind_of(columns: list[str]) -> str | None:
    """The class of structures that a table's headers name, by its identifier column."""
    plain = {c.lstrip("\ufeff").strip().lower() for c in columns}
    return next((k for k in KINDS if f"{k.lower()}_id" in plain), None)


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """type, chrom, start, end, center, length_bp, center_mismatch and source_file of all annotation tables below a folder.

    CSV files count if their header has a class's identifier column, BED files if their name has the class. A folder without such
    files gives an empty table. The list of files, not their rows, comes to the driver.
    """
    low = F.lower("name")
    files = inventory(spark, folder).where(low.endswith(".csv") | low.endswith(".bed")).select("path", "name").orderBy("path").collect()
    out = None
    for path, name in files:
        table = read_bed(spark, path) if name.lower().endswith(".bed") else read_csv(spark, path)
        kind = next((k for k in KINDS if k.lower() in name.lower()), None) if name.lower().endswith(".bed") else kind_of(table.columns)
        if kind:
            own = standardize(table, F.lit(kind)).withColumn("source_file", F.lit(path))
            out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], "type string, chrom string, start long, end long, center double, length_bp long, center_mismatch boolean, source_file string")


def container_health(pixels: DataFrame, sizes: DataFrame, binsize: int, keys: list[str]) -> DataFrame:
    """One row a container: bin size, pixels, chromosomes, bins, what is below the diagonal, outside its chromosome or no count, whether it has weights, and readable."""
    p = pixels.join(sizes, "chrom", "left")
    below, outside = F.col("bin1") > F.col("bin2"), (F.col("bin1") < 0) | F.col("size_bp").isNull() | ((F.col("bin2") + 1) * binsize > F.col("size_bp"))
    bad = (F.col("cnt") < 0) | F.isnan("cnt") | F.col("cnt").isNull()
    bins = sizes.agg(F.sum(F.expr(f"size_bp div {binsize}")).alias("bins"))
    out = p.groupBy(*keys).agg(F.lit(binsize).alias("binsize"), F.count("*").alias("pixels"), F.count_distinct("chrom").alias("chromosomes"), F.count_if(below).alias("below_diagonal"), F.count_if(outside).alias("outside"), F.count_if(bad).alias("bad_counts"), F.lit("weight" in pixels.columns).alias("has_weight"))
    return out.crossJoin(F.broadcast(bins)).withColumn("readable", (F.col("below_diagonal") == 0) & (F.col("outside") == 0) & (F.col("bad_counts") == 0))  # one row


def is_gzip(files: DataFrame) -> DataFrame:
    """(path, gzip): whether binary files begin as gzip does, whatever their names."""
    return files.select("path", (F.hex(F.substring("content", 1, 2)) == "1F8B").alias("gzip"))


def classify(name: Column) -> Column:
    """The kind of a raw file by its name; the first rule that matches counts."""
    low = F.lower(name)
    return F.when(low.rlike(r"\.m?cool(\.gz)?$"), "contact_map").when(low.rlike(r"\.(bed|csv|tsv|xlsx?)(\.gz)?$"), "table").when(low.rlike(r"\.(fa|fasta|gff3?|gtf)(\.gz)?$"), "reference").when(low.rlike(r"\.(tar|zip|tgz)$|\.tar\.gz$"), "archive").otherwise("other")


def tags(name: Column) -> Column:
    """The key words in a name, joined by semicolons."""
    return F.concat_ws(";", *[F.when(F.contains(F.lower(name), F.lit(k.lower())), F.lit(k)) for k in KEYWORDS])


def condition(name: Column) -> Column:
    """What a raw file's name says of the experiment; a mutation before a drug before a technical control."""
    low = F.lower(name)
    has = lambda *words: low.rlike("|".join(words))
    wild = F.when(low.rlike("37c[_-]?rep[12]") & ~has("fix"), "likely_wt_candidate").when(has("wt"), "wt_named_candidate")
    table = F.when(low.rlike(r"\.(csv|xlsx?|bed|gff3?)$"), "structure_annotation_candidate").otherwise("other")
    return F.when(has("hns", "fis", "muk", "stpa"), "mutation_condition").when(has("bleo", "novo", "cipro", "net"), "drug_condition").when(has("nolig", "rt_fix", "37c_fix"), "technical_control").otherwise(F.coalesce(wild, table))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size_bytes, modified, kind, tags and condition of all files below the path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), classify(name).alias("kind"), tags(name).alias("tags"), condition(name).alias("condition"))


def archive_members(files: DataFrame) -> DataFrame:
    """(path, member, size_bytes) of TAR archives given as binary files, without unpacking them."""

    def run(batches: Iterator[pa.RecordBatch]):
        import io
        import tarfile

        for batch in batches:
            out = [(p, m.name, m.size) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()) for m in tarfile.open(fileobj=io.BytesIO(c)) if m.isfile()]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["path", "member", "size_bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, member string, size_bytes long")


def header_names(df: DataFrame) -> DataFrame:
    """(name, normalized) of a table's columns."""
    return df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string").withColumn("normalized", normalized_name(F.col("name")))
