import io
import tarfile

import pytest
from pyspark.sql import functions as F

from pairloom.operators.status import compare_files, manifest
from pairloom.sources import annotations as A
from pairloom.sources import sinks
from pairloom.streaming import expected as E


def test_csv_encodings_and_standard_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Chrom,Start,End,Center\nc,10,20,15\nc,30,50,41\n,,,\n".encode())
    (tmp_path / "b.csv").write_bytes("名,Start\n染色体,1\n".encode("gb18030"))
    df = A.standardize(A.read_csv(spark, str(tmp_path / "a.csv")), F.lit("X")).orderBy("start").collect()
    assert [(r["start"], r["end"], r["center"], r["length_bp"], r["center_mismatch"]) for r in df] == [(10, 20, 15.0, 10, False), (30, 50, 40.0, 20, True)]
    assert A.read_csv(spark, str(tmp_path / "b.csv")).first()[0] == "染色体"
    with pytest.raises(ValueError):
        A.standardize(spark.range(1), F.lit("X"))


def test_centers_that_are_off_far_from_the_start(spark, tmp_path):
    """Structures beyond 700,000 bp: numpy.isclose, the default, takes 7 bp there for nothing; the query and its SQL don't."""
    import oracle
    from pairloom.plans import catalog

    for t in oracle.TABLES:
        path = f"/root/testdata/sf0.001/{t}.parquet"
        rows = spark.read.parquet(path)
        if t == "part":
            rows = rows.unionByName(rows.withColumn("p_partkey", (F.col("p_partkey") + 61 * 20_000).cast(rows.schema["p_partkey"].dataType)))
            rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
        else:
            (tmp_path / f"{t}.parquet").symlink_to(path)
    oracle.compare(spark, str(tmp_path), catalog.QUERIES["src09_standardize"], catalog.ORACLES["src09_standardize"])
    far = spark.createDataFrame([("c", 900_000, 900_100, 900_057.0)], "chrom string, start long, end long, center double")
    assert [A.standardize(far, F.lit("X"), *t).first()["center_mismatch"] for t in ((), ((1e-8, 0.0),))] == [False, True]


def test_bed_inventory_and_archives(spark, tmp_path):
    (tmp_path / "x.bed").write_text("#head\nc\t1\t5\tn\n")
    assert [tuple(r) for r in A.read_bed(spark, str(tmp_path / "x.bed")).collect()] == [("c", 1, 5, "n")]
    with tarfile.open(tmp_path / "y.tar", "w") as t:
        info = tarfile.TarInfo("inner.cool")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    assert {r["name"]: r["kind"] for r in A.inventory(spark, str(tmp_path)).collect()} == {"x.bed": "table", "y.tar": "archive"}
    files = spark.read.format("binaryFile").load(str(tmp_path / "y.tar"))
    assert [(r["member"], r["size_bytes"]) for r in A.archive_members(files).collect()] == [("inner.cool", 3)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, "b")], "n int, t string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert A.read_csv(spark, str(tmp_path / "csv")).columns == ["n", "t"]
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    before = sinks.write_table(df, str(tmp_path / "t"), ["t"])
    assert before.count() == 2 and sinks.verify(before, before).count() == 0
    rows = [tuple(r) for r in before.collect()]
    after = spark.createDataFrame([(rows[0][0], rows[0][1], "0"), ("new", 1, "1")], "path string, size_bytes long, sha256 string")
    assert {r["change"] for r in compare_files(spark.createDataFrame(rows, after.schema), after).collect()} == {"added", "removed", "changed"}
    one = spark.createDataFrame([(7,)], "seed int")
    sinks.freeze(one, str(tmp_path / "p"))
    sinks.freeze(one, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        sinks.freeze(spark.createDataFrame([(8,)], "seed int"), str(tmp_path / "p"))
    assert manifest(spark.read.format("binaryFile").load(str(tmp_path / "t/t=b"))).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    px = spark.createDataFrame([("rep1", "c", i, i + i % 5, float(i)) for i in range(60)], E.PIXELS)
    px.repartition(5).write.parquet(str(tmp_path / "px"))
    q = E.run_to_table(E.pixel_stream(spark, str(tmp_path / "px"), 2), "sums", str(tmp_path / "check"))
    q.awaitTermination()
    assert spark.table("sums").exceptAll(E.distance_sums(px)).count() == 0 and spark.table("sums").count() == 5


def test_discovery_over_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.csv").write_text("﻿CHIN_ID,Chr,Start,End\nx,c1,10,30\ny,c1,50,60\n", encoding="utf-8")
    (tmp_path / "notes.csv").write_text("name,value\na,1\n")
    (tmp_path / "my_chid.bed").write_text("# comment\nc2\t5\t25\tq\n")
    (tmp_path / "other.bed").write_text("c2\t5\t25\tq\n")
    got = sorted((r["type"], r["chrom"], r["start"], r["end"], r["center"], r["source_file"].rsplit("/", 1)[1]) for r in A.discover(spark, str(tmp_path)).collect())
    assert got == [("CHID", "c2", 5, 25, 15.0, "my_chid.bed"), ("CHIN", "c1", 10, 30, 20.0, "a.csv"), ("CHIN", "c1", 50, 60, 55.0, "a.csv")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("x")
    assert A.discover(spark, str(tmp_path / "none")).count() == 0


def test_health_gzip_and_tags(spark, tmp_path):
    import gzip

    sizes = spark.createDataFrame([("c", 1000)], "chrom string, size_bp long")
    ok = [("a", "c", 0, 9, 1.0)]
    bad = [("b", "c", 3, 2, 1.0), ("b", "c", 0, 10, 1.0), ("b", "x", 0, 1, 1.0), ("b", "c", 0, 1, -1.0)]
    got = {r["k"]: r for r in A.container_health(spark.createDataFrame(ok + bad, "k string, chrom string, bin1 long, bin2 long, cnt double"), sizes, 100, ["k"]).collect()}
    assert got["a"]["readable"] and (got["b"]["below_diagonal"], got["b"]["outside"], got["b"]["bad_counts"], got["b"]["bins"], got["b"]["readable"]) == (1, 2, 1, 10, False)
    (tmp_path / "a.cool").write_bytes(gzip.compress(b"x"))
    (tmp_path / "WT_37C_rep1_CHIN.bed").write_bytes(b"plain")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: r["gzip"] for r in A.is_gzip(files).collect()} == {"a.cool": True, "WT_37C_rep1_CHIN.bed": False}
    row = A.inventory(spark, str(tmp_path)).where("name LIKE 'WT%'").first()
    assert (row["tags"], row["condition"], row["kind"]) == ("WT;37C;rep1;CHIN", "likely_wt_candidate", "table")
