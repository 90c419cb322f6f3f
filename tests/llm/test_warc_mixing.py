import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

import oracle
from pairloom.llm import mixing, warc

SF = "/root/testdata/sf0.001"


def test_warc_round_trip(spark):
    rows = [(i, f"http://a/{i} b", "<p>é%d</p>" % (i % 7) * (i % 3)) for i in range(50)] + [(900, None, None), (None, "u", "<p>only</p>"), (None, "u", "<p>only</p>"), (7, "again", "<p>é0</p>"), (901, "x", "y" * 400000)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, kind string").repartition(3)
    m = warc.write(df, shard_bytes=6000, roll_bytes=3000)
    assert m.count() > 3
    got = warc.read(m).collect()
    assert len(got) == len(rows)
    top, seen = {}, {}
    for p, _, h in rows:
        top[h or ""] = max(top.get(h or "", -(1 << 63)), -(1 << 63) if p is None else p)
    by_sha = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): h for h in top}
    for r in got:
        h = by_sha[r["payload_digest"]]
        t = None if top[h] == -(1 << 63) else top[h]
        assert r["payload_bytes"] == len(h.encode())
        if r["record_type"] == "response":
            assert r["page_id"] == t and r["html"] == h and r["refers_to"] is None
            seen[h] = seen.get(h, 0) + 1
        else:
            assert r["refers_to"] == t
    assert seen == {h: 1 for h in top}
    again = warc.write(df.repartition(7), shard_bytes=6000, roll_bytes=3000)
    name = lambda q: sorted((r["path"].rsplit("/", 1)[1], r["bytes"]) for r in q.collect())
    assert name(m) == name(again)
    assert gzip.open(m.first()["path"].removeprefix("file://")).read().startswith(b"WARC/1.1\r\n")
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_cut_and_damaged_files_are_errors(spark, tmp_path):
    rows = [(i, "u", f"<p>{i}</p>" * 50) for i in range(9)]
    m = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    path = m.first()["path"].removeprefix("file://")
    raw = open(path, "rb").read()
    ends = [k for k in range(len(raw)) if raw[k : k + 3] == b"\x1f\x8b\x08"]
    last = ends[-1]
    for name, data in {"cut": raw[:-5], "cut early": raw[: last + 3], "a record short": raw[:last], "damaged": raw[:40] + bytes([raw[40] ^ 255]) + raw[41:]}.items():
        (tmp_path / "x.warc.gz").write_bytes(data)
        bad = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", 9)], "path string, records long")
        with pytest.raises(Exception, match="cut off|damaged|manifest|digests"):
            warc.read(bad).collect()
            raise AssertionError(name)
    assert warc.read(m.select("path")).count() == 9


def test_hot_payload_and_null_pages(spark):
    """A payload that most pages have, and many pages without identifier, in small shards."""
    rows = [(i, "u", "same" * 30) for i in range(800)] + [(None, "u", f"n{i}" * 30) for i in range(700)] + [(1 << 61, "u", "same" * 30), (None, "u", "same" * 30)]
    m = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_bytes=40_000)
    assert m.count() > 10 and m.agg(F.max("records")).first()[0] < 300
    got = warc.read(m).toPandas()
    assert len(got) == len(rows) and (got["record_type"] == "revisit").sum() == 801
    assert set(got[got["record_type"] == "revisit"]["refers_to"]) == {float(1 << 61)}


def test_oracles(spark):
    oracle.compare(spark, SF, warc.op4_warc, warc.OP4_SQL)
    oracle.compare(spark, SF, mixing.op7_mixing, mixing.OP7_SQL)


def test_mixing_edges(spark):
    rows = [(i, "w " * (i % 9), "abc"[i % 3]) for i in range(300)] + [(None, None, None), (5, "x y", None), (400, "", "z"), (401, "w " * 9000, "c")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, size int, row int, target int")
    m = mixing.mix(df).drop("row").toPandas()
    assert len(m) == len(rows) and (m["copies"] <= 2).all()
    t = mixing.mix(df).select("row.source", "source_size", "target").distinct().toPandas()
    assert (t["target"] <= 2 * t["source_size"] + 1e-6).all()
    assert abs(t["target"].sum() - 1.5 * m["size"].sum()) < 1e-6 * m["size"].sum()
    out = mixing.emit(df)
    assert out.columns == df.columns and out.count() == m["copies"].sum()
    assert mixing.mix(df).select("row.doc_id", "copies").exceptAll(mixing.mix(df.repartition(7)).select("row.doc_id", "copies")).count() == 0
    assert mixing.emit(df.limit(0)).count() == 0
    assert mixing.mix(df.where("source = 'z'")).agg(F.sum("copies")).first()[0] == 0
