"""Deterministic sharded WARC archives: written by range of identifier, rolled by compressed size, committed by manifest."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import common as C

#: Payload bytes of a range of identifiers that one task writes; compressed bytes at which a new file begins.
SHARD_BYTES, ROLL_BYTES = 32 << 20, 64 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_PAGE = -(1 << 63)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page}')}>"


def record(page: int | None, url: str, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: HTTP headers are made anew from the payload; a revisit has them without the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Page-ID: {'' if page is None else page}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(raw, path: str = "") -> Iterator[bytes]:
    """The gzip members of a file, one by one. A member that is cut off or damaged raises ValueError."""
    z, out, left, started = zlib.decompressobj(31), [], b"", False
    while True:
        data = left or raw.read(1 << 20)
        if not data:
            if started:
                raise ValueError(f"{path}: the last record is cut off")
            return
        started = True
        try:
            out.append(z.decompress(data))
        except zlib.error as e:
            raise ValueError(f"{path}: a record is damaged") from e
        left = b""
        if z.eof:
            yield b"".join(out)
            left, z, out, started = z.unused_data, zlib.decompressobj(31), [], False


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write(pages: DataFrame, root: str | None = None, least_bytes: int = LEAST_BYTES, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = 6) -> DataFrame:
    """Writes a record per row of (page_id, url, html) and returns the manifest: path, records, bytes, first, last.

    Of rows with equal payloads of at least `least_bytes` that with the largest page_id is a response, others revisit it
    (null is the smallest page_id; of repeated rows the first written is the response). Ranges of page_id and payload are cut by
    payload sizes, and do not depend on the cluster. Tasks write under temporary names; the manifest, committed by
    Spark, names those of the attempts that counted, and only they are renamed. Null html is an empty payload.
    """
    spark = pages.sparkSession
    C.arrow_rows(spark, 200)
    root = (root or C.scratch(spark, "warc")).rstrip("/")
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_PAGE)).alias("d"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    sha = F.unhex(F.sha1("html"))
    facts = C.stored(rows.select("d", sha.alias("sha"), F.xxhash64(sha).alias("x"), F.octet_length("html").cast("long").alias("size")), "payloads")
    # written, so that Spark may divide a payload that many pages have in the join
    tops = C.stored(facts.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.max("d").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n"), "tops")
    refs = facts.join(tops, "sha").select("d", "x", "sha", "top").distinct()
    shards, shard = C.id_shards(facts, F.col("size") + 600, shard_bytes)
    own = rows.select("d", F.xxhash64(sha).alias("x"), "url", "html", F.lit(None).cast("long").alias("top"), F.lit(1).alias("kind"))
    mixed = refs.select("d", "x", F.lit("").alias("url"), F.col("sha").alias("html"), "top", F.lit(0).alias("kind")).unionByName(own)
    placed = mixed.withColumn("shard", shard).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "d", "x", "kind", "url", "html")

    def put(batches):
        fs, base = C.filesystem(root)
        fs.create_dir(f"{base}/_temporary", recursive=True)
        state = {"shard": None, "out": None}
        done, refs_of, at, given = [], {}, None, set()

        def close():
            if state["out"]:
                state["out"].close()
                done.append((state["shard"], state["seq"], state["name"], state["n"], state["size"], state["first"], state["last"]))
                state["out"], state["seq"] = None, state["seq"] + 1

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("shard", "d", "kind", "url", "html", "top")]
            for sh, d, kind, url, html, top in zip(*cols):
                if sh != state["shard"]:
                    close()
                    state |= {"shard": sh, "seq": 0}
                if d != at:
                    at, refs_of, given = d, {}, set()
                if kind == 0:
                    refs_of[html] = top
                    continue
                raw = hashlib.sha1(html).digest()
                top = refs_of.get(raw)
                revisit = top is not None and (top != d or raw in given)
                given.add(raw)
                page = None if d == NO_PAGE else d
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = z.compress(record(page, url, html, base64.b32encode(raw).decode(), None if top == NO_PAGE else top, revisit)) + z.flush()
                if state["out"] and state["size"] + len(data) > roll_bytes:
                    close()
                if not state["out"]:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    state |= {"out": fs.open_output_stream(f"{base}/_temporary/{name}", compression=None), "name": name, "n": 0, "size": 0, "first": d}
                state["out"].write(data)
                state |= {"n": state["n"] + 1, "size": state["size"] + len(data), "last": d}
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "seq", "temporary", "records", "bytes", "first", "last"), x)) for x in done], schema=pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))

    written = C.stored(placed.mapInArrow(put, "shard int, seq int, temporary string, records long, bytes long, first long, last long"), "warc-written")

    def commit(batches):
        fs, base = C.filesystem(root)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                name = f"part-{r['shard']:06d}-{r['seq']:05d}.warc.gz"
                if fs.get_file_info(f"{base}/_temporary/{r['temporary']}").is_file:  # else an earlier attempt has moved it
                    fs.move(f"{base}/_temporary/{r['temporary']}", f"{base}/{name}")
                out.append({"path": f"{root}/{name}", "records": r["records"], "bytes": r["bytes"], "first": r["first"], "last": r["last"]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))

    manifest = written.mapInArrow(commit, "path string, records long, bytes long, first long, last long")
    manifest.write.parquet(f"{root}/manifest")
    fs, base = C.filesystem(root)
    if fs.get_file_info(f"{base}/_temporary").type == FileType.Directory:  # what attempts that did not count have left
        fs.delete_dir(f"{base}/_temporary")
    return spark.read.schema(manifest.schema).parquet(f"{root}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Per record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null for a revisit).

    Block and payload digests are checked, and the number of records against the manifest (where it has one); what does not match, or is cut off, raises an error.
    """

    def get(batches):
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                fs, name = C.filesystem(path)
                rows, size, count = [], 0, 0
                with fs.open_input_stream(name, compression=None) as raw:
                    for member in members(raw, path):
                        count += 1
                        f, block = parse(member)
                        kind = f["WARC-Type"]
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        sha = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if f["WARC-Block-Digest"] != f"sha1:{digest32(block)}" or payload is not None and (digest32(payload) != sha or len(payload) != int(f["X-Payload-Length"])):
                            raise ValueError(f"{path}: {f['WARC-Record-ID']} does not match its digests")
                        rows.append({"page_id": int(f["X-Page-ID"]) if f["X-Page-ID"] else None, "url": f["WARC-Target-URI"], "payload_bytes": int(f["X-Payload-Length"]), "payload_digest": sha, "record_type": kind, "refers_to": int(x) if (x := f.get("X-Refers-To-Page-ID")) else None, "html": payload.decode() if payload is not None else None})
                        size += len(block)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                            rows, size = [], 0
                if records is not None and count != records:
                    raise ValueError(f"{path}: the manifest has {records} records, the file {count}")
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    spread = manifest.select("path", F.col("records") if "records" in manifest.columns else F.lit(None).cast("long").alias("records")).repartition(max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism)))
    return spread.mapInArrow(get, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("url", "html")


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex FROM p),
e AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM e
"""
