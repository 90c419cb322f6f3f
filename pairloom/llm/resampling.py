"""Target-distribution importance resampling over hashed n-grams, through an integer dictionary of words.

A word's id is a seeded 64-bit hash; the dictionary is the table of all distinct words with their ids, and it is checked that no two words share one
(else it is made again with the next seed). So every task maps words to ids by itself, without a join. An n-gram is a tuple of ids, and a tuple's id
is made and checked the same way. The bytes of each distinct tuple are put together from the dictionary and hashed once; its bucket's gain is
joined back to the documents that hold it: the most frequent tuples are with every task (a bounded number), the others are joined by id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import common as C
from pairloom.llm import text as T

#: Fixed values of the contract: words of an n-gram, buckets, least words and percentage of the drawn documents, seed, scale of gains.
LOW, HIGH, BUCKETS, LEAST, PERCENT, SEED, SCALE = 1, 1, 10_000, 20, 10, 2024, 1000
#: The most tuples whose gains every task holds (8 + 4 bytes each).
HELD = 1 << 19
#: Lower case, and a space for every ASCII byte but digits and letters.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class Grams:
    """The n-grams of some texts: `words` (T.Words, lower case) with their `ids`, and for each n-gram its first word, number of words, text and id."""

    def __init__(self, texts: list[bytes], low: int, high: int, seed: int):
        self.words = w = T.Words([t.translate(_BYTES) for t in texts])
        self.ids = T.mix(w.hash ^ np.uint64(T.BASE * (seed + 1) & (1 << 64) - 1))
        left = w.first[w.doc + 1] - np.arange(len(w))  # words from each to its text's end
        starts = [np.flatnonzero(left >= n) for n in range(low, high + 1)]
        self.at = np.concatenate(starts)
        self.size = np.repeat(np.arange(low, high + 1), [len(s) for s in starts])
        self.doc = w.doc[self.at]
        self.id = np.concatenate([tuple_ids([self.ids[s + k] for k in range(n)], seed) for n, s in zip(range(low, high + 1), starts)])


def tuple_ids(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """Ids of tuples of word ids; a tuple of one word has the word's."""
    out = parts[0]
    for k, p in enumerate(parts[1:]):
        out = T.mix(out * np.uint64(T.BASE) + p + np.uint64(seed + k + 1))
    return out


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values ascending, a place of each, and how often they are."""
    o = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], ids[o][1:] != ids[o][:-1]))) if len(o) else o
    return ids[o[first]], o[first], np.diff(np.concatenate((first, [len(o)])))


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def dictionary(texts: DataFrame, seed: int) -> DataFrame:
    """(id, word) of the distinct words of texts(text), with `other`: a second word of that id, which there must not be."""

    def run(batches):
        for batch in batches:
            own = C.pylist(batch, "text")
            for a, b in T.chunks(own, 1 << 22):
                g = Grams(own[a:b], 1, 1, seed)
                ids, at, _ = counted(g.ids)
                s, e, raw = g.words.start[at].tolist(), g.words.end[at].tolist(), g.words.raw
                yield pa.RecordBatch.from_arrays([longs(ids), pa.array([raw[i:j] for i, j in zip(s, e)], pa.binary())], ["id", "word"])

    return texts.select("text").mapInArrow(run, "id long, word binary").groupBy("id").agg(F.min("word").alias("word"), F.max("word").alias("other"))


def tuples(texts: DataFrame, low: int, high: int, seed: int) -> DataFrame:
    """(id, ids, other, s, t): distinct n-grams of texts(text, target), the ids of their words, a second tuple of that id, and how often they are in the others and in the target."""

    def run(batches):
        for batch in batches:
            own, target = C.pylist(batch, "text"), batch.column("target").to_numpy(zero_copy_only=False)
            for a, b in T.chunks(own, 1 << 22):
                g = Grams(own[a:b], low, high, seed)
                aim = target[a:b][g.doc]
                for part in (False, True):
                    at = np.flatnonzero(aim == part)
                    ids, first, n = counted(g.id[at])
                    at, size = g.at[at][first], g.size[at][first]
                    ends = np.cumsum(size)
                    flat = g.ids[np.repeat(at, size) + np.arange(size.sum()) - np.repeat(ends - size, size)]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), longs(flat))
                    none = np.zeros(len(n), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([longs(ids), lists, *(pa.array(x, pa.int64()) for x in ((none, n) if part else (n, none)))], ["id", "ids", "s", "t"])

    each = texts.mapInArrow(run, "id long, ids array<long>, s long, t long")
    return each.groupBy("id").agg(F.min("ids").alias("ids"), F.max("ids").alias("other"), F.sum("s").alias("s"), F.sum("t").alias("t"))


def gain(s: Column, t: Column, all_s: Column, all_t: Column, buckets: int = BUCKETS) -> Column:
    """floor(SCALE * log ratio of a bucket's smoothed shares in the target and in the others)."""
    d = lambda c: c.cast("double")
    return F.floor(F.lit(float(SCALE)) * F.log(((d(t) + 1.0) * (d(all_s) + float(buckets))) / ((d(s) + 1.0) * (d(all_t) + float(buckets))))).cast("long")


def tuple_gains(docs: DataFrame, target: DataFrame, low: int, high: int, buckets: int) -> tuple[DataFrame, int]:
    """(id, gain, s) of every distinct n-gram of docs, stored, and the seed of the ids."""
    texts = docs.select("text", F.lit(False).alias("target")).unionByName(target.select("text", F.lit(True).alias("target")))
    for seed in range(8):
        words = C.stored(dictionary(texts, seed), "words")
        grams = C.stored(tuples(texts, low, high, seed), "tuples")
        if words.where("word <> other").isEmpty() and grams.where("ids <> other").isEmpty():
            break
    else:
        raise ValueError("eight seeds gave two words or n-grams one id; the texts are made for that")

    def hashed(batches):
        for batch in batches:
            values = [zlib.crc32(b" ".join(w)) % buckets for w in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values, pa.int32())], ["id", "bucket"])

    bytes_of = words.select("id", "word")
    if high == 1:
        written = bytes_of.select("id", F.array("word").alias("words"))
    else:  # the words of each distinct tuple in their order, joined by id
        parts = grams.select("id", F.posexplode("ids").alias("k", "part")).join(bytes_of.withColumnRenamed("id", "part"), "part")
        written = parts.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("words"))  # at most `high` words
    bucket = written.mapInArrow(hashed, "id long, bucket int")
    placed = C.stored(grams.select("id", "s", "t").join(bucket, "id"), "tuple-buckets")
    sums = C.stored(placed.groupBy("bucket").agg(F.sum("s").alias("bs"), F.sum("t").alias("bt")), "buckets")  # at most `buckets` rows
    all_s, all_t = (F.lit(x or 0) for x in sums.agg(F.sum("bs"), F.sum("bt")).first())
    gains = sums.select("bucket", gain(F.col("bs"), F.col("bt"), all_s, all_t, buckets).alias("gain"))
    return C.stored(placed.where("s > 0").join(F.broadcast(gains), "bucket").select("id", "gain", "s"), "tuple-gains"), seed


def frequent(gains: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The gains of at most `most` n-grams, the most frequent ones, and those of all others. The cut is a count, found from a histogram of powers of 2 ** (1 / 8)."""
    level = F.floor(F.log2(F.col("s").cast("double")) * 8).cast("int")
    held, least = 0, None
    for r in gains.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 64 * 8 rows
        if held + r["count"] > most:
            break
        held, least = held + r["count"], r["level"]
    if least is None:
        return gains.limit(0), gains
    return gains.where(level >= least), gains.where(level < least)


def weights(docs: DataFrame, gains: DataFrame, low: int, high: int, seed: int, held: int = HELD) -> DataFrame:
    """(doc_id, d, x, n_words, n_features, weight) of every row of docs: weight is the sum of the gains of its n-grams."""
    spark = docs.sparkSession
    some, rest = frequent(gains, held)
    table = some.select("id", "gain").toPandas().sort_values("id")  # at most `held` rows
    known = spark.sparkContext.broadcast((table["id"].to_numpy(np.int64), table["gain"].to_numpy(np.int64)))

    def run(batches):
        ids, values = known.value
        for batch in batches:
            own = C.pylist(batch, "text")
            for a, b in T.chunks(own, 1 << 22):
                g = Grams(own[a:b], low, high, seed)
                gram = g.id.view(np.int64)
                at = np.minimum(np.searchsorted(ids, gram), max(0, len(ids) - 1))
                hit = ids[at] == gram if len(ids) else np.zeros(len(gram), dtype=bool)
                total = np.zeros(b - a, dtype=np.int64)
                np.add.at(total, g.doc[hit], values[at[hit]])
                other = np.flatnonzero(~hit)
                o = other[np.lexsort((gram[other], g.doc[other]))]
                new = np.flatnonzero(np.concatenate(([True], (gram[o][1:] != gram[o][:-1]) | (g.doc[o][1:] != g.doc[o][:-1])))) if len(o) else o
                times = np.diff(np.concatenate((new, [len(o)])))
                cut = pa.array(np.searchsorted(g.doc[o[new]], np.arange(b - a + 1)).astype(np.int32))
                cols = [pa.array(np.diff(g.words.first), pa.int64()), pa.array(np.bincount(g.doc, minlength=b - a), pa.int64()), pa.array(total)]
                cols += [pa.ListArray.from_arrays(cut, pa.array(gram[o[new]])), pa.ListArray.from_arrays(cut, pa.array(times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ("doc_id", "d", "x")] + cols, ["doc_id", "d", "x", "n_words", "n_features", "weight", "other", "times"])

    schema = "doc_id long, d long, x long, n_words long, n_features long, weight long, other array<long>, times array<long>"
    base = C.text_keys(docs).mapInArrow(run, schema)
    if rest.isEmpty():
        return C.stored(base.drop("other", "times"), "weights")
    base = C.stored(base, "weights")
    rows = base.where(F.size("other") > 0).select("d", "x", F.explode(F.arrays_zip("other", "times")).alias("o")).select("d", "x", F.col("o.other").alias("id"), F.col("o.times").alias("times")).distinct()
    more = rows.join(rest.select("id", "gain"), "id").groupBy("d", "x").agg(F.sum(F.col("gain") * F.col("times")).alias("more"))
    return base.drop("other", "times").join(more, ["d", "x"], "left").withColumn("weight", F.col("weight") + F.coalesce("more", F.lit(0))).drop("more")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(SCALE * a Gumbel number) of the identifier, by the first 32 bits of sha256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def placed_by_score(scored: DataFrame, spark: SparkSession) -> DataFrame:
    """(score, d, x, place) of the rows, place 0, 1, ... by falling score, then d: sorted in ranges, and what the ranges before hold is added."""
    order = [F.desc("score"), F.asc("d"), F.asc("x")]
    rows = scored.select("score", "d", "x").repartitionByRange(C.partitions(spark), *order).sortWithinPartitions(*order)
    rows = C.stored(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "placed")
    before, table = 0, []
    for part, n in sorted(map(tuple, rows.groupBy("part").count().collect())):  # a row a partition
        table.append((part, before))
        before += n
    offsets = spark.createDataFrame(table, "part int, before long")
    return rows.join(F.broadcast(offsets), "part").select("score", "d", "x", (F.col("before") + F.col("at")).alias("place"))


def resample(docs: DataFrame, target: DataFrame, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED, held: int = HELD) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs(doc_id, text); rank is null where a row is not drawn.

    weight: the gains of the row's n-grams (`low` to `high` consecutive words), repeats counted. score: weight plus Gumbel noise of its
    identifier. Of the N rows with at least `least` words the floor(percent * N / 100) highest scores are drawn, ties to the smaller doc_id
    (nulls last), then to the hash of the text. Null and wordless texts have no features, weight 0, and are never drawn where `least` is over 0. An
    empty target gives smoothed shares; an empty table gives no rows. Repeated rows are rows of their own, with ranks of their own.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    C.arrow_rows(spark)
    docs = docs.select("doc_id", "text")
    gains, ids = tuple_gains(docs, target, low, high, buckets)
    scored = C.stored(weights(docs, gains, low, high, ids, held).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    able = scored.where(F.col("n_words") >= least)
    draw = percent * able.count() // 100
    ranks = placed_by_score(able, spark).where(F.col("place") < draw).withColumn("rank", F.col("place") + 1)
    # equal rows (d, x) have one score and follow each other: the first rank and how many of them are drawn say which ranks they get
    first = ranks.groupBy("d", "x").agg(F.min("rank").alias("first"), F.count("*").alias("drawn"))
    alike = scored.groupBy("d", "x", "doc_id", "n_words", "n_features", "weight", "score").agg(F.count("*").alias("rows"))
    out = alike.join(first, ["d", "x"], "left").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("k") < F.col("drawn"), F.col("first") + F.col("k")).alias("rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(w) AS w FROM d) GROUP BY ALL),
c AS (SELECT w, sum(s) AS s, sum(t) AS t FROM (SELECT w, n AS s, 0 AS t FROM f UNION ALL SELECT unnest(w), 0, 1 FROM b) GROUP BY w),
x AS (SELECT w, s, t, hex(encode(w)) AS h FROM c),
k AS (SELECT w, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 10000 AS bucket FROM x, tab),
g AS (SELECT bucket, CAST(floor(1000 * ln((sum(t) + 1)::DOUBLE * (sum(sum(s)) OVER () + 10000)::DOUBLE / ((sum(s) + 1)::DOUBLE * (sum(sum(t)) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM k GROUP BY bucket),
m AS (SELECT rid, sum(n * gain) AS weight FROM f JOIN k USING (w) JOIN g USING (bucket) GROUP BY rid),
z AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
      CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS noise FROM d LEFT JOIN m USING (rid)),
r AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM r
"""
