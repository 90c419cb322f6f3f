"""SimHash near-duplicates: fingerprints of word shingles, linked by BK-trees over shards that agree in blocks of bits."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import common as C
from pairloom.llm import text as T
from pairloom.llm.graph import components
from pairloom.llm.resampling import frequent

SHINGLE, RADIUS = 3, 2
#: Fixed value of the fingerprint: the seed of XXH64.
SEED = 42
#: A tree holds at most so many fingerprints; larger shards are divided by more of their bits (results are the same at any value). Shards that agree
#: in all but FREE_BITS bits are not divided: they hold 256 fingerprints at most.
TREE_MOST, FREE_BITS = 256, 8


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each set if set in over half of the hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    stop = end[min(shingle, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], SEED) for a, b in zip(start[:n].tolist(), stop.tolist())], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


class BKTree:
    """Fingerprints by Hamming distance: the children of a node are keyed by their distance to it."""

    def __init__(self):
        self.value: list[int] = []
        self.edges: list[dict[int, int]] = []

    def near(self, x: int, radius: int) -> list[tuple[int, int]]:
        """(distance, place) of all fingerprints within the radius; only edges whose key the triangle inequality allows are followed."""
        found, todo = [], [0] if self.value else []
        while todo:
            k = todo.pop()
            d = (self.value[k] ^ x).bit_count()
            if d <= radius:
                found.append((d, k))
            todo += [child for key, child in self.edges[k].items() if d - radius <= key <= d + radius]
        return found

    def add(self, x: int) -> int:
        new, k = len(self.value), 0
        self.value.append(x)
        self.edges.append({})
        while new:
            d = (self.value[k] ^ x).bit_count()
            k, at = self.edges[k].setdefault(d, new), k
            if k == new:
                break
        return new


class Classes:
    """Classes of places 0, 1, ... that are joined (union-find)."""

    def __init__(self):
        self.up: list[int] = []

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart before."""
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning star for each component of the values (distinct) under distances up to the radius."""
    tree, parts = BKTree(), Classes()
    for x in values:
        near = tree.near(x, radius)
        parts.up.append(tree.add(x))
        for _, k in near:
            parts.join(len(parts.up) - 1, k)
    return [(x, values[r]) for k, x in enumerate(values) if (r := parts.root(k)) != k]


def block_masks(radius: int, used: int = 0) -> list[int]:
    """Masks that keep the bits of `used` and two of radius + 2 blocks of the others: values within the radius that agree in `used` agree in one of these."""
    free = [b for b in range(64) if not used >> b & 1]
    edge = [round(i * len(free) / (radius + 2)) for i in range(radius + 3)]
    block = [sum(1 << b for b in free[i:j]) for i, j in zip(edge, edge[1:])]
    return [used | x | y for x, y in combinations(block, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = RADIUS, tree_most: int = TREE_MOST) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join exactly those connected by distances up to `radius` (0 to 2).

    Every fingerprint goes to a shard for each pair of blocks of bits; a shard has a BK-tree of its own, which its members search.
    So the trees are not broadcast whole - they grow with the corpus - but laid out where the searches that can meet them go.
    A shard of over `tree_most` is divided the same way by its bits that are still free, which is as exact, until every tree is small.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    spark = prints.sparkSession

    def search(batches):
        key, values, out = None, [], []
        for batch in batches:
            for path, part, fp in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "fp"))):
                if key != (path, part):
                    out += tree_links(values, radius)
                    key, values = (path, part), []
                values.append(fp & ((1 << 64) - 1))
        out += tree_links(values, radius)
        yield pa.RecordBatch.from_pydict({"a": pa.array([signed(a) for a, _ in out], pa.int64()), "b": pa.array([signed(b) for _, b in out], pa.int64())})

    found, left, paths = [], prints.select("fp", F.lit(0).cast("long").alias("path")), {0: 0}
    while True:
        pairs = [(path, m) for path, used in paths.items() for m in block_masks(radius, used)]  # at most 6 ** 4
        masks = spark.createDataFrame([(old, new, signed(m)) for new, (old, m) in enumerate(pairs)], "path long, new long, mask long")
        keyed = left.join(F.broadcast(masks), "path").select(F.col("new").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
        sizes = C.stored(keyed.groupBy("path", "part").agg(F.count("*").alias("n")).where("n > 1"), "shard-sizes")
        shards = C.stored(keyed.join(sizes, ["path", "part"]), "shards")
        paths = {new: m for new, (_, m) in enumerate(pairs)}
        last = 64 - min(m.bit_count() for m in paths.values()) <= FREE_BITS
        small = shards if last else shards.where(F.col("n") <= tree_most)
        small = small.select("path", "part", "fp").repartition(C.partitions(spark), "path", "part").sortWithinPartitions("path", "part", "fp")
        found.append(small.mapInArrow(search, "a long, b long"))
        left = shards.where(F.col("n") > tree_most).select("path", "fp")
        if last or left.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, d, fp) of every row, stored. Null, empty and blank texts have fingerprint 0."""
    C.arrow_rows(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp = [signed(fingerprint(t, shingle)) for t in C.pylist(batch, "text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(fp, pa.int64())})

    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")
    return C.stored(prints.withColumn("d", F.coalesce("doc_id", F.lit(C.NO_ID))), "prints")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id it is linked with, directly or not.

    Rows with equal fingerprints are linked and counted once from there on, whatever their number. A null doc_id is the
    largest; a component of such rows only has a null component_id. An empty table gives an empty one.
    """
    rows = fingerprints(docs, shingle)
    distinct = C.stored(rows.groupBy("fp").agg(F.min("d").alias("low")), "distinct-prints")
    parts = components(links(distinct, radius))
    named = C.stored(parts.join(distinct, parts["node"] == distinct["fp"]).select("node", "root", "low"), "parts")
    lows = named.groupBy("root").agg(F.min("low").alias("all_low"))
    of = named.join(lows, "root").select(F.col("node").alias("fp"), "all_low")
    ids = distinct.join(of, "fp", "left").select("fp", F.coalesce("all_low", "low").alias("low"))
    return rows.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.nullif(F.col("low"), F.lit(C.NO_ID)).alias("component_id"))


#: Words of a shingle and least similarity of near-duplicate texts; fingerprints of 64 bits each that are compared together; bands of
#: minima that a shard is keyed by, and minima in a band. Texts of similarity 0.8 share a band with probability 0.999.
LONG_SHINGLE, SIMILAR, PRINTS, BANDS, ROWS = 5, 0.8, 8, 10, 3
#: Nodes of a group that are a part (its results are the same at any value), and the set size from which SimHash's angle holds; smaller sets are all verified.
CELL_MOST, SMALL = 1024, 16
#: From so many nodes on an open shard is divided by the prefix filter, not into pairs of parts (both find every link in it).
PREFIX_FROM = 8 * CELL_MOST
#: Buckets in which shingles are counted for their order by frequency, and how many of the fullest the driver and all tasks hold; those of the others
#: are all as rare (any order is right, this one keeps groups small).
COUNTS, FULLEST = 1 << 20, 1 << 16


def wide_radius(similarity: float, bits: int) -> int:
    """Bits that differ between SimHashes of texts with this Jaccard similarity: the angle's share, and three standard deviations more."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * p + 3 * np.sqrt(bits * p * (1 - p)))


def shingle_sets(texts: list[bytes], shingle: int = LONG_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of all texts, ascending in each; cut[i]:cut[i + 1] are text i's."""
    w = T.Words([t.lower() for t in texts])
    size = np.diff(w.first)
    many = np.maximum(np.minimum(size, 1), size - shingle + 1)
    doc = np.repeat(np.arange(len(texts)), many)
    at = np.arange(len(doc)) - np.concatenate(([0], np.cumsum(many)))[doc] + w.first[doc]
    h = T.between(T.prefix(w.hash), at, np.minimum(at + shingle, w.first[doc + 1])) if len(doc) else np.zeros(0, dtype=np.uint64)
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[: len(h)]
    return h[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def sketch(texts: list[bytes], shingle: int = LONG_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's set of shingles: a hash, the size, PRINTS fingerprints of 64 bits, and keys of BANDS bands of least hashes."""
    h, first = shingle_sets(texts, shingle)
    many = np.diff(first)
    prints, bands, node = np.zeros((len(texts), PRINTS), dtype=np.uint64), np.zeros((len(texts), BANDS), dtype=np.uint64), np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(many)
    if len(some):
        cut = first[some]
        node[some] = T.mix(np.add.reduceat(T.mix(h), cut, dtype=np.uint64) + many[some].astype(np.uint64))
        for k in range(PRINTS):
            bits = np.unpackbits(T.mix(h + np.uint64(k + 1)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
            prints[some, k] = np.packbits(2 * ones > many[some][:, None], axis=1).view(">u8").ravel()
        for k in range(BANDS * ROWS):
            low = np.minimum.reduceat(T.mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 77) & (1 << 64) - 1)), cut)
            bands[some, k // ROWS] = T.mix(bands[some, k // ROWS] * np.uint64(3) + low + np.uint64(k // ROWS))
    return node, many, prints, bands


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets (node, hashes) have the Jaccard similarity or more."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("p"), batch.column("q")):
                a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both + 1e-9 >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    one, two = (sets.select(F.col("node").alias(n), F.col("hashes").alias(v)) for n, v in (("a", "p"), ("b", "q")))
    return C.stored(pairs.join(one, "a").join(two, "b").select("a", "b", "p", "q").mapInArrow(run, "a long, b long"), "similar")


def cell_links(members: list[tuple], similarity: float, radius: int) -> list[tuple[int, int]]:
    """Links (a, b) that join all members of a cell, (part, node, root, fingerprint, hashes), that similar texts connect; those of one root are joined already.

    Each member searches the BK-tree of those before it, and its candidates are held against its set, nearest first, unless joined by then.
    If the cell is of two parts, only pairs across them count.
    """
    tree, parts, out = BKTree(), Classes(), []
    first: dict[int, int] = {}
    across = members[0][0] != members[-1][0]
    for i, (part, node, root, print_, own) in enumerate(members):
        parts.up.append(i)
        parts.join(i, first.setdefault(root, i))
        for _, k in sorted(tree.near(print_, radius if len(own) >= SMALL / similarity else 64 * PRINTS)):
            other = members[k][4]
            if across and members[k][0] == part or min(len(own), len(other)) + 1e-9 < similarity * max(len(own), len(other)) or parts.root(k) == parts.root(i):
                continue
            both = len(np.intersect1d(own, other, assume_unique=True))
            if both + 1e-9 >= similarity * (len(own) + len(other) - both):
                parts.join(i, k)
                out.append((node, members[k][1]))
        tree.add(print_)
    return out


def prefix_groups(sets: DataFrame, similarity: float) -> DataFrame:
    """(token, n, node) of the groups of sets(node, root, hashes) that share a rare shingle and are not joined yet, stored.

    Prefix filter: with the shingles of every set in one order, two sets of the similarity share one of the first
    size - ceil(similarity * size) + 1. The order is by rising frequency, so that text which very many documents have in common stands last and
    groups nothing. Groups of one root are joined already, and of groups with the same members one is enough.
    """
    spark = sets.sparkSession

    def count(batches):
        total = np.zeros(COUNTS, dtype=np.int64)
        for batch in batches:
            for own in batch.column("hashes"):
                np.add.at(total, (np.frombuffer(own.as_buffer(), dtype=np.uint64) % np.uint64(COUNTS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counts = C.stored(sets.select("hashes").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("s")), "shingle-counts")
    fullest = frequent(counts, FULLEST)[0].toPandas()  # at most FULLEST rows
    shared = spark.sparkContext.broadcast((fullest["bucket"].to_numpy(np.int32), fullest["s"].to_numpy(np.int64)))

    def prefixes(batches):
        often = np.zeros(COUNTS, dtype=np.int64)
        often[shared.value[0]] = shared.value[1]
        for batch in batches:
            tokens, size = [np.zeros(0, dtype=np.uint64)], []
            for own in batch.column("hashes"):
                h = np.frombuffer(own.as_buffer(), dtype=np.uint64)
                n = often[(h % np.uint64(COUNTS)).astype(np.int64)]
                first = np.lexsort((h, n))[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]
                tokens.append(h[first])
                size.append(len(tokens[-1]))
            at = pa.array(np.repeat(np.arange(batch.num_rows), size))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), *(batch.column(c).take(at) for c in ("node", "root"))], ["token", "node", "root"])

    rows = C.stored(sets.mapInArrow(prefixes, "token long, node long, root long"), "prefixes")
    sign = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"sign{k}") for k in range(2)]
    groups = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("r"), F.max("root").alias("s"), *sign).where("r < s")
    once = C.stored(groups.groupBy("n", "sign0", "sign1").agg(F.min("token").alias("token")).select("token", "n"), "groups")
    return C.stored(rows.join(once, "token").select("token", "n", "node"), "members")


def links_in_groups(groups: DataFrame, sets: DataFrame, similarity: float, radius: int, most: int) -> DataFrame:
    """Links (a, b) that join the nodes of each group (token) as far as similar sets connect them; every pair of a group is covered, whatever its size.

    A group of over `most` nodes is cut into parts, and each part meets itself and every other in a cell of its own, so that no task gets a large
    group. Sets(node, root, fingerprints, hashes) go to the cells with their nodes, so no pair is written: a cell gives fewer links than it has nodes.
    """
    spark, fields = groups.sparkSession, [f"f{k}" for k in range(PRINTS)]

    def search(batches):
        at, held = None, []
        for batch in batches:
            cell = zip(*(batch.column(c).to_pylist() for c in ("token", "one", "two")))
            prints = np.stack([batch.column(f).to_numpy() for f in fields], axis=1)
            out = []
            for i, (c, part, node, root) in enumerate(zip(cell, *(batch.column(c).to_pylist() for c in ("part", "node", "root")))):
                if c != at:
                    out += cell_links(held, similarity, radius) if len(held) > 1 else []
                    at, held = c, []
                held.append((part, node, root, int.from_bytes(prints[i].tobytes(), "big"), np.frombuffer(batch.column("hashes")[i].as_py(), dtype=np.uint64)))
            yield links_batch(out)
        yield links_batch(cell_links(held, similarity, radius) if len(held) > 1 else [])

    parts = F.ceil(F.col("n") / most)
    own = groups.withColumn("part", F.pmod(F.xxhash64("node"), parts))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    cells = cells.select("token", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "node").join(sets, "node")
    return cells.repartition(C.partitions(spark), "token", "one", "two").sortWithinPartitions("token", "one", "two", "part", "node").mapInArrow(search, "a long, b long").distinct()


def links_batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def representatives(docs: DataFrame, shingle: int = LONG_SHINGLE, similarity: float = SIMILAR, tree_most: int = CELL_MOST, prefix_from: int = PREFIX_FROM) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest doc_id (nulls last, then by hash of the text).

    Texts are near-duplicates if their sets of word shingles (of 64-bit hashes) have the Jaccard similarity or more; every link is held against
    the sets. Candidates share a band of least shingle hashes and their 512 bits of SimHash are within `wide_radius`. First the members of
    a shard are held against its least; then the shards whose members are not joined by that are searched by BK-trees, in cells of at most about
    2 * `tree_most` nodes. Members of such shards of `prefix_from` nodes or more are grouped by the rare shingles they share before. Equal sets are one node. Texts without words are one group. All columns of docs stay.
    """
    spark, radius = docs.sparkSession, wide_radius(similarity, 64 * PRINTS)
    C.arrow_rows(spark)
    fields = [f"f{k}" for k in range(PRINTS)]

    def run(batches):
        for batch in batches:
            texts = C.pylist(batch, "text")
            for a, b in T.chunks(texts, 1 << 19):
                node, size, prints, bands = sketch(texts[a:b], shingle)
                yield pa.RecordBatch.from_pydict({"d": batch.column("d").slice(a, b - a), "x": batch.column("x").slice(a, b - a), "node": node.view(np.int64), "size": size.astype(np.int32)} | {f: prints[:, k].copy().view(np.int64) for k, f in enumerate(fields)} | {"bands": pa.array(bands.view(np.int64).tolist(), pa.list_(pa.int64()))})

    def sets_of(batches):
        for batch in batches:
            texts = C.pylist(batch, "text")
            for a, b in T.chunks(texts, 1 << 19):
                h, cut = shingle_sets(texts[a:b], shingle)
                yield pa.RecordBatch.from_pydict({"node": batch.column("node").slice(a, b - a), "hashes": pa.array([h[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())})

    keys = C.text_keys(docs).select("d", "x", "text")
    rows = keys.mapInArrow(run, "d long, x long, node long, size int, " + ", ".join(f"{f} long" for f in fields) + ", bands array<long>")
    rows = C.stored(rows, "sketches")
    nodes = C.stored(rows.groupBy("node").agg(F.min(F.struct("d", "x")).alias("low"), *[F.first(f).alias(f) for f in ("size", *fields, "bands")]), "nodes")
    keyed = nodes.select("node", "size", *fields, F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    shards = C.stored(keyed.join(sizes, ["band", "key"]), "bands")
    member = shards.select("node").distinct().join(nodes.select("node", "low.d", "low.x"), "node")
    sets = C.stored(keys.join(member, ["d", "x"]).select("node", "text").dropDuplicates(["node"]).mapInArrow(sets_of, "node long, hashes binary"), "sets")

    least = nodes.select(F.col("node").alias("least"), F.col("size").alias("size_"), *[F.col(f).alias(f"{f}_") for f in fields])
    apart = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"{f}_"))) for f in fields), F.lit(0))
    near = ((apart <= radius) | (F.least("size", "size_") < SMALL)) & (F.least("size", "size_") + 1e-9 >= similarity * F.greatest("size", "size_"))
    stars = shards.where(F.col("node") != F.col("least")).select("node", "size", "least", *fields).distinct().join(least, "least").where(near)
    links = similar(stars.groupBy("node").agg(F.min("least").alias("b")).select(F.col("node").alias("a"), "b"), sets, similarity)

    known = shards.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = known.groupBy("band", "key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("band", "key")
    left = C.stored(known.join(open_, ["band", "key"]).select(F.xxhash64("band", "key").alias("token"), "n", "node", "root", *fields), "open")
    own = left.select("node", "root", *fields).distinct().join(sets, "node")
    groups, large = left.where(F.col("n") < prefix_from).select("token", "n", "node"), left.where(F.col("n") >= prefix_from)
    if not large.isEmpty():
        groups = groups.unionByName(prefix_groups(large.select("node", "root").distinct().join(sets, "node"), similarity))
    more = C.stored(links_in_groups(groups, own, similarity, radius, tree_most), "more-links")
    roots = components(links.unionByName(more))
    named = nodes.select("node", "low").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "low")
    kept = C.stored(named.groupBy("root").agg(F.min("low").alias("low")).select("low.d", "low.x"), "kept")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NO_ID)).alias("d"), F.xxhash64("text").alias("x"))
    out = own.join(kept, ["d", "x"])
    if rows.count() > rows.select("d", "x").distinct().count():  # repeated rows
        out = out.dropDuplicates(["d", "x"])
    return out.select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir))
