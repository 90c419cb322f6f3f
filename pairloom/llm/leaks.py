"""Benchmark decontamination: CGK embeddings and bit-sampling LSH over item-sized windows, then exact edit distances.

The random walk of Chakraborty, Goldenberg and Koucky (2016) copies symbols (here words) of a string and moves on or not by a random function of
step and symbol; strings that differ by few edits get embeddings that agree at most steps, until the walks part. A key is what a walk has at
some sampled steps. Walks start at every word of a text and at every word of an item: after an edit the walks meet again at a later start, so
short walks from all starts reach what one long walk, which parts at the first of many edits, does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import common as C
from pairloom.llm import text as T

#: A document holds an item if a stretch of its words is within this part of the item's words in edits.
RATE = 0.2
#: Keys of each start, every one by a walk of its own: (least words of an item, steps of a walk, sampled steps, matches that make a stretch a
#: candidate). A walk ends within the item. Items of under 12 words have too few starts of long walks for several matches: two edits leave 10 words
#: three or more in a row, in which some walk of four steps nearly always stays.
REPEATS, CLASSES = 6, ((12, 8, 4, 3), (10, 4, 3, 1), (3, 3, 2, 1), (2, 2, 2, 1), (1, 1, 1, 1))
#: Items that are searched for at a time; all workers hold them.
BLOCK = 20_000
#: Matches that are looked at together.
SLICE = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normal(text: bytes) -> bytes:
    """Lower case, without ASCII punctuation."""
    return text.translate(_LOWER, _MARKS)


def edits(words: int) -> int:
    """The most edits that count as a leak of an item."""
    return int(RATE * words)


def closest(item: list[int], line: list[int]) -> tuple[int, int]:
    """The least edit distance of the item to any stretch of the line, and the first end of such a stretch (Myers 1999)."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, d = full, 0, m
    best, at = m, 0
    for j, w in enumerate(line):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        d += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        if d < best:
            best, at = d, j + 1
    return best, at


def embedded(line: np.ndarray, steps: int, sampled: int, seed: int, repeat: int) -> np.ndarray:
    """The LSH key of each place of the line (hashes of words): a hash of the words that the walk from there has at the sampled steps.

    A walk moves on at a step or stays, by a random bit for the step and the word's last byte. Past the end of the line it reads zeros.
    """
    rng = np.random.default_rng([seed, steps, repeat])
    bits = rng.integers(0, 2, (steps, 256), dtype=np.uint8)
    # the first step sees the start; of the others the sample is random
    at = np.sort(np.concatenate(([0], 1 + rng.permutation(steps - 1)[: sampled - 1])))
    padded = np.concatenate((line, np.zeros(steps, dtype=np.uint64)))
    low = (padded & np.uint64(255)).astype(np.uint8)
    here, out = np.arange(len(line)), np.full(len(line), steps * 64 + repeat, dtype=np.uint64)
    for j in range(int(at[-1]) + 1):
        if j in at:
            out *= np.uint64(T.BASE)
            out += padded[here]
        here += bits[j][low[here]]
    return T.mix(out)


class Filter:
    """Which of many 64-bit keys may be among the given ones: all that are, and few others."""

    def __init__(self, keys: np.ndarray):
        bits = min(26, max(10, int(16 * len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.some = np.zeros(1 << bits, dtype=bool)
        self.some[(keys >> self.shift).astype(np.int64)] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return self.some[(keys >> self.shift).astype(np.int64)]


class Items:
    """The items of a block: their words, and for each class and repeat the keys of all their starts, in order, with item and place."""

    def __init__(self, rows: list[tuple[int, bytes]], seed: int):
        w = T.Words([normal(t) for _, t in rows])
        words = [w.hash[i:j] for i, j in zip(w.first[:-1], w.first[1:])]
        own = [k for k, x in enumerate(words) if len(x)]
        self.ids, self.words, self.seed = [rows[k][0] for k in own], [words[k] for k in own], seed
        self.size = np.array([len(x) for x in self.words], dtype=np.int64)
        self.most = np.array([edits(n) for n in self.size.tolist()], dtype=np.int64)
        line = np.concatenate(self.words) if own else np.zeros(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(own)), self.size)
        place = np.arange(len(line)) - (np.cumsum(self.size) - self.size)[item] if own else item
        kind = [next(c for c in CLASSES if c[0] <= n) for n in self.size.tolist()]
        least, self.matches = (np.array([c[k] for c in kind], dtype=np.int64) for k in (0, 3))
        self.tables = []
        for few, steps, sampled, _ in CLASSES:
            at = np.flatnonzero((least[item] == few) & (self.size[item] - place >= steps)) if own else item
            for r in range(REPEATS if len(at) else 0):
                k = embedded(line, steps, sampled, seed, r)[at]
                o = np.argsort(k, kind="stable")
                self.tables.append((steps, sampled, r, Filter(k), k[o], item[at][o], place[at][o]))
        self.has = Filter(T.mix(line ^ T.mix(item.astype(np.uint64))))


def distinct(cols: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct rows of columns of numbers of 0 or more, ascending: sorted as one integer where the columns' widths fit into 63 bits, else column by column."""
    if not len(cols[0]):
        return cols
    bits = [max(1, int(c.max()).bit_length()) for c in cols]
    if sum(bits) <= 63:
        x = np.zeros(len(cols[0]), dtype=np.int64)
        for c, n in zip(cols, bits):
            x = x << n | c
        x.sort()
        x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        out = []
        for n in bits[::-1]:
            out.append(x & ((1 << n) - 1))
            x = x >> n
        return out[::-1]
    o = np.lexsort(cols[::-1])
    cols = [c[o] for c in cols]
    new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols], axis=0)))
    return [c[new] for c in cols]


def matches(line: np.ndarray, items: Items):
    """(place of the text's word, item, place of the item's word, repeat) of matching keys, in slices."""
    for steps, sampled, r, some, keys, item, place in items.tables:
        k = embedded(line, steps, sampled, items.seed, r)
        at = np.flatnonzero(some(k))
        a, b = np.searchsorted(keys, k[at], side="left"), np.searchsorted(keys, k[at], side="right")
        at, a, many = at[b > a], a[b > a], (b - a)[b > a]
        total = np.cumsum(many)
        cut = [0, *(np.flatnonzero(np.diff(total // SLICE)) + 1).tolist(), len(at)]
        for i, j in zip(cut, cut[1:]):
            if i < j:
                m = many[i:j]
                e = np.repeat(a[i:j], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                yield np.repeat(at[i:j], m), item[e], place[e], np.full(len(e), r)


def candidates(w: T.Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, from, to) of the stretches that may hold an item: tiles of where it may start, which overlap by half, and its length and edits after.

    A tile counts if as many starts of the item, or walks from them, match in it as its class asks for: a leak has many, as each
    run of words between two edits gives its own, and chance has few.
    """
    found = []
    for at, item, place, r in matches(w.hash, items):
        half = items.size[item] // 4 + 1
        doc = w.doc[at]
        tile = (at - place - w.first[doc] + items.size[item]) // half  # of half the width
        both = np.concatenate((tile, tile + 1))
        found.append(distinct([np.tile(doc, 2), np.tile(item, 2), both, np.tile(place * REPEATS + r, 2)]))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 4
    doc, item, tile, _ = distinct([np.concatenate(c) for c in zip(*found)])
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (tile[1:] != tile[:-1]))))
    many = np.diff(np.concatenate((new, [len(doc)])))
    new = new[many >= items.matches[item[new]]]
    doc, item, tile = doc[new], item[new], tile[new]
    size, most = items.size[item], items.most[item]
    half = size // 4 + 1
    low = w.first[doc] + (tile - 1) * half - size
    return doc, item, np.maximum(w.first[doc], low - most), np.minimum(w.first[doc + 1], low + 2 * half + size + most)


def search(texts: list[bytes], items: Items) -> list[tuple[int, int, int, int]]:
    """(text, item, edit distance, words from where the stretch ends) of each leak of an item in a text: the least distance, the first such end."""
    w = T.Words([normal(t) for t in texts])
    if not len(w) or not len(items.size):
        return []
    line, found = w.hash, {}
    every = candidates(w, items)
    for c in range(0, len(every[0]), 4096):
        doc, item, low, high = (x[c : c + 4096] for x in every)
        # within the distance all words but so many of the item are in the stretch
        ahead = np.arange(int((high - low).max()))
        col = np.minimum(low[:, None] + ahead, len(line) - 1)
        there = items.has(T.mix(line[col] ^ T.mix(item.astype(np.uint64))[:, None])) & (ahead < (high - low)[:, None])
        for i in np.flatnonzero(there.sum(1) >= items.size[item] - items.most[item]).tolist():
            d, k, lo = int(doc[i]), int(item[i]), int(low[i])
            if found.get((d, k), (1, 0))[0] == 0:
                continue
            best, at = closest(items.words[k].tolist(), line[lo : int(high[i])].tolist())
            if best <= items.most[k]:
                found[d, k] = min(found.get((d, k), (1 << 60, 0)), (best, lo + at - int(w.first[d])))
    return [(d, k, *v) for (d, k), v in found.items()]


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """(doc_id, item_id, distance, item_words, stop): a row for each document row and item that it holds, whole texts searched.

    Words are compared in lower case without punctuation. Windows of the item's size that share an LSH key with it, from any start, are candidates;
    the edit distance to the best stretch around the window decides: at most RATE of the item's words, so items of one to four words are found
    whole only. Of stretches with equal distances the first counts. Items are searched for in blocks of a bounded number. Null texts
    hold nothing, items without words are not searched for. An empty table or benchmark gives no rows. Repeated rows give repeated rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    C.arrow_rows(spark)
    schema = "doc_id long, item_id long, distance int, item_words int, stop int"
    texts, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for items in item_blocks(benchmark, block, seed):

        def run(batches, items=items):
            own = items.value
            for batch in batches:
                texts = C.pylist(batch, "text")
                ids = batch.column("doc_id").to_pylist()
                got = [(ids[a + d], own.ids[k], dist, int(own.size[k]), stop) for a, b in T.chunks(texts) for d, k, dist, stop in search(texts[a:b], own)]
                cols = list(zip(*got)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "distance", "item_words", "stop"])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def item_blocks(benchmark: DataFrame, block: int, seed: int):
    """Broadcast Items of at most `block` items each, in ascending order of item_id and text."""
    spark, last = benchmark.sparkSession, None
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text", F.coalesce(F.col("item_id").cast("long"), F.lit(C.NO_ID)).alias("k"), F.xxhash64("text").alias("x"))
    while True:
        more = rows if last is None else rows.where((F.col("k") > last[0]) | ((F.col("k") == last[0]) & (F.col("x") > last[1])))
        got = more.dropDuplicates(["k", "x"]).orderBy("k", "x").limit(block).collect()
        if got:
            yield spark.sparkContext.broadcast(Items([(r["item_id"], r["text"].encode()) for r in got], seed))
        if len(got) < block:
            return
        last = (got[-1]["k"], got[-1]["x"])


def clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """The rows of docs that hold no item, with all their columns, whatever their names. Repeated rows stay as often as they are; null texts stay."""
    C.arrow_rows(docs.sparkSession)
    out = docs
    for items in item_blocks(benchmark, block, seed):

        def run(batches, items=items):
            for batch in batches:
                texts = C.pylist(batch, "text")
                bad = {a + hit[0] for a, b in T.chunks(texts) for hit in search(texts[a:b], items.value)}
                yield batch.filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
