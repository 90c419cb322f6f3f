"""Repeated passages: which windows of a fixed length occur elsewhere, found over all texts without comparing pairs.

Every window of `target` symbols has an anchor, the k-gram in it with the least hash, so equal windows have equal anchors at
equal places. A document gives an item for each of its anchors: the windows with this anchor begin `hi` to `lo` symbols
before it; together they make the item's context. Equal contexts (by a 128-bit hash) are one from there on, with their number; windows of
a context that occurs twice are repeated by that number. Contexts that occur once, at an anchor that has others, are left:

* suffix-array dedup sorts their suffixes, by shards of anchors, by induced sorting. Before that, contexts are trimmed to what they
  have in common with any other of their anchor, and the gram, which these share, is written in two symbols. The contexts of an anchor
  with more than a task should hold are keyed anew by parts of their range, whose windows share more than the gram;
* substring dedup extends windows level by level: of windows repeated at one length alone, those of twice that length
  are counted, up to the target, until no candidates survive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import common as C
from pairloom.llm import text as T
from pairloom.llm.suffix import repeated_starts

#: Fixed values of the two contracts: bytes and words of a window. Grams are as long as windows stay distinctive and texts are not.
BYTES, BYTE_GRAM = 400, 160
WORDS, WORD_GRAM = 50, 16
#: Places of one text whose windows are taken at a time.
PIECE = 1 << 20
#: A shard of contexts has about so many bytes; an anchor with over SHARD_MOST contexts is divided (results are the same at any value).
SHARD_BYTES, SHARD_MOST = 1 << 21, 2048
#: Symbols that write which gram it is, after the 256 of bytes: two digits in base DIGIT.
DIGIT = 128
ITEM = "d long, x long, p long, h long, c binary"
SPAN = "d long, x long, start long, stop long"


def pack(pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (pos << 20) | (lo << 10) | hi


def unpack(p):
    return p >> 20, (p >> 10) & 1023, p & 1023


def anchors(sym: np.ndarray, first: np.ndarray, skip: np.ndarray, heads: np.ndarray, target: int, gram: int):
    """Items of the pieces laid end to end in sym: piece, p, gram hash, and where the context lies in sym (from, to).

    first: bounds of the pieces in sym; skip: place of a piece's first symbol in its text; heads: (from, to) of the starts of
    windows, in the text, that belong to the piece. Each window belongs to one item.
    """
    n = len(sym)
    if n < target:
        return [np.zeros(0, dtype=np.int64)] * 5
    sums = T.prefix(sym)
    j = np.arange(n - gram + 1)
    h = T.between(sums, j, j + gram)
    low = T.argmins(h, target - gram + 1)
    edge = np.zeros(n + 1, dtype=np.int32)
    a, b = first[:-1] + heads[:, 0] - skip, first[:-1] + heads[:, 1] - skip
    some = b > a
    np.add.at(edge, a[some], 1)
    np.add.at(edge, b[some], -1)
    window = np.flatnonzero(np.cumsum(edge)[: len(low)] > 0)
    low = low[window]
    if not len(low):
        return [low] * 5
    new = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    at, begin, end = low[new], window[new], window[np.concatenate((new[1:], [len(low)])) - 1]
    piece = np.searchsorted(first, at, side="right") - 1
    lo, hi = at - end, at - begin
    return piece, pack(at - first[piece] + skip[piece], lo, hi), h[at], begin, end + target


def digests(line: bytes, a: np.ndarray, b: np.ndarray, seed: np.ndarray) -> list[bytes]:
    """128-bit hashes of line[a:b], for many ranges."""
    h = xxhash.xxh3_128_digest
    return [h(line[i:j], k) for i, j, k in zip(a.tolist(), b.tolist(), seed.tolist())]


def pieces(sizes: list[int], target: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, from, to, first window, last window + 1): texts in slices that hold every context of their windows."""
    for i, n in enumerate(sizes):
        for w in range(0, n - target + 1, PIECE):
            stop = min(w + PIECE, n - target + 1)
            yield i, max(0, w - target), min(n, stop + 2 * target), w, stop


def items_of(docs: DataFrame, unit: str, target: int, gram: int) -> DataFrame:
    """The items of all texts: (d, x) of the document, p (place of the anchor and range of windows), h and c."""

    def run(batches):
        for batch in batches:
            d, x = batch.column("d").to_numpy(), batch.column("x").to_numpy()
            texts = C.pylist(batch, "text")
            keep = [i for i, t in enumerate(texts) if len(t) >= (target if unit == "bytes" else 2 * target - 1)]
            for a, b in T.chunks([texts[i] for i in keep], 1 << 19):
                ids = keep[a:b]
                if unit == "bytes":
                    parts = [np.frombuffer(texts[i], dtype=np.uint8) for i in ids]
                    sizes = [len(s) for s in parts]
                else:
                    w = T.Words([texts[i] for i in ids])
                    sizes = np.diff(w.first).tolist()
                    parts = [w.hash[w.first[k] : w.first[k + 1]] for k in range(len(ids))]
                cut = list(pieces(sizes, target))
                if not cut:
                    continue
                sym = np.concatenate([parts[i][s:e] for i, s, e, _, _ in cut])
                line, size = sym.tobytes(), sym.itemsize
                q = np.array(cut, dtype=np.int64)
                first = np.concatenate(([0], np.cumsum(q[:, 2] - q[:, 1])))
                piece, p, h, begin, end = anchors(sym.astype(np.uint64) + np.uint64(1), first, q[:, 1], q[:, 3:5], target, gram)
                own = np.array(ids)[q[piece, 0]]
                c = digests(line, size * begin, size * end, p & ((1 << 20) - 1))
                yield pa.RecordBatch.from_pydict({"d": d[own], "x": x[own], "p": p, "h": h.view(np.int64), "c": pa.array(c, pa.binary())})

    return docs.select("d", "x", "text").mapInArrow(run, ITEM)


def settle(items: DataFrame, rule: str, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Spans that are settled as repeated, and the items that are left, with n (contexts of their h).

    rule 'any': a window is repeated if it occurs twice anywhere; 'smaller': if it occurs in a document with a smaller d.
    Contexts (h, c) are counted with partial sums; then a context counts once for its h. A shared context is settled but for
    one representative (or those of the smallest d), which stays as long as its h has other contexts that it can settle.
    """
    tag = F.xxhash64("d", "x", "p")
    groups = items.groupBy("h", "c").agg(F.count("*").alias("k"), F.min("d" if rule == "smaller" else tag).alias("m"))
    if not last:
        open_ = (F.count("*") > 1) & (F.min("k") == 1) if rule == "any" else F.min("m") < F.max("m")
        groups = C.stored(groups, "contexts-counted")  # so that Spark may divide an anchor with many contexts in the join
        several = C.stored(groups.groupBy("h").agg(F.count("*").alias("n"), open_.alias("open")).where("open").drop("open"), "anchors")
        groups = groups.join(several, "h", "left")
    groups = groups.where("k > 1" if last else "k > 1 OR n IS NOT NULL")
    met = C.stored(items.join(groups, ["h", "c"]), "met")
    pos, hi, lo = F.shiftright("p", 20), F.col("p").bitwiseAND(1023), F.shiftright("p", 10).bitwiseAND(1023)
    spans = met.where("k > 1" if rule == "any" else "d > m").select("d", "x", (pos - hi).alias("start"), (pos - lo).alias("stop"))
    if last:
        return spans, None
    left = met.where("n IS NOT NULL").where(F.col("d") == F.col("m") if rule == "smaller" else (F.col("k") == 1) | (tag == F.col("m")))
    return spans, left.drop("c", "k", "m")


def contexts_of(docs: DataFrame, left: DataFrame, unit: str, target: int) -> DataFrame:
    """The items left, each with its context: bytes, or the hashes of words as bytes.

    Repeated rows of one key give an item twice; such an item is settled already, so that counts no window anew.
    """
    by_doc = left.groupBy("d", "x").agg(F.collect_list(F.struct("p", "h", "n")).alias("own"))

    def run(batches):
        for batch in batches:
            out, size = {k: [] for k in ("d", "x", "p", "h", "n", "ctx")}, 0
            for d, x, t, own in zip(batch.column("d").to_pylist(), batch.column("x").to_pylist(), C.pylist(batch, "text"), batch.column("own").to_pylist()):
                line = T.Words([t]).hash if unit == "words" else None
                for r in sorted(own, key=lambda r: r["p"]):
                    pos, lo, hi = unpack(r["p"])
                    ctx = t[pos - hi : pos - lo + target] if unit == "bytes" else line[pos - hi : pos - lo + target].tobytes()
                    size += len(ctx)
                    for k, v in zip(out, (d, x, r["p"], r["h"], r["n"], ctx)):
                        out[k].append(v)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pydict(out)
                    out, size = {k: [] for k in out}, 0
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.binary() if k == "ctx" else pa.int64()) for k in out]))

    return docs.select("d", "x", "text").join(by_doc, ["d", "x"]).mapInArrow(run, "d long, x long, p long, h long, n long, ctx binary")


def lengths(gram: int, target: int) -> list[int]:
    """The lengths of the levels above the gram, each twice the one before, and the target."""
    out = [gram]
    while out[-1] < target:
        out.append(min(2 * out[-1], target))
    return out[1:]


def extend(items: DataFrame, unit: str, target: int, gram: int, length: int) -> DataFrame:
    """Items over the windows of `length` symbols that lie in all target windows of a part of an item's range, with the part's context.

    h becomes the hash of that window, c that of the part's context. The parts are the same for all items, else equal windows
    of two items could fall in different ones: r windows in turn have a common core of target - r + 1 symbols.
    """
    whole = target - gram + 1
    parts = -(-whole // (target - length + 1))
    edge = whole * np.arange(parts + 1) // parts

    def run(batches):
        step = 1 if unit == "bytes" else 8
        for batch in batches:
            d, x, p = (batch.column(k).to_numpy() for k in ("d", "x", "p"))
            raw = batch.column("ctx").to_pylist()
            line = b"".join(raw)
            sym = (np.frombuffer(line, dtype=np.uint8).astype(np.uint64) if unit == "bytes" else np.frombuffer(line, dtype=np.uint64)) + np.uint64(1)
            off = np.concatenate(([0], np.cumsum([len(r) for r in raw])))[:-1] // step
            pos, lo, hi = unpack(p)
            i, k = np.nonzero((edge[:-1] <= hi[:, None]) & (edge[1:] > lo[:, None]))
            low, high, top = edge[k], edge[k + 1] - 1, (off + hi)[i]
            a, b = np.maximum(lo[i], low), np.minimum(hi[i], high)  # windows that begin b to a symbols before pos
            h = T.mix(T.between(T.prefix(sym), top - low, top - high + target) + low.astype(np.uint64))
            u, v = step * (top - b), step * (top - a + target)
            c, ctx = digests(line, u, v, (a << 10) | b), [line[m:n] for m, n in zip(u.tolist(), v.tolist())]
            yield pa.RecordBatch.from_pydict({"d": d[i], "x": x[i], "p": pack(pos[i], a, b), "h": h.view(np.int64), "c": pa.array(c, pa.binary()), "ctx": pa.array(ctx, pa.binary())})

    return items.select("d", "x", "p", "ctx").mapInArrow(run, ITEM + ", ctx binary")


def by_levels(items: DataFrame, target: int, gram: int) -> list[DataFrame]:
    """Starts of the windows (words) that occur in a smaller document, extending by levels until no candidates survive."""
    found = []
    for length in lengths(gram, target):
        if items.isEmpty():
            break
        level = extend(items, "words", target, gram, length)
        if length == target:
            level = level.drop("ctx")  # nothing extends them further
        spans, items = settle(C.stored(level, f"level-{length}"), "smaller", last=length == target)
        found.append(spans)
    return found


def by_suffixes(items: DataFrame, target: int, gram: int, shard_bytes: int, shard_most: int) -> tuple[list[DataFrame], DataFrame]:
    """Starts of the windows that whole contexts share, and spans of the windows (bytes) that sorting suffixes shows as repeated.

    Anchors with over `shard_most` contexts are divided: windows of a part of the range share a core that is longer than the gram, so that core
    is their anchor from there on; its length closes most of the gap to the target each time, until no anchor is too large.
    """
    whole, sorts, length = [], [], gram
    while True:
        sorts.append(sort_shards(items.where(F.col("n") <= shard_most), target, gram, shard_bytes))
        items = items.where(F.col("n") > shard_most)
        if length == target or items.isEmpty():
            return whole, reduce(DataFrame.unionByName, sorts)
        length = min(2 * length, target - (target - length) // 4)
        spans, items = settle(C.stored(extend(items, "bytes", target, gram, length), f"core-{length}"), "any", last=length == target)
        whole.append(spans)
        if items is None:
            return whole, reduce(DataFrame.unionByName, sorts)


def common(a: bytes, b: bytes) -> int:
    """Bytes that two strings have in common at their beginning."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def shared_heads(parts: list[bytes]) -> list[int]:
    """For each string, the most bytes at its beginning that another one has too: its neighbours in order have them."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        n = common(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def trimmed(rows: list[tuple], target: int, gram: int) -> list[tuple]:
    """Stretches (d, x, start of the gram, bytes before it, number of the gram, bytes after it, lo, hi) of the contexts (h, d, x, p, ctx) of a shard.

    Of a context only those bytes stay, around the gram, that another context of its anchor has in the same place; a context that has less
    than a window in common with the others has no repeated window.
    """
    groups: dict[bytes, list] = {}
    for _, d, x, p, ctx in rows:
        pos, lo, hi = unpack(p)
        groups.setdefault(ctx[hi : hi + gram], []).append((d, x, pos, lo, hi, ctx))
    out = []
    for k, own in enumerate(groups.values()):
        if len(own) == 1:
            continue
        left = shared_heads([c[:hi][::-1] for *_, hi, c in own])
        right = shared_heads([c[hi + gram :] for *_, hi, c in own])
        for (d, x, pos, lo, hi, c), a, b in zip(own, left, right):
            low, high = max(lo, target - gram - b), min(hi, a)
            if low <= high:
                out.append((d, x, pos, c[hi - high : hi], k, c[hi + gram : hi + target - low], low, high))
    return out


def sort_shards(items: DataFrame, target: int, gram: int, shard_bytes: int) -> DataFrame:
    """Spans of repeated windows in the contexts (bytes), sorting the suffixes of each shard of anchors."""
    total = items.agg(F.sum(F.octet_length("ctx"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    dealt = items.select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "h", "d", "x", "p", "ctx")
    dealt = dealt.repartition(max(1, min(C.partitions(items.sparkSession), shards)), "shard").sortWithinPartitions("shard", "h", "d", "x", "p")

    def solve(rows):
        parts = trimmed(rows, target, gram)
        if not parts:
            return
        size = np.array([len(a) + 2 + len(b) for _, _, _, a, _, b, _, _ in parts])
        first = np.cumsum(size + 1) - size - 1
        t = np.frombuffer(b"\0".join(a + b"\0\0" + b for _, _, _, a, _, b, _, _ in parts), dtype=np.uint8).astype(np.int64) + 1
        at, k = first + np.array([len(p[3]) for p in parts]), np.array([p[4] for p in parts])
        digits = 1
        while DIGIT**digits <= k.max():
            digits += 1
        if digits > 2:  # more grams than two digits tell apart
            t = np.insert(t, np.repeat(at, digits - 2), 0)
            at = at + (digits - 2) * np.arange(len(at))
            first = first + (digits - 2) * np.arange(len(at))
            size = size + digits - 2
        digits = max(2, digits)
        for i in range(digits):
            t[at + i] = 257 + k // DIGIT**i % DIGIT
        t[(first + size)[:-1]] = 0  # ends of stretches
        hit = repeated_starts(t, target - gram + digits)
        for (d, x, pos, a, _, _, low, high), f in zip(parts, first.tolist()):
            n = np.flatnonzero(hit[f : f + high - low + 1]) + pos - len(a)
            for s, e in zip(*T.runs(n, n + target)):
                yield d, x, int(s), int(e)

    def run(batches):
        shard, rows = None, []
        for batch in batches:
            out = []
            for s, *row in zip(*(batch.column(k).to_pylist() for k in ("shard", "h", "d", "x", "p", "ctx"))):
                if s != shard:
                    out += solve(rows) if rows else []
                    shard, rows = s, []
                rows.append(row)
            yield spans_batch(out)
        yield spans_batch(list(solve(rows)) if rows else [])

    return dealt.mapInArrow(run, SPAN)


def spans_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else ([], [], [], [])
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(("d", "x", "start", "stop"), cols)})


def spans_of(docs: DataFrame, method: str, target: int | None = None, gram: int | None = None, shard_bytes: int = SHARD_BYTES, shard_most: int = SHARD_MOST) -> DataFrame:
    """(d, x, start, stop): the stretches of documents that repeated windows cover; they may overlap.

    method 'suffix': windows of bytes that start anywhere else; 'levels': windows of words that start in a document with smaller d.
    """
    unit, rule, length, k = ("bytes", "any", BYTES, BYTE_GRAM) if method == "suffix" else ("words", "smaller", WORDS, WORD_GRAM)
    target, gram = target or length, gram or k
    if not gram < target < 1024:
        raise ValueError("gram < target < 1024 is needed")
    C.arrow_rows(docs.sparkSession)
    spans, left = settle(C.stored(items_of(docs, unit, target, gram), "items"), rule)
    context = C.stored(contexts_of(docs, left, unit, target), "contexts")
    more, sorted_ = by_suffixes(context, target, gram, shard_bytes, shard_most) if method == "suffix" else (by_levels(context, target, gram), None)
    starts = [s.select("d", "x", "start", (F.col("stop") + target).alias("stop")) for s in [spans, *more]]
    return reduce(DataFrame.unionByName, starts + ([sorted_] if sorted_ is not None else []))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with cuts: per row the stretches, start and stop in turn. A row has at most as many as it has places."""
    by_doc = spans.groupBy("d", "x").agg(F.flatten(F.collect_set(F.array("start", "stop"))).alias("cuts"))
    return docs.join(by_doc, ["d", "x"], "left")


def cut(docs: DataFrame, spans: DataFrame, unit: str) -> DataFrame:
    """Per row of docs: doc_id, size (bytes or words), n_removed, n_spans, kept (what is left, as binary) and its sha256."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("size", "n_removed", "n_spans", "kept", "kept_sha256")}
            for t, cuts in zip(C.pylist(batch, "text"), batch.column("cuts").to_pylist()):
                unit_of = t.split() if unit == "words" else None
                n = len(t) if unit == "bytes" else len(unit_of)
                removed = n_spans = 0
                if cuts:
                    q = np.array(cuts, dtype=np.int64).reshape(-1, 2)
                    a, b = T.runs(q[:, 0], q[:, 1])
                    kept, at = [], 0
                    for s, e in zip(a.tolist(), b.tolist()):
                        kept.append(t[at:s] if unit == "bytes" else b" ".join(unit_of[at:s]))
                        at = e
                    kept.append(t[at:] if unit == "bytes" else b" ".join(unit_of[at:]))
                    removed, n_spans = int((b - a).sum()), len(a)
                    kept = (b"" if unit == "bytes" else b" ").join(k for k in kept if k)
                else:
                    kept = t if unit == "bytes" else b" ".join(unit_of)
                for k, v in zip(out, (n, removed, n_spans, kept, hashlib.sha256(kept).hexdigest())):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | out)

    return with_spans(docs, spans).select("doc_id", "text", "cuts").mapInArrow(run, "doc_id long, size long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def dedup_bytes(docs: DataFrame, **options) -> DataFrame:
    """Suffix-array dedup: each byte goes that a `target`-byte string covers which starts anywhere else, in any text or this one.

    Null is an empty text. Rows of equal doc_id and text are texts of their own, so each is the other's copy. Texts that are
    shorter than a window lose nothing. Other columns are ignored.
    """
    keyed = C.text_keys(docs)
    return cut(keyed, spans_of(keyed, "suffix", **options), "bytes")


def dedup_words(docs: DataFrame, **options) -> DataFrame:
    """Substring dedup by level-wise doubling: each word goes that a `target`-word window covers which starts in a document with smaller doc_id.

    Null is an empty text; a null doc_id is larger than all. Rows of one doc_id do not take from each other.
    """
    keyed = C.text_keys(docs)
    return cut(keyed, spans_of(keyed, "levels", **options), "words")


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(C.documents(spark, sf_dir)).select("doc_id", F.col("size").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(C.documents(spark, sf_dir)).select("doc_id", F.col("size").alias("n_words"), "n_removed", "kept_sha256")


OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
b AS (SELECT rid, unnest(range(1, length(hx) // 2 + 1)) AS i, unnest(list_transform(range(1, length(hx) // 2 + 1), lambda i: substr(hx, 2 * i - 1, 2))) AS byte FROM d),
w AS (SELECT rid, unnest(range(1, length(hx) // 2 - 398)) AS i, unnest(list_transform(range(1, length(hx) // 2 - 398), lambda i: md5_number(substr(hx, 2 * i - 1, 800)))) AS k FROM d WHERE length(hx) >= 800),
s AS (SELECT rid, i, i AS hit FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
c AS (SELECT b.rid, b.i, b.byte, max(s.hit) OVER (PARTITION BY b.rid ORDER BY b.i ROWS UNBOUNDED PRECEDING) AS hit FROM b LEFT JOIN s ON s.rid = b.rid AND s.i = b.i),
r AS (SELECT *, coalesce(i - hit < 400, false) AS gone FROM c),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), false) AS opens FROM r),
a AS (SELECT rid, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY rid)
SELECT d.doc_id, CAST(length(hx) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a USING (rid)
"""

OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT rid, doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5_number(array_to_string(w[i:i + 49], ' ')))) AS k FROM d WHERE len(w) >= 50),
s AS (SELECT rid, i, i AS hit FROM k JOIN (SELECT k, min(coalesce(doc_id, 9223372036854775807)) AS low FROM k GROUP BY k HAVING count(*) > 1) USING (k) WHERE low < coalesce(doc_id, 9223372036854775807)),
c AS (SELECT b.rid, b.i, b.word, max(s.hit) OVER (PARTITION BY b.rid ORDER BY b.i ROWS UNBOUNDED PRECEDING) AS hit FROM b LEFT JOIN s ON s.rid = b.rid AND s.i = b.i),
r AS (SELECT *, coalesce(i - hit < 50, false) AS gone FROM c),
a AS (SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(encode(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (rid)
"""
