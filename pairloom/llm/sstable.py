"""Token ids in sorted-string-table shards: prefix-compressed blocks, a sparse block index, a Bloom filter and a footer.

A file is: magic; blocks; index; filter; footer. Keys are 13 bytes: 0 or 1 (no identifier), the identifier with its sign bit
flipped as big-endian, and its count among equal identifiers, so that byte order is row order. An entry of a block is: shared
and own bytes of the key, bytes of the value (varints), own key bytes, value (ids as little-endian integers of the width that
the footer names). A block holds whole entries of about BLOCK_BYTES, is compressed by zstandard and ends with its crc32. The
index has, for each block, its first key, place, length, and the ids before it in the file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.llm import common as C
from pairloom.llm import text as T

MAGIC = b"PLSST001"
FOOTER = struct.Struct("<QQQQQQBB8s")
INDEX = struct.Struct("<13sQIQ")
KEY = struct.Struct(">BQI")
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 32 << 20
BITS_PER_KEY, HASHES = 10, 7
#: Fixed value: the id that ends each document.
END = 0
#: Pieces of text whose ids a worker remembers.
CACHE = 3_000_000


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None, count: int = 0) -> bytes:
    return KEY.pack(doc_id is None, 0 if doc_id is None else doc_id + (1 << 63), count)


def id_of(key: bytes) -> int | None:
    none, doc, _ = KEY.unpack(key)
    return None if none else doc - (1 << 63)


def bloom_bits(key: bytes, bits: int) -> list[int]:
    """Places in the filter of an identifier (the key without its count)."""
    h = xxhash.xxh3_128_intdigest(key[:9])
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class Writer:
    """Takes entries in ascending order of keys and writes one file."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.zip = zstandard.ZstdCompressor(level=1)
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.block, self.first, self.last, self.ids, self.before = bytearray(), b"", b"", 0, 0
        self.at = out.write(MAGIC) or len(MAGIC)

    def add(self, key: bytes, value: bytes) -> None:
        if not self.block:
            self.first, self.last, self.before = key, b"", self.ids
        k = 0
        while k < len(self.last) and self.last[k] == key[k]:
            k += 1
        self.block += varint(k) + varint(len(key) - k) + varint(len(value)) + key[k:] + value
        self.last, self.ids = key, self.ids + len(value) // self.width
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.index.append(INDEX.pack(self.first, self.at, len(data), self.before))
            self.out.write(data)
            self.at, self.block = self.at + len(data), bytearray()

    def finish(self) -> None:
        self.flush()
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = np.zeros(bits, dtype=bool)
        for key in self.keys:
            bloom[bloom_bits(key, bits)] = True
        index, packed = b"".join(self.index), np.packbits(bloom).tobytes()
        self.out.write(index + packed + FOOTER.pack(self.at, len(self.index), self.at + len(index), bits, len(self.keys), self.ids, self.width, HASHES, MAGIC))
        self.out.close()


class Reader:
    """Reads one file: in order, or one identifier by filter, index and block."""

    def __init__(self, path: str):
        fs, name = C.filesystem(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        self.index_at, blocks, self.bloom_at, self.bits, self.entries, self.ids, self.width, _, magic = FOOTER.unpack(self.get(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or self.get(0, 8) != MAGIC:
            raise ValueError(f"{path} is no such table")
        self.index = list(INDEX.iter_unpack(self.get(self.index_at, blocks * INDEX.size)))

    def get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int):
        """(key, value, ids before it in the file) of a block's entries."""
        _, at, n, before = self.index[k]
        raw = self.get(at, n)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block does not match its checksum")
        data, at, key = zstandard.ZstdDecompressor().decompress(raw[:-4]), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            value = data[at + own : at + own + n]
            at += own + n
            yield key, value, before
            before += n // self.width

    def __iter__(self):
        for k in range(len(self.index)):
            yield from self.block(k)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row with the identifier, by binary search."""
        key = key_of(doc_id)
        bloom = self.get(self.bloom_at, -(-self.bits // 8))
        if not all(bloom[b >> 3] >> (7 - (b & 7)) & 1 for b in bloom_bits(key, self.bits)):
            return []
        out, k = [], max(0, bisect_right([x[0] for x in self.index], key) - 1)
        while k < len(self.index) and self.index[k][0][:9] <= key[:9]:
            out += [np.frombuffer(v, dtype=f"<u{self.width}") for found, v, _ in self.block(k) if found[:9] == key[:9]]
            k += 1
        return out


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The library's byte-level pattern never joins a word to what is before the space or line end in front of it, unless white
    space stands together, nor a letter or digit to a full stop or comma that ends its word; so the pieces of a text are encoded on
    their own and remembered, by 64-bit hash of piece and what is before it. Texts with other white space than single spaces and
    line ends between words, and those that hold one of the tokenizer's added tokens, go whole.
    """

    #: What is before a piece: a space, a line end or the text's start, or its word.
    SPACE, LINE, WORD = range(3)

    def __init__(self, path: str, width: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.type, self.width = Tokenizer.from_file(path), f"<u{width}", width
        #: Texts that hold an added token, such as an end mark, go whole.
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.line = self.raw(["\n"])[0]
        self.word = np.zeros(256, dtype=bool)
        self.word[[c for c in range(128) if chr(c).isalnum()]] = True
        self.latin = np.zeros(256, dtype=bool)  # second bytes of the letters from U+00C0 to U+00FF
        self.latin[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True
        self.clear()

    def clear(self) -> None:
        self.hash, self.entry = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.new_hash, self.new_entry = self.hash, self.entry
        self.off, self.size, self.alone = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.flat, self.used = np.zeros(1 << 16, dtype=self.type), 0

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.type) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def pieces(self, names: list[str], before: str) -> list[np.ndarray]:
        """Ids of `before` + each name (no white space in it): many are encoded as the lines of one text, and parted at its line ends."""
        out = []
        for k in range(0, len(names), 4096):
            (ids,) = self.raw(["\n".join([before + x for x in names[k : k + 4096]])])
            end = np.concatenate((np.flatnonzero(ids == self.line[0]), [len(ids)])).tolist()
            start = [0] + [x + 1 for x in end[:-1]]
            out += [ids[a:b] for a, b in zip(start, end)]
        return out

    def learn(self, keys: np.ndarray, names: list[str], kinds: np.ndarray) -> np.ndarray:
        """Remembers new pieces; returns their entries. One with white space in it can't be encoded alone."""
        ids: list = [np.zeros(0, dtype=self.type)] * len(names)
        alone = np.array([p.split() == [p] for p in names], dtype=bool)
        for kind, before in ((self.SPACE, " "), (self.LINE, ""), (self.WORD, "")):
            own = np.flatnonzero((kinds == kind) & alone).tolist()
            for i, x in zip(own, self.pieces([names[i] for i in own], before)):
                ids[i] = np.concatenate((self.line, x)) if kind == self.LINE else x
        size = np.array([len(x) for x in ids], dtype=np.int64)
        total = int(size.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(max(total, len(self.flat)), dtype=self.type)))
        self.flat[self.used : self.used + total] = np.concatenate(ids) if ids else []
        entry = np.arange(len(self.off), len(self.off) + len(names))
        self.off, self.size, self.alone = np.concatenate((self.off, self.used + np.cumsum(size) - size)), np.concatenate((self.size, size)), np.concatenate((self.alone, alone))
        self.used += total
        h, e = np.concatenate((self.new_hash, keys)), np.concatenate((self.new_entry, entry))
        if len(h) > max(1 << 16, len(self.hash) // 4):
            h, e = np.concatenate((self.hash, h)), np.concatenate((self.entry, e))
            o = np.argsort(h)
            self.hash, self.entry, self.new_hash, self.new_entry = h[o], e[o], h[:0], e[:0]
        else:
            o = np.argsort(h)
            self.new_hash, self.new_entry = h[o], e[o]
        return entry

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of sorted keys, -1 for unknown ones."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for h, e in ((self.hash, self.entry), (self.new_hash, self.new_entry)):
            if len(h):
                at = np.minimum(np.searchsorted(h, keys), len(h) - 1)
                hit = h[at] == keys
                out[hit] = e[at[hit]]
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return [x for a, b in T.chunks(texts, 2 << 20) for x in self.some(texts[a:b])]

    def some(self, texts: list[bytes]) -> list[bytes]:
        w, n = T.Words(texts), len(texts)
        buf, first, last = w.buf, w.offset[:-1], w.offset[1:] - 1
        before = np.where(w.start > first[w.doc], buf[np.maximum(w.start, 1) - 1], 10) if len(w) else np.zeros(0, dtype=np.uint8)
        gap = w.start - np.concatenate(([0], w.end[:-1]))[: len(w)] - 1
        lead = w.start == first[w.doc]
        opens = np.concatenate(([True], w.doc[1:] != w.doc[:-1]))[: len(w)]
        wrong = np.where(opens, ~lead, (gap != 0) | ((before != 32) & (before != 10)))
        odd = np.bincount(w.doc[wrong], minlength=n) > 0
        some = np.diff(w.first) > 0
        odd |= np.where(some, w.end[np.maximum(w.first[1:], 1) - 1] != last if len(w) else False, last > first)
        prev, prev2 = buf[np.maximum(w.end, 2) - 2] if len(w) else before, buf[np.maximum(w.end, 3) - 3] if len(w) else before
        end_mark = buf[w.end - 1] if len(w) else before
        long = w.end - w.start
        mark = ((end_mark == 44) | (end_mark == 46)) & (((long >= 2) & self.word[prev]) | ((long >= 3) & (prev2 == 0xC3) & self.latin[prev]))
        part = np.repeat(np.arange(len(w)), 1 + mark)
        tail = np.concatenate(([False], part[1:] == part[:-1]))[: len(part)]
        s, e, doc = np.where(tail, w.end[part] - 1, w.start[part]), np.where(mark[part] & ~tail, w.end[part] - 1, w.end[part]), w.doc[part]
        kind = np.where(tail, self.WORD, np.where(before[part] == 32, self.SPACE, self.LINE))
        key = T.mix(T.word_hashes(buf, s, e) + kind.astype(np.uint64))
        unique, at, back = np.unique(key, return_index=True, return_inverse=True)
        entry = self.find(unique)
        new = np.flatnonzero(entry < 0)
        if len(self.off) + len(new) > CACHE and len(self.off):
            self.clear()
            entry[:], new = -1, np.arange(len(unique))
        if len(new):
            where = at[new]
            names = [w.raw[a:b].decode(errors="replace") for a, b in zip(s[where].tolist(), e[where].tolist())]
            entry[new] = self.learn(unique[new], names, kind[where])
        entry = entry[back]
        odd |= np.bincount(doc[~self.alone[entry]], minlength=n) > 0
        if any(a in w.raw for a in self.added):
            odd |= np.array([any(a in t for a in self.added) for t in texts])
        size = self.size[entry]
        total = int(size.sum())
        ids = self.flat[np.repeat(self.off[entry] - (np.cumsum(size) - size), size) + np.arange(total)]
        stop = np.cumsum(np.bincount(doc, weights=size, minlength=n).astype(np.int64))
        raw, skip = ids.tobytes(), len(self.line)
        out = [raw[self.width * (a + skip) : self.width * b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist())]
        whole = np.flatnonzero(odd).tolist()
        for i, x in zip(whole, self.raw([texts[i].decode() for i in whole])):
            out[i] = x.tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str, width: int) -> Encoder:
    """One for each worker process, that what it remembers serves all its tasks."""
    return Encoder(path, width)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write(docs: DataFrame, root: str | None = None, tokenizer: str = "byte_bpe_50k.json", width: int = 2, end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes every text of (doc_id, text), ends it with the id `end`, and writes shards in ascending order of doc_id (nulls last,
    equal identifiers by hash of the text). Returns the manifest: shard, path, entries, ids, start (ids in the shards before).

    Shards are ranges of about `shard_bytes` of text each; rows of one identifier, or of none, can be in several. Tasks write under names of their own; the manifest, committed by
    Spark, names those of the attempts that counted. Null is an empty text: its only id is `end`. An empty table has an empty manifest.
    """
    spark = docs.sparkSession
    C.arrow_rows(spark)
    root = (root or C.scratch(spark, "tokens")).rstrip("/")
    rows = C.text_keys(docs)
    shards, shard = C.id_shards(rows, F.octet_length("text").cast("long") + 8, shard_bytes)
    placed = rows.withColumn("shard", shard).drop("doc_id").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "d", "x")

    def put(batches):
        fs, base = C.filesystem(root)
        fs.create_dir(base, recursive=True)
        own, done, at, last, count, out = encoder(tokenizer_path(tokenizer), width), [], None, None, 0, None

        def close():
            if out:
                out.finish()
                done.append({"shard": at, "name": name, "entries": len(out.keys), "ids": out.ids})

        for batch in batches:
            shards, d = batch.column("shard").to_pylist(), batch.column("d").to_pylist()
            for sh, doc, ids in zip(shards, d, own.encode(C.pylist(batch, "text"))):
                if sh != at:
                    close()
                    name = f"shard-{sh:06d}-{uuid.uuid4().hex}.sst"
                    out, at, last = Writer(fs.open_output_stream(f"{base}/{name}", compression=None), width), sh, None
                count = count + 1 if doc == last else 0
                last = doc
                out.add(key_of(None if doc == C.NO_ID else doc, count), ids + end.to_bytes(width, "little"))
        close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("entries", pa.int64()), ("ids", pa.int64())]))

    files = placed.mapInArrow(put, "shard int, name string, entries long, ids long")
    files.write.parquet(f"{root}/manifest")
    found = spark.read.schema(files.schema).parquet(f"{root}/manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row a shard
    return found.select("shard", F.concat(F.lit(root + "/"), "name").alias("path"), "entries", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) and the ids themselves."""

    def get(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                file, out, size = Reader(path), {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {}), 0
                for key, value, before in file:
                    ids = np.frombuffer(value, dtype=f"<u{file.width}").astype("<u4")
                    row = [id_of(key), start + before, len(ids), zlib.crc32(ids.tobytes())] + ([ids.tolist()] if with_ids else [])
                    for k, v in zip(out, row):
                        out[k].append(v)
                    size += len(ids)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_pydict(out, schema=schema)
                        out, size = {k: [] for k in out}, 0
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "n_tokens", "ids_crc32")] + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
    spread = manifest.select("path", "start").repartition(max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism)))
    return spread.mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(C.documents(spark, sf_dir)))
