import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import sstable as S


@pytest.fixture(scope="module")
def encoder():
    return S.Encoder(S.tokenizer_path("byte_bpe_50k.json"), 2)


@pytest.fixture(scope="module")
def fresh():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(S.tokenizer_path("byte_bpe_50k.json"))


def test_added_tokens_have_their_ids(spark, encoder, fresh):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x y <|endoftext|> z\nw", "plain words, here.", "<|endoftext", "endoftext|>"]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 50256, 65]
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in encoder.encode([t.encode() for t in texts])] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, S.read(S.write(df)).collect())) == expected(list(enumerate(texts)), fresh)


PLAIN = __import__("tokenizers").Tokenizer.from_file(S.tokenizer_path("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab '.,1é\u00d7\n\t\u3000\u00a0   <|>Z\x01\x1c!", max_size=30), max_size=5))
def test_pieces_have_the_ids_of_the_whole_text(encoder, texts):
    got = [np.frombuffer(x, dtype="<u2").tolist() for x in encoder.encode([t.encode() for t in texts])]
    assert got == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_real_texts_and_a_small_memory(encoder, monkeypatch):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    want = [encoder.tok.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (3_000_000, 300):
        monkeypatch.setattr(S, "CACHE", most)
        for k in range(0, len(texts), 50):
            assert [np.frombuffer(x, dtype="<u2").tolist() for x in encoder.encode([t.encode() for t in texts[k : k + 50]])] == want[k : k + 50]


def expected(rows, tok):
    out, start = [], 0
    key = lambda r: (r[0] is None, r[0] or 0)
    for d, t in sorted(rows, key=key):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, encoder):
    rows = [(i * 7 % 101, f"text {i}\nof  some words, é" * (i % 5)) for i in range(101)] + [(500, None), (-4, "x " * 50000), (None, "last")]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, shard int").repartition(4)
    manifest = S.write(df, shard_bytes=2000)
    assert manifest.count() > 3
    got = sorted((tuple(r) for r in S.read(manifest).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == expected(rows, encoder.tok)
    found = {r[0]: r[4] for r in S.read(manifest, with_ids=True).collect()}
    for p in [r["path"] for r in manifest.collect()]:
        reader = S.Reader(p)
        ids = [S.id_of(k) for k, _, _ in reader]
        assert all(reader.lookup(d)[0].tolist() == found[d] for d in ids)
        assert reader.lookup(10**12) == []


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    m = S.write(df)
    assert [(r["doc_id"], r["n_tokens"]) for r in S.read(m).orderBy("start").collect()] and S.read(m).count() == 3
    assert len(S.Reader(m.first()["path"]).lookup(1)) == 3
    assert S.read(S.write(df.limit(0))).count() == 0


def test_shards_with_outliers_equal_and_null_ids(spark):
    """One far identifier, and thousands of rows of one identifier or none, leave shards even, for any partitioning of the rows."""
    rows = [(i, "w " * 200) for i in range(2000)] + [(1 << 62, "far"), (-(1 << 63), "first")]
    rows += [(None, f"n{i} " * 150) for i in range(3000)] + [(7, f"seven{i} " * 60) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {}
    for parts in (2, 9):
        m = S.write(df.repartition(parts), shard_bytes=60_000).collect()
        sizes[parts] = [(r["shard"], r["entries"], r["ids"], r["start"]) for r in sorted(m, key=lambda r: r["shard"])]
    assert sizes[2] == sizes[9] and len(sizes[2]) > 30
    assert max(n for _, n, _, _ in sizes[2]) < 0.1 * len(rows)
    got = S.read(S.write(df, shard_bytes=60_000)).toPandas().sort_values("start")
    assert got["doc_id"].isna().sum() == 3000 and got["doc_id"].isna().to_numpy()[-3000:].all()
    assert got["doc_id"].dropna().is_monotonic_increasing and (got["start"].to_numpy()[1:] == (got["start"] + got["n_tokens"]).to_numpy()[:-1]).all()


def test_bounds_below():
    rng = np.random.default_rng(4)
    low, high = rng.integers(0, 5, 40), rng.integers(-9, 9, 40)
    o = np.lexsort((high, low))
    low, high = low[o], high[o]
    d, x = rng.integers(-1, 7, 500), rng.integers(-12, 12, 500)
    want = [sum((a, b) <= (p, q) for a, b in zip(low.tolist(), high.tolist())) for p, q in zip(d.tolist(), x.tolist())]
    assert S.C.bounds_below(low, high, d, x).tolist() == want
