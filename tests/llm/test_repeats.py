import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from pairloom.llm import repeats as R


def brute_bytes(rows, target):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + target] for t in texts for i in range(len(t) - target + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - target + 1):
            if seen[t[i : i + target]] > 1:
                gone[i : i + target] = [True] * target
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, target):
    big = 1 << 62
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    low = {}
    for (d, _), t in zip(rows, texts):
        for i in range(len(t) - target + 1):
            w = tuple(t[i : i + target])
            low[w] = min(low.get(w, big), big if d is None else d)
    out = []
    for (d, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - target + 1):
            if low[tuple(t[i : i + target])] < (big if d is None else d):
                gone[i : i + target] = [True] * target
        out.append((d, len(t), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(t, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=50):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["é", "ß"]
    line = lambda k: [rnd.choice(vocab) for _ in range(k)]
    passages = [line(rnd.randrange(8, 40)) for _ in range(4)]
    rows = []
    for i in range(n):
        words = line(rnd.randrange(0, 60))
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p) // 2)
            words = words[: len(words) // 2] + p[a:] + words[len(words) // 2 :]
        rows.append((rnd.randrange(n), " ".join(words)))
    rows += rnd.sample(rows, 8)
    rows += [(None, rows[0][1]), (None, None), (7, ""), (8, "same " * 300), (9, "same " * 120), (10, "\n".join(line(5) * 30)), (11, "ab" * 500)]
    return rows


@pytest.mark.parametrize("most", [1, 2, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_equal_brute_force(spark, seed, most):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, p int, ctx string").repartition(3)
    got = R.dedup_bytes(df, target=40, gram=8, shard_bytes=2000, shard_most=most).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_bytes(rows, 40)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_words_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, h int").repartition(3)
    got = R.dedup_words(df, target=12, gram=2).select("doc_id", "size", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(rows, 12)


def test_pieces_of_long_texts():
    """A text in small pieces has the windows of a whole one, each in one item, under the same anchors."""
    t = np.frombuffer(" ".join(random.Random(3).choices("abcdefgh", k=400)).encode(), dtype=np.uint8).astype(np.uint64)

    def windows(piece):
        R.PIECE, old = piece, R.PIECE
        q = np.array(list(R.pieces([len(t)], 40)))
        R.PIECE = old
        first = np.concatenate(([0], np.cumsum(q[:, 2] - q[:, 1])))
        _, p, h, _, _ = R.anchors(np.concatenate([t[s:e] for _, s, e, _, _ in q.tolist()]), first, q[:, 1], q[:, 3:5], 40, 8)
        pos, lo, hi = R.unpack(p)
        return sorted((int(a) - w, int(a), int(g)) for a, l, u, g in zip(pos, lo, hi, h) for w in range(l, u + 1))

    assert windows(64) == windows(1 << 20) and [w for w, _, _ in windows(64)] == list(range(len(t) - 39))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert R.dedup_bytes(df).count() == 0 and R.dedup_words(df).count() == 0


def plain_bytes(rows, target=400):
    """n_removed by row, with windows cut at the contract's size."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(hashlib.md5(t[i : i + target]).digest() for t in texts for i in range(len(t) - target + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, dtype=np.int64)
        for i in range(len(t) - target + 1):
            if seen[hashlib.md5(t[i : i + target]).digest()] > 1:
                gone[i] += 1
                gone[i + target] -= 1
        out.append((d, int((np.cumsum(gone)[:-1] > 0).sum())))
    return sorted(out)


def test_default_sizes_with_near_copies(spark):
    """Near copies, whose anchors have many contexts, and passages shorter and longer than a window between other text."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9)))
    base, passages = [word() for _ in range(200)], [" ".join(word() for _ in range(n)) for n in (60, 75, 90)]
    rows = [(i, " ".join(w if rnd.random() > 0.03 else word() for w in base)) for i in range(60)]
    rows += [(100 + i, " ".join([*(word() for _ in range(rnd.randrange(90))), rnd.choice(passages), *(word() for _ in range(rnd.randrange(90)))])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = plain_bytes(rows)
    assert sum(n > 0 for _, n in want) > 40
    for most in (10, R.SHARD_MOST):
        got = R.dedup_bytes(df, shard_most=most).select("doc_id", "n_removed").collect()
        assert sorted(map(tuple, got)) == want


def test_single_contexts_come_from_sorted_suffixes(spark, monkeypatch):
    """Without the sorted suffixes only contexts that occur twice as a whole are found."""
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = R.C.text_keys(df)
    monkeypatch.setattr(R, "by_levels", None)
    spans = {tuple(r) for r in R.spans_of(keyed, "suffix", target=40, gram=8).collect()}
    R.C.arrow_rows(spark)
    whole, left = R.settle(R.C.stored(R.items_of(keyed, "bytes", 40, 8), "items"), "any")
    equal = {(r["d"], r["x"], r["start"], r["stop"] + 40) for r in whole.collect()}
    own, sorted_ = R.by_suffixes(R.C.stored(R.contexts_of(keyed, left, "bytes", 40), "contexts"), 40, 8, 1 << 20, 1000)
    assert not own and spans == equal | {tuple(r) for r in sorted_.collect()} and not spans <= equal


def test_words_of_one_polynomial_hash():
    """Words on which polynomials modulo 2**64 fail, and words that differ late."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    words = [a, b, a[:-1] + "c", "x" * 64 + "yz", "x" * 64 + "zy", "yz", "zy"]
    assert len(set(R.T.Words([" ".join(words).encode()]).hash.tolist())) == len(words)
