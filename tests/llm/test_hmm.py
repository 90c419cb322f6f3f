import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from pairloom.llm import hmm as H


def corpus():
    rnd = random.Random(4)
    words = [[f"{c}{i}" for i in range(30)] for c in "ab"]
    rows = [(i, " ".join(rnd.choice(words[i % 2]).upper() if rnd.random() < 0.2 else rnd.choice(words[i % 2]) for _ in range(rnd.randrange(0, 80)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (None, "a1 a2"), (7, rows[7][1]), (502, "new words é É"), (503, "a1 B2 " * 3000), (503, "a1 B2 " * 3000)]


def test_base_score_and_counts_equal_brute_force(spark):
    rows = corpus()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None]
    counts = Counter(w for d, t in rows if not held(d) for w in tok(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, held(d), len(tok(t)), sum(counts[w] > 0 for w in tok(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for d, t in rows), key=repr)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, rid int").repartition(3)
    for types in (10, 10**6):
        out = H.score(df, states=3, classes=20, rounds=2, types=types).collect()
        assert sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in out), key=repr) == want
        assert all(r["score"] < 0 for r in out)


def test_forward_and_counts_equal_plain_recursions():
    rng = np.random.default_rng(0)
    s, k = 3, 5
    pi, a, b = rng.dirichlet(np.ones(s), 2), rng.dirichlet(np.ones(s), s), rng.dirichlet(np.ones(k), s).T
    seqs = [rng.integers(0, k, n).astype(np.uint16) for n in (4, 1, 6, 6, 2)]
    starts = np.array([0, 1, 0, 1, 0])
    own = H.Batch(seqs, starts)
    logs = own.forward(pi, a, b)[0]
    begin, trans, emit = np.zeros((2, s)), np.zeros((s, s)), np.zeros((k, s))
    for q, kind, got in zip(seqs, starts, logs):
        total, paths = 0.0, []
        for path in np.ndindex(*[s] * len(q)):
            p = pi[kind, path[0]] * b[q[0], path[0]]
            for i in range(1, len(q)):
                p *= a[path[i - 1], path[i]] * b[q[i], path[i]]
            total += p
            paths.append((path, p))
        assert math.isclose(math.log(total), got, rel_tol=1e-9)
        for path, p in paths:
            begin[kind, path[0]] += p / total
            for i, st in enumerate(path):
                emit[q[i], st] += p / total
                if i:
                    trans[path[i - 1], st] += p / total
    g = own.counts(pi, a, b)
    assert np.allclose(g[0], begin) and np.allclose(g[1], trans) and np.allclose(g[2], emit) and math.isclose(g[3], logs.sum())


def test_forward_over_long_texts_is_exact():
    """Texts of many stretches are scored whole: against a plain scaled recursion."""
    rng = np.random.default_rng(1)
    s, k = 4, 9
    pi, a, b = rng.dirichlet(np.ones(s), 2), rng.dirichlet(np.ones(s), s), rng.dirichlet(np.ones(k), s).T
    long = rng.integers(0, k, 3 * H.STRETCH + 77).astype(np.uint16)
    seqs, starts = H.sequences([long.tobytes(), long[:5].tobytes()], None)
    assert [len(q) for q in seqs] == [len(long), 5]
    got = {}
    for which, own in H.batches_of(seqs, starts):
        got |= dict(zip(np.asarray(which).tolist(), own.forward(pi, a, b)[0].tolist()))
    for n, q in enumerate((long, long[:5])):
        alpha, total = pi[starts[n]] * b[q[0]], 0.0
        for x in q[1:]:
            total += math.log(alpha.sum())
            alpha = (alpha / alpha.sum()) @ a * b[x]
        assert math.isclose(total + math.log(alpha.sum()), got[n], rel_tol=1e-9)


def test_training_raises_likelihood_and_beats_unigrams_on_held_out_texts(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    rows = df.selectExpr("doc_id", "false AS held_out", "coalesce(text, '') AS text")
    top = H.count_types(rows).orderBy("h").toPandas()
    cc = np.concatenate((np.sort(top["c"].to_numpy())[::-1], [125, 0])).astype(float)
    enc = H.encode(rows, top["h"].to_numpy().view(np.uint64), top["c"].to_numpy(), len(cc), 125)
    history = H.train(enc, cc, 2, 6)[3]
    assert all(y >= x - abs(x) * 1e-3 for x, y in zip(history, history[1:])) and history[-1] > history[0]
    out = H.score(df, states=2, classes=100, rounds=6).where("held_out").toPandas()
    assert out["score"].sum() > out["base_score"].sum()


def test_empty(spark):
    assert H.score(spark.createDataFrame([], "doc_id long, text string"), rounds=1).count() == 0
