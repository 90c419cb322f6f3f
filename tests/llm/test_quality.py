import math
import random
import re
from collections import Counter

from pairloom.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = [False] * len(words)
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    n, r = len(words), sum(hit)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def test_base_measures_and_verdicts(spark):
    rnd = random.Random(6)
    vocab = [f"w{i}é" for i in range(50)]
    rows = [(i, "\n".join(" ".join(rnd.choices(vocab, k=rnd.randrange(0, 12))) for _ in range(rnd.randrange(1, 20)))) for i in range(80)]
    rows += [(100 + i, rows[i][1] + "\n" + rows[i][1]) for i in range(20)]
    rows += [(200 + i, " ".join(rnd.choices(["###", "$$|", "<>&"], k=60))) for i in range(20)]
    rows += [(300, None), (301, ""), (302, " \x1c \n\n"), (None, "a " * 200), (303, "x y z " * 30), (5, rows[5][1])]
    df = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, score int").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(200, 0), (None, 1)], "doc_id long, quality int")
    got = Q.score(df, labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r["doc_id"], *(r[c] for c in names)) for r in got), key=repr) == sorted(((d, *brute(t)) for d, t in rows), key=repr)
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= Q.THRESHOLD) for r in got)
    assert not any(r["kept"] for r in got if r["doc_id"] and 200 <= r["doc_id"] < 220)
    good = [r["kept"] for r in got if r["doc_id"] is not None and 20 <= r["doc_id"] < 60 and not r["base_failed"]]
    assert sum(good) >= 0.95 * len(good)
    assert all(r["score"] == 0 for r in Q.score(df, labels.limit(0)).collect())
    assert Q.score(df.limit(0), labels).count() == 0 and Q.keep(df, labels).columns == df.columns


def test_scores_equal_a_plain_version(spark):
    """Score and verdict of every text from dictionaries of its words and pairs; very long and repeated texts, and scores of the threshold itself."""
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rnd.choices(vocab[: 150 if i % 2 else 300], k=rnd.randrange(1, 90)))) for i in range(150)]
    rows += [(200, " ".join(rnd.choices(vocab, k=120_000))), (3, rows[3][1]), (201, None), (None, "w1 w2 " * 30), (202, "x" * 300_000)]
    good = {i for i in range(1, 100, 2)}
    code = {w: int(h) for w in {w for _, t in rows for w in (t or "").split()} for h in Q.T.Words([w.encode()]).hash}

    def grams(t):
        h = [code[w] for w in (t or "").split()]
        two = [int(Q.T.mix(Q.np.array([a * 3 + b & (1 << 64) - 1], dtype=Q.np.uint64))[0]) for a, b in zip(h, h[1:])]
        return [x >> 64 - Q.BUCKETS_LOG2 for x in h + two]

    own = [grams(t) for _, t in rows]
    every, target = Counter(), Counter()
    for (d, _), g in zip(rows, own):
        every.update(g)
        target.update(g if d in good else ())
    n, m = sum(target.values()), sum(every.values())
    ratio = {b: math.log(target[b] + Q.SMOOTHING) - math.log(c * n / m + Q.SMOOTHING) for b, c in every.items()}
    want = [(d, sum(ratio[b] for b in g) / max(1, len(g))) for (d, _), g in zip(rows, own)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in good] + [(i, 0) for i in range(0, 100, 2)], "doc_id long, quality int")
    edge = sorted(s for d, s in want)[len(want) // 2]
    got = sorted(((r["doc_id"], r["score"], r["kept"], r["base_failed"]) for r in Q.score(df, labels, threshold=edge - 1e-12).collect()), key=repr)
    for (d, s, kept, failed), (e, t) in zip(got, sorted(want, key=repr)):
        assert d == e and abs(s - t) < 1e-9 and kept == (not failed and t >= edge)
    kept = Q.keep(df.withColumn("score", Q.F.lit(1)), labels, threshold=edge - 1e-12)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((d for d, _, k, _ in got if k), key=repr)
