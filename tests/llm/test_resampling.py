"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pairloom.llm import resampling as R

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, low, high):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, low=1, high=1, buckets=10_000, least=20, percent=10):
    crc = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(crc(g) for x in texts for g in grams(x, low, high)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for d, x in docs:
        w, own = grams(x, low, high)
        weight = sum(gain(crc(g)) for g in own)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least))
    able = sorted((k for k, r in enumerate(rows) if r[4]), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    rank = {k: i + 1 for i, k in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(k)) for k, r in enumerate(rows)), key=repr)


def run(spark, docs, target, **options):
    d = spark.createDataFrame([(i, x, "s", 1) for i, x in docs], "doc_id long, text string, id string, word int")
    t = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    return sorted(map(tuple, R.resample(d, t, **options).collect()), key=repr)


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(4)
    vocabulary = ["a", "An", "é", "Été", "x1", "naïve", "日本", "word", "b2", "Zürich", *(f"w{k}" for k in range(300))]
    join = ["-", " ", ", ", "\n", "\x7f", "_", "\t"]
    texts = ["".join(str(rng.choice(vocabulary)) + str(rng.choice(join)) for _ in range(n)) for n in rng.integers(0, 120, 150)]
    odd = [(500, None), (501, ""), (502, " \n.!"), (None, texts[0]), (None, texts[1]), (7, texts[7]), (7, texts[7]), (7, texts[7]), (7, texts[8]), (503, "long " * 50_000), (504, "x" * 100_000)]
    return list(enumerate(texts)) + odd


@pytest.mark.parametrize("options", [{}, {"low": 2, "high": 3, "buckets": 50}, {"least": 0, "percent": 100}])
def test_equals_plain(spark, docs, options):
    target = [docs[3][1], "été naïve w1 w2", None, ""]
    assert run(spark, docs, target, **options) == brute(docs, target, **options)


@pytest.mark.parametrize("held", [0, 200])
def test_rare_grams_are_joined(spark, docs, held):
    assert run(spark, docs, ["w1 w2 w3"], high=2, held=held) == brute(docs, ["w1 w2 w3"], high=2)


def test_empty_tables(spark, docs):
    assert run(spark, [], ["a b"]) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_two_words_of_one_id_are_seen(spark, monkeypatch):
    """A dictionary with two words of one id, whatever the seed, is an error, not a wrong result."""
    monkeypatch.setattr(R, "dictionary", lambda texts, seed: spark.createDataFrame([(1, b"a", b"b")], "id long, word binary, other binary"))
    with pytest.raises(ValueError):
        run(spark, [(1, "a b")], ["a"])
