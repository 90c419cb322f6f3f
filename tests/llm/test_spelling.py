"""Spelling variants against all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import spelling as S


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def counts(docs):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    return {w: k for w, k in n.items() if k >= 2}


def brute(docs):
    n = counts(docs)
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and distance(v, w) == 1] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def run(spark, docs):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, word string, n int")
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in S.variants(df).collect())


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(8)
    letters = list("abcdefgéèßÿ×÷") + ["Ab", "Z"]
    base = ["".join(rng.choice(letters, size=rng.integers(6, 12))) for _ in range(40)]
    words = []
    for w in base:  # chains of variants, each about a tenth as often as the one before
        for often in (300, 25, 2):
            words += [w] * int(often * rng.uniform(0.5, 1.5))
            k = int(rng.integers(len(w)))
            w = (w[:k] + w[k + 1 :], w[:k] + str(rng.choice(letters)) + w[k + 1 :], w[:k] + str(rng.choice(letters)) + w[k:])[int(rng.integers(3))]
    words = [str(w) for w in rng.permutation(words)]
    docs = [(k, " 1-".join(words[i : i + 60])) for k, i in enumerate(range(0, len(words), 60))]
    docs += [(None, docs[0][1]), (None, None), (5, ""), (5, docs[3][1]), (5, docs[3][1]), (6, "abcdefg " * 30_000), (908, "q" * 50_000 + " " + "q" * 50_001), (909, "q" * 50_000 + " " + "q" * 50_001)]
    got, want = run(spark, docs), brute([d for d in docs if d[0] not in (908, 909)])
    assert [r for r in got if len(r[0]) < 1000] == want
    assert any(r[3] and r[5] != r[3] for r in want) and any(r[3] is None and r[2] for r in want)
    assert sorted(r[2] for r in got if len(r[0]) >= 1000) == brute_long(docs)


def brute_long(docs):
    """The numbers of near words of words of one letter: lengths one apart."""
    n = counts([d for d in docs if d[0] in (908, 909)])
    return sorted(sum(abs(len(v) - len(w)) == 1 for v in n) for w in n)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, "short words only")]) == []


@pytest.mark.parametrize("shared", [2, 300])
def test_hot_band(spark, shared):
    """Many words that share a band's letters and length: every pair that is near is found, in whichever band it is first."""
    words = sorted({f"eni{a}{b}xqzw" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"})[:shared]
    docs = [(k, " ".join(words)) for k in range(4)]
    assert run(spark, docs) == brute(docs)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abzé×ÿþ", min_size=1, max_size=9), st.integers(0, 8), st.sampled_from("abzé×ÿþ"), st.integers(0, 2))
def test_an_edit_leaves_a_band(word, at, letter, kind):
    at = at % len(word)
    other = (word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :], word[:at] + letter + word[at:])[kind]
    if word == other:
        return
    (m, k, n), (p, q, o) = S.parity(word), S.parity(other)
    same = [i for i in range(3) if k[i] == q[i]]
    assert (m ^ p).bit_count() <= 2 and len(same) in (1, 2)
    if len(same) == 1:  # replaced across bands
        x = min({0, 1, 2} - set(same))
        assert len(word) == len(other) and abs(n[x] - o[x]) == 1 and (m ^ p).bit_count() == 2
