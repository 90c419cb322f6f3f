import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import suffix


def check(t):
    t = np.array(t, dtype=np.int64)
    sa = suffix.suffix_array(t)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    lcp = suffix.permuted_lcp(t, sa)
    for a, b in zip(sa, sa[1:]):
        k = 0
        while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        assert lcp[b] == k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_small_alphabet(t):
    check(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2000), max_size=40).flatmap(lambda x: st.just(x + x + [7] * 90 + x)))
def test_wide_alphabet_and_repeats(t):
    check(t)


def test_wide_induction():
    old, suffix.WIDE = suffix.WIDE, 2
    try:
        rng = np.random.default_rng(1)
        for n in (1, 2, 3, 50, 400):
            check(rng.integers(0, 4, n))
    finally:
        suffix.WIDE = old


def test_repeated_starts():
    t = np.frombuffer(b"xxabcdefyyabcdefzz" + b"ab" * 20, dtype=np.uint8)
    raw = t.tobytes()
    for n in (3, 6, 7):
        want = [len(raw[i : i + n]) == n and sum(raw[j : j + n] == raw[i : i + n] for j in range(len(raw))) > 1 for i in range(len(raw))]
        assert suffix.repeated_starts(t, n).tolist() == want
