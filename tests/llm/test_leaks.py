import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import leaks as L


def plain(item, line):
    row = [0] * (len(line) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(line, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), max_size=20))
def test_edit_distance(item, line):
    assert L.closest(item, line)[0] == plain(item, line)


def edited(rnd, item, n, vocab):
    """The item with n edits at different places: words replaced, put in or taken out."""
    item = list(item)
    for i in sorted(rnd.sample(range(len(item)), n), reverse=True):
        item[i : i + rnd.choice((0, 1, 1))] = [rnd.choice(vocab)] if rnd.random() < 0.7 else []
    return item


def test_recall_against_all_exact_distances(spark):
    """Planted items have up to the most edits, half of them exactly so many; every document is held against every item by the exact distance."""
    rnd = random.Random(8)
    vocab = [f"v{i}" for i in range(300)]
    line = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(k, line(n)) for k, n in enumerate([2, 3, 4, 5, 6, 7, 8, 9, 10, 11] + [rnd.randrange(12, 60) for _ in range(30)])] + [(98, ["v1"])]
    rows, want, most = [], set(), set()
    for d in range(500):
        text = line(rnd.randrange(0, 150))
        if d % 2 == 0:
            k, item = rnd.choice(items)
            n = L.edits(len(item))
            a = rnd.randrange(len(text) + 1)
            text = text[:a] + [w.upper() + "," for w in edited(rnd, item, n if d % 4 else rnd.randrange(n + 1), vocab)] + text[a:]
        rows.append((d, " ".join(text)))
        for k, item in items:
            dist = plain(item, [w.lower().strip(",") for w in text])
            if dist <= L.edits(len(item)):
                want.add((d, k, dist))
                if dist and dist == L.edits(len(item)):
                    most.add((d, k, dist))
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x), 1) for k, x in items] + [(99, None, 1), (97, "", 1), (96, " .,! ", 1)], "item_id long, text string, doc_id int")
    for block in (7, 1000):
        got = {(r["doc_id"], r["item_id"], r["distance"]) for r in L.leaks(docs, bench, block=block).collect()}
        assert {g[:2] for g in got} <= {w[:2] for w in want}
        assert len(got & want) >= 0.97 * len(want) and len(got & most) >= 0.95 * len(most) > 60, (len(got & want), len(want), len(got & most), len(most))
    assert L.leaks(docs.limit(0), bench).count() == 0 and L.leaks(docs, bench.limit(0)).count() == 0


def test_rows_names_ties_and_long_texts(spark):
    item = [f"q{i}" for i in range(20)]
    twice = item[:10] + ["x"] + item[11:] + ["between"] * 30 + item[:3] + ["y"] + item[4:]
    long = ["pad"] * 200_000 + item + ["pad"] * 1000
    template = (["what", "is", "the", "name", "of"] * 4000) + ["a"]
    rows = [(1, " ".join(twice), 7, 8), (1, " ".join(twice), 7, 8), (2, " ".join(long), 7, 8), (3, " ".join(template), 7, 8), (None, " ".join(item), 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int, stop int")
    items = [(5, " ".join(item))] + [(10 + k, f"what is the name of {' '.join(f'r{k}x{i}' for i in range(12))}") for k in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, L.leaks(docs, bench).collect()), key=repr)
    assert got == sorted([(1, 5, 1, 20, 20), (1, 5, 1, 20, 20), (2, 5, 0, 20, 200_020), (None, 5, 0, 20, 20)], key=repr)
    left = L.clean(docs, bench)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [rows[3]]


def test_equal_windows_have_equal_keys():
    x = np.random.default_rng(1).integers(1, 1 << 60, 30).astype(np.uint64)
    line = np.concatenate((x, x[:5], x))
    for _, steps, sampled, _ in L.CLASSES:
        k = L.embedded(line, steps, sampled, 3, 1)
        assert (k[: 30 - steps] == k[35 : 65 - steps]).all()


def test_recall_by_length():
    """Of each length on its own, items with the most edits (at random places; and the ones that leave the shortest runs) are found."""
    rnd = random.Random(5)
    vocab = [f"v{i}" for i in range(5000)]
    for n in [*range(5, 21), 24, 25, 30, 40, 50, 60]:
        items = [[rnd.choice(vocab) for _ in range(n)] for _ in range(120)]
        own = L.Items([(k, " ".join(x).encode()) for k, x in enumerate(items)], 11)
        texts = []
        for k, item in enumerate(items):
            if k % 3:
                bad = edited(rnd, item, L.edits(n), vocab)
            else:
                e, bad = L.edits(n), list(item)
                for i in range(e):
                    bad[(i + 1) * n // (e + 1)] = f"x{i}"
            texts.append(" ".join(["pad"] * rnd.randrange(30) + bad + ["pad"] * 5).encode())
        found = {(d, k) for d, k, *_ in L.search(texts, own)}
        assert sum((k, k) in found for k in range(len(items))) >= 0.95 * len(items), (n, len(found))


def test_twenty_thousand_items_and_a_thousand_texts():
    """No pair is lost however many texts and items meet in one batch."""
    items = [(k, " ".join(f"a{(k * 31 + i * 977) % 40_009}" for i in range(6 + k % 20)).encode()) for k in range(20_000)]
    own = L.Items(items, 11)
    at = [k * 20 for k in range(1000)]
    found = {(d, k) for d, k, dist, _ in L.search([b"so " + items[k][1] + b" it is" for k in at], own) if dist == 0}
    assert all((d, k) in found for d, k in enumerate(at))


def test_distinct_rows_at_any_width():
    rng = np.random.default_rng(2)
    narrow = [rng.integers(0, 5, 1000) for _ in range(3)]
    want = sorted(set(zip(*(c.tolist() for c in narrow))))
    wide = [np.where(c > 2, c + (1 << 40), c) for c in narrow]
    assert list(zip(*(c.tolist() for c in L.distinct(narrow)))) == want
    assert list(zip(*(c.tolist() for c in L.distinct(wide)))) == sorted(tuple(x + (1 << 40) * (x > 2) for x in r) for r in want)
    assert len(L.distinct([np.zeros(0, dtype=np.int64)] * 3)[0]) == 0
