import random

import pytest
import xxhash

from pairloom.llm import simhash as S


def brute_print(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), S.C.NO_ID), S.C.NO_ID if d is None else d)
    return sorted(((d, f"{fps[i]:016x}", None if low[find(i)] == S.C.NO_ID else low[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def test_components_equal_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        text = [rnd.choice(words) for _ in range(rnd.randrange(1, 300))]
        rows.append((i * 3, " ".join(text)))
        for k in range(rnd.randrange(3)):
            copy = list(text)
            copy[rnd.randrange(len(copy))] = "Changed"
            rows.append((1000 + 10 * i + k, "\t".join(copy)))
    rows += [(5000, None), (5001, ""), (None, " \n"), (5002, "é É A"), (5002, "é É A"), (5003, "x " * 30000)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, fp long, d long")
    got = sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=repr)
    assert got == brute(rows)


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("most", [4, 10**6])
def test_large_shards_and_trees_agree(spark, most):
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    values = {base}
    for _ in range(300):
        values.add(rnd.choice(sorted(values)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    values |= {rnd.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(S.signed(v),) for v in sorted(values)], "fp long")
    got = S.components(S.links(df, tree_most=most)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["node"])
    want = {}
    todo = {S.signed(v) for v in values}
    while todo:
        part, new = set(), {todo.pop()}
        while new:
            part |= new
            new = {v for v in todo if any((v ^ p).__and__((1 << 64) - 1).bit_count() <= 2 for p in new)}
            todo -= new
        if len(part) > 1:
            want[min(part)] = part
    assert groups == want


def test_masks_divide_until_few_bits_are_free():
    """Values within the radius share a mask at every level, so dividing a shard loses no link."""
    rnd = random.Random(8)
    for radius in (0, 1, 2):
        used = 0
        while used.bit_count() < 64 - S.FREE_BITS:
            masks = S.block_masks(radius, used)
            for _ in range(200):
                x = rnd.getrandbits(64)
                y = x
                for b in rnd.sample([b for b in range(64) if not used >> b & 1], radius):
                    y ^= 1 << b
                assert any(x & m == y & m for m in masks) and all(m & used == used for m in masks)
            used = rnd.choice(masks)
