import random

from pairloom.llm import simhash as S


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def survivors(rows):
    """Least identifier of each component of texts at an exact similarity of 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted(low.values())


def changed(rnd, words, share):
    """The words with a run of them replaced, so that about `share` of the union of shingles is common."""
    n = round(len(words) * (1 - share) / (1 + share))
    a = rnd.randrange(len(words) - n)
    return words[:a] + [f"new{rnd.random()}" for _ in range(n)] + words[a + n :]


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r["doc_id"] for r in S.representatives(df, **more).collect())


def grown(rnd, words, n):
    """The words and n new ones that leave all bands of least hashes as they are."""
    bands = S.sketch([" ".join(words).encode()])[-1]
    end = len(words) + n
    while len(words) < end:
        more = words + [f"g{rnd.random()}" for _ in range(8)]
        if (S.sketch([" ".join(more).encode()])[-1] == bands).all():
            words = more
    return words


def test_pairs_of_a_large_shard_are_found_across_its_parts(spark):
    rnd = random.Random(4)
    passage = [f"p{i}" for i in range(300)]
    rows = []
    for d in range(20):  # all share a passage and so all shards, pairs of them are near copies
        own = grown(rnd, passage, 160)
        rows += [(d, " ".join(own)), (1000 + d, " ".join(grown(rnd, own, 40)))]
    assert survivors(rows) == list(range(20))
    assert got(spark, rows, tree_most=4) == list(range(20))
    assert got(spark, rows, tree_most=4, prefix_from=0) == list(range(20))


def test_links_are_exact_near_the_threshold(spark):
    rnd = random.Random(7)
    rows = []
    for d in range(200):
        words = [f"w{d}x{i}" for i in range(300)]
        rows += [(d, " ".join(words)), (1000 + d, " ".join(changed(rnd, words, 0.70 + d / 1000)))]
    rows += [(3000, "a b c d e f g h"), (3001, "a b c d e f g h i"), (3002, " ".join(["r s t u v w x y z"] * 50)), (3003, "r s t u v w x y z r s t u v")]
    want = survivors(rows)
    assert 250 < len(want) < 400
    assert got(spark, rows) == want


def test_template_texts_are_not_compared(spark, monkeypatch):
    """Texts that share 70 % of their shingles are no near copies: the shared part must not bring them together, the pairs planted among them must be found."""
    template = [f"t{i}" for i in range(140)]
    rows = [(d, " ".join(template + [f"o{d}x{i}" for i in range(60)])) for d in range(600)]
    rows += [(1000 + d, rows[d][1] + " and more") for d in range(0, 600, 50)]
    seen = []
    real = S.prefix_groups
    monkeypatch.setattr(S, "prefix_groups", lambda *a: seen.append(real(*a)) or seen[-1])
    assert got(spark, rows, prefix_from=0) == list(range(600))
    assert sum(1 for _ in seen) == 1 and seen[0].select("node").distinct().count() <= 24


def test_prefixes_of_sets():
    """Every pair at the similarity shares a shingle of both prefixes, whatever the order."""
    rnd = random.Random(3)
    import numpy as np

    for _ in range(300):
        n, more = rnd.randrange(1, 60), rnd.randrange(0, 15)
        a = rnd.sample(range(100), n)
        b = a[: n - rnd.randrange(0, min(n, 8))] + list(range(200, 200 + more))
        if len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)):
            cut = lambda x: set(sorted(x)[: len(x) - int(np.ceil(0.8 * len(x) - 1e-9)) + 1])
            assert cut(a) & cut(b)
