import random
import re

import corpus_pipeline as P
from pairloom.llm import common as C
from pairloom.llm import leaks, quality, simhash
from pairloom.llm.common import documents

SF = "/root/testdata/sf0.001"


def jaccard(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_near_copies_go_and_clean_documents_stay(spark):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(500)]
    rows, near, low = [], {}, []
    for d in range(60):
        text = [rnd.choice(vocab) for _ in range(rnd.randrange(30, 400))]
        rows.append((d, " ".join(text), "x"))
        for k in range(rnd.randrange(4)):
            copy = list(text)
            for _ in range(len(copy) // 150):
                copy[rnd.randrange(len(copy))] = "new"
            if jaccard(text, copy) >= 0.88:
                rows.append((1000 + 10 * d + k, " ".join(copy), "x"))
                near[1000 + 10 * d + k] = d
            half = text[: len(text) // 2] + [rnd.choice(vocab) for _ in range(len(text))]
            rows.append((5000 + 10 * d + k, " ".join(half), "x"))
            low.append(5000 + 10 * d + k)
    rows += [(9000, None, "x"), (9001, " ", "x"), rows[0], (None, "only one of these", "x"), (None, "only one of these", "y"), (None, "another text without a number", "x")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, node string, d int, low int, row int").repartition(3)
    for most in (2, 256):
        got = simhash.representatives(df, tree_most=most)
        assert got.columns == df.columns
        ids = [r["doc_id"] for r in got.collect()]
        assert set(range(60)) <= set(ids) and not set(near) & set(ids) and set(low) <= set(ids)
        assert 9000 in ids and 9001 not in ids and ids.count(None) == 2 and len(set(ids)) == len(ids) - 1
    assert simhash.representatives(df.limit(0)).count() == 0


def test_stages(spark):
    docs = documents(spark, SF)
    assert [len(P.STAGES), P.STAGES[1][0]] == [5, "near duplicates"]
    kept = P.quality_rules(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = quality.score(docs, labels).where("kept").select("doc_id")
    assert kept.columns == docs.columns and kept.select("doc_id").exceptAll(want).count() == 0 == want.exceptAll(kept.select("doc_id")).count()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = P.decontamination(spark, docs, SF)
    bad = leaks.leaks(docs, bench).select("doc_id").distinct()
    assert clean.columns == docs.columns and clean.count() + docs.join(bad, "doc_id").count() == docs.count()
    norm = lambda t: " ".join(re.sub(r"[^\w\s]", "", t).lower().split())
    items = [norm(r["text"]) for r in bench.collect()]
    plain = {r["doc_id"] for r in docs.collect() if any(f" {i} " in f" {norm(r['text'])} " for i in items)}
    assert plain and plain <= {r[0] for r in bad.collect()}


def test_run(spark):
    out = P.run(spark, SF).collect()
    assert sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)
    assert [r["start"] for r in sorted(out, key=lambda r: r["start"])] == sorted(r["start"] for r in out)


def test_stages_keep_columns_of_any_name_and_empty_tables(spark):
    """Null, empty and repeated rows, clashing names and tables without rows, through every stage in turn."""
    docs = documents(spark, SF).limit(40)
    more = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", None, 0), (900002, "word " * 3, None, "s", 15)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("doc_id", "text", "lang", "source", docs["n_chars"].cast("long").alias("n_chars")).unionByName(more)
    docs = docs.selectExpr("*", "1 AS row", "2 AS d", "3 AS shard", "4 AS item_id", "5 AS score", "6 AS node", "7 AS `a b`").repartition(3)
    for table in (docs, docs.limit(0)):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == docs.columns, name
            table = P.common.stored(out, "t")
        out = P.STAGES[-1][1](spark, table, SF)
        assert out.count() == table.count()
    whole = P.near_duplicates(spark, docs, SF).collect()
    assert sum(r["doc_id"] is None for r in whole) + sum(r["doc_id"] == 900001 for r in whole) == 1  # texts without words are one group
    assert sum(r["doc_id"] == 900002 for r in whole) == 1
    assert P.decontamination(spark, docs, SF).where("doc_id IS NULL").count() == 2


def test_recall_of_near_copies_in_large_shards(spark):
    """More than 256 different texts on one passage, of any similarity, in one shard: survivors are those of exact similarities."""
    from test_near_copies import survivors

    rnd = random.Random(12)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for d in range(330):
        own = list(passage)
        for _ in range(rnd.randrange(4)):
            own[rnd.randrange(len(own))] = f"own{rnd.randrange(40)}"
        rows.append((d, " ".join(own + [f"tail{d % 30}x{i}" for i in range(rnd.randrange(10))])))
    want = survivors(rows)
    got = sorted(r["doc_id"] for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # links are exact, so at most copies that share no band stay too
    assert set(want) <= set(got) and len(rows) - len(got) >= 0.98 * (len(rows) - len(want)) > 50


def test_runs_beside_each_other_clean_their_own(spark):
    import threading

    mark, left = C.written(), []
    own = C.stored(spark.range(3), "own")

    def other():
        assert C.written() == 0
        C.stored(spark.range(2), "other")
        C.clean(spark)
        left.append(C.written())

    t = threading.Thread(target=other)
    t.start()
    t.join()
    assert left == [0] and own.count() == 3
    C.clean(spark, mark)
    assert C.written() == mark
