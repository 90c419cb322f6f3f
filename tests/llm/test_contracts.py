"""The registered queries over a whole small table, held against plain versions."""

import re
import zlib

import pytest

import oracle
from pairloom.llm import registry
from test_repeats import brute_bytes, brute_words
from test_simhash import brute
from test_quality import brute as brute_base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, name):
    return registry.queries()[name](spark, SF).toPandas()


def test_all_are_registered():
    assert sorted(m[1] for k in registry.queries() if (m := re.match(r"(op\d+)_", k))) == sorted(f"op{n}" for n in range(1, 14))
    assert "pipeline" in registry.queries() and set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    oracle.compare(spark, SF, registry.queries()[name], registry.oracle_sql()[name])


def test_op1(spark, rows):
    out = run(spark, "op1_quality")
    got = out[["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]].itertuples(index=False, name=None)
    assert sorted(got) == sorted((d, *brute_base(t)) for d, t in rows)
    assert not (out["kept"] & out["base_failed"]).any() and out["kept"].mean() > 0.5


def test_op2(spark, rows):
    out = run(spark, "op2_simhash")
    assert sorted(out[["doc_id", "fingerprint", "component_id"]].itertuples(index=False, name=None), key=repr) == brute(rows)


def test_op5(spark, rows):
    out = run(spark, "op5_suffix")[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]]
    assert sorted(out.itertuples(index=False, name=None), key=repr) == brute_bytes(rows, 400)


def test_op6(spark, rows):
    out = run(spark, "op6_substring")[["doc_id", "n_words", "n_removed", "kept_sha256"]]
    assert sorted(out.itertuples(index=False, name=None), key=repr) == brute_words(rows, 50)


def test_op8(spark, rows):
    norm = lambda t: " " + " ".join(re.sub(r"[!-/:-@\[-`{-~]", "", t).lower().split()) + " "
    items = [(r["item_id"], norm(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = run(spark, "op8_leaks")
    assert {(d, i) for d, t in rows for i, x in items if x in norm(t)} <= set(zip(out["doc_id"], out["item_id"]))
    assert out["doc_id"].nunique() < 0.2 * len(rows)


def test_op9(spark, rows):
    out = run(spark, "op9_toxicity")
    assert len(out) == len(rows) and out["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(out["doc_id"], out["held_out"]))
    assert ((out["score"] >= 0.5) == (out["predicted"] == 1)).all()


def test_op10(spark, rows):
    out = run(spark, "op10_hmm")
    assert len(out) == len(rows) and all(h == (zlib.crc32(str(d).encode()) % 7 == 2) for d, h in zip(out["doc_id"], out["held_out"]))
    held = out[out["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()
