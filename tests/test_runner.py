import pytest

from pairloom.plans import runner as R


def steps(log, bad=False, n=3):
    def make(name, f):
        def run(spark, inputs):
            log.append(name)
            return f(spark, inputs)

        return run

    def fails(spark, inputs):
        raise KeyError("x")

    return [
        R.Step("c", make("c", fails if bad else lambda s, i: i["a"].join(i["b"], "id")), ("a", "b")),
        R.Step("a", make("a", lambda s, i: s.range(n)), settings={"n": n}),
        R.Step("b", make("b", lambda s, i: i["a"].selectExpr("id", "id * 2 AS x")), ("a",)),
    ]


def test_order_failure_resume_and_dry_run(spark, tmp_path):
    out, log = str(tmp_path / "run"), []
    assert [r["state"] for r in R.execute(spark, steps(log), out, dry_run=True)] == ["planned"] * 3 and not log
    with pytest.raises(R.StepFailed, match="step c"):
        R.execute(spark, steps(log, bad=True), out)
    assert log == ["a", "b", "c"]
    log.clear()
    got = R.execute(spark, steps(log), out, resume=True, checksums=True)
    assert log == ["c"] and [(r["name"], r["state"], r["rows"]) for r in got] == [("a", "resumed", 3), ("b", "resumed", 3), ("c", "written", 3)]
    log.clear()
    assert [r["state"] for r in R.execute(spark, steps(log, n=5), out, resume=True)] == ["written"] * 3  # another setting
    assert spark.read.parquet(f"{out}/c/table").count() == 5
    log.clear()
    assert [r["state"] for r in R.execute(spark, steps(log, n=5), out, resume=True, dry_run=True)] == ["resumed"] * 3 and not log


def test_wrong_steps():
    a = R.Step("a", None, ("z",))
    for bad in ([a], [a, a], [R.Step("x", None, ("y",)), R.Step("y", None, ("x",))]):
        with pytest.raises(ValueError):
            R.ordered(bad)


def test_command_line(tmp_path):
    args = ["--tables", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")]
    assert [r["name"] for r in R.main([*args, "--steps", "summary", "--dry-run"])] == ["windows", "structures", "calibrated", "proposals", "regions", "annotated", "summary"]
    with pytest.raises(SystemExit):
        R.main([*args, "--steps", "nothing"])


def test_detection_goes_on_from_its_own_tables(spark, tmp_path):
    """After the first steps the raw tables may be gone: a resumed run reads what the steps wrote."""
    import shutil

    tables, out = str(tmp_path / "tables"), str(tmp_path / "run")
    shutil.copytree("/root/testdata/sf0.001", tables)
    steps = R.detection(tables)
    R.execute(spark, [s for s in steps if s.name in ("windows", "structures")], out)
    for name in ("lineitem", "part"):
        (tmp_path / "tables" / f"{name}.parquet").chmod(0o644)
        (tmp_path / "tables" / f"{name}.parquet").write_bytes(b"no table")
    got = {r["name"]: (r["state"], r["rows"]) for r in R.execute(spark, steps, out, resume=True)}
    assert got["windows"][0] == got["structures"][0] == "resumed" and got["summary"] == ("written", 1)
    assert got["regions"] == got["annotated"] and got["regions"][1] > 0 and got["recall"][1] > 1
