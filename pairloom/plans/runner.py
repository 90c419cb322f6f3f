"""Staged runs: steps in the order of their inputs, fail-fast, each a written table with a manifest, resumed where it is complete; dry runs; a command line.

    python -m pairloom.plans.runner --tables /path/to/tables --out /path/to/results [--steps windows,regions] [--resume] [--dry-run]
"""

from __future__ import annotations

import argparse
import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.status import table_checksum


@dataclass(frozen=True)
class Step:
    """A named table: run(spark, inputs by name) makes it from those of the steps in `needs`; settings are part of its identity."""

    name: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)


class StepFailed(RuntimeError):
    """The step that failed, with the error it raised as its cause."""


def ordered(steps: list[Step]) -> list[Step]:
    """The steps, each after what it needs; among those that can run, in the order given."""
    names = [s.name for s in steps]
    if len(set(names)) != len(names):
        raise ValueError("two steps have one name")
    out, left = [], list(steps)
    while left:
        ready = next((s for s in left if all(n in {o.name for o in out} for n in s.needs)), None)
        if ready is None:
            raise ValueError(f"needs that no step can meet: {', '.join(sorted({n for s in left for n in s.needs} - {o.name for o in out}))}")
        out.append(ready)
        left.remove(ready)
    return out


def identity(step: Step, marks: dict[str, str]) -> str:
    """A hash of the step's name, settings and inputs; a step is complete only under the identity it would have now."""
    text = json.dumps([step.name, step.settings, [marks[n] for n in step.needs]], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def complete(spark: SparkSession, path: str, mark: str) -> bool:
    """Whether a step's manifest is there, of the same identity."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
        return False
    row = spark.read.json(f"{path}/manifest").first()
    return row is not None and row["identity"] == mark


def execute(spark: SparkSession, steps: list[Step], out: str, resume: bool = False, dry_run: bool = False, checksums: bool = False) -> list[dict]:
    """Runs the steps; one record each: name, identity, state (written, resumed, planned), rows, seconds.

    A step's rows are at out/name/table and count only with out/name/manifest, which is written last. The first failure ends the run and
    names its step; a later run with resume goes on there. A step whose settings or inputs changed runs again, and so do those after it.
    """
    made, marks, records = {}, {}, []
    for step in ordered(steps):
        marks[step.name] = mark = identity(step, marks)
        path, began = f"{out.rstrip('/')}/{step.name}", time.time()
        record = {"name": step.name, "identity": mark, "state": "planned", "rows": None, "checksum": None, "seconds": 0.0}
        if resume and complete(spark, path, mark):
            row = spark.read.json(f"{path}/manifest").first().asDict()
            record |= {"state": "resumed", "rows": row["rows"], "checksum": row.get("checksum")}
        elif not dry_run:
            try:
                gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
                step.run(spark, {n: made[n] for n in step.needs}).write.mode("overwrite").parquet(f"{path}/table")
                table = spark.read.parquet(f"{path}/table")
                record |= {"state": "written", "rows": table.count(), "seconds": round(time.time() - began, 3)}
                if checksums:
                    record["checksum"] = table_checksum(table).first()["checksum"]
                own = spark.createDataFrame([(step.name, mark, record["rows"], record["checksum"], record["seconds"])], "name string, identity string, rows long, checksum string, seconds double")
                own.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/manifest")
            except Exception as e:
                raise StepFailed(f"step {step.name} failed: {type(e).__name__}") from e
        if record["state"] != "planned":
            made[step.name] = spark.read.parquet(f"{path}/table")
        records.append(record)
    return records


def detection(tables: str) -> list[Step]:
    """The detector's run over the test tables: scores of all windows, tails, proposals, regions, annotation and recall. Only the first two steps read the tables."""
    from pairloom.operators import selection as S
    from pairloom.plans import fixtures as X
    from pairloom.plans import score_queries as SQ

    known = {"tables": tables}
    return [
        Step("windows", lambda s, _: X.scale_scores(s, tables), settings=known),
        Step("structures", lambda s, _: X.structures(s, tables), settings=known),
        Step("calibrated", lambda s, i: SQ.tail_scores(i["windows"]), ("windows",)),
        Step("proposals", lambda s, i: S.channel_proposals(i["calibrated"]), ("calibrated",), {"threshold": S.PROPOSED_P}),
        Step("regions", lambda s, i: S.merged_proposals(i["proposals"], SQ.SCALE_NAMES), ("proposals",)),
        Step("annotated", lambda s, i: SQ.annotated(i["regions"], i["structures"]), ("regions", "structures")),
        Step("recall", lambda s, i: SQ.recalled(i["regions"], i["structures"]), ("regions", "structures")),
        Step("summary", lambda s, i: i["annotated"].agg(F.count("*").alias("regions"), F.count_if(F.col("known") > 0).alias("known")), ("annotated",)),
    ]


def main(args: list[str] | None = None) -> list[dict]:
    from pairloom.session import session

    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--tables", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--steps", default="", help="names of the last steps wanted; what they need runs too")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    own = p.parse_args(args)
    steps = detection(own.tables)
    wanted = {n for n in own.steps.split(",") if n} or {s.name for s in steps}
    if unknown := wanted - {s.name for s in steps}:
        p.error(f"no such steps: {', '.join(sorted(unknown))}")
    for s in reversed(ordered(steps)):
        wanted |= set(s.needs) if s.name in wanted else set()
    records = execute(session(), [s for s in steps if s.name in wanted], own.out, own.resume, own.dry_run)
    for r in records:
        print(f"{r['name']}: {r['state']}, {r['rows'] if r['rows'] is not None else '-'} rows, {r['seconds']:.1f} s")
    return records


if __name__ == "__main__":
    main()
