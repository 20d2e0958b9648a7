"""The whole run from two sources to a report: ``python -m kinspark.plans.pipeline ROOT --first F --second S``.

One session; each step reads and writes tables of the catalog, so a run can start at any
step, or be one step alone (``--only-step train --models logistic``, ``--only-step evaluate``,
``--only-step lines --mode candidates``). A failing step ends the process with a failure.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from ..matching import models
from ..operators import blocking, groundtruth, mediate, serialize
from ..session import session
from ..sources import io
from ..sources.io import Catalog

STEPS = ("mediate", "ground_truth", "block", "lines", "train", "evaluate", "compare")


def run_step(spark: SparkSession, step: str, c: Catalog, first: str | None, second: str | None, strategies: list[str], mode: str = "all", chosen: list[str] | None = None) -> None:
    read = lambda p: io.read_table(spark, p)
    if step == "mediate":
        # Descriptions have line ends, so a CSV file is one task; it is read once, here.
        a = mediate.clean_first(io.read_csv(spark, first, multi_line=True, doubles=mediate.FIRST_NUMBERS))
        b = io.read_csv(spark, second, multi_line=True, doubles=mediate.SECOND_NUMBERS)
        b = mediate.clean_second(b, [x for x in ("vin", "listed_date", "price", "mileage") if x in b.columns])
        io.write_table(mediate.mediate(a, b), c.mediated)
    elif step == "ground_truth":
        io.write_table(groundtruth.clean_by_vin(read(c.mediated)), c.cleaned)
        io.write_table(groundtruth.split(groundtruth.ground_truth(read(c.cleaned))), f"{c.truth}/all")
        for s in io.SPLITS:
            io.write_table(read(f"{c.truth}/all").where(f"split = '{s}'").drop("split"), c.split(s))
    elif step == "block":
        for s in strategies:
            io.write_table(blocking.block(read(c.split("test")), s), c.candidates(s))
            io.write_json(blocking.blocking_stats(read(c.split("test")), s).first().asDict(), c.stats(s))
    elif step == "lines":
        for s in io.SPLITS if mode in ("all", "splits") else ():
            io.write_lines(serialize.pair_lines(read(c.split(s))), c.lines(s))
        for s in strategies if mode in ("all", "candidates") else ():
            io.write_lines(serialize.pair_lines(read(c.candidates(s))), c.lines(s))
    elif step == "train":
        for name in chosen or models.FITS:
            fit = models.FITS[name]
            fit(read(c.split("train")), read(c.split("val"))).save(c.model(name), c.meta(name))
    elif step == "evaluate":
        io.write_json([models.evaluate(f, read(c.split("test"))) for f in saved(spark, c).values()], c.evaluation)
    elif step == "compare":
        io.write_json(models.compare(*(read(c.split(s)) for s in io.SPLITS), strategies=tuple(strategies), fitted=saved(spark, c)), c.report)


def saved(spark: SparkSession, c: Catalog) -> dict[str, models.Fitted]:
    """The models that the catalog has, as they were fitted."""
    return {name: models.load(spark, c.model(name), c.meta(name)) for name in models.FITS}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("root")
    p.add_argument("--first")
    p.add_argument("--second")
    p.add_argument("--from-step", choices=STEPS, default=STEPS[0])
    p.add_argument("--only-step", choices=STEPS)
    p.add_argument("--strategies", nargs="+", choices=io.STRATEGIES, default=list(io.STRATEGIES))
    p.add_argument("--mode", choices=("all", "splits", "candidates"), default="all", help="what the step lines writes")
    p.add_argument("--models", nargs="+", choices=list(models.FITS), help="which models the step train fits")
    a = p.parse_args(args)
    spark, c = session("kinspark-pipeline"), Catalog(a.root)
    c.ensure()
    for step in [a.only_step] if a.only_step else STEPS[STEPS.index(a.from_step) :]:
        began = time.perf_counter()
        run_step(spark, step, c, a.first, a.second, a.strategies, a.mode, a.models)
        print(f"{step}: {time.perf_counter() - began:.1f} s")


if __name__ == "__main__":
    main()
