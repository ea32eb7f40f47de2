"""python -m pairloom sweep --to FOLDER [--scenario NAME ...] [--trials N]; python -m pairloom first-direction --rho R [--blocks]"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pairloom import sinks
from pairloom.plans import experiments, stats
from pairloom.session import local_session


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pairloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    sweep = commands.add_parser("sweep", help="run scenarios and write facts, JSON and plot data")
    sweep.add_argument("--to", required=True)
    sweep.add_argument("--scenario", action="append", choices=[s.name for s in experiments.SCENARIOS])
    sweep.add_argument("--trials", type=int)
    first = commands.add_parser("first-direction", help="compare strategies by the first direction of seeded matching")
    first.add_argument("--rho", type=float, required=True)
    first.add_argument("--blocks", action="store_true")
    first.add_argument("--trials", type=int, default=100)
    given = parser.parse_args(args)
    spark = local_session()
    if given.command == "sweep":
        chosen = [s for s in experiments.SCENARIOS if not given.scenario or s.name in given.scenario]
        chosen = [replace(s, trials=given.trials) for s in chosen] if given.trials else chosen
        sinks.write_sweep(experiments.Runner(chosen).facts(spark), given.to)
    else:
        study = (experiments.paired_sbm if given.blocks else experiments.paired_er)(given.rho, trials=given.trials)
        print(sinks.console_summary(stats.h0_summary(study.records(spark))))


if __name__ == "__main__":
    main()
