"""``python -m palaver.cli COMMAND``: diagnose, prune, brief, rules-status and discover."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Observation, SparkSession

from palaver import api
from palaver.functions import patterns as P
from palaver.operators.store import RuleStore
from palaver.plans import prune as plans
from palaver.settings import settings
from palaver.sinks import outputs
from palaver.sources import files

#: Rows shown at most.
SHOWN = 60


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palaver", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("diagnose", "prune", "brief"):
        c = commands.add_parser(name)
        c.add_argument("paths", nargs="+", help="files or folders; - for the standard input")
        c.add_argument("--verbatim", type=int, default=settings().verbatim)
        c.add_argument("--rx", choices=sorted(P.PRESCRIPTIONS), default="aggressive" if name == "brief" else "standard")
        c.add_argument("--output", help="folder for the result, which replaces the one before it as a whole; without it, a few rows are shown")
        c.add_argument("--warn-size", type=int, nargs="?", const=P.WARN_INPUT_CHARS, default=P.WARN_INPUT_CHARS, help="tell if inputs have more characters")
        c.add_argument("--rejects", help="folder for what is no turn, with the reasons")
    commands.add_parser("rules-status").add_argument("store", nargs="?", help="folder of the store; by default as the settings say")
    commands.add_parser("discover").add_argument("path")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("palaver").getOrCreate()
    if args.command == "rules-status":
        out = api.rules_status(RuleStore(spark, args.store))
    elif args.command == "discover":
        out = files.list_files(spark, args.path)
        config = files.host_config()
        print(f"Host configuration: {config}, servers: {', '.join(files.configured_servers(config)) or 'none'}" if config else "Host configuration: not found")
    else:
        told = Observation("inputs")
        turns, rejects = api.load_with_rejects(spark, args.paths, None, told, args.warn_size)
        if args.command == "prune":
            for row in plans.prune_summary(turns, args.verbatim, args.rx).limit(SHOWN).collect():
                print(f"{row.conv_id}\n{row.summary}", file=sys.stderr)
        out = {"diagnose": lambda: plans.diagnosis_text(turns, args.verbatim), "prune": lambda: api.prune_conversation(turns, args.verbatim, args.rx)[0], "brief": lambda: api.create_briefing(turns, args.verbatim, args.rx)}[args.command]()
    if getattr(args, "output", None):
        outputs.write_output(out, args.output)
    else:
        out.show(SHOWN, truncate=False)
    if args.command in ("diagnose", "prune", "brief"):
        seen = told.get
        if seen["oversize"]:
            print(f"Warning: {seen['oversize']} inputs have over {args.warn_size:,} characters, the largest, {seen['largest']}, has {seen['largest_chars']:,}; processing may be slow.", file=sys.stderr)
        if args.rejects:
            outputs.write_output(rejects, args.rejects)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
