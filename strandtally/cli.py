"""Command line: ``python -m strandtally.cli flagstat INPUT.bam [options]``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from strandtally.operators.coverage import check_coverage, metrics_coverage, stage_times
from strandtally.operators.flagstat import ENGINES, FIELDS, check_engines, flagstat, report_text
from strandtally.shared import new_path
from strandtally.sources import datasource
from strandtally.sources.datasource import scan_metrics

PROGRAM = "strandtally"


class _Once(argparse.Action):
    """An option that may be given once."""

    def __call__(self, parser, namespace, values, option_string=None):
        if getattr(namespace, f"_{self.dest}", False):
            parser.error(f"{option_string} is given more than once")
        setattr(namespace, f"_{self.dest}", True)
        setattr(namespace, self.dest, values)


def _bounded(least: int, most: int):
    def parse(text: str) -> int:
        if not text.isdigit() or not least <= int(text) <= most:
            raise argparse.ArgumentTypeError(f"{text!r} is not a number from {least} to {most}")
        return int(text)

    return parse


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog=PROGRAM, allow_abbrev=False)
    one = top.add_subparsers(dest="command", required=True).add_parser("flagstat", allow_abbrev=False)
    one.add_argument("input", metavar="INPUT.bam")
    one.add_argument("--engine", choices=list(ENGINES), default="catalyst", action=_Once)
    one.add_argument("--bai", metavar="PATH", action=_Once, help="default: INPUT.bam.bai")
    one.add_argument("--max-uncompressed-bytes", type=_bounded(1, (1 << 32) - 1), default=256 << 20, action=_Once)
    one.add_argument("--threads", type=_bounded(1, 1 << 16), default=8, action=_Once, help="of a local session")
    one.add_argument("--benchmark", action="store_true", help="print coverage and times to stderr")
    one.add_argument("--validate", action="store_true", help="compare all engines")
    return top


def run(args: argparse.Namespace, spark: SparkSession) -> str:
    datasource.register(spark)
    options = {"maxUncompressedBytes": args.max_uncompressed_bytes} | ({"bai": args.bai} if args.bai else {})
    folder = new_path(spark, "metrics") if args.benchmark else None
    load = lambda **more: spark.read.format("bam").schema(datasource.schema_of(*FIELDS)).options(**options, **more).load(args.input)
    records = load(metrics=folder) if folder else load()
    took: dict[str, float] = {}

    def timed(stage: str, work):
        began = time.monotonic()
        out = work()
        took[stage] = time.monotonic() - began
        return out

    if args.validate:
        timed("validation", lambda: check_engines(load()))
    out = timed("scan and totals", lambda: report_text(flagstat(records, args.engine)))
    if args.benchmark:
        metrics = scan_metrics(spark, folder).cache()
        covered = metrics_coverage(metrics)
        check_coverage(covered)
        rows = covered.collect()
        total = lambda name: sum(r[name] for r in rows)
        print(f"master {spark.sparkContext.master}, parallelism {spark.sparkContext.defaultParallelism}, engine {args.engine}", file=sys.stderr)
        print(f"files {len(rows)}, splits {total('splits')}, index reads {total('index_reads')}, anchors {total('anchors')}, spans {total('spans')}, members {total('members')}", file=sys.stderr)
        print(f"records {total('records')}, inflated bytes {total('inflated_bytes')}, compressed bytes {total('compressed_bytes')}", file=sys.stderr)
        print("seconds: " + ", ".join(f"{k} {v:.3f}" for k, v in took.items()) + "; starts of sessions are in the first", file=sys.stderr)
        by_stage = {r.stage: r for r in stage_times(metrics).collect()}
        for stage in datasource.STAGES:
            print(f"stage {stage}: {by_stage[stage].total_s:.3f} s in all splits, {by_stage[stage].longest_s:.3f} s in the longest", file=sys.stderr)
        print(f"throughput {total('inflated_bytes') / max(took['scan and totals'], 1e-9) / 1e9:.3f} GB/s of inflated bytes", file=sys.stderr)
        metrics.unpersist()
        if args.validate:
            print("validation: all engines agree", file=sys.stderr)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        session = spark or SparkSession.builder.master(f"local[{args.threads}]").appName(PROGRAM).config("spark.ui.enabled", "false").getOrCreate()
        print(run(args, session), end="")
        return 0
    except Exception as e:
        print(f"{PROGRAM}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
