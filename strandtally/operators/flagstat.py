"""The sixteen flag statistics in both QC categories, over any DataFrame of records.

Records have integer columns flag, mapq, ref_id and next_ref_id.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandtally.functions.flags import COUNTERS, FAILED, HIGH_MAPQ, NAMES, PASSED, TOTALS
from strandtally.functions import flags

FIELDS = ("flag", "mapq", "ref_id", "next_ref_id")


def _sums(weight: str | None = None) -> list[Column]:
    """One conditional count, or sum of weights, per total, in the order of TOTALS."""

    def one(predicate: str) -> Column:
        if weight is None:
            return F.count_if(F.expr(predicate))
        return F.coalesce(F.sum(F.expr(f"CASE WHEN {predicate} THEN {weight} ELSE 0 END")), F.lit(0)).cast("long")

    return [one(f"{c.predicate} AND {qc}").alias(f"{c.name}_{name}") for c in COUNTERS for name, qc in (("pass", PASSED), ("fail", FAILED))]


def counters(records: DataFrame, *keys: str | Column, also: Sequence[Column] = ()) -> DataFrame:
    """The 32 totals, and other aggregates, of all records or for each combination of keys, in one pass."""
    return records.groupBy(*keys).agg(*_sums(), *also)


def merge(partials: DataFrame, *keys: str) -> DataFrame:
    """Totals of partial totals."""
    return partials.groupBy(*keys).agg(*[F.coalesce(F.sum(t), F.lit(0)).cast("long").alias(t) for t in TOTALS])


def preaggregated(records: DataFrame) -> DataFrame:
    """The totals by way of counts of distinct (flag, mate elsewhere, high quality), at most 16,384 rows."""
    groups = records.groupBy("flag", (F.col("ref_id") != F.col("next_ref_id")).alias("elsewhere"), (F.col("mapq") >= HIGH_MAPQ).alias("high")).agg(F.count("*").alias("n"))
    # a group stands for records with these representative values
    stand_in = groups.select("flag", "n", F.lit(0).alias("ref_id"), F.col("elsewhere").cast("int").alias("next_ref_id"), F.when(F.col("high"), HIGH_MAPQ).otherwise(0).alias("mapq"))
    return stand_in.agg(*_sums("n"))


def arrow_partials(records: DataFrame) -> DataFrame:
    """A row of totals for each task, computed with numpy on Arrow batches."""

    def run(batches):
        total = np.zeros(len(TOTALS), np.int64)
        for batch in batches:
            flag, mapq, ref, mate = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            off = lambda bits, flag=flag: (flag & bits) == 0
            primary, mapped = off(flags.SECONDARY | flags.SUPPLEMENTARY), off(flags.UNMAP)
            pair = primary & ~off(flags.PAIRED)
            both = pair & mapped & off(flags.MUNMAP)
            elsewhere, dup, second = both & (ref != mate), ~off(flags.DUP), ~off(flags.SECONDARY)
            by_name = {
                "n_reads": np.ones(len(flag), bool), "n_mapped": mapped, "n_pair_all": pair, "n_pair_map": both,
                "n_pair_good": pair & mapped & ~off(flags.PROPER), "n_sgltn": pair & mapped & ~off(flags.MUNMAP), "n_read1": pair & ~off(flags.READ1), "n_read2": pair & ~off(flags.READ2),
                "n_dup": dup, "n_diffchr": elsewhere, "n_diffhigh": elsewhere & (mapq >= HIGH_MAPQ), "n_secondary": second,
                "n_supp": ~second & ~off(flags.SUPPLEMENTARY), "n_primary": primary, "n_pmapped": primary & mapped, "n_pdup": primary & dup,
            }
            failed = ~off(flags.QCFAIL)
            total += [int(np.count_nonzero(by_name[n] & side)) for n in NAMES for side in (~failed, failed)]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in total], list(TOTALS))

    return records.select(*FIELDS).mapInArrow(run, ", ".join(f"{t} long" for t in TOTALS))


def by_arrow(records: DataFrame) -> DataFrame:
    return merge(arrow_partials(records))


ENGINES = {"catalyst": counters, "preagg": preaggregated, "arrow": by_arrow}


def flagstat(records: DataFrame, engine: str = "catalyst") -> DataFrame:
    """The 32 totals by the engine named; an unknown name is an error."""
    if engine not in ENGINES:
        raise ValueError(f"unknown engine {engine!r}; there are {', '.join(ENGINES)}")
    return ENGINES[engine](records)


def long_form(totals: DataFrame, *keys: str) -> DataFrame:
    """(keys, counter, qc_pass, qc_fail) from wide totals."""
    rows = F.array(*[F.struct(F.lit(n).alias("counter"), F.col(f"{n}_pass").alias("qc_pass"), F.col(f"{n}_fail").alias("qc_fail")) for n in NAMES])
    return totals.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def by_qc(records: DataFrame) -> DataFrame:
    """A row for each QC category, both always present."""
    totals = counters(records)
    rows = F.array(*[F.struct(F.lit(q).alias("category"), *[F.col(f"{n}_{q}").alias(n) for n in NAMES]) for q in ("pass", "fail")])
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def compare(records: DataFrame) -> DataFrame:
    """(counter, qc_pass, qc_fail, engines_agree) over all engines."""
    rows = [long_form(flagstat(records, e)).withColumnsRenamed({"qc_pass": f"pass_{e}", "qc_fail": f"fail_{e}"}) for e in ENGINES]
    joined = reduce(lambda a, b: a.join(b, "counter"), rows)
    same = lambda side: (F.col(f"{side}_catalyst") == F.col(f"{side}_preagg")) & (F.col(f"{side}_catalyst") == F.col(f"{side}_arrow"))
    return joined.select("counter", F.col("pass_catalyst").alias("qc_pass"), F.col("fail_catalyst").alias("qc_fail"), (same("pass") & same("fail")).alias("engines_agree"))


def check_engines(records: DataFrame) -> None:
    """Raise if the engines' totals differ."""
    bad = [r.counter for r in compare(records).where("not engines_agree").collect()]
    if bad:
        raise ValueError(f"totals differ between engines: {', '.join(bad)}")


def _share(n: Column, of: Column) -> Column:
    return F.when(of == 0, "N/A").otherwise(F.concat(F.regexp_replace(F.format_number(100.0 * n / F.when(of == 0, 1).otherwise(of), 2), ",", ""), F.lit("%")))


def report(totals: DataFrame) -> DataFrame:
    """(line_no, line): the sixteen lines of the report, from one row of totals."""
    lines = []
    for c in sorted(COUNTERS, key=lambda c: c.line):
        good, bad = F.col(f"{c.name}_pass"), F.col(f"{c.name}_fail")
        text = F.concat(good.cast("string"), F.lit(" + "), bad.cast("string"), F.lit(f" {c.label}"))
        if c.share_of:
            text = F.concat(text, F.lit(" ("), _share(good, F.col(f"{c.share_of}_pass")), F.lit(" : "), _share(bad, F.col(f"{c.share_of}_fail")), F.lit(")"))
        lines.append(F.struct(F.lit(c.line).alias("line_no"), text.alias("line")))
    return totals.select(F.explode(F.array(*lines)).alias("r")).select("r.*")


def report_text(totals: DataFrame) -> str:
    """The report with a line feed after each line."""
    return "".join(r.line + "\n" for r in report(totals).orderBy("line_no").collect())
