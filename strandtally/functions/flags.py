"""Alignment flags and the sixteen flag statistics, declared once for all engines."""

from __future__ import annotations

from dataclasses import dataclass

# Flag bits of the alignment format.
PAIRED = 0x001
PROPER = 0x002
UNMAP = 0x004
MUNMAP = 0x008
READ1 = 0x040
READ2 = 0x080
SECONDARY = 0x100
QCFAIL = 0x200
DUP = 0x400
SUPPLEMENTARY = 0x800

#: Least mapping quality of the last statistic.
HIGH_MAPQ = 5


def _on(bit: int) -> str:
    return f"(flag & {bit}) <> 0"


def _off(bit: int) -> str:
    return f"(flag & {bit}) = 0"


_PRIMARY = f"{_off(SECONDARY | SUPPLEMENTARY)}"
_PAIR = f"{_PRIMARY} AND {_on(PAIRED)}"
_BOTH = f"{_PAIR} AND {_off(UNMAP | MUNMAP)}"
_ELSEWHERE = f"{_BOTH} AND ref_id <> next_ref_id"


@dataclass(frozen=True)
class Counter:
    name: str
    predicate: str  #: SQL over flag, mapq, ref_id, next_ref_id; valid in Spark and other engines
    line: int  #: in the report
    label: str
    share_of: str | None = None  #: the counter that is 100 %


# The statistics in the order of their totals; line, label and denominator of the report.
COUNTERS = (
    Counter("n_reads", "TRUE", 1, "in total (QC-passed reads + QC-failed reads)"),
    Counter("n_mapped", _off(UNMAP), 7, "mapped", "n_reads"),
    Counter("n_pair_all", _PAIR, 9, "paired in sequencing"),
    Counter("n_pair_map", _BOTH, 13, "with itself and mate mapped"),
    Counter("n_pair_good", f"{_PAIR} AND {_on(PROPER)} AND {_off(UNMAP)}", 12, "properly paired", "n_pair_all"),
    Counter("n_sgltn", f"{_PAIR} AND {_on(MUNMAP)} AND {_off(UNMAP)}", 14, "singletons", "n_pair_all"),
    Counter("n_read1", f"{_PAIR} AND {_on(READ1)}", 10, "read1"),
    Counter("n_read2", f"{_PAIR} AND {_on(READ2)}", 11, "read2"),
    Counter("n_dup", _on(DUP), 5, "duplicates"),
    Counter("n_diffchr", _ELSEWHERE, 15, "with mate mapped to a different chr"),
    Counter("n_diffhigh", f"{_ELSEWHERE} AND mapq >= {HIGH_MAPQ}", 16, "with mate mapped to a different chr (mapQ>=5)"),
    Counter("n_secondary", _on(SECONDARY), 3, "secondary"),
    Counter("n_supp", f"{_off(SECONDARY)} AND {_on(SUPPLEMENTARY)}", 4, "supplementary"),
    Counter("n_primary", _PRIMARY, 2, "primary"),
    Counter("n_pmapped", f"{_PRIMARY} AND {_off(UNMAP)}", 8, "primary mapped", "n_primary"),
    Counter("n_pdup", f"{_PRIMARY} AND {_on(DUP)}", 6, "primary duplicates"),
)
NAMES = tuple(c.name for c in COUNTERS)
TOTALS = tuple(f"{n}_{q}" for n in NAMES for q in ("pass", "fail"))
FAILED = _on(QCFAIL)
PASSED = _off(QCFAIL)
