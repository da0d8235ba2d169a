"""Golden totals, the report, and agreement of the engines."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandtally.functions.flags import COUNTERS, NAMES, TOTALS
from strandtally.operators.flagstat import ENGINES, check_engines, compare, flagstat, report_text

SCHEMA = "flag int, mapq int, ref_id int, next_ref_id int"
RECORDS = [(0xD00, 60, 0, 0), (0x043, 4, 0, 1), (0x081, 5, 0, 1), (0x604, 0, -1, -1)]
GOLDEN = {"n_reads": (3, 1), "n_secondary": (1, 0), "n_supp": (0, 0), "n_primary": (2, 1), "n_diffchr": (2, 0), "n_diffhigh": (1, 0), "n_dup": (1, 1), "n_pdup": (0, 1), "n_mapped": (3, 0)}


def by_hand(records):
    """The totals, record by record."""
    out = dict.fromkeys(TOTALS, 0)
    for flag, mapq, ref, mate in records:
        side = "fail" if flag & 0x200 else "pass"
        names = ["n_reads"]
        mapped = not flag & 4
        names += ["n_mapped"] * mapped + ["n_dup"] * bool(flag & 0x400)
        if flag & 0x100:
            names.append("n_secondary")
        elif flag & 0x800:
            names.append("n_supp")
        else:
            names += ["n_primary"] + ["n_pmapped"] * mapped + ["n_pdup"] * bool(flag & 0x400)
            if flag & 1:
                names += ["n_pair_all"] + ["n_read1"] * bool(flag & 0x40) + ["n_read2"] * bool(flag & 0x80)
                if mapped:
                    names += ["n_pair_good"] * bool(flag & 2) + (["n_sgltn"] if flag & 8 else ["n_pair_map"])
                    if not flag & 8 and ref != mate:
                        names += ["n_diffchr"] + ["n_diffhigh"] * (mapq >= 5)
        for n in names:
            out[f"{n}_{side}"] += 1
    return out


@pytest.mark.parametrize("engine", list(ENGINES))
def test_golden(spark, engine):
    row = flagstat(spark.createDataFrame(RECORDS, SCHEMA), engine).first()
    for name, (good, bad) in GOLDEN.items():
        assert (row[f"{name}_pass"], row[f"{name}_fail"]) == (good, bad), name


@pytest.mark.parametrize("engine", list(ENGINES))
def test_no_records(spark, engine):
    totals = flagstat(spark.createDataFrame([], SCHEMA), engine)
    assert set(totals.first()) == {0}
    lines = report_text(totals).splitlines()
    assert len(lines) == 16
    assert lines[6] == "0 + 0 mapped (N/A : N/A)"


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 65535), st.integers(0, 255), st.integers(-1, 3), st.integers(-1, 3)), max_size=40))
def test_engines_agree(spark, records):
    frame = spark.createDataFrame(records, SCHEMA)
    assert flagstat(frame).first().asDict() == by_hand(records)
    assert compare(frame).where("not engines_agree").count() == 0
    check_engines(frame)


def test_unknown_engine(spark):
    with pytest.raises(ValueError, match="unknown engine"):
        flagstat(spark.createDataFrame([], SCHEMA), "gpu")


def test_recorded_report(spark):
    """Totals of a well-known sample give its recorded report, byte for byte."""
    known = {"n_reads": 10633980, "n_primary": 10633980, "n_mapped": 10457612, "n_pmapped": 10457612, "n_pair_all": 10633980, "n_read1": 5317145, "n_read2": 5316835, "n_pair_good": 10254964, "n_pair_map": 10281244, "n_sgltn": 176368, "n_diffchr": 22494, "n_diffhigh": 22392}
    totals = spark.createDataFrame([tuple(known.get(n, 0) if q == "pass" else 0 for n in NAMES for q in ("pass", "fail"))], ", ".join(f"{t} long" for t in TOTALS))
    assert hashlib.sha256(report_text(totals).encode()).hexdigest() == "dae9929278b2da62aec0393030a63dfcafa32a26dfd218242c037075c98cf113"


def test_report_lines_are_a_permutation():
    assert sorted(c.line for c in COUNTERS) == list(range(1, 17))


def test_share_rounds_half_to_even(spark):
    totals = {"n_reads_pass": 128, "n_mapped_pass": 100, "n_reads_fail": 300000, "n_mapped_fail": 299999}
    frame = spark.createDataFrame([tuple(totals.get(t, 0) for t in TOTALS)], ", ".join(f"{t} long" for t in TOTALS))
    assert "100 + 299999 mapped (78.12% : 100.00%)" in report_text(frame)
