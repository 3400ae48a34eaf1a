"""Plan shapes: what has to stay out of the physical plans, and what has to reach the scan."""

import pytest

from chiasma.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if n not in ("rate_band", "gamma_band", "snp_density", "winsorised_depth", "detection_saturation", "distance_histogram", "marker_expression", "top_barcodes_with_ties", "chromosome_extremes", "resolved_params", "ambient_test", "barcode_calls", "called_lists", "coincidence_axis", "marker_frames", "switch_frames", "density_curves", "smoothed_calls")))
def test_no_theta_join(spark, name):
    """The names left out join a one-row table of thresholds or defaults."""
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["switch_counts", "cell_selection", "refined_breakpoints", "sliding_rate", "marey_map", "feature_density", "threshold_grid", "best_hits"])
def test_python_only_in_the_recurrence(spark, name):
    p = plan(spark, name)
    assert "InArrow" not in p and "Python" not in p


@pytest.mark.parametrize("name", ["refined_breakpoints", "final_blocks", "block_rectangles"])
def test_calling_smooths_once(spark, name):
    p = plan(spark, name)
    # markers move by cell, and smoothed rows, whose partitioning the planner does not know, once more; the chromosomes'
    # sizes are a summary of their own
    assert "Arrow" not in p and p.count("Exchange hashpartitioning") == (1 if name == "refined_breakpoints" else 2)
    assert "SortMergeJoin" not in p


@pytest.mark.parametrize("name", ["interval_merge", "marey_map", "marker_spacing", "false_discovery"])
def test_rows_are_not_ordered_in_one_task(spark, name):
    """Windows are over bins of a chromosome or table, over what bins add up to, over counts of distinct values, or over one
    cell."""
    windows = [line for line in plan(spark, name).splitlines() if line.lstrip(" :+-").startswith("Window [")]
    assert windows
    for line in windows:
        assert any(token in line for token in ("_bin#", "_one#", "_k#", "_q#", "partitionBy(barcode", "windowspecdefinition(barcode#")), line


@pytest.mark.parametrize("name", ["molecule_collapse"])
def test_molecules_are_dealt_by_their_halves(spark, name):
    """Reads are scanned once; molecules move when counted, by each half and when added up, their neighbours never."""
    p = plan(spark, name)
    assert p.count("Scan parquet") == 1 and p.count("Exchange") == 4 and "Join" not in p
    above = [line.lstrip(" :+-") for line in p.splitlines()]
    for k in (i for i, line in enumerate(above) if line.startswith("Generate explode")):
        assert next(line for line in above[k + 1 :] if not line.startswith("Project")).startswith("Exchange hashpartitioning")


def test_counts_of_collapsed_molecules_take_two_shuffles_more(spark):
    """Of molecules by name, whose genes are compared, and of counts; the collapse below is the one above."""
    p = plan(spark, "gene_counts_collapsed")
    assert p.count("Scan parquet") == 1 and p.count("Exchange") == 6 and "Join" not in p


def ran(spark, name):
    """The plan that ran, in which what is used again is one line."""
    df = catalog.queries()[name](spark, SF)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


@pytest.mark.parametrize(("name", "scans"), [("six_number_summary", 1), ("winsorised_depth", 2)])
def test_quantiles_read_their_rows_once(spark, name, scans):
    """All steps start from the same counts of distinct values; the second query reads the rows again to cut them."""
    assert ran(spark, name).count("Scan parquet") == scans


def test_diagnostics_scan_four_times(spark):
    """For counts by chromosome and in all, for depths and ratios, for qualities, and for the grid."""
    assert ran(spark, "diagnostics_report").count("Scan parquet") == 4


def test_columns_are_pruned(spark):
    p = plan(spark, "switch_counts")
    assert "props" not in p.split("ReadSchema")[1] and "value" not in p.split("ReadSchema")[1]


def test_switches_take_one_shuffle_of_the_rows(spark):
    p = plan(spark, "switch_counts")
    assert p.count("Exchange hashpartitioning") == 1


def test_filters_reach_the_scan(spark):
    p = plan(spark, "marker_expression")
    assert "PushedFilters: [IsNotNull(p_size), LessThan(p_size,12)" in p


@pytest.mark.parametrize("module", ["catalog", "registry", "cells", "files", "frames", "maps", "more", "qc", "reads"])
def test_each_module_of_plans_imports_by_itself(module):
    import os
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", f"import chiasma.plans.{module}"], cwd=top, check=True, timeout=120)
