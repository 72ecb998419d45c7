"""Plans: what reaches the scan, and what isn't planned."""

from __future__ import annotations

import os
import re

import pytest

from strandline.operators import alignment as ops
from strandline.plans.genomic import PYTHON, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables aren't here")


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_flagstat_reads_four_columns_and_shuffles_partial_counts(spark):
    p = plan(QUERIES["agg04_flagstat"](spark, DATA))
    assert "ReadSchema: struct<l_orderkey" not in p and "l_quantity" not in p.split("ReadSchema")[1].split("\n")[0]
    assert "partial_count" in p and p.count("Exchange") <= 4


@pytest.mark.parametrize("name", ["jn09_interval_join", "jn09_interval_join_wide", "jn01_name_semi_join", "jn02_jn03_reference_lookup", "agg05_jn04_idxstats"])
def test_no_nested_loops(spark, name):
    p = plan(QUERIES[name](spark, DATA))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_bins_prune_partitions(spark, tmp_path):
    from strandline.functions.coords import Region
    from strandline.plans.views import view

    ops.with_bin(view(spark, DATA, "alignments")).where("bin is not null").write.partitionBy("ref_id", "bin").parquet(f"file://{tmp_path}/binned")
    binned = spark.read.parquet(f"file://{tmp_path}/binned")
    found = ops.binned_query(binned, 2, Region("sq2", 1000, 1200))
    p = plan(found)
    assert "PartitionFilters: [" in p and "bin" in p.split("PartitionFilters")[1].split("\n")[0] and "PushedFilters: [" in p
    assert found.count() == QUERIES["flt04_qry01_qry02_region_query"](spark, DATA).count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_python_only_where_marked(spark, name):
    p = plan(QUERIES[name](spark, DATA))
    assert bool(re.search("EvalPython|InArrow|InPandas|FlatMap|PythonUDF|BatchScan", p)) == (name in PYTHON)
