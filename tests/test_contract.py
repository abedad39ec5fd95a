import os
import subprocess
import sys

import pytest

import __spark_entry__ as contract
from contract.check import compare, database

#: Queries of the text operators, which are tested beside them.
TEXT = {n for n in contract.queries() if n == "pipeline" or n.startswith("op")}

def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["source", "n"] and df.count() > 0


def test_every_query_has_sql_but_the_forest():
    own = {n for n in contract.queries() if n not in TEXT}
    assert own - set(contract.oracle_sql()) == {"d_iforest", "d_detect_all"}
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) - TEXT))
def test_query_equals_sql(spark, small, name):
    assert compare(contract.queries()[name](spark, small), database(small), contract.oracle_sql()[name]) == ""


def test_workers_find_the_package(tmp_path):
    """The forest runs from another folder and without a path to the package."""
    root = os.path.dirname(os.path.abspath(contract.__file__))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as contract
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", contract.queries()["d_detect_all"](spark, "/root/testdata/sf0.001").count())
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    assert "rows 1000" in done.stdout, done.stderr[-2000:]
