from __future__ import annotations

import subprocess
import sys

import pytest

import __spark_entry__
from tests.conftest import SMALL
from tests.oracle import assert_same
from tidewater.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    assert_same(catalogue.queries()[name](spark, SMALL), catalogue.oracle_sql()[name], SMALL)


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_codecs_read_all_orders(spark):
    """On the largest table too, where most orders have keys beyond a smallint."""
    folder = "/root/testdata/sf0.1"
    orders = spark.read.parquet(f"{folder}/orders.parquet").count()
    assert assert_same(catalogue.queries()["type_codecs_all"](spark, folder), catalogue.oracle_sql()["type_codecs_all"], folder) == orders


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_works_without_the_optional_parts():
    code = """
import sys
class Gone:
    def find_spec(self, name, *_):
        if name == "corpus_pipeline" or name.startswith("tidewater.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=sys.path[0])
