"""Physical plans of the registered queries."""

import re

import pytest

from voidscan.llm.queries import QUERIES
from voidscan.plans.stage import nested_loops, physical

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_chat_format", "op10_secret_scan"])
def test_native_operators_run_no_python(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    assert not re.search("Python|Pandas|Arrow", plan) and nested_loops(QUERIES[name](spark, SF)) == 0


def test_chat_shuffles_once(spark):
    assert physical(QUERIES["op1_chat_format"](spark, SF)).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["op2_decontamination", "op5_packing"])
def test_scans_that_shuffle_nothing_and_read_two_columns(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
