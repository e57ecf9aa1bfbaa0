import os
import re

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from tallymill.llm import queries as llm

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_all_queries_and_the_pipeline():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert set(llm.oracle_sql()) <= set(llm.queries())


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_query_and_sql(spark, duck, name):
    assert differences(llm.queries()[name](spark, FOLDER), duck, llm.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["op8_mixing", "op10_chat_formatting"])
def test_native_queries_run_no_python(spark, name):
    plan = llm.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
    for node in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_nothing_else_imports_this_package():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "tallymill")):
        for file in files:
            if file.endswith(".py") and f"{os.sep}llm" not in folder:
                with open(os.path.join(folder, file), encoding="utf-8") as source:
                    assert not re.search(r"(from|import)\s+tallymill\.llm", source.read()), file
