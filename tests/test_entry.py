from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["file_id"]


def test_core_does_not_need_the_subpackage():
    root = Path(entry.__file__).parent / "tagloom"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "tagloom.llm" not in f.read_text(), f
