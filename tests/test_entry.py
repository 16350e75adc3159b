"""The driver's contract, at the smallest size."""

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_and_sql_belong_together():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for number in range(1, 8):
        assert f"p{number}_found" in entry.queries()


def test_general_part_needs_no_text_part():
    from pathlib import Path

    import tidelog

    root = Path(tidelog.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tidelog.llm" not in path.read_text(), path
