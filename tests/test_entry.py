import __spark_entry__ as entry


def test_contract(spark):
    names = entry.queries()
    assert names and set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).columns


def test_core_imports_nothing_of_the_corpus_operators():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "gaugeline"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"gaugeline\.llm|from gaugeline import llm", path.read_text()), path
