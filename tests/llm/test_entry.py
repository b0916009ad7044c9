import __spark_entry__ as entry


def test_every_operator_is_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
