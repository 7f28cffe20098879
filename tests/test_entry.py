"""The driver's contract."""

import __spark_entry__ as contract


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_registers():
    made, said = contract.queries(), contract.oracle_sql()
    assert set(said) <= set(made) and len(made) >= 50
