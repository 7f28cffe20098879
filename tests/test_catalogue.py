"""Every query of the catalogue against its SQL in DuckDB."""

import duckdb
import pytest

from lexloom.plans import answers, catalogue, further, morphology  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(repr(tuple(round(v, 5) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in catalogue.SQL:
        assert rows
        return
    told = duck.sql(catalogue.SQL[name])
    assert columns == sorted(told.columns)
    assert normal(rows) == normal(told.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_bootstrap_has_all_replicates(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(further, "_interval", lambda scores, replicates: (scores.count(), replicates))
    assert further.bootstrap_ci(spark, sf_dir) == (1000, 1000)


def test_reference_meets_every_entity(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    assert catalogue.QUERIES["feature_similarity_reference"](spark, sf_dir).count() == users - 1
