"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
# m_forecast_days and m_track fit the same forests; compare.py runs these two as well
AGAIN = {"m_temp", "m_forecast_storms"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - AGAIN))
def test_query_equals_sql(spark, con, name):
    if name not in entry.oracle_sql():
        assert entry.queries()[name](spark, SF).count() > 0
        return
    assert compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ["m_rain", "m_temp", "m_track", "m_forecast_days", "m_forecast_storms", "q_model_manifest"])
def test_model_queries_fit_the_forests_of_the_jobs(spark, monkeypatch, name):
    from skyloom.operators import forests

    class Asked(Exception):
        pass

    def fit(*args, **sizes):
        assert not {"trees", "minimum"} & set(sizes)
        raise Asked

    monkeypatch.setattr(forests, "fit_days", fit)
    monkeypatch.setattr(forests, "fit_tracks", fit)
    with pytest.raises(Asked):
        entry.queries()[name](spark, SF)
