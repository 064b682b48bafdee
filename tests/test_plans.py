"""Scale properties of the physical plans (regression guards)."""

import pytest

import __spark_entry__ as entry
from tools.plan_report import summary

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("tessera.window.strategy", "key")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("tessera.window.strategy")


@pytest.mark.parametrize("name", ["roll_mean", "ewm_mean", "sub_risk", "minutes_reliability", "us_roll_ewm"])
def test_window_layer_single_exchange(static, name):
    s = summary(_plan(static, name))
    assert s["shuffle_exchanges"] == 1 and s["python_udf_nodes"] == 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_no_nested_loop_or_cartesian(static, name):
    assert summary(_plan(static, name))["nested_loop_joins"] == 0


def test_flagship_history_exchange_reused_by_windows(static):
    static.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(static, "feature_build")
    finally:
        static.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
    assert plan.count("hashpartitioning(player_id") == 2   # both sides of the player join, no more
    assert "BroadcastExchange" in plan                      # the bounded context / nation sides


def test_asof_is_a_hash_join(static):
    plan = _plan(static, "asof_period")
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_shared_folder_is_required_off_local_masters():
    from types import SimpleNamespace

    import pytest

    from tessera.session import shared_dir
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="local-cluster[2,1,1024]")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_history_is_dealt_out_in_bounded_parts(spark, monkeypatch):
    from tessera.plans import analogue as an
    rows = an.history(spark, SF).count()
    whole = an.history_with_players(spark, SF)
    monkeypatch.setattr(an, "PART_ROWS", 100)
    parts = an.history_with_players(spark, SF)
    sizes = parts.rdd.glom().map(len).collect()
    assert len(sizes) == -(-rows // 100) and max(sizes) < 300
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))


def test_no_maps_are_shuffled(spark):
    """The documents' maps of strings are built after the shuffle of the lines they hold."""
    from tessera.plans import analogue as an
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = an.second_source_docs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    above, below = plan.split("Aggregate [", 1)
    assert "map_from_arrays" in above.lower() or "map(" in above.lower()
    assert "map_from_arrays" not in below.lower() and "map(" not in below.lower()
