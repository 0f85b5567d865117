"""Every registered query with an oracle gives DuckDB's rows."""

import pytest

from tessera.plans import registry

from .conftest import same

NAMES = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir)
    want = duck.execute(registry.oracle_sql()[name])
    same(got, want.fetchall(), [d[0] for d in want.description])


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry_without_optional_part(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_ordered_aggregate_reads_every_event(spark, sf_dir):
    got = registry.queries()["a17_ordered_aggregate_whole"](spark, sf_dir.replace("0.001", "0.01")).collect()
    assert sum(len(r.kinds.split(",")) for r in got) == spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/events.parquet").count() > 801


@pytest.mark.parametrize("kind", ["right", "full"])
def test_outer_joins_keep_whole_sides(spark, sf_dir, kind):
    got = registry.queries()[f"j5_{kind}_whole"](spark, sf_dir).collect()
    keys = lambda t, k: {r[0] for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k).collect()}
    assert {r.o_orderkey for r in got} - {None} == keys("orders", "o_orderkey") and any(r.c_custkey is None for r in got)
    if kind == "full":
        assert {r.c_custkey for r in got} - {None} == keys("customer", "c_custkey") and any(r.o_orderkey is None for r in got)


def test_whole_log_and_tables_are_read(spark, sf_dir):
    d, ask = sf_dir.replace("0.001", "0.01"), registry.queries()
    events, parts = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("events", "part"))
    users = events.select("user_id").distinct().count()
    latest = ask["w3_latest_row_now"](spark, d).collect()
    alive = {r.key for r in latest if r.value is not None}
    assert len(latest) == users and max(r.location for r in latest) == events.agg({"event_id": "max"}).first()[0]
    assert {r.key for r in ask["q5_active_state_now"](spark, d).collect()} == {r.key for r in ask["w4_cyclic_successor_now"](spark, d).collect()} == alive
    assert sum(r.n for r in ask["a15_reduce_whole"](spark, d).collect()) == events.count()
    assert ask["f9_key_codec_order_whole"](spark, d).count() == parts.count()


def test_approximations_keep_a_sketch_a_group(spark, tmp_path):
    """Nulls stay a group, and no sketch is made beside a distinct count."""
    rows = [(None if i % 3 == 0 else "A", None if i % 7 == 0 else i % 50, float(i % 11)) for i in range(600)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["a18_approximate"](spark, str(tmp_path))
    assert sorted(got.collect(), key=repr) == sorted([("A", True), (None, True)], key=repr)
    assert "Expand" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "count(distinct" not in plan.lower()
