import json

import pytest
from pyspark.sql import functions as F

from gaugeworks import flows
from gaugeworks.operators import filters as f
from gaugeworks.operators import project as p
from gaugeworks.operators import sets
from gaugeworks.operators.cube import Cube
from gaugeworks.session import checkpoint_dir, rows_table
from gaugeworks.sources import external, files, tables


def test_read_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read(spark, str(tmp_path / "none.csv"), "csv", schema="a int")
    with pytest.raises(ValueError):
        files.read(spark, str(tmp_path), "xml")
    with pytest.raises(ValueError):
        files.ingest(spark, [files.Source("gone", lambda s: files.read(s, str(tmp_path / "none"), "json", schema="a int"))])


@pytest.mark.parametrize("body", [[{"a": 1}, {"a": 2}], {"data": [{"a": 1}, {"a": 2}]}, {"a": 3}])
def test_json_document_shapes(spark, tmp_path, body):
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(body))
    got = sorted(r["a"] for r in files.read_json_documents(spark, str(path)).collect())
    assert got == ([3] if isinstance(body, dict) and "a" in body else [1, 2])


def test_jdbc_reader_refuses_without_a_driver_but_builds(spark):
    assert external.jdbc_reader(spark, "jdbc:postgresql://db/x", "select 1 a") is not None
    assert external.jdbc_reader(spark, "jdbc:postgresql://db/x", "select 1 a", ("a", 0, 10, 4)) is not None
    assert external.jdbc_appender(spark.range(1), "jdbc:postgresql://db/x", "t") is not None


def test_checkpoint_folder_of_the_session_wins(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def test_filters_check_names(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        f.where_all(df, [("nope", "eq", 1)])
    with pytest.raises(ValueError):
        f.where_all(df, [("id", "regex", 1)])


def test_filters_are_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).withColumn("v", F.col("id") * 2).withColumn("unused", F.lit("x")).write.parquet(path)
    got = f.where_all(spark.read.parquet(path), [("id", "gt", 3)]).select("v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan and "unused" not in plan


def test_retention_by_count_and_size(spark):
    df = spark.range(20)
    assert sorted(r["id"] for r in f.retain_count(df, ["id"], 3).collect()) == [17, 18, 19]
    assert sorted(r["id"] for r in f.retain_size(df, ["id"], F.lit(10), 25).collect()) == [18, 19]


def test_rows_with_zero_divisors_and_missing_names(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(p.formula(df, "a / b")).collect()] == [0.0, 2.0]
    assert df.select(p.formula(df, "c / b")).first()[0] == 0.0
    assert [r[0] for r in df.select(p.troyon_ratio("a", "b")).collect()][0] is None


def test_clip_is_idempotent_and_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (50.0,)], "v double")
    once = p.clip(df, {"v": (0.0, 10.0)})
    assert [r["v"] for r in once.collect()] == [None, 0.0, 10.0] == [r["v"] for r in p.clip(once, {"v": (0.0, 10.0)}).collect()]


def test_engineering_adds_only_what_its_inputs_allow(spark):
    df = spark.createDataFrame([(2.0, 0.9, 0.7)], "magnetic_field double, magnet_health double, vacuum_health double")
    got = p.engineer(df)
    assert set(got.columns) - set(df.columns) == {"magnetic_pressure", "gyrofrequency", "overall_health"}
    assert got.first()["overall_health"] == pytest.approx(0.8)


def test_cube_mean_of_means(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 2, 5.0)], "d string, e int, v double")
    c = Cube(df, ["d", "e"], ["v"], {"v": "mean"})
    assert c.roll_up("e").data.first()["v"] == 3.0 and c.roll_up("d").roll_up("e").data.first()["v"] == 2.5
    with pytest.raises(ValueError):
        c.drill_down("e", "fortnight")


def test_flow_stops_on_broken_rules_and_missing_columns(spark, tmp_path):
    src = [files.Source("r", lambda s: s.range(10))]
    bad = flows.run(spark, "r", src, [], {"big": F.col("id") > 7}, [(str(tmp_path / "o"), "json")], stop_on_invalid=True)
    assert bad.status == "failed" and bad.rows_failed == 2 and not (tmp_path / "o").exists()
    ok = flows.run(spark, "r", src, [flows.Step("keep", lambda d: d, expects=["other"])], {"big": F.col("id") > 7}, [(str(tmp_path / "o"), "json")])
    assert ok.status == "completed" and ok.rows_out == 10 and ok.warnings and (tmp_path / "o").exists()
    with pytest.raises(ValueError):
        flows.run(spark, "r", src, [flows.Step("needs", lambda d: d, requires=["x"])])


def test_declared_flow_is_checked():
    assert flows.check_spec({"name": "x", "sources": [{"name": "a", "path": "p", "format": "csv"}], "transformations": [{"kind": "spin"}]}) == ["unknown kind 'spin'"]
    assert "missing sources" in flows.check_spec({"name": "x"})


def test_custom_step_kind_and_rules(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    flows.register_kind("double", lambda df, column: df.withColumn(column, F.col(column) * 2))
    got = flows.run_spec(spark, {"name": "x", "sources": [{"name": "a", "path": str(tmp_path / "in"), "format": "parquet"}], "transformations": [{"kind": "double", "config": {"column": "id"}}]})
    assert got.data.agg(F.sum("id")).first()[0] == 20
    rules = flows.Rules()
    rules.add_constraint("beta", 0, 1)
    rules.add_target("latency", "<", 5)
    assert [c for c in rules.constraints if c[0] == "beta"] == [("beta", 0, 1, 0, 1)] and rules.targets[0][0] == "latency"


def test_set_difference_and_rule_tables(spark):
    assert sets.missing_columns(spark.range(1), ["id", "x"]) == ["x"]
    assert rows_table(spark, [("a", 1)], "n string, v int").count() == 1


def test_declared_tables_parse_and_keep_their_not_null_columns(spark):
    for ddl in (tables.EXPERIMENTS, tables.SHOTS, tables.MEASUREMENTS, tables.PREDICTIONS):
        schema = spark.createDataFrame([], ddl).schema
        assert schema["id"].nullable is False and len(schema) > 10


def test_constraint_checks_find_duplicates_and_orphans(spark):
    child = spark.createDataFrame([(1, 1), (1, 1), (2, 9)], "id int, parent int")
    parent = spark.createDataFrame([(1,)], "pid int")
    got = {r["rule"]: r["violations"] for r in tables.constraint_report({"dup": tables.duplicate_keys(child, ["id"]), "orphan": tables.orphans(child, "parent", parent, "pid")}).collect()}
    assert got == {"dup": 1, "orphan": 1}


def test_typed_tables_fill_defaults_and_name_unreadable_values(spark):
    rows = spark.createDataFrame([("a", "x", None, "12", 1), ("b", "x", "gone", "many", 2), (None, "x", "running", None, 3)], "id string, experiment_id string, status string, shot_number string, extra int")
    rows = rows.withColumn("start_time", F.lit("2024-01-01 00:00:00"))
    shots = tables.STORE["shots"]
    got = {r["id"]: r for r in tables.typed(rows, shots).collect()}
    assert "extra" not in got["a"].asDict() and got["a"]["shot_number"] == 12 and got["a"]["status"] == "completed" and got["a"]["had_disruption"] is False
    assert got["b"]["shot_number"] is None and got["b"]["_unreadable"] == ["shot_number"] and got["a"]["_unreadable"] == []
    good, bad = tables.accepted(rows, shots)
    assert [r["id"] for r in good.collect()] == ["a"] and good.columns == [f.name for f in shots.schema(spark)]
    assert {r["id"]: sorted(r["broken"]) for r in bad.collect()} == {"b": ["shot_number unreadable", "status unknown"], None: ["id missing", "shot_number missing"]}


def test_store_report_counts_repeated_keys_and_lost_references(spark):
    at = F.lit("2024-01-01 00:00:00")
    exp = spark.createDataFrame([("e1", "n", "t", "r"), ("e1", "n", "t", "r"), ("e2", None, "t", "r")], "id string, name string, experiment_type string, reactor_type string")
    shot = spark.createDataFrame([("s1", "e1", 1), ("s2", "e1", 1), ("s3", "e9", None), ("s4", "e9", None), ("s5", None, 2)], "id string, experiment_id string, shot_number int").withColumn("start_time", at)
    got = {(r["table"], r["rule"]): r["violations"] for r in tables.store_report({"experiments": exp, "shots": shot}).collect()}
    assert {k: v for k, v in got.items() if v} == {
        ("experiments", "id unique"): 1, ("experiments", "name missing"): 1, ("shots", "experiment_id, shot_number unique"): 1,
        ("shots", "experiment_id known"): 2, ("shots", "experiment_id missing"): 1, ("shots", "shot_number missing"): 2}
    alone = {(r["table"], r["rule"]): r["violations"] for r in tables.store_report({"shots": shot.limit(0)}).collect()}
    assert set(alone.values()) == {0} and ("shots", "experiment_id known") in alone


def test_rules_for_all_reach_every_message_and_no_rules_the_default(spark):
    from gaugeworks.operators import joins

    msgs = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "id int, key string")
    rules = lambda *r: spark.createDataFrame(list(r), "pattern string, queue string")
    got = lambda b: sorted((r["id"], r["queue"]) for r in joins.route(msgs, b, "id", "key").collect() if r["queue"])
    assert got(rules(("*", "q"), ("a*", "q"), ("a*", "p"))) == [(1, "p"), (1, "q"), (2, "q"), (3, "q")]
    assert got(rules(("*b", "p"), (None, "z"))) == [(1, "p"), (2, "events.")]
    assert got(rules()) == [(1, "events.ab"), (2, "events.")]
