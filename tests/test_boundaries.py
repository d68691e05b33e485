"""Semantics at the edges: windows, cutoffs, strictness, ties, nulls."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import interval_text, temporal_diff, typed_columns
from tidemark.operators import dfs, keys, sampling, temporal
from tidemark.operators.asof import asof_lags, lookup_text
from tidemark.operators.labels import make_labels
from tidemark.operators.leaderboard import elo
from tidemark.plans.dialect import add_lateral, nest_stacked_joins, to_spark
from tidemark.sources.cache import CacheConfig, cache_key, cached_artifact, resolve_cache
from tidemark.sources.schema import DatabaseSpec, RelDatabase, RelTable, TableSpec, TaskSpec, check, parse_step, read_table

DAY = timedelta(days=1)
T = lambda m, d=1, y=2020: datetime(y, m, d)


def times(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i, i % 3, T(i + 1)) for i in range(5)]
    return RelDatabase({
        "events": RelTable(times(spark, rows, "event_id long, driver_id long, t timestamp_ntz"), "event_id", {"driver_id": "drivers"}, "t"),
        "drivers": RelTable(times(spark, [(i, f"d{i}") for i in range(3)], "driver_id long, name string"), "driver_id"),
        "attendance": RelTable(times(spark, [(0, 0, T(1)), (1, 4, T(1, 2))], "attendance_id long, event_id long, t timestamp_ntz"), "attendance_id", {"event_id": "events"}, "t"),
    })


COUNT = TaskSpec("count", "regression", "drivers", "driver_id", "timestamp", "n", timedelta(days=31), """
    SELECT timestamp, driver_id, COUNT(*) AS n FROM timestamp_df, events
    WHERE t > timestamp AND t <= timestamp + INTERVAL '{timedelta}' GROUP BY timestamp, driver_id""")


def test__label_window__edges__excludes_start_includes_end(spark, events):
    got = {r.driver_id for r in make_labels(spark, events, COUNT, [T(1)]).collect()}
    assert got == {1}  # driver 0's event is at the anchor, driver 1's exactly 31 days later


def test__native_windows__edges__agree_with_labels(events):
    got = temporal.windows_of(events["events"].df, "t", [T(1)], timedelta(days=31)).collect()
    assert [(r.event_id, r.timestamp) for r in got] == [(1, T(1))]


def test__labels__extra_column_or_repeats__raise(spark, events):
    bad = TaskSpec(**{**vars(COUNT), "query": COUNT.query.replace("COUNT(*) AS n", "COUNT(*) AS n, 1 AS more")})
    with pytest.raises(ValueError, match="expected"):
        make_labels(spark, events, bad, [T(1)])
    twice = TaskSpec(**{**vars(COUNT), "query": "SELECT timestamp, driver_id, 1 AS n FROM timestamp_df, drivers UNION ALL SELECT timestamp, driver_id, 2 FROM timestamp_df, drivers"})
    with pytest.raises(ValueError, match="not unique"):
        make_labels(spark, events, twice, [T(1)])


def test__labels__reserved_table_name__raises(spark, events):
    with pytest.raises(ValueError, match="timestamp_df"):
        make_labels(spark, RelDatabase({"timestamp_df": events["drivers"]}), COUNT, [T(1)])


def test__censor_and_scrub__cutoff__inclusive_and_isolated(events):
    frozen = temporal.freeze(events, T(3))
    assert frozen["events"].df.count() == 3
    assert frozen["drivers"].df.count() == 3
    assert {r.attendance_id: r.event_id for r in frozen["attendance"].df.collect()} == {0: 0, 1: None}
    assert {r.event_id for r in events["attendance"].df.collect()} == {0, 4}


def test__splits__late_entities__dropped_and_target_masked(spark, events):
    labels = times(spark, [(T(2), 0, 1), (T(2), 4, 0)], "timestamp timestamp_ntz, event_id long, y int")
    inner = temporal.inner_split(events, "events", "event_id", labels, labels, T(3), "y")
    assert inner.train.count() == 1 and "y" not in inner.eval.columns and inner.target.count() == 1


def test__anchors__too_few__raise():
    with pytest.raises(ValueError, match="anchors"):
        temporal.train_anchors(T(3), timedelta(days=30), T(2))
    assert temporal.eval_anchors(T(1), DAY, 3, before=T(1, 3)) == [T(1), T(1, 2)]


def test__rekey__out_of_time_order__dense_by_time(spark):
    db = RelDatabase({"orders": RelTable(times(spark, [("b", T(2)), ("a", T(3)), ("c", T(1))], "id string, t timestamp_ntz"), "id", {}, "t")})
    _, maps = keys.rekey(db)
    assert {r.old: r.new for r in maps["orders"].collect()} == {"c": 0, "b": 1, "a": 2}
    with pytest.raises(ValueError, match="not unique"):
        keys.rekey(RelDatabase({"x": RelTable(times(spark, [(1,), (1,)], "id long"), "id")}))


def test__clean_columns__all_null_and_unnamed__go(spark):
    facts = times(spark, [(1, 1, None, None), (2, 1, None, 3.0)], "`Unnamed: 0` int, driver_id int, all_nan double, sparse double")
    empty = RelTable(facts.limit(0))
    out = keys.clean_columns(RelDatabase({"facts": RelTable(facts), "empty": empty}))
    assert out["facts"].df.columns == ["driver_id", "sparse"]
    assert "all_nan" in out["empty"].df.columns
    people = RelDatabase({"users": RelTable(times(spark, [(1, "a", 4.5)], "user_id long, name string, max_beer_rating double"), "user_id")})
    assert keys.clean_columns(people, "rel-ratebeer")["users"].df.columns == ["user_id", "name"]
    assert keys.clean_columns(people, "other")["users"] is people["users"]


def test__seeds__unknown_ids__warn_and_scalar_raises(events):
    with pytest.warns(UserWarning, match="not there"):
        assert temporal.prediction_seeds(events, "drivers", "driver_id", "at", T(1), [0, 999]).count() == 1
    with pytest.raises(TypeError):
        temporal.prediction_seeds(events, "drivers", "driver_id", "at", T(1), 5)
    assert temporal.prediction_seeds(events, "events", "event_id", "at", T(2)).count() == 2


def test__coverage__short_data__raises(events):
    temporal.check_coverage(events, T(4), timedelta(days=30), 1)
    with pytest.raises(ValueError, match="labels need"):
        temporal.check_coverage(events, T(4), timedelta(days=31), 1)


def test__lags__equal_time__not_seen(spark):
    pool = times(spark, [("u", T(1, 1), 10.0), ("u", T(1, 3), 20.0), ("u", T(1, 6), 30.0)], "e string, t timestamp_ntz, y double")
    anchors = times(spark, [(1, "u", T(1, 8)), (2, "u", T(1, 6)), (3, "v", T(1, 6))], "row_id long, e string, t timestamp_ntz")
    got = {r.row_id: r for r in asof_lags(anchors, pool, "e", "t", "y", 3).collect()}
    assert (got[1].target_lag1, got[1].target_lag1_age_days, got[1].target_lag2, got[1].target_lag2_age_days) == (30.0, 2.0, 20.0, 5.0)
    assert (got[2].target_lag1, got[2].target_lag2, got[2].target_lag3) == (20.0, 10.0, None)
    assert got[3].target_lag1 is None and len(got) == 3


def test__lookup__repeated_entities__one_row_each(spark):
    rows = times(spark, [(1, 7), (2, 8)], "row_id long, k long")
    people = times(spark, [("7", "b"), ("7", "a")], "id string, bio string")
    assert {r.row_id: r.bio__raw_text for r in lookup_text(rows, "k", people, "id", ["bio"]).collect()} == {1: "a", 2: None}


def test__typed_columns__lists_out__times_as_ns(spark):
    df = spark.createDataFrame([(1, True, T(1), [1.0], float("nan"))], "a int, b boolean, t timestamp_ntz, l array<double>, x double")
    out, names = typed_columns(df)
    row = out.first()
    assert names == ["b"] and out.columns == ["a", "t", "x", "b"]
    assert row.t == 1577836800e9 and row.x is None and row.b == "true"


def test__temporal_diff__std_goes__max_becomes_age(spark):
    df = spark.createDataFrame([(T(1), 0.0, 1.0, 5)], "ts timestamp_ntz, `users.MAX(reviews.ts_epochtime)` double, `users.STD(reviews.ts_epochtime)` double, plain int")
    assert temporal_diff(df, "ts").columns == ["ts", "users_MAX_reviews_ts_epochtime_diff", "plain"]


@pytest.fixture(scope="module")
def users(spark):
    return RelDatabase({
        "users": RelTable(times(spark, [(1, 30.0), (2, 40.0), (3, None)], "uid long, age double"), "uid"),
        "reviews": RelTable(times(spark, [(1, 1.0, T(1)), (1, 3.0, T(3)), (2, 5.0, T(2)), (None, 9.0, T(2))], "uid long, rating double, ts timestamp_ntz"), None, {"uid": "users"}, "ts"),
    })


def test__dfs__strict_cutoff_and_cobatch__same_rows(spark, users):
    anchors = times(spark, [(1, T(3)), (1, T(4)), (3, T(4))], "uid long, ts timestamp_ntz")
    got = {(r.uid, r.ts): r for r in dfs.features(anchors, users, "users", "uid", "ts", 2).collect()}
    assert got[1, T(3)]["d2__users.COUNT(reviews)"] == 1.0 and got[1, T(4)]["d2__users.COUNT(reviews)"] == 2.0
    assert got[3, T(4)]["d2__users.COUNT(reviews)"] == 0.0 and got[3, T(4)]["d2__users.MEAN(reviews.rating)"] is None
    alone = dfs.features(anchors.where("ts = timestamp_ntz'2020-03-01'"), users, "users", "uid", "ts", 2).first()
    assert alone == got[1, T(3)]
    running = dfs.running_features(anchors, users["reviews"], "uid", ["rating"], "uid", "ts", "reviews")
    assert {(r.uid, r.ts): r["reviews.COUNT"] for r in running.collect()} == {k: v["d2__users.COUNT(reviews)"] for k, v in got.items()}


def test__history__equal_time__hidden(spark, users):
    labels = times(spark, [(1, T(1), 1.0), (1, T(2), 3.0), (2, T(1), 7.0)], "uid long, ts timestamp_ntz, y double")
    anchor = times(spark, [(1, T(2))], "uid long, ts timestamp_ntz")
    row = dfs.features(anchor, users, "users", "uid", "ts", 2, history=labels).first()
    assert row["d2__users.MEAN(_target_history.y)"] == 1.0


def test__pools__small_table__none(spark):
    df = spark.range(60).select(F.col("id"), F.lit(T(1)).cast("timestamp_ntz").alias("t"))
    assert sampling.hard_pool(df, "t", "id", 5, 60, 2, 1) is None and sampling.soft_pool(df, "t", "id", 5, 60, 2, 1) is None
    drawn = sampling.hard_pool(df, "t", "id", 5, 20, 3, 1).collect()
    assert len(drawn) == 15 and len({(r.est, r.id) for r in drawn}) == 15 and all(r.id < 20 for r in drawn)
    soft = sampling.soft_pool(df, "t", "id", 5, 20, 3, 1)
    assert soft.count() == 15 and sorted(soft.collect()) == sorted(sampling.soft_pool(df, "t", "id", 5, 20, 3, 1).collect())


def test__dialect__four_gaps__closed():
    assert interval_text(timedelta(days=30)) == "30 days" and interval_text(timedelta(hours=1)) == "3600 seconds"
    assert "TIMESTAMP_NTZ '2020" in to_spark("SELECT TIMESTAMP '2020-01-01'", DAY)
    assert to_spark("SELECT '{\"a\": 1}', INTERVAL '{timedelta}'", DAY) == "SELECT '{\"a\": 1}', INTERVAL '1 days'"
    nested = nest_stacked_joins("SELECT * FROM a LEFT JOIN b LEFT JOIN c ON b.x = c.x ON a.x = b.x WHERE 1 = 1")
    assert nested.replace("  ", " ") == "SELECT * FROM a LEFT JOIN ( b LEFT JOIN c ON b.x = c.x )ON a.x = b.x WHERE 1 = 1"
    assert nest_stacked_joins("SELECT * FROM a JOIN b ON a.x = b.x JOIN c ON c.x = a.x") == "SELECT * FROM a JOIN b ON a.x = b.x JOIN c ON c.x = a.x"
    assert add_lateral("SELECT * FROM a, (SELECT 1)") == "SELECT * FROM a, LATERAL (SELECT 1)"
    assert add_lateral("SELECT f(a, (SELECT 1)) FROM a") == "SELECT f(a, (SELECT 1)) FROM a"


def test__specs__unknown_or_missing_keys__rejected(tmp_path, spark):
    with pytest.raises(ValueError, match="unknown keys"):
        check({"name": "x", "tables": {}, "more": 1}, {"name": str, "tables": dict}, "database")
    (tmp_path / "db.yaml").write_text("name: d\ntables:\n  sellers:\n    path: s.csv\n    pkey: id\n    time_col: t\n    columns: [id, t]\nval_timestamp: 2020-01-01\ntest_timestamp: 2020-02-01\n")
    (tmp_path / "s.csv").write_text("id,t,secret\na,2020-01-05,1\n")
    spec = DatabaseSpec.from_yaml(tmp_path / "db.yaml")
    assert spec.tables["sellers"].path == str(tmp_path / "s.csv")
    table = read_table(spark, spec.tables["sellers"], "sellers")
    assert table.df.columns == ["id", "t"] and table.df.first().t == T(1, 5)
    with pytest.raises(ValueError, match="listed"):
        read_table(spark, TableSpec(str(tmp_path / "s.csv"), "id", columns=("t",)))
    assert parse_step("2 weeks") == timedelta(days=14)


def test__cache__policies__raise_fill_read(spark, tmp_path):
    for bad in ("..", "a/b", ""):
        with pytest.raises(ValueError):
            cache_key([bad])
    config = CacheConfig(str(tmp_path), "raise")
    with pytest.raises(FileNotFoundError):
        cached_artifact(spark, config, "x", lambda: spark.range(3))
    assert cached_artifact(spark, CacheConfig(str(tmp_path)), "x", lambda: spark.range(3)).count() == 3
    assert cached_artifact(spark, config, "x", lambda: 1 / 0).count() == 3
    assert resolve_cache("off").root is None


def test__elo__anchor__at_1000():
    got = elo([("a", "b", 9, 10), ("b", "a", 1, 10)], "b")
    assert got["b"] == pytest.approx(1000) and got["a"] > 1200 and elo([], "b") == {}
