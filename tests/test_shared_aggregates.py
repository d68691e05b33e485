"""Scaling, rank differences, token artifacts, context shapes, discovery and small guards."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.models import base
from tidemark.models.matrices import cached_tokens
from tidemark.operators import graph, scaling, temporal
from tidemark.operators.leaderboard import critical_difference, range_quantile
from tidemark.sources.cache import CacheConfig
from tidemark.sources.schema import RelDatabase, RelTable

T = lambda m, d=1, y=2020: datetime(y, m, d)


def test__moments__one_or_equal_or_null_values__deviation_is_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", 1.0), ("c", 3.0), ("d", None)], "k string, v double")
    got = {r.k: (r["mean"], r["std"]) for r in scaling.moments(df, "v", ["k"]).collect()}
    assert got == {"a": (1.0, 1.0), "b": (2.0, 1.0), "c": (2.0, math.sqrt(2.0)), "d": (None, 1.0)}


def test__percentile_bounds__repeated_values__count_as_often_as_they_occur(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 50 + list(range(1, 51))], "v double")
    want = df.agg(F.percentile("v", F.lit(0.3)).alias("lo"), F.percentile("v", F.lit(0.98)).alias("hi")).first()
    assert scaling.percentile_bounds(df, "v", 0.3, 0.98).first() == want
    held = scaling.clamped(df, "v", scaling.percentile_bounds(df, "v", 0.3, 0.98))
    assert held.agg(F.max("clamped")).first()[0] == want.hi and held.count() == 100


def test__pivot_metrics__pair_without_rows__is_a_null_column(spark):
    long = spark.createDataFrame([(1, "val", "mae", 2.0), (1, "val", "mae", 4.0), (2, "test", "mae", 1.0)], "k int, s string, m string, v double")
    got = scaling.pivot_metrics(long, ["k"], "s", "m", "v", ["val", "test"], ["mae", "r2"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 3.0, None, None, None), (2, None, None, 1.0, None)]


@pytest.mark.parametrize(("k", "q"), [(2, 1.960), (3, 2.344), (4, 2.569), (5, 2.728), (10, 3.164)])
def test__range_quantile__published_table__agrees(k, q):
    assert range_quantile(k) / math.sqrt(2) == pytest.approx(q, abs=1e-3)


def test__critical_difference__one_method__has_none(spark):
    frame = spark.createDataFrame([("m", "t", 0.5)], "method string, task string, metric_error double")
    (row,) = critical_difference(frame).collect()
    assert (row["rank"], row.cd, row.n_alike) == (1.0, None, 1)


def test__context_grid__shapes__local_part_fits_and_builds_stand_together():
    grid = graph.context_grid()
    assert len(grid) == len(set(grid)) == 60 and all(c.local <= c.size for c in grid)
    builds = [(c.local, c.width, c.latest) for c in grid]
    assert len(set(builds)) == 24 and builds == sorted(builds, key=builds.index)
    assert graph.context_grid([8], [1]) == [graph.Context(8, 8, 1, True), graph.Context(8, 8, 1, False)]


def test__cached_tokens__ranges_and_strict_reads__equal_what_is_computed(spark, tmp_path):
    seeds = spark.createDataFrame([(i, "a", i, T(6)) for i in range(4)], "seed_id long, node_type string, node long, time timestamp_ntz")
    edges = spark.createDataFrame([("a-f2p_x-b", i, i % 2, T(1 + i)) for i in range(4)], "edge_type string, src long, dst long, time timestamp_ntz")
    pool = spark.createDataFrame([(0, "p", 7)], "pool_id long, node_type string, node long")
    ask = lambda root, policy, only=None, k=3: cached_tokens(spark, CacheConfig(root, policy), "c", seeds, edges, pool, k, 5, only)
    rows = lambda df: sorted(map(str, graph.unpacked(df).collect()))
    want, root = rows(ask(None, "compute")), str(tmp_path / "kept")
    assert len(want) == 12 and rows(ask(root, "fill")) == want
    assert sorted(rows(ask(root, "raise", (0, 2))) + rows(ask(root, "raise", (2, 4)))) == want
    with pytest.raises(FileNotFoundError):
        ask(root, "raise", k=4)


def test__discover__module_without_its_dependency__is_named_and_others_register(tmp_path, monkeypatch):
    home = tmp_path / "more_models"
    home.mkdir()
    (home / "__init__.py").write_text("")
    (home / "absent.py").write_text("import surely_no_such_library\n")
    (home / "_hidden.py").write_text("raise RuntimeError\n")
    (home / "there.py").write_text("from tidemark.models.base import Model, register_model\n@register_model('from-elsewhere')\nclass M(Model):\n    fit = predict = None\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    try:
        assert base.discover("more_models") == {"absent": "surely_no_such_library"}
        assert "from-elsewhere" in base.model_names()
    finally:
        base._registry.pop("from-elsewhere", None)
    (home / "wrong.py").write_text("import tidemark.no_such_module\n")
    with pytest.raises(ModuleNotFoundError):
        base.discover("more_models")


def test__canonical_labels__extra_columns__raise_unless_allowed(spark):
    df = spark.createDataFrame([(T(1), 1, 0, 9)], "t timestamp_ntz, e long, y int, index long")
    with pytest.raises(ValueError, match="index"):
        temporal.canonical_labels(df, "t", "e", "y")
    assert temporal.canonical_labels(df, "t", "e", "y", ["index"]).columns == ["t", "e", "y"]


def test__check_times__year_before_any_feature__raises(spark):
    table = lambda year: RelDatabase({"x": RelTable(spark.createDataFrame([(1, T(1, y=year))], "i long, t timestamp_ntz"), "i", {}, "t")})
    graph.check_times(table(1950))
    with pytest.raises(ValueError, match="1900"):
        graph.check_times(table(1800))
