"""Sampling, constant models, metrics, leaderboards, checksums and set-operation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import sigmoid
from tidemark.models.builtin import ensemble
from tidemark.models.constants import constant_scores, entity_scores
from tidemark.operators import leaderboard as lb
from tidemark.operators import metrics, sampling, scaling
from tidemark.operators.fingerprint import column_checksums
from tidemark.suites.common import star
from tidemark.suites.features import FEW, _seeds, tidy
from tidemark.suites.keys import _churn
from tidemark.suites.labels import ORDER_ANCHORS

SEED = 7
_INT60 = "('0x' || substr(md5({}), 1, 15))::BIGINT"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir, "events")["events"].df


def ctx_recency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.recency_rank(_events(spark, sf_dir).select("event_id", "ts"), "ts", "event_id").select("event_id", "rank")


def ctx_hard_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hard_pool(_events(spark, sf_dir), "ts", "event_id", 50, 200, 4, SEED)


def ctx_soft_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.soft_pool(_events(spark, sf_dir), "ts", "event_id", 50, 200, 4, SEED)


def ctx_union_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.union_positions(ctx_hard_pool(spark, sf_dir), "event_id")


def ctx_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_cap(_events(spark, sf_dir).select("event_id", "event_type"), "event_id", 100, SEED, "event_type")


def ctx_random_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_cap(_events(spark, sf_dir).select("event_id", "value"), "event_id", 100, SEED)


def _train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _seeds(spark, sf_dir, ORDER_ANCHORS[:12]), _seeds(spark, sf_dir, ORDER_ANCHORS[12:14])


def model_constant_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    return constant_scores(train, test.drop("churn"), "churn", "binary_classification")


def model_constant_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    return entity_scores(train, test.drop("churn"), "c_custkey", "churn", "binary_classification")


def model_constant_entity_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median totals per customer, with the overall median for customers without early orders."""
    orders = star(spark, sf_dir, "orders")["orders"].df.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    early = orders.where(F.col("o_orderdate") < F.lit(FEW[0]).cast("timestamp_ntz"))
    late = orders.where(F.col("o_orderdate") >= F.lit(FEW[0]).cast("timestamp_ntz")).select("o_custkey", "o_orderkey")
    return entity_scores(early, late, "o_custkey", "o_totalprice", "regression")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    scored = entity_scores(train, test, "c_custkey", "churn", "binary_classification")
    return scored.select(F.col("churn").alias("y"), F.col("score"))


def metric_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.ranking(_scored(spark, sf_dir)))


def metric_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.threshold(_scored(spark, sf_dir)))


def metric_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = star(spark, sf_dir, "lineitem")["lineitem"].df.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("score"))
    return tidy(metrics.regression(scored))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tasks, return flags as methods: a results frame with known gaps."""
    items = star(spark, sf_dir, "lineitem", "part")["lineitem"].df
    return items.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("dataset"), F.col("l_suppkey").cast("string").alias("task")).agg(
        F.when(F.min("l_suppkey") % 2 == 0, "roc_auc").otherwise("mae").alias("metric"), (F.count(F.lit(1)) > 3).alias("selected"),
        F.avg("l_discount").alias("test_score"), F.sum("l_tax").alias("fit_time_tuning"), F.avg("l_tax").alias("fit_time_refit"), F.min("l_tax").alias("predict_time_refit"),
    )


def leaderboard_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(lb.error_frame(_results(spark, sf_dir)))


def leaderboard_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.drop_incomplete(lb.error_frame(_results(spark, sf_dir))).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


def rescaled_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(lb.rescaled(lb.drop_incomplete(lb.error_frame(_results(spark, sf_dir)))).groupBy("method").agg(F.avg("loss").alias("loss")))


def avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(lb.ranked(lb.drop_incomplete(lb.error_frame(_results(spark, sf_dir)))).groupBy("method").agg(F.avg("rank").alias("rank")))


def winrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(lb.win_rates(lb.drop_incomplete(lb.error_frame(_results(spark, sf_dir)))))


def winrate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(lb.pairwise(lb.drop_incomplete(lb.error_frame(_results(spark, sf_dir)))))


def leaderboard_elo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.leaderboard(_results(spark, sf_dir), anchor="A").select("method", "elo", "n_tasks")


def prediction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test labels with their predictions, one to one."""
    train, test = _train_test(spark, sf_dir)
    scored = entity_scores(train, test.drop("churn"), "c_custkey", "churn", "binary_classification")
    return lb.joined_one_to_one(scored, test, ["timestamp", "c_custkey"])


def results_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with the metric and time of their method and task."""
    results = _results(spark, sf_dir)
    meta = results.select(F.col("model").alias("method"), F.concat_ws("/", "dataset", "task").alias("task"), "metric", "fit_time_tuning")
    return tidy(lb.with_meta(lb.error_frame(results).select("method", "task", "metric_error"), meta))


def loss_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(lb.heatmap(lb.rescaled(lb.drop_incomplete(lb.error_frame(_results(spark, sf_dir))))))


def reference_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own rows and published rows with fewer columns, one method left out."""
    own = lb.error_frame(_results(spark, sf_dir)).select("method", "task", "metric_error", "time_train_s")
    published = own.where("method = 'A'").select(F.concat(F.col("method"), F.lit("_ref")).alias("method"), "task", "metric_error")
    return tidy(own.unionByName(published, allowMissingColumns=True).where(~F.col("method").isin("R")))


def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metric rows to val_ and test_ columns."""
    items = star(spark, sf_dir, "lineitem")["lineitem"].df.select("l_suppkey", "l_returnflag", "l_linestatus", "l_discount")
    long = items.withColumn("split", F.when(F.col("l_returnflag") == "N", "val").otherwise("test"))
    return tidy(scaling.pivot_metrics(long, ["l_suppkey"], "split", "l_linestatus", "l_discount", ["val", "test"], ["O", "F"]))


def fingerprint_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = star(spark, sf_dir, "customer", columns={"customer": ("c_custkey", "c_nationkey", "c_mktsegment")})["customer"].df
    return column_checksums(customers, ["c_custkey"])


def target_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation per customer; one or equal values count as deviation 1."""
    orders = star(spark, sf_dir, "orders")["orders"].df
    return tidy(scaling.moments(orders, "o_totalprice", ["o_custkey"]))


def ensemble_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the models' raw scores per row, then the link."""
    items = star(spark, sf_dir, "lineitem")["lineitem"].df
    raw = items.select("l_orderkey", "l_linestatus", (F.col("l_quantity") / 10 - 2.5).alias("score"))
    parts = [raw.where(F.col("l_linestatus") == s) for s in ("O", "F")]
    return tidy(ensemble(parts, ["l_orderkey"]).select("l_orderkey", sigmoid(F.col("score")).alias("p")))


def critical_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks with the least difference that counts, and how many methods are not told apart from each."""
    return tidy(lb.critical_difference(lb.drop_incomplete(lb.error_frame(_results(spark, sf_dir)))))


QUERIES = {
    f.__name__: f
    for f in (
        ctx_recency_rank, ctx_hard_pool, ctx_soft_pool, ctx_union_remap, ctx_random, ctx_random_regression, model_constant_global,
        model_constant_entity, model_constant_entity_regression, metric_ranking, metric_threshold, metric_regression, leaderboard_frame,
        leaderboard_dense, rescaled_loss, avg_rank, winrate, winrate_matrix, leaderboard_elo, prediction_join, results_meta, loss_heatmap, reference_union, metric_pivot,
        fingerprint_table, target_moments, ensemble_link, critical_difference,
    )
}

_TRAIN, _TEST = _churn(ORDER_ANCHORS[:12]), _churn(ORDER_ANCHORS[12:14])
_SCORED = f"""tr AS ({_TRAIN}), te AS ({_TEST}), g AS (SELECT c_custkey, avg(churn) AS m FROM tr GROUP BY 1),
  scored AS (SELECT te.timestamp, te.c_custkey, te.churn AS y, coalesce(m, (SELECT avg(churn) FROM tr)) AS score FROM te LEFT JOIN g USING (c_custkey))"""
_DRAW = "row_number() OVER (PARTITION BY est ORDER BY " + _INT60.format(f"'{SEED}:' || est || ':' || event_id") + ", event_id) AS k"
_HARD = f"""WITH pool AS (SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 200),
  drawn AS (SELECT est, event_id, {_DRAW} FROM pool, range(4) r(est)) SELECT est::INTEGER AS est, event_id FROM drawn WHERE k <= 50"""
_RESULTS = """results AS (SELECT l_returnflag AS model, l_linestatus AS dataset, l_suppkey::VARCHAR AS task,
    CASE WHEN min(l_suppkey) % 2 = 0 THEN 'roc_auc' ELSE 'mae' END AS metric, count(*) > 3 AS selected, avg(l_discount) AS test_score,
    sum(l_tax) AS fit_time_tuning, avg(l_tax) AS fit_time_refit, min(l_tax) AS predict_time_refit
  FROM lineitem GROUP BY 1, 2, 3),
  frame AS (SELECT model AS method, dataset || '/' || task AS task, CASE WHEN metric = 'roc_auc' THEN 1 - test_score ELSE test_score END AS metric_error,
    fit_time_tuning + fit_time_refit AS time_train_s, predict_time_refit AS time_infer_s FROM results WHERE selected AND test_score IS NOT NULL),
  dense AS (SELECT * FROM frame WHERE task IN (SELECT task FROM frame GROUP BY task HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM frame)))"""
_SCALED = """scaled AS (SELECT *, min(metric_error) OVER w AS lo, max(metric_error) OVER w AS hi FROM dense WINDOW w AS (PARTITION BY task)),
  losses AS (SELECT *, CASE WHEN hi > lo THEN (metric_error - lo) / (hi - lo) ELSE 0 END AS loss FROM scaled)"""
_Q3 = "2.343700586"  # the 95th percentile of the range of three normal values, over the root of two
_PAIRS = """pairs AS (SELECT x.method AS a, y.method AS b, CASE WHEN x.metric_error < y.metric_error THEN 1.0 WHEN x.metric_error = y.metric_error THEN 0.5 ELSE 0 END AS win
  FROM dense x JOIN dense y USING (task) WHERE x.method <> y.method)"""


def r4(x: str) -> str:
    return f"(floor(({x})::DOUBLE * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE)"


ORACLES = {
    "ctx_recency_rank": "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS rank FROM events",
    "ctx_hard_pool": _HARD,
    "ctx_soft_pool": f"""WITH ranked AS (SELECT event_id, (row_number() OVER (ORDER BY ts DESC, event_id) - 1) / (count(*) OVER () - 1) AS frac FROM events),
        pool AS (SELECT event_id FROM ranked ORDER BY ln(({_INT60.format(f"'{SEED}:pool:' || event_id")}::DOUBLE + 1) / (2.0::DOUBLE ** 60 + 1))
          / exp(-ln(2.0::DOUBLE) / 0.25::DOUBLE * frac) DESC, event_id LIMIT 200),
        drawn AS (SELECT est, event_id, {_DRAW} FROM pool, range(4) r(est)) SELECT est::INTEGER AS est, event_id FROM drawn WHERE k <= 50""",
    "ctx_union_remap": f"WITH d AS ({_HARD}) SELECT est, event_id, dense_rank() OVER (ORDER BY event_id) - 1 AS position FROM d",
    "ctx_random": f"""WITH k AS (SELECT event_id, event_type, {_INT60.format(f"'{SEED}:' || event_id")} AS key FROM events),
        f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY key, event_id) > 1 AS later FROM k)
        SELECT event_id, event_type FROM f ORDER BY later, key, event_id LIMIT 100""",
    "ctx_random_regression": f"""SELECT event_id, value FROM events ORDER BY {_INT60.format(f"'{SEED}:' || event_id")}, event_id LIMIT 100""",
    "model_constant_global": f"SELECT timestamp, c_custkey, (SELECT avg(churn) FROM ({_TRAIN})) AS score FROM ({_TEST})",
    "model_constant_entity": f"WITH {_SCORED} SELECT timestamp, c_custkey, score FROM scored",
    "model_constant_entity_regression": f"""WITH early AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{FEW[0]}'),
        g AS (SELECT o_custkey, median(o_totalprice) AS m FROM early GROUP BY 1)
        SELECT o_custkey, o_orderkey, coalesce(m, (SELECT median(o_totalprice) FROM early)) AS score
        FROM orders LEFT JOIN g USING (o_custkey) WHERE o_orderdate >= TIMESTAMP '{FEW[0]}'""",
    "metric_ranking": f"""WITH {_SCORED}, ranks AS (SELECT y, score, row_number() OVER (ORDER BY score) AS r FROM scored),
        mid AS (SELECT y, score, avg(r) OVER (PARTITION BY score) AS r FROM ranks),
        auc AS (SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS v FROM mid),
        steps AS (SELECT score, sum(y) AS pos, count(*) AS n FROM scored GROUP BY score),
        ap AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER () AS p FROM steps WINDOW w AS (ORDER BY score DESC))
        SELECT {r4("(SELECT v FROM auc)")} AS roc_auc, {r4("(SELECT sum(pos * tp / seen) / max(p) FROM ap)")} AS average_precision""",
    "metric_threshold": f"""WITH {_SCORED} SELECT {r4("avg(CASE WHEN (score >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END)")} AS accuracy,
        {r4("2.0 * count(*) FILTER (score >= 0.5 AND y = 1) / (count(*) FILTER (score >= 0.5) + sum(y))")} AS f1 FROM scored""",
    "metric_regression": f"""SELECT {r4("avg(abs(l_extendedprice - l_quantity * 1500))")} AS mae, {r4("sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2))")} AS rmse,
        {r4("1 - sum((l_extendedprice - l_quantity * 1500) ** 2) / (var_pop(l_extendedprice) * count(*))")} AS r2 FROM lineitem""",
    "leaderboard_frame": f"WITH {_RESULTS} SELECT method, task, {r4('metric_error')} AS metric_error, {r4('time_train_s')} AS time_train_s, {r4('time_infer_s')} AS time_infer_s FROM frame",
    "leaderboard_dense": f"WITH {_RESULTS} SELECT task, count(*) AS n FROM dense GROUP BY task",
    "rescaled_loss": f"WITH {_RESULTS}, {_SCALED} SELECT method, {r4('avg(loss)')} AS loss FROM losses GROUP BY method",
    "avg_rank": f"""WITH {_RESULTS}, n AS (SELECT method, task, metric_error, row_number() OVER (PARTITION BY task ORDER BY metric_error) AS r FROM dense),
        m AS (SELECT method, avg(r) OVER (PARTITION BY task, metric_error) AS r FROM n) SELECT method, {r4('avg(r)')} AS rank FROM m GROUP BY method""",
    "winrate": f"WITH {_RESULTS}, {_PAIRS} SELECT a AS method, {r4('avg(win)')} AS win_rate FROM pairs GROUP BY a",
    "winrate_matrix": f"WITH {_RESULTS}, {_PAIRS} SELECT a, b, {r4('sum(win)')} AS wins, count(*) AS n FROM pairs GROUP BY a, b",
    "prediction_join": f"WITH {_SCORED} SELECT timestamp, c_custkey, y AS churn, score FROM scored",
    "results_meta": f"WITH {_RESULTS} SELECT method, f.task, {r4('metric_error')} AS metric_error, metric, {r4('fit_time_tuning')} AS fit_time_tuning FROM frame f JOIN results r ON model = method AND dataset || '/' || r.task = f.task",
    "loss_heatmap": f"""WITH {_RESULTS}, {_SCALED} SELECT task, {r4("max(loss) FILTER (method = 'A')")} AS "A", {r4("max(loss) FILTER (method = 'N')")} AS "N",
        {r4("max(loss) FILTER (method = 'R')")} AS "R" FROM losses GROUP BY task""",
    "reference_union": f"""WITH {_RESULTS} SELECT method, task, {r4('metric_error')} AS metric_error, {r4('time_train_s')} AS time_train_s FROM frame WHERE method <> 'R'
        UNION ALL SELECT 'A_ref', task, {r4('metric_error')}, NULL FROM frame WHERE method = 'A'""",
    "metric_pivot": "SELECT l_suppkey, " + ", ".join(
        r4(f"avg(l_discount) FILTER (l_returnflag {sign} 'N' AND l_linestatus = '{s}')") + f' AS "{split}_{s}"' for split, sign in (("val", "="), ("test", "<>")) for s in "OF"
    ) + " FROM lineitem GROUP BY l_suppkey",
    "fingerprint_table": "SELECT " + ", ".join(
        "bit_xor(" + _INT60.format(f"concat_ws('|', '{c}', c_custkey, {c})") + f") AS {c}" for c in ("c_custkey", "c_nationkey", "c_mktsegment")
    ) + " FROM customer",
    "target_moments": f"SELECT o_custkey, {r4('avg(o_totalprice)')} AS mean, {r4('coalesce(nullif(stddev_samp(o_totalprice), 0), 1)')} AS std FROM orders GROUP BY o_custkey",
    "critical_difference": f"""WITH {_RESULTS}, n AS (SELECT method, task, metric_error, row_number() OVER (PARTITION BY task ORDER BY metric_error) AS r FROM dense),
        m AS (SELECT method, task, avg(r) OVER (PARTITION BY task, metric_error) AS r FROM n),
        k AS (SELECT method, avg(r) AS rank, count(*) AS n_tasks FROM m GROUP BY method),
        d AS (SELECT *, {_Q3} * sqrt(3 * 4 / (6.0::DOUBLE * n_tasks)) AS cd FROM k)
        SELECT a.method, {r4('a.rank')} AS rank, a.n_tasks, {r4('a.cd')} AS cd, (SELECT count(*) FROM d b WHERE abs(a.rank - b.rank) <= a.cd) AS n_alike FROM d a""",
    "ensemble_link": f"SELECT l_orderkey, {r4('1 / (1 + exp(-avg(l_quantity / 10 - 2.5)))')} AS p FROM lineitem GROUP BY l_orderkey",
}
