"""Evaluation and forecasting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions.timefn import calendar
from gridlark.operators import attribution as SH
from gridlark.operators import features as FT
from gridlark.operators import metrics as M
from gridlark.operators import ml, prepared
from gridlark.operators import spatial as X
from gridlark.operators import timeseries as T
from gridlark.operators.iterate import saved, scratch
from gridlark.plans import series as Q
from gridlark.plans.helpers import big, r6, s6, sb, stamp
from gridlark.plans.series import W
from gridlark.plans.space import KINDS, KNN
from gridlark.plans.space import _counts as POI_COUNTS
from gridlark.plans.space import query as _query
from gridlark.sources import scenario as S
from gridlark.sources.artifacts import fingerprint
from gridlark.sources.files import Trials

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f):
        from gridlark.plans import space

        _query(sql, *views)(f)
        QUERIES[f.__name__] = space.QUERIES.pop(f.__name__)
        if sql is not None:
            ORACLE[f.__name__] = space.ORACLE.pop(f.__name__)
        return f

    return add


LAG = f"p AS (SELECT * FROM (SELECT *, lag(occ, 1) OVER ({W}) AS lag_1, hour(time) AS hour FROM obs) WHERE lag_1 IS NOT NULL)"
ERR = f"count(*) AS n_rows, {s6('avg(occ)', 'target_mean')}, {s6('avg(abs(occ - lag_1))', 'mae')}, {s6('avg(abs(occ - lag_1)) / avg(occ)', 'relative_mae')}, {s6('1 - sum(pow(occ - lag_1, 2)) / (var_pop(occ) * count(*))', 'r2')}"


def _persist(spark, sf):
    return T.lags(calendar(Q.obs(spark, sf)), (1,)).filter("lag_1 is not null")


@query(f", {LAG} SELECT {ERR} FROM p", "obs")
def metrics_global(spark, sf):
    return M.error_metrics(_persist(spark, sf), "occ", "lag_1").select("n_rows", r6("target_mean"), r6("mae"), r6("relative_mae"), r6("r2"))


@query(f", {LAG} SELECT {sb('hour', 'hour')}, {ERR} FROM p GROUP BY hour", "obs")
def metrics_by_group(spark, sf):
    return M.error_metrics(_persist(spark, sf), "occ", "lag_1", ["hour"]).select(big("hour"), "n_rows", r6("target_mean"), r6("mae"), r6("relative_mae"), r6("r2"))


@query(", h AS (SELECT unnest([5, 10, 30]) AS horizon_min, unnest([" + ", ".join(f"lead(occ, {k}) OVER ({W})" for k in (1, 2, 6)) + f"]) AS target, occ AS lag_1 FROM obs), p AS (SELECT horizon_min, target AS occ, lag_1 FROM h WHERE target IS NOT NULL) SELECT {sb('horizon_min', 'horizon_min')}, {ERR} FROM p GROUP BY horizon_min", "obs")
def metrics_by_horizon(spark, sf):
    h = (5, 10, 30)
    out = T.horizon_explode(T.horizon_targets(Q.obs(spark, sf), h), h)
    return M.error_metrics(out, "target", "occ", ["horizon_min"]).select(big("horizon_min"), "n_rows", r6("target_mean"), r6("mae"), r6("relative_mae"), r6("r2"))


@query(f"SELECT 'duration' AS feature, {s6('corr(duration, occ)', 'corr')} FROM obs UNION ALL SELECT 'e_price', {s6('corr(e_price, occ)', 'corr')} FROM obs UNION ALL SELECT 'idle', {s6('corr(idle, occ)', 'corr')} FROM obs", "obs")
def correlation_pearson(spark, sf):
    return M.pearson(Q.obs(spark, sf), ["duration", "e_price", "idle"], "occ").select("feature", r6("corr"))


def _rank_sql(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query(f", k AS (SELECT {_rank_sql('duration')} AS a, {_rank_sql('idle')} AS b, {_rank_sql('occ')} AS t FROM obs) SELECT 'duration' AS feature, {s6('corr(a, t)', 'corr')} FROM k UNION ALL SELECT 'idle', {s6('corr(b, t)', 'corr')} FROM k", "obs")
def correlation_spearman(spark, sf):
    return M.spearman(Q.obs(spark, sf), ["duration", "idle"], "occ").select("feature", r6("corr"))


SHARES = [0.05 + 0.9 * i / 9 for i in range(10)]


@query(f", q AS (SELECT quantile_cont(occ, [{', '.join(map(repr, SHARES))}]) AS q FROM obs) SELECT {sb('i - 1', 'bin')}, {s6('q[i]', 'value')} FROM q, range(1, 11) x(i)", "obs")
def quantiles(spark, sf):
    return M.quantile_grid(Q.obs(spark, sf), "occ").select(big("bin"), r6("value"))


@query(
    f", {LAG.replace(', hour(time) AS hour', ', (SELECT 0) AS z')}, sample AS (SELECT lag_1, s_price FROM p), g AS (SELECT i AS ix, j AS iy, i / 4.0::DOUBLE AS x, j * 30.0::DOUBLE AS y FROM range(5) a(i), range(1, 5) b(j)) "
    f"SELECT ix, iy, {s6('x', 'x')}, {s6('y', 'y')}, {s6('avg(greatest(0, least(1, 0.7 * x + 0.001 * y + 0.2 * lag_1 + s_price)))', 'value')} FROM sample, g GROUP BY ix, iy, x, y", "obs",
)
def pdp_grid(spark, sf):
    """Partial dependence of a linear scorer on the last value and the horizon, over all rows."""
    sample = _persist(spark, sf).select("lag_1", "s_price")
    grid = [(i, j, i / 4.0, j * 30.0) for i in range(5) for j in range(1, 5)]
    return M.partial_dependence(sample, grid, lambda x, y: 0.7 * x + 0.001 * y + 0.2 * F.col("lag_1") + F.col("s_price")).select(big("ix"), big("iy"), r6("x"), r6("y"), r6("value"))


@query(f", g AS (SELECT station_id, sum(duration) AS total FROM obs GROUP BY 1) SELECT station_id, {s6('total', 'total')}, {s6('total / sum(total) OVER ()', 'share')} FROM g", "obs")
def share_of_total(spark, sf):
    g = Q.obs(spark, sf).groupBy("station_id").agg(F.sum("duration").alias("total"))
    return M.share_of_total(g, "total").select(big("station_id"), r6("total"), r6("share"))


@query(f"SELECT {sb('i - 1', 'feature')}, {s6('avg(abs(embedding[i]))', 'mean_abs')} FROM embeddings, range(1, 65) x(i) GROUP BY i ORDER BY 2 DESC, 1 LIMIT 10")
def importance_topn(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("v"))
    return M.mean_abs_by_position(e, "v").select(big("feature"), r6("mean_abs")).orderBy(F.desc("mean_abs"), "feature").limit(10)


# Two trees of known leaves; left means up to the threshold. Their Shapley values are short enough for SQL.
TREES = [
    ({"feature": 0, "threshold": 250.0, "cover": 100, "left": {"feature": 1, "threshold": 0.4, "cover": 60, "left": {"value": 0.2, "cover": 30}, "right": {"value": 0.35, "cover": 30}}, "right": {"value": 0.6, "cover": 40}}, 1.0),
    ({"feature": 2, "threshold": 0.25, "cover": 100, "left": {"feature": 0, "threshold": 100.0, "cover": 30, "left": {"value": 0.1, "cover": 10}, "right": {"value": 0.3, "cover": 20}}, "right": {"value": 0.5, "cover": 70}}, 0.5),
]
TREE_FEATURES = ["duration", "s_price", "e_price"]
# a..: the first tree without features, with its first, its second and both; b..: the second tree, its weight included
GAME = (
    ", t AS (SELECT station_id, obs_id, coalesce(duration, 0) <= 250 AS d, coalesce(duration, 0) <= 100 AS d2, coalesce(s_price, 0) <= 0.4 AS s, coalesce(e_price, 0) <= 0.25 AS e FROM obs), "
    "v AS (SELECT station_id, obs_id, 0.6 * 0.275::DOUBLE + 0.4 * 0.6 AS a0, CASE WHEN d THEN 0.275 ELSE 0.6 END::DOUBLE AS a1, 0.6 * CASE WHEN s THEN 0.2 ELSE 0.35 END::DOUBLE + 0.24 AS a2, CASE WHEN NOT d THEN 0.6 WHEN s THEN 0.2 ELSE 0.35 END::DOUBLE AS a3, "
    "0.5 * (0.3 * (0.1::DOUBLE / 3 + 0.2) + 0.35) AS b0, 0.5 * CASE WHEN e THEN 0.1::DOUBLE / 3 + 0.2 ELSE 0.5 END AS b1, 0.5 * (0.3 * CASE WHEN d2 THEN 0.1 ELSE 0.3 END::DOUBLE + 0.35) AS b2, 0.5 * CASE WHEN NOT e THEN 0.5 WHEN d2 THEN 0.1 ELSE 0.3 END::DOUBLE AS b3 FROM t), "
    "g AS (SELECT *, (a1 - a0 + a3 - a2) / 2 + (b2 - b0 + b3 - b1) / 2 AS p0, (a2 - a0 + a3 - a1) / 2 AS p1, (b1 - b0 + b3 - b2) / 2 AS p2, (a3 - a1 - a2 + a0) / 2 AS i01, (b3 - b1 - b2 + b0) / 2 AS i02 FROM v)"
)


def _leaves():
    return [leaf for tree, weight in TREES for leaf in SH.leaves_of(tree, weight)]


@query(GAME + f" SELECT station_id, obs_id, {s6('a0 + b0', 'mean')}, {s6('a3 + b3', 'prediction')}, {s6('p0', 'duration')}, {s6('p1', 's_price')}, {s6('p2', 'e_price')} FROM g", "obs")
def attribution(spark, sf):
    """What each feature adds to the prediction of a small tree model, for every observation."""
    out = SH.attribute(_leaves(), Q.obs(spark, sf), TREE_FEATURES, ["station_id", "obs_id"])
    return out.select(big("station_id"), big("obs_id"), r6("mean"), r6("prediction"), *[r6(f, F.col("parts")[i]) for i, f in enumerate(TREE_FEATURES)])


_PAIR = {("duration", "duration"): "p0 - i01 - i02", ("s_price", "s_price"): "p1 - i01", ("e_price", "e_price"): "p2 - i02", ("duration", "s_price"): "i01", ("duration", "e_price"): "i02", ("s_price", "e_price"): "0"}


@query(GAME + " " + " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS other, {s6(f'avg(abs({v}))', 'mean_abs')} FROM g" for (x, y), v in _PAIR.items() for a, b in {(x, y), (y, x)}), "obs")
def interaction_matrix(spark, sf):
    """Mean absolute interactions of all pairs of features, over every observation."""
    return SH.interaction_matrix(_leaves(), Q.obs(spark, sf), TREE_FEATURES).select("feature", "other", r6("mean_abs"))


CUT = "2024-01-20"
_HOUR, _DOW = "14", "3"  # of NOW, a Thursday
_TARGET = f"(TIMESTAMP '{Q.NOW}' + to_microseconds(round(h * 60000000)::BIGINT))"


def _time_sql(t: str, prefix: str) -> list[str]:
    return [
        s6(f"isodow({t}) - 1", f"{prefix}_weekday"), s6(f"sin(2 * pi() * hour({t}) / 24)", f"{prefix}_hour_sin"), s6(f"cos(2 * pi() * hour({t}) / 24)", f"{prefix}_hour_cos"),
        s6(f"(strftime({t}, '%Y-%m-%d') IN ({Q.HOL}))::INT", f"{prefix}_is_holiday"), s6(f"(hour({t}) BETWEEN 7 AND 9)::INT", f"{prefix}_is_morning_peak"), s6(f"(hour({t}) BETWEEN 17 AND 19)::INT", f"{prefix}_is_evening_peak"),
    ]


_SERVING = [
    s6("h", "prediction_horizon_min"), s6("sqrt(h)", "horizon_sqrt"), *_time_sql(f"TIMESTAMP '{Q.NOW}'", "current"), *_time_sql(_TARGET, "target"), *[s6(f"w.{c}", c) for c in FT.WEATHER],
    s6("st.lon", "longitude"), s6("st.lat", "latitude"), s6("st.charge_count", "charge_count"), s6("st.tazid", "TAZID"), s6("z.p", "s_price"), s6("z.e", "e_price"), s6("coalesce(n.total, 0)", "poi_total_count"),
    *[s6(f"coalesce(n.{k}, 0)", f"poi_{k}_count") for k in KINDS], *[s6(f"coalesce(n.{k} / nullif(n.total, 0)::DOUBLE, 0)", f"poi_{c}_ratio") for k, c in zip(KINDS, ("lifestyle", "business_residential", "food_beverage"), strict=True)],
    s6("coalesce(f.a, g.v)", "station_avg_occupancy"), s6("coalesce(f.p, g.v)", "station_peak_avg_occupancy"), s6("coalesce(f.d, 0)", "station_avg_duration"), s6("coalesce(sh.v, gh.v, g.v)", "station_same_hour_occupancy"),
    s6("coalesce(gh.v, g.v)", "global_same_hour_occupancy"), *[s6(f"nb.{c}", c) for c in FT.NEIGHBOR], s6("z.a", "occupancy_lag_1"), s6("z.b", "occupancy_lag_3"), s6("z.c", "occupancy_lag_6"), s6("z.d", "occupancy_lag_12"),
    s6("z.m6", "occupancy_rolling_mean_6"), s6("z.m12", "occupancy_rolling_mean_12"), s6("z.s12", "occupancy_rolling_std_12"), s6("z.a - z.d", "occupancy_trend_12"),
]
SERVING = (
    f", {KNN}, {POI_COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY time DESC, obs_id DESC) AS rn FROM obs WHERE time <= TIMESTAMP '2024-01-25 14:35:00'), "
    "z AS (SELECT station_id, max(s_price) FILTER (rn = 1) AS p, max(e_price) FILTER (rn = 1) AS e, max(occ) FILTER (rn = 2) AS a, max(occ) FILTER (rn = 4) AS b, max(occ) FILTER (rn = 7) AS c, max(occ) FILTER (rn = 12) AS d, "
    "avg(occ) FILTER (rn BETWEEN 2 AND 7) AS m6, avg(occ) FILTER (rn > 1) AS m12, stddev_samp(occ) FILTER (rn > 1) AS s12, greatest(5, least(120, 5.5::DOUBLE + station_id * 7 % 130)) AS h FROM r WHERE rn <= 12 GROUP BY station_id HAVING count(*) = 12), "
    f"fit AS (SELECT *, hour(time) AS hour, isodow(time) - 1 AS weekday FROM obs WHERE time < TIMESTAMP '{CUT}'), f AS (SELECT station_id, avg(occ) AS a, coalesce(avg(occ) FILTER ({Q.PK}), avg(occ)) AS p, avg(duration) AS d FROM fit GROUP BY 1), g AS (SELECT avg(occ) AS v FROM fit), "
    f"gh AS (SELECT avg(occ) AS v FROM fit WHERE hour = {_HOUR}), gw AS (SELECT avg(occ) AS v FROM fit WHERE hour = {_HOUR} AND weekday = {_DOW}), sh AS (SELECT station_id, avg(occ) AS v FROM fit WHERE hour = {_HOUR} GROUP BY 1), "
    f"sw AS (SELECT station_id, avg(occ) AS v FROM fit WHERE hour = {_HOUR} AND weekday = {_DOW} GROUP BY 1), gp AS (SELECT avg(p) AS p, avg(d) AS d, avg(charge_count) AS c FROM f LEFT JOIN station USING (station_id)), "
    "nb AS (SELECT k.station_id, count(*) AS neighbor_count, avg(k.d) * 1000 AS neighbor_avg_distance_m, avg(coalesce(f.a, g.v)) AS neighbor_avg_station_occupancy, max(coalesce(f.a, g.v)) AS neighbor_max_station_occupancy, avg(coalesce(f.p, gp.p)) AS neighbor_avg_peak_occupancy, "
    "avg(coalesce(f.d, gp.d)) AS neighbor_avg_duration, avg(CASE WHEN f.a IS NULL THEN gp.c ELSE st.charge_count END) AS neighbor_avg_charge_count, avg(coalesce(sh.v, gh.v, g.v)) AS neighbor_avg_same_hour_occupancy, avg(coalesce(sw.v, gw.v, g.v)) AS neighbor_avg_same_weekday_hour_occupancy "
    "FROM k LEFT JOIN f ON f.station_id = k.neighbor_id LEFT JOIN station st ON st.station_id = k.neighbor_id LEFT JOIN sh ON sh.station_id = k.neighbor_id LEFT JOIN sw ON sw.station_id = k.neighbor_id, g, gp, gh, gw GROUP BY 1), "
    "w AS (SELECT * FROM weather WHERE weather_hour <= TIMESTAMP '2024-01-25 14:00:00' ORDER BY weather_hour DESC LIMIT 1)"
)


def _sources(spark, sf):
    """Profile rows, stations, weather, POI counts and neighbours, as assemble takes them."""
    o = saved(calendar(Q.obs(spark, sf)), "obs")
    s = saved(S.station(spark, sf), "stations")
    n = saved(X.knn(s, 5).select("station_id", "neighbor_id", "distance_km"), "neighbors")
    fit = o.filter(F.col("time") < F.lit(CUT).cast("timestamp_ntz"))
    return o, (fit, s, S.weather(spark, sf), saved(X.count_within(s, S.poi(spark, sf), 2.0, KINDS), "poi"), n)


def _requests(s):
    return s.select("station_id", (F.lit(5.5) + F.col("station_id") * 7 % 130).alias("horizon_min"))


@query(SERVING + f" SELECT z.station_id, {', '.join(_SERVING)} FROM z JOIN station st USING (station_id) LEFT JOIN n USING (station_id) LEFT JOIN f USING (station_id) LEFT JOIN sh USING (station_id) LEFT JOIN nb USING (station_id), g, gh, w", "station", "poi", "obs", "weather")
def serving_features(spark, sf):
    """All features of one request for every station, each for its own horizon."""
    o, sources = _sources(spark, sf)
    out = FT.serving_features(_requests(sources[1]), Q.NOW, o, *sources)
    return out.select(big("station_id"), *[r6(c) for c in FT.ALL])


def _training(spark, sf, horizons=(5, 30)):
    o, sources = _sources(spark, sf)
    f = T.horizon_explode(T.horizon_targets(T.train_state(o.select("station_id", "time", "obs_id", "occ", "s_price", "e_price")), horizons), horizons)
    f = f.select("station_id", "obs_id", "time", F.col("horizon_min").cast("double").alias("horizon_min"), "target", "s_price", "e_price", *FT.STATE)
    return saved(T.split_at(FT.assemble(f, *sources), F.lit(CUT).cast("timestamp_ntz")), "training"), o, sources


def gbt_predict(spark, sf):
    """Boosted trees of 5 trees of depth 4 on all features, trained on the days before CUT; predictions for the rest."""
    f, *_ = _training(spark, sf)
    m = ml.train(f.filter("part = 'train'"), FT.ALL, "target", trees=5, depth=4)
    return ml.predict(m, f.filter("part = 'test'"), FT.ALL).select(big("station_id"), big("obs_id"), r6("horizon_min"), r6("target"), r6("prediction"))


def gbt_serving(spark, sf):
    """Predicted occupancy of every station at its own horizon, and of those at odd horizons, by a model from the store."""
    f, o, sources = _training(spark, sf)
    m = prepared.trained(prepared.default_store(spark), "serving-model", f.filter("part = 'train'"), FT.ALL, "target", trees=3, depth=4)
    requests = _requests(sources[1])
    features = saved(FT.serving_features(requests, Q.NOW, o, *sources), "serving")
    own = FT.predict_requests(m, requests, features).select(big("station_id"), r6("horizon_min"), "predicted_occupancy", stamp("prediction_time"), "source")
    odd = ml.predict(m, FT.at_horizons(features, (7.5, 22, 61.25, 180)), FT.ALL)
    odd = odd.select(big("station_id"), r6("horizon_min"), F.col("prediction").alias("predicted_occupancy"), stamp("prediction_time", F.col("target_time")), F.lit("any horizon").alias("source"))
    return own.unionByName(odd).withColumn("predicted_occupancy", F.round("predicted_occupancy", 6))


def gbt_attribution(spark, sf):
    """Mean absolute part of each feature in the predictions of a trained model, over all test rows; parts add up to each prediction."""
    f, *_ = _training(spark, sf)
    names = [*FT.HORIZON, *FT.HISTORY, *FT.LAG]
    m = prepared.trained(prepared.default_store(spark), "attribution-model", f.filter("part = 'train'"), names, "target", trees=5, depth=4)
    told = SH.attribute(SH.model_leaves(m), f.filter("part = 'test'").select("station_id", "obs_id", *names), names, ["station_id", "obs_id"])
    return SH.mean_abs_parts(told, names).select("feature", r6("mean_abs"))


def gbt_ablation(spark, sf):
    """Errors of the named feature sets, with 3 trees of depth 3 each."""
    f, *_ = _training(spark, sf)
    rows = ml.ablation(f.filter("part = 'train'"), f.filter("part = 'test'"), FT.SETS, "target", trees=3, depth=3)
    return spark.createDataFrame([(r["feature_set"], r["n_features"], r["mae"], r["r2"]) for r in rows], "feature_set string, n_features int, mae double, r2 double")


GRID = {"trees": [2, 3, 4], "depth": [2, 3]}


def _search(spark, sf, name: str):
    """Training and validation rows of one horizon, and the log of the search's trials on just these rows."""
    f, *_ = _training(spark, sf, (5,))
    f = saved(T.split_at(f.filter("part = 'train'"), F.lit("2024-01-15").cast("timestamp_ntz")).select(*FT.LAG, "target", "part"), "search")
    log = Trials(spark, f"{scratch(spark)}/trials", name, fingerprint({"rows": f}))
    return f.filter("part = 'train'"), f.filter("part = 'test'"), log


def _settings(spark, rows):
    return spark.createDataFrame([(r["trees"], r["depth"], r["mae"], r["r2"]) for r in rows], "trees int, depth int, mae double, r2 double")


def random_search(spark, sf):
    """Two-stage search over tree settings for the horizon of 5 minutes, validated on the days before the test part."""
    fit, valid, log = _search(spark, sf, "random")
    return _settings(spark, ml.random_search(fit, valid, FT.LAG, "target", GRID, 2, 1, log=log))


def parzen_search(spark, sf):
    """Four trials of a Parzen search over the same settings: two at random, two proposed."""
    fit, valid, log = _search(spark, sf, "parzen")
    return _settings(spark, ml.parzen_search(lambda p: ml.evaluate(fit, valid, FT.LAG, "target", **p), GRID, 4, start=2, log=log))


QUERIES |= {f.__name__: f for f in (random_search, parzen_search, gbt_predict, gbt_serving, gbt_attribution, gbt_ablation)}
