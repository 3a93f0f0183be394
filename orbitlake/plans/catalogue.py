"""The registered queries of the trajectory engine, each with DuckDB SQL for the same rows.

The driver's tables stand in for run tables: ``events`` of a user are a
timeline, ``embeddings`` are 8 x 8 states in order of their ids, orders and line
items are runs with a status and features.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tensors
from ..functions.numbers import confidence
from ..operators import classify, planning, relational, summaries, timelines
from ..operators import matrix as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, t, v): the events of each user in order."""
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("v"))
    return rows.select("run_id", (F.row_number().over(w) - 1).alias("t"), "v")


OBS = "obs AS (SELECT user_id AS run_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS t, value AS v FROM events)"
RUN = ["run_id"]


# Timelines


@query(
    "timeline_agg_c1",
    f"WITH {OBS} SELECT run_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(coalesce(sum(v), 0), 6) AS total, round(max_by(v, t), 6) AS final, round(max_by(v, t) - min_by(v, t), 6) AS delta FROM obs GROUP BY run_id",
)
def timeline_agg_c1(spark, sf_dir):
    return rounded(timelines.aggregate_series(observations(spark, sf_dir), RUN))


@query(
    "stationarity",
    f"""WITH {OBS}, n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM obs), m AS (SELECT *, greatest(floor(n * 0.2)::INT, 1) AS tail FROM n)
    SELECT run_id, round(CASE WHEN max(n) >= 10 THEN abs(avg(v) FILTER (WHERE t >= n - tail) - avg(v) FILTER (WHERE t < tail)) / (stddev_pop(v) + 1e-8) END, 6) AS stat_delta FROM m GROUP BY run_id""",
)
def stationarity(spark, sf_dir):
    return rounded(timelines.stationarity(observations(spark, sf_dir), RUN))


@query("entropy_rate", f"WITH {OBS} SELECT run_id, round(CASE WHEN count(v) >= 3 AND var_pop(t) > 1e-8 THEN regr_slope(v, t) END, 6) AS slope FROM obs GROUP BY run_id")
def entropy_rate(spark, sf_dir):
    return rounded(timelines.slope(observations(spark, sf_dir), RUN))


@query("temporal_iqr", f"WITH {OBS} SELECT run_id, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr FROM obs GROUP BY run_id")
def temporal_iqr(spark, sf_dir):
    return rounded(timelines.iqr(observations(spark, sf_dir), RUN))


STEPS = f"{OBS}, steps AS (SELECT *, v - lag(v) OVER (PARTITION BY run_id ORDER BY t) AS d FROM obs)"


@query(
    "plateau_frac",
    f"""WITH {STEPS}, m AS (SELECT run_id, median(abs(d)) AS m FROM steps GROUP BY run_id)
    SELECT run_id, round(sum((abs(d) < greatest(0.1 * m, 1e-10))::INT) / greatest(count(d), 1), 6) AS plateau_frac FROM steps JOIN m USING (run_id) GROUP BY run_id""",
)
def plateau_frac(spark, sf_dir):
    return rounded(timelines.plateau(observations(spark, sf_dir), RUN))


@query(
    "cusum_delta",
    f"""WITH {OBS}, c AS (SELECT *, count(v) OVER (PARTITION BY run_id ORDER BY t) AS c, count(v) OVER (PARTITION BY run_id) AS n FROM obs),
    s AS (SELECT *, min(CASE WHEN c >= n // 2 THEN t END) OVER (PARTITION BY run_id) AS s FROM c)
    SELECT run_id, round(coalesce(avg(v) FILTER (WHERE t > s), 0) - coalesce(avg(v) FILTER (WHERE t <= s), 0), 6) AS cusum_delta FROM s GROUP BY run_id""",
)
def cusum_delta(spark, sf_dir):
    return rounded(timelines.half_shift(observations(spark, sf_dir), RUN))


@query(
    "changepoint",
    f"""WITH {OBS}, d AS (SELECT *, abs(lead(v) OVER (PARTITION BY run_id ORDER BY t) - v) AS d FROM obs), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY d DESC NULLS LAST, t) AS k FROM d)
    SELECT run_id, round(CASE WHEN count(v) >= 3 THEN max(CASE WHEN k = 1 THEN t END) / greatest(count(*), 1) END, 6) AS changepoint_t_norm FROM r GROUP BY run_id""",
)
def changepoint(spark, sf_dir):
    return rounded(timelines.changepoint(observations(spark, sf_dir), RUN))


@query(
    "pnn40",
    f"""WITH {STEPS}, s AS (SELECT *, stddev_pop(v) OVER (PARTITION BY run_id) AS s FROM steps)
    SELECT run_id, round(CASE WHEN count(*) > 1 THEN sum(coalesce((abs(d) > 0.4 * s)::INT, 0)) / (count(*) - 1) END, 6) AS pnn40 FROM s GROUP BY run_id""",
)
def pnn40(spark, sf_dir):
    return rounded(timelines.pnn(observations(spark, sf_dir), RUN))


SIGNS = f"{STEPS}, signs AS (SELECT *, CASE WHEN abs(d) < 1e-8 THEN 0 ELSE sign(d) END AS s FROM steps), turned AS (SELECT *, s <> lag(s) OVER (PARTITION BY run_id ORDER BY t) AS c FROM signs)"


@query("zero_crossings", f"WITH {SIGNS} SELECT run_id, coalesce(sum(c::INT), 0)::BIGINT AS sign_changes FROM turned GROUP BY run_id")
def zero_crossings(spark, sf_dir):
    return timelines.sign_changes(observations(spark, sf_dir), RUN)


@query(
    "phasic_turns",
    f"""WITH {SIGNS}, runs AS (SELECT *, sum(coalesce(c::INT, 1)) OVER (PARTITION BY run_id ORDER BY t) AS island FROM turned),
    sizes AS (SELECT run_id, island, CASE WHEN coalesce(max(s), 0) <> 0 OR coalesce(min(s), 0) <> 0 THEN count(*) ELSE 0 END AS size FROM runs GROUP BY run_id, island),
    best AS (SELECT run_id, max(size) AS size FROM sizes GROUP BY run_id), whole AS (SELECT run_id, count(*) AS n, coalesce(sum(c::INT), 0)::BIGINT AS r, (max(v) - min(v)) / (avg(abs(v)) + 1e-8) AS g FROM turned GROUP BY run_id)
    SELECT run_id, CASE WHEN n >= 2 THEN r END AS n_reversals, round(CASE WHEN n = 2 THEN 1.0 WHEN n > 2 THEN (greatest(size, 1) + 1) / n END, 6) AS max_monotone_frac, round(CASE WHEN n >= 2 THEN g END, 6) AS range_ratio FROM whole JOIN best USING (run_id)""",
)
def phasic_turns(spark, sf_dir):
    return rounded(timelines.turns(observations(spark, sf_dir), RUN))


@query(
    "lagged_causality",
    """WITH o AS (SELECT o_custkey AS run_id, (row_number() OVER w - 1)::INT AS t, o_totalprice AS a, date_diff('day', lag(o_orderdate) OVER w, o_orderdate)::DOUBLE AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    l AS (SELECT *, lead(a) OVER w AS an, lead(b) OVER w AS bn, lead(t) OVER w AS tn FROM o WINDOW w AS (PARTITION BY run_id ORDER BY t)),
    c AS (SELECT run_id, a - avg(a) OVER w AS c0, bn - avg(bn) OVER w AS c1, b - avg(b) OVER w AS c2, an - avg(an) OVER w AS c3 FROM l WHERE tn IS NOT NULL WINDOW w AS (PARTITION BY run_id))
    SELECT run_id, round(CASE WHEN count(*) >= 2 THEN abs(coalesce(sum(c0 * c1), 0) / (sqrt(coalesce(sum(c0 * c0), 0) * coalesce(sum(c1 * c1), 0)) + 1e-8)) - abs(coalesce(sum(c2 * c3), 0) / (sqrt(coalesce(sum(c2 * c2), 0) * coalesce(sum(c3 * c3), 0)) + 1e-8)) END, 6) AS asymmetry FROM c GROUP BY run_id""",
)
def lagged_causality(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), (F.row_number().over(w) - 1).alias("t"), F.col("o_totalprice").alias("a"), F.datediff(F.col("o_orderdate"), F.lag("o_orderdate").over(w)).cast("double").alias("b"))
    return rounded(timelines.lagged_asymmetry(rows, RUN, "a", "b"))


CENTRED = f"{OBS}, centred AS (SELECT run_id, t, v - avg(v) OVER (PARTITION BY run_id) AS c, count(*) OVER (PARTITION BY run_id) AS n FROM obs), energy AS (SELECT run_id, max(n) AS n, sum(c * c) AS e FROM centred GROUP BY run_id)"


@query(
    "autocorr_first_min",
    f"""WITH {CENTRED}, ac AS (SELECT a.run_id, b.t - a.t AS k, sum(a.c * b.c) / max(e.e) AS ac, max(e.n) // 2 AS half FROM centred a JOIN centred b ON a.run_id = b.run_id AND b.t > a.t AND b.t - a.t < a.n // 2 JOIN energy e ON e.run_id = a.run_id GROUP BY a.run_id, b.t - a.t),
    up AS (SELECT *, lead(ac) OVER (PARTITION BY run_id ORDER BY k) AS nxt FROM ac),
    f AS (SELECT run_id, least(coalesce(min(CASE WHEN ac < 0 THEN k END), max(half)), coalesce(min(CASE WHEN nxt > ac THEN k END), max(half))) AS m FROM up GROUP BY run_id)
    SELECT e.run_id, (CASE WHEN e.n // 2 >= 3 AND e.e >= 1e-8 THEN m END)::INT AS first_min_ac FROM energy e LEFT JOIN f USING (run_id)""",
)
def autocorr_first_min(spark, sf_dir):
    return timelines.first_minimum(observations(spark, sf_dir), RUN)


@query(
    "estimated_period",
    f"""WITH {CENTRED}, ac AS (SELECT a.run_id, b.t - a.t AS k, sum(a.c * b.c) / (max(e.e) + 1e-8) AS ac FROM centred a JOIN centred b ON a.run_id = b.run_id AND b.t >= a.t AND b.t - a.t < a.n // 4 JOIN energy e ON e.run_id = a.run_id GROUP BY a.run_id, b.t - a.t),
    w AS (SELECT *, lag(ac) OVER (PARTITION BY run_id ORDER BY k) AS l, coalesce(lead(ac) OVER (PARTITION BY run_id ORDER BY k), -1) AS r FROM ac)
    SELECT e.run_id, (min(CASE WHEN ac > l AND ac > r AND ac > 0.3 THEN k END))::INT AS period FROM energy e LEFT JOIN w USING (run_id) GROUP BY e.run_id""",
)
def estimated_period(spark, sf_dir):
    return timelines.period(observations(spark, sf_dir), RUN)


@query(
    "settling",
    f"""WITH {STEPS}, n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM steps), m AS (SELECT *, greatest(floor(n * 0.2)::INT, 1) AS tail, median(abs(d)) OVER (PARTITION BY run_id) AS md FROM n)
    SELECT run_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(max_by(v, t), 6) AS final, round(max_by(v, t) - min_by(v, t), 6) AS delta, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(regr_slope(v, t), 6) AS slope,
      round(CASE WHEN max(n) >= 10 THEN abs(avg(v) FILTER (WHERE t >= n - tail) - avg(v) FILTER (WHERE t < tail)) / (stddev_pop(v) + 1e-8) END, 6) AS stat_delta, round(sum((abs(d) < greatest(0.1 * md, 1e-10))::INT) / greatest(count(d), 1), 6) AS plateau_frac FROM m GROUP BY run_id""",
)
def flagship(spark, sf_dir):
    """Where a run's signal settles: its reducers, spread, slope, stationarity and share of small steps."""
    return rounded(timelines.settling(observations(spark, sf_dir), RUN))


# Screening: norms and relative steps of the event values


def screening(spark: SparkSession, sf_dir: str, runs: DataFrame | None = None) -> DataFrame:
    """What statuses and regimes are made of, from ``runs`` (run_id, t, v) or the events of each user."""
    w = Window.partitionBy("run_id").orderBy("t")
    step = F.abs(F.col("v") - F.lag("v").over(w)) / (F.abs("v") + F.abs(F.lag("v").over(w)) + 1e-8)
    obs = (observations(spark, sf_dir) if runs is None else runs).withColumns({"cos": F.coalesce(step, F.lit(0.0)), "delta": F.coalesce(F.abs(F.col("v") - F.lag("v").over(w)) / (F.abs("v") + 1e-8), F.lit(0.0))})
    whole = Window.partitionBy("run_id")
    return obs.select("run_id", "t", F.col("v").alias("frob"), "cos", "delta", (F.abs("v") < float("inf")).alias("fin"), (F.stddev_pop("v").over(whole) / (F.avg(F.abs("v")).over(whole) + 1e-8)).alias("spread"))


SCREEN = f"""{OBS}, scr AS (SELECT run_id, t, v AS frob, coalesce(abs(v - lag(v) OVER w) / (abs(v) + abs(lag(v) OVER w) + 1e-8), 0) AS cos, coalesce(abs(v - lag(v) OVER w) / (abs(v) + 1e-8), 0) AS delta,
  stddev_pop(v) OVER p / (avg(abs(v)) OVER p + 1e-8) AS spread, count(*) OVER p AS n FROM obs WINDOW w AS (PARTITION BY run_id ORDER BY t), p AS (PARTITION BY run_id)),
g AS (SELECT *, coalesce((frob > lag(frob) OVER (PARTITION BY run_id ORDER BY t))::INT, 0) AS grew FROM scr),
h AS (SELECT *, sum(grew) OVER (PARTITION BY run_id ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS last10 FROM g),
base AS (SELECT run_id, median(frob) AS b FROM scr WHERE t < n // 2 GROUP BY run_id),
st0 AS (SELECT run_id, max(n)::INT AS steps, min(CASE WHEN frob > b * 1e9 THEN t END) AS over_, max(spread) AS flat FROM h JOIN base USING (run_id) GROUP BY run_id),
st AS (SELECT s.run_id AS run_id, s.steps, CASE WHEN flat < 1e-4 THEN 'COLLAPSED' WHEN h.run_id IS NOT NULL THEN 'OK_TRUNCATED' ELSE 'OK' END AS run_status,
  (CASE WHEN NOT flat < 1e-4 AND h.run_id IS NOT NULL THEN over_ ELSE steps END)::INT AS t_effective
  FROM st0 s LEFT JOIN h ON h.run_id = s.run_id AND h.t = greatest(over_, 1) AND h.last10 >= least(10, h.n - 1))"""


@query("run_status", f"WITH {SCREEN} SELECT * FROM st")
def run_status(spark, sf_dir):
    return classify.statuses(screening(spark, sf_dir), RUN)


VALID = f"""{SCREEN}, v AS (SELECT s.*, st.run_status, st.t_effective, st.steps, CASE WHEN t < t_effective THEN cos ELSE 0 END AS cz, CASE WHEN t < t_effective THEN delta ELSE 0 END AS dz, CASE WHEN t < t_effective THEN frob ELSE 0 END AS fz, t < t_effective AS ok FROM scr s JOIN st USING (run_id)),
d AS (SELECT *, CASE WHEN ok AND lead(ok) OVER w THEN abs(lead(cz) OVER w - cz) END AS dc, CASE WHEN ok AND lead(ok) OVER w THEN CASE WHEN abs(lead(dz) OVER w - dz) < 1e-12 THEN 0 ELSE abs(lead(dz) OVER w - dz) END END AS dd, CASE WHEN abs(lead(cz) OVER w - cz) < 1e-8 OR NOT (ok AND lead(ok) OVER w) THEN 0 ELSE sign(lead(cz) OVER w - cz) END AS sg,
  CASE WHEN abs(lead(cz) OVER w - cz) < 1e-8 THEN 0 ELSE sign(lead(cz) OVER w - cz) END AS sc, CASE WHEN abs(lead(fz) OVER w - fz) < 1e-8 THEN 0 ELSE sign(lead(fz) OVER w - fz) END AS sf FROM v WINDOW w AS (PARTITION BY run_id ORDER BY t)),
ranks AS (SELECT run_id, list_sort(list(dc) FILTER (WHERE dc IS NOT NULL)) AS lc, list_sort(list(dd) FILTER (WHERE dd IS NOT NULL)) AS ld FROM d GROUP BY run_id),
fences AS (SELECT run_id, lc[floor(len(lc) * 0.75)::INT + 1] + 2.0 * (lc[floor(len(lc) * 0.75)::INT + 1] - lc[floor(len(lc) * 0.25)::INT + 1]) AS fc, ld[floor(len(ld) * 0.75)::INT + 1] + 2.0 * (ld[floor(len(ld) * 0.75)::INT + 1] - ld[floor(len(ld) * 0.25)::INT + 1]) AS fd FROM ranks),
marked AS (SELECT d.*, coalesce(dc > fc, false) AS far_c, coalesce(dd > fd, false) AS far_d, (CASE WHEN t < steps - 1 THEN sg END) <> lag(sg) OVER (PARTITION BY run_id ORDER BY t) AS turn,
  sf <> lag(sf) OVER (PARTITION BY run_id ORDER BY t) AS cf, sc <> lag(sc) OVER (PARTITION BY run_id ORDER BY t) AS cc FROM d JOIN fences USING (run_id)),
mean_ AS (SELECT run_id, sum(CASE WHEN ok THEN cz ELSE 0 END) / (sum(ok::INT) + 1e-8) AS mean, max(far_c::INT) AS far FROM marked GROUP BY run_id),
stat AS (SELECT run_id, steps, run_status, t_effective, max(mean) AS mean, max(far) AS far, sqrt(sum(CASE WHEN ok THEN (cz - mean) * (cz - mean) ELSE 0 END) / (sum(ok::INT) + 1e-8)) AS std, coalesce(sum(turn::INT), 0) / 2 AS nzc FROM marked JOIN mean_ USING (run_id) GROUP BY run_id, steps, run_status, t_effective),
cent AS (SELECT run_id, t, t_effective, cz - avg(cz) OVER (PARTITION BY run_id) AS c FROM marked WHERE ok), en AS (SELECT run_id, sum(c * c) AS e FROM cent GROUP BY run_id),
ac AS (SELECT a.run_id, b.t - a.t AS k, sum(a.c * b.c) / (max(e) + 1e-8) AS ac FROM cent a JOIN cent b ON a.run_id = b.run_id AND b.t >= a.t AND b.t - a.t < a.t_effective // 4 JOIN en ON en.run_id = a.run_id GROUP BY a.run_id, b.t - a.t),
pk AS (SELECT ac.*, lag(ac) OVER w AS l, coalesce(lead(ac) OVER w, -1) AS r, steps // 4 AS room FROM ac JOIN st USING (run_id) WINDOW w AS (PARTITION BY ac.run_id ORDER BY k)),
per AS (SELECT run_id, min(k)::DOUBLE AS period FROM pk WHERE ac > l AND ac > r AND ac > 0.3 AND k <= room - 2 GROUP BY run_id),
reg AS (SELECT s.*, std / (mean + 1e-8) AS cv, period, CASE WHEN run_status = 'OK_TRUNCATED' THEN 'EXPLOSIVE' WHEN period IS NULL AND std / (mean + 1e-8) < 0.3 THEN 'FLAT' WHEN period IS NOT NULL THEN 'OSCILLATING' WHEN far = 1 THEN 'TRANSITIONAL' ELSE 'MIXED' END AS regime FROM stat s LEFT JOIN per USING (run_id))"""


@query(
    "regime_class",
    f"WITH {VALID} SELECT run_id, run_status, t_effective, round(mean, 6) AS p1_cos_dissim_mean, round(std, 6) AS p1_cos_dissim_std, round(cv, 6) AS p1_cos_dissim_cv, nzc AS p1_n_zero_crossings, period AS p1_estimated_period, regime AS p1_regime_class FROM reg",
)
def regime_class(spark, sf_dir):
    return rounded(classify.regimes(screening(spark, sf_dir), RUN).drop("steps"))


MASK = f"""{VALID}, seeded AS (SELECT m.*, reg.period, far_c OR far_d OR coalesce(lag(far_c OR far_d) OVER (PARTITION BY m.run_id ORDER BY t), false) OR list_contains(list_transform(range(greatest(4, floor(m.steps * 0.02)::INT)), lambda i: floor(i * (m.steps - 1) / (greatest(4, floor(m.steps * 0.02)::INT) - 1))::INT), t) AS seed,
  greatest(1, floor(m.steps * 0.01)::INT) AS margin FROM marked m JOIN reg USING (run_id)),
near AS (SELECT *, coalesce(t - max(CASE WHEN seed THEN t END) OVER (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING) <= margin, false) OR coalesce(min(CASE WHEN seed THEN t END) OVER (PARTITION BY run_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - t <= margin, false) AS near,
  coalesce(sum(cf::INT) OVER (PARTITION BY run_id), 0) < 2 AND coalesce(sum(cc::INT) OVER (PARTITION BY run_id), 0) < 2 AS mono FROM seeded),
masked AS (SELECT *, (CASE WHEN mono THEN t = 0 OR t = greatest(t_effective - 1, 0) ELSE near END OR coalesce(run_status = 'OK' AND (t % period < 1.5 OR t % period > period - 1.5), false)) AND ok AND run_status IN ('OK', 'OK_TRUNCATED') AS mask FROM near)"""


@query("adaptive_mask", f"WITH {MASK} SELECT run_id, t, mask FROM masked")
def adaptive_mask(spark, sf_dir):
    return classify.masks(screening(spark, sf_dir), RUN).select("run_id", "t", "mask")


@query(
    "mask_geometry",
    f"""WITH {MASK}, s AS (SELECT *, mask AND NOT coalesce(lag(mask) OVER (PARTITION BY run_id ORDER BY t), false) AS start FROM masked)
    SELECT run_id, sum(start::INT)::DOUBLE AS mask_n_transitions, round(min(t) FILTER (WHERE mask) / max(steps), 6) AS mask_t_first_norm, round(max(t) FILTER (WHERE mask) / max(steps), 6) AS mask_t_last_norm,
      round(CASE WHEN sum(mask::INT) > 0 THEN sum(cos) FILTER (WHERE mask) / (sum(mask::INT) + 1e-8) END, 6) AS mask_mean_amplitude, round(max(cos) FILTER (WHERE mask), 6) AS mask_max_amplitude,
      round(CASE WHEN sum(start::INT) >= 2 THEN (max(t) FILTER (WHERE mask) - min(t) FILTER (WHERE mask)) / (sum(start::INT) - 1) / max(steps) END, 6) AS mask_mean_spacing_norm, round(sum(mask::INT) / max(steps), 6) AS mask_coverage_frac, sum(mask::INT)::BIGINT AS meta_n_svd FROM s GROUP BY run_id""",
)
def mask_geometry(spark, sf_dir):
    return rounded(classify.mask_geometry(classify.masks(screening(spark, sf_dir), RUN), RUN))


# States


@query(
    "tensor_layer_a",
    """WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), l AS (SELECT *, lag(x) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM e),
    a AS (SELECT *, list_sum(list_transform(x, lambda v: abs(v))) AS s1, list_sum(list_transform(x, lambda v: v * v)) AS s2, list_sum(list_transform(x, lambda v: v * v * v * v)) AS s4,
      CASE WHEN p IS NOT NULL THEN list_sum(list_transform(p, lambda v: v * v)) END AS sp, CASE WHEN p IS NOT NULL THEN list_sum(list_transform(range(1, 65), lambda i: x[i] * p[i])) END AS xp, CASE WHEN p IS NOT NULL THEN list_sum(list_transform(range(1, 65), lambda i: (x[i] - p[i]) * (x[i] - p[i]))) END AS d2,
      list_sum(list_transform(range(64), lambda i: (x[i + 1] - x[(i % 8) * 8 + i // 8 + 1]) * (x[i + 1] - x[(i % 8) * 8 + i // 8 + 1]))) AS asym FROM l)
    SELECT label, vec_id, round(sqrt(s2), 6) AS frob, round(sqrt(d2) / (sqrt(s2) + 1e-8), 6) AS delta_D, round(CASE WHEN p IS NOT NULL THEN 1 - greatest(-1, least(1, xp / (sqrt(s2) * sqrt(sp) + 1e-8))) END, 6) AS cos_dissim, 1.0::DOUBLE AS is_finite,
      round(-list_sum(list_transform(x, lambda v: abs(v) / (s1 + 1e-8) * ln(abs(v) / (s1 + 1e-8) + 1e-8))), 6) AS shannon_comp, round(s2 * s2 / (s4 + 1e-8) / 64, 6) AS ipr, round(sqrt(asym) / (sqrt(s2) + 1e-8), 6) AS mode_asymmetry_o2, round(d2 / (s2 + 1e-8), 6) AS bregman_cost,
      round(ln((sqrt(d2) + 1e-8) / (lag(sqrt(d2)) OVER (PARTITION BY label ORDER BY vec_id) + 1e-8)), 6) AS lyap_empirical, NULL::DOUBLE AS frob_gradient, round(sqrt(s2) * list_max(list_transform(x, lambda v: abs(v))) / (s1 + 1e-8), 6) AS volume_proxy FROM a""",
)
def tensor_layer_a(spark, sf_dir):
    states = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    made = tensors.observables(states, ["label"], "vec_id", "embedding", 8)
    # A distance to no previous state is null.
    return rounded(made.withColumn("cos_dissim", F.when(F.col("delta_D").isNotNull(), F.col("cos_dissim"))))


@query(
    "renyi2_entropy",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), g AS (SELECT vec_id, list_sum(list_transform(x, lambda v: v * v)) AS w, list_sum(list_transform(range(64), lambda q: pow(list_sum(list_transform(range(1, 9), lambda k: x[(q // 8) * 8 + k] * x[(q % 8) * 8 + k])), 2))) AS s FROM e)
    SELECT vec_id, round(-ln(s / ((w + 1e-8) * (w + 1e-8)) + 1e-8), 6) AS f2_renyi2_entropy FROM g""",
)
def renyi2_entropy(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return rounded(rows.select("vec_id", tensors.renyi2(F.col("x"), 8).alias("f2_renyi2_entropy")))


# Filters, joins, sets


@query("scope_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber IN (1)")
def scope_filter(spark, sf_dir):
    return relational.scope_filter(table(spark, sf_dir, "lineitem"), {"l_returnflag": ["A", "R"], "l_linenumber": 1, "l_linestatus": "all"}).select("l_orderkey", "l_linenumber", "l_quantity")


@query("exclude_ids", "SELECT p_partkey, p_brand FROM part WHERE NOT coalesce(p_brand IN ('Brand#11', 'Brand#22'), false) AND NOT coalesce(p_size IN (1, 2, 3), false)")
def exclude_ids(spark, sf_dir):
    return relational.exclude_ids(table(spark, sf_dir, "part"), {"p_brand": ["Brand#11", "Brand#22"], "p_size": [1, 2, 3]}).select("p_partkey", "p_brand")


@query("range_filter", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 20")
def range_filter(spark, sf_dir):
    return relational.range_filter(table(spark, sf_dir, "part"), "p_size", 10, 20).select("p_partkey", "p_size")


@query("dedup_first", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def dedup_first(spark, sf_dir):
    keys = ["l_partkey", "l_suppkey"]
    return relational.first_by_key(table(spark, sf_dir, "lineitem").select(*keys, "l_orderkey", "l_linenumber"), keys, [F.col("l_orderkey"), F.col("l_linenumber")])


@query("union_intersect_cols", "SELECT acctbal, nationkey FROM (SELECT c_acctbal AS acctbal, c_nationkey AS nationkey FROM customer UNION ALL SELECT s_acctbal, s_nationkey FROM supplier)")
def union_intersect_cols(spark, sf_dir):
    bare = lambda df: df.toDF(*[c.split("_", 1)[1] for c in df.columns]).drop("name", "address", "phone", "comment")
    customers, suppliers = bare(table(spark, sf_dir, "customer")), bare(table(spark, sf_dir, "supplier"))
    return relational.union_common([customers, suppliers]).select("acctbal", "nationkey")


@query("json_params", """SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events""")
def json_params(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_semi")


@query("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def anti_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("left_lookup_default", "SELECT c_custkey, coalesce(n_name, '?') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) ON c_nationkey = n_nationkey")
def left_lookup_default(spark, sf_dir):
    names = table(spark, sf_dir, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return relational.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), names, "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("strict_lookup", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def strict_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return relational.strict_lookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), names, "s_nationkey").select("s_suppkey", "n_name")


@query("theta_compat", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey % 2 = 0 OR n_nationkey % 2 = 1")
def theta_compat(spark, sf_dir):
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    # An even region takes every nation, an odd one those of rank 2: the rule of a rank constraint.
    constraint, rank = F.when(F.col("r_regionkey") % 2 == 1, "2"), F.when(F.col("n_nationkey") % 2 == 1, 2).otherwise(3)
    return regions.join(nations, planning.compatible(constraint, rank)).select("r_regionkey", "n_nationkey")


@query(
    "status_by_subset",
    "WITH s AS (SELECT o_custkey % 7 AS entity, o_orderstatus AS status, o_totalprice > 150000 AS big FROM orders) SELECT a.entity, a.n_all, coalesce(b.n_big, 0) AS n_big FROM (SELECT entity, count(*) AS n_all FROM s GROUP BY entity) a LEFT JOIN (SELECT entity, count(*) AS n_big FROM s WHERE big GROUP BY entity) b USING (entity)",
)
def status_by_subset(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("entity"), (F.col("o_totalprice") > 150000).alias("big"))
    return summaries.whole_and_subset(rows, "entity", F.col("big")).select("entity", F.col("n").alias("n_all"), F.col("n_subset").alias("n_big"))


@query(
    "set_overlap_jaccard",
    "WITH f AS (SELECT coalesce(c_acctbal > 5000, false) AS a, coalesce(c_mktsegment = 'BUILDING' OR c_acctbal > 8000, false) AS b FROM customer) SELECT sum((a AND b)::INT)::BIGINT AS n_both, sum((a AND NOT b)::INT)::BIGINT AS n_only_a, sum((NOT a AND b)::INT)::BIGINT AS n_only_b, round(CASE WHEN sum((a OR b)::INT) = 0 THEN 1 ELSE sum((a AND b)::INT) / sum((a OR b)::INT) END, 6) AS jaccard FROM f",
)
def set_overlap_jaccard(spark, sf_dir):
    return rounded(relational.overlap(table(spark, sf_dir, "customer"), F.col("c_acctbal") > 5000, (F.col("c_mktsegment") == "BUILDING") | (F.col("c_acctbal") > 8000)))


@query("manifest_grid", "WITH p AS (SELECT p_brand AS a, p_type AS b FROM part), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY a, b) SELECT a, b, coalesce(n, 0) AS n, n IS NULL AS missing FROM (SELECT DISTINCT a FROM p) CROSS JOIN (SELECT DISTINCT b FROM p) LEFT JOIN c USING (a, b)")
def manifest_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b"))
    return relational.grid(rows, "a", "b")


@query(
    "manifest_statuses",
    "WITH c AS (SELECT l_linenumber AS a, date_trunc('month', l_shipdate) AS b, l_linestatus || l_returnflag AS s, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT a, b, sum(n)::BIGINT AS n, string_agg(s || ':' || n, ',' ORDER BY s) AS statuses FROM c GROUP BY a, b) SELECT a, strftime(b, '%Y-%m') AS b, coalesce(n, 0)::BIGINT AS n, n IS NULL AS missing, statuses FROM (SELECT DISTINCT a FROM c) CROSS JOIN (SELECT DISTINCT b FROM c) LEFT JOIN g USING (a, b)",
)
def manifest_statuses(spark, sf_dir):
    """Line numbers by month of shipping, with the statuses of every cell."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("a"), F.date_format("l_shipdate", "yyyy-MM").alias("b"), F.concat("l_linestatus", "l_returnflag").alias("s"))
    return relational.grid(rows, "a", "b", "s").withColumn("statuses", summaries.map_text(F.col("statuses")))


@query("structural_null", "SELECT vec_id, CASE WHEN label % 2 = 0 THEN NULL ELSE label END AS odd_label, CASE WHEN label = 3 THEN list_transform(embedding[1:3], lambda v: NULL::FLOAT) ELSE embedding[1:3] END AS head FROM embeddings")
def structural_null(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("odd_label"), F.col("label").alias("k"), F.slice("embedding", 1, 3).alias("head"))
    return relational.structural_null(rows, {"odd_label": F.col("k") % 2 == 0, "head": F.col("k") == 3}).drop("k")


# Counts, statistics, verdicts


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(spark, sf_dir):
    return summaries.value_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")), ["status"])


@query(
    "triage_topk",
    "WITH c AS (SELECT o_orderstatus AS status, o_custkey AS item, count(*) AS n FROM orders GROUP BY ALL) SELECT status, item, n, round(n / total, 6) AS fraction, place::INT AS place FROM (SELECT *, sum(n) OVER (PARTITION BY status) AS total, row_number() OVER (PARTITION BY status ORDER BY n DESC, item) AS place FROM c) WHERE place <= 10",
)
def triage_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("item"))
    return rounded(summaries.top_per_group(rows, "status", "item"))


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG = "long AS (UNPIVOT (SELECT l_returnflag AS g, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE v)"


@query(
    "feature_stats",
    f"WITH {LONG} SELECT feature, count(v)::BIGINT AS n_valid, 0::BIGINT AS n_nan, 0::BIGINT AS n_inf, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.75), 4) AS q3 FROM long GROUP BY feature",
)
def feature_stats(spark, sf_dir):
    return rounded(summaries.column_stats(table(spark, sf_dir, "lineitem"), FEATURES), 4)


@query("group_summary", f"WITH {LONG} SELECT g, feature, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, 0.0::DOUBLE AS nan_rate, 0.0::DOUBLE AS inf_rate, count(*) AS n FROM long GROUP BY g, feature")
def group_summary(spark, sf_dir):
    return rounded(summaries.group_stats(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "g"), "g", FEATURES), 4)


@query("flag_stats", "SELECT sum((c_acctbal > 0)::INT)::BIGINT AS n_true, (count(c_acctbal) - sum((c_acctbal > 0)::INT))::BIGINT AS n_false, round(sum((c_acctbal > 0)::INT) / count(c_acctbal), 4) AS fraction FROM customer")
def flag_stats(spark, sf_dir):
    return summaries.flag_stats(table(spark, sf_dir, "customer"), F.col("c_acctbal") > 0)


@query(
    "anomaly_rows",
    "WITH d AS (SELECT user_id, event_id, value AS a, value / nullif(event_id % 5, 0) AS b FROM events) SELECT user_id, event_id, ((a IS NULL)::INT + (b IS NULL)::INT) AS n_nan, 0 AS n_inf FROM d WHERE a IS NULL OR b IS NULL",
)
def anomaly_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("a"), (F.col("value") / F.nullif(F.col("event_id") % 5, F.lit(0))).alias("b"))
    return relational.anomalies(rows, ["a", "b"], ["user_id", "event_id"]).select("user_id", "event_id", "n_nan", "n_inf")


@query("family_counts", "SELECT CASE WHEN upper(split_part(id, '-', 1)) IN ('SYM', 'ASY', 'R3', 'RN') THEN upper(split_part(id, '-', 1)) ELSE 'UNKNOWN' END AS family, count(*) AS n FROM (SELECT (['sym', 'ASY', 'r3', 'RN', 'X'])[(p_partkey % 5 + 1)] || '-00' || (p_partkey % 9) AS id FROM part) GROUP BY 1")
def family_counts(spark, sf_dir):
    heads = F.array(*[F.lit(h) for h in ("sym", "ASY", "r3", "RN", "X")])
    ids = F.concat(F.get(heads, (F.col("p_partkey") % 5).cast("int")), F.lit("-00"), (F.col("p_partkey") % 9).cast("string"))
    return summaries.value_counts(table(spark, sf_dir, "part").select(summaries.family(ids).alias("family")), ["family"])


WIDTH = 64  # components of an embedding
DIMS = [f"e{i}" for i in range(WIDTH)]
VECTORS = "vecs AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(WIDTH)) + " FROM embeddings)"
LONG_VECTORS = f"{VECTORS}, long AS (UNPIVOT (SELECT label, {', '.join(DIMS)} FROM vecs) ON {', '.join(DIMS)} INTO NAME feature VALUE v)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(WIDTH)])


@query("cluster_profile", f"WITH {LONG_VECTORS} SELECT label, feature, round(median(v), 6) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, 0.0::DOUBLE AS nan_frac, count(*) AS n FROM long GROUP BY label, feature")
def cluster_profile(spark, sf_dir):
    return rounded(summaries.cluster_profile(vectors(spark, sf_dir), "label", DIMS))


@query("entity_quartiles", f"WITH {LONG_VECTORS} SELECT label, feature, round(median(v), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3, count(v) AS n FROM long GROUP BY label, feature")
def entity_quartiles(spark, sf_dir):
    return rounded(summaries.quartiles(vectors(spark, sf_dir), "label", DIMS))


COMPOSITION = "c AS (SELECT o_custkey % 13 AS cluster, o_orderpriority AS item, count(*) AS n FROM orders GROUP BY ALL), f AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster) AS fraction, first(item) OVER (PARTITION BY cluster ORDER BY n DESC, item) AS dominant FROM c)"


@query("cluster_composition", f"WITH {COMPOSITION} SELECT cluster, item, n, round(fraction, 6) AS fraction, dominant FROM f")
def cluster_composition(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 13).alias("cluster"), F.col("o_orderpriority").alias("item"))
    return rounded(summaries.distribution(rows, "cluster", "item"))


@query(
    "cluster_coherence",
    f"WITH {COMPOSITION} SELECT cluster, sum(n)::BIGINT AS n, first(dominant) AS dominant, round(max(fraction), 6) AS dominant_fraction, round(CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(fraction * log2(fraction)) / log2(count(*)) END, 6) AS entropy, max(fraction) > 0.7 AS is_pure, max(fraction) < 0.5 AS is_mixed FROM f GROUP BY cluster",
)
def cluster_coherence(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 13).alias("cluster"), F.col("o_orderpriority").alias("item"))
    return rounded(summaries.coherence(rows, "cluster", "item"))


ENTITY = """r AS (SELECT o_custkey % 29 AS entity, (o_orderkey % 7) - 2 AS label, o_orderstatus AS status FROM orders),
c AS (SELECT entity, label, count(*) AS n FROM r WHERE label >= 0 GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY entity) AS n_clustered, row_number() OVER (PARTITION BY entity ORDER BY n DESC, label) AS place FROM c),
p AS (SELECT entity, count(*) AS n_runs, avg((status = 'F')::INT) AS explosion_rate FROM r GROUP BY entity)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 29).alias("entity"), ((F.col("o_orderkey") % 7) - 2).alias("label"), F.col("o_orderstatus").alias("status"))


@query(
    "entity_profiles",
    f"""WITH {ENTITY} SELECT entity, n_runs, round(explosion_rate, 6) AS explosion_rate, coalesce(n_clustered, 0)::BIGINT AS n_clustered, label AS dominant, round(n / n_clustered, 6) AS concentration,
    CASE WHEN explosion_rate > 0.8 THEN 'EXCLURE' WHEN explosion_rate > 0.3 THEN 'EXPLORER' WHEN n / n_clustered > 0.7 THEN 'CONSERVER' ELSE 'EXPLORER' END AS verdict FROM p LEFT JOIN (SELECT * FROM k WHERE place = 1) USING (entity)""",
)
def entity_profiles(spark, sf_dir):
    made = summaries.entity_profiles(entities(spark, sf_dir), "entity", "label", F.col("status") == "F")
    return rounded(made.withColumn("verdict", summaries.verdict(F.col("explosion_rate"), F.col("concentration"), F.col("n_clustered"))))


@query(
    "entity_distributions",
    f"""WITH {ENTITY}, s AS (SELECT entity, string_agg(status || ':' || n, ',' ORDER BY status) AS statuses FROM (SELECT entity, status, count(*) AS n FROM r GROUP BY ALL) GROUP BY entity), l AS (SELECT entity, string_agg(label || ':' || n, ',' ORDER BY label) AS clusters FROM c GROUP BY entity)
    SELECT entity, n_runs, statuses, clusters FROM p LEFT JOIN s USING (entity) LEFT JOIN l USING (entity)""",
)
def entity_distributions(spark, sf_dir):
    """How each entity's runs spread over statuses and clusters, as maps (here: as text)."""
    made = summaries.entity_profiles(entities(spark, sf_dir), "entity", "label", F.col("status") == "F", maps={"statuses": "status", "clusters": "label"})
    return made.select("entity", "n_runs", *[summaries.map_text(F.col(c)).alias(c) for c in ("statuses", "clusters")])


@query(
    "first_by_file",
    "WITH u AS (SELECT 0 AS f, row_number() OVER () AS r, o_custkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT 1, row_number() OVER (), c_custkey, c_acctbal FROM customer) SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f, r) AS place FROM u) WHERE place = 1",
)
def first_by_file(spark, sf_dir):
    """Two files with conflicting rows of the same keys: the first row in the order of files and rows stays."""
    from ..sources import tables

    rows = [tables.with_place(spark, 0, f"{sf_dir}/orders.parquet").selectExpr("o_custkey AS k", "o_totalprice AS v", *tables.PLACE), tables.with_place(spark, 1, f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS k", "c_acctbal AS v", *tables.PLACE)]
    return relational.first_by_key(relational.union_common(rows), ["k"], [F.col(c) for c in tables.PLACE]).select("k", "v")


@query("universality", "WITH c AS (SELECT l_returnflag AS entity, l_linestatus AS cluster, count(*) AS n, count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY ALL), f AS (SELECT *, n / sum(n) OVER (PARTITION BY entity) AS fraction FROM c) SELECT entity, cluster, n, round(fraction, 6) AS fraction FROM f WHERE fraction > 0.4 AND k >= 5")
def universality(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("entity"), F.col("l_linestatus").alias("cluster"), F.col("l_linenumber").alias("line"))
    return rounded(summaries.universality(rows, "cluster", "entity", 0.4, enforce_min=5, other="line"))


@query("synthesis_rollup", "SELECT l_returnflag AS strate, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def synthesis_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup(F.col("l_returnflag").alias("strate")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("recurrence", "SELECT c_nationkey AS item, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey")
def recurrence(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.lit(1).alias("g"), F.col("c_nationkey").alias("item"))
    return rounded(summaries.distribution(rows, "g", "item").select("item", "n", "fraction"))


@query("omega_squared", "WITH g AS (SELECT l_returnflag AS f, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS w FROM lineitem GROUP BY ALL), a AS (SELECT sum(n)::BIGINT AS n, count(*) AS k, sum(w) AS ssw, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS ssb FROM g) SELECT round((ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw + ssw / (n - k)), 6) AS omega_squared, n, k FROM a")
def omega_squared(spark, sf_dir):
    return rounded(summaries.omega_squared(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"))


@query("cramers_v", "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb FROM c) SELECT round(sqrt((sum(n * n / (ra * rb)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS cramers_v, sum(n)::BIGINT AS n FROM m")
def cramers_v(spark, sf_dir):
    return rounded(summaries.cramers_v(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


# Designs


@query(
    "design_expansion",
    "SELECT g.n_nationkey AS gamma, e.r_regionkey AS encoding, n_dof, rank_eff FROM nation g CROSS JOIN (SELECT *, CASE WHEN r_regionkey % 2 = 0 THEN 2 ELSE 3 END AS rank_eff FROM region) e CROSS JOIN (SELECT unnest([10, 50, 250]) AS n_dof) WHERE (g.n_nationkey % 3 <> 0 OR rank_eff = 2) AND NOT (rank_eff >= 3 AND n_dof >= 250)",
)
def design_expansion(spark, sf_dir):
    gammas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("gamma"), F.when(F.col("n_nationkey") % 3 == 0, "2").alias("rank_constraint"))
    encodings = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("encoding"), F.when(F.col("r_regionkey") % 2 == 0, 2).otherwise(3).alias("rank_eff"))
    sizes = spark.range(1).select(F.explode(F.array(F.lit(10), F.lit(50), F.lit(250))).alias("n_dof"))
    return planning.product(gammas, encodings, sizes).select("gamma", "encoding", "n_dof", "rank_eff")


@query("batch_chunks", "SELECT l_returnflag, l_orderkey, l_linenumber, ((row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber) - 1) // 512)::BIGINT AS batch FROM lineitem")
def batch_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")
    return planning.batches(rows, ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber"]).drop("l_linestatus")


@query(
    "seed_mix",
    """WITH h AS (SELECT p_partkey, md5(p_brand || ':' || p_type) AS m FROM part), w AS (SELECT p_partkey, ('0x' || m[7:8] || m[5:6] || m[3:4] || m[1:2])::HUGEINT AS w FROM h)
    SELECT p_partkey, (((p_partkey * 123457::HUGEINT) // 4294967296) * 4294967296 + ((((p_partkey * 123457::HUGEINT) % 4294967296) * 2654435761 + w) % 4294967296))::BIGINT AS seed FROM w""",
)
def seed_mix(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", planning.seed_of_run(F.col("p_partkey") * 123457, F.col("p_brand"), F.col("p_type")).alias("seed"))


# The matrix


@query("median_impute", f"WITH {VECTORS}, h AS (SELECT * REPLACE (CASE WHEN vec_id % 3 = 0 THEN NULL ELSE e0 END AS e0) FROM vecs) SELECT vec_id, " + ", ".join(f"round(coalesce({d}, (SELECT median({d}) FROM h)), 6) AS {d}" for d in DIMS) + " FROM h")
def median_impute(spark, sf_dir):
    rows = vectors(spark, sf_dir).drop("label").withColumn("e0", F.when(F.col("vec_id") % 3 != 0, F.col("e0")))
    return rounded(M.impute(rows, DIMS))


@query("signed_log", "WITH c AS (SELECT p_partkey, exp(p_size) AS wide, p_retailprice AS narrow FROM part), s AS (SELECT max(abs(wide)) / (min(abs(wide)) + 1e-10) > 1e6 AS big FROM c) SELECT p_partkey, round(CASE WHEN big THEN sign(wide) * ln(1 + abs(wide)) ELSE wide END, 6) AS wide, round(narrow, 6) AS narrow FROM c, s")
def signed_log(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.exp("p_size").alias("wide"), F.col("p_retailprice").alias("narrow"))
    return rounded(M.compress(rows, ["wide", "narrow"]))


QUARTILES = "q AS (SELECT " + ", ".join(f"median({d}) AS m_{d}, quantile_cont({d}, 0.75) - quantile_cont({d}, 0.25) AS i_{d}" for d in DIMS) + " FROM vecs)"


@query("robust_scale", f"WITH {VECTORS}, {QUARTILES} SELECT vec_id, " + ", ".join(f"round(({d} - m_{d}) / CASE WHEN i_{d} = 0 THEN 1 ELSE i_{d} END, 6) AS {d}" for d in DIMS) + " FROM vecs, q")
def robust_scale(spark, sf_dir):
    return rounded(M.robust_scale(vectors(spark, sf_dir).drop("label"), DIMS))


@query("correlations", f"WITH {VECTORS} SELECT " + ", ".join(f"round(corr(e0, e{i}), 6) AS r{i}" for i in range(1, WIDTH)) + " FROM vecs")
def correlations(spark, sf_dir):
    return rounded(M.correlations(vectors(spark, sf_dir), "e0", DIMS[1:]))


@query(
    "percentile_rank_conf",
    f"WITH {VECTORS}, m AS (SELECT label, median(e0) AS x FROM vecs GROUP BY label), r AS (SELECT m.label, x, avg((e0 <= x)::INT) AS rank FROM m, vecs GROUP BY m.label, x) SELECT label, round(x, 6) AS x, round(rank, 6) AS rank, round(least(greatest(rank, 0), 1), 6) AS upper, round(least(greatest(1 - rank, 0), 1), 6) AS lower FROM r",
)
def percentile_rank_conf(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    medians = rows.groupBy("label").agg(F.percentile("e0", 0.5).alias("x"))
    made = summaries.percentile_rank(rows, "e0", medians, "label")
    return rounded(made.select("label", "x", "rank", confidence(F.col("rank"), "upper").alias("upper"), confidence(F.col("rank"), "lower").alias("lower")))


# Reading, choosing and planning


@query("one_seed", "SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def one_seed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return relational.one_seed(rows, ("o_custkey", "o_orderstatus"), ("o_orderkey",))


@query("triage_split", "SELECT status IN ('OK', 'OK_TRUNCATED') AS healthy, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'OK' WHEN 'P' THEN 'OK_TRUNCATED' ELSE 'EXPLOSION' END AS status FROM orders) GROUP BY 1")
def triage_split(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "OK").when(F.col("o_orderstatus") == "P", "OK_TRUNCATED").otherwise("EXPLOSION")
    good, bad = relational.triage(table(spark, sf_dir, "orders").select(status.alias("run_status")))
    count = lambda df, healthy: df.agg(F.count("*").alias("n")).select(F.lit(healthy).alias("healthy"), "n").filter("n > 0")
    return count(good, True).unionByName(count(bad, False))


@query("nearest_rank", f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY run_id) AS n FROM obs) SELECT run_id, round(max(CASE WHEN k = least(floor(n * 0.25), n - 1) THEN v END), 6) AS q1, round(max(CASE WHEN k = least(floor(n * 0.75), n - 1) THEN v END), 6) AS q3 FROM r GROUP BY run_id")
def nearest_rank(spark, sf_dir):
    rows = observations(spark, sf_dir).groupBy("run_id").agg(F.sort_array(F.collect_list("v")).alias("x"))
    return rounded(rows.select("run_id", classify.ranked(F.col("x"), 0.25).alias("q1"), classify.ranked(F.col("x"), 0.75).alias("q3")))


@query("materialize_features", "SELECT round(value::FLOAT::DOUBLE, 3) AS value, NULL::DOUBLE AS absent FROM events")
def materialize_features(spark, sf_dir):
    from ..sources import tables

    made = tables.features(table(spark, sf_dir, "events"), ["value", "absent"])
    return rounded(made.select(F.col("value").cast("double").alias("value"), F.col("absent").cast("double").alias("absent")), 3)


@query("materialize_timelines", "SELECT vec_id, (i - 1)::INT AS t, round((embedding[i])::DOUBLE, 6) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def materialize_timelines(spark, sf_dir):
    from ..sources import tables

    rows = table(spark, sf_dir, "embeddings")
    full = tables.series(rows, ["embedding"], keep=["vec_id"])
    return rounded(full.select("vec_id", F.posexplode("embedding").alias("t", "v")).withColumn("v", F.col("v").cast("double")))


@query(
    "strata",
    "WITH r AS (SELECT o_orderkey, o_custkey % 5 AS gamma_id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END AS rank_eff, CASE WHEN o_custkey % 5 = 4 THEN NULL ELSE o_totalprice END AS trace FROM orders), s AS (SELECT gamma_id, bool_or(trace IS NOT NULL) AS seen FROM r GROUP BY gamma_id) SELECT 'rank' || rank_eff || CASE WHEN CASE gamma_id WHEN 0 THEN true WHEN 1 THEN false ELSE seen END THEN '_diff' ELSE '_nodiff' END AS strate, count(*) AS n FROM r JOIN s USING (gamma_id) GROUP BY 1",
)
def strata(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("gamma_id"), F.when(F.col("o_orderkey") % 2 == 0, 2).otherwise(3).alias("rank_eff"), F.when(F.col("o_custkey") % 5 != 4, F.col("o_totalprice")).alias("trace"))
    known = spark.range(2).select(F.col("id"), (F.col("id") == 0).alias("differentiable"))
    return summaries.value_counts(M.strata(rows, known, "trace"), ["strate"])


@query("weight_grid", "SELECT round(0.5 + a * 0.25, 6) AS w0, round(0.5 + b * 0.25, 6) AS w1, printf('w_%.2f-GAM-001-w_%.2f-GAM-004', 0.5 + a * 0.25, 0.5 + b * 0.25) AS id FROM range(3) x(a), range(3) y(b)")
def weight_grid(spark, sf_dir):
    from ..functions import atomics

    entries = planning.gamma_axis({"sequence": [["GAM-001"], ["GAM-004"]], "weights": {"range": [0.5, 1.0], "step": 0.25}}, atomics.registries()["gamma"])
    return rounded(planning.axis_table(spark, entries).select(F.get("weights", 0).alias("w0"), F.get("weights", 1).alias("w1"), "id"))


@query("dry_run", "SELECT count(*) AS n_samples, count(DISTINCT (n_regionkey, n_nationkey % 2)) AS n_groups, 40 AS max_it FROM nation")
def dry_run(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("gamma_id"), (F.col("n_nationkey") % 2).alias("rank_eff"), F.lit(10).alias("n_dof"), F.lit(40).alias("max_it"))
    return planning.dry_run(rows)


@query("runtime_null", f"WITH {OBS}, s AS (SELECT run_id, count(*) AS n, sum((v > 90)::INT) AS k, min(CASE WHEN v > 90 THEN t END) AS f FROM obs GROUP BY run_id) SELECT run_id, round(CASE WHEN k = 0 THEN NULL ELSE f / n END, 6) AS first_norm, round(CASE WHEN k < 2 THEN NULL ELSE k / n END, 6) AS spacing FROM s")
def runtime_null(spark, sf_dir):
    from ..operators import features

    per = observations(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n"), F.sum((F.col("v") > 90).cast("int")).alias("mask_n_transitions"), F.min(F.when(F.col("v") > 90, F.col("t"))).alias("f"))
    made = per.select("run_id", "mask_n_transitions", (F.coalesce("f", F.lit(0)) / F.col("n")).alias("mask_t_first_norm"), (F.col("mask_n_transitions") / F.col("n")).alias("mask_mean_spacing_norm"))
    return rounded(features.runtime_null(made).select("run_id", F.col("mask_t_first_norm").alias("first_norm"), F.col("mask_mean_spacing_norm").alias("spacing")))


@query("inclusion_profile", f"WITH {VECTORS}, c AS (SELECT label, corr(e0, e1) AS r, count(*) AS n FROM vecs GROUP BY label) SELECT label, round(r, 6) AS r, n FROM c")
def inclusion_profile(spark, sf_dir):
    return rounded(M.correlation_by(vectors(spark, sf_dir), "label", "e0", "e1"))


# Numerical kernels and iterative algorithms: no SQL; tests hold them against closed forms and brute force.


@query("tensor_spectral_b")
def tensor_spectral_b(spark, sf_dir):
    """Layer B of every embedding as an 8 x 8 state."""
    import numpy as np
    import pandas as pd

    from ..functions import spectra
    from ..functions.constants import TIMELINES_B

    names = TIMELINES_B[:11]

    def step(frames):
        for frame in frames:
            states = np.stack(frame["embedding"]).astype(float).reshape(-1, 8, 8)
            yield pd.concat([frame[["vec_id"]].reset_index(drop=True), pd.DataFrame(spectra.spectra(states), columns=list(names))], axis=1)

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter("embedding is not null")
    return rounded(rows.mapInPandas(step, "vec_id long, " + ", ".join(f"{n} double" for n in names)))


#: The map of recursive least squares from (value, step) to the next, by run and step; ``fitted`` is after the last one.
RECURRENCE = f"""{STEPS}, s AS (SELECT run_id, t, v AS y1, coalesce(d, 0) AS y2 FROM steps),
    r(run_id, t, x1, x2, a11, a12, a21, a22, p11, p12, p22) AS (
      SELECT run_id, t, y1, y2, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1e4::DOUBLE, 0.0::DOUBLE, 1e4::DOUBLE FROM s WHERE t = 0
      UNION ALL SELECT run_id, t, y1, y2, a11 + (y1 - a11 * x1 - a12 * x2) * q1 / den, a12 + (y1 - a11 * x1 - a12 * x2) * q2 / den, a21 + (y2 - a21 * x1 - a22 * x2) * q1 / den, a22 + (y2 - a21 * x1 - a22 * x2) * q2 / den,
        p11 - q1 * q1 / den, p12 - q1 * q2 / den, p22 - q2 * q2 / den
      FROM (SELECT r.run_id, s.t, s.y1, s.y2, x1, x2, a11, a12, a21, a22, p11, p12, p22, p11 * x1 + p12 * x2 AS q1, p12 * x1 + p22 * x2 AS q2, 1 + x1 * (p11 * x1 + p12 * x2) + x2 * (p12 * x1 + p22 * x2) + 1e-8 AS den FROM r JOIN s ON s.run_id = r.run_id AND s.t = r.t + 1)),
    fitted AS (SELECT run_id, t + 1::BIGINT AS steps, a11, a12, a21, a22 FROM r JOIN (SELECT run_id, max(t) AS t FROM s GROUP BY run_id) USING (run_id, t))"""


@query(
    "dmd_modes",
    f"""WITH RECURSIVE {RECURRENCE}, m AS (SELECT *, (a11 + a22) / 2 AS h, pow((a11 + a22) / 2, 2) - (a11 * a22 - a12 * a21) AS disc FROM fitted),
    e AS (SELECT *, CASE WHEN disc < 0 THEN sqrt(h * h - disc) ELSE abs(h + sqrt(greatest(disc, 0))) END AS l1, CASE WHEN disc < 0 THEN sqrt(h * h - disc) ELSE abs(h - sqrt(greatest(disc, 0))) END AS l2 FROM m),
    f AS (SELECT *, l1 / (l1 + l2 + 1e-8) AS s1, l2 / (l1 + l2 + 1e-8) AS s2 FROM e)
    SELECT run_id, round(CASE WHEN steps >= 3 THEN greatest(l1, l2) END, 4) AS f7_dmd_spectral_radius, CASE WHEN disc < 0 AND sqrt(-disc) > 1e-4 THEN 2 ELSE 0 END::DOUBLE AS f7_dmd_n_complex_pairs,
      round(CASE WHEN steps >= 3 THEN -s1 * ln(s1 + 1e-8) - s2 * ln(s2 + 1e-8) END, 4) AS f7_dmd_spectral_entropy, round(CASE WHEN steps >= 3 THEN ln(greatest(l1, l2) + 1e-8) END, 4) AS f7_dmd_decay_rate FROM f""",
)
def dmd_modes(spark, sf_dir):
    """Dynamic modes of every user's events: the value and its step as observables."""
    import numpy as np
    import pandas as pd

    from ..functions import spectra
    from ..functions.constants import DMD_SCALARS

    rows = timelines.values_in_order(observations(spark, sf_dir), RUN)

    def step(frames):
        for frame in frames:
            series = [np.stack([x, np.append(0.0, np.diff(x))], axis=1) for x in map(np.asarray, frame["x"])]
            yield pd.concat([frame[["run_id"]].reset_index(drop=True), pd.DataFrame(spectra.modes(series), columns=list(DMD_SCALARS))], axis=1)

    return rounded(rows.mapInPandas(step, "run_id long, " + ", ".join(f"{n} double" for n in DMD_SCALARS)), 4)


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumn("strate", F.concat(F.lit("s"), (F.col("label") % 2).cast("string")))


@query("peeling_clusters")
def peeling_clusters(spark, sf_dir):
    from ..operators import clustering

    return clustering.peel_strata(_strata(spark, sf_dir), "strate", DIMS, "vec_id")


@query("isolation_outliers")
def isolation_outliers(spark, sf_dir):
    from ..operators import clustering

    return clustering.outliers_of_strata(_strata(spark, sf_dir), "strate", DIMS, "vec_id")


@query("projection_2d")
def projection_2d(spark, sf_dir):
    """t-SNE, the operator's default."""
    from ..operators import clustering

    return clustering.project_strata(_strata(spark, sf_dir), "strate", DIMS, "vec_id")


@query("projection_pca")
def projection_pca(spark, sf_dir):
    from ..operators import clustering

    return clustering.project_strata(_strata(spark, sf_dir), "strate", DIMS, "vec_id", method="pca")


@query("feature_selection")
def feature_selection(spark, sf_dir):
    """Features in the order they are kept."""
    kept = M.select_features(vectors(spark, sf_dir), DIMS, ("e3",))
    return spark.createDataFrame(list(enumerate(kept)), "place int, feature string")


DESIGN = {"phase": "demo", "gamma": [{"id": "GAM-001", "params": {"beta": [1.0, 3.0]}}, {"id": "GAM-003"}, {"id": "GAM-004"}, {"id": "GAM-005"}, {"id": "GAM-013", "params": {"eta": 0.5}}], "encoding": [{"id": "SYM-001"}, {"id": "ASY-001"}, {"id": "RN-001"}], "n_dof": [6], "max_it": 40, "seed_CI": [1], "seed_run": [2]}


@query("simulate_phase")
def simulate_phase(spark, sf_dir):
    """A small design from end to end: every run with its status, regime and scalar features."""
    from . import workflows

    made = workflows.run_design(spark, DESIGN)
    return made.drop("weights", *[c for c in made.columns if c.startswith("timeline_") or c == "mask_t_indices"])


@query("cluster_names")
def cluster_names(spark, sf_dir):
    """Names of the clusters that the embeddings' labels make, by the rules of the slots."""
    from ..operators import naming

    rows = vectors(spark, sf_dir).select("label", F.col("e0").alias("f2_von_neumann_entropy_delta"), (F.col("e1") * 10).alias("f1_effective_rank_delta"), (1 + F.col("e2")).alias("f7_dmd_spectral_radius"))
    named = naming.name_clusters(rows, "label", ["f2_von_neumann_entropy_delta", "f1_effective_rank_delta", "f7_dmd_spectral_radius"])
    return spark.createDataFrame([(int(k), v["name"]) for k, v in named.items()], "label int, name string")
