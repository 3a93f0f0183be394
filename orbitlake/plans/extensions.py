"""Registered queries that go beyond the run table: recurrences, segments, likeness and comparisons of runs.

As in the catalogue, the driver's tables stand in for run tables.  Iterative
algorithms have no SQL; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import classify, comparison, features, planning, relational, segments, similarity, summaries
from ..operators import matrix as M
from ..sources import shared, tables
from ..streaming import recursive
from . import workflows
from .catalogue import MASK, OBS, RECURRENCE, RUN, SCREEN, VALID, VECTORS, observations, query, rounded, screening, table, vectors


def stepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, t, v, d): values of each user's events and their steps, the first step 0."""
    from ..operators.timelines import along

    return observations(spark, sf_dir).withColumn("d", F.coalesce(F.col("v") - F.lag("v").over(along(RUN)), F.lit(0.0)))


@query(
    "rls_coefficients",
    f"WITH RECURSIVE {RECURRENCE} SELECT run_id, steps, round(a11, 4) AS a00, round(a12, 4) AS a01, round(a21, 4) AS a10, round(a22, 4) AS a11 FROM fitted",
)
def rls_coefficients(spark, sf_dir):
    """The map from one (value, step) to the next of every user, as the streaming operator has it after the last event."""
    return rounded(recursive.coefficients(stepped(spark, sf_dir), "run_id", ["v", "d"]), 4)


@query("hmm_segments")
def hmm_segments(spark, sf_dir):
    """Users' events cut where a hidden state of three changes."""
    return rounded(segments.state_segments(observations(spark, sf_dir), RUN, rounds=10))


@query("level_changes")
def level_changes(spark, sf_dir):
    """Users' events cut where their level changes, at any number of places."""
    return rounded(segments.level_changes(observations(spark, sf_dir), RUN))


WIDTH = 8
PROFILE = f"""{OBS}, a AS (SELECT run_id, list(v ORDER BY t) AS x FROM obs WHERE v IS NOT NULL GROUP BY run_id),
    i AS (SELECT run_id, x, unnest(range(0, len(x) - {WIDTH - 1})) AS i FROM a), w AS (SELECT run_id, i, x[i + 1:i + {WIDTH}] AS s FROM i),
    z AS (SELECT run_id, i, s, list_avg(s) AS m, list_aggregate(s, 'stddev_pop') AS d FROM w),
    p AS (SELECT a.run_id, a.i, b.i AS j, sqrt({2 * WIDTH} * greatest(1 - (list_inner_product(a.s, b.s) - {WIDTH} * a.m * b.m) / ({WIDTH} * a.d * b.d), 0)) AS distance FROM z a JOIN z b ON a.run_id = b.run_id AND abs(a.i - b.i) >= {WIDTH}),
    profile AS (SELECT run_id, i, arg_min(j, row(distance, j)) AS j, min(distance) AS distance FROM p GROUP BY run_id, i)"""


@query("matrix_profile", f"WITH {PROFILE} SELECT run_id, i::INT AS i, j::INT AS j, round(distance, 5) AS distance FROM profile")
def matrix_profile(spark, sf_dir):
    return rounded(similarity.matrix_profile(observations(spark, sf_dir), RUN, WIDTH), 5)


@query("motifs", f"WITH {PROFILE} SELECT run_id, round(min(distance), 5) AS distance FROM profile GROUP BY run_id")
def motifs(spark, sf_dir):
    """How alike each user's two most alike stretches of events are."""
    found = similarity.motifs(similarity.matrix_profile(observations(spark, sf_dir), RUN, WIDTH), RUN)
    return rounded(found.select("run_id", "distance"), 5)


@query("nearest_runs")
def nearest_runs(spark, sf_dir):
    """The three users whose events run most like those of each user with an id divisible by 100."""
    return rounded(similarity.nearest_runs(observations(spark, sf_dir), "run_id", F.col("run_id") % 100 == 0).select("query", "run_id", "rank", "distance"))


AXES = ["gamma", "encoding", "n_dof"]


@query(
    "healthy_cousins",
    "WITH r AS (SELECT o_orderkey AS run_id, o_custkey % 40 AS gamma, o_orderpriority AS encoding, year(o_orderdate) AS n_dof, o_orderstatus <> 'P' AS ok, o_totalprice AS v FROM orders), f AS (SELECT * FROM r WHERE NOT ok), h AS (SELECT * FROM r WHERE ok), p AS ("
    + " UNION ALL ".join(f"SELECT f.run_id, '{a}' AS axis, f.v AS own, h.v FROM f LEFT JOIN h ON {' AND '.join(f'f.{b} = h.{b}' if a != b else f'f.{b} <> h.{b}' for b in AXES)}" for a in AXES)
    + ") SELECT run_id, axis, count(v) AS n_cousins, round(avg(v), 4) AS cousin_mean, round(min(v), 4) AS cousin_min, round(max(v), 4) AS cousin_max, round(max(own) - avg(v), 4) AS gap FROM p GROUP BY run_id, axis",
)
def healthy_cousins(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 40).alias("gamma"), F.col("o_orderpriority").alias("encoding"), F.year("o_orderdate").alias("n_dof"), (F.col("o_orderstatus") != "P").alias("ok"), F.col("o_totalprice").alias("v"))
    return rounded(comparison.cousins(rows, "run_id", AXES, F.col("ok"), "v"), 4)


#: Events with even and odd ids are two phases of the same users; a user's label is the whole part of its mean value, modulo 4.
PHASES = "lab AS (SELECT user_id, event_id % 2 AS phase, (floor(avg(value))::BIGINT % 4)::INT AS label FROM events GROUP BY user_id, event_id % 2), x AS (SELECT user_id, label FROM lab WHERE phase = 0), y AS (SELECT user_id, label FROM lab WHERE phase = 1), c AS (SELECT x.label AS a, y.label AS b, count(*) AS n FROM x JOIN y USING (user_id) GROUP BY ALL)"
MATCHES = "l AS (SELECT unnest(range(4))::INT AS k), g AS (SELECT p.k AS a, q.k AS b, coalesce(n, 0) AS n FROM l p CROSS JOIN l q LEFT JOIN c ON c.a = p.k AND c.b = q.k), perm AS (SELECT p.k AS p0, q.k AS p1, r.k AS p2, s.k AS p3 FROM l p, l q, l r, l s WHERE len(list_distinct([p.k, q.k, r.k, s.k])) = 4), scored AS (SELECT [p0, p1, p2, p3] AS way, sum(n) AS total FROM perm JOIN g ON b = [p0, p1, p2, p3][a + 1] GROUP BY ALL), way AS (SELECT arg_max(way, total) AS way FROM scored), m AS (SELECT a, b, n FROM g, way WHERE b = way[a + 1] AND a IN (SELECT a FROM c))"


def phases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 2).alias("phase")).agg((F.floor(F.avg("value")) % 4).cast("int").alias("label")).withColumn("entity", F.col("user_id") % 7)
    return rows.filter("phase = 0").drop("phase"), rows.filter("phase = 1").drop("phase")


@query(
    "phase_agreement",
    f"""WITH {PHASES}, p AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS p FROM c), pa AS (SELECT sum(n * (n - 1) / 2) AS pa, count(*) AS ka FROM (SELECT sum(n) AS n FROM c GROUP BY a)), pb AS (SELECT sum(n * (n - 1) / 2) AS pb, count(*) AS kb FROM (SELECT sum(n) AS n FROM c GROUP BY b))
    SELECT n::BIGINT AS n, ka AS n_first, kb AS n_second, round((p - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS adjusted_rand, n >= 10 AS reliable FROM p, pa, pb""",
)
def phase_agreement(spark, sf_dir):
    return rounded(comparison.concordance(*phases(spark, sf_dir), ["user_id"], "entity", "label")["summary"])


@query("phase_matches", f"WITH {PHASES}, {MATCHES} SELECT a, CASE WHEN n > 0 THEN b END AS b, n::BIGINT AS n FROM m")
def phase_matches(spark, sf_dir):
    return comparison.concordance(*phases(spark, sf_dir), ["user_id"], "entity", "label")["matches"]


@query(
    "entity_drifts",
    f"""WITH {PHASES}, {MATCHES}, e AS (SELECT user_id % 7 AS entity, phase, label, count(*) AS n FROM lab WHERE user_id IN (SELECT user_id FROM x JOIN y USING (user_id)) GROUP BY ALL), d AS (SELECT entity, phase, arg_min(label, row(-n, label)) AS label FROM e GROUP BY entity, phase)
    SELECT p.entity, p.label AS first, q.label AS second, CASE WHEN m.n > 0 THEN m.b END AS expected, (CASE WHEN m.n > 0 THEN m.b END) IS DISTINCT FROM q.label AS drifted FROM d p JOIN d q ON p.entity = q.entity AND p.phase = 0 AND q.phase = 1 LEFT JOIN m ON m.a = p.label""",
)
def entity_drifts(spark, sf_dir):
    return comparison.concordance(*phases(spark, sf_dir), ["user_id"], "entity", "label")["drifts"]


@query(
    "viability_frontiers",
    """WITH l AS (UNPIVOT (SELECT o_orderpriority AS entity, (o_orderstatus = 'F')::INT AS ok, (year(o_orderdate) * 12 + month(o_orderdate))::DOUBLE AS months, floor(o_totalprice / 20000)::DOUBLE AS price FROM orders) ON months, price INTO NAME parameter VALUE x),
    g AS (SELECT entity, parameter, x, count(*) AS n, sum(ok) AS k FROM l GROUP BY ALL), c AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(k) OVER w AS ck FROM g WINDOW w AS (PARTITION BY entity, parameter ORDER BY x)),
    s AS (SELECT a.entity, a.parameter, a.i AS lo, b.i AS hi, ((b.ck - a.ck + a.k) / (b.cn - a.cn + a.n))::DOUBLE AS r FROM c a JOIN c b ON a.entity = b.entity AND a.parameter = b.parameter AND a.i <= b.i),
    o AS (SELECT c.entity, c.parameter, c.i, lo, min(r) AS least, max(r) AS most FROM c JOIN s ON s.entity = c.entity AND s.parameter = c.parameter AND lo <= c.i AND hi >= c.i GROUP BY ALL),
    f AS (SELECT entity, parameter, i, max(least) AS up, min(most) AS down FROM o GROUP BY ALL),
    e AS (SELECT c.*, up, down FROM c JOIN f USING (entity, parameter, i)), d AS (SELECT entity, parameter, sum(n) AS n, count(*) AS n_values, sum(n * (up - k / n) ** 2) <= sum(n * (down - k / n) ** 2) + 1e-12 AS rises FROM e GROUP BY ALL),
    t AS (SELECT e.entity, e.parameter, d.n, n_values, rises, x, CASE WHEN rises THEN up ELSE down END AS fit, first_value(CASE WHEN rises THEN up ELSE down END) OVER (PARTITION BY e.entity, e.parameter ORDER BY e.i) AS head FROM e JOIN d USING (entity, parameter))
    SELECT entity, parameter, n::BIGINT AS n, n_values, CASE WHEN rises THEN 'up' ELSE 'down' END AS direction, round(min(fit), 6) AS least, round(max(fit), 6) AS most, min(CASE WHEN (fit >= 0.5) <> (head >= 0.5) THEN x END) AS threshold FROM t GROUP BY entity, parameter, n, n_values, rises""",
)
def viability_frontiers(spark, sf_dir):
    """Where along time and price the orders of a priority stop being finished."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("entity"), (F.col("o_orderstatus") == "F").alias("ok"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("months"), F.floor(F.col("o_totalprice") / 20000).alias("price"))
    return rounded(comparison.frontiers(rows, "entity", ["months", "price"], F.col("ok")))


# Cases that the tables do not hold by themselves: every status and regime, missing and infinite values.

#: Seven shapes by a user's id: events as they are, hardly varying, exploding after half of the steps, infinite from step 20 on, a wave of 8 steps, steady growth, and one jump.
SHAPES = 7


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    kind, t, v = F.pmod("run_id", F.lit(SHAPES)), F.col("t"), F.col("v")
    half = F.floor(F.count("*").over(Window.partitionBy("run_id")) / 2)
    shape = (
        F.when(kind == 1, 100 + v * 1e-7)
        .when(kind == 2, F.when(t < half, 1 + v * 1e-3).otherwise(F.exp((t - half) * 2.0)))
        .when(kind == 3, F.when(t >= 20, float("inf")).otherwise(v))
        .when(kind == 4, 50 + 40 * F.sin(t * 0.7853981633974483))
        .when(kind == 5, 10 * F.pow(F.lit(1.05), t))
        .when(kind == 6, F.when(t == 17, 900.0).otherwise(100 + v * 1e-3))
        .otherwise(v)
    )
    return rows.select("run_id", "t", shape.alias("v"))


#: The same in SQL; an infinite value is null there, as DuckDB's deviations fail on it, and marks the explosion.
SHAPED = f"""raw AS (SELECT user_id AS run_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS t, count(*) OVER (PARTITION BY user_id) // 2 AS half, value AS v FROM events),
obs AS (SELECT run_id, t, CASE run_id % {SHAPES} WHEN 1 THEN 100 + v * 1e-7 WHEN 2 THEN CASE WHEN t < half THEN 1 + v * 1e-3 ELSE exp((t - half) * 2.0::DOUBLE) END WHEN 3 THEN CASE WHEN t < 20 THEN v END
  WHEN 4 THEN 50 + 40 * sin(t * 0.7853981633974483::DOUBLE) WHEN 5 THEN 10 * pow(1.05::DOUBLE, t) WHEN 6 THEN CASE WHEN t = 17 THEN 900 ELSE 100 + v * 1e-3 END ELSE v END AS v FROM raw)"""


def _cases(sql: str) -> str:
    """The catalogue's SQL over the shaped events, with the branch of explosions."""
    out = sql.replace(OBS, SHAPED).replace("min(CASE WHEN frob > b * 1e9 THEN t END) AS over_,", "min(CASE WHEN frob > b * 1e9 THEN t END) AS over_, min(CASE WHEN frob IS NULL THEN t END) AS bad,")
    out = out.replace("CASE WHEN flat < 1e-4 THEN 'COLLAPSED'", "CASE WHEN bad IS NOT NULL THEN 'EXPLOSION' WHEN flat < 1e-4 THEN 'COLLAPSED'")
    return out.replace("(CASE WHEN NOT flat < 1e-4", "(CASE WHEN bad IS NOT NULL THEN bad WHEN NOT flat < 1e-4")


@query("status_cases", _cases(f"WITH {SCREEN} SELECT * FROM st"))
def status_cases(spark, sf_dir):
    """Statuses of shaped events: all four occur."""
    return classify.statuses(screening(spark, sf_dir, shaped(spark, sf_dir)), RUN)


@query("regime_cases", _cases(f"WITH {VALID} SELECT run_id, run_status, t_effective, round(mean, 5) AS p1_cos_dissim_mean, nzc AS p1_n_zero_crossings, period AS p1_estimated_period, regime AS p1_regime_class FROM reg"))
def regime_cases(spark, sf_dir):
    """Regimes of shaped events: all five occur."""
    made = classify.regimes(screening(spark, sf_dir, shaped(spark, sf_dir)), RUN)
    return rounded(made.select("run_id", "run_status", "t_effective", "p1_cos_dissim_mean", "p1_n_zero_crossings", "p1_estimated_period", "p1_regime_class"), 5)


@query("mask_cases", _cases(f"WITH {MASK} SELECT run_id, sum(mask::INT)::BIGINT AS n, min(t) FILTER (WHERE mask) AS first, max(t) FILTER (WHERE mask) AS last FROM masked GROUP BY run_id"))
def mask_cases(spark, sf_dir):
    """Masks of shaped events; explosions and collapsed runs have none."""
    made = classify.masks(screening(spark, sf_dir, shaped(spark, sf_dir)), RUN)
    return made.groupBy("run_id").agg(F.sum(F.col("mask").cast("long")).alias("n"), F.min(F.when(F.col("mask"), F.col("t"))).alias("first"), F.max(F.when(F.col("mask"), F.col("t"))).alias("last"))


#: Line items of which the third have infinite discounts, the fourth NaN, the fifth none.
SPOILT = "spoilt AS (SELECT l_orderkey, l_linenumber, l_returnflag AS g, CASE l_linenumber WHEN 3 THEN 'inf'::DOUBLE WHEN 4 THEN 'nan'::DOUBLE WHEN 5 THEN NULL ELSE l_discount END AS discount, CASE WHEN l_linenumber = 2 THEN '-inf'::DOUBLE ELSE l_tax END AS tax FROM lineitem), long AS (SELECT g, 'discount' AS feature, discount AS v FROM spoilt UNION ALL SELECT g, 'tax', tax FROM spoilt), f AS (SELECT *, CASE WHEN isfinite(v) THEN v END AS x FROM long)"


def spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, inf, nan = F.col("l_linenumber"), F.lit(float("inf")), F.lit(float("nan"))
    discount = F.when(line == 3, inf).when(line == 4, nan).when(line != 5, F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("g"), discount.alias("discount"), F.when(line == 2, -inf).otherwise(F.col("l_tax")).alias("tax"))


@query(
    "feature_stats_cases",
    f"""WITH {SPOILT} SELECT feature, count(*) FILTER (WHERE NOT isnan(v)) AS n_valid, count(*) FILTER (WHERE v IS NULL OR isnan(v)) AS n_nan, count(*) FILTER (WHERE isinf(v)) AS n_inf, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.75), 4) AS q3 FROM f GROUP BY feature""",
)
def feature_stats_cases(spark, sf_dir):
    return rounded(summaries.column_stats(spoilt(spark, sf_dir), ["discount", "tax"]), 4)


@query(
    "group_summary_cases",
    f"WITH {SPOILT} SELECT g, feature, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(avg((v IS NULL OR isnan(v))::INT), 4) AS nan_rate, round(avg(coalesce(isinf(v), false)::INT), 4) AS inf_rate, count(*) AS n FROM f GROUP BY g, feature",
)
def group_summary_cases(spark, sf_dir):
    return rounded(summaries.group_stats(spoilt(spark, sf_dir), "g", ["discount", "tax"]), 4)


@query(
    "anomaly_cases",
    f"WITH {SPOILT} SELECT l_orderkey, l_linenumber, (discount IS NULL OR isnan(discount))::INT + (tax IS NULL OR isnan(tax))::INT AS n_nan, coalesce(isinf(discount), false)::INT + coalesce(isinf(tax), false)::INT AS n_inf FROM spoilt WHERE l_linenumber BETWEEN 2 AND 5",
)
def anomaly_cases(spark, sf_dir):
    return relational.anomalies(spoilt(spark, sf_dir), ["discount", "tax"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "n_nan", "n_inf")


# Planning, reading and choosing: operators of designs and run tables over the given tables.


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as jobs: brands are gammas, sizes n_dof; every third names its rank in its parameters, every fifth in its metadata."""
    key = F.col("p_partkey")
    params = F.when(key % 3 == 0, F.concat(F.lit('{"rank": '), (key % 2 + 2).cast("string"), F.lit("}"))).otherwise("{}")
    rank = planning.effective_rank(F.when(key % 5 == 0, 2), params)
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("gamma_id"), rank.alias("rank_eff"), F.col("p_size").alias("n_dof"), (key % 300 + 1).alias("batch"), (key % 2 == 0).alias("differentiable"))


JOBS = "jobs AS (SELECT p_partkey, p_brand AS gamma_id, CASE WHEN p_partkey % 5 = 0 THEN 2 WHEN p_partkey % 3 = 0 THEN p_partkey % 2 + 2 ELSE 3 END::INT AS rank_eff, p_size AS n_dof, p_partkey % 300 + 1 AS batch, p_partkey % 2 = 0 AS differentiable FROM part), peaks AS (SELECT *, batch * (greatest(pow(n_dof, rank_eff) * 2 * 3 + 100 * 8, pow(n_dof, rank_eff) * 2 * 3 + 100 * 52 + 8) + 400 + CASE WHEN differentiable THEN pow(n_dof, rank_eff) * 2 * 4 * 0.3 ELSE 0 END)::DOUBLE AS peak FROM jobs), sized AS (SELECT *, greatest(floor(batch / pow(2, greatest(ceil(log2(peak / 1e6)), 0))), 1)::BIGINT AS size FROM peaks)"


@query("rank_params", f"WITH {JOBS} SELECT p_partkey, rank_eff FROM jobs")
def rank_params(spark, sf_dir):
    return jobs(spark, sf_dir).select("p_partkey", "rank_eff")


@query("job_groups", f"WITH {JOBS} SELECT gamma_id, rank_eff, n_dof, count(*) AS n_runs FROM jobs GROUP BY ALL")
def job_groups(spark, sf_dir):
    return planning.groups(jobs(spark, sf_dir))


def _peak() -> Column:
    return planning.peak_bytes(F.col("n_dof"), F.col("rank_eff"), F.col("batch"), F.lit(100), F.col("differentiable"))


@query("peak_bytes", f"WITH {JOBS} SELECT p_partkey, round(peak, 3) AS peak FROM peaks")
def peak_bytes(spark, sf_dir):
    return rounded(jobs(spark, sf_dir).select("p_partkey", _peak().alias("peak")), 3)


@query("split_jobs", f"WITH {JOBS}, c AS (SELECT p_partkey, batch, size, unnest(range(0, batch, size)) AS first FROM sized) SELECT p_partkey, (first // size)::BIGINT AS chunk, first::BIGINT AS first, least(size, batch - first)::BIGINT AS n_chunk FROM c")
def split_jobs(spark, sf_dir):
    return planning.split_jobs(jobs(spark, sf_dir), "batch", _peak(), 1e6).select("p_partkey", "chunk", "first", "n_chunk")


CONFORMED = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_mktsegment", T.StringType()), T.StructField("c_acctbal", T.FloatType()), T.StructField("seed_run", T.LongType()), T.StructField("phase", T.StringType()), T.StructField("timeline", T.ArrayType(T.FloatType()))])


@query("conform_defaults", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment, round((CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal::FLOAT END)::DOUBLE, 2) AS c_acctbal, c_custkey % 5 = 0 AS is_nan, -1::BIGINT AS seed_run, '' AS phase, 0::INT AS n FROM customer")
def conform_defaults(spark, sf_dir):
    """Rows in a schema that asks for columns they lack: empty texts, -1, NaN and empty arrays."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), F.when(key % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    made = tables.conform(rows, CONFORMED, strict=False)
    balance = F.col("c_acctbal").cast("double")
    return made.select("c_custkey", "c_mktsegment", F.round(F.nanvl(balance, F.lit(0.0)), 2).alias("c_acctbal"), F.isnan(balance).alias("is_nan"), "seed_run", "phase", F.size("timeline").alias("n"))


@query("conform_strict", "SELECT c_custkey::INT AS c_custkey, c_name, round(c_acctbal::FLOAT::DOUBLE, 2) AS c_acctbal FROM customer")
def conform_strict(spark, sf_dir):
    schema = T.StructType([T.StructField("c_custkey", T.IntegerType()), T.StructField("c_name", T.StringType()), T.StructField("c_acctbal", T.FloatType())])
    return tables.conform(table(spark, sf_dir, "customer"), schema).select("c_custkey", "c_name", F.round(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"))


@query("written_runs", "SELECT o_orderpriority AS phase, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def written_runs(spark, sf_dir):
    """Orders appended to a run table, a folder for each phase, and read back."""
    path = shared.new_path(spark, "written")
    tables.write_runs(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "phase"), path, rows_per_file=5000)
    return tables.read_runs(spark, path).groupBy("phase").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("values_at_mask", f"WITH {OBS}, a AS (SELECT run_id, list(v ORDER BY t) AS x, list(t ORDER BY t) FILTER (WHERE v > 60) AS places FROM obs GROUP BY run_id) SELECT run_id, len(places)::INT AS n, round(list_sum(list_transform(places, lambda i: x[i + 1])), 6) AS total FROM a WHERE places IS NOT NULL")
def values_at_mask(spark, sf_dir):
    """The values of each user's events at the steps where they are over 60."""
    per = segments.series(observations(spark, sf_dir), RUN)
    made = per.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("x") - 1), lambda i: F.get("x", i) > 60)).withColumn("picked", features.at_mask(F.col("x"), F.col("at")))
    return rounded(made.filter(F.size("at") > 0).select("run_id", F.size("picked").alias("n"), F.aggregate("picked", F.lit(0.0), lambda s, v: s + v).alias("total")))


@query(
    "mask_and_meta",
    f"""WITH {OBS}, p AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, v > 60 AS m FROM obs), s AS (SELECT *, m AND NOT coalesce(lag(m) OVER (PARTITION BY run_id ORDER BY t), false) AS start FROM p)
    SELECT run_id, sum(start::INT)::DOUBLE AS mask_n_transitions, round(min(t) FILTER (WHERE m) / max(n), 6) AS mask_t_first_norm, round(max(v) FILTER (WHERE m), 6) AS mask_max_amplitude, round(sum(m::INT) / max(n), 6) AS mask_coverage_frac, sum(m::INT)::DOUBLE AS meta_n_svd, round((arg_max(v, t) - arg_min(v, t)) / (max(n) + 1e-8), 6) AS meta_turbulence, max(n)::DOUBLE AS meta_t_effective FROM s GROUP BY run_id""",
)
def mask_and_meta(spark, sf_dir):
    """Mask and meta features of users' events, masked where they are over 60."""
    per = segments.series(observations(spark, sf_dir), RUN)
    at = F.filter(F.sequence(F.lit(0), F.size("x") - 1), lambda i: F.get("x", i) > 60)
    runs = per.select("run_id", F.col("x").alias("timeline_frob"), F.col("x").alias("timeline_cos_dissim"), at.alias("mask_t_indices"), F.size("x").alias("max_it"), F.size("x").alias("t_effective"))
    made = features.runtime_null(runs.withColumns(features.mask_features()))
    return rounded(made.select("run_id", "mask_n_transitions", "mask_t_first_norm", "mask_max_amplitude", "mask_coverage_frac", "meta_n_svd", "meta_turbulence", "meta_t_effective"))


@query("noise_split", "SELECT (o_orderkey % 7) - 2 >= 0 AS clustered, count(*) AS n FROM orders GROUP BY 1")
def noise_split(spark, sf_dir):
    parts = relational.split_noise(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7 - 2).alias("label")))
    counted = [p.agg(F.count("*").alias("n")).select(F.lit(c).alias("clustered"), "n") for p, c in zip(parts, (True, False), strict=True)]
    return counted[0].unionByName(counted[1])


@query("seeded_sample", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100")
def seeded_sample(spark, sf_dir):
    """A hundred orders drawn by a seeded hash."""
    return relational.seeded_sample(table(spark, sf_dir, "orders"), ["o_orderkey"], 100).select("o_orderkey", "o_orderstatus")


@query("first_rows", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def first_rows(spark, sf_dir):
    """The ten customers with most money."""
    return relational.first_rows(table(spark, sf_dir, "customer"), [F.desc("c_acctbal"), "c_custkey"], 10).select("c_custkey", "c_acctbal")


@query("strata_order", "WITH r AS (SELECT 2 + o_orderkey % 2 AS rank_eff, o_custkey % 3 = 0 AS d FROM orders) SELECT rank_eff::INT AS rank_eff, d AS differentiable, 'rank' || rank_eff || CASE WHEN d THEN '_diff' ELSE '_nodiff' END AS strate, count(*) AS n, (row_number() OVER (ORDER BY rank_eff, d))::INT AS place FROM r GROUP BY rank_eff, d")
def strata_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("gamma_id"), (F.col("o_orderkey") % 2 + 2).cast("int").alias("rank_eff"), F.lit(None).cast("double").alias("trace"))
    known = spark.range(3).select("id", (F.col("id") == 0).alias("differentiable"))
    return M.strata_in_order(M.strata(rows, known, "trace"))


@query("picture_centroids", f"WITH {VECTORS} SELECT label, round(median(e0), 6) AS x, round(median(e1), 6) AS y, count(*) AS n FROM vecs WHERE label >= 2 GROUP BY label")
def picture_centroids(spark, sf_dir):
    """Where the names of clusters stand in a picture of two components; labels under 2 are noise here."""
    points = vectors(spark, sf_dir).select(F.when(F.col("label") >= 2, F.col("label")).otherwise(-1).alias("label"), F.col("e0").alias("x"), F.col("e1").alias("y"))
    return rounded(workflows.centroids(points))
