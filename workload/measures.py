"""Metrics, statistics over measurements, joins and report tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from perilscope.operators.metrics import (
    ECE_EDGES,
    balanced_accuracy,
    calibration_error,
    expected_max_toxicity,
    roc_auc,
)
from perilscope.operators.statistics import (
    bootstrap_correlation,
    correlation,
    group_moments,
    join_on_dose,
    keep_last,
    linear_fit,
    proxy_vs_oracle_r2,
    sign_verdict,
)
from perilscope.plans import reports
from perilscope.session import checkpoint_folder, cut_lineage
from perilscope.sources.measurements import (
    TEXT_CALIBRATION,
    append_measurements,
    export_csv,
    pending_runs,
    read_measurements,
    read_runs,
    slice_keys,
    slice_name,
)
from workload import sql
from workload.experiments import NOISY_CTE
from workload.registry import query, r6
from workload.sql import pearson, u
from workload.tables import mix_measurements, mix_series, scored_events, scored_lines, table

_EVENTS_CTE = f"""
    scored AS (
      SELECT event_id, user_id, event_type, least(1.0, value / 100)::DOUBLE AS p,
        CASE WHEN {u("'event'", 'event_id')} < least(1.0, value / 100)::DOUBLE THEN 1 ELSE 0 END AS y
      FROM events
    )"""


def _auc_sql(source: str, run: str) -> str:
    return f"""ranked AS (
      SELECT {run} AS run, y, rank() OVER (PARTITION BY {run} ORDER BY p)
        + (count(*) OVER (PARTITION BY {run}, p) - 1) / 2 AS rk FROM {source})
    SELECT run, {sql.r6('''(sum(rk) FILTER (y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2)
        / (sum(y)::DOUBLE * sum(1 - y))''')} AS auc, sum(y)::BIGINT AS n_pos,
      sum(1 - y)::BIGINT AS n_neg FROM ranked GROUP BY 1"""


@query("auc", f"WITH {_EVENTS_CTE}, {_auc_sql('scored', 'event_type')}")
def auc(spark, folder):
    found = roc_auc(scored_events(spark, folder), "p", "y", ["event_type"])
    return found.select(F.col("event_type").alias("run"), r6("auc").alias("auc"), "n_pos", "n_neg")


@query(
    "auc_single_run",
    f"""WITH {NOISY_CTE}, one AS (
      SELECT 'all' AS r, 1 / (1 + exp(-(price - 53) / 20)) AS p, high AS y FROM noisy),
    {_auc_sql('one', 'r')}""",
)
def auc_single_run(spark, folder):
    found = roc_auc(scored_lines(spark, folder), "p_high", "high")
    return found.select(F.lit("all").alias("run"), r6("auc").alias("auc"), "n_pos", "n_neg")


@query(
    "balanced_accuracy",
    f"""WITH {_EVENTS_CTE}, recalls AS (
      SELECT event_type, y, avg(((p >= 0.5)::INT = y)::INT) AS recall FROM scored GROUP BY 1, 2)
    SELECT event_type, {sql.r6('avg(recall)')} AS balanced_accuracy FROM recalls GROUP BY 1""",
)
def balanced(spark, folder):
    found = balanced_accuracy(scored_events(spark, folder), "p", "y", ["event_type"])
    return found.select("event_type", r6("balanced_accuracy").alias("balanced_accuracy"))


_BIN = (
    "CASE "
    + " ".join(
        f"WHEN p >= {ECE_EDGES[i]!r}::DOUBLE AND p < {ECE_EDGES[i + 1]!r}::DOUBLE THEN {i}"
        for i in range(10)
    )
    + " END"
)


def _ece_sql(bin_sql: str) -> str:
    return f"""SELECT event_type, sum(CASE WHEN b IS NULL THEN 0 ELSE abs(mp - my) * n END) / sum(n) AS e
      FROM (SELECT event_type, {bin_sql} AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my
        FROM scored GROUP BY ALL) GROUP BY 1"""


@query(
    "ece",
    f"""WITH {_EVENTS_CTE}, o AS ({_ece_sql(_BIN)}),
    c AS ({_ece_sql(_BIN.replace(' END', ' WHEN p = 1 THEN 9 END'))})
    SELECT event_type, {sql.r6('o.e')} AS ece, {sql.r6('c.e')} AS ece_closed
    FROM o JOIN c USING (event_type)""",
)
def ece(spark, folder):
    rows = scored_events(spark, folder)
    half_open = calibration_error(rows, "p", "y", ["event_type"])
    closed = calibration_error(rows, "p", "y", ["event_type"], closed_last=True)
    return half_open.join(closed.withColumnRenamed("ece", "closed"), "event_type").select(
        "event_type", r6("ece").alias("ece"), r6("closed").alias("ece_closed")
    )


@query(
    "emt",
    f"""WITH {_EVENTS_CTE}, top AS (
      SELECT event_type, user_id, max(p) AS t FROM scored GROUP BY 1, 2)
    SELECT event_type, {sql.r6('avg(t)')} AS expected_max_toxicity,
      {sql.r6('avg((t >= 0.5)::INT)')} AS toxicity_probability, count(*) AS n_prompts
    FROM top GROUP BY 1""",
)
def emt(spark, folder):
    found = expected_max_toxicity(scored_events(spark, folder), "user_id", "p", ["event_type"])
    return found.select(
        "event_type",
        r6("expected_max_toxicity").alias("expected_max_toxicity"),
        r6("toxicity_probability").alias("toxicity_probability"),
        "n_prompts",
    )


# ---- statistics over the measured mixes -----------------------------------

_M = sql.measurements_cte()


@query(
    "text_study",
    f"""WITH {_M} SELECT injected_p, seed, {sql.r6('density')} AS density,
      {sql.r6('harm_rate')} AS harm_rate, {sql.r6('mean_length')} AS mean_length FROM measured""",
)
def text_study(spark, folder):
    found = mix_measurements(spark, folder)
    return found.select(
        "injected_p", "seed", *[r6(c).alias(c) for c in ("density", "harm_rate", "mean_length")]
    )


@query(
    "dose_means",
    f"""WITH {_M} SELECT injected_p, count(*) AS n, {sql.r6('avg(density)')} AS density_mean,
      {sql.r6('stddev_samp(density)')} AS density_sd, {sql.r6('avg(harm_rate)')} AS harm_rate_mean,
      {sql.r6('stddev_samp(harm_rate)')} AS harm_rate_sd FROM measured GROUP BY 1""",
)
def dose_means(spark, folder):
    found = group_moments(
        mix_measurements(spark, folder), ["injected_p"], ["density", "harm_rate"]
    )
    names = ("density_mean", "density_sd", "harm_rate_mean", "harm_rate_sd")
    return found.select("injected_p", "n", *[r6(c).alias(c) for c in names])


@query(
    "pearson",
    f"""WITH {_M} SELECT outcome, {sql.r6(pearson('density', 'value'))} AS r, count(*) AS n
    FROM series GROUP BY 1""",
)
def pearson_r(spark, folder):
    found = correlation(mix_series(spark, folder), "density", "value", ["outcome"])
    return found.select("outcome", r6("r").alias("r"), "n")


_BOOTSTRAP_ROUNDS = 10_000


@query(
    "bootstrap_ci",
    f"""WITH {_M}, {sql.bootstrap_cte(_BOOTSTRAP_ROUNDS)}
    SELECT outcome, {sql.r6('r')} AS r, {sql.r6('lo')} AS ci_low, {sql.r6('hi')} AS ci_high, n,
      coalesce(reps, 0)::BIGINT AS n_replicates FROM obs LEFT JOIN ci USING (outcome)""",
)
def bootstrap_ci(spark, folder):
    found = bootstrap_correlation(
        mix_series(spark, folder), "density", "value", ["injected_p", "seed"], ["outcome"]
    )
    return found.select(
        "outcome", *[r6(c).alias(c) for c in ("r", "ci_low", "ci_high")], "n", "n_replicates"
    )


#: Rounds over a long series; every one of them weighs every order line.
_LONG_ROUNDS = 200
_LINE_SERIES = """series AS (SELECT l_returnflag AS outcome, l_orderkey, l_linenumber, l_partkey, l_suppkey,
      l_quantity::DOUBLE AS density, l_discount::DOUBLE * l_quantity::DOUBLE AS value FROM lineitem)"""


@query(
    "bootstrap_long_series",
    f"""WITH {_LINE_SERIES}, {sql.poisson_cte(_LONG_ROUNDS, *sql.LINE_KEYS)}
    SELECT outcome, {sql.r6('r')} AS r, {sql.r6('lo')} AS ci_low, {sql.r6('hi')} AS ci_high, n,
      reps::BIGINT AS n_replicates FROM obs JOIN ci USING (outcome)""",
)
def bootstrap_long_series(spark, folder):
    """Poisson resamples of all order lines: quantity against the discount's worth."""
    quantity = F.col("l_quantity").cast("double")
    lines = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("outcome"),
        *sql.LINE_KEYS,
        quantity.alias("density"),
        (F.col("l_discount").cast("double") * quantity).alias("value"),
    )
    found = bootstrap_correlation(
        lines, "density", "value", sql.LINE_KEYS, ["outcome"], _LONG_ROUNDS, method="poisson"
    )
    return found.select(
        "outcome", *[r6(c).alias(c) for c in ("r", "ci_low", "ci_high")], "n", "n_replicates"
    )


@query(
    "ci_verdict",
    f"""WITH {_M}, {sql.bootstrap_cte(_BOOTSTRAP_ROUNDS)}
    SELECT outcome, CASE WHEN lo > 0 THEN 'CI excludes 0' ELSE 'crosses 0' END AS positive,
      CASE WHEN hi < 0 THEN 'CI excludes 0' ELSE 'crosses 0' END AS negative
    FROM obs LEFT JOIN ci USING (outcome)""",
)
def ci_verdict(spark, folder):
    found = bootstrap_correlation(
        mix_series(spark, folder),
        "density",
        "value",
        ["injected_p", "seed"],
        ["outcome"],
        replicates=_BOOTSTRAP_ROUNDS,
    )
    positive = sign_verdict(found).withColumnRenamed("verdict", "positive")
    return sign_verdict(positive, "negative").select(
        "outcome", "positive", F.col("verdict").alias("negative")
    )


@query(
    "linear_fit",
    f"""WITH {_M} SELECT outcome,
      {sql.r6('covar_pop(value, density) / nullif(var_pop(density), 0)')} AS slope,
      {sql.r6('avg(value) - avg(density) * covar_pop(value, density) / nullif(var_pop(density), 0)')}
        AS intercept, count(*) AS n FROM series GROUP BY 1""",
)
def fit(spark, folder):
    found = linear_fit(mix_series(spark, folder), "density", "value", ["outcome"])
    return found.select("outcome", r6("slope").alias("slope"), r6("intercept").alias("intercept"), "n")


@query(
    "proxy_vs_oracle_r2",
    f"""WITH {_M}, t AS (SELECT outcome, {pearson('density', 'value')} AS a,
      {pearson('injected_p', 'value')} AS b, count(*) AS n FROM series GROUP BY 1)
    SELECT outcome, {sql.r6('a * a')} AS proxy_r2, {sql.r6('b * b')} AS oracle_r2, n FROM t""",
)
def r2(spark, folder):
    found = proxy_vs_oracle_r2(
        mix_series(spark, folder), "density", "injected_p", "value", ["outcome"]
    )
    return found.select(
        "outcome", r6("proxy_r2").alias("proxy_r2"), r6("oracle_r2").alias("oracle_r2"), "n"
    )


# ---- joins and reports ----------------------------------------------------


@query(
    "calib_join",
    f"""WITH {_M} SELECT c.injected_p, c.seed, {sql.r6('c.density')} AS density,
      {sql.r6('o.harm_rate')} AS harm_rate
    FROM measured c JOIN measured o ON c.injected_p = o.injected_p AND c.seed = o.seed
    WHERE o.seed <> 3""",
)
def calib_join(spark, folder):
    measured = mix_measurements(spark, folder)
    # Outcomes come with text seeds and miss one seed, as files from elsewhere do.
    outcome = measured.filter("seed <> 3").select(
        "injected_p", F.col("seed").cast("string").alias("seed"), "harm_rate"
    )
    joined = join_on_dose(measured.select("injected_p", "seed", "density"), outcome)
    return joined.select(
        "injected_p", "seed", r6("density").alias("density"), r6("harm_rate").alias("harm_rate")
    )


@query(
    "keep_last",
    """SELECT user_id, event_type, event_id, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rk
      FROM events) WHERE rk = 1""",
)
def last_rows(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    kept = keep_last(events, ["user_id", "event_type"], "event_id")
    return kept.select("user_id", "event_type", "event_id", "value")


@query(
    "slice_keys",
    f"""WITH {_M} SELECT printf('mix_p%03d_s%d', round_even(injected_p * 1000, 0)::INT, seed::INT)
        AS slice_name, injected_p, seed::INT AS seed FROM measured""",
)
def names_and_keys(spark, folder):
    measured = mix_measurements(spark, folder)
    named = measured.select(slice_name().alias("slice_name"))
    return slice_keys(named).select("slice_name", "injected_p", "seed")


@query(
    "resume_runs",
    f"""WITH {_M} SELECT injected_p, seed, seed >= 3 AS pending, {sql.r6('density')} AS density
    FROM measured""",
)
def resume_runs(spark, folder):
    """A study cut short after three seeds: the sink holds those, the rest are pending."""
    sink = f"{checkpoint_folder(spark)}/measurements-{uuid4().hex}"
    keys = ["injected_p", "seed"]
    measured = mix_measurements(spark, folder).select(*keys, "density")
    append_measurements(measured.filter("seed < 3"), sink, "text")
    left = pending_runs(measured, sink, "text", keys).withColumn("pending", F.lit(True))
    done = spark.read.parquet(sink).select(*keys, "density").withColumn("pending", F.lit(False))
    return left.unionByName(done).select(*keys, "pending", r6("density").alias("density"))


@query(
    "resume_study",
    f"""WITH {_M} SELECT injected_p, seed::INT AS seed, {sql.r6('density')} AS density,
      {sql.r6('harm_rate')} AS harm_rate, CASE WHEN seed < 3 THEN 1 ELSE 2 END AS attempt,
      1::BIGINT AS n_rows FROM measured""",
)
def resume_study(spark, folder):
    """A study killed after three seeds, one commit of it repeated, then run to its end.

    Every run carries the attempt that measured it: the second one measures
    what the first has not finished, and nothing else.
    """
    sink = (f"{checkpoint_folder(spark)}/study-{uuid4().hex}", "text")
    first = sql.MIX_SEEDS[:3]
    mix_measurements(spark, folder, first, sink, attempt=1)
    repeated = read_runs(spark, *sink).filter(F.col("seed") == first[0])
    append_measurements(cut_lineage(repeated), *sink)
    found = mix_measurements(spark, folder, sql.MIX_SEEDS, sink, attempt=2)
    return found.groupBy("injected_p", "seed").agg(
        r6(F.max("density")).alias("density"),
        r6(F.max("harm_rate")).alias("harm_rate"),
        F.max("attempt").cast("int").alias("attempt"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def _calibration(spark, folder):
    return mix_measurements(spark, folder).select(
        "injected_p", "seed", F.col("density").alias("harm_content_density")
    )


def _outcome_log(spark, folder):
    """Outcomes as an append-only log: every run twice, the later entry counting."""
    measured = mix_measurements(spark, folder)
    entry = F.explode(F.array(F.lit(1), F.lit(2))).alias("ingest_seq")
    return measured.select("injected_p", "seed", "harm_rate", entry).withColumn(
        "generated_toxicity", F.col("harm_rate") * F.col("ingest_seq") / 2
    ).drop("harm_rate")


@query(
    "figure_calibration",
    f"""WITH {_M}, r AS (SELECT {pearson('injected_p', 'density')} AS r FROM measured)
    SELECT injected_p, count(*) AS n, {sql.r6('avg(density)')} AS density_mean,
      {sql.r6('stddev_samp(density)')} AS density_sd, {sql.r6('any_value(r.r)')} AS r
    FROM measured, r GROUP BY 1""",
)
def figure_calibration(spark, folder):
    found = reports.text_calibration_table(_calibration(spark, folder))
    return found.select(
        "injected_p",
        "n",
        r6("harm_content_density_mean").alias("density_mean"),
        r6("harm_content_density_sd").alias("density_sd"),
        r6("r").alias("r"),
    )


@query(
    "figure_predictive",
    f"""WITH {_M}, l AS (SELECT covar_pop(harm_rate, density) / var_pop(density) AS b,
        avg(harm_rate) - avg(density) * covar_pop(harm_rate, density) / var_pop(density) AS a
      FROM measured)
    SELECT injected_p, seed::INT AS seed, {sql.r6('density')} AS density,
      {sql.r6('harm_rate')} AS outcome, {sql.r6('a + b * density')} AS fitted FROM measured, l""",
)
def figure_predictive(spark, folder):
    found = reports.predictive_points(
        _calibration(spark, folder), _outcome_log(spark, folder), "ingest_seq"
    )
    return found.select(
        "injected_p",
        "seed",
        r6("harm_content_density").alias("density"),
        r6("generated_toxicity").alias("outcome"),
        r6("fitted").alias("fitted"),
    )


@query(
    "figure_scale_comparison",
    f"""WITH {_M}, o AS (
      SELECT 'small' AS model, injected_p, seed, mean_length AS v FROM measured
      UNION ALL SELECT 'large', injected_p, seed, harm_rate FROM measured)
    SELECT model, injected_p, count(*) AS n, {sql.r6('avg(v)')} AS outcome_mean,
      {sql.r6('stddev_samp(v)')} AS outcome_sd FROM o GROUP BY 1, 2""",
)
def figure_scale_comparison(spark, folder):
    measured = mix_measurements(spark, folder)
    pairs = F.array(
        F.struct(F.lit("small").alias("model"), F.col("mean_length").alias("outcome")),
        F.struct(F.lit("large").alias("model"), F.col("harm_rate").alias("outcome")),
    )
    outcomes = measured.select("injected_p", "seed", F.lit(1).alias("ingest_seq"), F.inline(pairs))
    found = reports.scale_comparison(outcomes, "ingest_seq", "outcome")
    return found.select(
        "model",
        "injected_p",
        "n",
        r6("outcome_mean").alias("outcome_mean"),
        r6("outcome_sd").alias("outcome_sd"),
    )


@query(
    "predictive_interval",
    f"""WITH {_M.replace('series AS', 'other_series AS')},
    series AS (SELECT '0' AS outcome, injected_p, seed, density, harm_rate AS value FROM measured),
    {sql.bootstrap_cte(_BOOTSTRAP_ROUNDS)}
    SELECT {sql.r6('r')} AS r, {sql.r6('lo')} AS ci_low, {sql.r6('hi')} AS ci_high, n,
      reps::BIGINT AS n_replicates FROM obs JOIN ci USING (outcome)""",
)
def predictive_interval(spark, folder):
    found = reports.predictive_interval(
        _calibration(spark, folder), _outcome_log(spark, folder), "ingest_seq"
    )
    return found.select(*[r6(c).alias(c) for c in ("r", "ci_low", "ci_high")], "n", "n_replicates")


@query(
    "csv_measurements",
    f"""WITH {_M} SELECT injected_p, seed::INT AS seed, {sql.r6('density')} AS density,
      {sql.r6('harm_rate')} AS safety FROM measured""",
)
def csv_measurements(spark, folder):
    """Measurements written as CSV and read back with their schema."""
    path = f"{checkpoint_folder(spark)}/measurements-{uuid4().hex}.csv"
    measured = mix_measurements(spark, folder)
    export_csv(
        measured.select(
            "injected_p",
            "seed",
            F.col("density").alias("harm_content_density"),
            F.col("harm_rate").alias("S"),
        ),
        path,
    )
    found = read_measurements(spark, path, TEXT_CALIBRATION)
    return found.select(
        "injected_p", "seed", r6("harm_content_density").alias("density"), r6("S").alias("safety")
    )
