"""Sampling, injection, preparation, label integrity and models."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from perilscope.config import IntegritySettings, SafetyConfig
from perilscope.functions.draws import uniform
from perilscope.functions.numeric import numeric_columns
from perilscope.operators import integrity
from perilscope.operators.mixing import binarise_equal, dose_mix, flip_labels
from perilscope.operators.prep import (
    category_counts,
    design_matrix,
    drop_if_present,
    fit_categories,
    fit_numeric,
    null_markers,
)
from perilscope.operators.sampling import assign_folds, stratified_split
from perilscope.plans import reports
from perilscope.plans.studies import label_noise_study
from workload import sql
from workload.registry import query, r6
from workload.sql import u
from workload.tables import labelled_pool, mix_rows, noisy_lines, scored_lines, table

_KEYS = list(sql.LINE_KEYS)
_KEY_SQL = ", ".join(_KEYS)

NOISY_CTE = f"""
    noisy AS (
      SELECT {_KEY_SQL}, l_returnflag AS dataset_id, l_extendedprice / 1000 AS price,
        nullif(l_discount, 0) AS discount,
        CASE WHEN l_extendedprice + ({u("'noise'", *_KEYS)} - 0.5) * 60000 > 53000
          THEN 1 ELSE 0 END AS high
      FROM lineitem
    )"""

_STUDY_DOSES = (0.0, 0.05, 0.1, 0.2, 0.4)
_STUDY_SEEDS = (0, 1, 2, 3, 4)

# ---- mixes ----------------------------------------------------------------


@query(
    "dose_mix",
    f"""WITH {sql.mix_cte()} SELECT injected_p, seed, draw_no, label, doc_id,
      {sql.r6(u("'mix'", 'seed', 'doc_id', 'draw_no'))} AS mix_order FROM mix""",
)
def mix(spark, folder):
    pool = labelled_pool(spark, folder)
    found = dose_mix(pool, "label", ["doc_id"], sql.MIX_DOSES, sql.MIX_SEEDS, mix_rows(spark, folder))
    order = r6("mix_order").alias("mix_order")
    return found.select("injected_p", "seed", "draw_no", "label", "doc_id", order)


@query(
    "dose_mix_short_pool",
    f"""WITH {sql.mix_cte(3000, (0.0, 0.1, 0.4), (0, 1))}
    SELECT injected_p, seed, draw_no, label, doc_id FROM mix""",
)
def dose_mix_short_pool(spark, folder):
    pool = labelled_pool(spark, folder)
    found = dose_mix(pool, "label", ["doc_id"], (0.0, 0.1, 0.4), (0, 1), 3000)
    return found.select("injected_p", "seed", "draw_no", "label", "doc_id")


@query(
    "label_flip",
    f"""WITH {NOISY_CTE},
    doses(injected_p) AS (SELECT unnest([{', '.join(map(str, _STUDY_DOSES))}])::DOUBLE),
    seeds(seed) AS (SELECT unnest([{', '.join(map(str, _STUDY_SEEDS))}])),
    flipped AS (SELECT *,
      CASE WHEN {u("'flip' || seed", *_KEYS)} < injected_p THEN 1 - high ELSE high END AS noisy_label
      FROM noisy CROSS JOIN doses CROSS JOIN seeds)
    SELECT injected_p, seed, high, noisy_label, l_linenumber, count(*) AS n,
      sum(l_orderkey)::BIGINT AS orders, sum(l_partkey)::BIGINT AS parts,
      sum(l_suppkey)::BIGINT AS suppliers
    FROM flipped GROUP BY ALL""",
)
def label_flip(spark, folder):
    """The whole grid of flips; key sums tell which rows were flipped."""
    rows = noisy_lines(spark, folder).select(*_KEYS, "high")
    found = flip_labels(rows, "high", _STUDY_DOSES, _STUDY_SEEDS, _KEYS)
    return found.groupBy("injected_p", "seed", "high", "noisy_label", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_orderkey").alias("orders"),
        F.sum("l_partkey").alias("parts"),
        F.sum("l_suppkey").alias("suppliers"),
    )


@query(
    "stratified_split",
    f"""WITH {NOISY_CTE},
    ranked AS (
      SELECT *, {u("'0'", *_KEYS)} AS draw, row_number() OVER (
        PARTITION BY high ORDER BY {u("'0'", *_KEYS)}, {_KEY_SQL}) AS rk,
        count(*) OVER (PARTITION BY high) AS n FROM noisy)
    SELECT {_KEY_SQL}, high, draw < 0.25 AS by_draw,
      rk <= round_even(n * 0.25, 0)::BIGINT AS exact FROM ranked""",
)
def split(spark, folder):
    rows = noisy_lines(spark, folder).select(*_KEYS, "high")
    by_draw = stratified_split(rows, "high", _KEYS, seed=0)
    exact = stratified_split(
        by_draw.withColumnRenamed("is_test", "by_draw"), "high", _KEYS, seed=0, exact=True
    )
    return exact.select(*_KEYS, "high", "by_draw", F.col("is_test").alias("exact"))


# ---- cleaning and preparation ---------------------------------------------


@query(
    "clean_and_select",
    """SELECT o_orderkey, nullif(CASE WHEN o_orderstatus = 'P' THEN '?' ELSE o_orderstatus END, '?')
        AS o_orderstatus,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS target,
      'o_orderkey,o_custkey,o_totalprice' AS numeric_names FROM orders""",
)
def clean_and_select(spark, folder):
    orders = table(spark, folder, "orders").withColumn(
        "o_orderstatus",
        F.when(F.col("o_orderstatus") == "P", "?").otherwise(F.col("o_orderstatus")),
    )
    clean = drop_if_present(null_markers(orders), ["o_orderdate", "weight"])
    names = ",".join(numeric_columns(clean))
    return clean.select(
        "o_orderkey",
        "o_orderstatus",
        binarise_equal("o_orderpriority", "1-URGENT").alias("target"),
        F.lit(names).alias("numeric_names"),
    )


@query(
    "prep_numeric",
    f"""WITH {NOISY_CTE},
    med AS (SELECT median(discount) AS md FROM noisy),
    filled AS (SELECT coalesce(discount, md) AS discount, price, dataset_id FROM noisy, med),
    m AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(discount) AS mdis,
      stddev_pop(discount) AS sdis FROM filled)
    SELECT dataset_id, {sql.r6('avg((price - mp) / sp)')} AS price_mean,
      {sql.r6('stddev_pop((price - mp) / sp)')} AS price_sd,
      {sql.r6('avg((discount - mdis) / sdis)')} AS discount_mean,
      {sql.r6('stddev_pop((discount - mdis) / sdis)')} AS discount_sd,
      {sql.r6('any_value(md)')} AS discount_median
    FROM filled, m, med GROUP BY 1""",
)
def prep_numeric(spark, folder):
    rows = noisy_lines(spark, folder)
    scaling = fit_numeric(rows, ["price", "discount"])
    price, discount = scaling.scaled("price"), scaling.scaled("discount")
    return rows.groupBy("dataset_id").agg(
        r6(F.avg(price)).alias("price_mean"),
        r6(F.stddev_pop(price)).alias("price_sd"),
        r6(F.avg(discount)).alias("discount_mean"),
        r6(F.stddev_pop(discount)).alias("discount_sd"),
        r6(F.lit(scaling.median["discount"])).alias("discount_median"),
    )


def _parts(spark, folder):
    """Parts with gaps in the brand."""
    part = table(spark, folder, "part")
    gap = uniform("gap", "p_partkey") < 0.1
    return part.withColumn("p_brand", F.when(~gap, F.col("p_brand")))


_PARTS_CTE = f"""
    parts AS (
      SELECT p_partkey, p_size, p_type,
        CASE WHEN NOT {u("'gap'", 'p_partkey')} < 0.1 THEN p_brand END AS p_brand FROM part),
    counts AS (SELECT p_brand AS v, count(*) AS n FROM parts WHERE p_brand IS NOT NULL GROUP BY 1),
    fill AS (SELECT v AS fv FROM counts ORDER BY n DESC, v LIMIT 1),
    kept AS (SELECT v FROM counts ORDER BY n DESC, v DESC
      LIMIT (SELECT CASE WHEN count(*) > 20 THEN 19 ELSE 20 END FROM counts)),
    coded AS (
      SELECT p_partkey, p_size, p_type, coalesce(p_brand, fv) AS brand,
        CASE WHEN coalesce(p_brand, fv) IN (SELECT v FROM kept) THEN coalesce(p_brand, fv)
          ELSE '__other__' END AS bucket
      FROM parts, fill)"""


@query(
    "prep_categorical",
    f"""WITH {_PARTS_CTE}
    SELECT 'p_brand' AS feature, bucket, count(*) AS n FROM coded GROUP BY ALL
    UNION ALL SELECT 'p_type', p_type, count(*) FROM coded GROUP BY ALL""",
)
def prep_categorical(spark, folder):
    parts = _parts(spark, folder)
    encoding = fit_categories(parts, ["p_brand", "p_type"])
    coded = parts.select(*[encoding.bucket(c).alias(c) for c in ("p_brand", "p_type")])
    return category_counts(coded, ["p_brand", "p_type"]).select(
        "feature", F.col("value").alias("bucket"), "n"
    )


_KINDS_CTE = f"""
    kinds AS (
      SELECT CASE WHEN {u("'kind'", *_KEYS)} < 0.5 THEN concat_ws('-', l_returnflag, l_linenumber, (l_quantity::INT % 2))
        ELSE concat_ws('-', l_orderkey, l_partkey) END AS kind FROM lineitem)"""


@query(
    "prep_many_values",
    f"""WITH {_KINDS_CTE},
    counts AS (SELECT kind, count(*) AS n FROM kinds GROUP BY 1),
    kept AS (SELECT kind FROM counts ORDER BY n DESC, kind DESC LIMIT 19)
    SELECT CASE WHEN kind IN (SELECT kind FROM kept) THEN kind ELSE '__other__' END AS bucket,
      sum(n)::BIGINT AS n FROM counts GROUP BY 1""",
)
def prep_many_values(spark, folder):
    """Half the lines have a common kind, the others one that hardly another line has."""
    often = F.concat_ws("-", "l_returnflag", "l_linenumber", F.col("l_quantity").cast("int") % 2)
    kind = F.when(uniform("kind", *_KEYS) < 0.5, often).otherwise(F.concat_ws("-", "l_orderkey", "l_partkey"))
    kinds = table(spark, folder, "lineitem").select(kind.alias("kind"))
    bucket = fit_categories(kinds, ["kind"]).bucket("kind")
    return kinds.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "design_matrix",
    f"""WITH {_PARTS_CTE},
    s AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS sd FROM coded)
    SELECT 'p_brand=' || bucket AS name, count(*)::DOUBLE AS total FROM coded GROUP BY ALL
    UNION ALL SELECT 'p_type=' || p_type, count(*) FROM coded GROUP BY ALL
    UNION ALL SELECT 'p_size', {sql.r6('sum(abs((p_size - m) / sd))')} FROM coded, s""",
)
def matrix(spark, folder):
    parts = _parts(spark, folder)
    rows, names = design_matrix(parts, ["p_size"], ["p_brand", "p_type"], keep=["p_partkey"])
    named = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("name"), F.col("x"))
    cells = rows.select(F.inline(named)).toDF("name", "v")
    return cells.groupBy("name").agg(r6(F.sum(F.abs("v"))).alias("total"))


# ---- label integrity ------------------------------------------------------


@query(
    "fold_assign",
    f"""WITH {NOISY_CTE},
    ranked AS (
      SELECT *, {u("'7'", *_KEYS)} AS draw, row_number() OVER (
        PARTITION BY dataset_id, high ORDER BY {u("'7'", *_KEYS)}, {_KEY_SQL}) AS rk FROM noisy)
    SELECT {_KEY_SQL}, floor(draw * 5)::INT AS by_draw, ((rk - 1) % 5)::INT AS exact FROM ranked""",
)
def fold_assign(spark, folder):
    rows = noisy_lines(spark, folder).select(*_KEYS, "dataset_id", "high")
    by_draw = assign_folds(rows, 5, 7, _KEYS).withColumnRenamed("fold", "by_draw")
    both = assign_folds(by_draw, 5, 7, _KEYS, strata=["dataset_id", "high"], exact=True)
    return both.select(*_KEYS, "by_draw", F.col("fold").alias("exact"))


def _newton_steps(passes: int, train: str = "fold <> m", start: str = "mom") -> str:
    """CTEs that fit a two-feature logistic model per (dataset_id, m) to ``z`` by Newton's method."""
    steps = [
        f"""
    theta0 AS (SELECT DISTINCT dataset_id, m, 0.0::DOUBLE AS t0, 0.0::DOUBLE AS t1,
      0.0::DOUBLE AS t2 FROM {start})"""
    ]
    for j in range(passes):
        steps.append(
            f"""
    sums{j} AS MATERIALIZED (
      SELECT dataset_id, m, any_value(t0) AS t0, any_value(t1) AS t1, any_value(t2) AS t2,
        sum(p - high) AS g0, sum((p - high) * z1) + any_value(t1) AS g1,
        sum((p - high) * z2) + any_value(t2) AS g2,
        sum(w) AS a, sum(w * z1) AS b, sum(w * z2) AS c, sum(w * z1 * z1) + 1 AS d,
        sum(w * z1 * z2) AS e, sum(w * z2 * z2) + 1 AS f
      FROM (SELECT *, p * (1 - p) AS w FROM (
        SELECT z.*, t0, t1, t2, 1 / (1 + exp(-(t0 + t1 * z1 + t2 * z2))) AS p
        FROM z JOIN theta{j} USING (dataset_id, m) WHERE {train}))
      GROUP BY 1, 2),
    theta{j + 1} AS MATERIALIZED (
      SELECT dataset_id, m,
        t0 - ((d * f - e * e) * g0 + (c * e - b * f) * g1 + (b * e - c * d) * g2) / det AS t0,
        t1 - ((c * e - b * f) * g0 + (a * f - c * c) * g1 + (b * c - a * e) * g2) / det AS t1,
        t2 - ((b * e - c * d) * g0 + (b * c - a * e) * g1 + (a * d - b * b) * g2) / det AS t2
      FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det
        FROM sums{j}))"""
        )
    return ",".join(steps)


def newton_sql(passes: int = 9, k: int = 5, source: str = "noisy", keys=_KEYS, keep: str = "") -> str:
    """Out-of-fold logistic fits of ``price`` and ``discount``, prepared within the folds."""
    return f"""
    folded AS (SELECT *, floor({u("'0'", *keys)} * {k})::INT AS fold FROM {source}),
    models AS (SELECT unnest(range({k})) AS m),
    med AS MATERIALIZED (
      SELECT dataset_id, m, median(price) AS mp, median(discount) AS mdis
      FROM folded JOIN models ON fold <> m GROUP BY 1, 2),
    mom AS MATERIALIZED (
      SELECT dataset_id, m, mp, mdis, avg(coalesce(price, mp)) AS a1,
        stddev_pop(coalesce(price, mp)) AS s1, avg(coalesce(discount, mdis)) AS a2,
        stddev_pop(coalesce(discount, mdis)) AS s2
      FROM folded JOIN med USING (dataset_id) WHERE fold <> m GROUP BY 1, 2, 3, 4),
    z AS MATERIALIZED (
      -- A constant feature is left unscaled; one missing from all training rows counts as 0.
      SELECT dataset_id, {keep} m, fold, high,
        coalesce((coalesce(price, mp) - a1) / coalesce(nullif(s1, 0), 1), 0) AS z1,
        CASE WHEN mdis IS NULL THEN coalesce(discount, 0)
          ELSE (coalesce(discount, mdis) - a2) / coalesce(nullif(s2, 0), 1) END AS z2
      FROM folded JOIN mom USING (dataset_id)),
    {_newton_steps(passes)}"""


_PASSES = 9


@query(
    "label_integrity",
    f"""WITH {NOISY_CTE}, {newton_sql(_PASSES)},
    held AS (SELECT dataset_id, high, 1 / (1 + exp(-(t0 + t1 * z1 + t2 * z2))) AS p
      FROM z JOIN theta{_PASSES} USING (dataset_id, m) WHERE fold = m)
    SELECT dataset_id, {sql.r6('avg(1 - CASE WHEN high = 1 THEN p ELSE 1 - p END)')} AS score,
      count(*) AS n_rows FROM held GROUP BY 1""",
)
def label_integrity(spark, folder):
    config = SafetyConfig(
        label_column="high", feature_columns=("price", "discount"), key_columns=sql.LINE_KEYS
    )
    found = integrity.label_integrity(noisy_lines(spark, folder), config)
    return found.select(
        "dataset_id",
        r6("score").alias("score"),
        F.col("details.n_rows").cast("bigint").alias("n_rows"),
    )


_CLASSES = 80
_CONSTANTS = [f"c{i}" for i in range(9)]


@query(
    "label_integrity_mixed",
    f"""WITH {NOISY_CTE}, {newton_sql(_PASSES)},
    held AS (SELECT dataset_id, high, 1 / (1 + exp(-(t0 + t1 * z1 + t2 * z2))) AS p
      FROM z JOIN theta{_PASSES} USING (dataset_id, m) WHERE fold = m),
    bad AS (
      SELECT 'flat' AS dataset_id, 1 AS high, count(*) AS n FROM noisy WHERE dataset_id = 'A'
      UNION ALL
      SELECT 'tiny', high, count(*) FROM noisy WHERE l_orderkey = 1 AND l_linenumber <= 4 GROUP BY high)
    SELECT dataset_id, true AS applicable, CAST(NULL AS VARCHAR) AS reason,
      {sql.r6('avg(1 - CASE WHEN high = 1 THEN p ELSE 1 - p END)')} AS score FROM held GROUP BY 1
    UNION ALL
    SELECT dataset_id, false, CASE WHEN count(*) < 2 THEN 'label has a single class'
        WHEN max(n) < 5 THEN 'too small for 5 folds' END, NULL
    FROM bad WHERE n > 0 GROUP BY 1""",
)
def label_integrity_mixed(spark, folder):
    """Good datasets beside one of a single class and one too small: these are rows with a reason."""
    lines = noisy_lines(spark, folder)
    flat = lines.filter("dataset_id = 'A'").withColumns({"dataset_id": F.lit("flat"), "high": F.lit(1)})
    tiny = lines.filter("l_orderkey = 1 AND l_linenumber <= 4").withColumn("dataset_id", F.lit("tiny"))
    config = SafetyConfig(
        label_column="high", feature_columns=("price", "discount"), key_columns=sql.LINE_KEYS
    )
    found = integrity.label_integrity(lines.unionByName(flat).unionByName(tiny), config)
    return found.select("dataset_id", "applicable", "reason", r6("score").alias("score"))


@query("label_integrity_wide", None)
def label_integrity_wide(spark, folder):
    """550 parameters a model over features that vary: the curvature comes in several blocks."""
    lines = table(spark, folder, "lineitem")
    features = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = lines.select(
        *_KEYS,
        F.col("l_returnflag").alias("dataset_id"),
        (F.floor(F.col("l_extendedprice") / 700) % 110).alias("label"),
        *[F.col(c).cast("double").alias(c) for c in features],
    )
    config = SafetyConfig(label_column="label", feature_columns=features, key_columns=sql.LINE_KEYS)
    found = integrity.label_integrity(rows, config)
    return found.select(
        "dataset_id",
        F.round("score", 4).alias("score"),
        F.col("details.n_rows").cast("bigint").alias("n_rows"),
        F.col("details.n_unfinished").cast("bigint").alias("n_unfinished"),
    )


@query(
    "label_integrity_many_classes",
    f"""WITH rows AS (SELECT l_returnflag AS dataset_id, l_suppkey % {_CLASSES} AS label,
        floor({u("'0'", *_KEYS)} * 5)::INT AS fold FROM lineitem),
    cells AS (SELECT dataset_id, fold, label, count(*) AS n FROM rows GROUP BY ALL),
    labels AS (SELECT dataset_id, label, sum(n) AS n FROM cells GROUP BY ALL),
    folds AS (SELECT dataset_id, fold, sum(n) AS n FROM cells GROUP BY ALL),
    sets AS (SELECT dataset_id, sum(n) AS n FROM cells GROUP BY ALL)
    SELECT dataset_id, round((sum(c.n * (1 - (l.n - c.n)::DOUBLE / (s.n - f.n))) / any_value(s.n))
        ::DOUBLE, 4) AS score, any_value(s.n)::BIGINT AS n_rows, 0::BIGINT AS n_unfinished
    FROM cells c JOIN labels l USING (dataset_id, label) JOIN folds f USING (dataset_id, fold)
      JOIN sets s USING (dataset_id) GROUP BY dataset_id""",
)
def label_integrity_many_classes(spark, folder):
    """800 parameters a model. The features do not vary, so a class's share is its probability."""
    lines = table(spark, folder, "lineitem")
    rows = lines.select(
        *_KEYS,
        F.col("l_returnflag").alias("dataset_id"),
        (F.col("l_suppkey") % _CLASSES).alias("label"),
        *[F.lit(float(i)).alias(c) for i, c in enumerate(_CONSTANTS)],
    )
    config = SafetyConfig(
        label_column="label", feature_columns=tuple(_CONSTANTS), key_columns=sql.LINE_KEYS
    )
    found = integrity.label_integrity(rows, config)
    return found.select(
        "dataset_id",
        F.round("score", 4).alias("score"),
        F.col("details.n_rows").cast("bigint").alias("n_rows"),
        F.col("details.n_unfinished").cast("bigint").alias("n_unfinished"),
    )


@query(
    "label_integrity_own_model",
    f"""WITH {NOISY_CTE}, one AS (SELECT * REPLACE ('lines' AS dataset_id) FROM noisy),
    {newton_sql(_PASSES, source='one')},
    held AS (SELECT dataset_id, high, 1 / (1 + exp(-(t0 + t1 * z1 + t2 * z2))) AS p
      FROM z JOIN theta{_PASSES} USING (dataset_id, m) WHERE fold = m)
    SELECT dataset_id, round(avg(1 - CASE WHEN high = 1 THEN p ELSE 1 - p END)::DOUBLE, 3) AS score,
      count(*) AS n_rows FROM held GROUP BY 1""",
)
def label_integrity_own_model(spark, folder):
    """The proxy with a classifier of the user's own: here the same model, fitted by Spark ML."""
    rows = noisy_lines(spark, folder).withColumn("dataset_id", F.lit("lines"))
    own = LogisticRegression(
        regParam=1.25 / rows.count(), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-10
    )
    config = SafetyConfig(
        label_column="high",
        feature_columns=("price", "discount"),
        key_columns=sql.LINE_KEYS,
        integrity=IntegritySettings(estimator=own),
    )
    found = integrity.label_integrity(rows, config)
    return found.select(
        "dataset_id",
        F.round("score", 3).alias("score"),
        F.col("details.n_rows").cast("bigint").alias("n_rows"),
    )


@query(
    "fold_impute_scale",
    f"""WITH {NOISY_CTE}, {newton_sql(1)}
    SELECT dataset_id, m AS model, {sql.r6('mdis')} AS fill, {sql.r6('a1')} AS price_mean,
      {sql.r6('s1')} AS price_sd, {sql.r6('a2')} AS discount_mean, {sql.r6('s2')} AS discount_sd
    FROM mom""",
)
def fold_impute_scale(spark, folder):
    matrix = integrity.build_matrix(
        noisy_lines(spark, folder),
        "high",
        ["price", "discount"],
        "dataset_id",
        IntegritySettings(),
        sql.LINE_KEYS,
    )
    found = integrity.fold_scaling(matrix, 5, ["price", "discount"])
    by_feature = found.groupBy("dataset_id", "model").pivot("feature", ["price", "discount"])
    wide = by_feature.agg(
        F.first("fill").alias("fill"), F.first("mean").alias("mean"), F.first("sd").alias("sd")
    )
    return wide.select(
        "dataset_id",
        "model",
        r6("discount_fill").alias("fill"),
        *[r6(f"{f}_{s}").alias(f"{f}_{s}") for f in ("price", "discount") for s in ("mean", "sd")],
    )


@query(
    "label_integrity_given_proba",
    f"""WITH {NOISY_CTE},
    p AS (SELECT dataset_id, high, 1 / (1 + exp(-(price - 53) / 20)) AS p FROM noisy)
    SELECT dataset_id, {sql.r6('avg(1 - CASE WHEN high = 1 THEN p ELSE 1 - p END)')} AS score,
      count(*) AS n_rows FROM p GROUP BY 1""",
)
def label_integrity_given_proba(spark, folder):
    rows = scored_lines(spark, folder)
    both = rows.withColumn("probability", F.array(1 - F.col("p_high"), F.col("p_high")))
    found = integrity.integrity_from_probabilities(both, "high", "probability")
    return found.select("dataset_id", r6("score").alias("score"), "n_rows")


@query(
    "suspicious_rows",
    f"""WITH {NOISY_CTE}, {newton_sql(_PASSES, keep=_KEY_SQL + ',')},
    held AS (SELECT dataset_id, {_KEY_SQL}, high, 1 / (1 + exp(-(t0 + t1 * z1 + t2 * z2))) AS p
      FROM z JOIN theta{_PASSES} USING (dataset_id, m) WHERE fold = m)
    SELECT dataset_id, {_KEY_SQL},
      {sql.r6('1 - CASE WHEN high = 1 THEN p ELSE 1 - p END')} AS suspicion
    FROM held ORDER BY 1 - CASE WHEN high = 1 THEN p ELSE 1 - p END DESC, {_KEY_SQL} LIMIT 100""",
)
def suspicious_rows(spark, folder):
    config = SafetyConfig(
        label_column="high", feature_columns=("price", "discount"), key_columns=sql.LINE_KEYS
    )
    rows = integrity.row_suspicion(noisy_lines(spark, folder), config)
    top = rows.orderBy(F.desc("suspicion"), *_KEYS).limit(100)
    return top.select("dataset_id", *_KEYS, r6("suspicion").alias("suspicion"))


# ---- the tabular study ----------------------------------------------------


def _text_shape(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    text = F.col("text")
    return (
        table(spark, folder, "labels")
        .select("doc_id", "quality")
        .join(docs, "doc_id")
        .select(
            "doc_id",
            "quality",
            "lang",
            F.length(text).alias("n_chars"),
            F.size(F.split(text, r"\s+")).alias("n_words"),
            F.length(F.regexp_replace(text, r"[^0-9]", "")).alias("n_digits"),
            F.length(F.regexp_replace(text, r"[^.!?]", "")).alias("n_stops"),
        )
    )


@query("downstream_models")
def downstream_models(spark, folder):
    rows = _text_shape(spark, folder)
    numeric = ["n_chars", "n_words", "n_digits", "n_stops"]
    prepared, names = design_matrix(rows, numeric, ["lang"], keep=["doc_id", "quality"])
    found = label_noise_study(
        prepared, len(names), "quality", ["doc_id"], doses=(0.0, 0.4), seeds=(0,)
    )
    return found.select(
        "injected_p", "seed", "model", *[F.round(c, 3).alias(c) for c in ("proxy_noise", "auc", "bal_acc", "ece")]
    )


_STUDY_CTE = f"""{NOISY_CTE},
    med AS (SELECT median(discount) AS md FROM noisy),
    filled AS (SELECT {_KEY_SQL}, price, coalesce(discount, md) AS discount, high FROM noisy, med),
    scale AS (SELECT avg(price) AS a1, stddev_pop(price) AS s1, avg(discount) AS a2,
      stddev_pop(discount) AS s2 FROM filled),
    doses AS (SELECT unnest([{', '.join(map(str, _STUDY_DOSES))}])::DOUBLE AS injected_p),
    seeds AS (SELECT unnest([{', '.join(map(str, _STUDY_SEEDS))}]) AS seed),
    drawn AS MATERIALIZED (
      SELECT seed, (price - a1) / s1 AS z1, (discount - a2) / s2 AS z2, high AS y0,
        {u("'split' || seed", *_KEYS)} < 0.25 AS is_test,
        {u("'flip' || seed", *_KEYS)} AS draw, floor({u("'0'", 'seed', *_KEYS)} * 5)::INT AS f
      FROM filled CROSS JOIN seeds, scale),
    runs AS MATERIALIZED (
      SELECT injected_p::VARCHAR || '|' || seed AS dataset_id, injected_p, seed, z1, z2,
        CASE WHEN draw < injected_p AND NOT is_test THEN 1 - y0 ELSE y0 END AS high,
        CASE WHEN is_test THEN 5 ELSE f END AS fold
      FROM drawn CROSS JOIN doses),
    -- Models 0 to 4 hold out a fold of the training rows, model 5 the test rows.
    models AS (SELECT unnest(range(6)) AS m),
    z AS (SELECT * FROM runs CROSS JOIN models WHERE m = 5 OR fold <> 5),
    ids AS (SELECT DISTINCT dataset_id, m FROM (SELECT DISTINCT dataset_id FROM runs), models),
    {_newton_steps(_PASSES, 'fold <> m AND fold <> 5', 'ids')},
    held AS MATERIALIZED (
      SELECT injected_p, seed, m, high AS y, 1 / (1 + exp(-(t0 + t1 * z1 + t2 * z2))) AS p
      FROM z JOIN theta{_PASSES} USING (dataset_id, m) WHERE fold = m),
    proxies AS (SELECT injected_p, seed, avg(1 - CASE WHEN y = 1 THEN p ELSE 1 - p END) AS proxy
      FROM held WHERE m < 5 GROUP BY 1, 2),
    tests AS (SELECT * FROM held WHERE m = 5),
    ranked AS (SELECT *, rank() OVER (PARTITION BY injected_p, seed ORDER BY p)
      + (count(*) OVER (PARTITION BY injected_p, seed, p) - 1) / 2 AS rk FROM tests),
    aucs AS (SELECT injected_p, seed, (sum(rk) FILTER (y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2)
      / (sum(y)::DOUBLE * sum(1 - y)) AS auc FROM ranked GROUP BY 1, 2),
    recalls AS (SELECT injected_p, seed, y, avg(((p >= 0.5)::INT = y)::INT) AS recall
      FROM tests GROUP BY 1, 2, 3),
    accuracies AS (SELECT injected_p, seed, avg(recall) AS bal_acc FROM recalls GROUP BY 1, 2),
    eces AS (SELECT injected_p, seed, sum(abs(mp - my) * n) / sum(n) AS ece FROM (
      SELECT injected_p, seed, floor(p * 10) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my
      FROM tests GROUP BY 1, 2, 3) GROUP BY 1, 2),
    study AS MATERIALIZED (
      SELECT injected_p, seed, 'logreg' AS model, proxy AS proxy_noise, auc, bal_acc, ece
      FROM proxies JOIN aucs USING (injected_p, seed) JOIN accuracies USING (injected_p, seed)
        JOIN eces USING (injected_p, seed))"""


def _noise_study(spark, folder):
    """The full dose and seed grid with the logistic model, on all line items."""
    rows = noisy_lines(spark, folder)
    prepared, names = design_matrix(rows, ["price", "discount"], [], keep=[*_KEYS, "high"])
    return label_noise_study(
        prepared,
        len(names),
        "high",
        _KEYS,
        doses=_STUDY_DOSES,
        seeds=_STUDY_SEEDS,
        models=("logreg",),
    )


@query(
    "label_noise_study",
    f"""WITH {_STUDY_CTE} SELECT injected_p, seed, model, {sql.r6('proxy_noise')} AS proxy_noise,
      {sql.r6('auc')} AS auc, {sql.r6('bal_acc')} AS bal_acc, {sql.r6('ece')} AS ece FROM study""",
)
def noise_study(spark, folder):
    found = _noise_study(spark, folder)
    measures = ("proxy_noise", "auc", "bal_acc", "ece")
    return found.select("injected_p", "seed", "model", *[r6(c).alias(c) for c in measures])


@query(
    "figure_tabular",
    f"""WITH {_STUDY_CTE} SELECT injected_p, count(*) AS n,
      {sql.r6('avg(proxy_noise)')} AS proxy_mean, {sql.r6('stddev_samp(proxy_noise)')} AS proxy_sd,
      {sql.r6('avg(auc)')} AS auc_mean, {sql.r6('stddev_samp(auc)')} AS auc_sd,
      {sql.r6('avg(ece)')} AS ece_mean, {sql.r6('stddev_samp(ece)')} AS ece_sd
    FROM study GROUP BY 1""",
)
def figure_tabular(spark, folder):
    found = reports.tabular_dose_table(_noise_study(spark, folder))
    pairs = (("proxy_noise", "proxy"), ("auc", "auc"), ("ece", "ece"))
    return found.select(
        "injected_p",
        "n",
        *[r6(f"{a}_{s}").alias(f"{b}_{s}") for a, b in pairs for s in ("mean", "sd")],
    )


@query(
    "tabular_analysis",
    f"""WITH {_STUDY_CTE}, series AS (
      SELECT 'dose_proxy' AS outcome, injected_p, seed, model, injected_p AS density,
        proxy_noise AS value FROM study
      UNION ALL SELECT 'proxy_auc', injected_p, seed, model, proxy_noise, auc FROM study
      UNION ALL SELECT 'proxy_ece', injected_p, seed, model, proxy_noise, ece FROM study),
    {sql.bootstrap_cte(10000, ('injected_p', 'seed', 'model'))}
    SELECT outcome AS pair, {sql.r6('r')} AS r, {sql.r6('lo')} AS ci_low, {sql.r6('hi')} AS ci_high,
      n, CASE WHEN outcome = 'proxy_auc' THEN hi < 0 ELSE lo > 0 END AS as_expected
    FROM obs LEFT JOIN ci USING (outcome)""",
)
def tabular_analysis(spark, folder):
    found = reports.tabular_analysis(_noise_study(spark, folder))
    return found.select(
        "pair",
        *[r6(c).alias(c) for c in ("r", "ci_low", "ci_high")],
        "n",
        (F.col("verdict") == "CI excludes 0").alias("as_expected"),
    )
