"""Proxies, composite and whole assessments."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilscope.config import PatternRule
from perilscope.functions.draws import uniform
from perilscope.operators import text_harm
from perilscope.operators.composite import compute_safety_composite, passes_threshold, to_json
from perilscope.operators.coverage import safety_critical_edge_case_coverage
from perilscope.operators.metadata import (
    adversarial_provenance_risk,
    factual_decay_rate,
    poisoning_susceptibility,
)
from perilscope.operators.models import TEXT_SCORE, fit_text_scorer, score_texts
from perilscope.operators.sampling import fixed_size_sample
from perilscope.functions.text import eligible
from perilscope.plans.assess import assess_safety
from perilscope.schemas import PROXY_COLUMNS, explode_proxies, proxy_struct
from workload import sql
from workload.experiments import newton_sql
from workload.registry import query, r6
from workload.sql import clamp, u
from workload.tables import (
    doc_set_metadata,
    doc_sets,
    labelled_pool,
    metadata_for,
    table,
    text_config,
)

# ---- the flagship ---------------------------------------------------------

_SCORE_COLUMNS = (
    "poisoning_susceptibility",
    "adversarial_provenance_risk",
    "factual_decay_rate",
    "harm_content_density",
    "physical_harm_enablement_density",
    "safety_critical_edge_case_coverage",
)


@query(
    "assess_corpus",
    f"""WITH {sql.metadata_cte(sql.SOURCES)}, {sql.flags_cte('source')},
    probes AS (SELECT unnest({list(sql.LANGUAGES)}) AS probe),
    covered AS (
      SELECT i.dataset_id, avg(CASE WHEN s.probe IS NULL THEN 0 ELSE 1 END) AS coverage
      FROM ids i CROSS JOIN probes p
      LEFT JOIN (SELECT DISTINCT source AS dataset_id, lang AS probe FROM documents) s
        ON s.dataset_id = i.dataset_id AND s.probe = p.probe
      GROUP BY 1),
    s AS (
      SELECT m.dataset_id,
        ({clamp('poison_raw')})::DOUBLE AS p1, ({clamp('origin_raw')})::DOUBLE AS p2,
        ({sql.DECAY})::DOUBLE AS p3, greatest(toxic, pii)::DOUBLE AS p4, dual::DOUBLE AS p6,
        CASE WHEN physical_process_coupled THEN 1 - coverage END::DOUBLE AS p7
      FROM meta_scores m JOIN text_scores USING (dataset_id) JOIN covered USING (dataset_id)),
    c AS (
      SELECT *, list_avg([p1, p2, p3, p4, p6, p7]) AS safety,
        list_count([p1, p2, p3, p4, p6, p7]) AS n FROM s)
    SELECT dataset_id, {sql.r6('safety')} AS safety, (safety IS NULL OR safety <= 0.3) AS passes,
      n::BIGINT AS n_applicable,
      concat_ws(',', CASE WHEN p3 IS NULL THEN 'factual_decay_rate' END, 'label_integrity',
        CASE WHEN p7 IS NULL THEN 'safety_critical_edge_case_coverage' END) AS excluded,
      {sql.r6('p1')} AS poisoning_susceptibility, {sql.r6('p2')} AS adversarial_provenance_risk,
      {sql.r6('p3')} AS factual_decay_rate, {sql.r6('p4')} AS harm_content_density,
      {sql.r6('p6')} AS physical_harm_enablement_density,
      {sql.r6('p7')} AS safety_critical_edge_case_coverage
    FROM c""",
)
def assess_corpus(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    sources = docs.select(F.col("source").alias("dataset_id")).distinct()
    required = sources.select(
        "dataset_id",
        F.explode(F.array(*[F.lit(x) for x in sql.LANGUAGES])).alias("probe"),
    )
    present = docs.select(F.col("source").alias("dataset_id"), F.col("lang").alias("probe"))
    result = assess_safety(
        docs,
        metadata_for(sources),
        text_config(dataset_column="source"),
        required_probes=required,
        present_probes=present,
        s_max=0.3,
    ).safety
    scores = F.map_from_arrays(
        F.transform("breakdown", lambda b: b["proxy"]),
        F.transform("breakdown", lambda b: b["score"]),
    )
    return result.select(
        "dataset_id",
        r6("safety").alias("safety"),
        "passes",
        "n_applicable",
        F.concat_ws(",", "excluded_for_na").alias("excluded"),
        *[r6(scores[c]).alias(c) for c in _SCORE_COLUMNS],
    )


# ---- metadata proxies -----------------------------------------------------


@query(
    "meta_poisoning",
    f"""WITH {sql.metadata_cte(sql.DOC_SETS)}
    SELECT dataset_id, {sql.r6(clamp('poison_raw'))} AS score, {sql.r6('poison_raw')} AS raw
    FROM meta_scores""",
)
def meta_poisoning(spark, folder):
    found = poisoning_susceptibility(doc_set_metadata(spark, folder))
    return found.select("dataset_id", r6("score").alias("score"), r6("raw_value.risk").alias("raw"))


@query(
    "meta_adversarial",
    f"""WITH {sql.metadata_cte(sql.DOC_SETS)}
    SELECT dataset_id, {sql.r6(clamp('origin_raw'))} AS score, {sql.r6('origin_raw')} AS raw
    FROM meta_scores""",
)
def meta_adversarial(spark, folder):
    found = adversarial_provenance_risk(doc_set_metadata(spark, folder))
    return found.select("dataset_id", r6("score").alias("score"), r6("raw_value.risk").alias("raw"))


@query(
    "meta_decay",
    f"""WITH {sql.metadata_cte(sql.DOC_SETS)}
    SELECT dataset_id, {sql.r6(sql.DECAY)} AS score, {sql.r6('age_days')} AS age_days,
      stamp IS NOT NULL AS applicable,
      CASE WHEN stamp IS NULL THEN 'no date in metadata'
           WHEN age_days IS NULL THEN 'unparseable: ' || stamp END AS reason
    FROM meta_scores""",
)
def meta_decay(spark, folder):
    found = factual_decay_rate(doc_set_metadata(spark, folder), as_of=sql.AS_OF)
    return found.select(
        "dataset_id",
        r6("score").alias("score"),
        r6("raw_value.age_days").alias("age_days"),
        "applicable",
        "reason",
    )


# ---- text proxies ---------------------------------------------------------


@query(
    "text_sample",
    f"""SELECT source, doc_id FROM (
      SELECT source, doc_id, row_number() OVER (
        PARTITION BY source ORDER BY {u("'42'", 'doc_id')}, doc_id) AS rk
      FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S'))
    WHERE rk <= 20""",
)
def text_sample(spark, folder):
    docs = table(spark, folder, "documents").filter(eligible(F.col("text")))
    picked = fixed_size_sample(
        docs.select("source", "doc_id"), 20, ["doc_id"], groups=["source"], seed=42
    )
    return picked.select("source", "doc_id")


@query(
    "harm_lexicon",
    f"""WITH {sql.flags_cte('source')}
    SELECT dataset_id, {sql.r6('greatest(toxic, pii)')} AS score, {sql.r6('toxic')} AS toxic_fraction,
      n_scored::BIGINT AS n_scored FROM text_scores""",
)
def harm_lexicon(spark, folder):
    docs = table(spark, folder, "documents")
    found = text_harm.harm_content_density(docs, text_config(dataset_column="source"))
    return found.select(
        "dataset_id",
        r6("score").alias("score"),
        r6("raw_value.toxic_fraction").alias("toxic_fraction"),
        F.col("details.n_sampled").cast("bigint").alias("n_scored"),
    )


_CUSTOM_PII = {
    "email": sql.EMAIL,
    "phone_like": r"\b\d{3}[- ]\d{4}\b",
    "long_number": r"\b\d{9,}\b",
}


@query(
    "harm_pii",
    f"""WITH f AS (SELECT source || '|' || lang AS dataset_id,
        regexp_matches(text, '{_CUSTOM_PII["email"]}') AS a,
        regexp_matches(text, '{_CUSTOM_PII["phone_like"]}') AS b,
        regexp_matches(text, '{_CUSTOM_PII["long_number"]}') AS c,
        regexp_matches(text, '{sql.SSN}') AS d FROM documents)
    SELECT dataset_id, {sql.r6('avg((a OR b OR c)::INT)')} AS custom_pii,
      {sql.r6('avg(a::INT)')} AS email, {sql.r6('avg(b::INT)')} AS phone_like,
      {sql.r6('avg(c::INT)')} AS long_number, {sql.r6('avg((a OR d)::INT)')} AS default_pii
    FROM f GROUP BY 1""",
)
def harm_pii(spark, folder):
    docs = doc_sets(spark, folder)
    rules = [
        PatternRule(name, pattern, must_contain="@" if name == "email" else None)
        for name, pattern in _CUSTOM_PII.items()
    ]
    custom = text_harm.harm_content_density(docs, text_config(pii_rules=rules)).select(
        "dataset_id",
        r6("raw_value.pii_fraction").alias("custom_pii"),
        *[r6(F.col("raw_value")[f"pii_{n}_fraction"]).alias(n) for n in _CUSTOM_PII],
    )
    default = text_harm.harm_content_density(docs, text_config()).select(
        "dataset_id", r6("raw_value.pii_fraction").alias("default_pii")
    )
    return custom.join(default, "dataset_id")


_HEADS = ("toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack")


@query(
    "harm_heads",
    f"""WITH h AS (SELECT source AS dataset_id,
        greatest({', '.join(f"round({u(repr(h), 'doc_id')}, 1)" for h in _HEADS)}) >= 0.9 AS t,
        greatest({', '.join(f"round({u(repr(h), 'doc_id')}, 1)" for h in _HEADS[:1])}) >= 0.7 AS t1
        FROM documents)
    SELECT dataset_id, {sql.r6('avg(t::INT)')} AS six_heads, {sql.r6('avg(t1::INT)')} AS one_head
    FROM h GROUP BY 1""",
)
def harm_heads(spark, folder):
    docs = table(spark, folder, "documents")
    scored = docs.select(
        "source", "text", *[F.round(uniform(h, "doc_id"), 1).alias(h) for h in _HEADS]
    )

    def toxic(**changes):
        config = text_config(dataset_column="source", classifier="heads", **changes)
        return text_harm.harm_content_density(scored, config).select(
            "dataset_id", r6("raw_value.toxic_fraction").alias("f")
        )

    six = toxic(toxicity_threshold=0.9).withColumnRenamed("f", "six_heads")
    one = toxic(toxicity_threshold=0.7, head_columns=("toxicity",)).withColumnRenamed(
        "f", "one_head"
    )
    return six.join(one, "dataset_id")


@query("harm_trained")
def harm_trained(spark, folder):
    docs = table(spark, folder, "documents")
    labelled = labelled_pool(spark, folder).join(docs.select("doc_id", "text"), "doc_id")
    model = fit_text_scorer(labelled, "text", "label")
    scored = score_texts(model, docs.select("doc_id", "source", "text"), "text")
    config = text_config(
        dataset_column="source",
        classifier="heads",
        head_columns=(TEXT_SCORE,),
        toxicity_threshold=0.5,
    )
    found = text_harm.harm_content_density(scored, config)
    return found.select(
        "dataset_id",
        F.round("score", 3).alias("score"),
        F.round("raw_value.toxic_fraction", 3).alias("toxic_fraction"),
    )


@query(
    "physical_harm",
    f"""WITH {sql.flags_cte("source || '|' || lang")}
    SELECT dataset_id, {sql.r6('dual')} AS score FROM text_scores""",
)
def physical_harm(spark, folder):
    found = text_harm.physical_harm_enablement_density(doc_sets(spark, folder), text_config())
    return found.select("dataset_id", r6("score").alias("score"))


#: Syllables; every three of them make a word and a term, 10,648 of each.
_SYLLABLES = "al an ar as at ed en er ha in is it le nd on or ou re sh st th ti".split()


def _of_three(shape: str) -> tuple[str, ...]:
    return tuple(shape.format(*abc) for abc in itertools.product(_SYLLABLES, repeat=3))


@query(
    "harm_long_lists",
    rf"""WITH syllables AS (SELECT unnest({_SYLLABLES}) AS s),
    threes AS (SELECT a.s AS a, b.s AS b, c.s AS c FROM syllables a, syllables b, syllables c),
    texts AS (SELECT source || '|' || lang AS dataset_id, doc_id, lower(text) AS low
      FROM documents WHERE regexp_matches(text, '\S')),
    words AS (SELECT doc_id,
      unnest(regexp_extract_all(low, '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+')) AS w FROM texts),
    toxic AS (SELECT DISTINCT doc_id FROM words WHERE w IN (SELECT a || b || c FROM threes)),
    pieces AS (SELECT doc_id, string_split(low, ', ') AS p FROM texts),
    cuts AS (SELECT doc_id, unnest(list_transform(range(1, len(p)),
      lambda i: right(p[i], 4) || ', ' || left(p[i + 1], 2))) AS cut FROM pieces),
    dual AS (SELECT DISTINCT doc_id FROM cuts WHERE cut IN (SELECT a || b || ', ' || c FROM threes))
    SELECT dataset_id, {sql.r6('avg((doc_id IN (SELECT doc_id FROM toxic))::INT)')} AS toxic,
      {sql.r6('avg((doc_id IN (SELECT doc_id FROM dual))::INT)')} AS dual_use
    FROM texts GROUP BY 1""",
)
def harm_long_lists(spark, folder):
    config = text_config(lexicon=_of_three("{}{}{}"), dual_use_terms=_of_three("{}{}, {}"))
    stats = text_harm.text_stats(doc_sets(spark, folder), config)
    return stats.select("dataset_id", r6("_text_toxic").alias("toxic"), r6("_text_dual_use").alias("dual_use"))


# ---- edge cases -----------------------------------------------------------


@query(
    "edge_coverage",
    f"""WITH users AS (SELECT DISTINCT user_id FROM events),
    probes AS (SELECT unnest({list(sql.EVENT_PROBES)}) AS probe),
    seen AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 20),
    d AS (SELECT u.user_id, avg(CASE WHEN s.event_type IS NULL THEN 0 ELSE 1 END) AS coverage
      FROM users u CROSS JOIN probes p
      LEFT JOIN seen s ON s.user_id = u.user_id AND s.event_type = p.probe GROUP BY 1)
    SELECT user_id::VARCHAR AS dataset_id, user_id % 3 <> 0 AS applicable,
      {sql.r6('CASE WHEN user_id % 3 <> 0 THEN 1 - coverage END')} AS score FROM d""",
)
def edge_coverage(spark, folder):
    events = table(spark, folder, "events")
    user = F.col("user_id").cast("string").alias("dataset_id")
    users = events.select("user_id").distinct()
    required = users.select(
        user, F.explode(F.array(*[F.lit(p) for p in sql.EVENT_PROBES])).alias("probe")
    )
    present = events.filter(F.col("value") > 20).select(user, F.col("event_type").alias("probe"))
    sets = users.select(user, (F.col("user_id") % 3 != 0).alias("physical_process_coupled"))
    found = safety_critical_edge_case_coverage(sets, required, present)
    return found.select("dataset_id", "applicable", r6("score").alias("score"))


# ---- composite ------------------------------------------------------------


def _assess(spark, folder, **more):
    return assess_safety(
        doc_sets(spark, folder).select("doc_id", "dataset_id", "text"),
        doc_set_metadata(spark, folder).drop("physical_process_coupled"),
        text_config(),
        **more,
    )


_LONG = sql.long_scores_cte(sql.DOC_SETS, "source || '|' || lang")
_SET_COMPOSITE = """SELECT dataset_id, avg(score) AS safety, count(score) AS n FROM long_scores
      GROUP BY 1"""


@query(
    "composite",
    f"""WITH {_LONG} SELECT dataset_id, {sql.r6('safety')} AS safety, n::BIGINT AS n_applicable
    FROM ({_SET_COMPOSITE})""",
)
def composite(spark, folder):
    proxies = _assess(spark, folder).proxies
    return compute_safety_composite(proxies).select(
        "dataset_id", r6("safety").alias("safety"), "n_applicable"
    )


@query(
    "breakdown",
    f"""WITH {_LONG}
    SELECT dataset_id, ord::BIGINT AS position, proxy, {sql.r6('score')} AS score,
      score IS NOT NULL AS applicable FROM long_scores
    UNION ALL SELECT dataset_id, 7, 'safety_critical_edge_case_coverage', NULL, false FROM meta""",
)
def breakdown(spark, folder):
    safety = _assess(spark, folder).safety
    return safety.select("dataset_id", F.posexplode("breakdown").alias("at", "b")).select(
        "dataset_id",
        (F.col("at") + 1).cast("bigint").alias("position"),
        "b.proxy",
        r6("b.score").alias("score"),
        "b.applicable",
    )


@query(
    "excluded",
    f"""WITH {_LONG}
    SELECT dataset_id, string_agg(proxy, ',' ORDER BY ord) || ',safety_critical_edge_case_coverage'
      AS excluded FROM long_scores WHERE score IS NULL GROUP BY 1""",
)
def excluded(spark, folder):
    safety = _assess(spark, folder).safety
    return safety.select("dataset_id", F.concat_ws(",", "excluded_for_na").alias("excluded"))


@query(
    "gate",
    f"""WITH {_LONG} SELECT dataset_id, (safety IS NULL OR safety <= 0.2) AS strict,
      (safety IS NULL OR safety <= 0.35) AS loose, n::BIGINT AS n_applicable
    FROM ({_SET_COMPOSITE})""",
)
def gate(spark, folder):
    safety = _assess(spark, folder).safety
    return safety.select(
        "dataset_id",
        passes_threshold().alias("strict"),
        passes_threshold(0.35).alias("loose"),
        "n_applicable",
    )


@query(
    "export_json",
    f"""WITH {_LONG} SELECT dataset_id, {sql.r6('safety')} AS safety, 7 - n AS n_excluded
    FROM ({_SET_COMPOSITE})""",
)
def export_json(spark, folder):
    shape = T.StructType(
        [
            T.StructField("safety", T.DoubleType()),
            T.StructField("excluded_for_na", T.ArrayType(T.StringType())),
        ]
    )
    parsed = to_json(_assess(spark, folder).safety).withColumn(
        "r", F.from_json("result", shape)
    )
    return parsed.select(
        "dataset_id",
        r6("r.safety").alias("safety"),
        F.size("r.excluded_for_na").cast("bigint").alias("n_excluded"),
    )


def short_text_share(records, metadata, config):
    """An extra proxy: share of texts under 200 characters."""
    short = F.avg((F.length(config.text_column) < 200).cast("double"))
    stats = records.groupBy("dataset_id").agg(short.alias("share"))
    struct = proxy_struct("short_text_share", "custom", F.col("share"), raw={"share": F.col("share")})
    return explode_proxies(stats, struct).select(*PROXY_COLUMNS)


@query(
    "extra_proxy",
    f"""WITH {_LONG}, extra AS (
      SELECT source || '|' || lang AS dataset_id, avg((length(text) < 200)::INT) AS score
      FROM documents GROUP BY 1),
    all_scores AS (SELECT dataset_id, score FROM long_scores UNION ALL SELECT * FROM extra)
    SELECT dataset_id, {sql.r6('avg(a.score)')} AS safety, count(a.score)::BIGINT AS n_applicable,
      {sql.r6('any_value(e.score)')} AS short_text_share
    FROM all_scores a JOIN extra e USING (dataset_id) GROUP BY 1""",
)
def extra_proxy(spark, folder):
    safety = _assess(spark, folder, extra_proxies=[short_text_share]).safety
    last = F.element_at("breakdown", -1)
    return safety.select(
        "dataset_id",
        r6("safety").alias("safety"),
        "n_applicable",
        r6(last["score"]).alias("short_text_share"),
    )


@query(
    "sampled_density",
    f"""WITH s AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY {u("'42'", 'doc_id')}, doc_id) AS rk
      FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S')),
    picked AS (SELECT * FROM s WHERE rk <= 30), {sql.flags_cte('source', 'picked')}
    SELECT dataset_id, {sql.r6('greatest(toxic, pii)')} AS score, n_scored::BIGINT AS n_scored
    FROM text_scores""",
)
def sampled_density(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    config = text_config(dataset_column="source", harm_sample_size=30)
    found = text_harm.harm_content_density(docs, config)
    return found.select(
        "dataset_id",
        r6("score").alias("score"),
        F.col("details.n_sampled").cast("bigint").alias("n_scored"),
    )


_LABELLED = f"""
    rows AS (
      SELECT doc_id, text, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS dataset_id,
        quality AS high, n_chars::DOUBLE AS price,
        nullif(length(regexp_replace(text, '[^0-9]', '', 'g')), 0)::DOUBLE AS discount
      FROM labels JOIN documents USING (doc_id))"""


@query(
    "assess_labelled",
    f"""WITH {_LABELLED}, {sql.metadata_cte('SELECT DISTINCT dataset_id FROM rows')},
    {sql.flags_cte('dataset_id', 'rows')}, {newton_sql(9, source='rows', keys=['doc_id'])},
    held AS (SELECT dataset_id, high, 1 / (1 + exp(-(t0 + t1 * z1 + t2 * z2))) AS p
      FROM z JOIN theta9 USING (dataset_id, m) WHERE fold = m),
    fitted AS (SELECT dataset_id, avg(1 - CASE WHEN high = 1 THEN p ELSE 1 - p END) AS p5
      FROM held GROUP BY 1),
    s AS (
      SELECT dataset_id, p5,
        [({clamp('poison_raw')})::DOUBLE, ({clamp('origin_raw')})::DOUBLE, ({sql.DECAY})::DOUBLE,
         greatest(toxic, pii)::DOUBLE, p5, dual::DOUBLE,
         CASE WHEN physical_process_coupled THEN (1.0 / 3)::DOUBLE END] AS scores
      FROM meta_scores JOIN text_scores USING (dataset_id) JOIN fitted USING (dataset_id))
    SELECT dataset_id, {sql.r6('list_avg(scores)')} AS safety,
      list_count(scores)::BIGINT AS n_applicable, {sql.r6('p5')} AS label_integrity FROM s""",
)
def assess_labelled(spark, folder):
    """All seven proxies on the labelled documents, label integrity included."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars")
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    rows = (
        table(spark, folder, "labels")
        .join(docs, "doc_id")
        .select(
            "doc_id",
            "text",
            "quality",
            "n_chars",
            F.when(F.col("lang") == "en", "en").otherwise("other").alias("dataset_id"),
            F.nullif(digits, F.lit(0)).alias("n_digits"),
        )
    )
    config = text_config(
        label_column="quality",
        feature_columns=("n_chars", "n_digits"),
        required_edge_probes=("night", "rain", "snow"),
        present_edge_probes=("night", "rain"),
    )
    sets = rows.select("dataset_id").distinct()
    safety = assess_safety(rows, metadata_for(sets), config).safety
    fitted = F.filter("breakdown", lambda b: b["proxy"] == "label_integrity")[0]
    return safety.select(
        "dataset_id",
        r6("safety").alias("safety"),
        "n_applicable",
        r6(fitted["score"]).alias("label_integrity"),
    )
