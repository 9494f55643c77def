"""SQL fragments shared by the oracles, written independently of the library's plans."""

from __future__ import annotations

import math

AS_OF = "2024-06-01"
TERMS = ("license", "token")
LANGUAGES = ("en", "de", "fr", "es", "it")
EVENT_PROBES = ("click", "view", "purchase", "error", "signup", "recall", "shutdown")
MIX_DOSES = (0.0, 0.025, 0.05, 0.1, 0.2, 0.4)
MIX_SEEDS = (0, 1, 2, 3, 4)
#: A mix takes a quarter as many records as the pool holds.
MIX_SHARE = 4
ORDER_ROUNDS = 64
LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def u(seed: str, *keys: str) -> str:
    """Uniform in [0, 1) from md5 of seed|keys; ``seed`` is an SQL expression."""
    text = f"concat_ws('|', {', '.join([seed, *keys])})"
    return f"((('0x' || substr(md5({text}), 1, 8))::UBIGINT)::DOUBLE / 4294967296)"


def r6(expression: str) -> str:
    return f"round(({expression})::DOUBLE, 6)"


def clamp(x: str) -> str:
    return f"CASE WHEN ({x}) IS NULL OR isnan(({x})::DOUBLE) THEN 0.0 ELSE greatest(0.0, least(1.0, {x})) END"


def metadata_cte(datasets: str) -> str:
    """``meta``: one described dataset per id in ``datasets``, every value from md5."""

    def d(tag: str) -> str:
        return u(f"'{tag}'", "dataset_id")

    return f"""
    ids AS ({datasets}),
    meta AS (
      SELECT dataset_id,
        {d('controls')} < 0.5 AS write_access_controls,
        CASE WHEN {d('provenance_known')} < 0.9 THEN {d('provenance')} < 0.4 END
          AS cryptographic_provenance,
        CASE WHEN {d('sources_known')} < 0.9 THEN floor({d('sources')} * 8)::INT END AS source_count,
        CASE WHEN {d('ugc_known')} < 0.9 THEN {d('ugc')} * 1.2 END AS ugc_fraction,
        {d('anonymous')} < 0.3 AS anonymous_contributions,
        CASE floor({d('breadth')} * 6)::INT WHEN 0 THEN 'narrow' WHEN 1 THEN 'medium'
          WHEN 2 THEN 'broad' WHEN 3 THEN 'web_scale' WHEN 4 THEN 'patchy' END AS scraping_breadth,
        CASE floor({d('date')} * 8)::INT WHEN 1 THEN '' WHEN 2 THEN '2031-01-01'
          WHEN 3 THEN '2023-13-45' WHEN 4 THEN '2023' WHEN 5 THEN '2023-05-06T10:20:30+02:00'
          WHEN 6 THEN '2021-02-03' WHEN 7 THEN 'not a date' END AS data_collection_end,
        CASE floor({d('date')} * 8)::INT WHEN 1 THEN '2022-03-04 05:06' END AS last_updated,
        {d('coupled')} < 0.6 AS physical_process_coupled
      FROM ids
    ),
    dated AS (
      SELECT *, coalesce(nullif(data_collection_end, ''), nullif(last_updated, '')) AS stamp
      FROM meta
    ),
    meta_scores AS (
      SELECT dataset_id, physical_process_coupled,
        1.0 - CASE WHEN write_access_controls THEN 0.4 ELSE 0 END
            - CASE WHEN cryptographic_provenance THEN 0.3 ELSE 0 END
            - least(0.3, (coalesce(source_count, 1) - 1) * 0.075) AS poison_raw,
        0.5 * coalesce(ugc_fraction, 0)
            + 0.3 * CASE coalesce(scraping_breadth, 'narrow') WHEN 'narrow' THEN 0.0
                WHEN 'medium' THEN 0.3 WHEN 'broad' THEN 0.7 WHEN 'web_scale' THEN 1.0 ELSE 0.5 END
            + CASE WHEN anonymous_contributions THEN 0.2 ELSE 0 END AS origin_raw,
        stamp,
        CASE WHEN try_cast(left(stamp, 10) AS DATE) IS NOT NULL AND regexp_full_match(stamp, '\\d{{4}}-\\d{{2}}-\\d{{2}}([T ]\\d{{2}}:\\d{{2}}(:\\d{{2}})?(Z|[+-]\\d{{2}}:\\d{{2}})?)?')
          THEN greatest(0.0, (epoch('{AS_OF} 00:00:00+00'::TIMESTAMPTZ) - epoch(try_cast(
            CASE WHEN length(stamp) > 10 AND regexp_matches(stamp, '(Z|[+-]\\d{{2}}:\\d{{2}})$') THEN stamp
                 WHEN length(stamp) = 10 THEN stamp || ' 00:00:00+00'
                 ELSE stamp || '+00' END AS TIMESTAMPTZ))) / 86400.0)
          END AS age_days
      FROM dated
    )"""


DECAY = (
    "CASE WHEN stamp IS NULL THEN NULL WHEN age_days IS NULL THEN 1.0 "
    "ELSE 1.0 - exp(-age_days / 365.0) END"
)

DOC_SETS = "SELECT DISTINCT source || '|' || lang AS dataset_id FROM documents"
SOURCES = "SELECT DISTINCT source AS dataset_id FROM documents"
LEXICON = r"(?i)\b(hate|kill|stupid|idiot)\b"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"


def flags_cte(dataset: str, source: str = "documents", extra: str = "") -> str:
    """``flags``: one row per text with its verdicts."""
    return f"""
    flags AS (
      SELECT {dataset} AS dataset_id, doc_id{extra},
        (text IS NOT NULL AND regexp_matches(text, '\\S')) AS is_text,
        regexp_matches(text, '{LEXICON}') AS is_toxic,
        regexp_matches(text, '{EMAIL}') AS is_email,
        regexp_matches(text, '{SSN}') AS is_ssn,
        regexp_matches(text, '(?i)({'|'.join(TERMS)})') AS is_dual
      FROM {source}
    ),
    text_scores AS (
      SELECT dataset_id, count(*) FILTER (is_text) AS n_scored,
        avg(is_toxic::INT) FILTER (is_text) AS toxic,
        avg((is_email OR is_ssn)::INT) FILTER (is_text) AS pii,
        avg(is_email::INT) FILTER (is_text) AS email,
        avg(is_ssn::INT) FILTER (is_text) AS ssn,
        avg(is_dual::INT) FILTER (is_text) AS dual
      FROM flags GROUP BY ALL
    )"""


def long_scores_cte(datasets: str, dataset: str) -> str:
    """``long_scores``: (dataset_id, ord, proxy, score), null where not applicable."""
    return f"""
    {metadata_cte(datasets)}, {flags_cte(dataset)},
    long_scores AS (
      SELECT dataset_id, 1 AS ord, 'poisoning_susceptibility' AS proxy,
        ({clamp('poison_raw')})::DOUBLE AS score FROM meta_scores
      UNION ALL SELECT dataset_id, 2, 'adversarial_provenance_risk', ({clamp('origin_raw')})::DOUBLE
        FROM meta_scores
      UNION ALL SELECT dataset_id, 3, 'factual_decay_rate', ({DECAY})::DOUBLE FROM meta_scores
      UNION ALL SELECT dataset_id, 4, 'harm_content_density', greatest(toxic, pii)::DOUBLE
        FROM text_scores
      UNION ALL SELECT dataset_id, 5, 'label_integrity', NULL FROM meta_scores
      UNION ALL SELECT dataset_id, 6, 'physical_harm_enablement_density', dual::DOUBLE
        FROM text_scores
    )"""


def _hex(digest: str, start: int, digits: int) -> str:
    return f"('0x' || substr({digest}, {start}, {digits}))::BIGINT"


def swap_or_not(position: str, size: str, keys: str) -> str:
    """Where the permutation with these round keys puts a position of 0..size-1."""
    prime = 2147483647
    mirror = f"((key.k % {size} + {size} - acc.x) % {size})"
    mixed = f"((greatest(acc.x, {mirror}) % {prime} + key.a) % {prime} * key.b % {prime})"
    bit = f"(((xor({mixed}, {mixed} >> 13) * 48271) % {prime}) >> 9) % 2"
    start = f"[{{'x': ({position})::BIGINT, 'k': 0::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT}}]"
    return (
        f"list_reduce({start} || {keys}, lambda acc, key: {{'x': CASE WHEN {bit} = 1 THEN {mirror} "
        "ELSE acc.x END, 'k': 0::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT}).x"
    )


def mix_cte(rows_per_slice: int | None = None, doses=MIX_DOSES, seeds=MIX_SEEDS) -> str:
    """``mix``: (injected_p, seed, draw_no, label, doc_id) over labelled documents.

    Without ``rows_per_slice`` a mix has a share of the pool's size.
    """
    doses_list = ", ".join(f"({p}::DOUBLE)" for p in doses)
    rows = f"(SELECT count(*) // {MIX_SHARE} FROM pool)" if rows_per_slice is None else rows_per_slice
    return f"""
    scored_pool AS (
      SELECT doc_id, quality, round((toxic + {u("'tox'", 'doc_id')}) / 2, 4) AS toxicity FROM labels
    ),
    pool AS (
      SELECT *, CASE WHEN toxicity >= 0.5 THEN 1 ELSE 0 END AS label FROM scored_pool
    ),
    sizes AS (SELECT label, count(*) AS pool_n FROM pool GROUP BY label),
    grid AS (
      SELECT injected_p, label, CASE WHEN label = 1 THEN hit ELSE n - hit END AS need
      FROM (SELECT injected_p, n, round_even(n * injected_p, 0)::BIGINT AS hit
        FROM (VALUES {doses_list}) d(injected_p), (SELECT ({rows})::BIGINT AS n))
      CROSS JOIN (VALUES (0), (1)) l(label)),
    seeds AS (SELECT unnest([{', '.join(map(str, seeds))}]) AS seed),
    indexed AS (
      SELECT p.*, row_number() OVER (PARTITION BY label ORDER BY {u("'pool'", 'doc_id')}, doc_id) AS rk
      FROM pool p),
    digests AS (
      SELECT seed, label, r, md5(concat_ws('|', seed, label, r)) AS d
      FROM seeds CROSS JOIN (VALUES (0), (1)) l(label) CROSS JOIN (SELECT unnest(range({ORDER_ROUNDS})) AS r)),
    rounds AS (
      SELECT seed, label, list({{'x': 0::BIGINT, 'k': {_hex('d', 1, 13)}, 'a': {_hex('d', 14, 7)},
        'b': {_hex('d', 21, 7)} + 1}} ORDER BY r) AS keys
      FROM digests GROUP BY 1, 2),
    draws AS (
      SELECT s.seed, g.label, g.pool_n, keys, unnest(range(1, g.need + 1)) AS draw_no
      FROM (SELECT label, pool_n, max(need) AS need FROM grid JOIN sizes USING (label)
        WHERE need <= pool_n GROUP BY 1, 2) g
      CROSS JOIN seeds s JOIN rounds k ON k.seed = s.seed AND k.label = g.label),
    ordered AS (
      SELECT seed, label, draw_no, {swap_or_not('draw_no - 1', 'pool_n', 'keys')} + 1 AS rk FROM draws),
    mix AS (
      SELECT injected_p, seed, draw_no, label, doc_id, quality
      FROM ordered JOIN indexed USING (label, rk) JOIN grid USING (label) JOIN sizes USING (label)
      WHERE need <= pool_n AND draw_no <= need
      UNION ALL
      SELECT injected_p, seed, draw_no, label, doc_id, quality
      FROM (
        SELECT injected_p, seed, label, i AS draw_no,
          floor({u('seed', 'label', 'i')} * pool_n)::BIGINT + 1 AS rk
        FROM (SELECT g.injected_p, g.label, s.seed, z.pool_n,
                unnest(range(1, g.need + 1)) AS i
              FROM grid g JOIN sizes z USING (label) CROSS JOIN seeds s WHERE g.need > z.pool_n)
      ) JOIN indexed USING (label, rk)
    )"""


def measurements_cte() -> str:
    """``measured``: one row per (dose, seed) with the proxy and two outcomes."""
    return f"""
    {mix_cte()},
    doc_flags AS (
      SELECT doc_id, n_chars, regexp_matches(text, '{LEXICON}') AS is_toxic,
        (regexp_matches(text, '{EMAIL}') OR regexp_matches(text, '{SSN}')) AS is_pii
      FROM documents
    ),
    measured AS (
      SELECT injected_p, seed, greatest(avg(is_toxic::INT), avg(is_pii::INT)) AS density,
        avg(1 - quality) AS harm_rate, avg(n_chars) / 1000 AS mean_length
      FROM mix JOIN doc_flags USING (doc_id) GROUP BY ALL
    ),
    series AS (
      SELECT 'harm_rate' AS outcome, injected_p, seed, density, harm_rate AS value FROM measured
      UNION ALL SELECT 'mean_length', injected_p, seed, density, mean_length FROM measured
      UNION ALL SELECT 'constant', injected_p, seed, density, 1.0 FROM measured
    )"""


def pearson(x: str, y: str) -> str:
    return (
        f"CASE WHEN min({x}) < max({x}) AND min({y}) < max({y}) "
        f"THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END"
    )


def bootstrap_cte(rounds: int, keys=("injected_p", "seed")) -> str:
    """``obs`` and ``ci``: correlation and percentile interval of every outcome in ``series``."""
    return f"""
    points AS (
      SELECT *, row_number() OVER (PARTITION BY outcome
        ORDER BY {u("'point'", *keys)}, {', '.join(keys)}) - 1 AS slot,
        count(*) OVER (PARTITION BY outcome) AS n FROM series),
    ns AS (SELECT DISTINCT outcome, n FROM points),
    picks AS (
      SELECT outcome, rep, floor({u("'0'", 'outcome', 'rep', 'i')} * n)::BIGINT AS slot
      FROM (SELECT outcome, n, rep, unnest(range(n)) AS i
        FROM ns CROSS JOIN (SELECT unnest(range({rounds})) AS rep))),
    rs AS (SELECT outcome, rep, {pearson('density', 'value')} AS r
      FROM picks JOIN points USING (outcome, slot) GROUP BY 1, 2),
    ci AS (SELECT outcome, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi,
      count(r) AS reps FROM rs WHERE r IS NOT NULL GROUP BY 1),
    obs AS (SELECT outcome, {pearson('density', 'value')} AS r, count(*) AS n FROM series GROUP BY 1)"""


def poisson_cte(rounds: int, *keys: str) -> str:
    """``obs`` and ``ci`` of every outcome in ``series``, resampled by Poisson(1) weights.

    A weight counts the steps of the distribution that a 64-bit draw reaches;
    the draw is the splitmix64 finaliser of the point's md5 and the round.
    """
    steps, total, term = [], 0.0, math.exp(-1.0)
    for k in range(12):
        total += term
        term /= k + 1
        steps.append(f"(z >= {int(total * 2**64)}::UBIGINT)::INT")

    def mixed(z: str, shift: int, factor: int) -> str:
        return f"((xor({z}, {z} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {2**64}::UHUGEINT)::UBIGINT"

    text = f"concat_ws('|', {', '.join(['0', 'outcome', *keys])})"
    return f"""
    points AS (SELECT outcome, density, value,
      ('0x' || substr(md5({text}), 1, 16))::UBIGINT AS h FROM series),
    z0 AS (SELECT outcome, density, value, rep,
      ((h::UHUGEINT + (rep + 1)::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % {2**64}::UHUGEINT)::UBIGINT AS z
      FROM points CROSS JOIN (SELECT unnest(range({rounds})) AS rep)),
    z1 AS (SELECT * REPLACE ({mixed('z', 30, 0xBF58476D1CE4E5B9)} AS z) FROM z0),
    z2 AS (SELECT * REPLACE ({mixed('z', 27, 0x94D049BB133111EB)} AS z) FROM z1),
    z3 AS (SELECT * REPLACE (xor(z, z >> 31) AS z) FROM z2),
    ws AS (SELECT outcome, rep, density - avg(density) OVER (PARTITION BY outcome) AS x,
      value - avg(value) OVER (PARTITION BY outcome) AS y, {' + '.join(steps)} AS w FROM z3),
    ms AS (SELECT outcome, rep, sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my,
      sum(w * x * x) / sum(w) AS xx, sum(w * y * y) / sum(w) AS yy, sum(w * x * y) / sum(w) AS xy
      FROM ws GROUP BY 1, 2),
    ci AS (SELECT outcome, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi, count(r) AS reps
      FROM (SELECT outcome, (xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)) AS r FROM ms)
      GROUP BY 1),
    obs AS (SELECT outcome, {pearson('density', 'value')} AS r, count(*) AS n FROM series GROUP BY 1)"""
