"""DuckDB SQL that the queries must match."""

_DRAW = """cast(('0x' || substr(md5('{seed}|' || coalesce(cast(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT)
        / 4294967296.0"""

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

SHARDING = f"""
WITH RECURSIVE
steps(k, c, n) AS (
    SELECT i, i, 0 FROM range(256) t(i)
    UNION ALL
    SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1
    FROM steps WHERE n < 8
),
crc AS (SELECT list(c ORDER BY k) AS tab FROM steps WHERE n = 8),
sized AS (
    SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size,
        regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes,
        {_DRAW.format(seed='slot')} AS draw
    FROM documents
),
summed AS (
    SELECT doc_id, size, draw,
        xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(bytes, lambda h: cast('0x' || h AS BIGINT))),
            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS text_crc32
    FROM sized, crc
),
keys AS (SELECT DISTINCT doc_id, coalesce(doc_id, 0) AS key FROM documents),
walk(doc_id, state, place, nxt) AS (
    SELECT doc_id, CASE WHEN key < 0 THEN key::HUGEINT + 18446744073709551616 ELSE key::HUGEINT END,
        0::BIGINT, 0::BIGINT FROM keys
    UNION ALL
    SELECT doc_id, s2, nxt, cast(floor((nxt + 1) * (2147483648.0 / ((s2 >> 33) + 1)::DOUBLE)) AS BIGINT)
    FROM (
        SELECT doc_id, nxt, (state * 2862933555777941757 + 1) % 18446744073709551616 AS s2
        FROM walk WHERE nxt < 24
    )
),
ends AS (SELECT doc_id, place, nxt FROM walk WHERE nxt >= 24)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, e.place AS shard,
    row_number() OVER (PARTITION BY e.place ORDER BY draw, s.doc_id, size, text_crc32) - 1 AS slot,
    CASE WHEN e.nxt = 24 THEN 24 ELSE e.place END AS grown_shard
FROM summed s JOIN ends e ON s.doc_id IS NOT DISTINCT FROM e.doc_id
"""

MIXING = f"""
WITH sized AS (
    SELECT doc_id, source, {_WORDS} AS size, {_DRAW.format(seed='mix')} AS draw FROM documents
),
totals AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT source, source_size, source_size * 3.0::DOUBLE AS cap,
        [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][
            ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight
    FROM totals
),
levels AS (
    SELECT *, row_number() OVER w AS place, cap / weight AS ratio,
        ((SELECT sum(source_size) FROM totals)::DOUBLE
          - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed
    WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)
),
level AS (SELECT arg_min(level, place) AS level FROM levels WHERE level <= ratio),
targets AS (
    SELECT source, source_size, least(cap, coalesce((SELECT level FROM level), 0) * weight) AS target
    FROM levels
),
placed AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized
),
cut AS (
    SELECT p.*, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN cast(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END
            AS epochs
    FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
    cast(epochs * size + greatest(0, least(size,
        cast(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM cut
"""


def _print(text: str) -> str:
    sections = f"string_split({text}, chr(10) || chr(10))"
    paragraphs = "list_transform(string_split(s, chr(10)), lambda p: sha256(p))"
    hashes = f"list_transform({sections}, lambda s: sha256('section|' || array_to_string({paragraphs}, '|')))"
    blocks = f"regexp_extract_all({text}, '[^\\n]{{1,32}}')"
    marks = f"list_distinct(list_transform({blocks}, lambda b: md5(b)[1:8]))"
    return (
        f"sha256('document|' || array_to_string({hashes}, '|')) || ':'"
        f" || array_to_string(list_sort({marks})[1:64], '')"
    )


def _near(left: str, right: str) -> str:
    def marks(p: str) -> str:
        return f"regexp_extract_all({p}[66:], '.{{8}}')"

    union = f"list_sort(list_distinct(list_concat({marks(left)}, {marks(right)})))[1:64]"
    common = f"len(list_intersect(list_intersect({union}, {marks(left)}), {marks(right)}))"
    share = f"({common} / greatest(len({union}), 1)::DOUBLE)"
    return (
        f"CASE WHEN {left}[1:64] = {right}[1:64] THEN 1.0::DOUBLE"
        f" ELSE 2 * {share} / (1 + {share}) END"
    )


FINGERPRINTS = f"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, {_print("coalesce(text, '')")} AS print FROM documents
),
following AS (
    SELECT *, length(text) AS n, length(text) // 4 AS q,
        coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text,
        coalesce(lead(print) OVER w, first_value(print) OVER w) AS next_print
    FROM texts WINDOW w AS (ORDER BY doc_id)
),
edited AS (
    SELECT *, left(text, n - q) || left(next_text, q) AS edited FROM following
),
prints AS (SELECT *, {_print('edited')} AS edited_print FROM edited)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, print AS fingerprint,
    edited_print AS edited_fingerprint,
    {_near('print', 'edited_print')} AS near_edited, {_near('print', 'next_print')} AS near_next
FROM prints
"""

TOP_K = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, cast(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank,
    vec_id, score
FROM scored QUALIFY rank <= 20
"""


def _clustering(rounds: int = 3, clusters: int = 16) -> str:
    def nearest(name: str, centroids: str) -> str:
        return f"""{name} AS (
    SELECT vec_id, v, cluster, d FROM (
        SELECT k.vec_id, k.v, c.cluster,
            cast(list_dot_product(k.v, k.v) - 2 * list_dot_product(k.v, c.c)
                + list_dot_product(c.c, c.c) AS BIGINT) AS d
        FROM kept k CROSS JOIN {centroids} c
    ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1
)"""

    steps = []
    for i in range(rounds):
        steps.append(nearest(f"a{i}", f"c{i}"))
        steps.append(f"""m{i} AS (
    SELECT cluster, list(floor(s / n) ORDER BY i) AS c FROM (
        SELECT cluster, i, sum(v[i]) AS s, count(*) AS n
        FROM a{i} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) t GROUP BY cluster, i
    ) GROUP BY cluster
),
c{i + 1} AS (
    SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m ON o.cluster = m.cluster
)""")
    steps.append(nearest("final", f"c{rounds}"))
    return f"""
WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS (
    SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, c FROM (
        SELECT sha256('1:' || cast(vec_id AS VARCHAR)) AS h, v AS c FROM kept ORDER BY 1 LIMIT {clusters}
    )
),
{(',' + chr(10)).join(steps)}
SELECT f.vec_id, cast(f.cluster AS INTEGER) AS cluster, f.d AS distance,
    cast(sum(f.d) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia,
    cast(sum(f.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(c.c, lambda x: cast(x AS BIGINT)), ',')) AS centroid_sha256
FROM final f JOIN c{rounds} c ON f.cluster = c.cluster
"""


CLUSTERING = _clustering()

# Near words share what is left when one code point is taken out at a place.
SPELLING = """
WITH RECURSIVE
steps(k, c, n) AS (
    SELECT i, i, 0 FROM range(256) t(i)
    UNION ALL
    SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1
    FROM steps WHERE n < 8
),
crc AS (SELECT list(c ORDER BY k) AS tab FROM steps WHERE n = 8),
runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[a-z\u00C0-\u00FF]+')) AS run
        FROM documents
    ) GROUP BY doc_id, run
),
hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(
            regexp_extract_all(hex(encode(coalesce(cast(doc_id AS VARCHAR), '') || ':' || run)), '..'),
            lambda h: cast('0x' || h AS BIGINT))),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h
    FROM runs, crc
),
words AS (
    SELECT word, cast(sum(n) AS BIGINT) AS n FROM (
        SELECT n, CASE WHEN h % 97 = 0
            THEN left(run, cast(h % length(run) AS BIGINT)) || substr(run, cast(h % length(run) + 2 AS BIGINT))
            ELSE run END AS word
        FROM hashed
    ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
),
cuts AS (
    SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
),
near AS (
    SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b
        ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION
    SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
    UNION
    SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
),
best AS (
    SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word
),
found AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
        CASE WHEN b.most >= 2 * w.n THEN b.most END AS form_n,
        CASE WHEN b.most >= 2 * w.n THEN (
            SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.n = b.most) END AS form
    FROM words w LEFT JOIN best b ON w.word = b.word
),
walk AS (
    SELECT word, word AS root, form AS nxt FROM found
    UNION ALL
    SELECT k.word, f.word, f.form FROM walk k JOIN found f ON k.nxt = f.word
)
SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n
FROM found f JOIN walk k ON f.word = k.word AND k.nxt IS NULL
"""
