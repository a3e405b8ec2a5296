"""DuckDB SQL that gives the same rows as this subpackage's queries."""

from __future__ import annotations

from itertools import combinations

from .bitmaps import BOUND_SIGMAS, ROUNDING, TARGET_ERROR
from .frequent import MIN_SHARE
from .leakage import VERBATIM_WORDS
from .mixing import SEED
from .queries import FREQUENT_COLUMNS

_FREQUENT = " UNION ALL ".join(
    f"""SELECT '{c}' AS label_name, {c} AS label_value, count(*) AS n_rows, count(*) / t.n::DOUBLE AS share
        FROM chunk_index, (SELECT count(*) AS n FROM chunk_index) t WHERE {c} <> '' GROUP BY {c}, t.n
        HAVING count(*) >= {MIN_SHARE} * t.n""" for c in FREQUENT_COLUMNS)

_DIMS = ("day", "namespace", "job")
_LEVELS = [c for n in (3, 2, 1, 0) for c in combinations(_DIMS, n)]
# The size of the bitmaps: the smallest power of two that counts all rows, were they distinct, within one per cent.
_BITS = f"""(SELECT min(b) FROM (SELECT CAST(pow(2, i) AS BIGINT) AS b, greatest(n, 1)::DOUBLE AS n
   FROM range(10, 50) x(i), (SELECT count(*) AS n FROM chunk_index) t)
   WHERE n / b <= 500 AND 1 / sqrt(2.0 * b) <= {TARGET_ERROR} AND b * exp(-least(n / b, 500)) >= 16
     AND sqrt(b * greatest(exp(least(n / b, 500)) - 1 - n / b, n / b * n / b / 2)) / n <= {TARGET_ERROR})"""
_WORDS = f"""
 WITH size AS (SELECT {_BITS} AS m),
 v AS (SELECT k.id_kind AS id_kind, day, namespace, job, k.v AS v FROM (
   SELECT CAST(make_date(1970, 1, 1) + CAST(floor(__mint / 86400000.0) AS INTEGER) AS VARCHAR) AS day, coalesce(namespace, '') AS namespace,
     coalesce(job, '') AS job, unnest([{{'id_kind': 'series', 'v': CAST(__series__id AS VARCHAR)}}, {{'id_kind': 'pod', 'v': pod}},
     {{'id_kind': 'container_id', 'v': container_id}}]) AS k FROM chunk_index)),
 p AS (SELECT id_kind, day, namespace, job, v, m, CAST(('0x' || substr(md5(v), 1, 15)) AS BIGINT) % m AS spot FROM v, size WHERE v <> ''),
 ones AS (""" + " UNION ALL ".join(
    f"""SELECT id_kind, '{','.join(level)}' AS level, """
    + ", ".join(d if d in level else f"CAST(NULL AS VARCHAR) AS {d}" for d in _DIMS)
    + f""", m, count(DISTINCT spot) AS ones, count(DISTINCT v) AS n_exact FROM p GROUP BY {', '.join(('id_kind', 'm', *level))}"""
    for level in _LEVELS) + f"""),
 raw AS (SELECT *, -m * ln((m - ones) / m::DOUBLE) AS raw FROM ones),
 counted AS (SELECT id_kind, level, day, namespace, job, n_exact, CAST(round(raw) AS BIGINT) AS n_distinct, CASE WHEN ones > 1 THEN
   CAST(ceil({BOUND_SIGMAS} * sqrt(m * greatest(exp(raw / m) - raw / m - 1, raw / m * raw / m / 2)) + {ROUNDING}) AS BIGINT) ELSE 0 END AS error_count
   FROM raw)"""
_COUNTED = _WORDS + " SELECT id_kind, level, day, namespace, job, n_distinct, error_count, error_count / n_distinct::DOUBLE AS error_bound FROM counted"

def _grams(key: str, text: str, source: str) -> str:
    """Runs of twelve words: words are cut first and lowered then, as the operator does."""
    return f"""(SELECT {key}, g FROM (SELECT {key}, i, n, string_agg(w, ' ') OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN CURRENT ROW AND {VERBATIM_WORDS - 1} FOLLOWING) AS g
      FROM (SELECT {key}, i, lower(l[i]) AS w, len(l) AS n FROM (SELECT {key}, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT {key}, regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+') AS l FROM {source})))) WHERE i + {VERBATIM_WORDS - 1} <= n)"""


_VERBATIM = f"SELECT DISTINCT doc_id, item_id FROM {_grams('doc_id', 'text', 'documents')} d JOIN {_grams('item_id', 'passage', 'eval_items')} p ON d.g = p.g"

# Water-filling in closed form: by the ratio of limit to share, the first sources are clamped, up to
# where the rest, split by share, exceeds none of the limits left.
_MIXED = f"""
 WITH t AS (SELECT nullif(lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')), '') AS source, target_share AS w, max_repeats AS k FROM mix_targets),
 d AS (SELECT doc_id, nullif(lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')), '') AS source, CAST(coalesce(length(text), 0) AS BIGINT) AS n FROM documents),
 h AS (SELECT t.*, coalesce((SELECT sum(n) FROM d WHERE d.source = t.source), 0)::BIGINT AS have FROM t WHERE source IS NOT NULL),
 l AS (SELECT *, have * k::DOUBLE AS lim, sum(have) OVER ()::DOUBLE AS budget FROM h),
 o AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_lim,
         sum(w) OVER (ORDER BY lim / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM l WHERE w > 0 AND lim > 0),
 c AS (SELECT *, (budget - before_lim) * w / w_left > lim AS over FROM o),
 e AS (SELECT *, bool_and(over) OVER (ORDER BY lim / w, source ROWS UNBOUNDED PRECEDING) AS capped FROM c),
 q AS (SELECT source, CASE WHEN capped THEN lim ELSE (budget - coalesce(sum(lim) FILTER (capped) OVER (), 0)) * w / sum(w) FILTER (NOT capped) OVER () END AS planned, capped FROM e),
 p AS (SELECT l.source, w, k, have, coalesce(planned, 0) AS planned, CASE WHEN w > 0 AND lim <= 0 THEN TRUE ELSE coalesce(capped, FALSE) END AS capped,
         CASE WHEN have > 0 THEN least(coalesce(planned, 0) / have, k) ELSE 0.0 END AS repeats FROM l LEFT JOIN q ON q.source = l.source),
 r AS (SELECT *, CAST(floor(repeats) AS INTEGER) AS whole, greatest(planned - floor(repeats) * have, 0) AS rest FROM p),
 m AS (SELECT d.doc_id, d.source, d.n, r.whole, r.rest, sum(n) OVER (PARTITION BY d.source ORDER BY CAST('0x' || substr(md5('{SEED}/' || d.source || '/' || doc_id), 1, 13) AS BIGINT), doc_id) - n / 2.0 AS middle
       FROM d JOIN r ON r.source = d.source),
 u AS (SELECT doc_id, source, n, whole + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END AS uses FROM m)"""

ORACLES: dict[str, str] = {
    "p1_found": f"SELECT label_name, label_value FROM ({_FREQUENT})",
    "p1_frequent_values": _FREQUENT,
    "p9_mix_characters": _MIXED + " SELECT doc_id, source, CAST(unnest(range(1, uses + 1)) AS INTEGER) AS copy_no FROM u",
    "p9_shares_characters": _MIXED + """, g AS (SELECT source, CAST(sum(n * uses) AS BIGINT) AS used_tokens, CAST(sum(uses) AS BIGINT) AS used_records, max(uses) AS most_repeats FROM u GROUP BY source)
        SELECT r.source, round(w, 9) AS target_share, have AS source_tokens, round(planned / sum(planned) OVER (), 9) AS planned_share, round(repeats, 9) AS repeats, capped,
          coalesce(used_tokens, 0) AS used_tokens, coalesce(used_records, 0) AS used_records, coalesce(most_repeats, 0) AS most_repeats,
          round(coalesce(used_tokens, 0) / sum(used_tokens) OVER (), 9) AS reached_share FROM r LEFT JOIN g ON g.source = r.source""",
    "p8_verbatim": _VERBATIM,
    "p2_distinct_counts_md5": _COUNTED,
    "p2_merged_loads": _COUNTED,
    "p2_bound_checked": _WORDS + """ SELECT id_kind, level, day, namespace, job, n_distinct, error_count, n_exact,
        abs(n_distinct - n_exact) <= error_count AS within_bound FROM counted""",
}
