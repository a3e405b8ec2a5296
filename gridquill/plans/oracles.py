"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from .queries import BUCKET, DAYS, END, LABELS, START, STEP, T0, T1
from .promql import LOOKBACK_MS

_GRID = f"(SELECT unnest(range({START}, {END} + 1, {STEP}))::BIGINT AS t)"
_LO = START - LOOKBACK_MS
_DAYS_GRID = f"(SELECT unnest(range({DAYS[0]}, {DAYS[1]} + 1, {DAYS[2]}))::BIGINT AS t)"
_DAYS_LO = DAYS[0] - LOOKBACK_MS
_ALL = ", ".join(f"coalesce({c}, '') AS {c}" for c in LABELS)

_CELLS = f"""
 SELECT 'events' AS "__name__", event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ms, event_id,
        CAST(round(value * 100) AS BIGINT) AS cents, (epoch_us(ts) // 1000) // {BUCKET} AS b FROM events"""

_SERIES_IN_RANGE = f"""
 SELECT __series__id, min(coalesce(job,'')) AS job, min(coalesce(namespace,'')) AS namespace,
        min(coalesce(__name__,'')) AS metric, min(coalesce(route,'')) AS route, min(coalesce(pod,'')) AS pod,
        min(coalesce(instance,'')) AS instance, min(coalesce(container_id,'')) AS container_id
 FROM chunk_index WHERE __mint >= {_LO} AND __maxt <= {END}"""

SPANS = """
 WITH c AS (SELECT DISTINCT k.__series__id AS series_id, __mint AS s, __maxt AS e, greatest(coalesce(scrape_ms, 0), 0) AS tol
            FROM chunks k LEFT JOIN series x ON k.__series__id = x.__series__id
            WHERE __mint IS NOT NULL AND __maxt IS NOT NULL AND __mint <= __maxt),
 r AS (SELECT *, max(e) OVER (PARTITION BY series_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c),
 n AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + tol THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY s, e
       ROWS UNBOUNDED PRECEDING) AS p FROM r),
 q AS (SELECT series_id, p, min(s) AS s, max(e) AS e FROM n GROUP BY series_id, p),
 g AS (SELECT series_id, s, e, lag(e) OVER (PARTITION BY series_id ORDER BY s) AS b FROM q),
 spans AS (SELECT series_id, 'period' AS span_kind, s AS start_ms, e AS end_ms FROM g
           UNION ALL SELECT series_id, 'gap', b, s FROM g WHERE b IS NOT NULL)"""

READINGS = r"""
 r0 AS (SELECT __series__id AS series_id, __mint AS a, __maxt AS z, unnest(string_split(decode(__chunk_bytes), ',')) AS pair
        FROM chunks WHERE __mint <= __maxt AND __chunk_bytes IS NOT NULL),
 r1 AS (SELECT series_id, a, z, try_cast(string_split(pair, ':')[1] AS BIGINT) AS o, try_cast(string_split(pair, ':')[2] AS DOUBLE) AS v
        FROM r0 WHERE regexp_full_match(pair, '[0-9]+:[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')),
 readings AS (SELECT series_id, a + o AS t, v FROM r1 WHERE o IS NOT NULL AND o <= z - a AND isfinite(v))"""

_PART_COLUMNS = r"""
 WITH o AS (SELECT writer_id, part_no, CAST(record AS JSON) AS j FROM part_rows WHERE part_no IS NOT NULL AND json_valid(record) AND json_type(record) = 'OBJECT'),
 k AS (SELECT writer_id, part_no, CAST(j->>'$.__series__id' AS BIGINT) AS sid, j, unnest(json_keys(j)) AS label FROM o),
 c AS (SELECT writer_id, part_no, sid, label, json_type(j, '/' || replace(replace(label, '~', '~0'), '/', '~1')) AS t,
        json_extract_string(j, '/' || replace(replace(label, '~', '~0'), '/', '~1')) AS v
       FROM k WHERE label NOT IN ('__series__id', '__mint', '__maxt', '__name__')),
 cells AS (SELECT writer_id, part_no, sid, label, CASE WHEN t IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 'integer' WHEN t = 'DOUBLE' THEN 'decimal'
        WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'NULL' OR v = '' THEN NULL ELSE 'string' END AS kind,
        coalesce(CAST(try_cast(v AS DOUBLE) AS VARCHAR), lower(trim(v))) AS value FROM c),
 typed AS (SELECT writer_id, part_no, label, count(*) FILTER (kind = 'string') AS a, count(*) FILTER (kind = 'decimal') AS b,
        count(*) FILTER (kind = 'boolean') AS d, count(*) FILTER (kind = 'integer') AS e FROM cells GROUP BY ALL),
 cols AS (SELECT writer_id, part_no, label, CASE greatest(a, b, d, e) WHEN 0 THEN NULL WHEN a THEN 'string' WHEN b THEN 'decimal'
        WHEN d THEN 'boolean' ELSE 'integer' END AS kind FROM typed),
 parts AS (SELECT writer_id, part_no, lag(part_no) OVER (PARTITION BY writer_id ORDER BY part_no) AS previous
        FROM (SELECT DISTINCT writer_id, part_no FROM part_rows WHERE part_no IS NOT NULL))"""

_COMPARED = _PART_COLUMNS + r""",
 links AS (SELECT * FROM parts WHERE previous IS NOT NULL),
 now AS (SELECT l.writer_id, l.part_no, l.previous, label, kind FROM links l JOIN cols USING (writer_id, part_no)),
 was AS (SELECT l.writer_id, l.part_no, l.previous, label, kind FROM links l JOIN cols c ON c.writer_id = l.writer_id AND c.part_no = l.previous),
 came AS (SELECT * FROM now ANTI JOIN was USING (writer_id, part_no, label)),
 gone AS (SELECT * FROM was ANTI JOIN now USING (writer_id, part_no, label)),
 votes AS (SELECT writer_id, part_no, label, sid, value, count(*) AS n FROM cells WHERE kind IS NOT NULL AND sid IS NOT NULL GROUP BY ALL),
 mode AS (SELECT writer_id, part_no, label, sid, arg_max(value, (n, value)) AS value FROM votes GROUP BY ALL),
 present AS (SELECT DISTINCT writer_id, part_no, sid FROM cells),
 old AS (SELECT g.writer_id, g.part_no, g.label, m.sid, m.value FROM gone g JOIN mode m ON m.writer_id = g.writer_id AND m.part_no = g.previous AND m.label = g.label
        SEMI JOIN present p ON p.writer_id = g.writer_id AND p.part_no = g.part_no AND p.sid = m.sid),
 new AS (SELECT g.writer_id, g.part_no, g.label, m.sid, m.value FROM came g JOIN mode m ON m.writer_id = g.writer_id AND m.part_no = g.part_no AND m.label = g.label
        SEMI JOIN present p ON p.writer_id = g.writer_id AND p.part_no = g.previous AND p.sid = m.sid),
 agreed AS (SELECT o.writer_id, o.part_no, o.label AS ol, n.label AS nl, count(*) AS m FROM old o JOIN new n USING (writer_id, part_no, sid, value) GROUP BY ALL),
 scored AS (SELECT a.*, a.m / least(x.n, y.n) AS score, x.n AS xn, y.n AS yn FROM agreed a
        JOIN (SELECT writer_id, part_no, label, count(*) AS n FROM old GROUP BY ALL) x ON (x.writer_id, x.part_no, x.label) = (a.writer_id, a.part_no, a.ol)
        JOIN (SELECT writer_id, part_no, label, count(*) AS n FROM new GROUP BY ALL) y ON (y.writer_id, y.part_no, y.label) = (a.writer_id, a.part_no, a.nl)),
 pairs AS (SELECT writer_id, part_no, ol, nl FROM (SELECT *, row_number() OVER (PARTITION BY writer_id, part_no, ol ORDER BY score DESC, m DESC, xn DESC, yn DESC, nl) AS ro,
        row_number() OVER (PARTITION BY writer_id, part_no, nl ORDER BY score DESC, m DESC, xn DESC, yn DESC, ol) AS rn FROM scored WHERE score >= 0.75) WHERE ro = 1 AND rn = 1)"""

_CHANGES = _COMPARED + r"""
 SELECT writer_id, part_no, 'added' AS change_kind, '' AS old_label, label AS new_label FROM came c
   ANTI JOIN pairs p ON p.writer_id = c.writer_id AND p.part_no = c.part_no AND p.nl = c.label
 UNION ALL SELECT writer_id, part_no, 'removed', label, '' FROM gone c ANTI JOIN pairs p ON p.writer_id = c.writer_id AND p.part_no = c.part_no AND p.ol = c.label
 UNION ALL SELECT writer_id, part_no, 'renamed', ol, nl FROM pairs
 UNION ALL SELECT p.writer_id, p.part_no, 'retyped', ol, nl FROM pairs p JOIN gone g ON (g.writer_id, g.part_no, g.label) = (p.writer_id, p.part_no, p.ol)
   JOIN came c ON (c.writer_id, c.part_no, c.label) = (p.writer_id, p.part_no, p.nl) WHERE g.kind <> c.kind
 UNION ALL SELECT n.writer_id, n.part_no, 'retyped', n.label, n.label FROM now n JOIN was w ON (w.writer_id, w.part_no, w.label) = (n.writer_id, n.part_no, n.label) WHERE n.kind <> w.kind"""

# Where each column of each part leads: followed part by part, until a part lacks it.
_CONSISTENT = _COMPARED.replace("WITH o AS", "WITH RECURSIVE o AS", 1) + r""",
 walk AS (SELECT writer_id, part_no, label, kind, part_no AS here, label AS target FROM cols
   UNION ALL SELECT w.writer_id, w.part_no, w.label, w.kind, l.part_no, coalesce(p.nl, c.label)
   FROM walk w JOIN links l ON l.writer_id = w.writer_id AND l.previous = w.here
   LEFT JOIN pairs p ON p.writer_id = w.writer_id AND p.part_no = l.part_no AND p.ol = w.target
   LEFT JOIN cols c ON c.writer_id = w.writer_id AND c.part_no = l.part_no AND c.label = w.target WHERE p.nl IS NOT NULL OR c.label IS NOT NULL),
 route AS (SELECT writer_id, part_no, label, any_value(kind) AS kind, arg_max(target, here) AS target FROM walk GROUP BY ALL),
 newest AS (SELECT writer_id, target, kind AS cast_to FROM (SELECT *, row_number() OVER (PARTITION BY writer_id, target ORDER BY part_no DESC, label) AS rn
   FROM route WHERE kind IS NOT NULL) WHERE rn = 1),
 once AS (SELECT writer_id, part_no, row_no, max(struct_pack(a := written_at, r := record)).r AS record FROM part_rows
   GROUP BY writer_id, part_no, row_no, CASE WHEN part_no IS NULL OR row_no IS NULL THEN record END),
 rec AS (SELECT *, row_number() OVER () AS rid, CASE WHEN json_valid(record) AND json_type(record) = 'OBJECT' THEN CAST(record AS JSON) ELSE CAST('{}' AS JSON) END AS j FROM once),
 keys AS (SELECT rid, writer_id, part_no, j, unnest(json_keys(j)) AS label FROM rec),
 text AS (SELECT k.rid, coalesce(r.target, k.label) AS target, coalesce(n.cast_to, 'string') AS cast_to,
     CASE WHEN json_type(j, '/' || replace(replace(k.label, '~', '~0'), '/', '~1')) = 'DOUBLE'
       THEN regexp_replace(regexp_replace(json_extract_string(j, '/' || replace(replace(k.label, '~', '~0'), '/', '~1')), '(\.[0-9]*[1-9])0+$', '\1'), '\.0+$', '')
       ELSE json_extract_string(j, '/' || replace(replace(k.label, '~', '~0'), '/', '~1')) END AS v
   FROM keys k LEFT JOIN route r ON r.writer_id = k.writer_id AND r.part_no = k.part_no AND r.label = k.label
   LEFT JOIN newest n ON n.writer_id = r.writer_id AND n.target = r.target WHERE k.label NOT IN ('__series__id', '__mint', '__maxt', '__name__')),
 one AS (SELECT rid, target, cast_to, max(v) AS v FROM text WHERE v IS NOT NULL AND v <> '' GROUP BY ALL),
 shaped AS (SELECT *, CASE WHEN cast_to = 'integer' AND try_cast(v AS DECIMAL(38,6)) = floor(try_cast(v AS DECIMAL(38,6))) THEN CAST(try_cast(try_cast(v AS DECIMAL(38,6)) AS BIGINT) AS VARCHAR)
     WHEN cast_to = 'decimal' AND try_cast(v AS DOUBLE) IS NOT NULL THEN printf('%.6f', CAST(v AS DOUBLE))
     WHEN cast_to = 'boolean' AND lower(trim(v)) IN ('t', 'true', 'y', 'yes', '1') THEN 'true'
     WHEN cast_to = 'boolean' AND lower(trim(v)) IN ('f', 'false', 'n', 'no', '0') THEN 'false' WHEN cast_to = 'string' THEN v END AS x FROM one),
 listed AS (SELECT rid, string_agg(target || '=' || x, '|' ORDER BY target) FILTER (cast_to = 'string') AS strings,
   string_agg(target || '=' || x, '|' ORDER BY target) FILTER (cast_to = 'integer' AND x IS NOT NULL) AS integers,
   string_agg(target || '=' || x, '|' ORDER BY target) FILTER (cast_to = 'decimal' AND x IS NOT NULL) AS decimals,
   string_agg(target || '=' || x, '|' ORDER BY target) FILTER (cast_to = 'boolean' AND x IS NOT NULL) AS booleans,
   string_agg(target || '=' || v, '|' ORDER BY target) FILTER (x IS NULL) AS unreadable FROM shaped GROUP BY rid)
 SELECT writer_id, part_no, row_no, try_cast(j->>'$.__series__id' AS BIGINT) AS series_id, try_cast(j->>'$.__mint' AS BIGINT) AS mint,
   try_cast(j->>'$.__maxt' AS BIGINT) AS maxt, j->>'$.__name__' AS name, coalesce(strings, '') AS strings, coalesce(integers, '') AS integers,
   coalesce(decimals, '') AS decimals, coalesce(booleans, '') AS booleans, coalesce(unreadable, '') AS unreadable
 FROM rec LEFT JOIN listed USING (rid)"""

_STEPS = _COMPARED + r""",
 per AS (SELECT writer_id, part_no, string_agg(label || ':' || coalesce(kind, '?'), ',' ORDER BY label || ':' || coalesce(kind, '?')) AS l FROM cols GROUP BY ALL),
 f AS (SELECT p.writer_id, p.part_no, coalesce(l, '') AS l FROM parts p LEFT JOIN per q ON p.writer_id = q.writer_id AND p.part_no = q.part_no),
 m AS (SELECT *, CASE WHEN lag(l) OVER (PARTITION BY writer_id ORDER BY part_no) IS NOT DISTINCT FROM l THEN 0 ELSE 1 END AS n FROM f),
 v AS (SELECT writer_id, part_no, CAST(sum(n) OVER (PARTITION BY writer_id ORDER BY part_no) AS INTEGER) AS version FROM m),
 s AS (SELECT p.writer_id, p.part_no, 'rename' AS step, 'renamed' AS change_kind, ol AS old_label, nl AS new_label, g.kind AS old_type, c.kind AS new_type
   FROM pairs p JOIN gone g ON (g.writer_id, g.part_no, g.label) = (p.writer_id, p.part_no, p.ol) JOIN came c ON (c.writer_id, c.part_no, c.label) = (p.writer_id, p.part_no, p.nl)
  UNION ALL SELECT n.writer_id, n.part_no, 'cast', 'retyped', n.label, n.label, w.kind, n.kind FROM now n JOIN was w ON (w.writer_id, w.part_no, w.label) = (n.writer_id, n.part_no, n.label) WHERE n.kind <> w.kind
  UNION ALL SELECT c.writer_id, c.part_no, 'default', 'added', '', label, NULL, kind FROM came c ANTI JOIN pairs p ON p.writer_id = c.writer_id AND p.part_no = c.part_no AND p.nl = c.label
  UNION ALL SELECT c.writer_id, c.part_no, 'default', 'removed', label, '', kind, NULL FROM gone c ANTI JOIN pairs p ON p.writer_id = c.writer_id AND p.part_no = c.part_no AND p.ol = c.label),
 every AS (SELECT * FROM s UNION ALL SELECT writer_id, part_no, 'cast', 'retyped', old_label, new_label, old_type, new_type FROM s WHERE step = 'rename' AND old_type <> new_type)
 SELECT e.writer_id, e.part_no, v.version, step, change_kind, old_label, new_label, old_type, new_type FROM every e JOIN v ON v.writer_id = e.writer_id AND v.part_no = e.part_no"""

_VERSIONS = _PART_COLUMNS + r""",
 listed AS (SELECT writer_id, part_no, label || ':' || coalesce(kind, '?') AS x FROM cols),
 per AS (SELECT writer_id, part_no, count(*) AS n_labels, string_agg(x, ',' ORDER BY x) AS l FROM listed GROUP BY ALL),
 f AS (SELECT p.writer_id, p.part_no, coalesce(n_labels, 0) AS n_labels, sha256(coalesce(l, '')) AS fingerprint
       FROM parts p LEFT JOIN per q ON p.writer_id = q.writer_id AND p.part_no = q.part_no),
 m AS (SELECT *, CASE WHEN lag(fingerprint) OVER (PARTITION BY writer_id ORDER BY part_no) IS NOT DISTINCT FROM fingerprint THEN 0 ELSE 1 END AS n FROM f)
 SELECT writer_id, part_no, CAST(n_labels AS INTEGER) AS n_labels, fingerprint,
  CAST(sum(n) OVER (PARTITION BY writer_id ORDER BY part_no) AS INTEGER) AS version FROM m"""

_SLOTS = READINGS + """,
 d AS (SELECT DISTINCT r.series_id, t, CAST(ceil(3.0 * coalesce(scrape_ms, 60000)) AS BIGINT) AS age FROM readings r LEFT JOIN series x ON x.__series__id = r.series_id),
 o AS (SELECT series_id, min(t - t % 60000) AS a, max(t - t % 60000) + 60000 AS z FROM d GROUP BY series_id),
 i AS (SELECT d.series_id, t, least(t + age, coalesce(lead(t) OVER (PARTITION BY d.series_id ORDER BY t), o.z)) AS e FROM d JOIN o ON o.series_id = d.series_id),
 g AS (SELECT series_id, t, e, unnest(range(t - t % 60000, e, 60000)) AS slot FROM i),
 c AS (SELECT series_id, slot, max(CASE WHEN t >= slot THEN 1 ELSE 0 END) AS own, sum(least(e, slot + 60000) - greatest(t, slot)) AS ms FROM g GROUP BY series_id, slot)
 SELECT o.series_id, (any_value(z) - any_value(a)) // 60000 AS n_slots, CAST(sum(own) AS BIGINT) AS n_observed,
   CAST(sum(1 - own) AS BIGINT) AS n_filled, CAST(sum(ms) AS BIGINT) AS covered_ms
 FROM o JOIN c ON c.series_id = o.series_id GROUP BY o.series_id"""

# As the operator adds up: a cell's own readings in order of time, then what an earlier one covers.
_GRID_CELLS = READINGS.replace("SELECT __series__id AS series_id, __mint AS a, __maxt AS z,", "SELECT __series__id AS series_id, __mint AS a, __maxt AS z, received_at,").replace(
    "SELECT series_id, a, z, try_cast", "SELECT series_id, a, z, received_at, try_cast").replace("SELECT series_id, a + o AS t, v", "SELECT series_id, a + o AS t, v, received_at") + """,
 d0 AS (SELECT series_id, t, v, row_number() OVER (PARTITION BY series_id, t ORDER BY received_at DESC NULLS LAST, v DESC) AS rn FROM readings),
 d AS (SELECT r.series_id, t, v, CAST(ceil(3.0 * coalesce(scrape_ms, 60000)) AS BIGINT) AS age FROM d0 r LEFT JOIN series x ON x.__series__id = r.series_id WHERE rn = 1),
 o AS (SELECT series_id, min(t - t % 60000) AS a, max(t - t % 60000) + 60000 AS z FROM d GROUP BY series_id),
 i AS (SELECT d.series_id, t, v, least(t + age, coalesce(lead(t) OVER (PARTITION BY d.series_id ORDER BY t), o.z)) AS e FROM d JOIN o ON o.series_id = d.series_id),
 g AS (SELECT series_id, t, v, e, unnest(range(t - t % 60000, e, 60000)) AS slot FROM i),
 c AS (SELECT series_id, slot, count(*) FILTER (t >= slot) AS n, sum(least(e, slot + 60000) - greatest(t, slot)) AS ms,
   coalesce(list_sum(list(v * (least(e, slot + 60000) - greatest(t, slot)) ORDER BY t) FILTER (t >= slot)), 0)
     + coalesce(sum(v * (least(e, slot + 60000) - greatest(t, slot))) FILTER (t < slot), 0) AS area FROM g GROUP BY series_id, slot),
 every AS (SELECT series_id, unnest(range(a, z, 60000)) AS slot FROM o)
 SELECT e.series_id, CAST(e.slot AS BIGINT) AS slot_ms, CAST(coalesce(n, 0) AS INTEGER) AS n_readings, CASE WHEN ms > 0 THEN round(area / ms, 9) END AS value,
   coalesce(ms, 0) / 60000.0::DOUBLE AS coverage, CASE WHEN coalesce(n, 0) > 0 THEN 'observed' WHEN ms > 0 THEN 'filled' ELSE 'missing' END AS status
 FROM every e LEFT JOIN c ON c.series_id = e.series_id AND c.slot = e.slot"""

_KINDS = " UNION ALL ".join(
    ["SELECT '__series__id' AS key_kind, CAST(__series__id AS VARCHAR) AS key_value, __mint AS a, __maxt AS z FROM chunk_index"]
    + [f"SELECT '{c}', coalesce({c}, ''), __mint, __maxt FROM chunk_index" for c in LABELS])

_NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_CELL_SQL = rf"""
 WITH cat AS (SELECT regexp_replace(lower(label_name), '[^\p{{L}}\p{{N}}]', '', 'g') AS k, label_name AS name, label_type AS ty FROM label_catalog),
 a AS (SELECT r.series_id, coalesce(cat.name, r.label_name) AS label_name, coalesce(ty, 'string') AS ty,
              regexp_replace(label_value, '^\s+|\s+$', '', 'g') AS v,
              row_number() OVER (PARTITION BY series_id, coalesce(cat.name, r.label_name) ORDER BY seen_at DESC NULLS LAST, row_id DESC) AS rn
       FROM label_rows r LEFT JOIN cat ON cat.k = regexp_replace(lower(r.label_name), '[^\p{{L}}\p{{N}}]', '', 'g')
       WHERE r.label_name IS NOT NULL AND r.label_name <> ''),
 w AS (SELECT series_id, label_name, ty, v, CASE
         WHEN regexp_matches(v, '{_NUM}') THEN v
         WHEN regexp_matches(v, '^[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+(\.[0-9]*)?$') OR regexp_matches(v, '^[+-]?[0-9]+(_[0-9]+)+(\.[0-9]*)?$')
           THEN regexp_replace(v, '[,_]', '', 'g') END AS n FROM a WHERE rn = 1 AND v IS NOT NULL AND v <> ''),
 x AS (SELECT series_id, label_name, CASE ty
         WHEN 'string' THEN v
         WHEN 'bigint' THEN CASE WHEN try_cast(n AS DECIMAL(38,9)) = floor(try_cast(n AS DECIMAL(38,9)))
                            THEN CAST(CAST(floor(try_cast(n AS DECIMAL(38,9))) AS BIGINT) AS VARCHAR) END
         WHEN 'double' THEN CASE WHEN isfinite(try_cast(n AS DOUBLE)) THEN printf('%.3f', try_cast(n AS DOUBLE)) END
         WHEN 'boolean' THEN CASE WHEN lower(v) IN ('true','t','yes','y','on','1') THEN 'true'
                                  WHEN lower(v) IN ('false','f','no','n','off','0') THEN 'false' END
         WHEN 'timestamp' THEN CASE
            WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN CAST(CASE WHEN abs(CAST(v AS BIGINT)) >= 100000000000 THEN CAST(v AS BIGINT) ELSE CAST(v AS BIGINT) * 1000 END AS VARCHAR)
            WHEN regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') THEN
              CAST(epoch_us(CAST(replace(substr(v, 1, 19), 'T', ' ') AS TIMESTAMP)) // 1000
                - CASE WHEN regexp_matches(v, '[+-][0-9]{{2}}:[0-9]{{2}}$') THEN
                    (CASE WHEN substr(v, length(v) - 5, 1) = '-' THEN -1 ELSE 1 END)
                    * (CAST(substr(v, length(v) - 4, 2) AS BIGINT) * 60 + CAST(substr(v, length(v) - 1, 2) AS BIGINT)) * 60000 ELSE 0 END AS VARCHAR)
            END END AS cell_text FROM w)
"""

_FOUND_CELLS = _CELL_SQL + " SELECT series_id, label_name, cell_text FROM x WHERE cell_text IS NOT NULL"

#: The catalogue's entries, fixed values of the tables: name and type.
CATALOG = (
    ("build_no", "bigint"), ("deployed_at", "timestamp"), ("drift_ms", "double"), ("host_class", "string"), ("image_tag", "string"),
    ("is_canary", "boolean"), ("last_restart", "timestamp"), ("load_weight", "double"), ("mem_limit_bytes", "bigint"), ("owner_team", "string"),
    ("paged", "boolean"), ("port", "bigint"), ("preemptible", "boolean"), ("replica_count", "bigint"), ("runbook", "string"), ("sample_ratio",
    "double"), ("shard_offset", "bigint"), ("tier", "string"), ("zone", "string"),
)
_AS = {"string": "{}", "bigint": "CAST({} AS BIGINT)", "boolean": "CAST({} AS BOOLEAN)", "timestamp": "epoch_ms(CAST({} AS BIGINT))", "double": "{}"}
# doubles come from the number's text, not from the three decimals of a cell
_WIDE = _CELL_SQL.replace("printf('%.3f', try_cast(n AS DOUBLE))", "CAST(try_cast(n AS DOUBLE) AS VARCHAR)") + f""",
 e AS (SELECT DISTINCT series_id FROM label_rows),
 o AS (SELECT series_id, string_agg(label_name || '=' || cell_text, '|' ORDER BY label_name) AS other_labels FROM x
       WHERE cell_text IS NOT NULL AND label_name NOT IN (SELECT name FROM cat) GROUP BY series_id),
 t AS (SELECT series_id, {", ".join(f"max(cell_text) FILTER (label_name = '{n}') AS {n}" for n, _ in CATALOG)} FROM x GROUP BY series_id)
 SELECT e.series_id, {", ".join(f"CAST({n} AS DOUBLE) AS {n}" if k == "double" else f"{_AS[k].format(n)} AS {n}" for n, k in CATALOG)},
   coalesce(other_labels, '') AS other_labels FROM e LEFT JOIN t ON t.series_id IS NOT DISTINCT FROM e.series_id
   LEFT JOIN o ON o.series_id IS NOT DISTINCT FROM e.series_id"""

ORACLES: dict[str, str] = {
    "scan_equals": "SELECT __series__id, __mint, __maxt, namespace FROM chunk_index WHERE job = 'ingest'",
    "scan_equals_absent": "SELECT __series__id, __mint, __maxt FROM chunk_index WHERE job = 'no such job'",
    "scan_gte": f"SELECT __series__id, __mint, __maxt FROM chunk_index WHERE __mint >= {T0}",
    "scan_lte": f"SELECT __series__id, __mint, __maxt FROM chunk_index WHERE __maxt <= {T0}",
    "scan_time_range": f"SELECT __series__id, __mint, __maxt FROM chunk_index WHERE __mint >= {T0} AND __maxt <= {T1}",
    "scan_string_gte": "SELECT __series__id, __mint, route FROM chunk_index WHERE route >= '/v2/'",
    "scan_string_lte": "SELECT __series__id, __mint, namespace FROM chunk_index WHERE coalesce(namespace, '') <= 'edge'",
    "scan_conjunction": f"""SELECT __series__id, __mint, __maxt, job, namespace FROM chunk_index
        WHERE job = 'ingest' AND namespace = 'edge' AND __mint >= {T0} AND __maxt <= {T1}""",
    "scan_missing_column_ignored": "SELECT __series__id, __mint, __maxt FROM chunk_index WHERE job = 'ledger-api'",
    "scan_missing_column_empty": "SELECT __series__id, __mint, __maxt FROM chunk_index WHERE '' = 'x'",
    "scan_not_equals": """SELECT __series__id, __mint, __maxt, job FROM chunk_index
        WHERE coalesce(job, '') <> 'ingest' AND namespace = 'edge'""",
    "scan_regex": "SELECT __series__id, __mint, __maxt, job FROM chunk_index WHERE regexp_full_match(coalesce(job, ''), 'ledger.*|ing.*t')",
    "scan_not_regex": f"""SELECT __series__id, __mint, __maxt, coalesce(route, '') AS route FROM chunk_index
        WHERE NOT regexp_full_match(coalesce(route, ''), '/.*') AND __mint >= {T0}""",
    "label_empty_string": "SELECT __series__id, __mint, __maxt, coalesce(route, '') AS route FROM chunk_index WHERE coalesce(route, '') = ''",
    "selection_num_rows": f"SELECT count(*) AS num_rows FROM chunk_index WHERE job = 'ingest' AND __mint >= {T0}",
    "row_range_pick": """SELECT event_id, event_type FROM events
        WHERE (event_id >= 10 AND event_id < 25) OR (event_id >= 100 AND event_id < 400)""",
    "row_range_skip": f"SELECT event_id, event_type FROM events WHERE event_id < 0 OR (event_id >= 900 AND event_id < 2000) OR event_id >= {1 << 40}",
    "project_columns": "SELECT pod, __series__id, __mint FROM chunk_index",
    "project_missing_skipped": "SELECT namespace, __series__id FROM chunk_index",
    "unique_by_column": """SELECT instance, __mint, __maxt, __series__id FROM (SELECT *, row_number() OVER (
        PARTITION BY instance ORDER BY __mint, __maxt, __series__id) AS rn FROM chunk_index WHERE __maxt IS NOT NULL) WHERE rn = 1""",
    "select_series": f"""SELECT DISTINCT CAST(__series__id AS VARCHAR) AS series_id FROM chunk_index
        WHERE namespace = 'edge' AND __mint >= {T0} AND __maxt <= {T1}""",
    "select_series_grouping": f"""SELECT CAST(__series__id AS VARCHAR) AS series_id, min(coalesce(namespace,'')) AS namespace,
        min(coalesce(instance,'')) AS instance FROM chunk_index WHERE job = 'ingest' AND __mint >= {T0} AND __maxt <= {T1} GROUP BY __series__id""",
    "select_series_ordered": f"""WITH r AS (SELECT __series__id, __mint, __maxt, {_ALL} FROM chunk_index
          WHERE job = 'ingest' AND __mint >= {T0} AND __maxt <= {T1}),
        f AS (SELECT *, row_number() OVER (PARTITION BY __series__id ORDER BY __name__, __mint, __maxt, container_id, instance, job, namespace, pod, route) AS rn,
          min(namespace) OVER (PARTITION BY __series__id) AS ns FROM r)
        SELECT row_number() OVER (ORDER BY __name__, __mint, __maxt, container_id, instance, job, namespace, pod, route, __series__id) - 1 AS position,
          CAST(__series__id AS VARCHAR) AS series_id, ns AS namespace FROM f WHERE rn = 1""",
    "project_batches": "SELECT CAST(count(*) AS BIGINT) AS n_rows, TRUE AS bounded FROM chunk_index",
    "select_series_overlap": f"""SELECT CAST(__series__id AS VARCHAR) AS series_id, min(coalesce(job,'')) AS job
        FROM chunk_index WHERE __maxt >= {T0} AND __mint <= {T0 + 3_600_000} GROUP BY __series__id""",
    "label_values": "SELECT DISTINCT instance AS label_value FROM chunk_index WHERE job = 'ingest' AND instance <> ''",
    "label_names": """WITH m AS (SELECT * FROM chunk_index WHERE job = 'ingest' AND coalesce(route, '') = '') """ + " UNION ALL ".join(
        f"SELECT '{c}' AS label_name WHERE EXISTS (SELECT 1 FROM m WHERE {c} <> '')" for c in LABELS),
    "series_ids": """SELECT cluster, job, namespace, row_number() OVER (ORDER BY cluster, job, namespace) - 1 AS series_no
        FROM (SELECT DISTINCT cluster, job, namespace FROM series)""",
    "make_rows": """SELECT __series__id, scrape_ms AS __mint, '' AS absent, job, cluster AS zone FROM series""",
    "chunk_rows": f"""WITH c AS ({_CELLS}), g AS (SELECT __name__, event_type, user_id, min(ms) AS __mint, max(ms) AS __maxt,
          string_agg(ms || ':' || cents, ',' ORDER BY ms, event_id) AS payload FROM c GROUP BY __name__, event_type, user_id, b)
        SELECT dense_rank() OVER (ORDER BY __name__, event_type, user_id) - 1 AS __series__id, __mint, __maxt, payload,
          __name__, event_type, user_id FROM g""",
    "sample_chunks": f"""WITH c AS (SELECT *, min(ms) OVER (PARTITION BY __name__, event_type, user_id, b) AS a FROM ({_CELLS}) WHERE cents IS NOT NULL),
        g AS (SELECT __name__, event_type, user_id, min(ms) AS __mint, max(ms) AS __maxt,
          string_agg((ms - a) || ':' || cents, ',' ORDER BY ms, CAST(cents AS VARCHAR)) AS payload FROM c GROUP BY __name__, event_type, user_id, b)
        SELECT dense_rank() OVER (ORDER BY __name__, event_type, user_id) - 1 AS __series__id, __mint, __maxt, payload,
          __name__, event_type, user_id FROM g""",
    "read_chunk_bytes": """SELECT __series__id, __mint, CAST(coalesce(octet_length(__chunk_bytes), 0) AS BIGINT) AS n_bytes
        FROM chunks WHERE job = 'replayer'""",
    "decode_readings": f"""WITH {READINGS} SELECT series_id, count(*) AS n, min(t) AS first_t, max(t) AS last_t, max(v) AS max_v
        FROM readings GROUP BY series_id""",
    "write_roundtrip": f"SELECT __series__id, __mint, __maxt, {_ALL} FROM chunk_index",
    "compact_roundtrip": f"SELECT __series__id, __mint, __maxt, {_ALL} FROM chunk_index",
    "promql_sum": f"""WITH s AS (SELECT DISTINCT __series__id FROM chunk_index WHERE __mint >= {_LO} AND __maxt <= {END}
          AND __name__ = 'beacon_retry_total' AND coalesce(namespace, '') <> 'lab')
        SELECT t, CAST(count(*) AS DOUBLE) AS value FROM s, {_GRID} GROUP BY t""",
    "promql_sum_by": f"""WITH s AS ({_SERIES_IN_RANGE} AND __name__ = 'beacon_retry_total' GROUP BY __series__id)
        SELECT job, namespace, t, CAST(count(*) AS DOUBLE) AS value FROM s, {_GRID} GROUP BY job, namespace, t""",
    "promql_count_without": f"""WITH s AS ({_SERIES_IN_RANGE} AND regexp_full_match(coalesce(job, ''), 'ing.*') GROUP BY __series__id)
        SELECT job, namespace, t, CAST(count(*) AS DOUBLE) AS value FROM s, {_GRID} GROUP BY job, namespace, t""",
    "promql_selector": f"""WITH s AS ({_SERIES_IN_RANGE} AND job = 'ingest' AND coalesce(route, '') = '' GROUP BY __series__id)
        SELECT CAST(__series__id AS VARCHAR) AS series_id, metric, container_id, instance, job, namespace, pod, route, t,
          CAST(1 AS DOUBLE) AS value FROM s, {_GRID}""",
    "promql_decoded_max": f"""WITH {READINGS.replace("__maxt AS z,", "__maxt AS z, coalesce(cluster, '') AS cluster,")
        .replace("SELECT series_id, a, z, try", "SELECT series_id, cluster, a, z, try").replace("SELECT series_id, a + o", "SELECT series_id, cluster, a + o")
        .replace("WHERE __mint <= __maxt", f"WHERE __mint <= __maxt AND __maxt >= {_LO} AND __mint <= {END} AND coalesce(job, '') <> ''")},
        b AS (SELECT g.t AS t, cluster, arg_max(v, (r.t, v)) AS v FROM readings r JOIN {_GRID} g ON r.t <= g.t AND r.t > g.t - {LOOKBACK_MS}
          GROUP BY series_id, cluster, g.t) SELECT cluster, t, max(v) AS value FROM b GROUP BY cluster, t""",
    "promql_decoded_max_fortnight": f"""WITH {READINGS.replace("__maxt AS z,", "__maxt AS z, coalesce(cluster, '') AS cluster,")
        .replace("SELECT series_id, a, z, try", "SELECT series_id, cluster, a, z, try").replace("SELECT series_id, a + o", "SELECT series_id, cluster, a + o")
        .replace("WHERE __mint <= __maxt", f"WHERE __mint <= __maxt AND __maxt >= {_DAYS_LO} AND __mint <= {DAYS[1]} AND coalesce(job, '') <> ''")},
        b AS (SELECT g.t AS t, cluster, arg_max(v, (r.t, v)) AS v FROM readings r JOIN {_DAYS_GRID} g ON r.t <= g.t AND r.t > g.t - {LOOKBACK_MS}
          GROUP BY series_id, cluster, g.t) SELECT cluster, t, max(v) AS value FROM b GROUP BY cluster, t""",
    "promql_sum_by_fortnight": f"""WITH s AS (SELECT __series__id, min(coalesce(job,'')) AS job, min(coalesce(namespace,'')) AS namespace FROM chunk_index
          WHERE __mint >= {_DAYS_LO} AND __maxt <= {DAYS[1]} AND coalesce(job, '') <> '' GROUP BY __series__id),
        g AS (SELECT job, namespace, CAST(count(*) AS DOUBLE) AS value FROM s GROUP BY job, namespace)
        SELECT job, namespace, t, value FROM g, {_DAYS_GRID}""",
    "p3_found": SPANS + " SELECT * FROM spans",
    "p3_series_coverage": SPANS + """ SELECT series_id, count(*) FILTER (span_kind = 'period') AS n_periods,
        count(*) FILTER (span_kind = 'gap') AS n_gaps, CAST(sum(end_ms - start_ms) FILTER (span_kind = 'period') AS BIGINT) AS period_ms,
        CAST(coalesce(sum(end_ms - start_ms) FILTER (span_kind = 'gap'), 0) AS BIGINT) AS gap_ms FROM spans GROUP BY series_id""",
    "p4_found": _FOUND_CELLS,
    "p4_wide": _WIDE,
    "p5_found": _CHANGES,
    "p5_consistent": _CONSISTENT,
    "p5_steps": _STEPS,
    "p5_versions": _VERSIONS,
    "p7_grid": "WITH " + _GRID_CELLS,
    "p7_series_summary": "WITH " + _SLOTS,
    "p6_span_summary": f"""WITH k AS ({_KINDS}),
        t AS (SELECT key_kind, key_value, count(*) AS n_rows, min(a) AS first_start, max(z) AS last_end FROM k GROUP BY key_kind, key_value),
        m AS (SELECT key_kind, key_value, a, z, max(z) OVER (PARTITION BY key_kind, key_value ORDER BY a, z
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM k WHERE a <= z),
        c AS (SELECT key_kind, key_value, CAST(sum(greatest(0, z - greatest(a, coalesce(p, a)))) AS BIGINT) AS covered FROM m GROUP BY key_kind, key_value)
        SELECT t.key_kind, t.key_value, n_rows, first_start, last_end, coalesce(covered, 0) AS covered_ms
        FROM t LEFT JOIN c ON t.key_kind = c.key_kind AND t.key_value IS NOT DISTINCT FROM c.key_value""",
    "p7_found": f"""WITH {READINGS}, o AS (SELECT DISTINCT series_id, t - t % 60000 AS s FROM readings),
        n AS (SELECT series_id, s, lead(s) OVER (PARTITION BY series_id ORDER BY s) AS x FROM o)
        SELECT series_id, unnest(range(s + 60000, x, 60000))::BIGINT AS slot_ms FROM n WHERE x > s + 60000""",
}
