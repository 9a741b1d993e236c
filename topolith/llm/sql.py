"""DuckDB SQL for the queries that SQL can express; p6, p7 and p8 are tested on fixtures instead."""

from __future__ import annotations

from .records import CALL

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"


def _values(col: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(coalesce({col}, []), lambda x: trim(x, {_BLANKS})), lambda x: x IS NOT NULL AND x <> '')))"


def _calls(col: str) -> str:
    name = f"CASE WHEN regexp_matches(x, '\\binvoke\\b') THEN '' ELSE regexp_extract(x, '{CALL}', 1) END"
    return f"list_sort(list_distinct(list_filter(list_transform({_values(col)}, lambda x: {name}), lambda x: x IS NOT NULL AND x <> '')))"


_RECORDS = f"""recs AS (
  SELECT 'added_ops' AS field, diff_id AS record_key, any_value({_calls('added_ops')}) AS items FROM function_diffs GROUP BY diff_id
  UNION ALL
  SELECT 'required_calls', row_id, {_values('identifying_features.required_calls')} FROM signatures),
 totals AS (SELECT field, count(*) AS n FROM recs GROUP BY field),
 terms AS (SELECT field, record_key, unnest(items) AS item, len(items) AS n_terms FROM recs),
 df AS (SELECT field, item, count(*) AS cnt FROM terms GROUP BY field, item)"""

_PAIRS = f"""WITH {_RECORDS},
 pairs AS (SELECT a.field, a.item AS item_a, b.item AS item_b, count(*) AS c FROM terms a JOIN terms b
   ON a.field = b.field AND a.record_key = b.record_key AND a.item < b.item GROUP BY ALL HAVING count(*) >= 5),
 full_pairs AS (SELECT p.field, item_a, item_b, n, x.cnt AS a, y.cnt AS b, c FROM pairs p JOIN totals USING (field)
   JOIN df x ON x.field = p.field AND x.item = item_a JOIN df y ON y.field = p.field AND y.item = item_b)
"""

_SCORES = f"""WITH {_RECORDS},
 coll AS (SELECT field, sum(cnt) AS total FROM df GROUP BY field),
 parts AS (SELECT t.field, record_key, t.item AS term, cnt AS df, n_terms, cnt::DOUBLE / total AS pc, (1 + 10.0::DOUBLE * (cnt::DOUBLE / total)) / (n_terms + 10.0::DOUBLE) AS pd
   FROM terms t JOIN df ON df.field = t.field AND df.item = t.item JOIN coll ON coll.field = t.field WHERE cnt >= 2)
"""


def _set(table: str) -> str:
    f = "identifying_features."
    joined = "list_concat(" + ", ".join(f"coalesce({f}{c}, [])" for c in ("required_calls", "optional_calls", "string_patterns")) + ")"
    return f"SELECT row_id, id, fuzzy_hash, topology_hash, {_values(joined)} AS s FROM {table}"


_SIMILAR = f"""WITH RECURSIVE rows_ AS ({_set('signatures')} UNION ALL {_set('signature_feed')}),
 sets AS (SELECT row_id, s, len(s) AS n FROM rows_ WHERE len(s) >= 4),
 vals AS (SELECT row_id, n, unnest(s) AS v FROM sets),
 shared AS (SELECT a.row_id AS row_a, b.row_id AS row_b, a.n AS na, b.n AS nb, count(*) AS c FROM vals a JOIN vals b ON a.v = b.v AND a.row_id < b.row_id GROUP BY ALL),
 near AS (SELECT row_a, row_b FROM shared WHERE c >= 0.7 * (na + nb - c) - 1e-9)
"""

_REPEATS = _SIMILAR + f""",
 keys AS (SELECT row_id,
   nullif(lower(trim(id, {_BLANKS})), '') AS i, nullif(lower(trim(fuzzy_hash, {_BLANKS})), '') AS f,
   nullif(regexp_extract(lower(topology_hash), '^\\s*(?:[\\w.-]+\\s*:\\s*)*([0-9a-f]{{32}})\\s*$', 1), '') AS t FROM rows_),
 good AS (SELECT row_id, i, f, CASE WHEN len(list_distinct(string_split(t, ''))) > 1 THEN t END AS t FROM keys),
 edges AS (
   SELECT a.row_id AS row_a, b.row_id AS row_b FROM good a JOIN good b ON a.t = b.t AND a.row_id < b.row_id
   UNION
   SELECT row_a, row_b FROM near JOIN good a ON a.row_id = row_a JOIN good b ON b.row_id = row_b WHERE a.f = b.f OR a.i = b.i),
 feed AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS k FROM signature_feed),
 links AS (SELECT k, row_id, list(row_a) FILTER (row_a IS NOT NULL) AS earlier FROM feed LEFT JOIN edges ON row_b = row_id GROUP BY k, row_id),
 walk(k, cases) AS (
   SELECT 0::BIGINT, []::BIGINT[]
   UNION ALL
   SELECT l.k, CASE WHEN len(list_filter(coalesce(l.earlier, []), lambda x: NOT list_contains(w.cases, x))) > 0 THEN list_append(w.cases, l.row_id) ELSE w.cases END
   FROM walk w JOIN links l ON l.k = w.k + 1),
 done AS (SELECT cases FROM walk ORDER BY k DESC LIMIT 1)
SELECT min(row_a) AS row_a, row_b FROM edges, done
WHERE list_contains(cases, row_b) AND NOT list_contains(cases, row_a) GROUP BY row_b"""

SQL: dict[str, str] = {
    "p1_found": _PAIRS + "SELECT field, item_a, item_b FROM full_pairs WHERE c::DOUBLE / n >= 0.01 AND c::DOUBLE * n >= 4.0 * (a::DOUBLE * b::DOUBLE)",
    "p1_association": _PAIRS + """SELECT field, item_a, item_b, n, a AS count_a, b AS count_b, c AS count_ab,
 round(ln(c::DOUBLE * n / (a::DOUBLE * b::DOUBLE)), 6) AS pmi, round(c::DOUBLE * n / (a::DOUBLE * b::DOUBLE), 6) AS lift FROM full_pairs""",
    "p2_found": _REPEATS,
    "p3_found": """WITH best AS (SELECT matched_function, signature_id, max(confidence) AS c FROM scan_results
 WHERE matched_function <> '' AND signature_id IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY ALL)
SELECT matched_function, signature_id FROM best QUALIFY row_number() OVER (PARTITION BY matched_function ORDER BY c DESC, signature_id) <= 5""",
    "p4_found": _SCORES + """, best AS (SELECT *, min(df) OVER (PARTITION BY field, record_key) AS least FROM parts)
SELECT field, record_key, term FROM best WHERE df = least AND df <= 12""",
    "p4_scores": _SCORES + "SELECT field, record_key, term, df, n_terms, round(pd * ln(pd / pc), 6) AS score FROM parts",
    "p5_found": _SIMILAR + "SELECT row_a, row_b FROM near",
    "p5_links": _SIMILAR + """SELECT row_id, class_row, count(row_a)::BIGINT AS links FROM sets JOIN (SELECT s, min(row_id) AS class_row FROM sets GROUP BY s) USING (s)
 LEFT JOIN (SELECT row_a, row_b FROM near UNION ALL SELECT row_b, row_a FROM near) ON row_a = row_id GROUP BY row_id, class_row""",
}
