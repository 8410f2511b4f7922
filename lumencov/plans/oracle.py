"""Queries of the coverage engine in DuckDB SQL, over the store of sources.star_schema."""

from __future__ import annotations

from ..sources.formats import CHUNK_END, HEADER_END
from ..sources.star_schema import SQL as STORE

_STATUS = """
line_status AS (
  SELECT s.raw_upload_id, s.local_sample_id, s.source_file_id, s.line_no, s.coverage_type,
    CAST(CASE WHEN s.hits > 0 OR s.hit_branches >= s.total_branches THEN 2 WHEN s.hits = 0 OR s.hit_branches = 0 THEN 0
         WHEN s.hit_branches > 0 AND s.hit_branches < s.total_branches THEN 1 ELSE -1 END AS BIGINT) AS coverage_status,
    coalesce(m.hit_complexity_paths, m.total_complexity) AS hit_complexity_paths,
    CASE WHEN m.hit_complexity_paths IS NOT NULL THEN m.total_complexity END AS total_complexity
  FROM coverage_sample s LEFT JOIN method_data m USING (raw_upload_id, local_sample_id)),
flattened_lines AS (
  SELECT source_file_id, line_no, coverage_type, max(coverage_status) AS coverage_status, max(hit_complexity_paths) AS hit_complexity_paths, max(total_complexity) AS total_complexity
  FROM line_status GROUP BY ALL),
chunk_index AS (SELECT row_number() OVER (ORDER BY id) - 1 AS chunk_index, id, path FROM source_file),
session_index AS (SELECT row_number() OVER (ORDER BY id) - 1 AS session_index, id FROM raw_upload),
file_totals AS (
  SELECT chunk_index, id, path, count(*) AS file_lines, count(*) FILTER (coverage_status = 2) AS file_hits, count(*) FILTER (coverage_status = 0) AS file_misses, count(*) FILTER (coverage_status = 1) AS file_partials,
    count(*) FILTER (coverage_type = 'b') AS file_branches, count(*) FILTER (coverage_type = 'm') AS file_methods,
    CAST(coalesce(sum(hit_complexity_paths), 0) AS BIGINT) AS file_hit_complexity_paths, CAST(coalesce(sum(total_complexity), 0) AS BIGINT) AS file_total_complexity
  FROM flattened_lines JOIN chunk_index ON source_file_id = id GROUP BY chunk_index, id, path),
session_totals AS (
  SELECT CAST(session_index AS VARCHAR) AS session_index, s.raw_upload_id AS id, count(DISTINCT s.source_file_id) AS session_files, count(*) AS session_lines,
    count(*) FILTER (s.hits > 0 OR s.hit_branches >= s.total_branches) AS session_hits, count(*) FILTER (s.hits = 0 OR s.hit_branches = 0) AS session_misses,
    count(*) FILTER (s.hit_branches > 0 AND s.hit_branches < s.total_branches) AS session_partials, count(*) FILTER (s.coverage_type = 'b') AS session_branches, count(*) FILTER (s.coverage_type = 'm') AS session_methods,
    CAST(coalesce(sum(t.hit_complexity_paths), 0) AS BIGINT) AS session_hit_complexity_paths, CAST(coalesce(sum(t.total_complexity), 0) AS BIGINT) AS session_total_complexity
  FROM coverage_sample s JOIN line_status t USING (raw_upload_id, local_sample_id) JOIN session_index i ON i.id = s.raw_upload_id GROUP BY 1, 2)
"""

_LINES = """
missing_branches AS (SELECT raw_upload_id, local_sample_id, CAST(to_json(list(branch ORDER BY branch)) AS VARCHAR) AS missing_branches FROM branches_data WHERE hits = 0 GROUP BY ALL),
line_partials AS (SELECT raw_upload_id, local_sample_id, CAST(to_json(list([start_col, end_col, hits] ORDER BY local_span_id)) AS VARCHAR) AS partials FROM span_data WHERE local_sample_id IS NOT NULL GROUP BY ALL),
line_labels AS (SELECT raw_upload_id, local_sample_id, CAST(to_json(list(DISTINCT name ORDER BY name)) AS VARCHAR) AS labels FROM context_assoc JOIN context ON context_id = id GROUP BY ALL),
seen AS (SELECT source_file_id, list(DISTINCT session_index ORDER BY session_index) AS s FROM coverage_sample JOIN session_index ON id = raw_upload_id GROUP BY ALL),
present_sessions AS (SELECT chunk_index, id AS source_file_id, coalesce(CAST(to_json(s) AS VARCHAR), '[]') AS present_sessions FROM chunk_index LEFT JOIN seen ON id = source_file_id),
method AS (SELECT raw_upload_id, local_sample_id, max(hit_complexity_paths) AS hit_complexity_paths, max(total_complexity) AS total_complexity FROM method_data GROUP BY ALL),
picked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file_id, line_no, raw_upload_id ORDER BY local_sample_id) AS nth FROM coverage_sample)
    LEFT JOIN method USING (raw_upload_id, local_sample_id) LEFT JOIN missing_branches USING (raw_upload_id, local_sample_id) LEFT JOIN line_partials USING (raw_upload_id, local_sample_id) LEFT JOIN line_labels USING (raw_upload_id, local_sample_id)
  WHERE nth = 1),
line_sums AS (
  SELECT source_file_id, line_no, CAST(sum(hits) AS BIGINT) AS report_line_hits, CAST(sum(hit_branches) AS BIGINT) AS report_line_hit_branches, CAST(sum(total_branches) AS BIGINT) AS report_line_total_branches,
    CAST(sum(hit_complexity_paths) AS BIGINT) AS report_line_hit_complexity_paths, CAST(sum(total_complexity) AS BIGINT) AS report_line_total_complexity
  FROM picked GROUP BY ALL),
line_sessions AS (
  SELECT chunk_index, line_no, coverage_type, report_line_hits, report_line_hit_branches, report_line_total_branches, report_line_hit_complexity_paths, report_line_total_complexity,
    session_index, present_sessions, hits, hit_branches, total_branches, hit_complexity_paths, total_complexity, missing_branches, partials, labels
  FROM picked JOIN line_sums USING (source_file_id, line_no) JOIN present_sessions USING (source_file_id) JOIN session_index ON session_index.id = raw_upload_id)
"""

_PCT = "CASE WHEN {h} = 0 THEN '0' WHEN {h} = {l} THEN '100' ELSE printf('%.5f', CAST({h} AS DOUBLE) / CAST({l} AS DOUBLE) * 100) END"

_DOCUMENTS = f"""
report_json_files AS (
  SELECT path, '[' || chunk_index || ',[0,' || file_lines || ',' || file_hits || ',' || file_misses || ',' || file_partials || ',"' || {_PCT.format(h="file_hits", l="file_lines")} || '",' || file_branches || ',' || file_methods
    || ',0,0,' || file_hit_complexity_paths || ',' || file_total_complexity || ',0],null,null]' AS entry
  FROM file_totals),
report_json_sessions AS (
  SELECT session_index, '{{"t":[' || session_files || ',' || session_lines || ',' || session_hits || ',' || session_misses || ',' || session_partials || ',"' || {_PCT.format(h="session_hits", l="session_lines")} || '",' || session_branches || ','
    || session_methods || ',0,0,' || session_hit_complexity_paths || ',' || session_total_complexity || ',0],"d":' || coalesce(CAST("timestamp" AS VARCHAR), 'null') || ',"a":null,"f":' || coalesce(flags, 'null') || ',"c":null,"n":null,"N":"' || name
    || '","j":"' || job_name || '","u":null,"p":null,"e":null,"st":"' || session_type || '","se":' || session_extras || '}}' AS entry
  FROM session_totals JOIN raw_upload USING (id)),
cov AS (
  SELECT *, CASE coverage_type WHEN 'l' THEN 'null' ELSE '"' || coverage_type || '"' END AS ty,
    coalesce(CAST(hits AS VARCHAR), '"' || hit_branches || '/' || total_branches || '"') AS co,
    coalesce('[' || hit_complexity_paths || ',' || total_complexity || ']', CAST(total_complexity AS VARCHAR), CAST(hit_complexity_paths AS VARCHAR), 'null') AS cx
  FROM line_sessions),
session_json AS (
  SELECT *, '[' || session_index || ',' || co || CASE WHEN cx <> 'null' THEN ',' || coalesce(missing_branches, 'null') || ',' || coalesce(partials, 'null') || ',' || cx
    WHEN partials IS NOT NULL THEN ',' || coalesce(missing_branches, 'null') || ',' || partials WHEN missing_branches IS NOT NULL THEN ',' || missing_branches ELSE '' END || ']' AS sj,
    CASE WHEN labels IS NOT NULL THEN '[' || session_index || ',' || co || ',' || ty || ',' || labels || ']' END AS dj
  FROM cov),
line_json AS (
  SELECT chunk_index, line_no, any_value(present_sessions) AS present_sessions,
    coalesce(CAST(any_value(report_line_hits) AS VARCHAR), '"' || any_value(report_line_hit_branches) || '/' || any_value(report_line_total_branches) || '"') AS co, arg_min(ty, session_index) AS ty,
    string_agg(sj, ',' ORDER BY session_index) AS sessions,
    coalesce('[' || any_value(report_line_hit_complexity_paths) || ',' || any_value(report_line_total_complexity) || ']', CAST(any_value(report_line_total_complexity) AS VARCHAR), CAST(any_value(report_line_hit_complexity_paths) AS VARCHAR), 'null') AS cx,
    string_agg(dj, ',' ORDER BY session_index) AS points
  FROM session_json GROUP BY chunk_index, line_no),
line_text AS (
  SELECT chunk_index, line_no, present_sessions, '[' || co || ',' || ty || ',[' || sessions || ']' || CASE WHEN points IS NOT NULL THEN ',null,' || cx || ',[' || points || ']' WHEN cx <> 'null' THEN ',null,' || cx ELSE '' END || ']' AS line,
    line_no - coalesce(lag(line_no) OVER (PARTITION BY chunk_index ORDER BY line_no), 0) AS gap
  FROM line_json),
chunks_text AS (
  SELECT c.chunk_index, CASE WHEN count(line) = 0 THEN 'null' ELSE '{{"present_sessions":' || any_value(present_sessions) || '}}' || string_agg(repeat(chr(10), CAST(gap AS BIGINT)) || line, '' ORDER BY line_no) END AS chunk
  FROM chunk_index c LEFT JOIN line_text USING (chunk_index) GROUP BY c.chunk_index)
"""

_REPARSED = """
reparsed AS (
  SELECT chunk_index, line_no, session_index, lt AS coverage_type, CASE WHEN lt = 'b' THEN NULL WHEN hits IS NULL AND lt = 'm' THEN hit_branches ELSE hits END AS hits,
    CASE WHEN lt = 'b' THEN coalesce(hit_branches, hits) WHEN lt = 'l' THEN hit_branches END AS hit_branches, CASE WHEN lt = 'b' THEN coalesce(total_branches, 2) WHEN lt = 'l' THEN total_branches END AS total_branches,
    hit_complexity_paths, total_complexity, missing_branches, partials, labels
  FROM (SELECT *, first_value(coverage_type) OVER (PARTITION BY chunk_index, line_no ORDER BY session_index) AS lt FROM line_sessions)
  WHERE NOT (lt = 'b' AND coalesce(hits, 0) > 2))
"""

_REREAD = """
reread AS (
  SELECT path, name AS upload, line_no, coverage_type, hits, hit_branches, total_branches, hit_complexity_paths, total_complexity, missing_branches, partials, labels
  FROM reparsed JOIN chunk_index USING (chunk_index) JOIN session_index USING (session_index) JOIN raw_upload ON raw_upload.id = session_index.id)
"""


def _over(body: str, *more: str) -> str:
    return "WITH " + ",".join([STORE, *more]) + " " + body


TOTALS = """SELECT (SELECT count(*) FROM source_file) AS file_count, (SELECT count(*) FROM raw_upload) AS upload_count, (SELECT count(*) FROM context) AS test_case_count,
  count(*) FILTER (coverage_type = 'l' AND hits > 0) AS hit_lines, count(*) FILTER (coverage_type = 'l') AS total_lines,
  CAST(coalesce(sum(s.hit_branches) FILTER (coverage_type = 'b'), 0) AS BIGINT) AS hit_branches, CAST(coalesce(sum(s.total_branches) FILTER (coverage_type = 'b'), 0) AS BIGINT) AS total_branches,
  count(*) FILTER (coverage_type = 'b') AS total_branch_roots, count(*) FILTER (coverage_type = 'm' AND hits > 0) AS hit_methods, count(*) FILTER (coverage_type = 'm') AS total_methods,
  CAST(coalesce(sum(m.hit_complexity_paths) FILTER (coverage_type = 'm'), 0) AS BIGINT) AS hit_complexity_paths, CAST(coalesce(sum(m.total_complexity) FILTER (coverage_type = 'm'), 0) AS BIGINT) AS total_complexity
FROM coverage_sample s LEFT JOIN method_data m USING (raw_upload_id, local_sample_id)"""


_HEADER = """SELECT '{"labels_index":{' || string_agg('"' || i || '":"' || name || '"', ',' ORDER BY i) || '}}' FROM (SELECT row_number() OVER (ORDER BY id) AS i, name FROM context)"""

_REPORT_JSON = """SELECT '{"files":{' || coalesce((SELECT string_agg(to_json(path) || ':' || entry, ',' ORDER BY path) FROM report_json_files), '') || '},"sessions":{'
  || coalesce((SELECT string_agg('"' || session_index || '":' || entry, ',' ORDER BY CAST(session_index AS BIGINT)) FROM report_json_sessions), '') || '}}'"""


def oracle_sql() -> dict[str, str]:
    s, l, d = _STATUS, _LINES, _DOCUMENTS  # noqa: E741
    out = {f"scan_{t}": _over(f"SELECT * FROM {t}") for t in ("source_file", "raw_upload", "context", "context_assoc", "coverage_sample", "branches_data", "method_data", "span_data")}
    tables = [k.removeprefix("scan_") for k in out]
    out |= {f"merge_{t}": _over(f"SELECT * FROM {t}") for t in tables if t not in ("raw_upload", "coverage_sample")} | {f"write_{t}": _over(f"SELECT * FROM {t}") for t in tables}
    out |= {
        "append_store": _over("SELECT * FROM coverage_sample"),
        "insert_files": _over("SELECT DISTINCT path FROM source_file"),
        "insert_contexts": _over("SELECT DISTINCT name FROM context"),
        "list_files": _over("SELECT id, path FROM source_file"),
        "list_contexts": _over("SELECT id, name FROM context"),
        "list_raw_uploads": _over("SELECT * FROM raw_upload"),
        "list_coverage_samples": _over("SELECT * FROM coverage_sample"),
        "branches_for_samples": _over("SELECT * FROM branches_data"),
        "methods_for_samples": _over("SELECT * FROM method_data"),
        "spans_for_samples": _over("SELECT * FROM span_data"),
        "contexts_for_samples": _over("SELECT raw_upload_id, local_sample_id, id, name FROM context_assoc JOIN context ON context_id = id"),
        "samples_for_files": _over("SELECT * FROM coverage_sample WHERE source_file_id IN (SELECT id FROM source_file)"),
        "totals": _over(TOTALS),
        "line_status": _over("SELECT * FROM line_status", s),
        "flattened_lines": _over("SELECT * FROM flattened_lines", s),
        "chunk_index": _over("SELECT * FROM chunk_index", s),
        "file_totals": _over("SELECT * FROM file_totals", s),
        "coverage_pct": _over(f"SELECT chunk_index, path, {_PCT.format(h='file_hits', l='file_lines')} AS coverage_pct FROM file_totals", s),
        "session_index": _over("SELECT * FROM session_index", s),
        "session_totals": _over('SELECT session_index, id, session_files, session_lines, session_hits, session_misses, session_partials, session_branches, session_methods, session_hit_complexity_paths, session_total_complexity, "timestamp", raw_upload_url, flags, provider, build, name, job_name, ci_run_url, state, env, session_type, session_extras FROM session_totals JOIN raw_upload USING (id)', s),
        "line_sessions": _over("SELECT * FROM line_sessions", s, l),
        "report_line_totals": _over("SELECT DISTINCT chunk_index, line_no, report_line_hits AS hits, report_line_hit_branches AS hit_branches, report_line_total_branches AS total_branches, report_line_hit_complexity_paths AS hit_complexity_paths, report_line_total_complexity AS total_complexity FROM line_sessions", s, l),
        "present_sessions": _over("SELECT * FROM present_sessions", s, l),
        "missing_branches": _over("SELECT * FROM missing_branches", s, l),
        "line_partials": _over("SELECT * FROM line_partials", s, l),
        "line_labels": _over("SELECT * FROM line_labels", s, l),
        "label_index": _over("SELECT row_number() OVER (ORDER BY id) AS label_index, id, name FROM context"),
        "labels_index": _over(f"SELECT ({_HEADER}) AS header"),
        "merge_dims": _over("SELECT * FROM raw_upload"),
        "merge_facts": _over("SELECT * FROM coverage_sample"),
        "format_coverage": _over("SELECT raw_upload_id, local_sample_id, coalesce(CAST(hits AS VARCHAR), '\"' || hit_branches || '/' || total_branches || '\"') AS coverage, CASE coverage_type WHEN 'l' THEN 'null' ELSE '\"' || coverage_type || '\"' END AS type FROM coverage_sample"),
        "format_complexity": _over("SELECT raw_upload_id, local_sample_id, coalesce('[' || hit_complexity_paths || ',' || total_complexity || ']', CAST(total_complexity AS VARCHAR), CAST(hit_complexity_paths AS VARCHAR), 'null') AS complexity FROM method_data"),
        "strip_trailing_nulls": _over("""SELECT raw_upload_id, local_sample_id, CASE WHEN end_col IS NOT NULL THEN '[' || start_col || ',' || hits || ',null,' || end_col || ']' ELSE '[' || start_col || ',' || hits || ']' END AS trimmed FROM span_data"""),
        "normalize_coverage": _over("""SELECT raw_upload_id, local_sample_id,
            CASE WHEN kind = 'partial' AND t = 'l' THEN 'l' WHEN kind = 'branches' AND t = 'l' THEN 'b' ELSE t END AS coverage_type,
            CASE WHEN kind = 'hits' AND t <> 'b' THEN x WHEN kind = 'branches' AND t = 'm' THEN x END AS hits,
            CASE WHEN kind = 'partial' THEN 1 WHEN kind = 'branches' AND t <> 'm' THEN x WHEN kind = 'hits' AND t = 'b' THEN x END AS hit_branches,
            CASE WHEN kind = 'partial' THEN 2 WHEN kind = 'branches' AND t <> 'm' THEN CAST(4 AS BIGINT) WHEN kind = 'hits' AND t = 'b' THEN 2 END AS total_branches
          FROM (SELECT raw_upload_id, local_sample_id, coverage_type AS t, CASE local_sample_id % 3 WHEN 0 THEN 'hits' WHEN 1 THEN 'branches' ELSE 'partial' END AS kind, local_sample_id % 3 AS m, CASE WHEN coverage_type = 'b' AND local_sample_id % 3 = 0 THEN line_no % 3 ELSE line_no END AS x FROM coverage_sample)"""),
        "report_json_files": _over("SELECT * FROM report_json_files", s, l, d),
        "report_json_sessions": _over("SELECT * FROM report_json_sessions", s, l, d),
        "report_json": _over(f"SELECT ({_REPORT_JSON}) AS report_json", s, l, d),
        "report_lines": _over("SELECT chunk_index, line_no, line FROM line_text", s, l, d),
        "chunks_text": _over("SELECT * FROM chunks_text", s, l, d),
        # what the parser finds in the text that the writer made is what the text was made from
        "parse_line_sessions": _over("SELECT chunk_index, line_no, session_index, coverage_type, hits, hit_branches, total_branches, hit_complexity_paths, total_complexity FROM reparsed", s, l, _REPARSED),
        "parse_missing_branches": _over("SELECT chunk_index, line_no, session_index, 'l' AS branch_format, branch FROM (SELECT chunk_index, line_no, session_index, unnest(from_json(missing_branches, '[\"VARCHAR\"]')) AS branch FROM reparsed WHERE missing_branches IS NOT NULL)", s, l, _REPARSED),
        "parse_partials": _over("SELECT chunk_index, line_no, session_index, p[1] AS start_col, p[2] AS end_col, p[3] AS hits FROM (SELECT chunk_index, line_no, session_index, unnest(from_json(partials, '[[\"BIGINT\"]]')) AS p FROM reparsed WHERE partials IS NOT NULL)", s, l, _REPARSED),
        "parse_labels": _over("SELECT chunk_index, line_no, session_index, unnest(from_json(labels, '[\"VARCHAR\"]')) AS label FROM reparsed WHERE labels IS NOT NULL", s, l, _REPARSED),
        "parse_labels_index": _over("SELECT CAST(row_number() OVER (ORDER BY id) AS VARCHAR) AS label, name FROM context"),
        "parse_report_json": _over("SELECT chunk_index, path FROM file_totals", s),
        "parse_sessions": _over('SELECT CAST(session_index AS BIGINT) AS session_index, "timestamp", flags, name, job_name, session_type, session_extras FROM session_totals JOIN raw_upload USING (id)', s),
        "parse_report": _over("""SELECT (SELECT count(*) FROM source_file) AS files, count(*) FILTER (coverage_type = 'l' AND hits > 0) AS hit_lines, count(*) FILTER (coverage_type = 'l') AS total_lines,
            CAST(sum(hit_branches) FILTER (coverage_type = 'b') AS BIGINT) AS hit_branches, CAST(sum(total_branches) FILTER (coverage_type = 'b') AS BIGINT) AS total_branches, count(*) FILTER (coverage_type = 'm' AND hits > 0) AS hit_methods,
            count(*) FILTER (coverage_type = 'm') AS total_methods, CAST(sum(hit_complexity_paths) AS BIGINT) AS hit_complexity_paths, CAST(sum(total_complexity) AS BIGINT) AS total_complexity FROM reparsed""", s, l, _REPARSED),
        "explode_models": _over("""SELECT 'coverage_sample' AS "table", count(*) AS n FROM reparsed UNION ALL SELECT 'branches_data', count(*) FROM (SELECT unnest(from_json(missing_branches, '["VARCHAR"]')) FROM reparsed)
            UNION ALL SELECT 'method_data', count(*) FILTER (total_complexity IS NOT NULL) FROM reparsed UNION ALL SELECT 'span_data', count(*) FROM (SELECT unnest(from_json(partials, '[["BIGINT"]]')) FROM reparsed)
            UNION ALL SELECT 'context_assoc', count(*) FROM (SELECT unnest(from_json(labels, '["VARCHAR"]')) FROM reparsed)""", s, l, _REPARSED),
        "reread_source_file": _over("SELECT path FROM file_totals", s),
        "reread_raw_upload": _over("SELECT u.* EXCLUDE (id) FROM raw_upload u WHERE id IN (SELECT raw_upload_id FROM coverage_sample)"),
        "reread_context": _over("SELECT name FROM context"),
        "reread_coverage_sample": _over("SELECT path, upload, line_no, coverage_type, hits, hit_branches, total_branches FROM reread", s, l, _REPARSED, _REREAD),
        "reread_branches_data": _over("SELECT path, upload, line_no, CAST(0 AS BIGINT) AS hits, 'l' AS branch_format, unnest(from_json(missing_branches, '[\"VARCHAR\"]')) AS branch FROM reread WHERE missing_branches IS NOT NULL", s, l, _REPARSED, _REREAD),
        "reread_method_data": _over("SELECT path, upload, line_no, hit_complexity_paths, total_complexity FROM reread WHERE total_complexity IS NOT NULL", s, l, _REPARSED, _REREAD),
        "reread_span_data": _over("SELECT path, upload, line_no, p[3] AS hits, line_no AS start_line, p[1] AS start_col, line_no AS end_line, p[2] AS end_col FROM (SELECT path, upload, line_no, unnest(from_json(partials, '[[\"BIGINT\"]]')) AS p FROM reread WHERE partials IS NOT NULL)", s, l, _REPARSED, _REREAD),
        "reread_context_assoc": _over("SELECT path, upload, line_no, unnest(from_json(labels, '[\"VARCHAR\"]')) AS label FROM reread WHERE labels IS NOT NULL", s, l, _REPARSED, _REREAD),
        "parse_chunks": _over("SELECT * FROM chunks_text", s, l, d),
        "to_report": _over(f"SELECT ({_REPORT_JSON}) AS report_json, ({_HEADER}) || '{HEADER_END}' || (SELECT string_agg(chunk, '{CHUNK_END}' ORDER BY chunk_index) FROM chunks_text) AS chunks", s, l, d),
        "assign_local_ids": _over("SELECT raw_upload_id, local_sample_id, source_file_id, line_no FROM coverage_sample"),
        "parse_report_lines": _over("SELECT chunk_index, line_no, line AS raw FROM line_text", s, l, d),
        "parse_coverage": _over("SELECT raw_upload_id, local_sample_id, CASE WHEN hits IS NOT NULL THEN 'hits' ELSE 'branches' END AS kind, coalesce(hits, hit_branches) AS a, CASE WHEN hits IS NULL THEN total_branches END AS b FROM coverage_sample"),
        "parse_coverage_type": _over("SELECT raw_upload_id, local_sample_id, coverage_type FROM coverage_sample"),
        "parse_complexity": _over("SELECT raw_upload_id, local_sample_id, hit_complexity_paths AS paths, total_complexity AS total, TRUE AS valid FROM method_data"),
    }
    return out
