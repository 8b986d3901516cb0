"""DuckDB SQL for each query, written from the rules of the derived data and not from the texts that the queries parse."""

from __future__ import annotations

_BASE = """
WITH e AS (SELECT event_id, event_id::VARCHAR AS case_id, 'u' || user_id::VARCHAR AS family_id, event_id AS pos, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type, ts, value FROM events),
c AS (SELECT *, 'run-' || (k % 3)::VARCHAR AS run_id,
  CASE k % 4 WHEN 0 THEN 'RESPOND' WHEN 1 THEN 'CALL_TOOL' WHEN 2 THEN 'ASK_CLARIFICATION' ELSE 'REFUSE' END AS expected_decision,
  CASE k % 5 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'UNSUPPORTED' WHEN 2 THEN 'CONFLICTING' WHEN 3 THEN 'INSUFFICIENT_CONTEXT' ELSE 'NOT_APPLICABLE' END AS expected_answerability,
  CASE WHEN k % 4 = 1 THEN CASE (k // 4) % 4 WHEN 0 THEN 'search_records' WHEN 1 THEN 'get_record' WHEN 2 THEN 'calculate' ELSE 'lookup_status' END END AS expected_tool FROM e),
a AS (SELECT *,
  CASE WHEN event_type <> 'error' THEN 'completed' WHEN pos % 4 = 0 THEN 'timeout' WHEN pos % 4 = 2 THEN 'invalid_response' ELSE 'execution_error' END AS status,
  CASE WHEN event_type <> 'error' OR pos % 4 = 2 THEN NULL WHEN pos % 4 = 0 THEN 'TIMEOUT' WHEN pos % 4 = 1 THEN 'CONTEXT_OVERFLOW' ELSE 'EXECUTION_ERROR' END AS runtime_error_code,
  CASE event_type WHEN 'click' THEN expected_decision WHEN 'view' THEN 'RESPOND' WHEN 'purchase' THEN 'CALL_TOOL' WHEN 'signup' THEN 'REFUSE' END AS decision,
  CASE event_type WHEN 'click' THEN expected_answerability WHEN 'view' THEN 'SUPPORTED' WHEN 'purchase' THEN expected_answerability WHEN 'signup' THEN 'NOT_APPLICABLE' END AS answerability,
  CASE WHEN event_type = 'click' THEN expected_tool WHEN event_type = 'purchase' THEN 'get_record' END AS tool FROM c),
l AS (SELECT *, status IN ('timeout', 'execution_error') AS runtime,
  CASE status WHEN 'invalid_response' THEN 'parser_failure,invalid_schema' WHEN 'timeout' THEN 'timeout' WHEN 'execution_error' THEN CASE runtime_error_code WHEN 'CONTEXT_OVERFLOW' THEN 'overflow' ELSE 'incomplete_run' END ELSE '' END AS attempt_labels,
  CASE WHEN expected_decision = 'CALL_TOOL' AND decision <> 'CALL_TOOL' THEN 'missed_call' WHEN expected_decision <> 'CALL_TOOL' AND decision = 'CALL_TOOL' THEN 'unnecessary_call'
       WHEN expected_decision = 'CALL_TOOL' AND tool <> expected_tool THEN 'wrong_tool' ELSE '' END AS action_label FROM a),
s AS (
  SELECT l.*, 'action_correct' AS metric_id, true AS eligible, CASE WHEN decision = expected_decision THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, NULL::VARCHAR AS missing_reason, CASE WHEN status = 'completed' THEN action_label ELSE attempt_labels END AS labels FROM l
  UNION ALL SELECT l.*, 'answerability_correct', true, CASE WHEN answerability = expected_answerability THEN 1.0 ELSE 0.0 END, NULL, CASE WHEN status <> 'completed' THEN attempt_labels WHEN answerability <> expected_answerability THEN 'wrong_answerability' ELSE '' END FROM l
  UNION ALL SELECT l.*, 'schema_valid', NOT runtime, CASE WHEN runtime THEN NULL WHEN status = 'completed' THEN 1.0 ELSE 0.0 END, CASE WHEN status = 'timeout' THEN 'runtime_timeout' WHEN runtime THEN 'runtime_' || lower(runtime_error_code) END, attempt_labels FROM l
  UNION ALL SELECT l.*, 'tool_identity_correct', expected_decision = 'CALL_TOOL' AND NOT runtime, CASE WHEN expected_decision <> 'CALL_TOOL' OR runtime THEN NULL WHEN tool = expected_tool THEN 1.0 ELSE 0.0 END,
    CASE WHEN expected_decision <> 'CALL_TOOL' THEN 'not_tool_required' WHEN status = 'timeout' THEN 'runtime_timeout' WHEN runtime THEN 'runtime_' || lower(runtime_error_code) END,
    CASE WHEN expected_decision <> 'CALL_TOOL' THEN '' WHEN status = 'completed' THEN action_label ELSE attempt_labels END FROM l),
f AS (SELECT case_id, list_aggregate(list_sort(list_distinct(list_filter(string_split(string_agg(labels, ','), ','), lambda x: x <> ''))), 'string_agg', ',') AS failure_labels FROM s GROUP BY case_id),
w AS (SELECT 'run-' || (k % 3)::VARCHAR || ':' || a.case_id || ':1' AS attempt_id, a.case_id, status, CASE status WHEN 'invalid_response' THEN 'PARSE_ERROR' END AS parse_error, runtime_error_code AS runtime_error, coalesce(failure_labels, '') AS failure_labels, expected_decision, decision AS observed_decision
  FROM a LEFT JOIN f ON a.case_id = f.case_id WHERE status <> 'completed' OR coalesce(failure_labels, '') <> '')
"""

_TOOL = "CASE {} % 4 WHEN 0 THEN 'search_records' WHEN 1 THEN 'get_record' WHEN 2 THEN 'calculate' ELSE 'lookup_status' END"
_JSON = """'{"case_id":"' || case_id || '","expected_answerability":"' || expected_answerability || '","expected_decision":"' || expected_decision || '"' || CASE WHEN expected_tool IS NULL THEN '' ELSE ',"expected_tool":"' || expected_tool || '"' END || ',"family_id":"' || family_id || '","k":' || k::VARCHAR || '}'"""
_METRICS = "SELECT metric_id, count(*) AS total_rows, count(CASE WHEN eligible THEN score END) AS eligible_instances, count(*) FILTER (score IS NULL) AS missing_instances, avg(CASE WHEN eligible THEN score END) AS estimate FROM s GROUP BY metric_id"
_KIND = "CASE (conv_id * 3 + turn * 5) % 7 WHEN 0 THEN 'answer' WHEN 1 THEN 'call' WHEN 2 THEN 'invalid' WHEN 3 THEN 'call' WHEN 4 THEN 'invalid' WHEN 5 THEN 'call' ELSE 'answer' END"
_EPISODES = f"""
WITH t AS (SELECT conv_id AS case_id, turn AS turn_index, {_KIND} AS kind FROM conversations),
n AS (SELECT *, count(*) OVER w AS turns, count(*) FILTER (kind = 'call') OVER w AS calls, count(*) FILTER (kind = 'invalid') OVER w AS invalid FROM t WINDOW w AS (PARTITION BY case_id ORDER BY turn_index ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, CASE WHEN turns > 4 THEN 'budget_exhausted' WHEN kind = 'answer' THEN 'completed' WHEN kind = 'invalid' AND invalid > 1 THEN 'budget_exhausted' WHEN kind = 'call' AND calls > 2 THEN 'budget_exhausted' END AS verdict FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN verdict IS NULL THEN 1 ELSE 0 END, CASE WHEN verdict IS NULL THEN -turn_index ELSE turn_index END) AS k FROM v)
SELECT case_id, coalesce(verdict, 'open') AS terminal_status, turn_index, least(turns, 4)::BIGINT AS turns_used, least(calls, 2)::BIGINT AS calls_used, least(invalid, 1)::BIGINT AS repairs_used FROM r WHERE k = 1
"""
_BITS = "list_filter(['search_records', 'get_record', 'calculate', 'lookup_status'], lambda t, i: ({} >> (i - 1)) & 1 = 1)"
_PROMPT_HEAD = "<reserved_0>\nReturn exactly one JSON object and no other text.\ndecision must be RESPOND, CALL_TOOL, ASK_CLARIFICATION, or REFUSE.\nanswerability must be SUPPORTED, UNSUPPORTED, CONFLICTING, INSUFFICIENT_CONTEXT, or NOT_APPLICABLE.\nRESPOND requires answer. CALL_TOOL requires tool_call with tool and arguments. ASK_CLARIFICATION requires question. REFUSE requires reason.\n\nMESSAGES\n"
_CODES = ("PARSE_ERROR", "PARSE_ERROR", "PARSE_ERROR", "OK", "UNKNOWN_FIELD", "INVALID_TOOL", "ARGUMENT_INVALID", "UNKNOWN_FIELD", "PARSE_ERROR", "PARSE_ERROR", "OK", "ARGUMENT_INVALID")

ORACLES = {
    "metric_report": _BASE + _METRICS,
    "run_summary": _BASE + """SELECT run_id, count(*) AS attempted_cases, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'invalid_response') AS invalid_responses,
      count(*) FILTER (status = 'timeout') AS timeouts, count(*) FILTER (status = 'execution_error') AS execution_errors, count(*) * 4 AS score_rows, count(*) AS expected_cases FROM a GROUP BY run_id""",
    "scores_long": _BASE + "SELECT case_id, metric_id, eligible, score AS value, missing_reason, labels AS failure_labels FROM s",
    "failure_rows": _BASE + "SELECT attempt_id, case_id, status, parse_error, runtime_error, failure_labels FROM w",
    "pilot_failure_rows": _BASE + "SELECT case_id, status, parse_error, runtime_error, failure_labels, expected_decision, observed_decision FROM w",
    "parse_codes": _BASE + "SELECT case_id, CASE pos % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END AS code, CASE pos % 12 WHEN 3 THEN 'RESPOND' WHEN 10 THEN 'CALL_TOOL' END AS decision FROM e",
    "resume_plan": _BASE + "SELECT case_id, pos, CASE WHEN pos % 3 = 0 THEN 'reuse' ELSE 'run' END AS action FROM e",
    "resume_rules": _BASE + """, o AS (SELECT case_id, CASE WHEN pos % 5 = 0 THEN 'x' ELSE family_id END AS family_id, run_id, pos FROM c WHERE pos % 4 = 0),
      p AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE pos % 8 = 0 UNION ALL SELECT 'no-' || case_id, family_id, run_id, pos FROM c WHERE pos % 9 = 0)
      SELECT case_id, 'other_run' AS rule FROM p WHERE run_id <> 'run-1' UNION ALL SELECT case_id, 'unknown_case' FROM p WHERE case_id NOT IN (SELECT case_id FROM c)
      UNION ALL SELECT p.case_id, 'other_family' FROM p JOIN c ON p.case_id = c.case_id WHERE p.family_id <> c.family_id UNION ALL SELECT case_id, 'repeated' FROM p GROUP BY case_id HAVING count(*) > 1""",
    "journal_states": _BASE + """SELECT case_id, CASE WHEN pos % 11 = 0 THEN 'unknown_case' WHEN pos % 2 = 0 AND (pos % 4 = 0 OR pos % 7 = 0) THEN 'reuse' WHEN pos % 4 = 0 OR pos % 7 = 0 THEN 'receipt_without_intent'
      WHEN pos % 2 = 0 THEN 'unresolved' ELSE 'run' END AS state FROM e WHERE pos % 11 <> 0 OR pos % 2 = 0 OR pos % 4 = 0 OR pos % 7 = 0""",
    "case_violations": """WITH m AS (SELECT conv_id, count(*) FILTER (role = 'user' AND conv_id % 10 <> 0) AS users FROM conversations WHERE conv_id % 10 <> 0 OR role <> 'user' GROUP BY conv_id)
      SELECT 'V01' AS rule, conv_id::VARCHAR AS key FROM m WHERE conv_id % 7 = 0 UNION ALL SELECT 'V02', conv_id::VARCHAR FROM m WHERE conv_id % 9 = 0 UNION ALL SELECT 'V03', conv_id::VARCHAR FROM m WHERE users = 0
      UNION ALL SELECT 'V04', conv_id::VARCHAR FROM m WHERE conv_id % 11 = 0 UNION ALL SELECT 'V05', conv_id::VARCHAR FROM m WHERE conv_id % 13 = 0 UNION ALL SELECT 'V06', conv_id::VARCHAR FROM m WHERE conv_id % 17 = 0
      UNION ALL SELECT 'V07', conv_id::VARCHAR FROM m WHERE conv_id % 19 = 0 UNION ALL SELECT 'V08', conv_id::VARCHAR FROM m WHERE conv_id % 23 = 0 AND conv_id % 19 <> 0 UNION ALL SELECT 'V09', conv_id::VARCHAR FROM m WHERE conv_id % 29 = 0""",
    "duplicate_keys": "SELECT 'V20' AS rule, sha256(text) AS key FROM documents GROUP BY 2 HAVING count(*) > 1",
    "permission_sets": _BASE + f""", q AS (SELECT case_id, {_BITS.format('k')} AS a, {_BITS.format('(k // 3)')} AS p FROM e)
      SELECT case_id, list_contains(p, 'search_records') AS search_records, list_contains(p, 'get_record') AS get_record, list_contains(p, 'calculate') AS calculate, list_contains(p, 'lookup_status') AS lookup_status,
      list_has_all(a, p) AS is_subset, list_has_all(a, p) AND list_has_all(p, a) AS is_equal, NOT list_has_any(a, p) AS is_unique FROM q""",
    "tool_search_topk": """WITH q AS (SELECT 's' || item_id::VARCHAR AS call_id, replace(lower(substr(text, 1, 12)), 'ß', 'ss') AS query, CASE WHEN item_id % 5 <> 0 THEN DATE '2024-01-01' + (item_id * 7 % 400)::INT END AS as_of, item_id % 10 + 1 AS n FROM benchmark),
      d AS (SELECT 'doc-' || doc_id::VARCHAR AS record_id, replace(lower(text), 'ß', 'ss') AS text, DATE '2024-01-01' + (doc_id % 365)::INT AS day FROM documents),
      h AS (SELECT call_id, n, record_id, row_number() OVER (PARTITION BY call_id ORDER BY day DESC, record_id DESC)::INT AS rank FROM q JOIN d ON contains(d.text, q.query) AND (as_of IS NULL OR day <= as_of))
      SELECT call_id, rank, record_id FROM h WHERE rank <= n""",
    "tool_get_first": _BASE + """, d AS (SELECT doc_id % 50 AS key, min(doc_id) AS pos, arg_min(length(text), doc_id)::BIGINT AS n FROM documents GROUP BY 1)
      SELECT case_id AS call_id, d.pos IS NOT NULL AS success, coalesce(d.pos, -1) AS pos, coalesce(n, -1)::BIGINT AS n_chars FROM e LEFT JOIN d ON e.k = d.key""",
    "tool_status": _BASE + """, o AS (SELECT o_orderkey, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1)
      SELECT case_id AS call_id, status, CASE WHEN o_orderkey IS NULL THEN 'NOT_FOUND' END AS error_code FROM e LEFT JOIN o ON e.pos * 3 = o_orderkey""",
    "tool_calculate": """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_extendedprice + l_discount WHEN 1 THEN l_extendedprice - l_discount WHEN 2 THEN l_extendedprice * l_discount WHEN 3 THEN CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END END AS result,
      CASE WHEN l_linenumber % 4 = 3 AND l_discount = 0 THEN 'ARGUMENT_INVALID' END AS error_code FROM lineitem""",
    "tool_fault_precedence": _BASE + f""", q AS (SELECT case_id, k, {_TOOL.format('k')} AS tool FROM e)
      SELECT case_id, tool, CASE WHEN k % 5 = 0 AND tool <> 'calculate' THEN 'INVALID_TOOL' WHEN k % 3 = 0 AND tool <> 'get_record' THEN 'PERMISSION_DENIED' WHEN tool = 'get_record' THEN 'TIMEOUT' WHEN tool = 'calculate' THEN 'MALFORMED_RESPONSE' END AS error_code FROM q""",
    "episode_terminal": _EPISODES,
    "episode_fold": f"SELECT case_id, terminal_status, turns_used, calls_used, repairs_used FROM ({_EPISODES})",
    "call_tracker": _BASE + """, q AS (SELECT family_id AS case_id, pos, row_number() OVER (PARTITION BY family_id, k % 2, event_type ORDER BY pos) > 1 AS stagnant, row_number() OVER (PARTITION BY family_id ORDER BY pos) AS n FROM e)
      SELECT case_id, pos, stagnant, CASE WHEN n > 6 THEN 'budget_exhausted' WHEN stagnant THEN 'stagnation' ELSE 'ok' END AS verdict FROM q""",
    "call_ids": _BASE + "SELECT pos AS turn_index, family_id || ':tool:' || (row_number() OVER (PARTITION BY family_id ORDER BY pos))::VARCHAR AS call_id FROM e",
    "event_sequence": _BASE + """SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos)::INT AS sequence, case_id, status, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS event_time_utc, 'attempt:' || run_id || ':' || case_id || ':1' AS artifact_ref FROM a""",
    "case_digests": _BASE + f"SELECT case_id, sha256({_JSON} || chr(10)) AS case_sha256, sha256({_JSON}) AS payload_sha256 FROM c",
    "dataset_digest": _BASE + f"SELECT run_id, sha256('[' || string_agg({_JSON}, ',' ORDER BY pos) || ']' || chr(10)) AS dataset_sha256, count(*) AS n_rows FROM c GROUP BY run_id",
    "checksum_diff": """SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 33 = 0 THEN 'missing' WHEN doc_id % 50 = 0 THEN 'unexpected' ELSE 'mismatch' END AS fault FROM documents
      WHERE (doc_id % 50 <> 0 OR doc_id % 33 <> 0) AND ((doc_id % 33 = 0) OR (doc_id % 50 = 0) OR (doc_id % 20 = 1))""",
    "run_comparison": _BASE + """, x AS (SELECT case_id, pos, status AS s0, CASE WHEN pos % 6 = 0 THEN 'timeout' ELSE status END AS s1 FROM a)
      SELECT case_id, 'row' AS field, CASE WHEN pos % 17 <> 0 THEN 'present' ELSE 'missing' END AS a, CASE WHEN pos % 13 <> 0 THEN 'present' ELSE 'missing' END AS b FROM x WHERE (pos % 17 = 0) <> (pos % 13 = 0)
      UNION ALL SELECT case_id, 'status', s0, s1 FROM x WHERE pos % 17 <> 0 AND pos % 13 <> 0 AND s0 <> s1""",
    "ordered_selection": _BASE + "SELECT case_id, -pos AS pos, family_id, true AS found FROM e WHERE k = 5 UNION ALL SELECT 'no-' || case_id, -pos, NULL, false FROM e WHERE k = 7",
    "shape_mismatch": """SELECT 't' || p_partkey::VARCHAR AS name, CASE WHEN p_partkey % 11 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'unexpected' ELSE 'shape' END AS fault FROM part
      WHERE (p_partkey % 7 <> 0 OR p_partkey % 11 <> 0) AND (p_partkey % 11 = 0 OR p_partkey % 7 = 0 OR p_partkey % 13 = 0)""",
    "prompt_text": f"""WITH m AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS said FROM conversations WHERE conv_id % 10 <> 0 OR role <> 'user' GROUP BY conv_id),
      p AS (SELECT conv_id, '{_PROMPT_HEAD}' || said || chr(10) || chr(10) || 'EVIDENCE' || chr(10) || CASE WHEN conv_id % 2 <> 0 THEN 'none' ELSE 'd1: fact' || chr(10) || CASE WHEN conv_id % 17 = 0 THEN 'd1' ELSE 'd2' END || ': fact' END || chr(10) || chr(10)
        || 'AVAILABLE_TOOLS=' || CASE WHEN conv_id % 11 = 0 THEN '["get_record", "get_record"]' ELSE '["get_record", "search_records"]' END || chr(10) || 'PERMITTED_TOOLS=' || CASE WHEN conv_id % 13 = 0 THEN '["calculate", "get_record"]' ELSE '["get_record"]' END
        || chr(10) || chr(10) || 'TOOL_RESULTS' || chr(10) || 'none' || chr(10) || '<reserved_1>' || chr(10) AS t FROM m)
      SELECT conv_id::VARCHAR AS case_id, sha256(t) AS prompt_sha256, length(t)::BIGINT AS n_chars FROM p""",
    "timing_csv": _BASE + """SELECT case_id, status AS attempt_status, CASE WHEN status = 'timeout' THEN 'timeout' ELSE 'completed' END AS transport_status, printf('%.6f', k / 8.0::DOUBLE) AS elapsed_seconds, CASE WHEN status = 'timeout' THEN '' ELSE printf('%.6f', k / 4.0::DOUBLE) END AS model_load_seconds,
      CASE WHEN status = 'completed' THEN printf('%.6f', k / 2.0::DOUBLE) ELSE '' END AS model_inference_seconds, k::VARCHAR AS input_token_count, '' AS output_token_count, CASE WHEN k % 2 = 0 THEN 'max_new_tokens' ELSE '' END AS stop_reason FROM a""",
    "report_table": _BASE + f""", m AS ({_METRICS})
      SELECT 1 AS part, '' AS key, '| metric | eligible | missing | estimate |' || chr(10) || '|---|---|---|---|' AS line UNION ALL SELECT 2, '', '| case | status | decision | labels |' || chr(10) || '|---|---|---|---|'
      UNION ALL SELECT 1, metric_id, '| ' || metric_id || ' | ' || eligible_instances || ' | ' || missing_instances || ' | ' || coalesce(printf('%.6f', estimate), '—') || ' |' FROM m
      UNION ALL SELECT 2, case_id, '| ' || case_id || ' | ' || status || ' | ' || coalesce(observed_decision, '—') || ' | ' || CASE WHEN failure_labels = '' THEN 'none' ELSE replace(failure_labels, ',', ', ') END || ' |' FROM w""",
}
