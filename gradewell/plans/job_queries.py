"""The jobs as queries: each runs its job twice into a new folder and returns what stands there after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gradewell.plans.oracles import _PROMPT_HEAD
from gradewell.sources.places import shared_folder
from jobs import build_cases, score_outputs
from jobs.common import config


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/gradewell-{name}-{uuid.uuid4().hex}"


def job1_build_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job1")
    for _ in range(2):
        build_cases.run(spark, config("build_cases"), f"{sf_dir}/conversations.parquet", f"{sf_dir}/documents.parquet", out)
    return build_cases.published(spark, out)


def job2_score_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job2")
    for _ in range(2):  # as a pattern, as the table may be one file
        score_outputs.run(spark, config("score_outputs"), f"{sf_dir}/conversations.parque[t]", f"{out}/out", f"{out}/checkpoint")
    return score_outputs.published(spark, f"{out}/out")


JOBS = {f.__name__: f for f in (job1_build_cases, job2_score_outputs)}

JOB_SQL = {
    "job1_build_cases": f"""
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
m AS (SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS said, arg_min(coalesce(text, ''), turn) FILTER (role = 'user') AS question FROM conversations WHERE conv_id IN (SELECT conv_id FROM n WHERE n <= 64) GROUP BY conv_id),
p AS (SELECT m.conv_id, 'conv-' || m.conv_id AS case_id, question, d.lang, sha256(coalesce(question, '')) AS family_id, '{_PROMPT_HEAD}' || said || chr(10) || chr(10) || 'EVIDENCE' || chr(10)
    || CASE WHEN d.text IS NULL AND d.lang IS NULL THEN 'none' ELSE 'doc-' || m.conv_id || ': ' || coalesce(d.text, '') END || chr(10) || chr(10) || 'AVAILABLE_TOOLS=["search_records", "get_record"]' || chr(10) || 'PERMITTED_TOOLS=["get_record"]'
    || chr(10) || chr(10) || 'TOOL_RESULTS' || chr(10) || 'none' || chr(10) || '<reserved_1>' || chr(10) AS prompt FROM m LEFT JOIN documents d ON m.conv_id = d.doc_id),
b AS (SELECT case_id, 'V02' AS rule FROM p WHERE lang IS NULL UNION ALL SELECT case_id, 'V03' FROM p WHERE question IS NULL UNION ALL SELECT case_id, 'prompt_chars' FROM p WHERE length(prompt) > 20000),
g AS (SELECT *, sha256(prompt) AS sha, CASE WHEN substr(family_id, 1, 1) IN ('0', '1', '2', '3') THEN 'test' ELSE 'development' END AS split, row_number() OVER (PARTITION BY sha256(prompt) ORDER BY conv_id) AS k FROM p WHERE case_id NOT IN (SELECT case_id FROM b))
SELECT 'case' AS kind, case_id AS name, split AS label, length(prompt)::BIGINT AS n, sha AS sha256 FROM g WHERE k = 1
UNION ALL SELECT 'rejected', case_id, rule, NULL, NULL FROM b
UNION ALL SELECT 'rejected', 'conv-' || conv_id, 'turns', NULL, NULL FROM n WHERE n > 64
UNION ALL SELECT 'rejected', case_id, 'duplicate', NULL, NULL FROM g WHERE k > 1
UNION ALL SELECT 'digest', substr(sha, 1, 1), split, count(*), sha256('[' || string_agg('{{"case_id":"' || case_id || '","prompt_sha256":"' || sha || '"}}', ',' ORDER BY conv_id) || ']' || chr(10)) FROM g WHERE k = 1 GROUP BY split, substr(sha, 1, 1)
""",
    "job2_score_outputs": """
WITH o AS (SELECT conv_id || '-' || turn AS case_id, 'run-' || (conv_id % 4) AS run_id, CASE conv_id % 3 WHEN 0 THEN 'CALL_TOOL' WHEN 1 THEN 'REFUSE' ELSE 'RESPOND' END AS want, conv_id % 2 = 0 AS supported,
  CASE WHEN conv_id % 11 = 0 THEN 'TIMEOUT' WHEN conv_id % 13 = 0 THEN 'CONTEXT_OVERFLOW' WHEN turn % 4 = 3 AND text IS NULL THEN 'EXECUTION_ERROR' END AS code, turn % 4 = 3 OR coalesce(text, '') = '' AS odd
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL),
a AS (SELECT *, CASE WHEN code = 'TIMEOUT' THEN 'timeout' WHEN code IS NOT NULL THEN 'execution_error' WHEN odd THEN 'invalid_response' ELSE 'completed' END AS status,
  CASE WHEN code = 'TIMEOUT' THEN 'timeout' WHEN code = 'CONTEXT_OVERFLOW' THEN 'overflow' WHEN code IS NOT NULL THEN 'incomplete_run' WHEN odd THEN 'parser_failure,invalid_schema' ELSE '' END AS attempt FROM o),
l AS (SELECT *, status = 'completed' AS done, code IS NOT NULL AS runtime, 'runtime_' || lower(code) AS reason, CASE WHEN status <> 'completed' THEN attempt WHEN want = 'CALL_TOOL' THEN 'missed_call' ELSE '' END AS action FROM a),
s AS (SELECT run_id, 'action_correct' AS metric_id, case_id, status, true AS eligible, CASE WHEN done AND want = 'RESPOND' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value, NULL::VARCHAR AS missing_reason, action AS labels FROM l
  UNION ALL SELECT run_id, 'answerability_correct', case_id, status, true, CASE WHEN done AND supported THEN 1.0 ELSE 0.0 END, NULL, CASE WHEN NOT done THEN attempt WHEN supported THEN '' ELSE 'wrong_answerability' END FROM l
  UNION ALL SELECT run_id, 'schema_valid', case_id, status, NOT runtime, CASE WHEN runtime THEN NULL WHEN done THEN 1.0 ELSE 0.0 END, reason, attempt FROM l
  UNION ALL SELECT run_id, 'tool_identity_correct', case_id, status, want = 'CALL_TOOL' AND NOT runtime, CASE WHEN want = 'CALL_TOOL' AND NOT runtime THEN 0.0 END, CASE WHEN want <> 'CALL_TOOL' THEN 'not_tool_required' ELSE reason END, CASE WHEN want = 'CALL_TOOL' THEN action ELSE '' END FROM l)
SELECT *, 1::BIGINT AS n FROM s
UNION ALL SELECT run_id, metric_id, NULL, NULL, NULL, avg(CASE WHEN eligible THEN value END), NULL, NULL, count(CASE WHEN eligible THEN value END) FROM s GROUP BY run_id, metric_id
""",
}
