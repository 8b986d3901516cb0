"""Enumerations and Spark schemas (DDL) of the data model."""

from __future__ import annotations

# Names that data files hold.
DECISIONS = ("RESPOND", "CALL_TOOL", "ASK_CLARIFICATION", "REFUSE")
ANSWERABILITIES = ("SUPPORTED", "UNSUPPORTED", "CONFLICTING", "INSUFFICIENT_CONTEXT", "NOT_APPLICABLE")
TOOLS = ("search_records", "get_record", "calculate", "lookup_status")
OPERATIONS = ("add", "subtract", "multiply", "divide")
TOOL_ERROR_CODES = (
    "PARSE_ERROR", "UNKNOWN_FIELD", "INVALID_TOOL", "ARGUMENT_INVALID", "CONTEXT_OVERFLOW", "BUDGET_EXHAUSTED",
    "PERMISSION_DENIED", "NOT_FOUND", "TIMEOUT", "MALFORMED_RESPONSE", "STALE_DATA", "STAGNATION",
)
ATTEMPT_STATUSES = ("completed", "invalid_response", "timeout", "execution_error")
ATTEMPT_ERROR_CODES = ("PARSE_ERROR", "UNKNOWN_FIELD", "INVALID_TOOL", "ARGUMENT_INVALID", "CONTEXT_OVERFLOW", "BUDGET_EXHAUSTED", "TIMEOUT", "EXECUTION_ERROR")
TRANSPORT_STATUSES = ("completed", "timeout", "execution_error")
EPISODE_STATUSES = ("completed", "invalid_response", "budget_exhausted", "stagnation")
ROLES = ("system", "user", "assistant", "tool")
ACTORS = ("model", "tool", "runtime")
TURN_KINDS = ("generation", "format_repair")
SPLIT = "development_pilot"
METRICS = ("action_correct", "answerability_correct", "schema_valid", "tool_identity_correct")
FAILURE_LABELS = (
    "extrinsic_claim", "ignored_evidence", "wrong_span", "partial_support", "wrong_answerability", "conflict_error", "citation_mismatch", "memory_override",
    "missed_call", "unnecessary_call", "wrong_tool", "wrong_argument", "invalid_schema", "missing_clarification", "loop", "ignored_result",
    "false_refusal", "unsafe_compliance", "inconsistent_handling", "excessive_disclaimer", "benign_misclassification",
    "decision_flip", "implausible_code_switching", "entity_corruption", "register_error", "semantic_translation_loss", "language_drift",
    "overflow", "timeout", "oom", "numerical_error", "corrupted_artifact", "parser_failure", "incomplete_run",
    "conversion_mismatch", "quantization_policy_shift", "language_regression", "memory_overrun", "unstable_latency",
)

# Fields stand in alphabetical order, so to_json() writes canonical JSON.
ARGUMENTS = "struct<as_of_date:string,left:double,limit:int,operation:string,query:string,record_id:string,right:double,subject_id:string>"
TOOL_CALL = f"struct<arguments:{ARGUMENTS},tool:string>"
CLAIMS = "array<struct<claim:string,evidence_refs:array<string>>>"
GOLD = f"struct<case_id:string,expected_answerability:string,expected_claims:{CLAIMS},expected_decision:string,expected_tool_call:{TOOL_CALL},permitted_tools:array<string>,rubric:string,schema_version:string>"
INPUT = (
    "struct<available_tools:array<string>,case_id:string,evaluation_time_utc:string,"
    "evidence:array<struct<authoritative:boolean,content:string,document_id:string,observed_at_utc:string,version:string>>,"
    "family_id:string,languages:array<string>,messages:array<struct<content:string,role:string>>,permitted_tools:array<string>,schema_version:string>"
)
CASE = f"gold:{GOLD},input:{INPUT},license:string, provenance:string,review_status:string,schema_version:string,source:string,split:string"
RESPONSE = f"struct<answer:string,answerability:string,citations:array<string>,claims:{CLAIMS},decision:string,question:string,reason:string,schema_version:string,status:string,tool_call:{TOOL_CALL}>"
FAILURE = "struct<code:string,message:string>"
ATTEMPT = f"attempt_id string, case_id string, family_id string, parse_failure {FAILURE}, parsed_response {RESPONSE}, raw_output string, run_id string, runtime_error_code string, schema_version string, status string"
OBSERVATION = (
    "struct<attention_mode:string,case_id:string,completed_at_utc:string,elapsed_seconds:double,generated_ids:array<int>,input_ids:array<int>,input_token_count:bigint,"
    "model_inference_seconds:double,model_load_seconds:double,output_token_count:bigint,parameter_dtype:string,prompt_sha256:string,runtime_device:string,schema_version:string,"
    "started_at_utc:string,stop_reason:string,transport_status:string,worker_returncode:int>"
)
INTENT = "case_id string, case_sha256 string, family_id string, identity_sha256 string, implementation_commit string, protocol_sha256 string, run_id string, schema_version string, started_at_utc string"
RECEIPT = f"attempt struct<{ATTEMPT}>, case_sha256 string, diagnostics struct<case_id:string,schema_version:string,worker_stderr:string,worker_stdout:string>, implementation_commit string, observation {OBSERVATION}, protocol_sha256 string, run_id string, schema_version string"
SCORE = (
    "attempt_status string, case_id string, dataset_hash string, eligible boolean, evidence_refs array<string>, failure_labels array<string>, family_id string, metric_id string, missing_reason string,"
    "model_identity_hash string, review_status string, run_id string, schema_version string, scorer_version string, value double"
)
TURN = f"case_id string, turn_index int, kind string, raw_output string, response {RESPONSE}, parse_failure {FAILURE}"
EVENT = "action string, actor string, artifact_ref string, case_id string, elapsed_seconds double, event_time_utc string, sequence int, status string"
RECORD = "case_id string, pos int, record_id string, text string, observed_at date, authoritative boolean"
STATUS = "case_id string, pos int, subject_id string, status string, observed_at date"
FAULT = "case_id string, pos int, tool string, error_code string"

CONTRACTS = {"case": CASE, "attempt": ATTEMPT, "intent": INTENT, "receipt": RECEIPT, "score": SCORE, "turn": TURN, "event": EVENT, "record": RECORD, "status": STATUS, "fault": FAULT}
