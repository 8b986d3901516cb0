"""The prompt of a case: fixed text around its messages, evidence, tools and tool results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt's wording, which digests of prompts depend on.
OPENING, CLOSING = "<reserved_0>", "<reserved_1>"
INSTRUCTIONS = (
    "Return exactly one JSON object and no other text.",
    "decision must be RESPOND, CALL_TOOL, ASK_CLARIFICATION, or REFUSE.",
    "answerability must be SUPPORTED, UNSUPPORTED, CONFLICTING, INSUFFICIENT_CONTEXT, or NOT_APPLICABLE.",
    "RESPOND requires answer. CALL_TOOL requires tool_call with tool and arguments. ASK_CLARIFICATION requires question. REFUSE requires reason.",
)
NONE = "none"


def name_list(names: Column) -> Column:
    """["a", "b"] with a space behind the comma."""
    return F.when(F.size(names) == 0, F.lit("[]")).otherwise(F.concat(F.lit('["'), F.array_join(names, '", "'), F.lit('"]')))


def lines_or_none(lines: Column) -> Column:
    return F.when(F.size(lines) == 0, F.lit(NONE)).otherwise(F.array_join(lines, "\n"))


def prompt(messages: Column, evidence: Column, available: Column, permitted: Column, results: Column | None = None) -> Column:
    """messages: array<struct<content, role>>; evidence: array<struct<content, document_id, ..>>; results: array of canonical JSON."""
    said = F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    known = F.transform(evidence, lambda d: F.concat(d["document_id"], F.lit(": "), d["content"]))
    tools = F.concat(F.lit("AVAILABLE_TOOLS="), name_list(available), F.lit("\nPERMITTED_TOOLS="), name_list(permitted))
    parts = [
        F.lit("\n".join((OPENING, *INSTRUCTIONS, "", "MESSAGES"))),
        F.array_join(said, "\n"),
        F.lit("\nEVIDENCE"),
        lines_or_none(known),
        F.concat(F.lit("\n"), tools),
        F.lit("\nTOOL_RESULTS"),
        lines_or_none(results) if results is not None else F.lit(NONE),
        F.lit(CLOSING + "\n"),
    ]
    return F.concat_ws("\n", *parts)
