"""The response contract as a loop over Python values: what the expressions of gradewell.functions.response are held against."""

from __future__ import annotations

import datetime
import json
import math
import re
from collections.abc import Callable

from gradewell.schemas import ANSWERABILITIES, OPERATIONS, TOOLS

_BAD = object()
Check = Callable[[object], object]


def _text(least: int = 1, most: float = math.inf) -> Check:
    return lambda x: x if isinstance(x, str) and least <= len(x) <= most else _BAD


def _one_of(*values: str) -> Check:
    return lambda x: x if isinstance(x, str) and x in values else _BAD


def _number(x: object) -> object:
    if isinstance(x, str):
        try:
            x = float(x.strip().replace("_", "x"))
        except ValueError:
            return _BAD
    if not isinstance(x, (int, float)):
        return _BAD
    try:
        x = float(x)
    except OverflowError:
        return _BAD
    return x if math.isfinite(x) else _BAD


def _whole(least: int, most: int) -> Check:
    def check(x: object) -> object:
        if isinstance(x, str):
            x = x.strip()
            if not re.fullmatch(r"[+-]?\d+(\.0*)?", x, re.ASCII):
                return _BAD
            x = int(x.partition(".")[0])
        if isinstance(x, float):
            if not math.isfinite(x) or x != int(x):
                return _BAD
            x = int(x)
        return int(x) if isinstance(x, int) and least <= x <= most else _BAD

    return check


def _day(x: object) -> object:
    """An ISO day; a midnight of seconds since 1970 as a number or digits; a date and time at midnight."""
    if x is None:
        return None
    if isinstance(x, str):
        if re.fullmatch(r"\d{4}-\d\d-\d\d", x, re.ASCII):
            try:
                return datetime.date.fromisoformat(x).isoformat()
            except ValueError:
                return _BAD
        if m := re.fullmatch(r"(\d{4}-\d\d-\d\d)[T ]00:00(:00(\.0+)?)?(Z|[+-]00:?00)?", x, re.ASCII):
            return _day(m[1])
        if not re.fullmatch(r"[+-]?\d+(\.\d+)?", x, re.ASCII) or len(x) == 8:
            return _BAD
        x = float(x)
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x % 86400:
        return _BAD
    if abs(x) > 2e10:
        x /= 1000
    try:
        return (datetime.date(1970, 1, 1) + datetime.timedelta(days=x / 86400)).isoformat()
    except OverflowError:
        return _BAD


def _many(item: Check) -> Check:
    def check(x: object) -> object:
        if not isinstance(x, list):
            return _BAD
        out = [item(v) for v in x]
        return _BAD if any(v is _BAD for v in out) else out

    return check


_REFS = _many(_text())
_REQUIRED = object()
# field: (check, default); _REQUIRED has none
ARGUMENT_FIELDS = {
    "search_records": {"query": (_text(1, 500), _REQUIRED), "as_of_date": (_day, None), "limit": (_whole(1, 10), 5)},
    "get_record": {"record_id": (_text(), _REQUIRED)},
    "calculate": {"operation": (_one_of(*OPERATIONS), _REQUIRED), "left": (_number, _REQUIRED), "right": (_number, _REQUIRED)},
    "lookup_status": {"subject_id": (_text(), _REQUIRED)},
}
_COMMON = {"schema_version": (_one_of("1.0"), "1.0"), "status": (_one_of("OK"), "OK"), "answerability": (_one_of(*ANSWERABILITIES), _REQUIRED)}
DECISION_FIELDS = {
    "RESPOND": {"answer": (_text(), _REQUIRED), "claims": (None, []), "citations": (_REFS, [])},
    "CALL_TOOL": {"tool_call": (None, _REQUIRED)},
    "ASK_CLARIFICATION": {"question": (_text(), _REQUIRED)},
    "REFUSE": {"reason": (_text(), _REQUIRED)},
}


class _Faults:
    """What was found wrong, by the rank of its code."""

    def __init__(self) -> None:
        self.unknown = self.tool = self.argument = self.other = False

    @property
    def code(self) -> str | None:
        return "UNKNOWN_FIELD" if self.unknown else "INVALID_TOOL" if self.tool else "ARGUMENT_INVALID" if self.argument else "PARSE_ERROR" if self.other else None

    def fields(self, found: dict, wanted: dict, kind: str) -> dict:
        out = {}
        self.unknown |= bool(found.keys() - wanted.keys() - ({"decision"} if kind == "other" else set()))
        for name, (check, default) in wanted.items():
            if check is None:
                continue
            value = check(found[name]) if name in found else default
            if value is _BAD or value is _REQUIRED:
                setattr(self, kind, True)
            else:
                out[name] = value
        return out

    def claims(self, found: object) -> list | None:
        if not isinstance(found, list):
            self.other = True
            return None
        out = []
        for item in found:
            if not isinstance(item, dict):
                self.other = True
                continue
            inner = _Faults()
            out.append(inner.fields(item, {"claim": (_text(), _REQUIRED), "evidence_refs": (_REFS, [])}, "inner"))
            self.unknown |= inner.unknown
            self.other |= getattr(inner, "inner", False)
        return out

    def call(self, found: object) -> dict | None:
        if not isinstance(found, dict) or "tool" not in found:
            self.other = True
            return None
        if not isinstance(found["tool"], str) or found["tool"] not in TOOLS:
            self.tool = True
            return None
        self.unknown |= bool(found.keys() - {"tool", "arguments"})
        if not isinstance(found.get("arguments"), dict):
            self.argument = True
            return None
        return {"tool": found["tool"], "arguments": self.fields(found["arguments"], ARGUMENT_FIELDS[found["tool"]], "argument")}


def parse_text(raw: str) -> tuple[dict | None, str | None, str | None]:
    """(response, code, message); a message is for people and not part of the contract."""
    if not raw.strip():
        return None, "PARSE_ERROR", "The output is blank."
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError) as e:
        return None, "PARSE_ERROR", f"The output is not JSON: {getattr(e, 'msg', 'nested too deep')}"
    if not isinstance(found, dict):
        return None, "PARSE_ERROR", "The output is JSON but not an object."
    decision = found.get("decision")
    if not isinstance(decision, str) or decision not in DECISION_FIELDS:
        return None, "PARSE_ERROR", "The decision is missing or unknown."
    faults = _Faults()
    wanted = _COMMON | DECISION_FIELDS[decision]
    out = {"decision": decision} | faults.fields(found, wanted, "other")
    if decision == "RESPOND":
        out["claims"] = faults.claims(found["claims"]) if "claims" in found else []
    if decision == "CALL_TOOL":
        out["tool_call"] = faults.call(found.get("tool_call"))
    if faults.code:
        return None, faults.code, "The output breaks the response contract."
    return out, None, None
