"""Strict parsing of raw model outputs into typed decisions.

JSON syntax is that of a lenient decoder that no Spark parser matches (last of repeated keys wins, NaN is a number, nothing may follow the
document), so a row that isn't blank crosses to Python once, in Arrow batches, and comes back as plain JSON. Blank rows never cross. All else
is expressions over VARIANT, made from the tables of fields below: types, bounds, defaults, what lax fields take, unknown fields. A text that
breaks rules yields the first code of: any unknown field, an unknown tool, an error under the arguments, anything else. An unknown or missing
decision ends the descent at once."""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.schemas import ANSWERABILITIES, CLAIMS, FAILURE, OPERATIONS, RESPONSE, TOOL_CALL, TOOLS

PARSED = f"struct<response:{RESPONSE},failure:{FAILURE}>"
_SPACE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: What counts as white space around a text, as a class for Java patterns.
BLANK = rf"^[{_SPACE}]*$"

#: A check takes a variant to its value, null if it is wrong.
Check = Callable[[Column], Column]


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is made once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _is(v: Column, kind: str) -> Column:
    return _yes(F.schema_of_variant(v) == kind)


def _fields_of(v: Column) -> Column:
    """An object's fields, null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _items_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _text(least: int = 1, most: int | None = None) -> Check:
    fits = lambda s: (F.length(s) >= least) & (F.length(s) <= most) if most else F.length(s) >= least
    return lambda v: _let(F.when(_is(v, "STRING"), _string(v)), lambda s: F.when(fits(s), s))


def _one_of(*values: str) -> Check:
    return lambda v: _let(F.when(_is(v, "STRING"), _string(v)), lambda s: F.when(s.isin(*values), s))


def _as_double(v: Column, pattern: str, booleans: bool = True, strip: bool = True) -> Column:
    """A number, a boolean, or a text that spells a number as the pattern says; else null."""
    s = F.regexp_replace(_string(v), rf"^[{_SPACE}]+|[{_SPACE}]+\z", "") if strip else _string(v)
    spelled = _let(F.when(_is(v, "STRING"), s), lambda t: F.when(t.rlike(pattern), t.try_cast("double")))
    plain = F.schema_of_variant(v).rlike(r"^(BIGINT|DOUBLE|DECIMAL|BOOLEAN)" if booleans else r"^(BIGINT|DOUBLE|DECIMAL)")
    return _let(F.when(plain, F.try_variant_get(v, "$", "double")).otherwise(spelled), lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))


def _number(v: Column) -> Column:
    return _as_double(v, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z")


def _whole(least: int, most: int) -> Check:
    return lambda v: _let(_as_double(v, r"^[+-]?\d+(\.0*)?\z"), lambda x: F.when((x == F.floor(x)) & (x >= least) & (x <= most), x.try_cast("int")))


def _day(v: Column) -> Column:
    """An ISO day; a midnight of seconds since 1970 as a number or digits; a date and time at midnight."""

    def counted(x: Column) -> Column:
        days = F.when(x % 86400 == 0, F.floor(F.when(F.abs(x) > 2e10, x / 1000).otherwise(x) / 86400))
        return _let(days, lambda n: F.when(n.between(-719162, 2932896), F.date_add(F.lit("1970-01-01").cast("date"), n.try_cast("int")).cast("string")))

    def of(s: Column) -> Column:
        iso = s.rlike(r"^\d{4}-\d\d-\d\d([T ]00:00(:00(\.0+)?)?(Z|[+-]00:?00)?)?\z")
        named = _let(F.substring(s, 1, 10), lambda d: F.when(~d.startswith("0000") & d.try_cast("date").isNotNull(), d))
        number = F.when(s.isNull() | (F.length(s) != 8), _as_double(v, r"^[+-]?\d+(\.\d+)?\z", booleans=False, strip=False))
        return F.when(iso, named).otherwise(_let(number, counted))

    return _let(F.when(_is(v, "STRING"), _string(v)), of)


def _many(item: Check) -> Check:
    return lambda v: _let(F.transform(_items_of(v), item), lambda found: F.when(F.forall(found, lambda x: x.isNotNull()), found))


_REFS, _TEXTS = _many(_text()), "array<string>"
_REQUIRED = object()
# field: (check, default as (value, type)), null beside its check where null is right; _REQUIRED has no default
ARGUMENT_FIELDS: dict[str, dict] = {
    "search_records": {"query": (_text(1, 500), _REQUIRED), "as_of_date": (_day, (None, "string")), "limit": (_whole(1, 10), (5, "int"))},
    "get_record": {"record_id": (_text(), _REQUIRED)},
    "calculate": {"operation": (_one_of(*OPERATIONS), _REQUIRED), "left": (_number, _REQUIRED), "right": (_number, _REQUIRED)},
    "lookup_status": {"subject_id": (_text(), _REQUIRED)},
}
CLAIM_FIELDS = {"claim": (_text(), _REQUIRED), "evidence_refs": (_REFS, ([], _TEXTS))}
COMMON_FIELDS = {"schema_version": (_one_of("1.0"), ("1.0", "string")), "status": (_one_of("OK"), ("OK", "string")), "answerability": (_one_of(*ANSWERABILITIES), _REQUIRED)}
# claims and tool_call are looked at on their own
DECISION_FIELDS: dict[str, dict] = {
    "RESPOND": {"answer": (_text(), _REQUIRED), "claims": None, "citations": (_REFS, ([], _TEXTS))},
    "CALL_TOOL": {"tool_call": None},
    "ASK_CLARIFICATION": {"question": (_text(), _REQUIRED)},
    "REFUSE": {"reason": (_text(), _REQUIRED)},
}
_NULLABLE = ("as_of_date",)
_NAMES = ("answer", "answerability", "citations", "claims", "decision", "question", "reason", "schema_version", "status", "tool_call")
_ARGUMENTS = ("as_of_date", "left", "limit", "operation", "query", "record_id", "right", "subject_id")


def _field(m: Column, name: str, check: Check, default: object) -> Column:
    """struct<bad, value> of a field of an object."""
    there = F.map_contains_key(m, name)
    absent = None if default is _REQUIRED else (F.array() if default[0] == [] else F.lit(default[0])).cast(default[1])
    bad = lambda x: x.isNull() & ~_is(m[name], "VOID") if name in _NULLABLE else x.isNull()
    found = _let(check(m[name]), lambda x: F.struct(bad(x).alias("bad"), x.alias("value")))
    return F.when(there, found).otherwise(F.struct(F.lit(default is _REQUIRED).alias("bad"), (F.lit(None) if absent is None else absent).alias("value")))


def _unknown(m: Column, names: Column) -> Column:
    return _yes(F.size(F.array_except(F.map_keys(m), names)) > 0)


def _names(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _one_kind(kind: Column, m: Column, kinds: dict[str, dict]) -> Column:
    """A struct of the fields of all kinds, each struct<bad, value>: null but for those of the kind that it is."""
    return F.struct(*[F.when(kind == k, _field(m, name, *field)).alias(name) for k, own in kinds.items() for name, field in own.items() if field is not None])


def _any_bad(fields: Column, names: list[str]) -> Column:
    return F.exists(F.array(*[F.coalesce(fields[n]["bad"], F.lit(False)) for n in names]), lambda x: x)


def _claims(v: Column) -> Column:
    """struct<unknown, other, value> of claims."""

    def one(m: Column) -> Column:
        def told(f: Column) -> Column:
            return F.struct(_unknown(m, _names(*CLAIM_FIELDS)).alias("unknown"), (m.isNull() | _any_bad(f, list(CLAIM_FIELDS))).alias("other"), F.struct(*[f[n]["value"].alias(n) for n in CLAIM_FIELDS]).alias("value"))

        return _let(F.struct(*[_field(m, n, *CLAIM_FIELDS[n]).alias(n) for n in CLAIM_FIELDS]), told)

    whole = lambda c: F.struct(_yes(F.exists(c, lambda x: x["unknown"])).alias("unknown"), (c.isNull() | _yes(F.exists(c, lambda x: x["other"]))).alias("other"), F.transform(c, lambda x: x["value"]).alias("value"))
    return _let(F.transform(_items_of(v), lambda x: _let(_fields_of(x), one)), whole)


def _call(v: Column) -> Column:
    """struct<unknown, tool, argument, other, value> of a tool call: what is wrong with it ends the look at it where the contract says so."""
    names = [n for own in ARGUMENT_FIELDS.values() for n in own]
    known = F.create_map(*[x for t, own in ARGUMENT_FIELDS.items() for x in (F.lit(t), _names(*own))])

    def one(m: Column) -> Column:
        def called(tool: Column) -> Column:
            def told(a: Column) -> Column:
                def verdict(f: Column) -> Column:
                    lacking = m.isNull() | ~_yes(F.map_contains_key(m, "tool"))
                    wrong = ~lacking & tool.isNull()
                    right = tool.isNotNull()
                    call = F.struct(F.struct(*[f[n]["value"].alias(n) for n in _ARGUMENTS]).alias("arguments"), tool.alias("tool")).cast(TOOL_CALL)
                    more = right & (_unknown(m, _names("tool", "arguments")) | _unknown(a, known[tool]))
                    return F.struct(more.alias("unknown"), wrong.alias("tool"), (right & (a.isNull() | _any_bad(f, names))).alias("argument"), lacking.alias("other"), call.alias("value"))

                return _let(_one_kind(tool, a, ARGUMENT_FIELDS), verdict)

            return _let(_fields_of(m["arguments"]), told)

        return _let(_one_of(*TOOLS)(m["tool"]), called)

    return _let(_fields_of(v), one)


def _judged(m: Column) -> Column:
    """struct<response, code> of an object's fields; null if the decision is missing or unknown."""
    known = F.create_map(*[x for d, own in DECISION_FIELDS.items() for x in (F.lit(d), _names("decision", *COMMON_FIELDS, *own))])
    names = [*COMMON_FIELDS, *[n for own in DECISION_FIELDS.values() for n, f in own.items() if f is not None]]

    def decided(decision: Column) -> Column:
        own = _one_kind(decision, m, DECISION_FIELDS)
        claims = F.when((decision == "RESPOND") & F.map_contains_key(m, "claims"), _claims(m["claims"]))
        call = F.when(decision == "CALL_TOOL", _call(m["tool_call"]))
        common = F.struct(*[_field(m, n, *field).alias(n) for n, field in COMMON_FIELDS.items()])

        def verdict(x: Column) -> Column:
            claims, call, own, common = (x[n] for n in ("claims", "call", "own", "common"))
            bad = _any_bad(common, list(COMMON_FIELDS)) | _any_bad(own, [n for n in names if n not in COMMON_FIELDS])
            code = (
                F.when(_unknown(m, known[decision]) | _yes(claims["unknown"]) | _yes(call["unknown"]), "UNKNOWN_FIELD").when(_yes(call["tool"]), "INVALID_TOOL").when(_yes(call["argument"]), "ARGUMENT_INVALID")
                .when(bad | _yes(claims["other"]) | _yes(call["other"]), "PARSE_ERROR")
            )
            values = {n: (common if n in COMMON_FIELDS else own)[n]["value"] for n in names} | {"decision": decision, "tool_call": call["value"]}
            values["claims"] = F.when(decision == "RESPOND", F.coalesce(claims["value"], F.array().cast(CLAIMS)))
            response = F.struct(*[values[n].alias(n) for n in _NAMES]).cast(RESPONSE)
            return _let(code, lambda c: F.struct(F.when(c.isNull(), response).alias("response"), c.alias("code")))

        return F.when(decision.isNotNull(), _let(F.struct(claims.alias("claims"), call.alias("call"), own.alias("own"), common.alias("common")), verdict))

    return _let(_one_of(*DECISION_FIELDS)(m["decision"]), decided)


_NO_NUMBER: dict = {}


def _whole_number(s: str) -> object:
    x = int(s)
    if -(2**63) <= x < 2**63:
        return x
    try:
        return float(x)
    except OverflowError:
        return _NO_NUMBER


def _plain(raw: str) -> str:
    """JSON that any parser reads. A number that is none, or has no place in a double, becomes an object, which is wrong wherever a number is."""
    found = json.loads(raw, parse_constant=lambda _: _NO_NUMBER, parse_int=_whole_number, parse_float=lambda s: x if math.isfinite(x := float(s)) else _NO_NUMBER)
    found = None if found is _NO_NUMBER else found
    return json.dumps(found, ensure_ascii=False).encode("utf-8", "replace").decode()


def _syntax(raw: pd.Series) -> pd.DataFrame:
    out = []
    for text in raw:
        try:
            out.append((None, None) if text is None else (_plain(text), None))
        except (ValueError, RecursionError) as e:
            out.append((None, f"The output is not JSON: {getattr(e, 'msg', 'nested too deep')}"))
    return pd.DataFrame(out, columns=["json", "fault"], dtype=object)


def is_blank(raw: Column) -> Column:
    return raw.rlike(BLANK)


def read_json(raw: Column) -> Column:
    """struct<json, fault>: the text as plain JSON, or what is wrong with its syntax. Blank texts don't cross to Python."""
    return F.pandas_udf(_syntax, "struct<json:string,fault:string>")(F.when(~is_blank(raw), raw))


def parse_response(raw: Column, read: Column) -> Column:
    """struct<response, failure>: exactly one is set; null for a null text. read: a column that holds read_json(raw)."""
    blank = is_blank(raw)

    def whole(m: Column) -> Column:
        return F.struct(m.isNotNull().alias("object"), F.when(m.isNotNull(), _judged(m)).alias("judged"))

    def verdict(x: Column) -> Column:
        code = x["judged"]["code"]
        message = F.when(blank, "The output is blank.").when(read["fault"].isNotNull(), read["fault"]).when(~x["object"], "The output is JSON but not an object.").when(x["judged"].isNull(), "The decision is missing or unknown.").when(code.isNotNull(), "The output breaks the response contract.")
        failure = F.when(message.isNotNull(), F.struct(F.when(blank | code.isNull(), "PARSE_ERROR").otherwise(code).alias("code"), message.alias("message")))
        return F.when(raw.isNotNull(), F.struct(x["judged"]["response"].alias("response"), failure.alias("failure")).cast(PARSED))

    # not taken apart and put together here: the optimizer would then make it anew for each field that is asked for
    return _let(_let(_fields_of(F.try_parse_json(read["json"])), whole), verdict)


@functools.lru_cache(maxsize=1)
def _parser(context: SparkContext) -> Column:
    """parse_response() of the columns __text and __read: a large expression, so it is made once."""
    return parse_response(F.col("__text"), F.col("__read"))


def with_response(df: DataFrame, raw: Column, name: str) -> DataFrame:
    """df with the parsed text as a column; two steps, as Python can't be called within expressions that name a value twice."""
    return df.select("*", raw.alias("__text"), read_json(raw).alias("__read")).withColumn(name, _parser(df.sparkSession.sparkContext)).drop("__text", "__read")
