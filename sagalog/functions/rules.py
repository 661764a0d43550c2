"""JSON schema documents compiled to column expressions.

A narrow subset: strict rejection of unknown fields, required fields, type,
enum of strings, inclusive bounds; top level only.  The first violation is
reported: an input that is no object, then unknown fields, then missing ones,
then field by field type, enum, bounds; within each step by field name.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quoted number satisfies "number" and "integer".
QUOTED_NUMBERS = True
VIOLATION = "struct<field:string,type:string,valid_fields:array<string>,message:string>"
NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
INTEGER = r"^-?(0|[1-9][0-9]*)$"


@dataclass(frozen=True)
class Rule:
    type: str = ""
    minimum: float | None = None
    maximum: float | None = None
    enum: tuple[str, ...] = ()


@dataclass(frozen=True)
class Schema:
    rules: dict[str, Rule] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    strict: bool = False

    @property
    def fields(self) -> list[str]:
        return sorted(self.rules)


def _number(value) -> float | None:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise ValueError("bound is no number")
    return float(value)


def _rule(doc) -> Rule:
    """A definition that can't be read leaves the field declared and unconstrained."""
    try:
        kind = doc.get("type") or ""
        if not isinstance(kind, str):
            return Rule()
        enum = doc.get("enum") or []
        texts = tuple(enum) if isinstance(enum, list) and all(isinstance(x, str) for x in enum) else ()
        return Rule(kind, _number(doc.get("minimum")), _number(doc.get("maximum")), texts)
    except (AttributeError, ValueError):
        return Rule()


def parse_schema(text: str | bytes | None) -> Schema:
    """Compile a schema document; an empty one accepts everything."""
    if not text:
        return Schema()
    doc = json.loads(text)
    rules = {name: _rule(x) for name, x in (doc.get("properties") or {}).items()}
    return Schema(rules, tuple(sorted(doc.get("required") or ())), doc.get("additionalProperties") is False)


def bound_text(x: float) -> str:
    return str(int(x)) if x == int(x) else f"{x:g}"


def _violation(message: Column, name: Column | None = None, kind: str | None = None, valid: list[str] | None = None) -> Column:
    return F.struct(
        (F.lit(None).cast("string") if name is None else name).alias("field"),
        F.lit(kind).cast("string").alias("type"),
        (F.lit(None) if valid is None else F.array(*[F.lit(v) for v in valid])).cast("array<string>").alias("valid_fields"),
        message.alias("message"),
    ).cast(VIOLATION)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))


def violation(content: Column, schema: Schema, context: str) -> Column:
    """The first violation of ``content`` against ``schema``, or null.

    Null, empty and ``null`` contents count as ``{}``.  Duplicate keys and
    malformed JSON are no object.  Values are shown in canonical form.
    """
    raw = F.when(content.isNull() | content.isin("", "null"), F.lit("{}")).otherwise(content)
    # parsed once a row, whatever the number of branches that look at it
    return _let(F.struct(F.json_object_keys(raw).alias("keys"), F.try_parse_json(raw).alias("doc")), lambda it: _first_violation(it["keys"], it["doc"], schema, context))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _first_violation(keys: Column, doc: Column, schema: Schema, context: str) -> Column:
    where = F.lit(f" in input for {context}")
    steps = [F.when(keys.isNull() | doc.isNull(), _violation(F.lit(f"input for {context} must be a JSON object")))]
    valid = schema.fields
    listed = ", ".join(valid)
    if schema.strict:
        unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(v) for v in valid]).cast("array<string>")))
        steps.append(F.when(F.size(unknown) > 0, _violation(F.concat(F.lit("unknown field "), _quoted(unknown[0]), where, F.lit(f". Valid fields: [{listed}]")), unknown[0], None, valid)))
    if schema.required:
        missing = F.array_sort(F.array_except(F.array(*[F.lit(v) for v in schema.required]), keys))
        steps.append(F.when(F.size(missing) > 0, _violation(F.concat(F.lit("required field "), _quoted(missing[0]), F.lit(" missing"), where), missing[0], None, valid)))
    for name in valid:
        rule = schema.rules[name]
        if rule.type:
            steps.append(F.when(F.array_contains(keys, name), _field_violation(doc, name, rule, context)))
    return F.coalesce(*steps)


def _field_violation(doc: Column, name: str, rule: Rule, context: str) -> Column:
    path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    found = F.struct(F.schema_of_variant(F.try_variant_get(doc, path, "variant")).alias("kind"), F.try_variant_get(doc, path, "string").alias("text"))
    return _let(found, lambda it: _checked(it["kind"], it["text"], name, rule, context))


def _checked(kind: Column, text: Column, name: str, rule: Rule, context: str) -> Column:
    null = kind.isNull() | (kind == "VOID")
    is_text, is_flag = kind == "STRING", kind == "BOOLEAN"
    is_object, is_array = kind.startswith("OBJECT"), kind.startswith("ARRAY")
    numeric = ~(null | is_text | is_flag | is_object | is_array)
    label = F.when(null, "null").when(is_text, "string").when(is_flag, "boolean").when(is_object, "object").when(is_array, "array").otherwise("number")
    quoted_number = is_text & text.rlike(NUMBER) if QUOTED_NUMBERS else F.lit(False)

    def said(message: Column, allowed: list[str] | None = None) -> Column:
        return _violation(F.concat(F.lit(f'field "{name}" in input for {context}: '), message), F.lit(name), rule.type, allowed)

    wrong = F.concat(F.lit(f"expected {rule.type}, got "), label)
    checks: list[Column] = []
    if rule.type == "string":
        checks.append(F.when(~(null | is_text), said(wrong)))
    elif rule.type == "boolean":
        checks.append(F.when(~(null | is_flag), said(wrong)))
    elif rule.type == "object":
        checks.append(F.when(~(null | is_object), said(wrong)))
    elif rule.type == "array":
        checks.append(F.when(~(null | is_array), said(wrong)))
    elif rule.type == "number":
        checks.append(F.when(~(null | numeric | quoted_number), said(wrong)))
    elif rule.type == "integer":
        checks.append(F.when(~(null | numeric | quoted_number), said(wrong)))
        whole = (kind == "BIGINT") | (quoted_number & text.rlike(INTEGER) & text.try_cast("bigint").isNotNull())
        checks.append(F.when(~F.coalesce(whole, F.lit(False)), said(F.concat(F.lit("expected integer, got "), F.when(null, "").otherwise(text), F.lit(" ("), label, F.lit(")")))))
    if rule.enum and rule.type == "string":
        allowed = sorted(rule.enum)
        shown = F.when(null, "").otherwise(text)
        checks.append(F.when(~shown.isin(*allowed), said(F.concat(F.lit("value "), _quoted(shown), F.lit(f" not in enum [{', '.join(allowed)}]")), allowed)))
    if rule.type in ("number", "integer") and (rule.minimum is not None or rule.maximum is not None):
        number = text.try_cast("double")
        shown = F.concat(F.lit("value "), F.when(null, "").otherwise(text))
        checks.append(F.when(null | number.isNull() | (F.abs(number) == float("inf")), said(F.concat(shown, F.lit(" is outside the representable numeric range")))))
        if rule.minimum is not None:
            checks.append(F.when(number < rule.minimum, said(F.concat(shown, F.lit(f" is below minimum {bound_text(rule.minimum)}")))))
        if rule.maximum is not None:
            checks.append(F.when(number > rule.maximum, said(F.concat(shown, F.lit(f" is above maximum {bound_text(rule.maximum)}")))))
    return F.coalesce(*checks) if checks else F.lit(None).cast(VIOLATION)
