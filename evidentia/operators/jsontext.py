"""JSON found in free text, trace payloads and error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions import text as tx

# Fixed value: a fenced JSON object.
FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def json_blob(text: Column) -> Column:
    """The first fenced object, else the outermost braces, else the trimmed text."""
    t = tx.strip(text)
    first = F.instr(t, "{")
    last = F.length(t) - F.instr(F.reverse(t), "}") + 1
    outer = F.when((first > 0) & F.contains(t, F.lit("}")) & (last > first), F.substring(t, first, last - first + 1)).otherwise(t)
    fenced = F.regexp_extract(t, FENCE, 1)
    return F.when(t.rlike(FENCE), fenced).otherwise(outer)


def json_verdict(text: Column, schema: str, required: list[str]) -> Column:
    """empty_response, invalid_json, structured_parse_failure, schema_validation_failure or ok."""
    blob = json_blob(text)
    parsed = F.from_json(blob, schema, {"mode": "PERMISSIVE"})
    complete = F.lit(True)
    for name in required:
        complete = complete & parsed.getField(name).isNotNull()
    return (
        F.when(text.isNull() | text.rlike(r"^\s*$"), "empty_response")
        .when(F.try_parse_json(blob).isNull(), "invalid_json")
        .when(~blob.rlike(r"^\s*\{"), "structured_parse_failure")
        .when(~complete, "schema_validation_failure")
        .otherwise("ok")
    )


def http_error_class(status: Column, message: Column) -> Column:
    """Authentication errors are final, everything else may be retried."""
    auth = status.isin(401, 403) | message.rlike(r"\b(401|403)\b")
    known = (status == 429) | status.between(500, 599) | message.rlike(r"\b(429|5[0-9]{2})\b")
    return F.when(auth, "auth").when(known, "transient").otherwise("unknown_transient")


def failure_category(name: Column, message: Column, cause: Column) -> Column:
    """Stable category of a failed proposal call."""
    m = F.lower(message)
    return (
        F.when(name == "MaxRetriesExceeded",
               F.when(F.contains(F.lower(F.coalesce(cause, F.lit(""))), F.lit("timeout")), "provider_timeout")
               .otherwise("provider_failure"))
        .when(F.contains(m, F.lit("timeout")), "provider_timeout")
        .when(name.isin("RetryableError", "AuthError", "ConnectionError", "TimeoutError"), "provider_failure")
        .when(name == "SchemaValidationError",
              F.when(F.contains(m, F.lit("empty response")), "empty_response")
              .when(F.contains(m, F.lit("invalid json")), "invalid_json")
              .when(F.contains(m, F.lit("schema mismatch")), "schema_validation_failure")
              .otherwise("structured_parse_failure"))
        .otherwise("internal_error")
    )


def field_text(parsed: Column, key: str) -> Column:
    """A field of a parsed payload (a VARIANT), so several fields cost one parse."""
    return F.try_variant_get(parsed, f"$.{key}", "string")


def field_int(parsed: Column, key: str) -> Column:
    """An integer field; null when it is absent or of another type."""
    value = field_text(parsed, key)
    return F.when(value.rlike(r"^-?\d+$"), value.cast("bigint"))


def payload_int(payload: Column, key: str) -> Column:
    """An integer field of a JSON payload; null when it is absent or of another type."""
    return field_int(F.try_parse_json(payload), key)


def payload_text(payload: Column, key: str) -> Column:
    return field_text(F.try_parse_json(payload), key)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def parse_iso(text: Column) -> Column:
    """Zoned ISO text; a text without zone is read as UTC (the session runs in UTC)."""
    return F.try_to_timestamp(text)


def run_id(ts: Column, suffix: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.left(suffix, F.lit(8)))
