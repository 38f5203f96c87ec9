"""Logged model calls -> responses, usage and failure classification.

A call log row holds what a chat-completions call returned: a transport
error (connection/timeout), an HTTP status and the body. Decoding is one
projection: the body is parsed once to VARIANT, the reply text is
``choices[0].message.content``, usage is optional. Each failed call gets the
error text the harness would have recorded, so it becomes an error attempt
instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.functions.jsonv import with_strict_json
from evalgrid.functions.text import fill_sql, fixed, lit

# Request timeout (seconds) quoted in timeout messages, and the
# failure texts of a chat-completions call.
REQUEST_TIMEOUT_SEC = 120
MESSAGES = {
    "connection": "Could not connect to llama-server at {url}: {error}",
    "timeout": "Request to llama-server timed out after {timeout}s: {error}",
    "http_status": "llama-server returned HTTP {status}: {body}",
    "non_json": "llama-server returned non-JSON response: {body}",
    "missing_content": "Response JSON missing expected field 'choices[0].message.content': available keys are [{keys}]",
}


def decode_calls(log: DataFrame, server_url: str | None = None) -> DataFrame:
    """Add ``response``, ``usage``, ``usage_json``, ``error_kind``, ``error`` to a call log.

    Input columns: ``transport_error`` (connection/timeout/NULL),
    ``status_code``, ``body``; optional ``server_url`` column (else the
    ``server_url`` argument) for connection messages. ``usage`` maps each
    field to its number, ``usage_json`` holds it whole; a ``latency_sec`` column is rounded to 3 decimals.
    """
    url = F.col("server_url") if "server_url" in log.columns else F.lit(server_url or "the model server")
    df = with_strict_json(log.withColumns({"__url": url}), "body", "__v")
    df = df.withColumns(
        {
            "__content_v": F.expr("try_variant_get(__v, '$.choices[0].message.content', 'variant')"),
            "__keys": F.expr(
                "CASE WHEN startswith(schema_of_variant(__v), 'OBJECT') THEN "
                "array_distinct(json_object_keys(body)) END"  # in the order of the body
            ),
        }
    )
    kind = F.expr(
        "CASE WHEN transport_error = 'connection' THEN 'connection' "
        "WHEN transport_error = 'timeout' THEN 'timeout' "
        "WHEN transport_error IS NOT NULL THEN 'transport' "
        "WHEN status_code <> 200 THEN 'http_status' "
        "WHEN __v IS NULL THEN 'non_json' "
        "WHEN __content_v IS NULL THEN 'missing_content' END"
    )
    quote = lit("'")
    keys = f"array_join(transform(coalesce(__keys, array()), k -> concat({quote}, k, {quote})), ', ')"
    body = "coalesce(body, '')"
    error = F.expr(
        f"CASE WHEN transport_error = 'connection' THEN {fill_sql(MESSAGES['connection'], url='__url', error='transport_error')} "
        f"WHEN transport_error = 'timeout' THEN "
        f"{fill_sql(MESSAGES['timeout'], timeout=lit(str(REQUEST_TIMEOUT_SEC)), error='transport_error')} "
        "WHEN transport_error IS NOT NULL THEN transport_error "
        f"WHEN status_code <> 200 THEN {fill_sql(MESSAGES['http_status'], status='CAST(status_code AS STRING)', body=body)} "
        f"WHEN __v IS NULL THEN {fill_sql(MESSAGES['non_json'], body=f'substr({body}, 1, 200)')} "
        f"WHEN __content_v IS NULL THEN {fill_sql(MESSAGES['missing_content'], keys=keys)} END"
    )
    out = df.withColumns(
        {
            "error_kind": kind,
            "error": error,
            "response": F.expr("CASE WHEN transport_error IS NULL AND status_code = 200 THEN try_variant_get(__content_v, '$', 'string') END"),
            "usage": F.expr(
                "coalesce(try_variant_get(__v, '$.usage', 'map<string,decimal(38,10)>'), CAST(map() AS MAP<STRING, DECIMAL(38,10)>))"
            ),
            "usage_json": F.expr("to_json(try_variant_get(__v, '$.usage', 'variant'))"),  # nested counts too
        }
    )
    if "latency_sec" in log.columns:
        out = out.withColumn("latency_sec", fixed("latency_sec", 3).cast("double"))
    out = out.withColumn("response", F.when(F.col("error").isNull(), F.col("response")))
    return out.drop("__url", "__v", "__content_v", "__keys")
