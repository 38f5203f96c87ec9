"""Model configs: YAML or JSON documents -> a validated dimension table.

A config directory is read with ``wholetext=True`` (one row per file). JSON
is parsed natively; YAML goes through ``yaml.safe_load`` in a
``mapInPandas`` batch helper (configs are one small document per model, so
this Python step is tiny) and comes back as JSON text, parsed to VARIANT.

Validation: the document must be a mapping; top-level keys ``id,
model_name, runtime, settings`` must exist (missing ones listed sorted);
then ``runtime.server_url``, ``settings.temperature``, ``settings.top_p``,
``settings.max_tokens`` must exist, first missing reported.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.functions.jsonv import json_kind_sql, object_keys_sql
from evalgrid.functions.text import fill_sql, lit

# Required top-level keys and (section, key) pairs in check order.
REQUIRED_TOP = ["id", "model_name", "runtime", "settings"]
REQUIRED_NESTED = [("runtime", "server_url"), ("settings", "temperature"), ("settings", "top_p"), ("settings", "max_tokens")]
# Config loader messages.
MESSAGES = {
    "not_mapping": "Config file must contain a YAML mapping (dict), got {kind}",
    "missing_top": "Missing required top-level key(s): {keys}",
    "missing_nested": "Missing required key '{key}' in '{section}'",
}

CONFIG_SCHEMA = (
    "config_file string, id string, model_name string, model_path string, "
    "runtime struct<engine:string,server_url:string>, "
    "settings struct<context_size:int,temperature:double,top_p:double,max_tokens:int>, "
    "hardware struct<gpu:string,vram_gb:int,backend:string>, raw variant"
)


def _yaml_to_json(batches):
    """Per batch: YAML text -> JSON text (or an error string)."""
    import pandas as pd

    try:
        import yaml
    except ImportError:  # pragma: no cover - YAML support is optional
        yaml = None
    for pdf in batches:
        out_json, out_err = [], []
        for text in pdf["text"]:
            try:
                if yaml is None:
                    data = json.loads(text)
                else:
                    data = yaml.safe_load(text)
                out_json.append(json.dumps(data, default=str))
                out_err.append(None)
            except Exception as e:  # noqa: BLE001 - reported per document
                out_json.append(None)
                out_err.append(f"{type(e).__name__}: {e}")
        yield pd.DataFrame({"config_file": pdf["config_file"], "json": out_json, "parse_error": out_err})


def parse_config_texts(texts: DataFrame) -> DataFrame:
    """(config_file, text) -> (config_file, json, parse_error) via ``yaml.safe_load``."""
    return texts.select("config_file", "text").mapInPandas(
        _yaml_to_json, "config_file string, json string, parse_error string"
    )


def read_config_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per config file under ``path`` (glob or directory)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("config_file"), F.col("value").alias("text")
    )


def load_configs(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(configs, errors) from (config_file, text) rows."""
    parsed = parse_config_texts(texts).withColumn("raw", F.expr("try_parse_json(json)"))
    parsed = parsed.withColumn("__kind", F.expr(json_kind_sql("raw")))
    parsed = parsed.withColumn("__keys", F.expr(f"CASE WHEN __kind = 'dict' THEN {object_keys_sql('raw')} END"))
    nested = " ".join(
        f"WHEN NOT coalesce(array_contains(map_keys(try_variant_get(raw, '$.{p}', 'map<string,variant>')), '{c}'), false) "
        f"THEN {fill_sql(MESSAGES['missing_nested'], key=lit(c), section=lit(p))} "
        for p, c in REQUIRED_NESTED
    )
    top = "array_except(array(" + ", ".join(lit(k) for k in REQUIRED_TOP) + "), __keys)"
    kind = "coalesce(__kind, 'NoneType')"
    missing = f"array_join({top}, ', ')"
    err = (
        "CASE WHEN parse_error IS NOT NULL THEN parse_error "
        f"WHEN __kind IS NULL OR __kind <> 'dict' THEN {fill_sql(MESSAGES['not_mapping'], kind=kind)} "
        f"WHEN size({top}) > 0 THEN {fill_sql(MESSAGES['missing_top'], keys=missing)} "
        f"{nested}END"
    )
    parsed = parsed.withColumn("__err", F.expr(err))
    errors = parsed.filter(F.col("__err").isNotNull()).select("config_file", F.col("__err").alias("message"))
    ok = parsed.filter(F.col("__err").isNull())
    g = "try_variant_get(raw, '$.{}', '{}')".format
    configs = ok.select(
        "config_file",
        F.expr(g("id", "string")).alias("id"),
        F.expr(g("model_name", "string")).alias("model_name"),
        F.expr(g("model_path", "string")).alias("model_path"),
        F.expr(g("runtime", "struct<engine:string,server_url:string>")).alias("runtime"),
        F.expr(g("settings", "struct<context_size:int,temperature:double,top_p:double,max_tokens:int>")).alias("settings"),
        F.expr(g("hardware", "struct<gpu:string,vram_gb:int,backend:string>")).alias("hardware"),
        "raw",
    )
    return configs, errors


def duplicate_ids(configs: DataFrame) -> DataFrame:
    """Config ids defined more than once: how many files, first and last file by name.

    Bounded aggregates only (no list of files is gathered per id)."""
    return (
        configs.groupBy("id")
        .agg(F.count(F.lit(1)).alias("n_files"), F.min("config_file").alias("first_file"), F.max("config_file").alias("last_file"))
        .filter(F.col("n_files") > 1)
    )
