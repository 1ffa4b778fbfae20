"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.drift import consistent_table, exploded_fields, field_catalogue, lifespans, schema_changes

TABLES = {"sft_patch_v2_judge_scores": "scores", "gt_scores_c": "payload"}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [schema_changes(spark.read.parquet(f"{sf_dir}/{t}.parquet"), payload) for t, payload in TABLES.items()]
    return parts[0].unionByName(parts[1])


def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    own = sorted({c for df in tables.values() for c in df.columns} - set(TABLES.values()))
    parts = [consistent_table(tables[t], payload, schema_changes(tables[t], payload), own).withColumn("table_name", F.lit(t)) for t, payload in TABLES.items()]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def p3_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: in which files of its run a field has which type."""
    parts = [lifespans(field_catalogue(exploded_fields(spark.read.parquet(f"{sf_dir}/{t}.parquet").fillna({"run_name": ""}), payload))).withColumn("table_name", F.lit(t)) for t, payload in TABLES.items()]
    return parts[0].unionByName(parts[1]).select("table_name", "run_name", "field", "type", "first", "final")


def _lifespans_sql(table: str, payload: str) -> str:
    kinds = "CASE WHEN t IN ('BIGINT', 'UBIGINT') THEN 'integer' WHEN t = 'DOUBLE' THEN 'decimal' WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'OBJECT' THEN 'object' WHEN t = 'ARRAY' THEN 'array' END"
    return f"""SELECT '{table}' AS table_name, run_name, field, type, min(place) AS first, max(place) AS final FROM (
    WITH kept AS (SELECT DISTINCT coalesce(run_name, '') AS run_name, file_no, file_name, video_id, {payload} AS raw FROM {table} WHERE file_name IS NOT NULL AND json_valid({payload}) AND json_type({payload}) = 'OBJECT' AND json_keys({payload}) <> ['error']),
    files AS (SELECT run_name, file_no, file_name, count(*) AS records, row_number() OVER (PARTITION BY run_name ORDER BY file_no, file_name) AS place FROM kept GROUP BY run_name, file_no, file_name),
    rows AS (SELECT run_name, file_no, file_name, raw, unnest(json_keys(raw)) AS field FROM kept),
    typed AS (SELECT run_name, file_no, file_name, field, {kinds} AS kind FROM (SELECT *, json_type(raw, '$."' || field || '"') AS t FROM rows)),
    per AS (SELECT run_name, file_no, file_name, field, count(*) AS carried, count(kind) AS valued FROM typed GROUP BY ALL),
    best AS (SELECT run_name, file_no, file_name, field, kind, count(*) AS n FROM typed WHERE kind IS NOT NULL GROUP BY ALL),
    had AS (SELECT per.run_name, place, per.field, best.kind FROM per JOIN files USING (run_name, file_no, file_name) LEFT JOIN best ON best.run_name = per.run_name AND best.file_no IS NOT DISTINCT FROM per.file_no AND best.file_name = per.file_name AND best.field = per.field AND 2 * best.n > per.valued WHERE 2 * carried > records),
    filled AS (SELECT *, coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY run_name, field ORDER BY place), 'unknown') AS type FROM had),
    marked AS (SELECT *, CASE WHEN place - lag(place) OVER w = 1 AND type = lag(type) OVER w THEN 0 ELSE 1 END AS new FROM filled WINDOW w AS (PARTITION BY run_name, field ORDER BY place))
    SELECT *, sum(new) OVER (PARTITION BY run_name, field ORDER BY place) AS island FROM marked) GROUP BY run_name, field, type, island"""


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_table, p3_lifespans)}


def oracle_sql() -> dict[str, str]:
    return {"p3_lifespans": " UNION ALL ".join(_lifespans_sql(t, payload) for t, payload in TABLES.items())}
