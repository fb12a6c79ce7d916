"""Explicit schemas of the index tables, their version, and conforming a DataFrame to one."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "projects": "project_id string, name string, root_path string",
    "build_configs": "config_hash string, project_id string, created_at timestamp, compile_commands_path string, embedding_dim int, "
    "manifest_verification string, description string, analyze_vendor int, entry_point string, row_format string, variant string, "
    "image string, board string",
    "index_runs": "config_hash string, run_no int, started_at timestamp, finished_at timestamp, state string",
    "files": "id long, config_hash string, path string, language string, generated int, is_project int, mtime double, content string, "
    "content_hash string, source_hash string, flags_hash string, parse_errors int, parse_fatal int, parse_first_error string, run_no int, seen_at timestamp",
    "symbols": "id long, config_hash string, file_id long, file_path string, name_tokens string, usr string, name string, "
    "qualified_name string, kind string, line int, col int, end_line int, is_definition int, is_weak int, is_tentative int, "
    "signature string, docstring string, enum_value int, is_virtual int, is_pure_virtual int, parent_usr string, is_template int, "
    "template_usr string, is_project int, pagerank double, source string, link_name string, seen_at timestamp, removed_at timestamp",
    "symbols_fts": "symbol_id long, name string, qualified_name string, signature string, docstring string, file_path string, "
    "name_tokens string, summary string, inputs string, outputs string, source string",
    "refs": "id long, config_hash string, to_usr string, from_file string, from_line int, from_usr string, ref_kind string, "
    "slot_index int, from_col int, origins int, seen_at timestamp",
    "ref_producers": "ref_id long, config_hash string, unit_path string, unit_flags_hash string",
    "embedding_stash": "stash_id long, model string, content_hash string, is_project int, donor_id long, chunk_index int, embedding array<float>",
    "embeddings": "symbol_id long, chunk_index int, embedding array<float>, model string, content_hash string",
    "llm_analysis": "symbol_id long, summary string, inputs string, outputs string, model string, content_hash string",
    "inheritance": "config_hash string, derived_usr string, base_usr string, access string, is_virtual int",
    "overrides": "config_hash string, derived_usr string, base_usr string",
    "macros": "id long, config_hash string, file_id long, name string, value string, params string, expanded_value string, line int, is_function_like int",
    "memory_regions": "config_hash string, name string, attributes string, origin string, length string, origin_value long, length_value long, file_path string, line int",
    "slot_sources": "config_hash string, file string, line int, col int, function string, function_type string, slot string, unit string",
    "slot_flows": "config_hash string, file string, line int, col int, source string, target string, unit string",
    "slot_sites": "config_hash string, file string, line int, col int, ordinal int, caller string, kind string, slot string, slot_type string, "
    "reason string, callee string, unit string",
    "slot_arguments": "config_hash string, file string, line int, col int, ordinal int, arg_index int, value_kind string, value string, unit string",
    "slot_escapes": "config_hash string, slot string, reason string",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[table])


TABLES = tuple(_DDL)


def schema_version() -> str:
    """SHA-256 over the sorted table.column:type names; changes whenever a table does."""
    names = sorted(f"{t}.{f.name}:{f.dataType.simpleString()}" for t in TABLES for f in schema(t).fields)
    return hashlib.sha256("\n".join(names).encode()).hexdigest()


def missing_columns(df: DataFrame, table: str) -> list[str]:
    return [f.name for f in schema(table).fields if f.name not in df.columns]


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the columns of the table, missing ones as null; columns of the scan that aren't needed are pruned."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table).fields])


def quick_check(df: DataFrame, table: str) -> None:
    """An error if a table lacks columns of its schema or holds them in a type that can't be read as the schema's."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name} is {have[f.name].simpleString()}" for f in schema(table).fields
             if f.name in have and isinstance(have[f.name], (T.ArrayType, T.MapType, T.StructType)) != isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if (lost := missing_columns(df, table)) or wrong:
        raise ValueError(f"{table}: " + "; ".join([*(f"no {c}" for c in lost), *wrong]))


def open_index(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ("symbols", "refs", "files")) -> dict[str, DataFrame]:
    """Tables of an index directory by name, checked against their schemas and conformed to them."""
    out = {}
    for t in tables:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        quick_check(df, t)
        out[t] = conform(df, t)
    return out
