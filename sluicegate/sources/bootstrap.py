"""Registry tables: idempotent creation, seeding, presence check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.model import REGISTRY_SCHEMAS, SEED_DOMAINS


def create_registry(spark: SparkSession, database: str = "default", fmt: str = "parquet") -> list[str]:
    """Create the registry tables that do not exist yet; returns all their names."""
    names = []
    for table, schema in REGISTRY_SCHEMAS.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{table}` ({columns}) USING {fmt}")
        names.append(table)
    return names


def seed(new: DataFrame, existing: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of `new` whose key is absent from `existing`: what an insert that ignores
    conflicts would add. Nothing is removed from `new` otherwise."""
    keys = [key] if isinstance(key, str) else key
    return new.join(existing.select(*keys), keys, "left_anti").select(*new.columns)


def seed_domains(spark: SparkSession, as_of: str) -> DataFrame:
    """The starting domains as rows of the `domains` table, keyed by schema name."""
    rows = [(schema, name, schema, text) for name, schema, text in SEED_DOMAINS]
    frame = spark.createDataFrame(rows, "id string, name string, uc_schema_name string, description string")
    stamp = F.lit(as_of).cast("timestamp")
    return frame.select(
        "*", stamp.alias("created_at"), stamp.alias("updated_at"), F.lit("system").alias("created_by")
    )


def missing_tables(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected table names that are not in the catalog listing (both: table_name)."""
    return expected.join(actual, "table_name", "left_anti")


def missing_registry_tables(spark: SparkSession, database: str = "default") -> DataFrame:
    return missing_tables(
        _names(spark, REGISTRY_SCHEMAS),
        _names(spark, (t.name for t in spark.catalog.listTables(database) if not t.isTemporary)),
    )


def _names(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "table_name string")
