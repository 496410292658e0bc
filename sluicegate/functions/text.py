"""Text helpers: schema names, SQL quoting, PII masks, HTML to text."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sluicegate.model import MASK_WIDTH

# Unicode white space; Java's plain \s is ASCII only.
WHITE_SPACE = "".join(
    chr(c)
    for low, high in (
        (0x09, 0x0D),
        (0x1C, 0x20),
        (0x85, 0x85),
        (0xA0, 0xA0),
        (0x1680, 0x1680),
        (0x2000, 0x200A),
        (0x2028, 0x2029),
        (0x202F, 0x202F),
        (0x205F, 0x205F),
        (0x3000, 0x3000),
    )
    for c in range(low, high + 1)
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def schema_name(name: Column | str) -> Column:
    """Business domain name to schema name: 'Supply Chain' -> 'supply_chain'."""
    return F.lower(F.regexp_replace(F.trim(_col(name)), "[^A-Za-z0-9]+", "_"))


def sql_quote(text: Column | str) -> Column:
    """Body of a SQL string literal, quotes doubled."""
    return F.replace(_col(text), F.lit("'"), F.lit("''"))


def masked(value: Column | str) -> Column:
    """Stars in place of a value, eight at most. A NULL gives eight stars."""
    return F.repeat(F.lit("*"), F.least(F.length(_col(value)), F.lit(MASK_WIDTH)))


def mask_pii(value: Column | str, can_view: Column | bool) -> Column:
    """The value for privileged viewers, a mask for everyone else."""
    allowed = can_view if isinstance(can_view, Column) else F.lit(can_view)
    return F.when(allowed, _col(value)).otherwise(masked(value))


def create_mask_function(spark: SparkSession, name: str = "mask_pii_string", temporary: bool = True) -> None:
    """Register the mask as a SQL function ``name(val STRING, can_view BOOLEAN)``."""
    kind = "TEMPORARY FUNCTION" if temporary else "FUNCTION"
    spark.sql(
        f"CREATE OR REPLACE {kind} {name}(val STRING, can_view BOOLEAN) RETURNS STRING "
        f"RETURN CASE WHEN can_view THEN val ELSE repeat('*', least(length(val), {MASK_WIDTH})) END"
    )


def html_to_text(html: Column | str) -> Column:
    """Drop tags, then collapse white space. All white space becomes a plain space first,
    so that only runs of spaces are left to replace."""
    without_tags = F.regexp_replace(_col(html), "<[^>]+>", "")
    spaced = F.translate(without_tags, WHITE_SPACE, " " * len(WHITE_SPACE))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))
