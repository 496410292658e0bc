"""Storage paths of received files:
``{container}/{domain}/{template}/{template}_{YYYYMMDD}_{HHMMSS}.{ext}``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(.*)/([^/]+)/([^/]+)/\3_(\d{8}_\d{6})\.([^./]+)$"
_STAMP = "yyyyMMdd_HHmmss"
_STAMP_PARTS = r"^(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stored_path(
    container: Column | str,
    domain: Column | str,
    template: Column | str,
    received_at: Column | str,
    extension: Column | str,
) -> Column:
    name = F.concat(
        _col(template), F.lit("_"), F.date_format(_col(received_at), _STAMP), F.lit("."), _col(extension)
    )
    return F.concat_ws("/", _col(container), _col(domain), _col(template), name)


def parse_stored_path(path: Column | str) -> Column:
    """Struct (container, domain, template, received_at, extension), the time being free of
    zones as it is in the name; NULL fields if the path has another form."""
    p = _col(path)

    def part(i: int) -> Column:
        found = F.regexp_extract(p, _PARTS, i)
        return F.when(found != "", found)

    return F.struct(
        part(1).alias("container"),
        part(2).alias("domain"),
        part(3).alias("template"),
        F.regexp_replace(part(4), _STAMP_PARTS, "$1-$2-$3 $4:$5:$6").try_cast("timestamp_ntz").alias("received_at"),
        part(5).alias("extension"),
    )
