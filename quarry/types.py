"""SQL type names and their Spark types."""
from __future__ import annotations

import re

from .errors import BindError

#: Accepted type names. Integers are 64 bits wide and character lengths are not enforced.
NAMES = {
    "SMALLINT": "smallint", "INT2": "smallint", "INT": "bigint", "INTEGER": "bigint", "INT4": "bigint", "BIGINT": "bigint", "INT8": "bigint",
    "BOOLEAN": "boolean", "BOOL": "boolean", "FLOAT": "float", "FLOAT4": "float", "REAL": "float", "DOUBLE": "double", "DOUBLE PRECISION": "double", "FLOAT8": "double",
    "CHAR": "string", "CHARACTER": "string", "VARCHAR": "string", "CHARACTER VARYING": "string", "TEXT": "string", "UUID": "string", "JSON": "string", "JSONB": "variant",
    "BINARY": "binary", "VARBINARY": "binary", "BYTEA": "binary", "DATE": "date", "TIME": "string", "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "timestamp_ntz", "INTERVAL": "interval day to second",
}


def spark_type(name: str, custom: dict[str, str] | None = None) -> str:
    """Spark's DDL name of a SQL type; T[] nests, DECIMAL(p, s) keeps its scale, custom types are looked up."""
    name = " ".join(name.split())
    if name.endswith("[]"):
        return f"array<{spark_type(name[:-2], custom)}>"
    found = re.fullmatch(r"([A-Za-z_][\w. ]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", name)
    if not found:
        raise BindError(f"bad type: {name}")
    base = found[1].upper()
    if base in ("DECIMAL", "NUMERIC"):
        return f"decimal({found[2] or 38},{found[3] or (0 if found[2] else 18)})"
    if base in NAMES:
        return NAMES[base]
    if custom and found[1].lower() in custom:
        return custom[found[1].lower()]
    raise BindError(f"unknown type: {name}")
