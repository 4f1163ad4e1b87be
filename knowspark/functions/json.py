"""JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_fields(text: Column | str) -> Column:
    """MAP<STRING, VARIANT> of a JSON object; null, invalid or other JSON reads as {}."""
    c = F.col(text) if isinstance(text, str) else text
    parsed = F.try_parse_json(F.coalesce(c, F.lit("{}"))).try_cast("map<string,variant>")
    return F.coalesce(parsed, F.create_map().cast("map<string,variant>"))


def dig(variant: Column | str, path: str) -> Column:
    """The value at a dotted path as text; null where a step is missing."""
    v = F.col(variant) if isinstance(variant, str) else variant
    return F.try_variant_get(v, path if path.startswith("$") else "$." + path, "string")


def json_patch(text: Column | str, values: dict[str, Column]) -> Column:
    """JSON object text with the fields of ``values`` set; all others keep their value and type.

    A null value leaves its field as it was.
    """
    base = json_fields(text)
    new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("variant"))])
    new = F.map_filter(new, lambda _, v: v.isNotNull())
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.to_json(F.map_concat(kept, new))
