"""Entry tables of a few rows for the tests."""

from datetime import datetime

from knowspark.schema import ENTRY_SCHEMA

T0 = datetime(2024, 1, 1)


def make_entries(spark, rows):
    """rows: dicts with name/content and optional store, id, type, tags, meta, pinned, updated."""
    out = []
    for i, r in enumerate(rows):
        out.append((r.get("store", "user"), r.get("id", i + 1), r.get("type", "knowledge"), r["name"],
                    r.get("content", ""), r.get("tags", ""), r.get("meta", "{}"), r.get("pinned", False),
                    r.get("created", T0), r.get("updated", T0)))
    return spark.createDataFrame(out, ENTRY_SCHEMA)
