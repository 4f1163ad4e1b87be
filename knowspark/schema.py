"""Fixed schemas of the entry table and of source items."""

from __future__ import annotations

from pyspark.sql import types as T

# The entry table: one row per entry, business key (store, name).
ENTRY_SCHEMA = T.StructType([
    T.StructField("store", T.StringType(), False),    # 'user' | 'system'
    T.StructField("id", T.LongType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("content", T.StringType(), True),
    T.StructField("tags", T.StringType(), True),
    T.StructField("meta", T.StringType(), True),      # JSON text
    T.StructField("pinned", T.BooleanType(), False),
    T.StructField("created", T.TimestampNTZType(), False),
    T.StructField("updated", T.TimestampNTZType(), False),
])

ENTRY_COLUMNS = [f.name for f in ENTRY_SCHEMA.fields]

# What a source adapter produces before it becomes an entry.
ITEM_SCHEMA = T.StructType([
    T.StructField("source_id", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("content", T.StringType(), True),
    T.StructField("tags", T.StringType(), True),
    T.StructField("meta", T.StringType(), True),
    T.StructField("fingerprint", T.StringType(), True),
    T.StructField("source_path", T.StringType(), True),
])

ITEM_COLUMNS = [f.name for f in ITEM_SCHEMA.fields]

# Searchable columns of an entry, in index order.
SEARCH_COLUMNS = ("name", "content", "tags")

# Store order: the user store shadows the system store.
STORES = ("user", "system")

# Entry types that carry memory weights.
MEMORY_TYPES = ("memory", "lesson", "session")

# The types that 'auto' routing sends to the system store.
SYSTEM_TYPES = ("knowledge", "tool")
