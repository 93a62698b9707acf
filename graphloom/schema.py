"""The property graph's tables, labels and relation kinds."""

from __future__ import annotations

from pyspark.sql import types as T

NODE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
])

EDGE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("target", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
])

UNRESOLVED = "Unresolved"

#: Labels a relation kind may point to; Unresolved is always allowed, a kind that is not here may point anywhere.
ALLOWED_TARGETS = {
    "BelongsTo": ("Region", "Nation"),
    "PlacedBy": ("Customer",),
    "Contains": ("Part",),
    "SuppliedBy": ("Supplier",),
    "References": ("Page",),
}
