"""Records of decisions as rows: id, title, status, sections (a map from heading to text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.extract import fenced, lines_of

# What a record's status may be.
STATUSES = ("proposed", "accepted", "rejected", "deprecated", "superseded")


def parsed(documents: DataFrame) -> DataFrame:
    """documents: path, content (Markdown). The record of each: its first heading is the title, other headings begin sections."""
    from pyspark.sql import Window

    rows = fenced(lines_of(documents))
    upto = Window.partitionBy("path").orderBy("line")
    heading = F.when(~F.col("inside") & ~F.col("fence"), F.nullif(F.regexp_extract("text", r"^##+\s+(.*?)\s*$", 1), F.lit("")))
    rows = rows.withColumns({"heading": heading, "section": F.last(heading, ignorenulls=True).over(upto)})
    title = rows.where(F.col("text").rlike(r"^#\s+\S")).groupBy("path").agg(F.min_by(F.regexp_extract("text", r"^#\s+(.*?)\s*$", 1), "line").alias("title"))
    body = rows.where("heading IS NULL AND section IS NOT NULL").groupBy("path", "section").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")).alias("text"))
    sections = body.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("text"))))).alias("sections"))
    out = documents.select("path").join(title, "path", "left").join(sections, "path", "left")
    ident = F.regexp_extract("path", r"([^/]*?)(?:\.md)?$", 1)
    status = F.lower(F.coalesce(F.regexp_extract(F.element_at("sections", "Status"), r"^(\w+)", 1), F.lit("proposed")))
    return out.select(ident.alias("id"), F.coalesce("title", ident).alias("title"), F.when(status.isin(*STATUSES), status).otherwise("proposed").alias("status"), F.coalesce("sections", F.create_map().cast("map<string,string>")).alias("sections"))


def created(records: DataFrame, new: DataFrame) -> DataFrame:
    """records with the new ones whose ids are not there yet."""
    return records.unionByName(new.join(records.select("id"), "id", "left_anti").select(*records.columns))


def updated(records: DataFrame, ident: str, status: str | None = None, sections: dict[str, str] | None = None) -> DataFrame:
    """records with a status or sections of one changed; an unknown status is an error."""
    if status is not None and status not in STATUSES:
        raise ValueError(f"a status is one of {', '.join(STATUSES)}, not {status}")
    own = F.col("id") == ident
    out = records
    if status is not None:
        out = out.withColumn("status", F.when(own, status).otherwise(F.col("status")))
    if sections:
        more = F.create_map(*[F.lit(x) for pair in sections.items() for x in pair])
        kept = F.map_filter("sections", lambda k, v: ~k.isin(*sections))
        out = out.withColumn("sections", F.when(own, F.map_concat(kept, more)).otherwise(F.col("sections")))
    return out


def deleted(records: DataFrame, ident: str) -> DataFrame:
    return records.where(F.col("id") != ident)
