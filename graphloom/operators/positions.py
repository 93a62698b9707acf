"""Byte offsets in texts to lines and columns, and where the matches of a pattern begin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of one piece of a line, and bytes of one bin; a piece lies in a few bins, however long its line is.
PIECE, BIN = 2048, 4096


def line_pieces(texts: DataFrame, ident: str = "id", text: str = "text") -> DataFrame:
    """id, line (from 1), start and size (bytes), before (characters of the line before it, without carriage returns), piece, last.

    Lines end at line feeds; a line of more than PIECE characters has several pieces, an empty one has one.
    """
    rows = texts.where(F.col(text).isNotNull()).select(F.col(ident).alias("id"), F.posexplode(F.split(text, "\n")).alias("line", "text"))
    many = F.greatest(F.ceil(F.length("text") / PIECE), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.substring("text", k * PIECE + 1, F.lit(PIECE)))
    pieces = rows.select("id", (F.col("line") + 1).alias("line"), F.posexplode(cut).alias("at", "piece"), many.alias("many"))
    sized = pieces.withColumns({"size": F.octet_length("piece").cast("long"), "seen": F.length(F.replace("piece", F.lit("\r"), F.lit(""))), "last": F.col("at") == F.col("many") - 1})
    upto = Window.partitionBy("id").orderBy("line", "at").rowsBetween(Window.unboundedPreceding, -1)
    of_line = Window.partitionBy("id", "line").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") + F.col("last").cast("int")).over(upto), F.lit(0))
    before = F.coalesce(F.sum("seen").over(of_line), F.lit(0))
    return sized.select("id", "line", start.alias("start"), "size", before.alias("before"), "piece", "last")


def text_positions(texts: DataFrame, offsets: DataFrame, ident: str = "id", text: str = "text") -> DataFrame:
    """offsets: id, offset (bytes from 0). id, offset, line, column, both from 1; columns count characters other than carriage returns.

    An offset at a line feed is behind its line's last character. An offset outside of the text, or of a text that is not there,
    gives no row; one inside a character has a null column. Pieces of lines and offsets meet in bins of bytes.
    """
    pieces = line_pieces(texts, ident, text)
    first, last = F.floor(F.col("start") / BIN), F.floor((F.col("start") + F.col("size")) / BIN)
    binned = pieces.withColumn("bin", F.explode(F.sequence(first, last)))
    asked = offsets.select(F.col(ident).alias("id"), F.col("offset").cast("long").alias("offset")).where("offset >= 0").withColumn("bin", F.floor(F.col("offset") / BIN))
    at = F.col("offset") - F.col("start")
    hit = asked.join(binned, ["id", "bin"]).where((at >= 0) & ((at < F.col("size")) | (F.col("last") & (at == F.col("size")))))
    ahead = F.try_validate_utf8(F.substring(F.col("piece").cast("binary"), F.lit(1), at.cast("int")).cast("string"))
    column = F.col("before") + F.length(F.replace(ahead, F.lit("\r"), F.lit(""))) + 1
    return hit.select("id", "offset", F.col("line").cast("long").alias("line"), column.cast("long").alias("column"))


def match_offsets(texts: DataFrame, pattern: str, ident: str = "id", text: str = "text") -> DataFrame:
    """id, match, offset (bytes) of all matches of a pattern that has no groups and no empty match."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(ident).alias("id"), F.posexplode(zipped).alias("at", "x"))
    sized = rows.select("id", "at", "x.match", F.octet_length("x.gap").alias("gap"), F.coalesce(F.octet_length("x.match"), F.lit(0)).alias("size"))
    upto = Window.partitionBy("id").orderBy("at")
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    return sized.withColumn("offset", end - F.col("size")).where("match IS NOT NULL").select("id", "match", F.col("offset").cast("long").alias("offset"))
