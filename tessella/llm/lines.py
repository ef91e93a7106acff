"""Line dedup by distinct-site spread, in DataFrame functions alone.

HyperLogLog sketches of the sites of each line merge by aggregation. Lines whose estimate is far
over the threshold are boilerplate, lines far below are not, and only for those near it are the
distinct sites counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, staged

SITES = 10
#: A sketch has 2**LG registers; its relative error is 1.04 / sqrt(2**LG), 1.6 % here.
LG = 12
#: The share around the threshold within which sites are counted exactly, over six such errors.
NEAR = 0.1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """id, text_hash, site, pos and the line's hash (h, g: 96 bits) for each line that isn't blank.

    Lines are compared without the white space around them.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    solid = rows.withColumn("line", F.trim(F.translate("line", "\t\r\v\f", "    "))).where("line <> ''")
    return solid.select("id", "text_hash", "site", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))


def boilerplate(seen: DataFrame, sites: int = SITES, lg: int = LG, near: float = NEAR) -> DataFrame:
    """h, g and first (the first place, by id and position) of the lines on at least ``sites`` sites."""
    low, high = sites * (1 - near) - 1, sites * (1 + near) + 1
    spread = seen.groupBy("h", "g").agg(F.hll_sketch_agg("site", lg).alias("sketch"), F.min(F.struct("id", "text_hash", "pos")).alias("first"))
    spread = staged(spread.select("h", "g", "first", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= low), "spread")
    close = spread.where(F.col("estimate") <= high)
    exact = seen.join(close.select("h", "g"), ["h", "g"]).select("h", "g", "site").distinct().groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= sites)
    return spread.where(F.col("estimate") > high).select("h", "g", "first").unionByName(close.join(exact, ["h", "g"], "left_semi").select("h", "g", "first"))


def line_dedup(docs: DataFrame, sites: int = SITES, lg: int = LG, near: float = NEAR, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and n_lines and n_removed (longs).

    A line on at least ``sites`` sites stays where it comes first (by id, then position) and goes
    from everywhere else, so no content is lost altogether. Blank lines stay. Rows all stay: a
    text all of whose lines go is empty, a null text stays null. Rows without a site count as one
    site. Very long texts are read whole, all their lines count. An empty table has no rows. Equal rows count as one place and keep or lose the same lines. A column of ``docs`` that
    is named n_lines or n_removed is replaced.
    """
    seen = staged(occurrences(docs, id_col, text_col, site_col), "lines")
    common = boilerplate(seen, sites, lg, near)
    lost, key, print_of = (free(n, docs) for n in ("gone", "gone_id", "gone_hash"))
    first = F.struct("id", "text_hash", "pos").eqNullSafe(F.col("first"))
    gone = seen.join(common, ["h", "g"]).where(~first).groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias(lost)).withColumnsRenamed({"id": key, "text_hash": print_of})
    met = docs.join(gone, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(print_of)), "left")
    lines = _lines(F.col(text_col))
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(lost, i)), "\n")
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    text = F.when(F.col(lost).isNull(), F.col(text_col).cast("string")).otherwise(left).alias(text_col)
    return met.select(*[text if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in kept], F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_removed"))
