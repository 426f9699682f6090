"""Line dedup by site-relative frequency: a line on too large a share of its site's pages is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.tables import joinable, without

MAX_RATIO = 0.05
MIN_PAGES = 5
_BLANK = " \t\x0b\x0c\r"


def _worded(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(_BLANK))) > 0


def drop_boilerplate_lines(docs: DataFrame, site: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Removes from every text the lines that more than ``max_ratio`` (and at least ``min_pages``) of its site's pages contain.

    Adds n_lines and n_dropped; every row is a page of its site, a page counts once for a line however often the line
    repeats in it. Lines are compared as they are; lines without a word are neither counted nor dropped. Counts are
    exact over all pages, combined per task before they are shuffled. A site keeps at most (mean distinct lines per
    page) / max_ratio boilerplate lines, so the per-site list that meets the pages is bounded by page length; the lists
    are broadcast if they measure a few MB, otherwise joined by site, where adaptive execution splits a hot site.

    A null text stays null with 0 lines and counts as a page; an empty text has one line, a blank one. Null sites form
    one site. Repeated rows are pages of their own. An empty table gives an empty result. Extra columns pass through;
    input columns named n_lines or n_dropped give way. Very long texts and lines are treated whole.
    """
    docs = without(docs, ["n_lines", "n_dropped"])
    place, text = F.col(f"`{site}`"), F.col("text")
    lines = F.split(text, "\n", -1)
    pages = docs.groupBy(place.alias("__site")).agg(F.count("*").alias("__pages"))
    held = docs.select(place.alias("__site"), F.explode(F.array_distinct(F.filter(lines, _worded))).alias("__line"))
    often = held.groupBy("__site", "__line").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_pages)
    common = often.alias("o").join(pages.alias("p"), F.col("o.__site").eqNullSafe(F.col("p.__site"))).where(F.col("__n") > max_ratio * F.col("__pages"))
    listed = joinable(common.groupBy(F.col("o.__site").alias("__site")).agg(F.collect_list("__line").alias("__common")))
    joined = docs.join(listed, place.eqNullSafe(F.col("__site")), "left")
    hit = joined.withColumn("__lines", lines).withColumn("__bad", F.array_intersect("__lines", "__common"))
    kept = F.filter("__lines", lambda x: ~F.array_contains("__bad", x))
    changed = F.coalesce(F.size("__bad") > 0, F.lit(False)) & F.col("__bad").isNotNull()
    return (
        hit.withColumn("__kept", F.when(changed, kept))
        .withColumn("n_lines", F.coalesce(F.array_size("__lines"), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.when(changed, F.array_size("__lines") - F.array_size("__kept")).otherwise(0).cast("long"))
        .withColumn("text", F.when(changed, F.array_join("__kept", "\n")).otherwise(text))
        .drop("__site", "__common", "__lines", "__bad", "__kept")
    )


ORACLE = f"""
WITH line AS (
  SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents
), often AS (
  SELECT source, line, count(*) AS n FROM line
  WHERE trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY ALL HAVING count(*) >= {MIN_PAGES}
), pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
common AS (
  SELECT o.source AS site, list(line) AS lines FROM often o JOIN pages p ON o.source IS NOT DISTINCT FROM p.source
  WHERE n > {MAX_RATIO} * pages GROUP BY 1
), cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(c.lines, []), x)) AS kept
  FROM documents d LEFT JOIN common c ON d.source IS NOT DISTINCT FROM c.site
)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped,
  CASE WHEN len(kept) < len(lines) THEN array_to_string(kept, chr(10)) ELSE text END AS text
FROM cut
"""
