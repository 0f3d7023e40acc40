"""Line deduplication by how common a line is within its site.

A line is boilerplate if it stands on more than ``ratio`` of its site's pages. The lines dropped from a site
can't be more than the mean number of different lines on its pages divided by the ratio.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.scratch import stored

BROADCAST_LINES = 50_000


def _line_key(line):
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float, least_pages: int) -> DataFrame:
    """Boilerplate lines: host, h1, h2, pages. A page counts once for a line; blank lines never count."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    keys = F.array_distinct(F.transform(lines, _line_key))
    pages = docs.select(F.col(host_col).alias("host"), keys.alias("keys"))
    totals = docs.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("total"))
    counts = pages.select("host", F.explode("keys").alias("k")).groupBy("host", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.count("*").alias("pages"))
    common = counts.filter(F.col("pages") >= least_pages)
    joined = common.join(totals.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host")))
    return joined.filter(F.col("pages") > F.col("total") * F.lit(ratio)).select("host", "h1", "h2", "pages")


def drop_boilerplate(
    docs: DataFrame,
    ratio: float = 0.02,
    least_pages: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Rows of ``docs`` with the boilerplate lines of their site taken out of the text: all columns, and n_lines, n_dropped.

    Lines are split at ``\\n``; all others stay in order. A null text stays null with no lines; a null host
    is a site of its own; repeated rows are pages of their own. A line on fewer than ``least_pages`` pages is never
    dropped, so tiny sites keep their text. An empty table gives no rows.
    """
    common = stored(boilerplate(docs, host_col, text_col, ratio, least_pages), "boilerplate")
    lines = F.split(F.col(text_col), "\n", -1)
    if common.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        by_host = common.groupBy("host").agg(F.collect_list(F.struct("h1", "h2")).alias("__common"))
        marked = docs.join(F.broadcast(by_host.withColumnRenamed("host", "__host")), docs[host_col].eqNullSafe(F.col("__host")), "left")
        drop = F.transform(lines, lambda x: F.coalesce(F.array_contains("__common", _line_key(x)), F.lit(False)))
    else:
        marked = _marked_by_join(docs, common, id_col, text_col, host_col)
        drop = F.transform(lines, lambda x, i: F.coalesce(F.array_contains("__at", i), F.lit(False)))
    marked = marked.select(*[docs[c] for c in docs.columns], lines.alias("__lines"), drop.alias("__drop"))
    kept = F.filter("__lines", lambda x, i: ~F.get("__drop", i))
    dropped = F.coalesce(F.size(F.filter("__drop", lambda d: d)), F.lit(0))
    out = marked.withColumns({text_col: F.array_join(kept, "\n"), "n_lines": F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")), "n_dropped": F.when(F.col("__lines").isNull(), 0).otherwise(dropped)})
    return out.drop("__lines", "__drop")


def _marked_by_join(docs: DataFrame, common: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """For lists too long to broadcast: join line by line, then bring the positions back to the texts."""
    key = [F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(host_col).alias("__host")]
    lines = docs.select(*key, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("at", "line"))
    lines = lines.select("__id", "__hash", "__host", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))
    same = lines["__host"].eqNullSafe(common["host"]) & (lines["h1"] == common["h1"]) & (lines["h2"] == common["h2"])
    found = lines.join(common, same, "left_semi").groupBy("__id", "__hash", "__host").agg(F.collect_set("at").alias("__at"))
    here = docs[id_col].eqNullSafe(found["__id"]) & (F.xxhash64(docs[text_col]) == found["__hash"]) & docs[host_col].eqNullSafe(found["__host"])
    return docs.join(found, here, "left")


ORACLE = r"""
WITH p AS (
  SELECT doc_id, source, unnest(list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS line
  FROM documents
), t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
c AS (
  SELECT p.source, line FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
  GROUP BY p.source, line, total HAVING count(*) >= 3 AND count(*) > total * CAST(0.02 AS DOUBLE)
), l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), m AS (
  SELECT l.doc_id, l.i, l.line, c.line IS NOT NULL AS gone FROM l LEFT JOIN c ON l.source IS NOT DISTINCT FROM c.source AND l.line = c.line
), g AS (
  SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS INT) AS n_dropped,
         md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_md5
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, text_md5 FROM documents d LEFT JOIN g USING (doc_id)
"""
