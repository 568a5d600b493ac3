"""Removal of lines that spread over many sites, in DataFrame functions alone.

Each line's sites go into a HyperLogLog sketch; sketches of one line merge by aggregation, so a line that is everywhere
costs one small row a task. Lines whose estimate is clearly above the limit are boilerplate, those clearly below are not,
and the few near the limit are counted exactly. The first occurrence of a boilerplate line (least document id, then
position) stays; all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, fresh, join_checked, materialize

MIN_SITES = 5
LG_K = 12
#: Half width of the band around the limit in which lines are counted exactly, as a share of the limit. The sketch's
#: standard error at LG_K = 12 is 1.6 %, so the band is over ten of them.
BAND = 0.25


def _lines(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """One row a line that is not blank. Lines are compared without spaces at either end, by 128 bits of hash."""
    # The text is hashed and split below the explosion, and doesn't go through it: else each line would hash the whole text.
    whole = docs.select(col(doc_id).alias("doc"), F.xxhash64(col(text)).alias("text_key"), col(site).alias("site"), F.split(col(text), "\n").alias("lines"))
    at = whole.select("doc", "text_key", "site", F.posexplode("lines").alias("pos", "line")).withColumn("line", F.trim("line")).where(F.col("line") != "")
    return at.select("doc", "text_key", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), F.col("line")).alias("h2"))


def line_spread(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, sites, first) of every line: sketched number of sites, and its first occurrence. Null sites count as none."""
    return _lines(docs, doc_id, text, site).groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.min(F.struct("doc", "text_key", "pos")).alias("first")
    )


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, lg_k: int = LG_K, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """(h1, h2, first) of the lines that stand on at least ``min_sites`` different sites."""
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    wide = materialize(line_spread(docs, doc_id, text, site, lg_k).where(F.col("sites") >= low), "line-spread")
    near = wide.where(F.col("sites") <= high).select("h1", "h2")
    counted = join_checked(_lines(docs, doc_id, text, site).select("h1", "h2", "site"), near, ["h1", "h2"], "left_semi")
    exact = counted.groupBy("h1", "h2").agg(F.count_distinct("site").alias("exact")).where(F.col("exact") >= min_sites).drop("exact")
    sure = wide.where(F.col("sites") > high)
    return materialize(sure.unionByName(wide.join(exact, ["h1", "h2"], "left_semi")).drop("sites"), "boilerplate")


def _without(text: Column, gone: Column) -> Column:
    """A text without the lines at some positions. The split text is bound as the argument of a lambda: an expression that
    stands inside a lambda is worked out anew for each element, which would split the whole text once a line."""
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.get(F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.transform(kept(lines), lambda i: F.get(lines, i)), "\n")), 0)


def dedup_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True, doc_id: str = "doc_id", text: str = "text", site: str = "source",
    counts: tuple[str, str] | None = ("n_lines", "n_lines_removed"), band: float = BAND, lg_k: int = LG_K,
) -> DataFrame:
    """docs with boilerplate lines taken out of ``text``; ``counts`` names the columns for lines seen and removed.

    A null text stays null and has 0 lines; an empty text is one blank line; blank lines are never removed. A document
    that loses every line keeps an empty text. Repeated rows (equal id and text) lose the same lines. Very long texts lose
    lines as short ones do; an empty table stays empty. Columns of docs named as ``counts`` are replaced, all others stay.
    """
    lines = _lines(docs, doc_id, text, site)
    hits = join_checked(lines, boilerplate_lines(docs, min_sites, band, lg_k, doc_id, text, site), ["h1", "h2"], "inner")
    if keep_first:
        hits = hits.where(~F.struct("doc", "text_key", "pos").eqNullSafe(F.col("first")))
    key, gone, doc = fresh(docs, "text_key", "gone", "doc")
    cuts = hits.groupBy(F.col("doc").alias(doc), F.col("text_key").alias(f"{key}_of")).agg(F.collect_set("pos").alias(gone))
    cuts = materialize(cuts, "line-cuts")
    keyed = docs.withColumn(key, F.xxhash64(col(text)))
    # The cuts grow with the documents, so they are never broadcast: the plan is the same at every size.
    joined = keyed.join(cuts.hint("merge"), col(doc_id).eqNullSafe(F.col(doc)) & (F.col(key) == F.col(f"{key}_of")), "left")
    left = F.when(F.col(gone).isNull(), col(text)).otherwise(_without(col(text), F.col(gone)))
    new = {text: left}
    if counts:
        new[counts[0]] = F.when(col(text).isNull(), F.lit(0)).otherwise(F.size(F.split(col(text), "\n"))).cast("long")
        new[counts[1]] = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long")
    return joined.withColumns(new).drop(key, f"{key}_of", gone, doc)


#: The same rows by exact counts: DuckDB.
ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, pos, parts[pos] AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos
        FROM documents WHERE text IS NOT NULL)),
spread AS (
  SELECT trim(line) AS t FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT l.doc_id, l.pos, l.line, s.t IS NOT NULL AND row_number() OVER (PARTITION BY trim(l.line) ORDER BY l.doc_id, l.pos) > 1 AS gone
  FROM l LEFT JOIN spread s ON s.t = trim(l.line)),
rebuilt AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines,
         count(*) FILTER (WHERE gone) AS n_lines_removed
  FROM marked GROUP BY 1)
SELECT d.doc_id, r.text, CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_lines_removed, 0) AS BIGINT) AS n_lines_removed
FROM documents d LEFT JOIN rebuilt r USING (doc_id)
"""
