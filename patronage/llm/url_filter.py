"""URL filtering by lists whose entries have dates.

A list entry says that from its day on a rule (a host or a parent domain) is
blocked, allowed or removed.  Entries become validity intervals, each lasting
until the next entry of its rule.  A capture is judged by the entries active on
the day it was fetched: an as-of join of the rules that its host falls under
with the intervals.  The most specific rule decides.

Captures are first reduced to different (host, day) pairs, so a host with a
third of all rows costs one row per task and day.  The verdicts go back to the
captures over salted keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import table

SALTS = 16
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    """The lower-cased host; empty for null and for what is no absolute URL."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def validity(entries: DataFrame) -> DataFrame:
    """(rule, action, valid_from, valid_to) of entries (rule, action, listed).

    The last of several entries of a rule and day counts, in the order allow,
    block, remove.  Entries with a null rule, action or day are ignored.
    """
    known = entries.where("rule is not null and action is not null and listed is not null")
    daily = known.groupBy("rule", "listed").agg(F.max("action").alias("action"))
    following = F.lead("listed").over(Window.partitionBy("rule").orderBy("listed"))
    spans = daily.withColumn("valid_to", following).where("action <> 'remove'")
    return spans.select("rule", "action", F.col("listed").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, fetched_col: str, salts: int = SALTS) -> DataFrame:
    """One row per capture: id, host, fetched, rule, action, listed, blocked.

    ``rule``, ``action`` and ``listed`` are null where no entry is active; such
    captures, and those without URL or day, are not blocked.  Repeated rows are
    judged alike; an empty list blocks nothing.
    """
    rows = captures.select(
        F.col(f"`{id_col}`").alias("id"), host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{fetched_col}`").alias("fetched")
    )
    asked = rows.where("host <> '' and fetched is not null").groupBy("host", "fetched").agg(F.count("*").alias("n"))
    labels = F.split("host", r"\.")
    # The host itself first, then its parent domains.
    level = F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("level", "rule")
    candidates = asked.select("host", "fetched", level)
    spans = validity(entries)
    active = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    found = candidates.join(spans, "rule").where(active)
    verdict = found.groupBy("host", "fetched").agg(F.min(F.struct("level", "rule", "action", "valid_from")).alias("v"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    verdict = verdict.select("host", "fetched", "v.rule", "v.action", F.col("v.valid_from").alias("listed"), salt)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    judged = salted.join(verdict, ["host", "fetched", "salt"], "left")
    return judged.select(
        F.col("id").alias(id_col), "host", "fetched", "rule", "action", "listed", F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked")
    )


# The tables hold neither fetch days nor lists.  Both are derived from them: the
# day from the page's id, and for each host and registered domain two entries
# whose days and actions follow from its digest.
FETCHED = "date_add(DATE '2024-01-01', cast((page_id * 37) % 365 AS int))"


def derived_entries(pages: DataFrame) -> DataFrame:
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''")
    domain = F.substring_index("host", ".", -3)
    rules = hosts.select(F.explode(F.array("host", domain)).alias("rule")).distinct()
    code = lambda i: F.ascii(F.substring(F.md5("rule"), i, 1))
    day = (code(1) * 7 + code(2) * 13 + code(3) * 29) % 365
    first = F.when(code(4) % 3 == 0, "block").when(code(4) % 3 == 1, "allow")
    second = F.when(code(5) % 2 == 0, "remove").otherwise("block")
    start = F.to_date(F.lit("2024-01-01"))
    both = F.array(
        F.struct(first.alias("action"), F.date_add(start, day).alias("listed")),
        F.struct(second.alias("action"), F.date_add(start, day + code(6)).alias("listed")),
    )
    return rules.select("rule", F.inline(both)).where("action is not null")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr(FETCHED))
    judged = filter_urls(captures, derived_entries(pages), "page_id", "url", "fetched")
    return judged.withColumns({day: F.col(day).cast("string") for day in ("fetched", "listed")})


OP6_SQL = f"""
WITH captures AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
         DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS fetched
  FROM pages),
rules AS (
  SELECT DISTINCT rule FROM (
    SELECT host AS rule FROM captures WHERE host <> ''
    UNION ALL SELECT array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 2, 1), len(string_split(host, '.'))), '.') FROM captures WHERE host <> '')),
codes AS (SELECT rule, [ascii(substr(md5(rule), i, 1)) FOR i IN range(1, 7)] AS c FROM rules),
days AS (SELECT rule, c, (c[1] * 7 + c[2] * 13 + c[3] * 29) % 365 AS d FROM codes),
entries AS (
  SELECT rule, CASE c[4] % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'allow' END AS action, DATE '2024-01-01' + CAST(d AS INTEGER) AS listed FROM days
  UNION ALL
  SELECT rule, CASE c[5] % 2 WHEN 0 THEN 'remove' ELSE 'block' END, DATE '2024-01-01' + CAST(d + c[6] AS INTEGER) FROM days),
spans AS (
  SELECT rule, action, listed AS valid_from, lead(listed) OVER (PARTITION BY rule ORDER BY listed) AS valid_to
  FROM (SELECT rule, listed, max(action) AS action FROM entries WHERE action IS NOT NULL GROUP BY rule, listed)),
levels AS (
  SELECT page_id, host, fetched, level, array_to_string(list_slice(string_split(host, '.'), level, len(string_split(host, '.'))), '.') AS rule
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS level FROM captures WHERE host <> '')),
best AS (
  SELECT page_id, rule, action, valid_from, row_number() OVER (PARTITION BY page_id ORDER BY level) AS place
  FROM levels JOIN spans USING (rule)
  WHERE action <> 'remove' AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to))
SELECT captures.page_id, host, CAST(fetched AS VARCHAR) AS fetched, rule, action, CAST(valid_from AS VARCHAR) AS listed, coalesce(action = 'block', false) AS blocked
FROM captures LEFT JOIN best ON captures.page_id = best.page_id AND place = 1
"""
