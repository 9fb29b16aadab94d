"""Secrets in texts, and how widely each candidate value is owned.

Spans come from fixed patterns, which always count, and from a wide pattern of
key-like tokens, which count only when the value is owner-specific.  For that
every candidate value of the corpus is hashed and reduced to its number of
repositories and owners: a value seen at several owners is a copied example,
one that stays with a single owner looks live.

All work is done by DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import table, whole_text, written


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# The patterns of the base kinds and their least lengths.
ASSIGN = (
    "("
    + either_case("password|passwd|secret|token|api_?key")
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

# Key-like tokens: long, with digits and letters of both cases.
WIDE = r"[A-Za-z0-9_-]{20,}"
KINDS = ["assign", "access", "hex", "owned"]

# A value with so many owners is a copied example.
COPIED_OWNERS = 2
SALTS = 16
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def sums_before(values: Column) -> Column:
    """For each value the sum of those before it, by blocks rather than from the start each time."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
        lambda b: total(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))),
    )
    starts = let(blocks, lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))))
    return let(
        starts,
        lambda start: F.transform(
            values,
            lambda _, i: F.get(start, F.floor(i / BLOCK).cast("int"))
            + total(F.slice(values, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK)),
        ),
    )


def located(text: Column, pattern: str, kind: int, value_group: int, least: int, least_of_value: bool) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind, end, value), in code points.

    Start positions follow from the lengths of the pieces between the matches.
    """
    lengths = lambda parts: F.transform(parts, lambda x: F.length(x).cast("long"))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else None
    gaps = F.split(text, pattern, -1)

    def spans(found: Column) -> Column:
        sizes, skipped, value = found["sizes"], found["gaps"], found["values"]
        steps = F.zip_with(sizes, F.slice(skipped, F.lit(1), F.size(sizes)), lambda a, b: a + b)
        return let(
            steps,
            lambda step: let(
                sums_before(step),
                lambda before: F.transform(
                    sizes,
                    lambda size, i: F.struct(
                        (F.get(before, i) + F.get(skipped, i)).alias("start"),
                        F.lit(kind).alias("kind"),
                        (F.get(before, i) + F.get(step, i)).alias("end"),
                        F.get(value, i).alias("value"),
                    ),
                ),
            ),
        )

    parts = let(
        whole,
        lambda w: F.struct(lengths(w).alias("sizes"), lengths(gaps).alias("gaps"), (w if values is None else values).alias("values")),
    )
    if least_of_value:
        enough = lambda s: F.length(s["value"]) >= least
    else:
        enough = lambda s: s["end"] - s["start"] >= least
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,value:string>>)")
    return F.when(text.rlike(pattern), F.filter(let(parts, spans), enough)).otherwise(none)


def base_spans(text: Column) -> Column:
    return F.concat(
        located(text, ASSIGN, 0, 2, ASSIGN_LEAST, True),
        located(text, ACCESS, 1, 0, ACCESS_LEAST, False),
        located(text, HEX, 2, 0, 16, False),
    )


def wide_spans(text: Column) -> Column:
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    return F.filter(located(text, WIDE, 3, 0, 20, False), mixed)


def described(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    text = lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(F.array_sort(spans), text), ",")


def value_owners(candidates: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repositories, n_found) of candidates (value_hash, owner, repository).

    Three aggregations, each combined before it is shuffled, so a value with a
    third of all rows arrives as one row per task, then as one per repository,
    then as one per owner.
    """
    places = candidates.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = places.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return owners.groupBy("value_hash").agg(
        F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_found")
    )


def scan(docs: DataFrame, text_col: str, owner: Column, repository: Column, keep: list[str]) -> DataFrame:
    """The candidates of each row, written once: ``keep``, row, owner, repository, base, wide."""
    text = whole_text(text_col)
    return written(
        docs.select(
            *[F.col(f"`{c}`") for c in keep],
            F.monotonically_increasing_id().alias("__row"),
            owner.alias("__owner"),
            repository.alias("__repository"),
            hashed(base_spans(text)).alias("__base"),
            hashed(wide_spans(text)).alias("__wide"),
        ),
        "secret-candidates",
    )


def hashed(spans: Column) -> Column:
    """Values leave the scan only as hashes."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("value_hash")
        ),
    )


def scan_secrets(
    docs: DataFrame,
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    keep: tuple[str, ...] = ("doc_id",),
    copied_owners: int = COPIED_OWNERS,
    salts: int = SALTS,
) -> DataFrame:
    """One row per row of ``docs``: ``keep``, spans, n_owned, n_copied, n_repositories.

    ``spans`` holds structs (start, kind, end, value_hash) sorted by start and
    kind; kinds number KINDS.  Owners default to the column ``source``,
    repositories to ``source`` and ``lang``.  A value with several owners is a
    copied example; ``n_repositories`` tells how widely the most widespread
    value of the row is copied, within its owner or beyond (0 without values).
    A null owner or repository counts
    as one of its own.  Texts that are null or empty have no spans; repeated
    rows each get their spans; an empty table gives an empty result.  Columns
    not in ``keep`` are ignored whatever their names.
    """
    owner = F.coalesce(owner if owner is not None else F.col("source").cast("string"), F.lit(""))
    repository = F.coalesce(repository if repository is not None else F.concat_ws("/", "source", "lang"), F.lit(""))
    found = scan(docs, text_col, owner, repository, list(keep))
    each = found.select(
        "__row", F.col("__owner").alias("owner"), F.col("__repository").alias("repository"), F.explode(F.concat("__base", "__wide")).alias("s")
    ).select("__row", "owner", "repository", "s.*")
    spread = value_owners(each).where((F.col("n_owners") >= copied_owners) | (F.col("n_repositories") > 1))
    copied = spread.select("value_hash", "n_repositories", (F.col("n_owners") >= copied_owners).alias("copied"))
    # A copied value may be in a third of all rows: its occurrences are dealt over the salts.
    salted = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    judged = each.withColumn("salt", F.pmod(F.col("__row"), F.lit(salts)).cast("int")).join(salted, ["value_hash", "salt"], "left")
    owned = ~F.coalesce("copied", F.lit(False))
    added = F.when(owned & (F.col("kind") == 3), F.struct("start", "kind", "end", "value_hash"))
    judged_rows = judged.groupBy("__row").agg(
        F.collect_list(added).alias("__added"), F.count_if(owned).alias("n_owned"), F.count_if(~owned).alias("n_copied"),
        F.max(F.coalesce("n_repositories", F.lit(1))).alias("n_repositories"),
    )
    joined = found.join(judged_rows, "__row", "left")
    nothing = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,value_hash:string>>)")
    return joined.select(
        *[F.col(f"`{c}`") for c in keep],
        F.array_sort(F.concat(F.col("__base"), F.coalesce(F.col("__added"), nothing))).alias("spans"),
        F.coalesce("n_owned", F.lit(0)).alias("n_owned"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("n_repositories", F.lit(0)).cast("long").alias("n_repositories"),
    )


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The secrets of every text of ``documents``; see ``scan_secrets``."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(described(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        described(F.col("spans")).alias("spans"),
        "n_owned",
        "n_copied",
        "n_repositories",
    )


def located_sql(name: str, pattern: str, kind: int, group: int, test: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
{name}_parts AS (
  SELECT row, generate_subscripts(m, 1) AS i, unnest(m) AS whole, unnest(v) AS value, unnest(g[1:len(m)]) AS gap
  FROM (SELECT row, regexp_extract_all(t, '{quoted}', 0) AS m, regexp_extract_all(t, '{quoted}', {group}) AS v,
               regexp_split_to_array(t, '{quoted}') AS g
        FROM texts)),
{name} AS (
  SELECT row, {kind} AS kind, e - length(whole) AS s, e, value
  FROM (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY row ORDER BY i) AS e FROM {name}_parts)
  WHERE {test})"""


OP1_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner,
         concat_ws('/', source, lang) AS repository
  FROM documents),
{located_sql("assign", ASSIGN, 0, 2, f"length(value) >= {ASSIGN_LEAST}")},
{located_sql("access", ACCESS, 1, 0, f"length(whole) >= {ACCESS_LEAST}")},
{located_sql("hexes", HEX, 2, 0, "true")},
{located_sql("wide", WIDE, 3, 0, "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')")},
spans AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hexes UNION ALL SELECT * FROM wide),
owners AS (
  SELECT value, count(DISTINCT owner) AS n_owners, count(DISTINCT struct_pack(o := owner, r := repository)) AS repositories
  FROM spans JOIN texts USING (row) GROUP BY value),
judged AS (SELECT spans.*, n_owners >= {COPIED_OWNERS} AS copied, repositories FROM spans JOIN owners USING (value)),
named AS (
  SELECT row, kind, s, copied, repositories,
         ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS span
  FROM judged),
summed AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
         count(*) FILTER (kind = 2) AS n_hex,
         string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
         string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3 OR NOT copied) AS spans,
         count(*) FILTER (NOT copied) AS n_owned, count(*) FILTER (copied) AS n_copied,
         max(repositories) AS n_repositories
  FROM named GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied,
       coalesce(n_repositories, 0) AS n_repositories
FROM texts LEFT JOIN summed USING (row)
"""
