"""Exact duplicates by skew-safe combining of digest groups.

Three combining steps, each of which compares the full text because the text is
part of the grouping key beside its digest:

1. every task merges the equal texts it has read (map-side aggregation);
2. these are merged per digest and salt, the salt being taken from the id, so
   that a text with a third of all rows is spread over ``salts`` reducers;
3. at most ``salts`` winners per text are merged into the final group.

Rows find their group by digest afterwards, without moving texts again.  Digests
that stand for two different texts are recognised and matched by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import whole_text, written

SALTS = 32


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def text_groups(keyed: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, text, keep_id, group_size), one row per different text."""
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    merged = salted.groupBy("digest", "salt", "text").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    return merged.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    Texts are equal when identical; null counts as empty.  The largest id of a
    group is kept.  Repeated rows count in the group size and get the same
    answer.  A null id never is the largest unless all ids of the group are
    null, when ``keep_id`` is null and the rows count as kept.  An empty table
    gives an empty result.  Other columns are ignored.
    """
    text = whole_text(text_col)
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), digest(text).alias("digest"))
    found = text_groups(keyed, salts)
    # The text is left out; its length and digest tell which texts shared a digest.
    groups = written(found.select("digest", "keep_id", "group_size"), "exact-groups")
    shared = groups.groupBy("digest").count().where("count > 1").select("digest")
    if shared.isEmpty():
        rows = keyed.select("id", "digest").join(groups, "digest")
    else:
        alone = keyed.select("id", "digest").join(shared, "digest", "left_anti").join(groups, "digest")
        clash = keyed.join(shared, "digest", "left_semi")
        matched = clash.join(text_groups(clash, salts), ["digest", "text"]).select("digest", "id", "keep_id", "group_size")
        rows = alone.select("digest", "id", "keep_id", "group_size").unionByName(matched)
    return rows.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, one per text, with all their columns.

    Of rows repeated with the same id and text one stays.
    """
    columns = docs.columns
    kept = exact_groups(docs, id_col, text_col, salts).where("kept").select(F.col(id_col).alias("__id"), F.col("digest").alias("__digest"))
    kept = kept.dropDuplicates(["__id", "__digest"])
    keyed = docs.withColumn("__own", sha256(whole_text(text_col)))
    same = keyed[f"`{id_col}`"].eqNullSafe(kept["__id"]) & (keyed["__own"] == kept["__digest"])
    joined = keyed.join(kept, same, "left_semi")
    return joined.dropDuplicates([id_col, "__own"]).select(*[f"`{c}`" for c in columns])


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
