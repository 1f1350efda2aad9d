"""Exact dedup by progressive refinement, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, keep, lookup

#: Characters of the text that the second level hashes.
PREFIX = 64


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, prefix: int = PREFIX) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, and the `carry` columns.

    Level 1 groups by byte length, level 2 by length and a hash of the first `prefix` characters;
    both come from one scan that keeps two numbers a row. Only rows whose level-2 group has
    company get level 3, SHA-256 of the full text, in a second scan. When the surviving groups are few
    (counted) they are broadcast and other rows are never hashed; else the hash is taken beside the
    scan, so that a row moves 60 bytes and never its text.

    Defined cases: a null text equals the empty text; of equal texts the row with the largest id
    stays, null ids sort first, and of repeated rows with that id exactly one stays; an empty table
    gives an empty result; other columns of `df` play no part.
    """
    carry = carry or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = df.select(
        F.col(id_col).alias("__id"),
        F.octet_length(text).cast("long").alias("__len"),
        F.xxhash64(F.substring(text, 1, prefix)).alias("__head"),
        text.alias("__text"),
        *[c.alias(n) for n, c in carry.items()],
    )
    heads = keep(narrow.groupBy("__len", "__head").agg(F.count("*").alias("__n")), "heads")
    lengths = heads.groupBy("__len").agg(F.sum("__n").alias("__rows")).where("__rows > 1")
    shared = heads.where("__n > 1").join(lengths.select("__len"), "__len", "left_semi")
    shared = keep(shared.withColumn("__shared", F.lit(True)), "shared")
    full = F.unhex(F.sha2("__text", 256))
    if shared.count() <= BROADCAST_ROWS:
        rows = narrow.join(F.broadcast(shared), ["__len", "__head"], "left").withColumn("__sha", F.when(F.col("__shared"), full))
    else:
        hashed = narrow.withColumn("__sha", full).drop("__text")
        rows = lookup(hashed, shared, ["__len", "__head"], "__n", ["__shared"]).withColumn("__sha", F.when(F.col("__shared"), F.col("__sha")))
    rows = keep(rows.select("__id", "__len", "__sha", F.monotonically_increasing_id().alias("__row"), *carry), "rows")
    sets = (
        rows.where("__sha is not null")
        .groupBy("__len", "__sha")
        .agg(F.max(F.struct("__id", "__row")).alias("__stays"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    out = lookup(rows, keep(sets, "sets"), ["__len", "__sha"], "group_size", ["__stays", "group_size"])
    alone = F.col("__stays").isNull()
    return out.select(
        F.col("__id").alias(id_col),
        F.when(alone, F.col("__id")).otherwise(F.col("__stays.__id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("__row") == F.col("__stays.__row"))).alias("kept"),
        *carry,
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay, with all their columns; the cases are those of exact_groups.

    Dropped ids are matched together with a hash of the text, so a repeated id with another text
    stays. Of repeated rows with one id and one text, the one with the greatest columns stays.
    """
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    verdict = keep(exact_groups(df, id_col, text_col, {"__text_sha": sha}).where("group_size > 1"), "verdict")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__key")
    tally = verdict.groupBy(key, "__text_sha").agg(F.max("kept").alias("__stays"), F.count("*").alias("__times"))
    tally = keep(tally.where("not __stays or __times > 1"), "dropped")
    side = F.broadcast(tally) if tally.count() <= BROADCAST_ROWS else tally
    marked = df.withColumn("__key", key).withColumn("__text_sha", sha).join(side, ["__key", "__text_sha"], "left")
    single = marked.where("__stays is null").select(*df.columns)
    if not tally.where("__stays").limit(1).count():
        return single
    repeated = marked.where("__stays").groupBy("__key", "__text_sha").agg(F.max(F.struct(*df.columns)).alias("__one"))
    return single.unionByName(repeated.select("__one.*"))
