"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keep, small, words

#: Permitted sequence lengths in words, and items packed together.
LENGTHS = (512, 1024, 2048, 4096)
GROUP = 2048
#: A sequence costs OVERHEAD + length + length^2 / QUADRATIC, as attention does.
OVERHEAD, QUADRATIC = 64, 16_384


def cost(length: int, overhead: int = OVERHEAD, quadratic: int = QUADRATIC) -> float:
    return overhead + length + length * length / quadratic


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int]]:
    """Bin of each item, and the length of each bin; items come in falling order of size.

    An item goes where it leaves the least room. If it fits nowhere, the length opened is the one of
    least cost per word, counting the item and what the rest could still add; in the end each bin
    shrinks to the shortest length that holds its contents.
    """
    lengths = tuple(sorted(lengths))
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    used: list[int] = []
    bins: list[int] = []
    rest = sum(sizes)
    for n in sizes:
        rest -= n
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            fits = [c for c in lengths if c >= n]
            free, b = min(fits, key=lambda c: (cost(c) / (n + min(c - n, rest)), -c)), len(used)
            used.append(0)
        bins.append(b)
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return bins, [lengths[bisect_left(lengths, u)] for u in used]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LENGTHS[-1], with_text: bool = False) -> DataFrame:
    """(id, piece, start, n, spread, text): every row's words in stretches of at most `longest` words."""
    size = words(text_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), size.alias("size"), F.xxhash64(id_col, text_col).alias("spread")).where("size > 0")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {longest}")))
    if not with_text:
        rows = rows.drop("text").select("*", at.alias("piece"))
    else:
        each = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
        rows = rows.withColumn("each", F.when(F.col("size") > longest, each)).select("*", at.alias("piece"))
        cut = F.rtrim(F.array_join(F.slice("each", (F.col("piece") * longest + 1).cast("int"), longest), ""))
        rows = rows.withColumn("text", F.when(F.col("size") > longest, cut).otherwise(F.col("text")))
    start = F.col("piece") * longest
    out = rows.select("id", "piece", start.alias("start"), F.least(F.lit(longest).cast("long"), F.col("size") - start).alias("n"), "spread", *(["text"] if with_text else []))
    return out


def _placed(rows: pd.DataFrame, group: int, lengths: tuple[int, ...]) -> pd.DataFrame:
    rows = rows.sort_values(["n", "id", "piece", "spread"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
    bins, caps = best_fit(rows["n"].tolist(), lengths)
    rows["seq_id"] = [group * 2**24 + b for b in bins]
    rows["length"] = [caps[b] for b in bins]
    rows["offset"] = rows.groupby("seq_id")["n"].cumsum() - rows["n"]
    return rows.drop(columns="group")


def _packed(lengths: tuple[int, ...]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _placed(rows, key[0], lengths)

    return run


def _sequences(lengths: tuple[int, ...]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bins = _placed(rows, key[0], lengths).groupby(["seq_id", "length"], sort=False)
        out = bins.agg(used=("n", "sum"), doc_ids=("id", list), starts=("start", list), sizes=("n", list), text=("text", "\n".join))
        return out.reset_index()

    return run


def deal(items: DataFrame, group: int = GROUP) -> DataFrame:
    """Items with a group number each; the number of groups follows the number of items.

    Items equal in id, text and piece have one hash; where more than `group` are equal, each goes by its own
    row number, which stays what it is while the input is read in the same partitions, as a table is.
    """
    alike = items.groupBy("spread", "piece").agg(F.count("*").alias("alike"))
    total, hot = alike.agg(F.coalesce(F.sum("alike"), F.lit(0)), F.count_if(F.col("alike") > group)).first()
    groups = F.lit(max(1, total // group))
    if not hot:
        return items.withColumn("group", F.pmod(F.xxhash64("spread", "piece"), groups))
    many = keep(alike.where(F.col("alike") > group), "repeats")
    marked = items.withColumn("row", F.monotonically_increasing_id()).join(small(many), ["spread", "piece"], "left")
    salt = F.when(F.col("alike").isNotNull(), F.col("row"))
    dealt = marked.withColumn("group", F.pmod(F.xxhash64("spread", "piece", salt), groups))
    return dealt.select(*items.columns, "group")


def pack(items: DataFrame, lengths: tuple[int, ...] = LENGTHS, group: int = GROUP) -> DataFrame:
    """Items (id, piece, start, n, spread) with seq_id, length and offset within the sequence.

    Items are dealt by hash into groups of about `group`, each packed in a task of its own. A group
    holds thousands of items of at most the longest length, so its bins are about as full as one global packing
    would make them, and its memory is bounded.

    Defined cases: rows with no words have no item; ties in size go by id, then piece; repeated rows
    are packed each, a third of all rows being alike included; an empty table gives an empty result.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    dealt = deal(items, group).groupBy("group")
    return dealt.applyInPandas(_packed(tuple(sorted(lengths))), f"{fields}, seq_id long, length int, offset long")


def packed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """One row per piece of every row of `df`, and one without sequence for a row that has no words."""
    placed = pack(pieces(df, id_col, text_col, max(lengths)), lengths)
    out = placed.select(F.col("id").alias(id_col), "piece", "start", F.col("n").alias("n_words"), "seq_id", "length", "offset")
    none = df.where(words(text_col) == 0).select(F.col(id_col), F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_words"))
    return out.unionByName(none, allowMissingColumns=True)


def sequences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """One row per packed sequence: seq_id, length, used, the ids, first words and sizes of its pieces, its text.

    Ids are integers. Pieces move once, with their text, to the task that packs them; the cases are those of `pack`.
    """
    items = pieces(df.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, max(lengths), with_text=True)
    schema = "seq_id long, length int, used long, doc_ids array<long>, starts array<long>, sizes array<long>, text string"
    return deal(items).groupBy("group").applyInPandas(_sequences(tuple(sorted(lengths))), schema)
