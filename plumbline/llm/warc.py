"""WARC archives written and read by Spark's text files, records found by their boundary chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import folder, keep, lookup, small

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Records written to one archive.
RECORDS = 20_000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: eight groups of five hex digits, four symbols each."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.upper(F.conv(F.substring(digits, i, 5), 16, 32)), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(df: DataFrame, id_col: str, payload: Column, least_bytes: int = 0) -> DataFrame:
    """(id, sha, refers_to) of rows whose payload, with that SHA-256, equals that of a row with a larger id, which refers_to names.

    A payload shared by a third of all rows is resolved by a broadcast row; see common.lookup.
    """
    rows = df.select(F.col(id_col).alias("id"), F.octet_length(payload).alias("size"), F.unhex(F.sha2(payload, 256)).alias("sha"))
    rows = keep(rows.where(F.col("size") >= least_bytes), "payloads")
    groups = rows.groupBy("size", "sha").agg(F.max("id").alias("refers_to"), F.count("*").alias("times")).where("times > 1")
    found = lookup(rows, keep(groups, "shared"), ["size", "sha"], "times", ["refers_to"])
    return found.where("id < refers_to").select("id", "sha", "refers_to")


def _urn(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, records: int = RECORDS) -> None:
    """One record per row: a response, or a revisit of the equal payload with the largest id.

    Payloads below `least_bytes` are always responses. A revisit has no payload of its own. Null payloads are
    empty; line breaks in urls are percent-encoded; null urls and null ids give empty fields; an empty
    table gives no record. Rows are written where they were read unless revisits are too many to broadcast.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    again = keep(revisits(df, id_col, payload, least_bytes), "revisits").distinct()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("sha"))
    rows = rows.join(small(again), ["id", "sha"], "left")  # an id may come with several payloads
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(_urn(F.col("id")), F.lit(""))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))),
        F.when(revisit, line("WARC-Refers-To", _urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        F.lit("Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
    )
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records).text(path)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place of the archives where the magic stands, with the stretch up to the next one.

    Files are split; a task knows the places within its own split, which are added to the sums of the splits
    before. Columns: file, at, size, head (null without a header end), clen, next (null if the header
    does not parse), whole (the record ends where its stretch ends), payload_bytes, payload_digest of
    whole records, sha (of the stretch). Stretches themselves are not kept.
    """
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", MAGIC).text(path)
    end = F.locate(END, F.col("value"))
    data = F.col("value").cast("binary")
    rows = raw.select(
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("split"),
        F.monotonically_increasing_id().alias("seq"),
        (F.octet_length("value") + len(MAGIC)).cast("long").alias("size"),
        F.when(end > 0, F.substring_index("value", END, 1)).alias("head"),
        data.alias("data"),
    )
    length = F.expr("try_cast(clen as bigint)")
    start = F.octet_length("head") + len(END)
    rows = rows.withColumn("clen", _field("Content-Length")).withColumn("clen", length)
    rows = rows.withColumn("need", (start + F.col("clen") + len(END) + len(MAGIC)).cast("long"))
    # The stretch's own magic is the separator before it, so sizes and places agree but for the file's first.
    exact = F.col("need") == F.col("size")
    body = F.expr(f"substring(data, octet_length(head) + {len(END)} + 1, int(clen))")
    rows = rows.withColumn("payload", F.when(exact, body)).select(
        "file", "split", "seq", "size", "head", "clen", "need", F.coalesce(exact, F.lit(False)).alias("whole"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("payload").isNotNull(), base32_sha1(F.col("payload"))).alias("payload_digest"),
        F.unhex(F.sha2("data", 256)).alias("sha"),
    )
    rows = keep(rows, "stretches")
    inside = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "split").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["file", "split"])
    # A stretch starts behind its separator: its record's magic stands one magic earlier.
    at = F.col("base") + F.col("within") - len(MAGIC)
    out = placed.withColumn("at", at).withColumn("next", F.col("at") + F.col("need"))
    return out.drop("split", "seq", "base", "within", "need")


def reachable(links: DataFrame) -> DataFrame:
    """(file, at) of the records that the chain from each file's start visits, by pointer jumping.

    links: (file, at, next). Each round marks the successors of what is marked and lets every pointer
    skip as far again, so rounds grow with the logarithm of the records in a file. Each place has one pointer, so
    no round has more rows than the first.
    """
    jump = keep(links.where("next is not null and next > at"), "jump")
    known = jump.select("file", "at")
    reach = keep(known.where("at = 0"), "reach")
    longest = known.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):
        step = reach.join(jump, ["file", "at"]).select("file", F.col("next").alias("at")).join(known, ["file", "at"], "left_semi")
        reach = keep(reach.union(step).distinct(), "reach")
        hop = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = keep(jump.join(hop, ["file", "next"]).select("file", "at", F.col("far").alias("next")), "jump")
    return reach


def read(spark: SparkSession, path: str) -> DataFrame:
    """The verified records: file, offset, record_id, record_type, target_uri, refers_to, payload_bytes,
    payload_digest (base-32 SHA-1 of the payload read), declared_digest, head, sha.

    Only records on the chain from the start of their file count, so a magic inside a payload is no
    record. A payload that holds one stands in several stretches; these are fetched again by their hash and
    put together. A file that does not start with a record gives none; a chain ends at the first
    record whose header does not parse.
    """
    all_ = keep(candidates(spark, path), "candidates")
    found = reachable(all_.select("file", "at", "next"))
    own = keep(all_.join(found, ["file", "at"], "left_semi"), "records")
    whole = own.where("whole").select("file", "at", "head", "clen", "sha", "payload_bytes", "payload_digest")
    parted = keep(own.where("not whole").select("file", "at", "head", "clen", "next"), "parted")
    if parted.limit(1).count():
        whole = whole.unionByName(assembled(spark, path, all_, parted), allowMissingColumns=True)
    return whole.select(
        "file", F.col("at").alias("offset"), _field("WARC-Record-ID").alias("record_id"), _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("target_uri"), _field("WARC-Refers-To").alias("refers_to"), "payload_bytes", "payload_digest",
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("declared_digest"), "head", "sha",
    )


def assembled(spark: SparkSession, path: str, all_: DataFrame, parted: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: the stretches from their start to their end, joined in order.

    Stretches of a file meet the records of that file by blocks of bytes, so neither side pairs with all of the other.
    """
    block = 1 << 20
    spans = F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(next - 1) div {block}"))).alias("block")
    held = parted.select("file", F.col("at").alias("owner"), "next", "clen", F.col("head").alias("own_head"), spans)
    parts = all_.select("file", "at", "sha", F.expr(f"at div {block}").alias("block")).join(held, ["file", "block"])
    parts = keep(parts.where("at >= owner and at < next").select("file", "owner", "own_head", "clen", "at", "sha"), "parts")
    wanted = small(keep(parts.select("sha").distinct(), "wanted"))
    data = spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("data"))
    data = data.withColumn("sha", F.unhex(F.sha2("data", 256))).join(wanted, "sha", "left_semi").dropDuplicates(["sha"])
    rows = parts.join(data, "sha").groupBy("file", "owner", "own_head", "clen").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("p"))
    text = F.aggregate(F.slice("p", 2, 1 << 30), F.expr("element_at(p, 1).data"), lambda a, x: F.concat(a, F.lit(MAGIC).cast("binary"), x["data"]))
    rows = rows.withColumn("data", text)
    payload = F.expr(f"substring(data, octet_length(own_head) + {len(END)} + 1, int(clen))")
    return rows.withColumn("payload", payload).select(
        "file", F.col("owner").alias("at"), F.col("own_head").alias("head"), "clen", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )


def payloads(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """The payloads, as bytes, of whole records of `read`, fetched by the hash of their stretch."""
    data = spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("data"))
    data = data.withColumn("sha", F.unhex(F.sha2("data", 256))).dropDuplicates(["sha"])
    body = F.expr(f"substring(data, octet_length(head) + {len(END)} + 1, int(payload_bytes))")
    return records.where("sha is not null").join(data, "sha").withColumn("payload", body).drop("data")


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back: id, payload_bytes, payload_digest, record_type, refers_to.

    The figures of a revisit are those read from the response with the id it names and the digest it declares. Rows
    without id, and rows with a repeated id, are records of their own, whatever their payloads.
    """
    spark = df.sparkSession
    path = path or folder(spark, "warc")
    write(df, path, id_col, url_col, payload_col, least_bytes)
    records = keep(read(spark, path), "read")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    rows = records.select(number("record_id").alias("id"), "payload_bytes", "payload_digest", "declared_digest", "record_type", number("refers_to").alias("refers_to"))
    first = rows.where("record_type = 'response'").select("id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = rows.where("record_type = 'revisit'").select("id", "refers_to", F.col("declared_digest").alias("digest"))
    counts = again.groupBy("refers_to", "digest").agg(F.count("*").alias("times"))
    named = first.select(F.col("id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest")).dropDuplicates(["refers_to", "digest"])
    named = keep(named.join(counts, ["refers_to", "digest"]), "named")
    resolved = lookup(again, named, ["refers_to", "digest"], "times", ["bytes"])
    resolved = resolved.select("id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return first.unionByName(resolved).withColumnRenamed("id", id_col)
