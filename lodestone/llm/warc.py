"""Operator 2: WARC archives, written and read back with boundary-chain verification.

Writing: one record per page; of equal payloads of at least MIN_REVISIT bytes the smallest id is a response, the others
are revisits that refer to it and carry no payload. Records have the fields that WARC/1.1 asks for: a date, an id that no
other record has, for revisits the profile of identical payloads and the id of the record they refer to. The page id is
the target, urn:page:<id>. Archives are written by Spark's own text writer, uncompressed and so splittable, RECORDS in
each at most.

Reading: the files are split at every occurrence of the magic `WARC/1.1\\r\\n`, wherever tasks begin, so a task
sees candidates only. Each candidate whose header parses emits its offset and that of its successor (header, length,
two line ends). Pointer jumping from offset 0 of each file doubles the reach in every round; candidates that are not
reached lie inside payloads and are dropped. Payloads with magic inside are put together again from their pieces. A
revisit gets length, digest and page id of the record it refers to, as they were read.

Null payloads are empty; empty ones are responses. Payloads may hold any bytes. Pages without id are written and read with
a null id. Rows that repeat an id and a payload give a record each: of several smallest rows one is the response.
Payloads of any length are written and read whole. An empty table gives no records; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._common import Workspace, table

MIN_REVISIT, RECORDS = 100, 8192
MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def revisits(pages: DataFrame, ws: Workspace | None = None, *, id_col: str = "page_id", payload_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """id, payload (binary), digest, refers_to: the id of the response for a revisit, else null.

    Only payloads that occur twice are listed, in a table of their own, so that Spark sees its size: a small list is sent
    to the payloads, a large one is joined by shuffle. Rows are told apart by id and digest alone, never by their place in
    a scan; rows that share both are alike, so one of them is made the response and the others revisits by their count.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # the first id of each payload, and how many rows share it
    row = F.struct(F.col("id").isNull().alias("gone"), "id", "m")
    each = rows.filter(F.octet_length("payload") >= least).groupBy("digest", "id").agg(F.count("*").alias("m"))
    first = each.groupBy("digest").agg(F.min(row).alias("first"), F.sum("m").alias("n")).filter("n > 1").select("digest", "first")
    first = (ws or Workspace(pages.sparkSession, "warc")).keep("first", first)
    joined = rows.join(first, "digest", "left").withColumn("mine", F.col("first").isNull() | F.col("first.id").eqNullSafe(F.col("id")))
    alike = F.col("mine") & (F.coalesce("first.m", F.lit(1)) > 1)
    shown = ["id", "payload", "digest", F.when(F.col("mine"), None).otherwise(F.col("first.id")).alias("refers_to"), (~F.col("mine")).alias("revisit"), F.col("first").isNotNull().alias("shared")]
    if first.filter("first.m > 1").isEmpty():
        return joined.select(*shown)
    same = joined.filter(alike).groupBy("digest").agg(F.first("id").alias("id"), F.first("payload").alias("payload"), F.first("first").alias("first"))
    same = same.withColumn("mine", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("first.m")), lambda k: k == 1)))
    return joined.filter(~alike).select(*shown).unionByName(same.select(*shown))


def _name(digest: Column, id_: Column) -> Column:
    """A record id that follows from the payload and the page id."""
    h = F.md5(F.concat_ws(":", digest, F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))
    return F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def write_archives(records: DataFrame, path: str, *, date: str | None = None, records_per_archive: int = RECORDS) -> None:
    """records: id, payload, digest, refers_to, revisit, shared. date: of all records, now if none is given. A record that others refer to has the id that follows from it, all others a random one."""
    first = F.col("shared") & ~F.col("revisit")
    page = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    head = [
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), F.when(first, _name(F.col("digest"), F.col("id"))).otherwise(F.uuid()), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), page("id")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(F.col("revisit"), F.lit("WARC-Profile: " + PROFILE)),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), _name(F.col("digest"), F.col("refers_to")), F.lit(">"))),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To-Target-URI: "), page("refers_to"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("revisit"), 0).otherwise(F.octet_length("payload"))),
    ]
    # the text writer ends each row with END, which is what ends a record
    text = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *head), F.lit(END), F.when(F.col("revisit"), "").otherwise(F.col("payload").cast("string")))
    records.select(text.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_archive).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between occurrences of the magic, with file, split and place in the split."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))


def _place(pieces: DataFrame) -> DataFrame:
    """Adds size (the piece and its magic) and at, the offset of the magic before it: sums within a split and over the splits of a file. What stands before the first magic goes."""
    inside = Window.partitionBy("file", "split").orderBy("place")
    ahead = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    run = pieces.withColumn("end", F.sum("size").over(inside))
    before = pieces.groupBy("file", "split").agg(F.sum("size").alias("total")).select("file", "split", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("before"))
    return run.join(before, ["file", "split"]).withColumn("at", F.col("before") + F.col("end") - F.col("size") - len(MAGIC)).filter("at >= 0").drop("split", "place", "before", "end")


def candidates(pieces: DataFrame) -> DataFrame:
    """What the header after each magic says, without the payload: its digest if the piece holds all of it."""
    head, value = F.substring_index("value", END, 1), F.col("value")
    field = lambda name, form="[^\\r\\n]*": F.regexp_extract(head, rf"(?:^|\r\n){name}: ({form})(?:\r\n|$)", 1)
    rows = pieces.filter(F.octet_length(value) >= 0).select("file", "split", "place", value, (F.octet_length(value) + len(MAGIC)).cast("long").alias("size"), (F.octet_length(head) + len(END)).alias("body"), F.contains(value, F.lit(END)).alias("headed"), field("Content-Length", "[0-9]{1,18}").try_cast("long").alias("length"), field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("record"), field("WARC-Target-URI").alias("target"), field("WARC-Payload-Digest").alias("digest"), field("WARC-Refers-To").alias("refers_to"))
    payload = F.expr("substring(cast(value AS binary), body + 1, cast(length AS int))")
    full = F.octet_length(value) == F.col("body") + F.col("length") + len(END)
    return rows.withColumn("length", F.when(F.col("headed"), F.col("length"))).withColumn("read_digest", F.when(full, F.sha2(payload, 256))).drop("value", "headed")


def verify(ws: Workspace, found: DataFrame) -> DataFrame:
    """The candidates that pointer jumping from offset 0 of their file reaches."""
    jump = ws.keep("jump", found.filter("length is not null").select("file", "at", (F.col("at") + len(MAGIC) + F.col("body") + F.col("length") + len(END)).alias("to")))
    reach, n = ws.keep("reach", found.select("file", F.lit(0).cast("long").alias("at")).distinct()), 0
    while True:
        new = reach.unionByName(reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct()
        reach = ws.keep("reach", new)
        count = reach.count()
        if count == n:
            break
        n = count
        jump = ws.keep("jump", jump.alias("a").join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("far")), ["file", "to"]).select("file", "at", F.col("far").alias("to")))
    ws.free("jump")
    return found.join(reach, ["file", "at"])


def read_archives(spark: SparkSession, path: str, ws: Workspace | None = None) -> DataFrame:
    """A row per verified record: file, at, id, record, type, header_digest, and of the payload as it was read (a revisit's: that of the record it refers to, null if that isn't there): payload_bytes, payload_digest, refers_to (its page id)."""
    ws = ws or Workspace(spark, "warc")
    found = ws.keep("found", _place(ws.keep("pieces", candidates(_pieces(spark, path)))))
    ws.free("pieces")
    good = ws.keep("good", verify(ws, found))
    torn = good.filter("read_digest is null and length > 0").select("file", "at", "body", "length")
    if not torn.isEmpty():
        # payloads with magic inside: each piece belongs to the last true record before it in its file
        last = Window.partitionBy("file").orderBy("at")
        marks = found.select("file", "at").join(good.select("file", "at", F.col("at").alias("own")), ["file", "at"], "left").withColumn("own", F.last("own", True).over(last))
        parts = marks.join(torn.withColumnRenamed("at", "own"), ["file", "own"])
        pieces = _place(_pieces(spark, path).withColumn("size", (F.octet_length("value") + len(MAGIC)).cast("long")))
        whole = pieces.join(parts, ["file", "at"]).groupBy("file", "own", "body", "length").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("all"))
        value = F.array_join(F.transform("all", lambda x: x["value"]), MAGIC)
        mended = whole.withColumn("value", value).select("file", F.col("own").alias("at"), F.sha2(F.expr("substring(cast(value AS binary), body + 1, cast(length AS int))"), 256).alias("mended"))
        good = good.join(mended, ["file", "at"], "left").withColumn("read_digest", F.coalesce("read_digest", "mended"))
    number = F.regexp_extract("target", "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    read = F.coalesce("read_digest", F.when(F.col("length") == 0, F.sha2(F.lit(b""), 256)))
    good = ws.keep("read", good.select("file", "at", number.alias("id"), "record", "type", F.regexp_replace("digest", "^sha256:", "").alias("header_digest"), F.nullif("refers_to", F.lit("")).alias("target"), F.col("length").alias("payload_bytes"), read.alias("payload_digest")))
    again = good.filter("type = 'revisit'").drop("payload_bytes", "payload_digest")
    shown = good.filter("type != 'revisit'")
    named = shown.select(F.col("record").alias("target"), F.col("id").alias("refers_to"), "payload_bytes", "payload_digest")
    columns = ["file", "at", "id", "record", "type", "header_digest", "payload_bytes", "payload_digest", "refers_to"]
    return shown.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(again.join(named, "target", "left").select(*columns))


def archive(pages: DataFrame, path: str, ws: Workspace | None = None, *, id_col: str = "page_id", payload_col: str = "html") -> None:
    write_archives(revisits(pages, ws, id_col=id_col, payload_col=payload_col), path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "warc")
    path = f"{ws.root}/archives-{uuid.uuid4().hex[:6]}"
    archive(table(spark, sf_dir, "pages"), path, ws)
    got = read_archives(spark, path, ws)
    return got.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


ORACLE_SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha256(h) AS g, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, g AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM d
"""
}
