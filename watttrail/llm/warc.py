"""Content-addressed WARC archive: payload bytes stored once by SHA-256, record headers apart.

An archive is two tables in one folder. ``payloads`` has the bytes of each distinct payload once,
under their digest, and how many copies readers should make of it. ``records`` has the exact header block of every record with the digest of its
payload. ``read_archive`` joins them, verifies every payload against its digest and rebuilds the
records byte for byte.

Writing: a Bloom filter over the digests sends payloads that surely do not repeat straight to the
table; only those that may repeat are exchanged, one per digest and task. Reading: a payload with
many records is replicated once per ``RECORDS_PER_COPY`` of them and the records are spread over
the copies, so no task gets all records of a popular payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watttrail.llm.columns import pick
from watttrail.llm.exact_dedup import mark_repeats
from watttrail.operators.skew import lookup
from watttrail.session import stage

#: Payloads of fewer bytes are never revisited.
REVISIT_FROM = 100
RECORDS_PER_COPY = 128
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page: Column, row: Column) -> Column:
    """Name of a record; the id is percent-encoded, so it may hold any character."""
    name = F.url_encode(F.coalesce(page.cast("string"), F.lit("")))
    return F.concat(F.lit("<urn:page:"), name, F.lit(":"), row.cast("string"), F.lit(">"))


def _header() -> Column:
    """Header block of a record, ending with the empty line."""
    revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.col("url"), r"[\r\n]+", "")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page"), F.col("row"))),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("sha")),
        F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))  # concat_ws leaves null lines out


def write_archive(
    df: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    date_col: str | None = None,
) -> None:
    """Writes the archive of ``df`` to ``path``: a record for every row.

    Of records with equal payloads of at least ``REVISIT_FROM`` bytes, that with the smallest id
    (nulls last; of repeated rows one) is a response and the others revisit it. Smaller payloads
    are all responses. A null payload is empty; a null or empty URL leaves its header out or
    empty. An empty table writes an empty archive. Ids may hold any characters; other columns
    may have any names. A record's date is the timestamp ``date_col``, or ``date`` where there
    is none.
    """
    taken = {"page": id_col, "url": url_col, "text": payload_col} | ({"taken": date_col} if date_col else {})
    content = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    own = F.date_format(F.to_utc_timestamp("taken", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None)
    dated = F.coalesce(own, F.lit(date)).alias("date")
    named = pick(df, **taken).select("page", "url", dated, content.alias("payload"), F.sha2(content, 256).alias("sha"))
    narrow = stage(
        named.select("page", "url", "date", "sha", F.octet_length("payload").cast("long").alias("size")).withColumn("row", F.monotonically_increasing_id()),
        "records",
    )
    marked = mark_repeats(named.select("sha", "payload"), narrow)
    copies = F.ceil(F.col("n") / RECORDS_PER_COPY).cast("int").alias("copies")
    repeated = marked.where("may_repeat").groupBy("sha").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
    straight = marked.where(~F.col("may_repeat")).select("sha", "payload", F.lit(1).alias("copies"))
    payloads = straight.unionByName(repeated.select("sha", "payload", copies)).withColumnRenamed("sha", "digest")

    first = F.min(F.struct(F.col("page").isNull().alias("no_id"), "page", "row")).alias("first")
    groups = stage(narrow.groupBy("sha").agg(F.count("*").alias("n"), first), "groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    entries = groups.select("sha", "n", copies, F.col("first.page").alias("first_page"), F.col("first.row").alias("first_row"))
    records = lookup(narrow, entries, "sha", "n", total, "row")
    other = (F.col("row") != F.col("first_row")) & (F.col("size") >= REVISIT_FROM)
    records = records.withColumn("refers_to", F.when(other, _urn(F.col("first_page"), F.col("first_row"))))
    copy = F.pmod(F.xxhash64("row"), F.col("copies")).cast("int").alias("copy")
    records.select(_header().alias("header"), F.col("sha").alias("digest"), copy).write.option("compression", "zstd").parquet(f"{path}/records")
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: ``header``, ``record`` (its exact bytes), ``payload`` (in full,
    also of revisits), ``payload_digest``, and the fields ``record_type``, ``page``,
    ``refers_to`` read from the header.

    A payload that does not hash to its digest, or that is missing, raises an error.
    """
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads")
    spread = payloads.select("digest", "payload", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    joined = records.join(spread, ["digest", "copy"], "left")
    sound = F.sha2("payload", 256) == F.col("digest")
    checked = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload missing or damaged: "), F.col("digest"))))

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1), F.lit(""))

    out = joined.select("header", checked.alias("payload"), F.col("digest").alias("payload_digest"))
    kind = field("WARC-Type")
    block = F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    page_of = r"<urn:page:([^:]*):"
    return out.select(
        "header",
        F.concat(F.col("header").cast("binary"), block, F.lit(b"\r\n\r\n")).alias("record"),
        "payload",
        "payload_digest",
        kind.alias("record_type"),
        F.url_decode(F.regexp_extract(field("WARC-Record-ID"), page_of, 1)).alias("page"),
        F.url_decode(F.regexp_extract(field("WARC-Refers-To"), page_of, 1)).alias("refers_to"),
    )
