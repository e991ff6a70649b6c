"""Content-addressed WARC archive: payload bytes once, exact record headers apart, records by a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.session import shared_dir, stored

#: Payloads under this many bytes never become revisits.
LEAST_REVISIT = 1000
_EOL = "\r\n"


def write_archive(records: DataFrame, path: str, id_col: str, uri_col: str, payload_col: str, least: int = LEAST_REVISIT, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one WARC/1.1 record per row under path: ``payloads`` and ``headers`` (Parquet).

    payloads has each distinct payload once, by its SHA-256; equal digests are verified to have
    equal length and SHA-1, or the write fails. headers has each record's exact header block.
    Of records with equal payloads of at least ``least`` bytes, those with the largest id are
    response and the others revisit it (no block of their own). A text payload counts as UTF-8,
    a null one as empty; a null id or URI is left out of its header, and a record without an id is a
    revisit if a record with an id has its payload. Other columns are not read.
    Payloads of any length are stored whole, as one value; no rows give an archive without records; repeated rows give a record each.
    """
    data = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), data.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    once = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.max("id").alias("owner"), F.min(F.struct(F.length("payload"), F.sha1("payload"))).alias("x"), F.max(F.struct(F.length("payload"), F.sha1("payload"))).alias("y"))
    verified = F.when(F.col("x") == F.col("y"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have one digest")).cast("binary"))
    once.select("digest", verified.alias("payload"), "owner").write.parquet(f"{path}/payloads")
    owners = records.sparkSession.read.parquet(f"{path}/payloads").select("digest", "owner")
    heads = stored(rows.select("id", "uri", "digest", F.length("payload").alias("n")), "warc-heads").join(owners, "digest")
    revisit = (F.col("n") >= least) & F.col("owner").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("owner")))

    def line(name: str, *value):
        return F.concat(F.lit(f"{name}: "), *value, F.lit(_EOL))

    block = F.concat_ws(
        "",
        F.lit(f"WARC/1.1{_EOL}"),
        F.when(revisit, f"WARC-Type: revisit{_EOL}").otherwise(f"WARC-Type: response{_EOL}"),
        line("WARC-Record-ID", F.lit("<urn:record:"), F.col("id").cast("string"), F.lit(">")),
        line("WARC-Target-URI", F.regexp_replace("uri", r"[\r\n]+", " ")),
        F.lit(f"WARC-Date: {date}{_EOL}"),
        line("WARC-Payload-Digest", F.lit("sha256:"), F.col("digest")),
        F.when(revisit, line("WARC-Refers-To", F.lit("<urn:record:"), F.col("owner").cast("string"), F.lit(">"))),
        line("Content-Length", F.when(revisit, 0).otherwise(F.col("n")).cast("string")),
        F.lit(_EOL),
    )
    heads.select(block.alias("header"), "digest").write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per record: record_id, uri, record_type, refers_to, payload_digest (SHA-1), payload_bytes, parsed from the header and joined with the verified payload.

    A payload whose SHA-256 is not its address fails the read.
    """
    # the payloads' figures are stored by digest, so that the join with a very frequent digest can be split
    payloads = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.sha1("payload")).otherwise(F.raise_error(F.lit("a payload does not match its digest")))
    figures = payloads.select("digest", sound.alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes"))

    def field(pattern: str):
        return F.nullif(F.regexp_extract("header", pattern, 1), F.lit(""))

    heads = spark.read.parquet(f"{path}/headers").select(
        field(r"\r\nWARC-Record-ID: <urn:record:(-?\d+)>").cast("long").alias("record_id"),
        field(r"\r\nWARC-Target-URI: ([^\r]*)").alias("uri"),
        field(r"\r\nWARC-Type: (\w+)").alias("record_type"),
        field(r"\r\nWARC-Refers-To: <urn:record:(-?\d+)>").cast("long").alias("refers_to"),
        field(r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]+)").alias("digest"),
    )
    return heads.join(figures, "digest").drop("digest")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Per record: its exact bytes (header block, payload unless a revisit, and the two closing line ends)."""
    heads, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    block = F.when(F.col("header").contains("WARC-Type: revisit"), F.lit(b"")).otherwise(F.col("payload"))
    return heads.join(payloads, "digest").select("header", F.concat(F.encode("header", "UTF-8"), block, F.lit((_EOL * 2).encode())).alias("record"))


def archive_folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
