"""HTTP response headers as rows, and what they decide about a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.functions import text
from tonelake.operators import lookups


def fields(rows: DataFrame) -> DataFrame:
    """(conn_id, line_no, name, value) of (conn_id, line_no, line); a line without a colon is all name."""
    at = text.index_of(F.col("line"), ":")
    name = F.when(at < 0, F.col("line")).otherwise(F.substring_index("line", ":", 1))
    return rows.select("conn_id", "line_no", F.lower(name).alias("name"), F.when(at >= 0, text.trim(text.remove_before(F.col("line"), ":", keep=False))).alias("value"))


def summary(rows: DataFrame) -> DataFrame:
    """One row per connection: its typed header values, kind of content, and state.

    ``state`` is redirect, error (status over 310, gzip, or no known content type) or ok; ``stream_type`` is webfile with a
    content length unless stream headers are there, else webstream.
    """
    f = fields(rows)

    def last(name: str):
        return F.max_by(F.when(F.col("name") == name, F.col("value")), F.when(F.col("name") == name, F.col("line_no")))

    texts = {n.replace("-", "_"): last(n) for n in ("icy-genre", "icy-logo", "icy-name", "icy-url", "icy-description", "content-type", "content-encoding", "location", "content-disposition")}
    status = F.max(F.when(F.startswith("name", F.lit("http/")), F.regexp_extract("name", r"^http/\S+\s+(\d+)", 1).try_cast("int")))
    icy = F.max(F.startswith("name", F.lit("icy-")))
    out = f.groupBy("conn_id").agg(
        status.alias("status"), icy.alias("icy"), *[v.alias(k) for k, v in texts.items()], text.to_int(last("icy-metaint")).alias("metaint"), (text.to_int(last("icy-br")) * 1000).alias("nominal_bitrate"),
        text.to_int(last("content-length")).alias("content_length"), F.max((F.col("name") == "transfer-encoding") & F.endswith(F.lower("value"), F.lit("chunked"))).alias("chunked"),
        F.max((F.col("name") == "accept-ranges") & F.endswith(F.lower("value"), F.lit("bytes"))).alias("accept_ranges"), F.max((F.col("name") == "connection") & F.contains(F.lower("value"), F.lit("close"))).alias("close"),
    )
    out = lookups.with_mime_kind(out)
    filename = F.nullif(F.replace(F.regexp_extract("content_disposition", r"(?i)filename=(.*)$", 1), F.lit('"'), F.lit("")), F.lit(""))
    bad = (F.coalesce("status", F.lit(200)) > 310) | F.coalesce(F.contains("content_encoding", F.lit("gzip")), F.lit(False)) | F.col("kind").isNull()
    state = F.when(F.col("location").isNotNull(), "redirect").when(bad, "error").otherwise("ok")
    return out.withColumn("filename", filename).withColumn("state", state).withColumn("stream_type", stream_type()).drop("content_disposition")


def stream_type(speech: bool = False):
    """webfile for a content length without stream headers; speech is always a stream."""
    return F.when(F.lit(not speech) & (F.coalesce("content_length", F.lit(0)) > 0) & ~F.coalesce("icy", F.lit(False)), "webfile").otherwise("webstream")
