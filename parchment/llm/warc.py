"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Reading splits the files at every occurrence of the version line, in parallel and inside large files.
Each piece is a candidate record with its offset and the offset its Content-Length gives for its
successor.  Only candidates on the chain from the start of the file are records: runs of candidates in
which each one's successor is the next are contracted, and pointer jumping over the runs finds those
that the start reaches.  A version line inside a payload starts no reachable candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import new_path, saved, spread_join

VERSION = "WARC/1.1\r\n"
#: Records of a file at most; duplicated payloads that are broadcast at most.
FILE_RECORDS, BROADCAST_ROWS = 20_000, 100_000


def base32(hex_digits: Column) -> Column:
    """Bare upper-case base32 of an even number of 20-bit groups, from hex."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    five = lambda g, k: F.substring(letters, F.shiftright(g, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hex_digits, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    return F.array_join(F.transform(groups, lambda g: F.concat(*[five(g, k) for k in range(4)])), "")


def digest(payload: Column) -> Column:
    return base32(F.sha1(payload.cast("binary")))


def _uuid(uid: Column) -> Column:
    h = F.md5(F.concat(F.lit("record "), uid.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_archives(pages: DataFrame, path: str, smallest: int = 0) -> None:
    """Write one record a page to ``path``.

    ``pages``: page_id, url, html; other columns are left out.  The payload is the html in UTF-8, empty for
    null.  Of records with equal payloads of at least ``smallest`` bytes the one with the smallest page_id
    (null ids last, repeated rows in scan order) is the response and the others are revisits of it; smaller
    ones are all responses.  Line ends in a url become %0D and %0A.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    # numbered once, in a written table
    rows = saved(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("uid")), "pages")
    rows = rows.withColumn("digest", digest(F.col("payload")))
    first = F.min(F.struct(F.isnull("page_id").alias("none"), "page_id", "uid"))
    equal = rows.filter(F.octet_length("payload") >= smallest).groupBy(F.col("digest").alias("of")).agg(first.alias("first"), F.count("*").alias("n"))
    equal = saved(equal.filter("n > 1").select("of", F.col("first.uid").alias("first")), "equal-payloads")
    if equal.count() <= BROADCAST_ROWS:  # 40 bytes each; more are joined by shuffle
        equal = F.broadcast(equal)
    rows = rows.join(equal, rows["digest"] == equal["of"], "left")
    again = F.col("first").isNotNull() & (F.col("first") != F.col("uid"))
    end = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(f"{VERSION}WARC-Type: "), F.when(again, "revisit").otherwise("response"), end,
        F.lit("WARC-Record-ID: "), _uuid(F.col("uid")), end, F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, end), F.lit("")),
        F.coalesce(F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"), end), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), end,
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _uuid(F.col("first")), end)).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block, F.lit("\r\n\r"),
    )
    # the sink ends each value with the line separator: the last byte of the record
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", VERSION).text(path)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("piece"))


def _hashed(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("h1", F.xxhash64("value", F.lit(1))).withColumn("h2", F.xxhash64(F.lit(2), "value", F.octet_length("value")))


def _header(name: str, header: str = "header") -> Column:
    return F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)


def _fields(df: DataFrame) -> DataFrame:
    """Header fields and, where the piece holds the whole record, payload length and digest."""
    value = F.col("value")
    df = df.withColumn("header", F.when(F.instr(value, "\r\n\r\n") > 0, F.substring_index(value, "\r\n\r\n", 1)))
    df = df.withColumn("header_bytes", F.octet_length("header") + 4).withColumn("block_bytes", _header("Content-Length").try_cast("long")).withColumn("bytes", F.octet_length("value").cast("long"))
    raw = F.substring(value.cast("binary"), F.col("header_bytes") + 1, F.col("block_bytes").cast("int"))
    df = df.withColumn("whole", F.coalesce(F.col("bytes") - F.col("header_bytes") - F.col("block_bytes") == 4, F.lit(False)))
    df = df.withColumn("raw", F.when(F.col("whole"), raw))
    http = F.position(F.lit("\r\n\r\n").cast("binary"), F.col("raw"))
    df = df.withColumn("payload", F.when(F.col("whole"), F.when(http > 0, F.substring("raw", http + 4, F.octet_length("raw"))).otherwise(F.col("raw"))))
    return df.select(
        *[c for c in df.columns if c in ("file", "block", "piece", "h1", "h2")], "bytes", "header_bytes", "block_bytes", "whole",
        _header("WARC-Type").alias("record_type"), _header("WARC-Record-ID").alias("record_id"), _header("X-Page-ID").try_cast("long").alias("page_id"), _header("WARC-Refers-To").alias("refers_to_id"), _header("WARC-Target-URI").alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), digest(F.col("payload")).alias("payload_digest"),
    )


def _reached(runs: DataFrame) -> DataFrame:
    """(file, head) of the runs that offset 0 of their file reaches, by pointer jumping."""
    jump = saved(runs.select("file", "head", F.col("exit").alias("to")), "jumps")
    reached = jump.filter("head = 0").select("file", "head")
    seen = reached.count()
    while True:
        there = reached.join(jump, ["file", "head"]).select("file", F.col("to").alias("head"))
        there = there.join(jump.select("file", "head"), ["file", "head"], "left_semi")
        reached = saved(reached.unionByName(there).distinct(), "reached")
        now = reached.count()
        if now == seen:
            return reached
        seen = now
        onward = jump.select("file", F.col("head").alias("to"), F.col("to").alias("onward"))
        jump = saved(jump.join(onward, ["file", "to"], "left").select("file", "head", F.coalesce("onward", "to").alias("to")), "jumps")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives: record_id, record_type, page_id, url, refers_to_id, payload_bytes, payload_digest.

    Bytes and digest are those of the payload as stored, so a revisit has 0 bytes.  Pieces off the chain
    from the start of their file are payload; a file that doesn't start with a record has none.
    """
    pieces = saved(_fields(_hashed(_pieces(spark, path))), "pieces")
    order = Window.partitionBy("file").orderBy("block", "piece")
    start = F.coalesce(F.sum(F.col("bytes") + len(VERSION)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - len(VERSION)
    line = saved(pieces.select("file", "block", "piece", "h1", "h2", "whole", start.alias("off"), (start + len(VERSION) + F.col("header_bytes") + F.col("block_bytes") + 4).alias("next"), "bytes"), "offsets")
    by_offset = Window.partitionBy("file").orderBy("off")
    found = line.filter("next is not null and off >= 0").select("file", "block", "piece", "whole", "off", "next").withColumn("following", F.lead("off").over(by_offset))
    far = found.filter("following is null or following <> next").select("file", F.col("next").alias("off")).distinct().withColumn("target", F.lit(True))
    runs = found.join(far, ["file", "off"], "left").withColumn("head", F.coalesce(F.lag("next").over(by_offset) != F.col("off"), F.lit(True)) | F.coalesce("target", F.lit(False)))
    runs = saved(runs.withColumn("run", F.sum(F.col("head").cast("long")).over(by_offset)).select("file", "block", "piece", "whole", "off", "next", "run"), "runs")
    ends = saved(runs.groupBy("file", "run").agg(F.min("off").alias("head"), F.max("next").alias("exit")), "run-ends")
    good = ends.join(_reached(ends), ["file", "head"], "left_semi").select("file", "run")
    records = saved(runs.join(good, ["file", "run"], "left_semi"), "records")
    keys = ["file", "block", "piece"]
    simple = pieces.join(records.filter("whole").select(*keys), keys, "left_semi")
    names = ["record_id", "record_type", "page_id", "url", "refers_to_id", "payload_bytes", "payload_digest"]
    out = simple.select(*names)
    broken = records.filter("not whole")
    if broken.isEmpty():
        return out
    # payloads with the version line inside: the pieces up to the successor are joined again
    owner = line.join(records.select("file", "off", F.col("off").alias("own"), F.col("whole").alias("own_whole")), ["file", "off"], "left")
    owner = owner.withColumn("own", F.last("own", ignorenulls=True).over(by_offset)).withColumn("own_whole", F.last("own_whole", ignorenulls=True).over(by_offset)).filter("not own_whole")
    # they are known again by their bytes: another scan may split the files elsewhere
    parts = saved(owner.select("file", "h1", "h2", "off", "own"), "parts")
    wanted = saved(parts.select("h1", "h2").distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = _hashed(_pieces(spark, path)).select("h1", "h2", "value").join(wanted, ["h1", "h2"], "left_semi")
    texts = saved(texts.groupBy("h1", "h2").agg(F.first("value").alias("value")), "part-texts")
    values = spread_join(parts, texts, ["h1", "h2"])
    whole = values.groupBy("file", "own").agg(F.sort_array(F.collect_list(F.struct("off", "value"))).alias("parts"))
    whole = whole.select("file", F.lit(0).alias("block"), F.lit(0).alias("piece"), F.array_join("parts.value", VERSION).alias("value"))
    return out.unionByName(_fields(whole).filter("whole").select(*names))


def resolved(records: DataFrame) -> DataFrame:
    """Records with the full payload's bytes and digest: a revisit takes them from the response it refers to."""
    response = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"))
    own = records.filter("record_type = 'response'").select("record_id", "record_type", "page_id", "url", "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"))
    revisit = records.filter("record_type = 'revisit'").join(response, "refers_to_id", "left")
    return own.unionByName(revisit.select("record_id", "record_type", "page_id", "url", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "refers_to"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives (to a new folder of the shared one, or ``path``), read them back and resolve revisits."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return resolved(saved(read_archives(pages.sparkSession, path), "read-back"))
