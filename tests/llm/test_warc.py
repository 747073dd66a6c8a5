import base64
import hashlib

import parchment.llm.warc as W
from parchment.llm.warc import VERSION, read_archives, round_trip, write_archives
from parchment.llm.store import new_path

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        key = (page is None, page or 0)
        if raw not in first or key < first[raw]:
            first[raw] = key
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        d = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = first[raw] != (page is None, page or 0)
        out.append((page, len(raw), d, "revisit" if again else "response", first[raw][1] if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def pages():
    inner = f"{VERSION}WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    lying = f"{VERSION}WARC-Type: response\r\nContent-Length: 999999\r\n\r\nabc"
    return [
        (1, "http://a/", "<p>x</p>"), (2, None, None), (3, "http://a/\r\nb", ""), (4, "u", VERSION), (5, "u", VERSION * 3 + "tail"),
        (6, "u", f"a {inner} b"), (7, "u", inner * 4), (8, "u", lying), (9, "u", "é\n\r\nß" * 500), (10, "u", "<p>x</p>"), (11, "u", inner * 4),
        (12, "u", "x" * 50_000 + inner + "y" * 50_000), (None, "u", "only"), (13, "u", "﻿WARC/1.1"), (0, "u", "\r\n\r\n"),
    ]


def test_magic_inside_payloads_nulls_and_ties(spark):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 4):
        assert got(round_trip(df.repartition(parts, "page_id") if parts > 1 else df.coalesce(1))) == expected(rows)


def test_files_are_split(spark):
    rows = [(k, "u", pages()[k % len(pages())][2]) for k in range(60)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        assert got(round_trip(spark.createDataFrame(rows, SCHEMA).coalesce(1))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_repeated_rows_have_one_response(spark):
    out = got(round_trip(spark.createDataFrame([(7, "u", "same")] * 3, SCHEMA)))
    assert [r[3] for r in out].count("response") == 1 and {r[4] for r in out} == {None, 7}


def test_empty_table_and_foreign_file(spark):
    assert got(round_trip(spark.createDataFrame([], SCHEMA))) == []
    path = new_path(spark, "foreign")
    spark.createDataFrame([("no archive at all",)], "value string").coalesce(1).write.text(path)
    assert read_archives(spark, path).count() == 0


def test_query_on_the_table(spark, sf):
    from parchment.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(QUERIES["op4_warc"](spark, sf)) == expected(rows)


def test_splits_that_change_between_scans(spark):
    """Executors that come or go change the splits: records with the version line inside are still whole."""
    rows = [(k, "u", (VERSION * 3 + f"tail {k}") if k % 2 else f"plain {k} " * 300) for k in range(20)]
    path = new_path(spark, "changing")
    write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    read = W._hashed

    def other_splits(pieces):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
        return read(pieces)

    try:
        records = read_archives(spark, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        assert sorted(r.page_id for r in records.collect()) == list(range(20))
        W._hashed = other_splits
        assert sorted(r.page_id for r in read_archives(spark, path).collect()) == list(range(20))
    finally:
        W._hashed = read
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
