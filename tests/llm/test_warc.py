import base64
import gzip
import hashlib

import pytest
from pyarrow.fs import FileSystem

from curaloom.llm import warc
from curaloom.storage import new_path


def pages(spark):
    rows = [(1, "http://a.example/ü?q=1 2", "<p>same</p>"), (2, "http://b.example/", "<p>same</p>"), (3, None, None), (4, "x\r\ny: z", ""), (5, "u", "ä" * 50_000), (None, "n", "<p>same</p>"), (9, "r", "twice"), (9, "r", "twice"), (None, "m", "alone")]
    return spark.createDataFrame([r + ("c", "d") for r in rows], "page_id bigint, url string, html string, id string, size string").repartition(3)


def test_round_trip(spark):
    index = warc.write_archives(pages(spark), roll_bytes=400)
    got = warc.read_records(index, most=300).collect()
    assert len(got) == 9
    by_id = {}
    for r in got:
        by_id.setdefault(r["id"], []).append(r)
    assert {(r["record_type"], r["refers_to"]) for r in by_id[1]} == {("revisit", 2)} and by_id[2][0]["record_type"] == "response"
    assert {(r["record_type"], r["refers_to"]) for r in by_id[3]} == {("revisit", 4)}  # null is the empty payload
    assert [r["record_type"] for r in by_id[9]] == ["response", "response"]
    assert sorted(r["record_type"] for r in by_id[None]) == ["response", "revisit"]
    assert bytes(by_id[5][0]["payload"]) == ("ä" * 50_000).encode() and by_id[5][0]["payload_bytes"] == 100_000
    assert by_id[5][0]["payload_digest"] == base64.b32encode(hashlib.sha1(("ä" * 50_000).encode()).digest()).decode()


def test_selected_records_and_small_payloads(spark):
    index = warc.write_archives(pages(spark), at_least=20)
    assert {r["record_type"] for r in index.collect()} == {"response"}
    got = warc.read_records(index.where("id = 5 OR id = 1")).collect()
    assert sorted(r["id"] for r in got) == [1, 5]


def test_files_are_plain_archives(spark):
    """Without the index: whole files are valid gzip, and records lie end to end."""
    index = warc.write_archives(pages(spark)).collect()
    for name in {r["file"] for r in index}:
        files, path = FileSystem.from_uri(name)
        data = files.open_input_file(path).read()
        own = sorted((r["offset"], r["length"]) for r in index if r["file"] == name)
        assert own[0][0] == 0 and sum(n for _, n in own) == len(data) and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        text = gzip.decompress(data)
        assert text.count(b"WARC/1.1\r\n") == len(own)


def test_damage_is_noticed(spark):
    index = warc.write_archives(pages(spark).where("page_id = 5"))
    files, path = FileSystem.from_uri(index.first()["file"])
    data = bytearray(files.open_input_file(path).read())
    bad = warc.member(gzip.decompress(bytes(data)).replace("ä".encode(), "ö".encode(), 1), 4)
    with files.open_output_stream(path, compression=None) as f:
        f.write(bad)
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read_records(index.withColumn("length", F.lit(len(bad)).cast("bigint"))).collect()


def test_empty(spark):
    index = warc.write_archives(pages(spark).limit(0), folder=new_path(spark, "warc"))
    assert index.count() == 0 and warc.read_records(index).count() == 0


def test_reads_are_dealt_out_by_bytes(spark):
    """One file of many stretches is many tasks' work, though its index is tiny."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(i, "u", rng.randbytes(40_000).hex()) for i in range(60)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1))
    total = index.agg(F.sum("length")).first()[0]
    most = total // 24
    read = warc.read_records(index, most=most).select("id", F.spark_partition_id().alias("task"))
    tasks = {r["task"] for r in read.collect()}
    assert len(index.select("file").distinct().collect()) == 1 and len(tasks) >= 12


def test_both_ways_of_deciding_agree(spark, monkeypatch):
    rows = lambda: sorted(map(str, warc.read_records(warc.write_archives(pages(spark))).drop("payload").collect()))
    want = rows()
    monkeypatch.setattr(warc, "BROADCAST_KEYS", 0)
    assert rows() == want
