import hashlib
import json
import zlib

from pyarrow import fs
from pyspark.sql import functions as F

from strandspark.llm import warc
from strandspark.session import scratch_path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def plain(rows):
    least = {}
    for i, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 100:
            least[h] = min(i, least.get(h, i))
    out = []
    for i, _, h in rows:
        h = h or ""
        owner = least.get(h, i)
        out.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "response" if owner == i else "revisit", None if owner == i else owner))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(k, f"http://h{k % 5}.example.org:80/p/{k}?q=1", f"<p>{k % 7} é {'x' * 120 if k % 3 else ''}</p>") for k in range(80)]
    rows += [(100, None, None), (101, "", ""), (102, "no scheme", "<p>\r\n\r\nGET</p>" * 20), (103, "HTTP://User@Ab.C/d e\nf", "z" * 99), (104, "x", "z" * 99), (105, "x", "z" * 100), (106, "y", "z" * 100), (107, "http://big.org/", "body " * 200_000)]
    got = sorted((tuple(r) for r in warc.archive_and_read(pages(spark, rows)).collect()), key=str)
    assert got == plain(rows)


def test_index_blocks_are_sorted_and_found(spark):
    rows = [(k, f"http://www.site{k % 3}.org/{k % 10:03d}", f"page {k}") for k in range(1500)]
    folder = scratch_path(spark, "warc-test")
    captures = warc.write_archives(warc.classify(pages(spark, rows), "page_id", "url", "html"), folder)
    files = warc.write_index(captures, f"{folder}/index")
    upper = [tuple(r) for r in files.select("first_entry", "file", "offset", "length").collect()]
    index = warc.Index(f"{folder}/index", upper)
    seen = []
    where, path = fs.FileSystem.from_uri(f"{folder}/index")
    for _, name, at, size in index.files:
        source = where.open_input_file(f"{path}/{name}")
        for key, id_, offset, length in json.loads(zlib.decompress(source.read_at(size, at))):
            lines = [json.loads(x) for x in zlib.decompress(source.read_at(length, offset)).decode().split("\n")]
            assert lines[0][:2] == [key, id_] and len(lines) <= warc.BLOCK_LINES
            seen += [tuple(x[:2]) for x in lines]
    assert seen == sorted(seen) and len(seen) == 1500
    for r in captures.limit(50).collect():
        assert index.find(r["key"], r["id"]) == [(r["archive"], r["offset"], r["length"])]
    assert index.find("nothing)", 1) == [] and index.find("zzz)", 10**9) == [] and index.find("", -1) == []
    assert seen[0][0].startswith("org,site0,www)/")


def test_edges(spark):
    same = "same payload " * 20
    rows = [(5, "u", same), (5, "u", same), (7, "v", same)]
    got = warc.archive_and_read(pages(spark, rows)).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [(5, "response"), (5, "response"), (7, "revisit")]
    assert warc.archive_and_read(pages(spark, [(None, "u", "x")])).count() == 0
    assert warc.archive_and_read(pages(spark, rows).limit(0)).count() == 0
    extra = pages(spark, rows[2:]).withColumn("digest", F.lit(1)).withColumn("key", F.lit(2))
    assert warc.archive_and_read(extra).count() == 1
