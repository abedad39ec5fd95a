import gzip
import hashlib
import os

from logloom.llm import files, warc
from tests.llm.helpers import LONG, clashing

KIND = "page_id long, url string, html string"
PAGES = [
    (5, "http://a/ö b\r\nX: y", "same"), (2, "http://b", "same"), (9, None, "same"), (3, "http://c", None), (4, "http://d", ""), (7, "http://e", LONG),
    (8, "http://f", "é\r\n\r\nWARC/1.1\r\n"), (1, "http://g", "alone"), (5, "http://a/ö b\r\nX: y", "same"), (2, "http://b", "same"), (2, "http://b2", "two"),
    (None, "http://n", "same"),
]


def expected(pages, min_bytes=0):
    payload = lambda html: (html or "").encode()
    first, rows, done = {}, [], set()
    for page_id, _, html in pages:
        if page_id is not None and len(payload(html)) >= min_bytes:
            first[payload(html)] = min(page_id, first.get(payload(html), page_id))
    for page_id, _, html in sorted(pages, key=lambda p: (p[0] is not None, p[0] or 0)):
        data = payload(html)
        refers = None
        if page_id is not None and len(data) >= min_bytes and (first[data] != page_id or (page_id, data) in done):
            refers = first[data]
        done.add((page_id, data))
        rows.append((page_id, len(data), warc.digest(data), "response" if refers is None else "revisit", refers))
    return sorted(map(repr, rows))


def test_round_trip(spark):
    table = clashing(spark.createDataFrame(PAGES, KIND))
    for least in (0, 1, 5):
        got = warc.archive(table, least).drop("url").collect()
        assert sorted(repr(tuple(r)) for r in got) == expected(PAGES, least)
    assert warc.archive(table.limit(0)).count() == 0


def test_same_files_whatever_the_partitions(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    seen = []
    for parts in (1, 5):
        folder = str(tmp_path / f"run{parts}")
        manifest = warc.write(table.repartition(parts), folder, shard_bytes=30_000, roll_bytes=4_000)
        names = {r.name: r.sha256 for r in manifest.collect()}
        assert set(os.listdir(folder)) == {*names, "manifest"}
        seen.append(names)
    assert seen[0] == seen[1] and len(names) > 5 and len({n.split("-")[1] for n in names}) > 2
    for name, sha in names.items():
        data = open(f"{folder}/{name}", "rb").read()
        assert hashlib.sha256(data).hexdigest() == sha and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_leftovers_of_lost_tasks_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "lost")
    files.put(folder, "pages-000000-00000.warc.gz", b"half a file")
    manifest = warc.write(spark.createDataFrame(PAGES, KIND), folder)
    assert warc.read(manifest, folder).count() == len(PAGES)
    assert not os.path.exists(f"{folder}/_temporary")
