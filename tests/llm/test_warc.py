import hashlib

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, key string, refers_to int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "extra", 0) for r in rows], SCHEMA)


def test_records_come_back_and_copies_are_revisits(spark, tmp_path):
    h = "x" * 2000
    rows = [(5, "http://a.example/1", h), (7, "http://b.example/1", h), (7, "http://b.example/2", h), (None, "http://b.example/2", h), (1, None, None), (2, "", "short"),
            (3, "nohost", "short"), (5, "http://A.example:80/1", h + "y"), (9, "http://a.example/1", "é \r\n\r\n WARC/1.1"), (12, "http://a.example/long", "é" * 100_000)]
    archive = warc.write_archive(pages(spark, rows).repartition(3), str(tmp_path), block_lines=2, file_bytes=500)
    got = sorted(map(tuple, warc.read_archive(archive).collect()), key=str)
    want = []
    for page_id, url, html in rows:
        data = (html or "").encode()
        again = html == h and page_id is not None and page_id < 7
        want.append((page_id, url or "", len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 7 if again else None))
    assert got == sorted(want, key=str)
    urls = spark.createDataFrame([("https://a.example/1",), (None,), ("zzz",), ("https://a.example/1",)], "url string")
    for directory_rows in (1, 2, 100):
        found = {(r.page_id, r.payload_bytes) for r in warc.look_up(archive, urls, directory_rows).collect()}
        assert found == {(5, 2000), (5, 2001), (1, 0), (2, 5), (9, len("é \r\n\r\n WARC/1.1".encode()))}


def test_empty_archive(spark, tmp_path):
    archive = warc.write_archive(pages(spark, []), str(tmp_path))
    assert warc.read_archive(archive).count() == 0
    assert warc.look_up(archive, pages(spark, [(1, "http://a.example", "")])).count() == 0


def test_keys_reverse_the_host(spark):
    rows = spark.createDataFrame([("HTTPS://user@WWW.a.Example:8080/b?c#d",), ("a.b/c",), (None,), ("x y",)], "url string")
    assert [r[0] for r in rows.select(warc.sort_key("url")).collect()] == ["example,a,www)/b?c#d", "b,a)/c", ")", "x y)"]
