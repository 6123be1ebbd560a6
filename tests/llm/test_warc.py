import gzip
import hashlib
import io
import json
import os

from loomgraph.llm import warc

BIG = "<p>é</p>" * 300


def expected(rows):
    last = {}
    for page, _, html in rows:
        h = (html or "").encode()
        if len(h) >= 1000:
            last[h] = max(page, last.get(h, page))
    out = []
    for page, _, html in rows:
        h = (html or "").encode()
        refers = last.get(h)
        kind = "revisit" if refers not in (None, page) else "response"
        out.append((page, len(h), hashlib.sha1(h).hexdigest(), kind, refers if kind == "revisit" else None))
    return sorted(out)


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", BIG), (2, None, None), (3, "http://b/ x\r\ny", BIG), (4, "u", "short\r\n\r\nContent-Length: 5"), (5, "u", "short\r\n\r\nContent-Length: 5"), (9, "é", BIG), (7, "z", "q" * 999), (8, "z", "q" * 999), (10, "", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, seq int").repartition(3)
    for file_bytes in (1 << 28, 1):
        folder = str(tmp_path / str(file_bytes))
        got = warc.round_trip(pages, folder, file_bytes=file_bytes).collect()
        assert sorted(map(tuple, got)) == expected(rows)
        names = [f for f in os.listdir(f"{folder}/archives") if f.endswith(".gz")]
        for name in names:
            raw = open(f"{folder}/archives/{name}", "rb").read()
            whole = gzip.decompress(raw)
            index = [json.loads(x) for x in open(f"{folder}/archives/{name}.idx")]
            assert b"".join(gzip.decompress(raw[p["offset"] : p["offset"] + p["length"]]) for p in index) == whole
            assert len(list(warc.records(io.BytesIO(raw)))) == len(index)
        assert len(names) == len(rows) if file_bytes == 1 else len(names) <= 3
        assert not os.path.exists(f"{folder}/raw")


def test_repeated_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", BIG), (1, "a", BIG), (None, "a", BIG), (None, "a", "")], "page_id long, url string, html string")
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, str(tmp_path / "x")).collect()]
    assert sorted(got, key=str) == sorted([(1, "response", None), (1, "revisit", 1), (None, "revisit", 1), (None, "response", None)], key=str)
    assert warc.round_trip(pages.limit(0), str(tmp_path / "y")).count() == 0
