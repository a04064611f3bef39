"""Archives: exact round trips, ZIP and ZIP64 directories, digests."""

import base64
import hashlib
import io
import random
import zipfile

import pytest

from colloquy.llm import warc


def b32(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def some_pages():
    rng = random.Random(6)
    html = ["<p>" + "é" * rng.randint(0, 50) + str(rng.randint(0, 12)) for _ in range(60)] + ["", None, "x" * 200_000, "a\r\n\r\nb", "\x00😀"]
    rows = [(i * 2, f"http://h/{i}" if i % 5 else None, h, "x") for i, h in enumerate(html)]
    return rows + [(3, "u\nv", html[0], "y"), (3, "w", html[0], "y"), (None, "n", html[1], None), (None, None, "only without id", None), (-1, "z", None, None)]


def expected(rows):
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, u, h, _ in rows:
        f = first.get(h or "")
        again = f is not None and i != f
        out.append((i, len((h or "").encode()), b32(h), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    rows = some_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = warc.round_trip(df, payload=True).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(rows)
    texts = {(i, len((h or "").encode())): (h or "").encode() for i, _, h, _ in rows}
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or bytes(r.payload) == texts[(r.page_id, r.payload_bytes)]


def test_rolled_archives(spark, tmp_path):
    rows = some_pages()
    old, warc.ARCHIVE_BYTES = warc.ARCHIVE_BYTES, 500
    try:
        _, out = None, warc._Archive(f"file://{tmp_path}")
        for i, u, h, _ in rows:
            out.add(i, "response", warc.record(i, u, "response", (h or "").encode(), b32(h), None))
        uri, n, size = out.close()
    finally:
        warc.ARCHIVE_BYTES = old
    assert n == len(rows) and zipfile.ZipFile(uri.removeprefix("file://")).testzip() is None
    with warc._open(uri) as f:
        d = warc.ZipDirectory(f, f.size())
        start, length = d.start(warc.DATA)
        assert length == size and set(d.members) == {warc.DATA, warc.INDEX}


@pytest.mark.parametrize("zip64", [False, True])
def test_directory(zip64, monkeypatch):
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = io.BytesIO(b"")
    raw.write(b"")
    with zipfile.ZipFile(raw, "w") as z:
        z.comment = b"PK\x05\x06 a comment that looks like the end"
        z.writestr("a.txt", b"first member")
        z.writestr("é.txt", b"second member, longer")
        z.writestr(zipfile.ZipInfo("c"), b"packed" * 50, zipfile.ZIP_DEFLATED)
    d = warc.ZipDirectory(raw, len(raw.getvalue()))
    assert d.content("a.txt") == b"first member" and d.content("é.txt") == b"second member, longer"
    assert (b"PK\x06\x06" in raw.getvalue()) == zip64
    with pytest.raises(ValueError):
        d.content("c")
    with pytest.raises(ValueError):
        warc.ZipDirectory(io.BytesIO(raw.getvalue()[:-40]), len(raw.getvalue()) - 40)


def test_broken_payload_is_seen():
    data = warc.record(1, "u", "response", b"abc", b32("abc"), None)
    assert warc.parse(data)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"abc", b"abd"))


def test_query(spark):
    from colloquy.llm.queries import op3_warc

    d = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html, None) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    got = op3_warc(spark, d).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_runs_are_bounded_by_bytes():
    sizes = [3, 4, 5, 100, 1, 1, 8]
    index = [{"offset": sum(sizes[:i]), "length": n} for i, n in enumerate(sizes)]
    assert list(warc.runs(index, 10)) == [(0, [3, 4]), (7, [5]), (12, [100]), (112, [1, 1, 8])]
    assert list(warc.runs([], 10)) == []


def test_a_run_writes_one_folder_and_can_remove_it(spark):
    from pyarrow import fs

    from colloquy.llm import shared

    shared.cut(spark.range(3), "kept").count()
    system, path = fs.FileSystem.from_uri(shared.run_dir(spark))
    assert system.get_file_info(path).type == fs.FileType.Directory
    shared.remove_run(spark)
    assert system.get_file_info(path).type == fs.FileType.NotFound
    shared.remove_run(spark)
