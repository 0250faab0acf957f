"""Headers of any length."""

from gaugeline.llm import warc


def test_header_of_over_a_mebibyte(tmp_path):
    head = warc.MAGIC + b"WARC-Target-URI: " + b"u" * (3 << 20) + b"\r\nContent-Length: 5" + warc.BLANK
    data = head + b"hello" + warc.BLANK
    path = tmp_path / "a.warc"
    path.write_bytes(data + data)
    window = warc.Window(f"file://{path}", 0, 2 * len(data))
    fields, block, after = window.header(0)
    assert fields[b"content-length"] == b"5" and (block, after) == (len(head), len(data))
    assert window.header(after)[2] == 2 * len(data) and window.header(1) is None


def test_magic_in_payloads_is_searched_once(tmp_path):
    """A payload of eight mebibytes of magic, with and without blank lines, in seconds, whatever the ranges."""
    import time

    began = time.perf_counter()
    for payload in (warc.MAGIC * 800_000, (b"x" + warc.MAGIC) * 750_000, (warc.BLANK + warc.MAGIC) * 580_000, (warc.MAGIC + b"\r\n") * 700_000):
        head = warc.MAGIC + b"Content-Length: " + str(len(payload)).encode() + warc.BLANK
        data = head + payload + warc.BLANK
        path = tmp_path / "a.warc"
        path.write_bytes(data + data)
        size = 2 * len(data)
        assert warc.leave(f"file://{path}", 0, 4 << 20, size) == [(0, len(data))]
        assert (len(data), size) in warc.leave(f"file://{path}", 8 << 20, 12 << 20, size) + warc.leave(f"file://{path}", 4 << 20, 8 << 20, size)
    assert time.perf_counter() - began < 90


def test_payloads_longer_than_ranges_and_clashing_columns(spark):
    """Candidates inside payloads that are records by themselves; a null id that is alone is a response."""
    from collections import Counter

    inner = (warc.MAGIC + b"Content-Length: 3" + warc.BLANK + b"abc" + warc.BLANK).decode()
    rows = [(1, "u", inner * 40), (2, "u", "\r\n\r\n" + inner * 40), (3, None, "WARC/1.1\r\n" * 500), (None, "u", "alone"), (4, "u", inner * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "'y' AS n_bytes", "'z' AS largest", "'w' AS value")
    from gaugeline.llm._common import shared_dir

    folder = f"{shared_dir(spark)}/warc"
    warc.write_archives(pages, folder)
    for range_bytes in (50, 333, 1 << 20):
        got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, folder, range_bytes=range_bytes).collect())
        assert got == Counter([(1, len(inner) * 40, "revisit", 4), (2, len(inner) * 40 + 4, "response", None), (3, 5000, "response", None), (None, 5, "response", None), (4, len(inner) * 40, "response", None)])
