import base64
import hashlib
from collections import Counter

from tabloom.llm import warc
from tabloom.llm.queries import ORACLES, QUERIES
from tests.compare import compare


def test_query(spark, folder):
    assert compare(spark, folder, "op1", QUERIES["op1_warc"], ORACLES["op1_warc"]) is None


def plain(rows, min_bytes):
    out = []
    for k, _, html in rows:
        body = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == body]
        first = min((x for x in same if x is not None), default=None)
        again = len(body) >= min_bytes and k != first
        out.append((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    return Counter(out)


ROWS = [(1, "http://a/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://ü/", ""), (4, "", None), (5, "u", "\r\n\r\nWARC/1.0\r\n\r\n\n"), (6, "u", "a\r\nb\rc\n\n"),
        (7, "u", "x" * 400_000), (8, "u", "x" * 400_000), (9, "u", "\n" * 5000), (10, "u", "漢 é"), (11, "u", "short"), (0, "u", "short"), (None, "u", "short"), (12, "v", "http://b 0.0.0.0 20240101000000 text/html 3\nabc")]


def test_odd_pages(spark):
    df = spark.createDataFrame([("h", *r, 1) for r in ROWS], "head string, page_id long, url string, html string, key int").repartition(3)
    for least in (0, 6):
        assert Counter(map(tuple, warc.round_trip(df, min_bytes=least).collect())) == plain(ROWS, least)


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "same")] * 4, "page_id long, url string, html string")
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    assert got == {(1, "response", None): 1, (1, "revisit", 1): 3}
    assert warc.round_trip(df.limit(0)).count() == 0


ARC_1 = (b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
         b"http://a/ 1.2.3.4 19970102030405 text/html; charset=x 24\nHTTP/1.0 200 OK\r\n\r\n<a>\n\n\n\n"
         b"dns:a 1.2.3.4 199701 text/dns 5\na\xff\xfe\x00b\n")


def test_legacy_file_of_another_writer(spark, tmp_path):
    import gzip

    (tmp_path / "arc").mkdir()
    body = ARC_1
    with gzip.open(tmp_path / "arc" / "old.arc.gz", "wb") as f:
        f.write(body)
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = sorted(warc.read_warc(spark, str(tmp_path / "warc")).collect(), key=lambda r: r.uri)
    assert [(r.uri, r.record_type, r.date, bytes(r.payload)) for r in got] == [
        ("dns:a", "resource", "1997-01-01T00:00:00Z", b"a\xff\xfe\x00b"), ("http://a/", "response", "1997-01-02T03:04:05Z", b"<a>\n\n")]
    with gzip.open(next((tmp_path / "warc").glob("part-*.gz"))) as f:
        assert f.read().startswith(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n")


def _arc(tmp_path, name, body):
    import gzip

    (tmp_path / "arc").mkdir(exist_ok=True)
    with gzip.open(tmp_path / "arc" / f"{name}.arc.gz", "wb") as f:
        f.write(body)


def test_damaged_files_lose_only_what_is_damaged(spark, tmp_path):
    """A record that the file's end cuts off, lines where a header should be, and a file without a version block."""
    first = ARC_1 + b"http://cut/ 1.2.3.4 19970102030405 text/html 5000\nHTTP/1.0 200 OK\r\n\r\n<half"
    _arc(tmp_path, "cut", first)
    _arc(tmp_path, "junk", ARC_1.replace(b"dns:a", b"some junk\nand more\ndns:b"))
    _arc(tmp_path, "none", b"not an archive\nat all\n")
    _arc(tmp_path, "empty", b"")
    place = str(tmp_path / "arc")
    warc.convert(spark, place, str(tmp_path / "warc"))
    got = Counter((r.uri, r.record_type) for r in warc.read_warc(spark, str(tmp_path / "warc")).collect())
    assert got == {("http://a/", "response"): 1, ("http://a/", "revisit"): 1, ("dns:a", "resource"): 1, ("dns:b", "revisit"): 1} or got == {
        ("http://a/", "response"): 1, ("http://a/", "revisit"): 1, ("dns:b", "resource"): 1, ("dns:a", "revisit"): 1}
    lost = Counter((r.uri, r.reason) for r in warc.unreadable(spark, place).collect())
    assert lost == {("http://cut/", "cut off by the end of the file"): 1, ("some", "no header line"): 1, ("not", "no header line"): 1}


def test_revisits_keep_the_size_of_other_content(spark, tmp_path):
    _arc(tmp_path, "two", ARC_1 + b"dns:b 1.2.3.4 199701 text/dns 5\na\xff\xfe\x00b\n")
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    found = {r.uri: r for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert (found["dns:b"].record_type, found["dns:b"].payload_bytes, found["dns:b"].payload) == ("revisit", 5, None)
    assert found["dns:b"].refers_to_id == found["dns:a"].record_id and found["dns:b"].payload_digest == found["dns:a"].payload_digest


def test_many_revisits_are_joined_without_a_broadcast(spark):
    rows = [(k, "u", f"page {k % 50}") for k in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Counter(map(tuple, warc.round_trip(df).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert got == plain(rows, 0)
