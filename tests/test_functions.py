import base64
import hashlib

from pyspark.sql import functions as F

from tagloom.functions import content, extract
from tagloom.sources import readers, sinks
from tagloom.streaming import ingest as streams


def values(spark, data, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_paths_and_formats(spark):
    path = lambda h: content.sharded_path(F.lit("files"), h, F.lit("jpg"))
    assert values(spark, ["short", "abcdef", "abcdef123456", None, ""], path) == [None, None, "files/ab/cd/ef/abcdef123456.jpg", None, None]
    sniff = lambda x: content.sniffed_extension(F.unhex(x))
    assert values(spark, ["FFD8FFE0", "89504E470D0A1A0A00", "524946460000000057454250", "0000001866747970", "00", None], sniff) == ["jpg", "png", "webp", "mp4", None, None]
    assert spark.range(1).select(content.dated_path("b", F.lit(1704067200))).first()[0] == "b/2024/01/01"


def test_hashes(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "id int, t string")
    got = {(r.id, r.algorithm): r.digest for r in content.hash_rows(df, "id", "t").collect()}
    assert len(got) == 8 and got[1, "MD5"] == hashlib.md5(b"x").hexdigest() and got[3, "SHA512"] == hashlib.sha512(b"").hexdigest().upper()


def test_durations_and_times(spark):
    assert values(spark, ["PT1H2M3S", "PT5M", "PT", "P1D", "PT1X", "xPT5M", None, ""], extract.iso_seconds) == [3723, 300, None, None, None, None, None, None]
    assert values(spark, ["now", "Now", "1w2d3h", "xs", "", "2mo", "3m", "h5m", "+5m", "-5m", "5m7m2s", "1d30s", None], extract.spoken_seconds) == [0, 0, 604800 + 2 * 86400 + 3 * 3600, 0, 0, 2 * 2629800, 180, 0, 300, 0, 300, 86430, None]
    assert values(spark, ["2024-01-01T00:00:00", "2024-01-01T00:00:00.5", "2024-01-01T02:00:00+02:00", "soon", None], extract.epoch_seconds) == [1704067200] * 3 + [None, None]


def test_urls(spark):
    assert values(spark, ["a.b/c/12/", "https://a.b/x", None, ""], extract.last_path_number) == ["12", None, None, None]
    assert values(spark, ["https://a.b/c/d?x=1", "a.b"], extract.url_host) == ["a.b", "a.b"]
    assert values(spark, ["https://a.b/c/d?x=1#f", "a.b"], lambda c: extract.url_segment(c, 2)) == ["d", None]
    assert values(spark, ["http://a?x=1&y=&x=2"], lambda c: F.to_json(extract.url_query(F.regexp_replace(c, "&x=2", "")))) == ['{"x":"1","y":""}']


def test_text_and_markup(spark):
    assert values(spark, [" a \n\t b ", "", None], extract.collapsed) == ["a b", "", None]
    assert values(spark, ['{a,"b,c","d""e"}', "{}", "a,b", None], extract.braced_csv) == [["a", "b,c", 'd"e'], [], None, None]
    assert values(spark, ["<p>a &amp; b</p><script>x</script><br>c", "plain", "", None], extract.html_text) == ["a & b\nc", "plain", "", None]
    assert values(spark, ['<a class="th" href="u">x</a><A HREF=\'v\'>', "no", None], extract.html_links) == [["u", "v"], [], None]
    assert values(spark, ['<script type="application/ld+json">{bad</script><script type="application/ld+json">{"a":1}</script>', "x"], extract.json_ld) == ['{"a":1}', None]
    assert values(spark, [base64.b64encode(b"\x01\xff").decode(), "***", None], extract.base64_hex) == ["01ff", None, None]
    assert values(spark, ["Video 1080p", "4K", "x", None], extract.quality_score) == [1080, 2160, 1, 1]
    pairs = values(spark, ["a,b,c", "a"], lambda c: extract.paired(F.split(c, ",")))
    assert [[tuple(p) for p in x] for x in pairs] == [[("a", "b"), ("c", None)], [("a", None)]]


def test_sources(spark, tmp_path, rows):
    d = tmp_path / "t" / "u"
    d.mkdir(parents=True)
    for name, body in (("f.jpg", "img"), ("f.jpg.txt", "note"), ("f.jpg.json", "{}"), ("alone.txt", "x")):
        (d / name).write_text(body)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.text, r.json) for r in readers.with_sidecars(readers.file_tree(spark, str(tmp_path / "t"))).collect()}
    assert got == {"f.jpg": (3, "note", "{}"), "alone.txt": (1, None, None)}
    spark.createDataFrame([(1, "x")], "id long, extra string").write.parquet(str(tmp_path / "files"))
    t = readers.tables(spark, str(tmp_path), {"files": "id bigint, size_bytes bigint", "none": "a string"})
    assert rows(t["files"]) == [(1, None)] and rows(t["none"]) == []


def test_sinks(spark, tmp_path, rows):
    path = str(tmp_path / "x")
    for n in (3, 2):
        sinks.swap_in(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    sinks.swap_in(spark.read.parquet(path).filter("id = 1"), path)
    assert rows(spark.read.parquet(path)) == [(1,)]
    assert sinks.backup(spark.range(1), str(tmp_path), 86400).endswith("1970/01/02")


def test_edges_arrive_once(spark, tmp_path, rows):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "file_id long, tag_id long, namespace long"
    for part in ([(1, 1, 1), (1, 1, 1), (2, 1, 1)], [(1, 1, 1), (3, 1, 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = streams.edges_to_table(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "ck"))
        q.awaitTermination(60)
    assert rows(spark.read.parquet(out).select("file_id", "tag_id")) == [(1, 1), (2, 1), (3, 1)]


def test_streams_drop_repeats_and_count_windows(spark, tmp_path, rows):
    src = str(tmp_path / "in")
    df = spark.sql("select 'u' || (id % 2) as url, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 20) as at, 'k' as k from range(6)")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    for name, s in (("urls", streams.new_urls(stream)), ("act", streams.activity(stream, "at", "k"))):
        q = s.writeStream.format("memory").queryName(name).outputMode("append" if name == "urls" else "append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(60)
    assert rows(spark.sql("select url from urls")) == [("u0",), ("u1",)]
    assert rows(spark.sql("select n from act")) == [(3,)]


def test_all_digests_of_documents(spark, rows, tmp_path):
    from tagloom.plans.graph_queries import QUERIES

    spark.createDataFrame([(1, "aé"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.algorithm: r.digest.lower() for r in QUERIES["hash_columns_all"](spark, str(tmp_path)).collect()}
    assert got == {a: hashlib.new(a, "aé".encode()).hexdigest() for a in ("MD5", "SHA1", "SHA256", "SHA512")}


def test_elements_of_pages(spark):
    html = '<ul class="a statlist"><li>1<b>2</b></li><li>3</ul><a class="chapter" href="/c"><div class="title"> T  x</div><i class="cost"></i></a><a class="chapter" href="/d"><div>no title</div></a><a class="k" href="#">&amp;n</a><div>ok<script>s</script> WM: end</div><div class="advertisment">ad</div><p>open'
    e = spark.createDataFrame([(html,), ("",), (None,)], "h string").select(extract.html_elements(F.col("h")).alias("e"))
    col = lambda c: [r[0] for r in e.select(c).collect()]
    assert col(F.transform(extract.children_of_first(F.col("e"), "ul", "statlist"), lambda x: x["text"])) == [["12", "3"], None, None]
    assert [[tuple(x) for x in v] if v is not None else None for v in col(extract.chapters(F.col("e")))] == [[("/c", "T x", True)], [], None]
    assert [[tuple(x) for x in v] if v is not None else None for v in col(extract.tags_by_class(F.col("e"), {"k": "ns"}))] == [[("ns", "&n")], [], None]
    assert col(extract.body_lines(F.col("e"), "wm:")) == ["T  x\nno title\nok  end", "", None]


def test_values_in_addresses_and_scripts(spark):
    assert values(spark, ["https://v/video/12/x", "https://v/vid/12", None], extract.video_id) == ["12", None, None]
    assert values(spark, ["https://a.b/c/d/?x#y", "https://a.b/c", "nope", None], extract.slug) == ["d", "c", None, None]
    assert values(spark, ["/x/0a1b.ext.zip", "a", None], extract.file_stem) == ["0a1b", "a", None]
    assert values(spark, ['const BOOK_ID = "b1";', "const OTHER = 'x'", None], lambda c: extract.script_constant(c, "BOOK_ID")) == ["b1", None, None]
    assert values(spark, ['self.__next_f.push([1,"a\\"b\\u003c"])', "x", None], extract.pushed_text) == ['a"b<', None, None]
    assert values(spark, ["?page=3&amp;page=12", "x", None], extract.page_numbers) == [12, 1, 1]


def test_sqlite_tables(spark, rows, tmp_path):
    import sqlite3

    path = str(tmp_path / "old.db")
    with sqlite3.connect(path) as db:
        db.execute("create table File (id integer primary key, hash text, extra text)")
        db.executemany("insert into File values (?, ?, 'x')", [(i * 3, f"h{i}") for i in range(1, 200)])
        db.execute("create table Empty (id integer)")
    db.close()
    got = readers.sqlite(spark, path, "File", "id long, hash string, size_bytes long", parts=5)
    assert rows(got) == sorted([(i * 3, f"h{i}", None) for i in range(1, 200)], key=repr)
    assert readers.sqlite(spark, path, "Empty", "id long").count() == readers.sqlite(spark, path, "None", "id long").count() == 0


def test_typed_calls():
    import pytest

    from tagloom.plans.registry import Registry

    r = Registry()
    r.offer("f", 1, (int, str), lambda n, s: s * n)
    assert r.call("f", 1, 2, "ab") == "abab"
    for bad in (("f", 2, 2, "ab"), ("f", 1, "ab", 2), ("g", 1, 2, "ab")):
        with pytest.raises(LookupError):
            r.call(*bad)
    with pytest.raises(ValueError):
        r.offer("f", 1, (int, str), print)


def test_content_identifiers(spark):
    df = spark.createDataFrame([(bytearray(b"hello world"),), (bytearray(b"x" * 262_145),), (None,), (bytearray(b""),)], "c binary")
    got = [tuple(r) for r in df.select(content.cid_v0("c"), content.cid_v1("c")).collect()]
    assert got[0] == ("Qmf412jQZiuVUtdgnB36FXFX7xg5V6KEbSJ4dpQuhkLyfD", "bafkreifzjut3te2nhyekklss27nh3k72ysco7y32koao5eei66wof36n5e")
    assert got[1] == got[2] == (None, None) and got[3][0] == "QmbFMke1KXqnYyBBWxB74N4c5SBnJMVAiMNRcGu6x1AwQH"
