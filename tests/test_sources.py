import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import evaluation, records
from tessera.sources import files


def test_manifest_names_the_line(spark, tmp_path):
    def read(*lines):
        path = tmp_path / "m.jsonl"
        path.write_text("\n".join(lines))
        return files.read_manifest(spark, str(path), "document_id string, title string")

    assert [tuple(r) for r in read('{"document_id":"a","title":"é"}', "", '{"document_id":"b"}').orderBy("line_no").collect()] == [(1, "a", "é"), (3, "b", None)]
    for lines, why in (((["{"]), "line 1: not valid JSON"), (['{"document_id":"a"}', '{"title":"x"}'], "line 2: missing"), (['{"document_id":"a"}', '{"document_id":"a"}'], "line 2: repeated document_id of line 1")):
        with pytest.raises(files.SourceError, match=why):
            read(*lines)


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    lines = [f"{i} " + "x" * (i * 37 % 90) for i in range(500)]
    lines[7] = lines[499] = ""
    (tmp_path / "m").mkdir()
    for name, part in (("b", lines[300:]), ("a", lines[:300])):
        (tmp_path / "m" / f"{name}.txt").write_text("\n".join(part) + "\n")
    names = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "20"}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        assert spark.read.text(str(tmp_path / "m")).select(F.spark_partition_id()).distinct().count() > 8
        got = files.numbered_lines(spark, str(tmp_path / "m")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [r["line"] for r in sorted(got)] == lines and [r["line_no"] for r in sorted(got)] == list(range(1, 501))


def test_jsonl_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "ü")], "k string, v string")
    files.write_jsonl(df.coalesce(1), str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part*"))
    assert [json.loads(x) for x in text.splitlines()] == [{"k": "a", "v": None}, {"k": "b", "v": "ü"}] and "ü" in text


def test_csv_header_is_checked(spark, tmp_path):
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])
    (tmp_path / "a.csv").write_text('text,label\n"x, ""y""",rag\n')
    (tmp_path / "b.csv").write_text("label,text\nrag,x\n")
    assert files.read_csv(spark, str(tmp_path / "a.csv"), schema).first()["text"] == 'x, "y"'
    with pytest.raises(files.SourceError):
        files.read_csv(spark, str(tmp_path / "b.csv"), schema)


def test_binary_digests(spark, tmp_path):
    (tmp_path / "f.html").write_bytes(b"x")
    good = files.read_binary(spark, str(tmp_path / "f.html")).select(F.lit("f.html").alias("name"), "digest")
    assert files.read_binary(spark, str(tmp_path / "f.html"), good).count() == 1
    with pytest.raises(Exception, match="digest differs"):
        files.read_binary(spark, str(tmp_path / "f.html"), good.withColumn("digest", F.lit("0"))).select("content").collect()


def test_requests(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert [r[0] for r in files.in_request_order(df, ["c", "a"], "id").collect()] == ["c", "a"]
    with pytest.raises(files.SourceError, match="zz"):
        files.in_request_order(df, ["zz"], "id")


def test_written_once_and_whole(spark, tmp_path):
    df = spark.range(2)
    files.write_once(df, str(tmp_path / "o"))
    with pytest.raises(Exception):
        files.write_once(df, str(tmp_path / "o"))
    files.write_once(df, str(tmp_path / "o"), overwrite=True)
    files.write_json(str(tmp_path / "x.json"), {"é": 1})
    files.append_record(str(tmp_path / "x.jsonl"), {"a": 1})
    files.append_record(str(tmp_path / "x.jsonl"), {"a": 2})
    assert json.loads((tmp_path / "x.json").read_text()) == {"é": 1} and len((tmp_path / "x.jsonl").read_text().splitlines()) == 2


def test_robots(spark):
    df = spark.createDataFrame([("https://x/a",), ("https://x/private/b",)], "url string")
    assert [r["allowed"] for r in files.allowed(df, "url", "User-agent: *\nDisallow: /private/").collect()] == [True, False]


def test_markdown_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", "# A\n\nx\n"), ("b", "# B\n")], "document_id string, markdown string")
    files.write_markdown(df, str(tmp_path / "m"), "document_id", "markdown")
    back = spark.read.text(str(tmp_path / "m"), wholetext=True)
    assert {(r["document_id"], r["value"]) for r in back.collect()} == {("a", "# A\n\nx\n"), ("b", "# B\n")}


def test_tree_digest_depends_on_paths_and_contents(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "p string, c string")
    one = evaluation.tree_digest(df, "p", "c").first()[0]
    assert one == evaluation.tree_digest(df.orderBy(F.desc("p")), "p", "c").first()[0] != evaluation.tree_digest(df.withColumn("p", F.upper("p")), "p", "c").first()[0]


def test_crawl_budget_and_depth(spark):
    fetch = lambda front: front.select("url", F.explode(F.array(F.col("url") * 10 + 1, F.col("url") * 10 + 2, F.lit(1))).alias("link"))
    seeds = spark.createDataFrame([(1,)], "url long")
    assert [(r["url"], r["depth"]) for r in records.crawl(seeds, fetch, 2, 5).orderBy("depth", "url").collect()] == [(1, 0), (11, 1), (12, 1), (111, 2), (112, 2)]


BLOCK = "page int, x0 double, y0 double, width double, height double, size double, text string"


def test_route_layout(spark):
    w, h = 1000.0, 500.0
    rows = [
        (1, 10.0, 100.0, w, h, 9.0, "margin"), (1, 260.0, 20.0, w, h, 9.0, "header"), (1, 260.0, 100.0, w, h, 9.0, "first column"), (1, 260.0, 200.0, w, h, 9.0, "ends mid"),
        (1, 260.0, 300.0, w, h, 18.0, "PANEL"), (1, 260.0, 350.0, w, h, 9.0, "a. b. c."), (1, 500.0, 90.0, w, h, 9.0, "sentence."), (1, 750.0, 90.0, w, h, 9.0, "third"),
    ]
    df = spark.createDataFrame(rows, BLOCK)
    assert [tuple(r) for r in records.panel_tops(df).collect()] == [(1, 0, 300.0)]
    assert records.route_page_text(df).first()["text"] == "first column\n\nends mid\nsentence.\n\nthird"


def test_map_pages(spark):
    long = "x" * 130
    rows = [(1, 800.0, 260.0, 1000.0, 500.0, 9.0, "label"), (1, 800.0, 270.0, 1000.0, 500.0, 9.0, "Title"), (1, 800.0, 300.0, 1000.0, 500.0, 9.0, long), (1, 10.0, 300.0, 1000.0, 500.0, 9.0, "map")]
    assert records.map_sidebar(spark.createDataFrame(rows, BLOCK)).first()["text"] == f"Title\n\n{long}"
    flat = spark.createDataFrame([(1, 0.0, 2.0, 1.0, 0.0, "b "), (1, 0.0, 1.0, 1.0, 0.0, "a"), (1, 0.0, 0.0, 0.0, 1.0, "turned")], "page int, x0 double, y0 double, dx double, dy double, text string")
    assert records.horizontal_text(flat).first()["text"] == "a\n\nb" and records.horizontal_text(flat, editorial=True).count() == 0


def test_letter_spacing(spark):
    g = [("a", "F", 10.0, 5.0), (" ", "F", 10.0, 1.7), ("b", "F", 10.0, 5.0), (" ", "F", 10.0, 2.7), ("c", "G", 5.0, 2.0), (" ", "G", 5.0, 2.0)]
    df = spark.createDataFrame([(g,)], "g array<struct<char:string,font:string,size:double,width:double>>")
    assert df.select(records.without_letter_spacing(F.col("g"), [("F", 0.0, 0.23)], [("G", 6.0)])).first()[0] == "ab c"


def test_links_without_fetch_become_rows(spark):
    fetched = spark.createDataFrame([("a", 1)], "url string, n int")
    links = spark.createDataFrame([("a", "s2"), ("a", "s1"), ("b", "s1")], "url string, source string")
    assert {(r["url"], r["fetched"], tuple(r["sources"])) for r in records.attach_sources(fetched, links).collect()} == {("a", True, ("s1", "s2")), ("b", False, ("s1",))}


def test_site_map_gaps_and_listing_samples(spark):
    fetch = lambda front: front.select("url", F.concat("url", F.lit("a")).alias("link"))
    seeds, gaps = spark.createDataFrame([("x",)], "url string"), spark.createDataFrame([("xa",), ("z",), ("y",), ("y",)], "url string")
    assert sorted((tuple(r) for r in records.crawl(seeds, fetch, 1, 9, gaps).collect()), key=str) == [("x", 0), ("xa", 1), ("y", None), ("z", None)]
    assert records.crawl(seeds, fetch, 1, 3, gaps).count() == 3
    pages = spark.createDataFrame([("e", "shop"), ("a", "shop"), ("c", "shop"), ("b", "inn"), ("d", "topic"), ("f", None)], "url string, page_type string")
    assert sorted(r["url"] for r in records.listing_samples(pages, ["shop", "inn"]).collect()) == ["a", "b", "c", "d", "f"]


def test_other_lines_stay_byte_for_byte(spark):
    old = spark.createDataFrame([(1, '{"document_id":  "b", "x":1}'), (2, '{"x": "é",   "document_id": "a"}')], "line_no long, line string")
    new = spark.createDataFrame([("d", '{"document_id": "d"}'), ("c", '{"document_id": "c"}'), ("b", '{"document_id": "b", "x": 2}')], "document_id string, line string")
    assert [r[0] for r in files.upsert_lines(old, new).collect()] == ['{"document_id": "b", "x": 2}', '{"x": "é",   "document_id": "a"}', '{"document_id": "c"}', '{"document_id": "d"}']


def test_work_folder_is_shared_or_an_error():
    from types import SimpleNamespace as N

    from tessera.sources import store

    def session(master, named=None, placed=None):
        option = N(isDefined=lambda: placed is not None, get=lambda: placed)
        return N(conf=N(get=lambda key, default: named), sparkContext=N(master=master, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: option))))

    assert store.work_dir(session("spark://x", "hdfs://a/b/")) == "hdfs://a/b" and store.work_dir(session("yarn", None, "s3://c/d")) == "s3://c/d"
    assert store.work_dir(session("local[4]")).startswith("file:///")
    for master in ("yarn", "spark://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="share"):
            store.work_dir(session(master))


def test_pages_are_read_by_their_layout(spark):
    w, h, long = 1000.0, 500.0, "body " * 30
    rows = [(p, 300.0, 100.0, w, h, 9.0, 1.0, 0.0, f"p{p}") for p in range(1, 6)] + [(p, 800.0, 300.0, w, h, 9.0, 1.0, 0.0, long) for p in (2, 3, 4)] + [(5, 10.0, 90.0, w, h, 9.0, 0.0, 1.0, "turned")]
    df = spark.createDataFrame(rows, "page int, x0 double, y0 double, width double, height double, size double, dx double, dy double, text string")
    layouts = spark.createDataFrame([(1, "route"), (2, "map"), (3, "editorial"), (5, "unheard of")], "page int, layout string")
    got = {r["page"]: (r["layout"], r["text"]) for r in records.page_texts(df, layouts).collect()}
    body = long.rstrip()
    assert got == {1: ("route", "p1"), 2: ("map", body), 3: ("editorial", body), 4: ("plain", f"p4\n\n{body}"), 5: ("unheard of", "p5")}


def test_files_of_many_folders(spark, tmp_path):
    """Names below a path are found in all folders, the session's own number of listing tasks stays as it was."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    files.write_markdown(spark.createDataFrame([(i, f"t{i}\n") for i in range(40)], "k long, t string"), f"{tmp_path}/o", "k", "t")
    got = files.read_binary(spark, f"{tmp_path}/o", below="part-*").select("content").collect()
    assert sorted(bytes(r[0]) for r in got) == sorted(f"t{i}\n".encode() for i in range(40))
    assert spark.conf.get(name) == before


def test_tasks_write_local_files_themselves(spark, tmp_path):
    """Without a checksum file, and a process to set its mode, beside each; folders are named as Spark names them."""
    rows = [("a/b=c", "x\n"), ("é:1 [%]", "y"), (None, "z\n"), ("n", None), ("n", "2\n\n"), ("n", "é\r\n")]
    df = spark.createDataFrame(rows, "k string, t string").coalesce(1)
    files.write_markdown(df, f"{tmp_path}/m", "k", "t")
    files.write_markdown(df, f"{tmp_path}/m", "k", "t")
    assert not [x for x in (tmp_path / "m").rglob(".*") if x.name.startswith(".part")]
    df.select("k", F.regexp_replace("t", r"\n\z", "").alias("value")).write.partitionBy("k").text(f"{tmp_path}/spark")
    found = [{x.parent.name: x.read_bytes() for x in (tmp_path / p).rglob("part-*")} for p in ("m", "spark")]
    assert found[0].keys() == found[1].keys() and len(found[0]) == 4
    assert {k: sorted(v.split(b"\n")) for k, v in found[0].items()} == {k: sorted(v.split(b"\n")) for k, v in found[1].items()}
    assert (tmp_path / "m" / "_SUCCESS").exists()
