"""Round trips of tables, files and streams."""

import json
from collections import Counter

from pyspark.sql import functions as F

from lotwise.plans.queries import categorized, sheet_grid
from lotwise.sources import exports, grid, tables
from lotwise.streaming import events as ev

SF = "/root/testdata/sf0.001"


def test_save_load_delete(spark, tmp_path):
    r = categorized(spark, SF).select("dataset_id", "_source_row")
    folder = str(tmp_path)
    tables.save(r, folder, "records")
    tables.save(r.where("dataset_id = 'ds1'").limit(3), folder, "records")
    assert tables.load(spark, folder, "records", "ds1").count() == 3
    assert tables.load(spark, folder, "records", "ds2").count() == r.where("dataset_id = 'ds2'").count()
    tables.delete_dataset(spark, folder, "ds1", ["records", "absent"])
    assert {x.dataset_id for x in tables.load(spark, folder, "records").select("dataset_id").distinct().collect()} == {"ds0", "ds2", "ds3"}


def test_exports(spark, tmp_path):
    r = categorized(spark, SF)
    exports.write_csv(exports.inventory_export(r), str(tmp_path / "x"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "x"))
    assert back.count() == r.count() and len(back.columns) == 18
    exports.write_csv(r.select("_sheet_name", "_source_row"), str(tmp_path / "y"), "_sheet_name")
    assert spark.read.option("header", True).csv(str(tmp_path / "y")).count() == r.count()
    _, out = grid.ingest(sheet_grid(spark, SF))
    assert exports.excluded_export(out).count() == out.count()


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Banner,,\nProduct Name,Qty,Brand\n"Rice, 5 kg",2,X\n\nGrand Total,2,\n,3,Y\n=cmd,1,Z\n')
    (tmp_path / "b.csv").write_text('Banner,,\nProduct Name,Qty,Brand\n"Rice, 5 kg",2,X\n\nGrand Total,2,\n,3,Y\n=cmd,1,Z\n')
    (tmp_path / "c.txt").write_text("x")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length", "content")
    files = files.union(spark.createDataFrame([("file:/d.csv", 0, bytearray())], files.schema))  # a scan of files skips empty ones
    m = {r.path.rsplit("/", 1)[1]: r for r in tables.manifest(files).collect()}
    assert [m[n].admitted for n in ("a.csv", "b.csv", "c.txt", "d.csv")] == [True, True, False, False]
    assert (m["a.csv"].is_duplicate, m["b.csv"].is_duplicate, m["d.csv"].reason) == (False, True, "empty")
    records, out = grid.ingest(grid.read_csv_grid(spark, str(tmp_path / "a.csv"), "d", 8))
    assert sorted((r._source_row, r.name, r.qty, r.brand) for r in records.collect()) == [(3, "Rice, 5 kg", "2", "X"), (7, "=cmd", "1", "Z")]
    assert sorted((r._source_row, r._exclude_reason) for r in out.collect()) == [(5, "summary_row"), (6, "missing_product_name")]


def test_headers(spark):
    rows = [("d", "A", 0, ["x", "y", None]), ("d", "A", 1, ["Item Name", "Sum of QTY", "Total Value"]), ("d", "A", 2, ["Rice", "1", "2"]), ("d", "B", 0, ["free text", "here", None]), ("d", "B", 1, ["long words", "1", None])]
    h = {r._sheet_name: r for r in grid.detect_headers(spark.createDataFrame(rows, "dataset_id string, _sheet_name string, row_idx int, cells array<string>")).collect()}
    assert h["A"].header_row == 1 and {k: v.pos for k, v in h["A"].mapping.items()} == {"name": 0, "qty": 1, "value": 2} and h["B"].header_row == 0 and h["B"].mapping == {}
    s = grid.suggest_headers(spark.createDataFrame([("Prod. Name",), ("zz",)], "header string"), spark.createDataFrame([("name",)], "canonical string"))
    assert [(r.canonical, r.header) for r in s.collect()] == [("name", "Prod. Name")]
    raw = spark.createDataFrame([("r", {"Qty On Hand": "7", "brand": "Q"}, None, None)], "name string, _raw map<string,string>, qty_on_hand string, brand string")
    assert tuple(grid.back_fill(raw, "qty_on_hand", "brand").select("qty_on_hand", "brand").first()) == ("7", "Q")


EVENT = "anonymous_session_id string, timestamp string, event string, page string, event_sequence string, metadata map<string,string>"


def test_event_ingest(spark, tmp_path):
    rows = [
        {"anonymous_session_id": "s1", "timestamp": "2024-01-01T00:00:00Z", "event": "upload_started", "page": "/", "event_sequence": "1", "metadata": {"k": "v", "email": "x", "n": "a@b", "t": "eyABCDEFGHIJKLMN.x"}},
        {"anonymous_session_id": "s1", "timestamp": "bad", "event": "x", "event_sequence": "1"},
        {"anonymous_session_id": "s1", "timestamp": "2024-01-01T00:00:00Z", "event": " ", "event_sequence": "0"},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    seen = []
    q = ev.ingest(ev.read_events(spark, str(tmp_path / "in"), EVENT), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"), [lambda d: seen.append(d.count())])
    q.awaitTermination(120)
    good = spark.read.parquet(str(tmp_path / "good")).collect()
    assert [r.metadata for r in good] == [{"k": "v"}] and seen == [1]
    assert Counter(",".join(r.errors) for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == Counter(["timestamp", "event,event_sequence"])


def test_streams_equal_their_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = ev.funnel_by_session(stream).writeStream.outputMode("complete").format("memory").queryName("funnel_now").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert Counter(map(tuple, spark.table("funnel_now").collect())) == Counter(map(tuple, ev.funnel_by_session(e).collect()))
    q = ev.sessions(stream, watermark="365 days").writeStream.outputMode("append").format("memory").queryName("sessions_now").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("sessions_now").count() <= ev.sessions(e).count()
    q = ev.without_repeats(stream, ["event_id"]).writeStream.outputMode("append").format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == e.count()
    counted = []
    q = ev.load_incrementally(spark, str(tmp_path / "e"), e.schema.simpleString()[7:-1].replace(":", " "), lambda b: counted.append(b.count()), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert sum(counted) == e.count()
