from __future__ import annotations

import hashlib
import json
from decimal import Decimal

import pytest
from shop import raw_frame
from pyspark.sql import functions as F

from revlens.config import Settings
from revlens.functions.joins import measured_bytes
from revlens.operators.cleaning import clean
from revlens.plans import run as pipeline
from revlens.sources import sinks
from revlens.sources.manifest import source_manifest
from revlens.sources.raw import ORDINAL, PART, read_raw_parts, spread_scan
from revlens.sources.stages import StageStore, shared_folder


def test_parquet_parts_stack_in_order_with_their_position(spark, settings, store, tmp_path):
    paths = {}
    for name, text in (("year one", "first"), ("year two", "second")):
        paths[name] = str(tmp_path / name.replace(" ", "-"))
        raw_frame(spark, {"Description": text}, {"Quantity": 9}).drop(ORDINAL).coalesce(1).write.parquet(paths[name])
    raw = read_raw_parts(spark, paths)
    assert [(r[PART], r["Quantity"]) for r in raw.orderBy(ORDINAL).collect()] == [
        ("year one", 4), ("year one", 9), ("year two", 4), ("year two", 9)
    ]
    # the same line in both parts: the earlier part wins
    kept = clean(raw, settings, store).kept.where("quantity = 4").collect()
    assert [row["description"] for row in kept] == ["first"]


def test_csv_parts_keep_file_order(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    header = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
    lines = [f"{n},S,,{n},2010-12-01 08:26:31,2.55,,France" for n in range(50)]
    (folder / "a.csv").write_text(header + "\n".join(lines) + "\n")
    raw = read_raw_parts(spark, {"only": str(folder)}, "csv").repartition(4)
    rows = raw.orderBy(ORDINAL).collect()
    assert [row["Quantity"] for row in rows] == list(range(50))
    assert rows[0]["Description"] is None and rows[0]["Customer ID"] is None


def test_csv_text_is_cast_strictly(spark, settings, tmp_path):
    header = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text(header + "1,S,MUG,6.0,2010-12-01 08:26:31,2.55,17850.0,France\n")
    bad.write_text(header + "1,S,MUG,six,2010-12-01 08:26:31,2.55,17850.0,France\n")
    row = read_raw_parts(spark, {"p": str(good)}, "csv").first()
    assert (row["Quantity"], row["Customer ID"], str(row["Price"])) == (6, 17850, "2.5500")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_raw_parts(spark, {"p": str(bad)}, "csv").collect()


def test_parquet_with_other_number_types_is_read_into_the_contract(spark, tmp_path):
    path = str(tmp_path / "floats")
    floats = raw_frame(spark, {}, {"Customer ID": None}).drop(ORDINAL)
    for name in ("Price", "Customer ID", "Quantity"):
        floats = floats.withColumn(name, F.col(f"`{name}`").cast("double"))
    floats.withColumn("Invoice", F.col("Invoice").cast("int")).coalesce(1).write.parquet(path)
    raw = read_raw_parts(spark, {"p": path})
    assert [f.dataType.simpleString() for f in raw.schema.fields[:8]] == [
        "string", "string", "string", "bigint", "timestamp_ntz", "decimal(18,4)", "bigint", "string"
    ]
    assert [row["Customer ID"] for row in raw.orderBy(ORDINAL).collect()] == [931, None]


def test_manifest_streams_every_file(spark, tmp_path):
    content = {"one.bin": b"x" * (3 << 20), "two words.bin": b"y", "three.txt": b"no"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    rows = {row["file"]: row for row in source_manifest(spark, str(tmp_path), "*.bin").collect()}
    assert {name: (row["sha256"], row["bytes"]) for name, row in rows.items()} == {
        name: (hashlib.sha256(content[name]).hexdigest(), len(content[name]))
        for name in ("one.bin", "two words.bin")
    }
    manifest = source_manifest(spark, str(tmp_path), "*.bin")
    sinks.write_manifest(manifest, f"file://{tmp_path}/manifest")
    assert spark.read.json(f"file://{tmp_path}/manifest").count() == 2
    assert all(row["recorded_at"] is not None for row in rows.values())


def test_stages_live_in_the_folder_the_session_names(spark):
    store = StageStore(spark)
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder.rstrip("/")
    assert store.folder.startswith(folder)
    assert store.within("a").folder.startswith(f"{store.folder}/a-")
    saved = store.save(spark.range(3).withColumn("d", F.lit(1).cast("decimal(18,4)")), "three")
    # saving under the same name leaves the first stage alone, even when built from it
    again = store.save(saved.where("id > 0"), "three")
    assert (saved.count(), again.count()) == (3, 2)
    assert saved.schema["d"].dataType.simpleString() == "decimal(18,4)"


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_narrow_scans_spread_and_wide_ones_stay(spark):
    assert spread_scan(spark.range(100, numPartitions=1), "id").rdd.getNumPartitions() == 4
    wide = spark.range(100, numPartitions=9)
    assert spread_scan(wide, "id") is wide


def test_measured_bytes(spark):
    frame = spark.createDataFrame([("abc", 1), ("é", 2), (None, 3)], "a string, b bigint")
    assert measured_bytes(frame) == 5 + 3 * 8
    assert measured_bytes(frame.where("false")) == 0


def test_settings_from_json(tmp_path):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps({"min_unit_price": 0.5, "test_codes": ["T"], "expected_totals": {"net_revenue": 1.5}}))
    settings = Settings.from_json(str(path))
    assert str(settings.min_unit_price) == "0.5" and settings.test_codes == ("T",)
    assert str(settings.expected_totals["net_revenue"]) == "1.5"
    with pytest.raises(KeyError, match="colour"):
        Settings.from_mapping({"colour": "red"})


def test_published_run_is_repeatable(spark, settings, tmp_path):
    rows = [
        {"Invoice": str(100 + n), "StockCode": f"S{n % 3}", "Customer ID": n % 4 or None,
         "Country": "France", "Quantity": n % 5 + 1, "Price": "0" if n == 3 else "2.55"}
        for n in range(12)
    ]
    first = pipeline.run(raw_frame(spark, *rows), settings, f"file://{tmp_path}/one")
    other = raw_frame(spark, *rows).orderBy(F.rand(1)).repartition(3)
    second = pipeline.run(other, settings, f"file://{tmp_path}/two")
    assert first.counts == second.counts
    assert first.counts["transactions"] == 11 and first.counts["quarantine"] == 1
    for name in first.counts:
        one = spark.read.parquet(f"{first.folder}/{name}").collect()
        two = spark.read.parquet(f"{second.folder}/{name}").collect()
        # sorted exports come back row for row, star tables as the same set of rows
        if name.startswith(("mart_", "transactions", "quarantine")):
            assert one == two, name
        assert sorted(map(str, one)) == sorted(map(str, two)), name
    assert pipeline.documents(first) == pipeline.documents(second)
    views = sinks.register_marts(spark, first.marts.tables())
    assert views == sorted(first.marts.tables())
    assert spark.sql("SELECT SUM(net_revenue) FROM mart_revenue_trend").first()[0] is not None
    target = sinks.write_json(spark, {"b": 1, "a": "é"}, str(tmp_path / "x.json"))
    assert open(target, encoding="utf-8").read() == '{\n  "a": "é",\n  "b": 1\n}\n'


def test_manifest_lists_empty_files(spark, tmp_path):
    (tmp_path / "cut.bin").write_bytes(b"")
    (tmp_path / "whole.bin").write_bytes(b"abc")
    rows = {row["file"]: row for row in source_manifest(spark, f"file://{tmp_path}", "*.bin").collect()}
    assert set(rows) == {"cut.bin", "whole.bin"} and rows["cut.bin"]["bytes"] == 0
    assert rows["cut.bin"]["sha256"] == hashlib.sha256(b"").hexdigest()
    only = source_manifest(spark, f"file://{tmp_path}", "cut.*").collect()
    assert [row["bytes"] for row in only] == [0]


def test_nothing_is_published_when_a_gate_fails(spark, settings, store, tmp_path):
    raw = raw_frame(spark, {}).withColumn(PART, F.lit("only"))
    strict = settings.with_values(expected_totals={"gross_revenue": Decimal("1")})
    with pytest.raises(RuntimeError, match="audited_gross"):
        pipeline.run(raw, strict, f"file://{tmp_path}/out", store)
    assert not (tmp_path / "out").exists()
    # one customer fills one segment: strict segments raise as well
    with pytest.raises(RuntimeError, match="segments_missing"):
        pipeline.run(raw, settings, f"file://{tmp_path}/out", store, advisory=())
