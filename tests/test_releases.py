"""Publishing as versions, loading them again, and what happens when either goes wrong."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import pytest
from shop import raw_frame
from pyspark.sql import functions as F

from revlens import schemas
from revlens.plans import gates, run as pipeline, sqlviews
from revlens.sources import manifest, releases, sinks
from revlens.sources.raw import PART
from revlens.sources.stages import StageStore


def lines(count, price="2.55"):
    return [
        {"Invoice": str(100 + n), "StockCode": f"S{n % 3}", "Customer ID": n % 4 or None, "Country": "France",
         "Quantity": n % 5 + 1, "Price": price}
        for n in range(count)
    ]


@pytest.fixture(scope="module")
def shop(spark, settings, tmp_path_factory):
    """A published run and the folder it is in."""
    folder = tmp_path_factory.mktemp("shop")
    (folder / "in").mkdir()
    (folder / "in" / "a.csv").write_text("abc")
    raw = raw_frame(spark, *lines(12)).withColumn(PART, F.lit("first"))
    root = f"file://{folder}/out"
    published = pipeline.run(raw, settings, root, delivered=["first", "late"], sources=[f"file://{folder}/in"])
    return published, root


def test_a_version_is_loaded_as_it_was_built(spark, settings, shop):
    published, root = shop
    loaded = pipeline.load(spark, settings, root)
    assert loaded.version.folder == published.folder
    for name, frame in published.star.tables().items():
        assert sorted(map(str, loaded.star.tables()[name].collect())) == sorted(map(str, frame.collect())), name
    for name, frame in published.marts.tables().items():
        assert sorted(map(str, loaded.marts.tables()[name].collect())) == sorted(map(str, frame.collect())), name
    assert sorted(map(str, loaded.star.lines.collect())) == sorted(map(str, published.star.lines.collect()))
    assert pipeline.documents(loaded)["dashboard"] == pipeline.documents(published)["dashboard"]
    # loading reads tables and computes none
    plan = loaded.marts.mart_rfm._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan and "Relation" in plan
    wide = loaded.star.lines._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in wide and "Window" not in wide


def test_the_run_publishes_its_manifest_and_parts_without_rows(spark, settings, shop):
    published, root = shop
    version = releases.open_version(spark, root)
    row = version.table("source_manifest").first()
    assert (row["file"], row["bytes"], row["sha256"]) == ("a.csv", 3, hashlib.sha256(b"abc").hexdigest())
    figures = {row["figure"]: row["value"] for row in version.table("audit_readiness").collect()}
    assert figures["rows_in_first"] == 12 and figures["rows_in_late"] == 0


@pytest.mark.parametrize("last", ["fact_sales", "commit"])
def test_a_run_that_dies_leaves_the_version_before(spark, settings, tmp_path, monkeypatch, last):
    root = f"file://{tmp_path}/out"
    first = pipeline.run(raw_frame(spark, *lines(6)), settings, root)
    write, move = sinks.write_table, releases._replace

    def dying(frame, path):
        if path.endswith(f"/{last}"):
            raise OSError("lost")
        return write(frame, path)

    def stuck(*arguments):
        raise OSError("lost")

    monkeypatch.setattr(sinks, "write_table", dying)
    if last == "commit":
        monkeypatch.setattr(releases, "_replace", stuck)
    with pytest.raises(OSError, match="lost"):
        pipeline.run(raw_frame(spark, *lines(9, "7")), settings, root)
    kept = pipeline.load(spark, settings, root)
    assert kept.version.folder == first.folder and kept.star.fact_sales.count() == 6
    kept.version.checked()
    monkeypatch.setattr(sinks, "write_table", write)
    monkeypatch.setattr(releases, "_replace", move)
    second = pipeline.run(raw_frame(spark, *lines(9, "7")), settings, root)
    assert pipeline.load(spark, settings, root).star.fact_sales.count() == 9
    # the version before can still be named, and goes when it is told to
    name = first.folder.rsplit("/", 1)[1]
    assert pipeline.load(spark, settings, root, version=name).star.fact_sales.count() == 6
    assert len(releases.versions(spark, root)) == 3 and name in releases.expire(spark, root, 1)
    assert releases.open_version(spark, root).folder == second.folder
    with pytest.raises(releases.NotPublished):
        releases.open_version(spark, root, name)


def test_nothing_published_and_broken_contracts_are_errors(spark, settings, tmp_path):
    root = f"file://{tmp_path}/out"
    with pytest.raises(releases.NotPublished):
        pipeline.load(spark, settings, root)
    published = pipeline.run(raw_frame(spark, *lines(4)), settings, root)
    version = releases.open_version(spark, root)
    with pytest.raises(releases.ContractError, match="no table"):
        version.table("dim_shop")
    renamed = version.table("dim_product").withColumnRenamed("description", "label")
    rows = renamed.collect()
    spark.createDataFrame(rows, renamed.schema).write.mode("overwrite").parquet(f"{published.folder}/dim_product")
    with pytest.raises(releases.ContractError, match="label"):
        pipeline.load(spark, settings, root)
    with pytest.raises(ValueError, match="current"):
        releases.expire(spark, root, 0)


def test_the_audit_finds_what_was_changed_after_publishing(spark, settings, tmp_path):
    root = f"file://{tmp_path}/out"
    published = pipeline.run(raw_frame(spark, *lines(8)), settings, root)
    sound = pipeline.audit(pipeline.load(spark, settings, root)).collect()
    assert {row["gate"] for row in sound if row["violations"]} <= {"segments_missing"}
    fact = spark.createDataFrame(
        published.star.fact_sales.withColumn(
            "product_key", F.when(F.col("sale_key") == 1, F.lit(999).cast("bigint")).otherwise(F.col("product_key"))
        ).withColumn("line_revenue", (F.col("line_revenue") + 1).cast("decimal(18,4)")).collect(),
        schemas.FACT_SALES,
    )
    fact.write.mode("overwrite").parquet(f"{published.folder}/fact_sales")
    broken = {row["gate"] for row in pipeline.audit(pipeline.load(spark, settings, root)).collect() if row["violations"]}
    assert {"orphan_product_key", "trend_net_revenue_differs", "country_gross_differs"} <= broken
    fact.where("sale_key > 2").write.mode("overwrite").parquet(f"{published.folder}/fact_sales")
    with pytest.raises(releases.ContractError, match="fact_sales: 6 rows of 8"):
        pipeline.audit(pipeline.load(spark, settings, root))


def test_figures_of_the_writes_equal_those_of_a_scan(shop):
    published, _ = shop
    built = (published.cleaned, published.star, published.marts)
    scanned = sorted(gates.gate_report(*built).collect())
    assert sorted(gates.gate_report(*built, written=True).collect()) == scanned
    written = gates.total_gates(published.star, published.marts, written=True)
    assert "fact_lines" not in str(written._jdf.queryExecution().executedPlan())
    assert published.star.written["rows"] == 12 and published.cleaned.written["kept_revenue"] == sum(
        Decimal("2.55") * (n % 5 + 1) for n in range(12)
    )


def test_orphans_take_one_scan_and_gaps_a_join(spark, settings, shop):
    published, _ = shop
    star = published.star
    report = gates.orphan_gates(star, settings)
    assert {row["gate"]: row["violations"] for row in report.collect()} == {f"orphan_{key}": 0 for key in gates.KEYS}
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    from dataclasses import replace

    gap = replace(star, dim_product=star.dim_product.where("product_key <> 2"))
    lost = {row["gate"]: row["violations"] for row in gates.orphan_gates(gap, settings).collect()}
    assert lost["orphan_product_key"] == star.fact_sales.where("product_key = 2").count() > 0


def test_large_files_are_hashed_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "ROW_BYTES", 1000)
    monkeypatch.setattr(manifest, "BLOCK_BYTES", 64)
    content = bytes(range(256)) * 40
    for name, size in (("small.bin", 1000), ("large one.bin", 10_001), ("next.bin", 1001), ("none.bin", 0)):
        (tmp_path / name).write_bytes(content[:size])
    rows = {row["file"]: row for row in manifest.source_manifest(spark, f"file://{tmp_path}", "*.bin").collect()}
    sizes = {name: row["bytes"] for name, row in rows.items()}
    assert sizes == {"small.bin": 1000, "large one.bin": 10_001, "next.bin": 1001, "none.bin": 0}
    for name, size in sizes.items():
        assert rows[name]["sha256"] == hashlib.sha256(content[:size]).hexdigest()


def test_reports_are_table_functions(spark, hand_marts):
    made = sqlviews.register(spark, hand_marts)
    assert "mart_rfm" in made["views"] and set(made["functions"]) == {f.name for f in sqlviews.FUNCTIONS}
    every = spark.sql("SELECT * FROM market_filter()").collect()
    assert [row["country"] for row in every] == [row["country"] for row in sqlviews.panels(hand_marts)["markets"].collect()]
    assert [row["country"] for row in spark.sql("SELECT country FROM market_filter(top => 1)").collect()] == [every[0]["country"]]
    assert {row["country"] for row in spark.sql("SELECT * FROM market_filter(region => 'Asia')").collect()} == {"Japan"}
    assert spark.sql("SELECT MAX(month_offset) FROM cohort_depth(depth => 2)").first()[0] == 2
    sizes = [row["customers"] for row in spark.sql("SELECT * FROM segments_by(measure => 'customers') ORDER BY place").collect()]
    assert sizes == sorted(sizes, reverse=True)
    units = [row["units"] for row in spark.sql("SELECT * FROM products_by('units') ORDER BY place").collect()]
    assert units == sorted(units, reverse=True) and units
    with pytest.raises(Exception, match="no such measure"):
        spark.sql("SELECT * FROM products_by(measure => 'weight')").collect()


def test_stages_can_be_counted_while_they_are_written(spark):
    store = StageStore(spark)
    table, seen = store.save_observed(spark.range(10), "ten", {"rows": F.count(F.lit(1)), "most": F.max("id")})
    assert seen == {"rows": 10, "most": 9} and table.count() == 10
