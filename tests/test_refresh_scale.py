"""Steps of landing and refresh that must not repeat work or sort what can be combined by hash."""

from __future__ import annotations

import contextlib
import pathlib

import pytest
from pyspark.sql import functions as F

from reactorlake.functions import dates as D
from reactorlake.operators.upsert import dimension_from_batch, last_wins, latest
from reactorlake.sources import landing as L
from reactorlake.sources.tables import materialize

RECORD = "period string, facility string, facilityName string, capacity string, outage string, percentOutage string"


def _records(spark, n):
    return spark.createDataFrame([(f"2024-01-{i % 28 + 1:02d}", str(i), "A", "1", "2", "3") for i in range(n)], RECORD)


def test_page_envelopes_compute_the_records_once(spark):
    """The reported total is counted on the stored numbering, not by a second run of the records' plan."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def met(_):
        seen.add(1)
        return True

    pages = L.page_envelopes(_records(spark, 10).where(met("facility")), None, 4).collect()
    assert sorted((p["offset"], p["response"]["total"], len(p["response"]["data"])) for p in pages) == [(0, "10", 4), (4, "10", 4), (8, "10", 2)]
    assert seen.value == 10


def test_landed_pages_are_compressed_and_read_back(spark, tmp_path):
    records = _records(spark, 40)
    L.write_pages(records, f"{tmp_path}/landing/run-1", page_size=7)
    files = [f for f in pathlib.Path(tmp_path).rglob("part-*")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    got = L.landed_records(spark, f"{tmp_path}/landing", page_size=7).select(*records.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, records.collect()))


def test_latest_is_last_wins_without_a_sort(spark):
    rows = [("a", 1.0, None, 5), ("a", None, 2.0, 9), ("b", 3.0, 4.0, 1), ("a", 7.0, 7.0, 6), (None, 1.0, 1.0, 2), (None, 2.0, None, 3)]
    df = spark.createDataFrame(rows, "k string, x double, y double, ord bigint")
    ours = latest(df, ["k"], "ord")
    assert sorted(map(str, ours.collect())) == sorted(map(str, last_wins(df, ["k"], "ord", keep_seq=True).select("k", "x", "y", "ord").collect()))
    assert "SortAggregate" not in ours._jdf.queryExecution().executedPlan().toString()


def test_dimension_of_an_integer_order(spark):
    rows = [("1", "old", 1), ("1", "new", 8), ("1", "old", 5), ("2", "only", 3)]
    df = spark.createDataFrame(rows, "facility_id string, facility_name string, ord bigint")
    assert sorted(map(tuple, dimension_from_batch(df, "ord").collect())) == [("1", "new", 8), ("2", "only", 3)]


def test_ord_and_places_give_seq(spark, tmp_path):
    """Runs in natural order, pages by offset, records by position: ``ord`` orders as ``seq`` and leads back to it."""
    for run, first in (("run-9", 0), ("run-10", 20)):
        L.write_pages(_records(spark, 10 + first), f"{tmp_path}/landing/{run}", page_size=4)
    pages = materialize(L.read_pages(spark, f"{tmp_path}/landing"), "test-pages")
    places = materialize(L.page_places(pages), "test-places")
    ours = L.with_seq(L.ordered_records(pages, places).withColumn("by", F.col("ord")), places).orderBy("by").collect()
    plain = L.records_from_pages(pages).orderBy("seq").collect()
    assert [r["seq"] for r in ours] == [r["seq"] for r in plain]
    assert [(r["period"], r["facility"], r["run"]) for r in ours] == [(r["period"], r["facility"], r["run"]) for r in plain]


def test_page_infos_bounds_with_odd_periods(spark):
    odd = [["2024-03-01", "2024-01-05", None], ["2024-1-5", "2024-02-02"], ["abcdefghij", "2024-02-02"], ["2024-02-31", "2024-02-01"], ["", "2023-12-31"], [None], [], ["0000000000", "2024-05-05", "2024-04-04"]]
    pages = spark.createDataFrame([("r", "f", 0, i, 9, [(p, "1", "n", "1", "1", "1") for p in ps], None) for i, ps in enumerate(odd)], f"run string, file string, at bigint, offset bigint, total bigint, data array<struct<{RECORD.replace(' ', ':').replace(',:', ',')}>>, broken string")
    got = {r["offset"]: (str(r["low"]), str(r["high"])) for r in L.page_infos(pages).collect()}
    assert got == {0: ("2024-01-05", "2024-03-01"), 1: ("2024-02-02",) * 2, 2: ("2024-02-02",) * 2, 3: ("2024-02-01",) * 2, 4: ("2023-12-31",) * 2, 5: ("None",) * 2, 6: ("None",) * 2, 7: ("2024-04-04", "2024-05-05")}


def test_page_texts_are_the_envelopes_json(spark):
    rows = [("2024-01-01", "1", 'a "quoted" \\ näme\n', "1.5", "", None), (None, None, None, None, None, None), ("2024-01-03", "é", "", "n/a", "2", "3"), ("2024-01-04", "4", "d", "1", "2", "3")]
    records = spark.createDataFrame(rows, RECORD).coalesce(1)
    for order in (None, [F.col("facility")]):
        for total in (None, 99):
            plain = L.page_envelopes(records, order, 3, 6, total).select("offset", F.to_json(F.struct("offset", "response")).alias("value"))
            assert sorted(map(tuple, L.page_texts(records, order, 3, 6, total).collect())) == sorted(map(tuple, plain.collect()))


def test_empty_frames_need_no_task(spark):
    from pyspark.sql import types as T

    from reactorlake.schemas import FACILITY_SCHEMA, SEQ_SCHEMA
    from reactorlake.sources.tables import empty_frame

    schema = T.StructType([*FACILITY_SCHEMA.fields, T.StructField("seq", SEQ_SCHEMA)])
    empty = empty_frame(spark, schema)
    assert [(f.name, f.dataType) for f in empty.schema.fields] == [(f.name, f.dataType) for f in schema.fields]
    assert empty.collect() == [] and "LocalTableScan <empty>" in empty._jdf.queryExecution().executedPlan().toString()


def test_page_infos_read_only_periods(spark, tmp_path):
    L.write_pages(_records(spark, 10), f"{tmp_path}/landing/run-1", page_size=4)
    infos = L.page_infos(materialize(L.read_pages(spark, f"{tmp_path}/landing"), "test-pages"))
    assert sorted((r["offset"], r["n"]) for r in infos.collect()) == [(0, 4), (4, 4), (8, 2)]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = infos.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "data:array<struct<period:string>>" in plan


def test_a_batch_is_staged_once(spark, scratch, monkeypatch):
    """The merge stages its rows once, with what they do; a first load stages none."""
    from reactorlake.plans import refresh as RF
    from reactorlake.sources.tables import Warehouse

    labels = []
    monkeypatch.setattr(RF, "materialize", lambda df, label: labels.append(label) or materialize(df, label))
    wh = Warehouse(spark, f"{scratch}/wh")
    landing = RF.Landing(f"{scratch}/landing", f"{scratch}/none", page_size=4)
    L.write_pages(_records(spark, 10), f"{scratch}/landing/run-1", page_size=4)
    RF.full_refresh(spark, landing, wh)
    L.write_pages(_records(spark, 12).withColumn("outage", F.lit("7")), f"{scratch}/landing/run-2", page_size=4)
    labels.clear()
    counts = RF.incremental_refresh(spark, landing, wh, lookback_days=400)
    assert [x for x in labels if x.startswith("facts")] == ["facts-kinds"] and counts["facility_outages"] == 12
    got = wh.load_snapshot("facility")
    assert got.count() == 12 and [r["outage"] for r in got.select("outage").distinct().collect()] == [7.0]
    assert str(RF._newest(wh, "facility_outages")) == "2024-01-12"
    labels.clear()
    first = Warehouse(spark, f"{scratch}/first")
    pages = materialize(L.read_pages(spark, f"{scratch}/landing"), "test-pages")
    batch = RF.judge(spark, landing, f"{scratch}/landing", "facility", pages, L.landed_files(spark, f"{scratch}/landing"), None, None)
    n, plants, newest = RF.apply_facility_batch(spark, first, batch.rows, batch.places)
    assert (n, plants, str(newest)) == (12, 12, "2024-01-12") and not [x for x in labels if x.startswith("facts")]
    assert RF.apply_facility_batch(spark, first, batch.rows.where("false"), batch.places) == (0, 0, None)


@pytest.mark.parametrize("page_size", [1, 3, 4, 50])
def test_pages_of_any_order_shuffle_no_whole_page(spark, page_size):
    """Each task cuts its own rows into pages; only the rests are put together, so every page but the last is full."""
    records = _records(spark, 41).repartition(5).union(_records(spark, 0))
    pages = L.page_envelopes(records, None, page_size)
    rows = sorted(pages.collect(), key=lambda p: p["offset"])
    assert [p["offset"] for p in rows] == list(range(0, 41, page_size)) and {p["response"]["total"] for p in rows} == {"41"}
    assert {len(p["response"]["data"]) for p in rows[:-1]} <= {page_size} and 0 < len(rows[-1]["response"]["data"]) <= page_size
    assert sorted(tuple(r) for p in rows for r in p["response"]["data"]) == sorted(map(tuple, records.collect()))
    cut = L._cutter(page_size)
    assert cut(iter([])) is not None and list(cut(iter([]))) == []
    assert L.page_envelopes(_records(spark, 0), None, page_size).collect() == []


def test_whole_pages_are_not_gathered_again(spark):
    """Pages that one task has cut meet no list aggregate and no exchange by page."""
    pages, _ = L._pages(_records(spark, 41).repartition(5), 3)
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    whole = plan[: plan.index("collect_list")]
    assert "MapInArrow" not in plan and plan.count("collect_list") <= 2 and "n#" in whole


def test_dates_are_parsed_as_the_format_does(spark):
    texts = ["2024-01-05", "2024-02-30", "2024-1-5", " 2024-01-5", "2024-01-5 ", "2024-01-5T", "2024-01-05\n", "2024-01-0\n", "0000-01-01", "9999-12-31", "+12024-01-05", "-2024-01-05", "12024-01-05", "٢٠٢٤-٠١-٠٥", "", None, "2024/01/05", "1582-10-10", "0001-01-01"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.parse_date("t").alias("a"), F.try_to_date("t", D.DATE_FORMAT).alias("b")).select("t", F.col("a").eqNullSafe(F.col("b")).alias("same")).collect()
    assert [r["t"] for r in got if not r["same"]] == []
    days = spark.sql("select explode(array(date'2024-01-05', date'0001-02-03', date'9999-12-31', date'-0044-03-15', date'+12024-01-05', null)) as d")
    for r in days.select(D.format_date("d").alias("a"), F.date_format("d", "yyyy-MM-dd").alias("b"), D.format_month("d").alias("c"), F.date_format("d", "yyyy-MM").alias("e")).collect():
        assert (r["a"], r["c"]) == (r["b"], r["e"])


def test_sums_are_those_of_decimals(spark):
    """Plain prices are summed as whole numbers; the others, nulls and large ones as decimals: the same doubles either way."""
    from reactorlake.sources.adapter import _daily

    prices = [901.0, 0.285, 0.1, 1.005, 33.335, -5.25, -0.005, 21474836.47, 21474836.48, 1e13 + 0.25, 104949.5, None, 0.0]
    discounts = [0.04, 0.1, 0.005, None, 0.0, 1.0, 99.99, -0.07]
    rows = [(f"{i}-{j}", p, d) for i, p in enumerate(prices) for j, d in enumerate(discounts)]
    rows += [("all", p, d) for _, p, d in rows] + [("plain", p, d) for _, p, d in rows if p in (901.0, 104949.5) and d] + [("many", 21474836.47, 99.99)] * 3000
    df = spark.createDataFrame(rows, "k string, l_extendedprice double, l_discount double")
    price, discount = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    old = df.groupBy("k").agg(F.sum(price).cast("double").alias("capacity"), F.sum(price * discount).cast("double").alias("outage"))
    old = old.withColumn("percent_outage", F.try_divide(F.col("outage") * F.lit(100.0), F.col("capacity")))
    assert sorted(map(str, _daily(df, [F.col("k")]).collect())) == sorted(map(str, old.collect()))


def test_facts_travel_without_names(spark, scratch, monkeypatch):
    """``seq`` joins the rows after they were gathered by month, or before when there are too many places: the same table."""
    from reactorlake.plans import refresh as RF
    from reactorlake.sources.tables import SEQ_COL, Warehouse

    landing = RF.Landing(f"{scratch}/landing", f"{scratch}/none", page_size=4)
    for run in ("run-1", "run-2"):
        L.write_pages(_records(spark, 30).withColumn("outage", F.lit(run[-1])), f"{scratch}/landing/{run}", page_size=4)
    got = []
    for limit in (RF.BROADCAST_PLACES, 0):
        monkeypatch.setattr(RF, "BROADCAST_PLACES", limit)
        wh = Warehouse(spark, f"{scratch}/wh-{limit}")
        RF.refresh(spark, landing, wh)
        table = wh.load_base("facility", with_seq=True)
        assert table.where(F.col(SEQ_COL).isNull()).isEmpty() and {r["outage"] for r in table.select("outage").collect()} == {2.0}
        got.append(sorted(map(str, table.collect())))
    assert got[0] == got[1] and len(got[0]) == 30


def _largest_groups(root) -> dict[str, int]:
    """The most rows in a row group of each stage below a folder."""
    import pyarrow.parquet as pq

    found: dict[str, int] = {}
    for f in pathlib.Path(root.removeprefix("file:")).rglob("*.parquet"):
        label = f.parent.name.rsplit("-", 1)[0]
        meta = pq.ParquetFile(f).metadata
        found[label] = max([found.get(label, 0), *(meta.row_group(i).num_rows for i in range(meta.num_row_groups))])
    return found


def test_staged_pages_are_read_a_few_at_a_time(spark, scratch):
    """A task reads whole row groups, up to 4,096 rows: of pages they hold a few, however many its file has."""
    from reactorlake.plans import refresh as RF
    from reactorlake.sources.tables import GROUP_RECORDS, Warehouse, stage_scope

    size, n = 500, 60_000
    few = GROUP_RECORDS // size
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int") % 28), "yyyy-MM-dd")
    records = spark.range(0, n, 1, 1).select(day.alias("period"), F.col("id").cast("string").alias("facility"), F.lit("A").alias("facilityName"), *[F.lit("1").alias(c) for c in ("capacity", "outage", "percentOutage")])
    landing = RF.Landing(f"{scratch}/landing", f"{scratch}/none", page_size=size)
    wh = Warehouse(spark, f"{scratch}/wh")
    with stage_scope(spark) as root:
        L.write_pages(records, f"{landing.facility}/run-1", page_size=size)
        texts = L.stage_pages(L.page_texts(records, None, size), "texts", size)
        assert texts.count() == n // size
        RF.full_refresh(spark, landing, wh)
        groups = _largest_groups(root)
    assert all(0 < groups[label] <= few for label in ("pages-cut", "texts", "facility-pages")), groups
    assert groups["facility-records"] == n  # flat rows are not cut up
    with stage_scope(spark) as root:
        assert L.landed_records(spark, landing.facility, page_size=size).count() == n
        assert 0 < _largest_groups(root)["pages"] <= few
    assert wh.load_snapshot("facility").count() == n


def test_a_stream_stages_its_pages_a_few_at_a_time(spark, scratch, monkeypatch):
    """Pages of a micro-batch lie in row groups of a few, too."""
    from reactorlake.sources import tables
    from reactorlake.sources.tables import Warehouse
    from reactorlake.streaming import refresh_stream as RS

    groups, scope = {}, RS.stage_scope

    @contextlib.contextmanager
    def kept(session):
        with scope(session) as root:
            yield root
            groups.update(_largest_groups(root))

    monkeypatch.setattr(RS, "stage_scope", kept)
    monkeypatch.setattr(tables, "GROUP_RECORDS", 8)
    L.write_pages(_records(spark, 40).coalesce(1), f"{scratch}/landing/run-1", page_size=4)
    wh = Warehouse(spark, f"{scratch}/wh")
    RS.run_available(spark, f"{scratch}/landing", "facility", wh, page_size=4)
    assert 0 < groups["facility-stream-pages"] <= 2 and wh.load_snapshot("facility").count() == 40


@pytest.mark.parametrize(("query", "label"), [("landed_broken_pages", "broken-pages"), ("stream_gap_filled", "stream-gap-pages")])
def test_staged_texts_are_read_a_few_at_a_time(spark, tmp_path, monkeypatch, query, label):
    """Texts of pages that queries land later lie in row groups of a few."""
    from reactorlake.plans import registry
    from reactorlake.sources import tables

    days = spark.range(0, 60, 1, 1)
    lines = days.select(F.timestamp_add("DAY", F.col("id"), F.lit("2024-01-01").cast("timestamp")).alias("l_shipdate"), (F.col("id") % 3).alias("l_suppkey"), F.lit(10.0).alias("l_extendedprice"), F.lit(0.05).alias("l_discount"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(3).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(registry, "GAP_PAGE", 3)
    monkeypatch.setattr(tables, "GROUP_RECORDS", 6)
    with tables.stage_scope(spark) as root:
        rows = getattr(registry, query)(spark, str(tmp_path)).collect()
        groups = _largest_groups(root)
    assert rows and 0 < groups[label] <= 2, groups
