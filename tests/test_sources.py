import datetime
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from advertide.operators import imports as I
from advertide.sources import listings as L
from advertide.sources import registries as G
from advertide.sources import release as R
from advertide.sources import sinks as K

HEADER = ["ANZSCO_CODE", "ANZSCO_TITLE", "State", "Adjustment", "Jan-06", "Feb-06"]


def sheet(spark, sheets):
    rows = [(name, i + 1, cells) for name, lines in sheets.items() for i, cells in enumerate(lines)]
    return spark.createDataFrame(rows, "sheet string, row_index int, cells array<string>")


def parse(spark, sheets):
    df = sheet(spark, sheets)
    layout = R.layouts(df)
    stated = R.stated_rows(df, layout)
    read = R.readings(stated, "src", "data", "ads")
    return df, layout, stated, read, R.first_readings(read)


RELEASE = {
    "A": [
        ["Title"], [None, " "], HEADER,
        ["2211", "Accountants", "New South Wales", "Original", "111", "0"],
        ["2211", "Accountants", "New South Wales", "Trend", "1,234", "np"],
        ["2211", "Accountants", "Victoria", None, "..", "-"],
        [None, " ", None, "Original", "7", "8"],
        [None, None, None, None, None, None],
    ],
    "B": [HEADER, ["2211", "Accountants", "New South Wales", "Original", "111", "5"]],
    "Notes": [["nothing"], ["here"]],
    "Bare": [["Jan-06", "Feb-06"], ["1", "2"]],
}


def test_release_readings(spark):
    _, _, stated, read, first = parse(spark, RELEASE)
    got = {(r["series_key"].split("g:")[1], r["period_start"].isoformat()): (r["value_state"], r["value"]) for r in R.observations(first).collect()}
    nsw = "n.new-south-wales|o:c.2211"
    assert got == {
        (f"{nsw}|adjustment.original", "2006-01-01"): ("PRESENT", 111.0),
        (f"{nsw}|adjustment.original", "2006-02-01"): ("ZERO", 0.0),
        (f"{nsw}|adjustment.trend", "2006-01-01"): ("PRESENT", 1234.0),
        (f"{nsw}|adjustment.trend", "2006-02-01"): ("SUPPRESSED", None),
        ("n.victoria|o:c.2211", "2006-01-01"): ("NOT_COVERED", None),
    }
    repeated = R.repeats(read, first)
    assert sorted((r["label"], r["agrees"]) for r in repeated.collect()) == [("Feb-06", False), ("Jan-06", True)]
    problems = sorted((r["kind"], r["sheet"], r["row_index"], r["raw"]) for r in R.problems(stated, read, repeated).collect())
    assert problems == [
        ("CONFLICTING_DUPLICATE", "B", 2, "5.0"),
        ("NO_DIMENSIONS", "A", 7, " |  |  | Original | 7 | 8"),
        ("UNREADABLE_VALUE", "A", 6, "-"),
    ]


def test_sheet_report(spark):
    _, layout, stated, _, _ = parse(spark, RELEASE)
    got = {r["sheet"]: r for r in R.sheet_report(layout, stated).collect()}
    assert (got["A"]["status"], got["A"]["header_row"], got["A"]["data_rows"], got["A"]["first_period"]) == ("PARSED", 3, 3, "2006-01")
    assert (got["Notes"]["status"], got["Notes"]["reason"]) == ("SKIPPED", "no header row")
    assert (got["Bare"]["reason"], got["Bare"]["header_row"]) == ("periods without a dimension", 1)


def test_the_better_spelled_column_wins(spark):
    lines = [["Code", "ANZSCO Code", "State", "Region Name", "Jan-06", "Feb-06"], ["x", "12", "NSW", "Sydney", "1", "2"]]
    _, _, stated, _, _ = parse(spark, {"A": lines})
    row = stated.collect()[0]
    assert (row["occupation_code"], row["geography_name"]) == ("12", "Sydney")


def test_sheets_are_read_as_text(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    os.makedirs(f"{folder}/sheet=One")
    with open(f"{folder}/sheet=One/rows.csv", "w") as out:
        out.write('1,State,Jan-06,Feb-06\n2,NSW,"1,234",0\n')
    got = R.read_sheets(spark, folder, 3).orderBy("row_index").collect()
    assert [(r["sheet"], r["row_index"], r["cells"]) for r in got] == [("One", 1, ["State", "Jan-06", "Feb-06"]), ("One", 2, ["NSW", "1,234", "0"])]


def test_release_import_is_idempotent_and_gated(spark):
    areas = spark.createDataFrame([("1", "New South Wales")], "code string, name string")
    jobs = spark.createDataFrame([("2211", "2211/v1")], "code string, occupation_id string")
    nothing = spark.createDataFrame([], "series_key string, period_start date, value double, value_state string")
    lines = [HEADER] + [["2211", "Accountants", "NSW", str(i), "1", "2"] for i in range(40)]
    args = (areas, jobs, "src", "data", "ads", "ads", 1)
    first = I.import_release(sheet(spark, {"A": lines}), nothing, *args)
    row = first.counts.collect()[0]
    # Retention narrows what is written to one period of the two that were seen.
    assert (row["records_seen"], row["records_written"], row["records_quarantined"], row["status"]) == (80, 40, 0, "COMPLETED")
    assert {(r["geography_resolution"], r["occupation_resolution"]) for r in first.series.collect()} == {("RESOLVED", "RESOLVED")}
    again = I.import_release(sheet(spark, {"A": lines}), first.observations, *args).counts.collect()[0]
    assert (again["records_written"], again["records_skipped"]) == (0, 40)
    broken = [HEADER] + [["2211", "Accountants", "NSW", str(i), "?", "2"] for i in range(4)]
    stored = spark.createDataFrame([("k", datetime.date(2001, 1, 1), 1.0, "PRESENT"), ("k", datetime.date(2001, 2, 1), 2.0, "PRESENT")], nothing.schema)
    failed = I.import_release(sheet(spark, {"A": broken}), stored, *args)
    gated = failed.counts.collect()[0]
    assert gated["status"] == "FAILED" and gated["records_quarantined"] == 4
    # What is stored stays, also what retention would have dropped.
    assert sorted((r["series_key"], r["period_start"].month, r["value"], r["action"]) for r in failed.observations.collect()) == [("k", 1, 1.0, "KEPT"), ("k", 2, 2.0, "KEPT")]


def test_only_retained_periods_are_taken_apart(spark, monkeypatch):
    """Figures, faults and repeats of older periods count, but only readings of the retained ones are kept."""
    areas = spark.createDataFrame([("1", "New South Wales")], "code string, name string")
    jobs = spark.createDataFrame([("2211", "2211/v1")], "code string, occupation_id string")
    nothing = spark.createDataFrame([], "series_key string, period_start date, value double, value_state string")
    months = ["Jan-06", "Feb-06", "Mar-06", "Apr-06", "May-06", "Jun-06"]
    head = ["ANZSCO Code", "State", *months]
    # The newest column holds no figure at all; an old cell is a word; two rows state one series.
    lines = [head] + [["2211", f"S{i}", "?" if i == 3 else "1", "2", "3", "4", "5", "?"] for i in range(40)]
    lines += [["2211", "S0", "1", "2", "9", "4", "5", "?"], [None, None, "1", "2", "3", "4", "5", "6"]]
    old = [["ANZSCO Code", "State", "Jan-05", "Feb-05"], ["2211", "Old", "1", "x"]]
    kept, staged = {}, I.stage

    def watched(df, name):
        kept.setdefault(name, []).append(staged(df, name))
        return kept[name][-1]

    monkeypatch.setattr(I, "stage", watched)
    done = I.import_release(sheet(spark, {"A": lines, "B": old}), nothing, areas, jobs, "src", "data", "ads", "ads", 2)
    row = done.counts.collect()[0]
    words = 41 + 1 + 1  # the newest column, one old cell, one of the older sheet
    usable = 41 * 6 + 2 - words
    repeats = {"agree": 4, "contradict": 1}
    assert row["records_seen"] == usable - 5 + words + repeats["contradict"] + 1
    assert row["records_quarantined"] == words + repeats["contradict"] + 1
    assert row["records_skipped"] == repeats["agree"]
    assert row["records_written"] == 2 * 40
    at = lambda df: sorted({r["period_start"].month for r in df.select("period_start").collect()})
    # One period short in the first try, so the second takes twice the columns; never all of them.
    assert [at(df) for df in kept["readings"]] == [[5, 6], [3, 4, 5, 6]]
    # A series without a retained figure is still described.
    assert done.series.count() == 41
    assert done.quarantined.count() == row["records_quarantined"]


def test_a_sheet_of_old_periods_is_no_fault(spark):
    """Narrowing leaves a sheet no column at all; its rows are read, its cells are not."""
    sheets = sheet(spark, {"A": [HEADER, ["2211", "Accountants", "NSW", "x", "1", "2"]], "B": [["State", "Jan-01", "Q1 2002"], ["NSW", "1", "2"]]})
    stated = R.stated_rows(sheets, R.layouts(sheets), recent_periods=1)
    assert {r["sheet"]: (len(r["periods"]), r["granularity"]) for r in stated.collect()} == {"A": (1, "MONTH"), "B": (0, "MONTH")}
    assert R.readings(stated, "s", "d", "m").count() == 1


def test_a_completed_release_is_not_read_again(spark):
    areas = spark.createDataFrame([("1", "New South Wales")], "code string, name string")
    jobs = spark.createDataFrame([("2211", "2211/v1")], "code string, occupation_id string")
    nothing = spark.createDataFrame([], "series_key string, period_start date, value double, value_state string")
    lines = {"A": [HEADER] + [["2211", "Accountants", "NSW", str(i), "1", "2"] for i in range(5)]}
    args = (areas, jobs, "src", "data", "ads", "ads", 2)
    at = {"started": "2001-01-01 00:00:00", "finished": "2001-01-01 00:05:00"}
    none_run = spark.createDataFrame([], "source_key string, dataset string, status string, checksum string")
    first = I.import_release(sheet(spark, lines), nothing, *args, runs=none_run, checksum="c1", **at)
    run = first.ledger.collect()
    assert [(r["status"], r["records_written"], r["checksum"], r["finished_at"].minute) for r in run] == [("COMPLETED", 10, "c1", 5)]
    runs = spark.createDataFrame([(r["source_key"], r["dataset"], r["status"], r["checksum"]) for r in run], none_run.schema)
    keys = {r["series_key"] for r in first.series.collect()}
    gone = first.series.withColumn("series_key", F.concat("series_key", F.lit("-old")))
    stored = first.series.withColumn("geography_resolution", F.lit("UNRESOLVED")).unionByName(gone)
    again = I.import_release(sheet(spark, lines), first.observations, *args, stored_series=stored, runs=runs, checksum="c1", **at)
    assert [(r["status"], r["records_seen"]) for r in again.ledger.collect()] == [("SKIPPED", 0)]
    assert again.observations.count() == 10
    assert {r["action"] for r in again.series.collect()} == {"KEPT"}
    # A skipped run prunes nothing either, however few periods are to be kept.
    fewer = I.import_release(sheet(spark, lines), first.observations, *args[:-1], 1, stored_series=stored, runs=runs, checksum=F.lit("c1"), **at)
    assert fewer.observations.count() == 10
    # Another checksum is read, and its series are resolved anew beside those it does not name.
    other = I.import_release(sheet(spark, lines), first.observations, *args, stored_series=stored, runs=runs, checksum="c2", **at)
    assert [(r["status"], r["records_skipped"]) for r in other.ledger.collect()] == [("COMPLETED", 10)]
    got = {r["series_key"]: (r["action"], r["geography_resolution"]) for r in other.series.collect()}
    assert got == {k: ("UPDATED", "RESOLVED") for k in keys} | {k + "-old": ("KEPT", "RESOLVED") for k in keys}


def lines_of(spark, records):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "value string")


GOOD = {"id": 7, "title": "Cook", "redirect_url": "https://x.com/7"}


@pytest.mark.parametrize(
    "change, faults",
    [
        ({}, []),
        ({"unknown": [1]}, []),
        ({"id": ""}, ["id"]),
        ({"id": None}, ["id"]),
        ({"title": 5}, ["title"]),
        ({"redirect_url": "nowhere"}, ["redirect_url"]),
        ({"salary_min": "12"}, ["salary_min"]),
        ({"company": {"display_name": 3}}, ["company.display_name"]),
        ({"salary_is_predicted": "1"}, []),
    ],
)
def test_feed_records(spark, change, faults):
    assert L.parse_listings(lines_of(spark, [{**GOOD, **change}])).collect()[0]["faults"] == faults


def test_rejects_keep_what_came(spark):
    parsed = L.parse_listings(lines_of(spark, [GOOD, "{broken", {"id": "x"}]))
    assert L.accepted(parsed).count() == 1
    assert {(r["source_id"], r["raw"]) for r in L.rejected(parsed).collect()} == {(None, "{broken"), ("x", '{"id": "x"}')}


def test_canonical_listing(spark):
    record = {
        **GOOD, "title": "<b>Chef</b> &amp; cook", "description": "A&nbsp;job", "company": {"display_name": " Acme "},
        "location": {"area": ["Australia", "Perth"]}, "latitude": 1.5, "salary_min": 10, "salary_is_predicted": 1,
        "contract_type": "Contract", "created": "2024-05-01T10:00:00Z", "category": {"tag": "it"},
    }
    row = L.canonical_listings(L.accepted(L.parse_listings(lines_of(spark, [record, GOOD]))), "feed", "au").orderBy(F.desc("title")).collect()
    plain, full = row
    assert (full["title"], full["description"], full["company_name"], full["location_text"]) == ("Chef & cook", "A job", "Acme", "Australia, Perth")
    assert (full["salary_currency"], full["salary_basis"], full["employment_type"], full["latitude"]) == ("AUD", "SOURCE_ESTIMATED", "CONTRACT", 1.5)
    assert full["posted_at"].isoformat() == "2024-05-01T10:00:00" and full["category_label"] == "it"
    assert plain["description"] is None and plain["salary_basis"] is None and plain["location_text"] is None


def test_a_faulty_result_page_is_a_row_beside_the_good_ones(spark):
    good = 'of <strong> 3</strong> matching<ol class="search-results jobs">{}</ol>'
    items = [
        '<li><h3><a href="/jobs/r1">Clerk, Health</a></h3></li>',
        '<li><h3><a href="jncustomsearch.viewFullSingle?x=1">Cook, Health</a></h3></li>',
        '<li><h3><a href="/jobs/r2"> </a></h3></li>',
    ]
    pages = spark.createDataFrame([(1, "<p>nothing</p>"), (2, None), (3, good.format("".join(items)))], "page_id int, html string")
    got = L.parse_result_pages(pages, "https://x.com/").collect()
    assert sorted((r["page_id"], r["reference"] or "", tuple(r["faults"])) for r in got) == [
        (1, "", ("no result count",)), (2, "", ("no result count",)),
        (3, "", ("no reference",)), (3, "r1", ()), (3, "r2", ("no heading",)),
    ]


def test_a_page_of_results_with_nested_lists(spark):
    html = (
        'of <strong> 2,038</strong> matching jobs<ol class="search-results jobs"><li><h3><A HREF="jncustomsearch.viewFullSingle?in_organid=1&amp;in_jnCounter=22" '
        "onMouseOver=\"x\">Clerk, AO3, Health</A></h3><ul class=\"location\"><li><strong class=\"locality\">Gold Coast,Cairns region</strong></li></ul></li></ol>"
    )
    row = L.parse_result_pages(spark.createDataFrame([(1, html)], "page_id int, html string"), "https://x.com/jobs/tool/").collect()[0]
    assert (row["total"], row["reference"], row["title"], row["employer"]) == (2038, "22", "Clerk, AO3", "Health")
    assert row["localities"] == ["Gold Coast", "Cairns region"]
    assert row["detail_url"] == "https://x.com/jobs/tool/jncustomsearch.viewFullSingle?in_organid=1&in_jnCounter=22"


ABOUT = K.Provenance("Title", "Pub", "Set", "2024-05", "CC", "https://l", "Attr", "Sum", "src", "2024-05-20T00:00:00.000Z")


def test_csv_export(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/out"
    rows = spark.createDataFrame([("b", None, 2.5), ("a", 'say "hi", x', 10.0)], "code string, name string, n double")
    K.write_lines(K.csv_lines(rows, {"code": "Code", "name": "Name, full", "n": "N"}, ABOUT, [F.col("code")]), folder)
    parts = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
    text = "".join(open(f"{folder}/{p}", newline="").read() for p in parts)
    assert text.endswith('Code,"Name, full",N\r\na,"say ""hi"", x",10\r\nb,,2.5\r\n')
    assert text.startswith("# Title\r\n#\r\n# Publisher: Pub\r\n") and "# Reference period: 2024-05\r\n" in text


def test_json_export_of_rows_at_one_place(spark, monkeypatch):
    """Every row is at the least place and most are alike: one document with all of them, nothing numbered in one task."""
    monkeypatch.setattr(K, "STRETCH", 3)
    rows = spark.createDataFrame([(1, "a")] * 10 + [(1, "b"), (1, None)], "id int, name string")
    lines = K.json_lines(rows, {"id": "Id", "name": "Name"}, ABOUT, [F.col("id")])
    assert "Window" not in lines._jdf.queryExecution().optimizedPlan().toString()
    told = [r["line"] for r in lines.sort("part", "seat", "place").collect()]
    names = [r["name"] for r in json.loads("".join(told))["rows"]]
    assert sorted(names, key=str) == [None] + ["a"] * 10 + ["b"]
    nothing = K.json_lines(rows.limit(0), {"id": "Id", "name": "Name"}, ABOUT, [F.col("id")]).sort("part", "seat", "place").collect()
    assert json.loads("".join(r["line"] for r in nothing))["rows"] == []


def test_json_export_is_one_document(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/out"
    rows = spark.range(50).select(F.col("id"), F.when(F.col("id") % 2 == 0, "x").alias("name")).repartition(8)
    K.write_lines(K.json_lines(rows, {"id": "Id", "name": "Name"}, ABOUT, [F.col("id")]), folder, "\n")
    parts = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
    document = json.loads("".join(open(f"{folder}/{p}").read() for p in parts))
    assert [r["id"] for r in document["rows"]] == list(range(50)) and document["rows"][1] == {"id": 1, "name": None}
    assert document["provenance"]["referencePeriod"] == "2024-05" and document["columns"][1] == {"key": "name", "heading": "Name"}


def test_registries(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    area = {"code": "1", "name": "N", "level": "STATE", "parentCode": None, "hasGeometry": True, "areaSqKm": 1.5}
    with open(f"{folder}/areas.json", "w") as out:
        json.dump([area, {**area, "code": ""}, {**area, "level": "MOON"}], out)
    checked = G.read_area_registry(spark, f"{folder}/areas.json")
    assert sorted(r["faults"] for r in checked.collect()) == [[], ["code"], ["level"]]
    with pytest.raises(Exception, match="failed"):
        G.require_valid(checked).collect()
    with open(f"{folder}/features.json", "w") as out:
        json.dump({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": None, "properties": {"C": " 1 ", "N": "x", "A": 2.5, "L": ""}}]}, out)
    row = G.feature_areas(G.read_features(spark, f"{folder}/features.json"), "STATE", "C", "N", None, "A", "L").collect()[0]
    assert tuple(row) == ("1", "x", "STATE", None, False, 2.5, None)
    with open(f"{folder}/verdicts.json", "w") as out:
        json.dump({"instrument": {"id": "L", "registerId": "F"}, "areas": [{"code": "1", "name": "n", "stateCode": None, "status": "MIXED", "distinctPostcodes": 2}]}, out)
    assert tuple(G.read_verdicts(spark, f"{folder}/verdicts.json").collect()[0]) == ("L", "1", "n", None, "MIXED", 2)
    with pytest.raises(ValueError, match="missing columns"):
        G.required_columns(spark.range(1), {"MB_CODE": "unit"})
