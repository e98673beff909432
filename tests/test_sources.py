"""Pinned scans, bundles and worksheets."""

import hashlib
import zipfile

import pytest

from tidemark.sources import pinned


def test_csv_is_text_with_row_numbers_and_raw_json(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("id,name,score\n1,NA,\n2,\"b, c\",6-4\n1,x,3\n")
    sha = hashlib.sha256(f.read_bytes()).hexdigest()
    rows = pinned.read_csv(spark, str(f), sha).orderBy("_source_row_number").collect()
    assert [(r["_source_row_number"], r["id"], r["name"], r["score"]) for r in rows] == [(2, "1", "NA", ""), (3, "2", "b, c", "6-4"), (4, "1", "x", "3")]
    assert rows[1]["_raw_record_json"] == '{"id":"2","name":"b, c","score":"6-4"}'
    with pytest.raises(pinned.SourceError):
        pinned.read_csv(spark, str(f), "0" * 64)


def test_headers(spark, tmp_path):
    for text in ("a,a\n1,2\n", "a,\n1,2\n"):
        f = tmp_path / "h.csv"
        f.write_text(text)
        with pytest.raises(pinned.SourceError):
            pinned.read_csv(spark, str(f))
    with pytest.raises(pinned.SourceError):
        pinned.require(spark.range(1), ["id", "other"])


def test_many_files_keep_their_tags(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "y.csv").write_text("a\n3\n")
    got = pinned.read_many(spark, {str(tmp_path / "x.csv"): {"tour": "A"}, str(tmp_path / "y.csv"): {"tour": "B"}})
    assert sorted((r["tour"], r["a"], r["b"]) for r in got.collect()) == [("A", "1", "2"), ("B", "3", None)]


def test_bundle_round_trip_and_tampering(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], None), (2, [], 0.5)], "id long, codes array<string>, x double")
    bundle = pinned.write_bundle({"rows": df}, str(tmp_path))
    assert pinned.write_bundle({"rows": df.orderBy("id", ascending=False)}, str(tmp_path)) == bundle
    assert sorted(r["id"] for r in pinned.read_bundle(spark, str(tmp_path), bundle, "rows").collect()) == [1, 2]
    df.limit(1).write.mode("overwrite").parquet(str(tmp_path / bundle / "rows"))
    with pytest.raises(pinned.SourceError):
        pinned.read_bundle(spark, str(tmp_path), bundle, "rows")


def test_worksheet(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>Date</t></si><si><t>Winner</t></si><si><t>Smith J.</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>45000</v></c><c r="B2" t="s"><v>2</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in pinned.read_xlsx(spark, str(tmp_path / "w.xlsx")).collect()] == [("45000", "Smith J.")]


def test_feed_and_score_text(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"matches": [{"id": "1", "eventCode": "MS", "statusCode": "D", "sets": [[{"score": 6, "tiebreak": null}, {"score": 4, "tiebreak": null}], [{"score": 7, "tiebreak": 7}, {"score": 6, "tiebreak": 5}]]}, {"id": "2", "eventCode": "XX", "statusCode": "D", "sets": []}, {"id": "3", "eventCode": "MS", "statusCode": "P", "sets": []}]}')
    schema = "matches array<struct<id:string,eventCode:string,statusCode:string,sets:array<array<struct<score:int,tiebreak:int>>>>>"
    good, out = pinned.read_feed(spark, str(tmp_path / "f.json"), schema, ["MS"], "D")
    assert [r[0] for r in good.select(pinned.score_text(good["sets"])).collect()] == ["6-4 7-6(5)"]
    assert sorted((r["id"], r["reason"]) for r in out.collect()) == [("2", "OTHER_EVENT"), ("3", "NOT_FINISHED")]
