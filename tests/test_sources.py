import json
import os

import pytest
from pyspark.sql import functions as F

from embertrace.plans.ingest import clean, ingest
from embertrace.sources import readers, writers
from embertrace.sources.schemas import METADATA, PROCESSED, conform
from embertrace.streaming.ingest import ingest_new_files, windowed_counts


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture
def raw(tmp_path):
    root = str(tmp_path / "raw")
    put(f"{root}/2020/chat.csv", 'time,type,key,slot,player_slot,match_id,leagueid,unit\n7.5,chat,"gg, wp",1,0,1,9,u\n1,ChatWheel,hi,1,0,1,9,u\n2,,ｇｇ ,1,130,1,9,u\n3,chat,   ,1,0,2,9,u\n4,chat,hey,1,0,3,9,u\n')
    put(f"{root}/2021/chat.csv", "time,type,key,slot,player_slot,match_id,leagueid,unit\n5,chat,nice,1,0,2,9,u\n")
    put(f"{root}/2020/main_metadata.csv", "match_id,leagueid,start_date_time,duration,radiant_win,extra\n1,7,2020-01-05 10:00:00,100,True,x\n1,7,2020-01-05 10:00:00,100,True,x\n2,7,not a date,abc,,x\n")
    put(f"{root}/2021/main_metadata.csv", "match_id,start_date_time\n9,2021-01-01 00:00:00\n")
    put(f"{root}/leagues.csv", "leagueid,leaguename,tier\n7,The International 2019,premium\n8,,excluded\n")
    put(f"{root}/patches.csv", "patch,date\n7.10,2019-12-01 00:00:00\n7.20,2020-01-05 10:00:00\n")
    return root


def test_ingest_from_files(spark, raw):
    folders = readers.folders_with(raw, ["2020", "2021", "2022"], "chat.csv", "main_metadata.csv")
    assert folders == ["2020", "2021"]
    chat = readers.read_chat(spark, raw, folders)
    assert {r["source_folder"]: r["count"] for r in chat.groupBy("source_folder").count().collect()} == {"2020": 5, "2021": 1}
    with pytest.raises(FileNotFoundError):
        readers.read_chat(spark, raw, ["2022"])
    md = readers.read_metadata(spark, raw, folders)
    assert md.schema == METADATA or md.columns == METADATA.fieldNames()
    assert md.where("match_id = 2").first()["start_date_time"] is None and md.where("match_id = 2").first()["duration"] is None
    patches = readers.read_patches(spark, f"{raw}/patches.csv")
    assert [r["patch"] for r in readers.read_patches(spark, f"{raw}/patches.csv", float_names=True).orderBy("date_start").collect()] == ["7.1", "7.2"]
    p = ingest(chat, md, readers.read_leagues(spark, f"{raw}/leagues.csv"), patches)
    assert p.columns == PROCESSED.fieldNames()
    rows = {(r["match_id"], r["key"]): r for r in p.collect()}
    assert set(rows) == {(1, "gg, wp"), (1, "gg"), (3, "hey"), (2, "nice")}
    assert rows[(1, "gg, wp")]["match_outcome_for_player"] == "win" and rows[(1, "gg")]["match_outcome_for_player"] == "loss"
    assert rows[(1, "gg")]["tier"] == "TI" and rows[(1, "gg")]["patch_name"] == "7.20" and rows[(1, "gg, wp")]["match_minute"] == 0.12
    assert rows[(3, "hey")]["tier"] == "Lainnya" and rows[(3, "hey")]["match_outcome_for_player"] == "unknown" and rows[(3, "hey")]["patch_name"] is None


def test_idempotent_sink(spark, raw, tmp_path):
    df = spark.createDataFrame([(1, "x", "en"), (2, "y", "es")], "match_id long, key string, lang string")
    h = writers.sources_hash(f"{raw}/2020", f"{raw}/leagues.csv")
    assert h == writers.sources_hash(f"{raw}/leagues.csv", f"{raw}/2020") and len(h) == 64
    at = str(tmp_path / "p.parquet")
    assert writers.write_stage(df, at, h) == writers.WriteStats(at, True, 2, h)
    assert not writers.write_stage(df, at, h).written and writers.write_stage(df, at, "other").written
    put(at + ".meta.json", "broken")
    assert writers.write_stage(df, at, h).written
    en, other = writers.write_both_languages(df.where("lang = 'en'"), str(tmp_path / "s/a.parquet"), str(tmp_path / "s/a_non_english.parquet"), h)
    assert (en.rows, other.rows) == (1, 0)
    assert readers.read_stage(spark, str(tmp_path / "s")).count() == 1 and readers.read_optional(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        readers.read_stage(spark, raw)
    assert writers.content_hash(df) == writers.content_hash(df.orderBy(F.desc("match_id"))) != writers.content_hash(df.limit(1))
    assert writers.write_if_absent(df, str(tmp_path / "i.parquet")) and not writers.write_if_absent(df, str(tmp_path / "i.parquet"))


def test_manifest_reports_and_log(spark, tmp_path):
    m = str(tmp_path / "m.json")
    assert writers.update_manifest(m, {"a": "1"}) == {} and writers.update_manifest(m, {"a": "1"}) == {}
    assert writers.update_manifest(m, {"a": "2"})["parts"] == {"a": "1"}
    df = spark.createDataFrame([("x", 0.123456, None)], "a string, b double, c int")
    writers.write_report(df, str(tmp_path / "r.md"))
    writers.write_report(df, str(tmp_path / "r.csv"))
    assert "| x | 0.1235 |  |" in (tmp_path / "r.md").read_text() and (tmp_path / "r.csv").read_text().splitlines()[0] == "a,b,c"
    for _ in range(2):
        log = writers.RunLog("s")
        log.note(rows=1)
        log.save(str(tmp_path / "log.csv"))
    assert len((tmp_path / "log.csv").read_text().splitlines()) == 3
    put(str(tmp_path / "c.json"), json.dumps({"seed": 42}))
    assert readers.load_config(str(tmp_path / "c.json")) == {"seed": 42}


def test_annotations_and_corpora(spark, tmp_path):
    put(str(tmp_path / "sample_ann.csv"), "match_id,sentiment,tox_toxic\n1, Positive ,1.7\n2,,x\n3,NEG,-4\n")
    a = {r["match_id"]: (r["annotator_id"], r["sentiment"], r["tox_toxic"]) for r in readers.read_annotations(spark, str(tmp_path), ["tox_toxic", "tox_threat"]).collect()}
    assert a == {"1": ("ann", "positive", 1), "2": ("ann", None, 0), "3": ("ann", "neg", 0)}
    put(str(tmp_path / "t.csv"), "id,comment_text\n1,a\n2,b\n")
    put(str(tmp_path / "l.csv"), "id,toxic,insult\n1,1,0\n2,-1,-1\n")
    assert [tuple(r) for r in readers.read_toxicity_tables(spark, str(tmp_path / "t.csv"), str(tmp_path / "l.csv"), ["toxic", "insult"]).collect()] == [("a", 1, 0)]
    put(str(tmp_path / "s.csv"), "0,x\n4,y\n2,z\n")
    assert sorted(map(tuple, readers.read_label_table(spark, str(tmp_path / "s.csv"), "t", "l", {"0": "negative", "4": "positive"}, header=False, names=["l", "t"]).collect())) == [("x", "negative"), ("y", "positive")]
    names = readers.name_tokens(spark.createDataFrame([("Iron Branch",), ("Axe",)], "n string"), "n", ["bkb"])
    assert {r["token"] for r in names.collect()} == {"iron branch", "ironbranch", "iron", "branch", "axe", "bkb"}


def test_conform_is_tolerant(spark):
    d = spark.createDataFrame([("7", "x", float("nan"))], "match_id string, duration string, time double")
    r = conform(d, PROCESSED).first()
    assert r["match_id"] == 7 and r["duration"] is None and r["time"] is None and len(r) == 29
    assert conform(d.where("false"), PROCESSED).count() == 0


def test_incremental_files(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    head = "time,type,key,slot,player_slot,match_id,leagueid,unit\n"
    put(f"{folder}/1.csv", head + "1,chat,gg,1,0,1,9,u\n1,chatwheel,gg,1,0,1,9,u\n")
    assert ingest_new_files(spark, folder, out, check) == 1
    assert ingest_new_files(spark, folder, out, check) == 1
    put(f"{folder}/2.csv", head + "1,chat,wp,1,0,1,9,u\n1,chat,,1,0,1,9,u\n")
    assert ingest_new_files(spark, folder, out, check) == 2
    batch = spark.createDataFrame([("2020-01-01 00:01:00",), ("2020-01-01 00:09:00",), ("2020-01-01 00:11:00",)], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    assert sorted(r["n"] for r in windowed_counts(batch, "ts").collect()) == [1, 2]
    assert clean(spark.createDataFrame([], "type string, key string")).count() == 0
