"""Export files that are read in pieces hold what the whole document holds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from subjectseries.plans.ingest import ingest_envelopes
from subjectseries.schemas import STORED
from subjectseries.sources import export
from subjectseries.sources.large_export import read_large_documents
from subjectseries.sources.store import VersionedStore

HEAD = {"schema_version": 1, "exported_at": "2026-08-10T20:02:50Z", "data_start": "2026-07-30T00:00:00Z", "data_end": "2026-08-10T20:02:50Z"}
NASTY = ['a"b', "c\\", '\\"', "},{", "],[", "x,y", "{", "[[", "\n", "ü\U00010400", '\\\\",', ""]


def sample(draw, ident):
    row = {"source": "apple", "source_sample_id": f"{ident}", "sample_time": "2026-08-01T02:05:51", "value": 90 + ident % 50, "unit": "mg/dL"}
    if draw.random() < 0.5:
        row["metadata"] = {draw.choice(NASTY): [draw.choice(NASTY), {"k": draw.choice(NASTY)}, []]}
    return row


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def whole(spark, folder):
    docs = export.read_documents(spark, str(folder), "s")
    return export.envelopes(docs)


def rows_of(records):
    text = F.to_json("record")
    key = F.element_at(F.split("document_id", "/"), -1)
    return sorted((r[0], r[1], r[2], r[3]) for r in records.select(key, "entity", "index", text).collect())


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_pieces_hold_the_same_records(spark, tmp_path, small_blocks):
    draw = random.Random(5)
    folder = tmp_path / "in"
    for k in range(4):
        body = dict(HEAD)
        body["glucose_samples"] = [sample(draw, i) if draw.random() < 0.9 else draw.choice([7, None, "x,]}", [1, [2]], {}]) for i in range(30)]
        body["other"] = draw.choice([{"a": 1, "b": [1, {"c": 2}]}, [[1, 2], [3]], "},", None])
        body["meal_events"] = [] if k % 2 else [{"source": "m", "source_sample_id": "1", "meal_completed_at": "2026-08-01", "foods": NASTY}]
        body["sleep_sessions"] = [{"stage": s} for s in NASTY]
        items = list(body.items())
        draw.shuffle(items)
        text = json.dumps(dict(items), ensure_ascii=k > 1, indent=[None, 2, None, 1][k])
        write(folder, f"d{k}.json", " \n" + text + "\n" if k == 3 else text)
    found = read_large_documents(spark, str(folder), "s")
    want = export.records(whole(spark, folder))
    assert spark.read.option("lineSep", ",").text(str(folder)).rdd.getNumPartitions() > 8
    assert rows_of(found.records) == rows_of(want) and found.records.count() > 100
    head = ["subject_id", "document_id", "schema_version", "exported_at", "data_start", "data_end", "reject_code"]
    assert sorted(map(tuple, found.envelope.select(head).collect())) == sorted(map(tuple, whole(spark, folder).select(head).collect()))


BODIES = [
    "{not json",
    "",
    "[]",
    "7",
    json.dumps({**HEAD, "schema_version": 2}),
    json.dumps({**HEAD, "data_end": HEAD["data_start"]}),
    json.dumps({**HEAD, "workouts": {}}),
    json.dumps({**HEAD, "workouts": {"a": 1, "b": 2}}),
    json.dumps({**HEAD, "workouts": None}),
    json.dumps({**HEAD, "glucose_samples": [1, 2]})[:-1],
    json.dumps({**HEAD, "glucose_samples": [1, 2]})[:-2] + "}}",
    json.dumps({**HEAD, "glucose_samples": [1, 2]}).replace("1, 2", "1, {2"),
    json.dumps({**HEAD, "glucose_samples": [1, 2]}).replace("1, 2", "1, , 2"),
    json.dumps({**HEAD}),
    "{}",
]


def test_codes_are_those_of_whole_documents(spark, tmp_path):
    """A text after the document, which the parser of whole documents ignores, is refused here."""
    folder = tmp_path / "in"
    for k, text in enumerate(BODIES):
        write(folder, f"d{k}.json", text)
    write(folder, "more.json", BODIES[-2] + "}")
    found = {r.document_id.rsplit("/", 1)[1]: r.reject_code for r in read_large_documents(spark, str(folder), "s").envelope.collect()}
    want = {r.document_id.rsplit("/", 1)[1]: r.reject_code for r in whole(spark, folder).collect()}
    want["more.json"] = "INVALID_REQUEST"
    assert {k: found.get(k, "INVALID_REQUEST") for k in want} == want
    assert list(want.values()).count(None) == 1


def test_split_documents_are_ingested(spark, tmp_path, small_blocks):
    draw = random.Random(2)
    write(tmp_path / "in", "d.json", json.dumps({**HEAD, "glucose_samples": [*[sample(draw, i) for i in range(40)], 7]}))
    found = read_large_documents(spark, str(tmp_path / "in"), "s")
    store = VersionedStore(spark, str(tmp_path / "store"), parts=4)
    out = ingest_envelopes(spark, found.envelope, store, found.records)
    assert store.read("glucose_samples", STORED["glucose_samples"]).count() == 40
    assert [r["index"] for r in out["rejections"].collect()] == [40]
    assert len(out["audit"].first().payload_sha256) == 64
