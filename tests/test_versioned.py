"""Versioned tables, activation, schemas and merges on small cases."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from lexloom.functions import schemas
from lexloom.sources.versioned import Conflict, VersionedTable, activated


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_versions_conflicts_and_keys(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.current() == 0
    with pytest.raises(LookupError):
        t.read()
    assert t.commit(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0, "load") == 1
    assert t.commit(spark.createDataFrame([(9, "z")], "k int, v string"), 0, "load") == 1  # the key was published
    with pytest.raises(Conflict):
        t.commit(spark.createDataFrame([(9, "z")], "k int, v string"), 0)
    assert len(os.listdir(tmp_path / "t" / "data")) == 1 and not [n for n in os.listdir(tmp_path / "t" / "manifests") if "draft" in n]
    assert t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]) == 2
    assert rows_of(t.read()) == [(1, "a"), (2, "c"), (3, "d")] and rows_of(t.read(1)) == [(1, "a"), (2, "b")]
    assert t.activate(1, 2, "back") == 3 == t.activate(1, 99, "back")
    assert rows_of(t.read()) == [(1, "a"), (2, "b")] and [m["version"] for m in t.history()] == [1, 2, 3]
    with pytest.raises(Conflict):
        t.activate(2, 2)


def test_two_writers_leave_one_winner(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(spark.createDataFrame([(0, "start")], "k int, v string"), 0)
    lost, won = [], []

    def write(name):
        try:
            won.append((t.commit(spark.createDataFrame([(1, name)], "k int, v string"), 1), name))
        except Conflict:
            lost.append(name)

    both = [threading.Thread(target=write, args=(n,)) for n in ("a", "b")]
    for x in both:
        x.start()
    for x in both:
        x.join()
    assert len(won) == 1 and len(lost) == 1 and rows_of(t.read()) == [(1, won[0][1])]
    # writers of single keys who merge again lose nothing
    many = [threading.Thread(target=t.upsert, args=(spark.createDataFrame([(k, "u")], "k int, v string"), ["k"])) for k in (10, 11)]
    for x in many:
        x.start()
    for x in many:
        x.join()
    assert {(10, "u"), (11, "u")} <= set(rows_of(t.read())) and t.current() == 4


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(spark.createDataFrame([(1, "a")], "k int, v string"), 0)
    broken = spark.range(4).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        t.commit(broken, 1)
    assert t.current() == 1 and rows_of(t.read()) == [(1, "a")]
    t.spark.range(1).write.parquet(f"{t.path}/data/left-behind")
    assert t.sweep(3600) == 0 and t.sweep(-1) >= 1 and rows_of(t.read()) == [(1, "a")]


def test_activation(spark):
    rows = spark.createDataFrame([(1, "a", 1, True), (2, "a", 1, False), (3, "a", 2, True), (4, None, 1, True), (5, None, 1, None)], "id int, doc string, schema int, active boolean")
    chosen = spark.createDataFrame([(2,), (5,), (99,), (None,), (2,)], "id int")
    assert sorted((r.id, r.active) for r in activated(rows, ["doc", "schema"], "id", "active", chosen).collect()) == [(1, False), (2, True), (3, True), (4, False), (5, True)]
    assert rows_of(activated(rows, ["doc"], "id", "active", chosen.where("false")).select("id")) == rows_of(rows.select("id"))


SCHEMA = {
    "type": "object",
    "required": ["id", "day"],
    "properties": {
        "id": {"type": "integer"},
        "kind": {"const": "case"},
        "level": {"enum": ["low", 2, None, True]},
        "day": {"type": ["string", "null"], "format": "date"},
        "share": {"type": "number"},
        "flag": {"type": "boolean"},
        "parts": {"type": "array", "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "t's": {"type": "string"}}}},
        "any": {"type": "strange"},
    },
}


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        ('{"id": 1, "day": "2020-02-29", "kind": "case", "level": "low", "share": 0.5, "flag": false, "parts": [{"n": 1, "t\'s": ""}], "any": [], "more": {}}', []),
        ('{"id": 1, "day": null, "level": null, "share": 3, "parts": []}', []),
        ('{"id": 1, "day": null, "level": 2.0}', []),
        ("{}", ["$: required id", "$: required day"]),
        ('{"id": "1", "day": 5}', ["$.id: type", "$.day: type"]),
        ('{"id": 1.5, "day": "2021-02-29"}', ["$.id: type", "$.day: format"]),
        ('{"id": true, "day": "x"}', ["$.id: type", "$.day: format"]),
        ('{"id": 1, "day": null, "kind": "law", "level": "high", "share": "1", "flag": 0}', ["$.kind: const", "$.level: enum", "$.share: type", "$.flag: type"]),
        ('{"id": 1, "day": null, "level": false}', ["$.level: enum"]),
        ('{"id": 1, "day": null, "parts": [{"n": 1}, {}, 5, {"n": "x", "t\'s": 1}]}', ["$.parts[1]: required n", "$.parts[2]: type", "$.parts[3].n: type", "$.parts[3].t's: type"]),
        ('{"id": 1, "day": null, "parts": {}}', ["$.parts: type"]),
        ("[1]", ["$: type"]),
        ("no json", ["$: type"]),
        (None, ["$: type"]),
    ],
)
def test_every_keyword(spark, payload, want):
    rows = spark.createDataFrame([(payload,)], "j string").withColumn("v", schemas.variant(F.col("j")))
    assert rows.select(schemas.errors(SCHEMA, F.col("v"))).first()[0] == want


def test_merges(spark):
    rows = [('{"a": 1, "b": {"x": 1, "y": 2}, "c": [1]}', '{"b": {"y": 3}, "c": [], "d": null}'), (None, '{"a": 1}'), ('{"b": 5}', '{"b": {"x": 1}}'), ("[]", None)]
    frame = spark.createDataFrame(rows, "o string, n string").select(schemas.variant(F.col("o")).alias("o"), schemas.variant(F.col("n")).alias("n"))
    assert [r[0] for r in frame.select(schemas.merged(F.col("o"), F.col("n"))).collect()] == ['{"a":1,"b":{"y":3},"c":[],"d":null}', '{"a":1}', '{"b":{"x":1}}', "{}"]
    assert [r[0] for r in frame.select(schemas.merged(F.col("o"), F.col("n"), ("b",))).collect()] == ['{"a":1,"b":{"x":1,"y":3},"c":[],"d":null}', '{"a":1}', '{"b":{"x":1}}', "{}"]


def test_updates_of_documents(spark):
    rows = [("law", "T", 2000, '{"doc_type": " Case ", "title": " ", "year": "2019"}'), ("law", None, None, '{"doc_type": "poem", "title": "New", "year": "soon"}'), ("law", "T", 1, None)]
    frame = spark.createDataFrame(rows, "doc_type string, title string, year int, j string")
    columns = {c: F.col(c) for c in ("doc_type", "title", "year")}
    new = schemas.updated(schemas.variant(F.col("j")), columns, ("law", "regulation", "enactment_notice", "case", "other"))
    assert [tuple(r) for r in frame.select(*new.values()).collect()] == [("case", "T", 2019), ("law", "New", None), ("law", "T", 1)]
