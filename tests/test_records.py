"""Deliveries and packed fields on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skolion.operators import packed
from skolion.operators.delivery import DeliveryLog, keep_first

T0 = dt.datetime(2024, 1, 1)


def _log(spark, tmp_path, rows, schema="id string, n bigint, at timestamp, text string, rn int", files=3):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(rows, schema).repartition(files).write.mode("overwrite").parquet(path)
    return DeliveryLog(spark, path, "id", ["at", "n"])


def _choose(rows):
    best = {}
    for r in rows:
        k = (r[2] is None, r[2] or T0, r[1] is None, r[1] or 0)
        if r[0] is not None and (r[0] not in best or k < best[r[0]][0]):
            best[r[0]] = (k, r)
    return sorted(x[1][1] for x in best.values())


def test_delivery_keeps_the_earliest_copy(spark, tmp_path):
    rows = [(f"k{i % 7}" if i % 3 else "hot", i, T0 + dt.timedelta(minutes=(i * 37) % 11), "x" * (i % 5), i) for i in range(500)]
    log = _log(spark, tmp_path, rows)
    kept = [r.n for r in log.kept().collect()]
    assert sorted(kept) == _choose(rows)
    rest = [r.n for r in log.surplus(["n"]).collect()]
    assert sorted(kept + rest) == list(range(500))


def test_delivery_nulls_ties_and_long_texts(spark, tmp_path):
    rows = [(None, 1, T0, "a", 1), (None, 2, T0, "b", 2), ("x", 3, None, "c", 3), ("x", 4, T0, None, 4), ("y", 5, T0, "z" * 200_000, 5), ("y", 5, T0, "z" * 200_000, 5), ("x ", 6, T0, "", 6)]
    got = sorted((r.id or "", r.n) for r in _log(spark, tmp_path, rows).kept().collect())
    assert got == [("", 1), ("", 2), ("x", 4), ("x ", 6), ("y", 5)]


def test_delivery_of_nothing(spark, tmp_path):
    log = _log(spark, tmp_path, [], files=1)
    assert log.kept().count() == log.surplus().count() == 0


def test_keep_first_agrees_with_the_log(spark, tmp_path):
    rows = [(f"k{i % 5}", i, T0 + dt.timedelta(minutes=(i * 37) % 11), "t", i) for i in range(60)]
    log = _log(spark, tmp_path, rows)
    assert sorted(r.n for r in keep_first(log.frame, "id", ["at", "n"]).collect()) == _choose(rows)


CASES = [
    ("Al Bee, Jo Li, and Ed Foe", ["Al Bee", "Jo Li", "Ed Foe"]),
    ("Roe, Jo ; Poe, Al", ["Roe, Jo", "Poe, Al"]),
    ("Roe, Jo and Poe, Al M.", ["Roe, Jo", "Poe, Al M."]),
    ("Roe, Jo AND Poe, Al", ["Roe, Jo", "Poe, Al"]),
    ('"Roe, J. K.", Al Poe,', ["Roe, J. K.", "Al Poe"]),
    ('["Al ""X"" Poe", "Jo \\"Y\\" Roe"]', ['Al "X" Poe', 'Jo "Y" Roe']),
    ("Al Poe,, Jo Roe; ;Ed Coe | Bo Loe & Cy Noe", ["Al Poe", "Jo Roe", "Ed Coe", "Bo Loe", "Cy Noe"]),
    ("Centre of Maps, Town | Al Poe", ["Centre of Maps, Town", "Al Poe"]),
    ("Al Poe\r\nJo Roe\tEd Coe · Bo Loe • Cy Noe、Di Foe / Ha Goe", ["Al Poe", "Jo Roe", "Ed Coe", "Bo Loe", "Cy Noe", "Di Foe", "Ha Goe"]),
    ("Roe-Poe, B. R.", ["Roe-Poe, B. R."]),
    ("", []), (None, []), (" , ;", []), ('""', []), ("Al Poe" * 1, ["Al Poe"]),
    (", ".join(f"Aa{i} Bb{i}" for i in range(3000)), [f"Aa{i} Bb{i}" for i in range(3000)]),
]


def test_author_notations(spark):
    df = spark.createDataFrame([(str(i), c[0]) for i, c in enumerate(CASES)], "paper_id string, authors string")
    out = packed.explode_field(df.unionByName(df), "paper_id", "authors", packed.AUTHORS).collect()
    for i, (_, want) in enumerate(CASES):
        assert [r.item_value for r in sorted((r for r in out if r.paper_id == str(i)), key=lambda r: r.pos)] == want


def test_compounds_stay_whole_where_the_column_has_them(spark):
    rows = [("1", '"a/b", c'), ("2", "a/b|c"), ("3", "c/d"), ("4", "R&D and more; a/b"), ("5", "a/c"), (None, "a/b"), ("6", '{"x; y",z}'), ("7", "x; y / z")]
    df = spark.createDataFrame(rows, "paper_id string, topics string").withColumn("k", F.lit(1)).withColumn("f", F.lit(2))
    out = packed.explode_field(df, "paper_id", "topics", packed.LABELS, compounds=True).collect()
    got = {}
    for r in sorted(out, key=lambda r: r.pos):
        got.setdefault(r.paper_id, []).append(r.item_value)
    assert got == {"1": ["a/b", "c"], "2": ["a/b", "c"], "3": ["c", "d"], "4": ["R&D and more", "a/b"], "5": ["a", "c"], None: ["a/b"], "6": ["x; y", "z"], "7": ["x; y", "z"]}


@pytest.mark.parametrize("name", ["papers"])
def test_every_topic_of_the_table_is_known(spark, sf, name):
    df = packed.explode_field(spark.read.parquet(f"{sf}/{name}.parquet"), "paper_id", "topics", packed.LABELS, compounds=True)
    assert df.where(F.col("item_value").rlike('^[";|/,]|[";|/,]$')).where(~F.col("item_value").contains("team")).count() == 0
