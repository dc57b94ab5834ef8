"""No lost or altered data: quoted fields, headers, optional tables, file
identity, extreme quantiles, keys of 64 bits."""

import math
import os

import pytest
from pyspark.sql import functions as F

from vitrine.functions import stats
from vitrine.operators.ml import hash_key
from vitrine.sources.tables import CSV_FILES, CSV_SCHEMAS, RetailTables, _identity


def _export(folder, reviews):
    os.makedirs(folder, exist_ok=True)
    for name, file in CSV_FILES.items():
        if name != "geolocation":
            with open(f"{folder}/{file}", "w", encoding="utf-8") as f:
                f.write(",".join(CSV_SCHEMAS[name].fieldNames()) + "\n")
    with open(f"{folder}/{CSV_FILES['reviews']}", "w", encoding="utf-8") as f:
        f.write(reviews)


def _review_row(comment):
    values = {"review_id": "r1", "order_id": "o1", "review_score": "4", "review_comment_message": comment,
              "review_creation_date": "2018-01-01 00:00:00", "review_answer_timestamp": "2018-01-02 00:00:00"}
    return ",".join(values.get(c, "") for c in CSV_SCHEMAS["reviews"].fieldNames())


@pytest.mark.parametrize("comment", ['"one line\nand another"', '"a ""quoted"", word"'])
def test_free_text_comments_keep_their_row(spark, tmp_path, comment):
    head = ",".join(CSV_SCHEMAS["reviews"].fieldNames())
    _export(str(tmp_path), f"{head}\n{_review_row(comment)}\n")
    rows = RetailTables.from_csv(spark, str(tmp_path), strict_timestamps=True).reviews.collect()
    assert len(rows) == 1
    assert rows[0]["review_id"] == "r1" and str(rows[0]["review_answer_timestamp"]).startswith("2018-01-02")


def test_a_swapped_header_is_an_error(spark, tmp_path):
    names = CSV_SCHEMAS["reviews"].fieldNames()
    names[0], names[1] = names[1], names[0]
    _export(str(tmp_path), ",".join(names) + "\n" + _review_row("x") + "\n")
    with pytest.raises(Exception):
        RetailTables.from_csv(spark, str(tmp_path)).reviews.collect()


def test_optional_tables_survive_write_and_read(spark, tables_small, tmp_path):
    t = RetailTables(**{**tables_small.as_dict(), "geolocation": spark.range(3).toDF("zip")})
    t.write(str(tmp_path))
    assert RetailTables.read(spark, str(tmp_path)).geolocation.count() == 3


def test_identity_sees_nested_files(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(4).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(at)
    before = _identity(spark, [at])
    spark.range(9).write.mode("overwrite").parquet(at + "/p=0")
    assert _identity(spark, [at]) != before


def test_bundles_in_memory_share_no_model(tables_small):
    from vitrine.operators.models import _key

    a = RetailTables(**tables_small.as_dict())
    b = RetailTables(**tables_small.as_dict())
    assert a.dataset_id is None and _key(a, "x") != _key(b, "x")


def test_extreme_quantiles_and_tails():
    assert math.isclose(float(stats.t_ppf(0.9999, 1)), 3183.0987571, rel_tol=1e-6)
    assert math.isclose(float(stats.t_sf_two_sided(1.0, 1e12)), 0.31731050786, rel_tol=1e-9)
    assert math.isclose(float(stats.t_sf_two_sided(2.0, 10.0)), 0.07338803477, rel_tol=1e-8)


def test_hash_key_takes_large_ids(spark):
    df = spark.createDataFrame([(2**62,), (5,)], "k long")
    got = [r[0] for r in df.select(hash_key(df, "k")).collect()]
    assert got == [2**62 * 48271 % 2147483647, 5 * 48271 % 2147483647]
