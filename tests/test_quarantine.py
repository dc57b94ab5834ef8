"""Bad records of the CSV export: told of, never silently null; splits."""

import pytest

from test_csv_path import _write
from vitrine.sources.tables import CSV_FILES, RetailTables


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("bad")
    _write(root)
    with open(root / CSV_FILES["order_items"], "a") as f:
        f.write("o0001,9,p1,s1,2018-01-05 00:00:00,twelve,1.00\n")        # a bad price
        f.write("o0001,10,p1,s1,not a time,5.00,1.00\n")                  # a bad timestamp only
        f.write("o0001,11\n")                                             # too few fields
    with open(root / CSV_FILES["reviews"], "a") as f:
        f.write('r900,o0001,5,"a, ""b""","two\nlines",2018-01-05 00:00:00,2018-01-06 00:00:00\n')
        f.write("r901,o0001,five,,,2018-01-05 00:00:00,2018-01-06 00:00:00\n")
    return str(root)


def test_bad_records_are_listed_and_kept(spark, raw):
    t = RetailTables.from_csv(spark, raw)
    bad = t.quarantine.collect()
    assert sorted((r.file, tuple(r.faults)) for r in bad) == sorted([
        (CSV_FILES["order_items"], ("fields",)), (CSV_FILES["order_items"], ("fields",)),
        (CSV_FILES["order_items"], ("shipping_limit_date",)), (CSV_FILES["reviews"], ("fields",))])
    assert any("twelve" in r.record for r in bad) and any("not a time" in r.record for r in bad)
    counts = {r.file: r.bad_records for r in t.bad_record_counts().collect()}
    assert counts[CSV_FILES["order_items"]] == 3 and counts[CSV_FILES["orders"]] == 0 and len(counts) == len(CSV_FILES)
    assert t.items.where("order_id = 'o0001' and order_item_id >= 9").count() == 3
    assert t.items.where("order_item_id = 9").first().price is None
    assert t.reviews.where("review_id = 'r900'").first().review_comment_message == "two\nlines"


def test_bad_records_dropped_whatever_columns_are_read(spark, raw):
    t = RetailTables.from_csv(spark, raw, drop_bad_records=True)
    assert t.items.where("order_item_id >= 9").select("order_id").count() == 0
    assert t.items.where("order_item_id >= 9").select("price").count() == 0
    assert t.reviews.where("review_id >= 'r90'").count() == 1
    assert "quarantine" not in t.as_dict()


def test_strict_read_raises(spark, raw):
    with pytest.raises(Exception):
        RetailTables.from_csv(spark, raw, strict_timestamps=True).items.collect()


def test_files_split_but_reviews(spark, raw):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        t = RetailTables.from_csv(spark, raw)
        assert t.orders.rdd.getNumPartitions() > 1
        assert t.reviews.rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
