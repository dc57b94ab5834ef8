"""The marketplace-export path: headered CSVs with string ids, read with the
fixed schemas, through operators of every area."""

import pandas as pd
import pytest

from vitrine.sources.tables import CSV_FILES, CSV_SCHEMAS, RetailTables


def _write(tmp_path):
    def ts(day, hour=0):
        return f"2018-0{1 + day // 28}-{1 + day % 28:02d} {hour:02d}:00:00"

    states = ["SP", "RJ", "PR", "MG", "RS"]
    orders, customers, items, payments, reviews = [], [], [], [], []
    for i in range(60):
        oid, cid, uid = f"o{i:04x}", f"c{i:04x}", f"u{i % 23:04x}"
        status = "canceled" if i % 17 == 0 else "delivered"
        orders.append([oid, cid, status, ts(i % 80, 10), ts(i % 80, 11), ts(i % 80 + 1),
                       "" if status == "canceled" else ts(i % 80 + 3 + i % 9), ts(i % 80 + 8)])
        customers.append([cid, uid, "01000", "city", states[i % 5]])
        for k in range(1 + i % 3):
            items.append([oid, k + 1, f"p{(i + k) % 7}", f"s{i % 4}", ts(i % 80 + 2), f"{40 + (i * 13 + k) % 200}.50", "12.30"])
        payments.append([oid, 1, "credit_card" if i % 3 else "boleto", 1 + i % 6, f"{100 + i * 7}.00"])
        if i % 5 == 0:
            payments.append([oid, 2, "voucher", 1, "10.00"])
        reviews.append([f"r{i}", oid, 1 + i % 5, "", "", ts(i % 80 + 12), ts(i % 80 + 13)])
    products = [[f"p{j}", ["beleza_saude", "esporte_lazer", None][j % 3], 10, 100, 2, 500.0 + j, 20.0, 10.0, 15.0]
                for j in range(7)]
    sellers = [[f"s{j}", "01000", "city", "SP"] for j in range(4)]
    translation = [["beleza_saude", "health_beauty"], ["esporte_lazer", "sports_leisure"]]
    geolocation = [["01000", -23.5 + j / 100, -46.6, "sao paulo", "SP"] for j in range(30)] + [["01001", None, None, "x", "SP"]]
    frames = {"geolocation": geolocation, "orders": orders, "customers": customers, "order_items": items, "payments": payments,
              "reviews": reviews, "products": products, "sellers": sellers, "translation": translation}
    for name, rows in frames.items():
        cols = [f.name for f in CSV_SCHEMAS[name].fields]
        pdf = pd.DataFrame(rows, columns=cols)
        enc = "utf-8-sig" if name == "translation" else "utf-8"   # the translation file has a BOM
        pdf.to_csv(tmp_path / CSV_FILES[name], index=False, encoding=enc)
    return str(tmp_path)


@pytest.fixture(scope="module")
def csv_tables(spark, tmp_path_factory):
    return RetailTables.from_csv(spark, _write(tmp_path_factory.mktemp("raw")))


def test_geolocation_profiled(csv_tables):
    from vitrine.operators.audit import null_profile, shape_profile

    nulls = {(r.table_name, r.column_name): r.null_count for r in null_profile(csv_tables).collect()}
    assert nulls[("geolocation", "geolocation_lat")] == 1
    shapes = {r.table_name: r.n_rows for r in shape_profile(csv_tables).collect()}
    assert shapes["geolocation"] == 31


def test_schemas_and_timestamps(csv_tables):
    assert dict(csv_tables.orders.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    assert csv_tables.translation.columns == ["product_category_name", "product_category_name_english"]
    assert csv_tables.orders.where("order_delivered_customer_date is null").count() == 4


@pytest.mark.parametrize("module,fn", [
    ("funnel", "funnel_summary"), ("funnel", "funnel_by_state"), ("cohort", "cohort_retention"),
    ("explore", "top_categories"), ("rfm", "rfm_segment_summary"), ("rfm", "rfm_qcut_segments"),
    ("profit", "category_profit"), ("profit", "platform_profit_summary"), ("abtest", "ab_summary"),
    ("ml", "customer_features"), ("ml", "stratified_split"), ("ml", "delay_features"),
])
def test_operators_run_on_csv_tables(csv_tables, module, fn):
    import importlib

    from vitrine.operators.profit import CONTROL_STATES, TREATMENT_STATES

    mod = importlib.import_module(f"vitrine.operators.{module}")
    if module == "abtest":
        from vitrine.operators import abtest
        df = abtest.ab_frame(csv_tables, control=CONTROL_STATES, treatment=TREATMENT_STATES)
        assert df.count() > 0
        return
    kw = {"category_profit": {"min_orders": 1}}.get(fn, {})  # the fixture has 60 orders
    out = getattr(mod, fn)(csv_tables, **kw)
    assert out.count() > 0
