"""Raw POS CSV ingest: header handling, coercion, rejects, price cleaning, sinks."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shelfcast.operators.cleaning import clean_transactions, coerce_raw, price_cleaning, reject_counts
from shelfcast.sources.readers import read_cleaned, read_pos_csv
from shelfcast.sources.sinks import write_cleaned

HEADER = " Transaction ID ,Date, Time ,ProductID,ProductName,Category,UnitPrice,BuyingPrice,SellingPrice,Quantity,Total_LKR,Payment Method\n"
ROWS = [
    "1,2025-01-05,9:05,P1,Tea,Bev,25,35,-25,2.7,100,cash",
    "2,2025-01-06,09:05:01,P1,Tea,Bev,35,1e3,45,0.4,NA,card",
    "3,2025-01-06,9:05 PM,P2,Rice,Food,1.5d,10,10,1,10,cash",
    "4,bad,10:00:00,P2,Rice,Food,10,10,10,1,10,cash",
    "5,2025-01-07,bad,P2,Rice,Food,10,10,10,1,10,cash",
    "6,2025-01-07,10:00:00,P3,None,Food,10,10,10,1,10,cash",
    "7,2025-01-07,10:00:00,P3,Oil,Food,inf,10,10,1,10,cash",
    "8,2025-01-07,10:00:00,P3,Oil,Food,\"1,5\",10,10,1,10,cash",
    "9,2025-01-08,23:59:59,P3,Oil,Food,10,10,10,-2.7,-27,N/A",
]


@pytest.fixture()
def raw_csv(tmp_dir):
    path = os.path.join(tmp_dir, "pos.csv")
    with open(path, "w") as f:
        f.write(HEADER + "\n".join(ROWS) + "\n")
    return path


def test_read_and_clean(spark, raw_csv):
    raw = read_pos_csv(spark, raw_csv)
    assert "txn_id" in raw.columns and "payment_method" in raw.columns
    assert all(t == "string" for _, t in raw.dtypes)
    clean = price_cleaning(clean_transactions(raw)).orderBy("txn_id").collect()
    assert [r.txn_id for r in clean] == ["1", "9"]
    first, last = clean
    assert (first.unit_price, first.buying_price, first.selling_price, first.quantity) == (20, 40, -20, 2)
    assert first.sold_at == dt.datetime(2025, 1, 5, 9, 5)
    assert (last.quantity, last.total_amount, last.payment_method) == (-2, -30, "N/A")
    assert last.sold_at == dt.datetime(2025, 1, 8, 23, 59, 59)


def test_reject_counts(spark, raw_csv):
    counts = reject_counts(coerce_raw(read_pos_csv(spark, raw_csv))).first().asDict()
    assert counts["rows"] == 9
    assert counts["null_sale_date"] == 1
    assert counts["null_sale_seconds"] == 1
    assert counts["null_unit_price"] == 3  # 1.5d, inf, 1,5
    assert counts["null_total_amount"] == 1
    assert counts["null_product_name"] == 1


def test_missing_column_error(spark, tmp_dir):
    path = os.path.join(tmp_dir, "bad.csv")
    with open(path, "w") as f:
        f.write("TransactionID,Date,ProductID\n1,2025-01-01,P\n")
    with pytest.raises(KeyError) as err:
        read_pos_csv(spark, path)
    assert "BuyingPrice" in str(err.value) and "Time" in str(err.value)


def test_alias_only_when_target_absent(spark, tmp_dir):
    from shelfcast.sources.contract import canonical_headers

    df = spark.createDataFrame([("a", "b")], "`Transaction ID` string, TransactionID string")
    assert canonical_headers(df).columns == ["Transaction ID", "TransactionID"]
    df = spark.createDataFrame([("a", "b")], "`Transaction ID` string, `payment method` string")
    assert canonical_headers(df).columns == ["TransactionID", "Payment_Method"]
    df = spark.createDataFrame([("a", "b")], "`Transaction ID` string, `Transaction_ID` string")
    with pytest.raises(ValueError, match="both answer"):
        canonical_headers(df)


def test_cleaned_sink_roundtrip(spark, raw_csv, tmp_dir):
    clean = price_cleaning(clean_transactions(read_pos_csv(spark, raw_csv)))
    out = os.path.join(tmp_dir, "cleaned")
    assert write_cleaned(clean, out) == 2
    back = read_cleaned(spark, out)
    assert back.count() == 2
    # The year partition prunes at the scan.
    plan = back.filter(F.col("sale_year") == 2025)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sale_year" in plan


def test_read_features_checks_and_narrows(spark, tmp_dir):
    from shelfcast.sources.readers import read_features

    path = os.path.join(tmp_dir, "feat.csv")
    with open(path, "w") as f:
        f.write(" product_id,product_name,category,week_ending,quantity,lag_1_week\n"
                "1,a,c,2025-01-05,3,2.5\n2,b,c,bad,4,1.0\n3,b,c,2025-01-12,,1.0\n")
    df = read_features(spark, path, "week_ending", fmt="csv")
    rows = df.collect()
    assert [r.product_id for r in rows] == ["1"]
    assert dict(df.dtypes)["quantity"] == "float" and rows[0].week_ending == dt.date(2025, 1, 5)
    assert dict(df.dtypes)["lag_1_week"] == "float" and rows[0].lag_1_week == 2.5


def test_cleaned_csv_roundtrip(spark, raw_csv, tmp_dir):
    clean = price_cleaning(clean_transactions(read_pos_csv(spark, raw_csv)))
    out = os.path.join(tmp_dir, "cleaned_csv")
    write_cleaned(clean, out, fmt="csv")
    back = read_cleaned(spark, out, fmt="csv")
    types = dict(back.dtypes)
    assert types["sale_date"] == "date" and types["sold_at"] == "timestamp_ntz" and types["quantity"] == "double"
    assert sorted(r.sold_at for r in back.collect()) == [dt.datetime(2025, 1, 5, 9, 5), dt.datetime(2025, 1, 8, 23, 59, 59)]


def test_malformed_lines_are_noticed_and_counted(spark, tmp_dir):
    from shelfcast.operators.cleaning import clean_transactions, coerce_raw, reject_counts
    from shelfcast.sources.contract import RAW_REQUIRED
    from shelfcast.sources.readers import parse_pos_lines, read_pos_csv

    header = list(RAW_REQUIRED)
    good = {"Date": "2024-01-02", "Time": "10:30:00"}
    line = ",".join(good.get(h, "7") for h in header)
    lines = [line, line.rpartition(",")[0], line + ",surplus", '"' + line, line.replace("2024-01-02", "bad")]
    os.makedirs(f"{tmp_dir}/pos")
    with open(f"{tmp_dir}/pos/a.csv", "w") as f:
        f.write("\n".join([",".join(header), *lines]) + "\n")
    for raw in (read_pos_csv(spark, f"{tmp_dir}/pos"), parse_pos_lines(spark.createDataFrame([(x,) for x in lines], "l string"), "l", header)):
        counts = reject_counts(coerce_raw(raw)).first()
        assert (counts["rows"], counts["malformed"], counts["null_sale_date"], counts["null_quantity"]) == (5, 3, 1, 0)
        clean = clean_transactions(raw)
        assert clean.count() == 1 and "malformed" not in clean.columns
    assert {r.malformed for r in raw.where("malformed IS NOT NULL").collect()} == set(lines[1:4])


def test_headers_that_differ_in_punctuation_clash_only_where_needed():
    from shelfcast.sources.contract import resolve_columns

    both = ["Payment-Method", "PAYMENT  METHOD", "Date"]
    wanted = {"Payment Method": ("Payment Method",), "Date": ("Date",)}
    assert resolve_columns(both, wanted, needed=("Date",)) == {"Date": "Date"}
    with pytest.raises(ValueError, match="both answer"):
        resolve_columns(both, wanted)
    assert resolve_columns(["payment method", "Payment-Method"], wanted, needed=()) == {"Payment Method": "payment method"}


def test_only_the_years_of_a_late_file_are_replaced(spark, tmp_dir):
    from shelfcast.sources.sinks import write_cleaned, write_features

    tx = spark.createDataFrame([(f"t{k}", k) for k in range(40)], "txn_id string, k int").selectExpr("*", "make_date(2020 + k % 3, 1 + k % 12, 1) AS sale_date")
    path = f"{tmp_dir}/cleaned"
    write_cleaned(tx, path)
    files = lambda p: {d: {(f, os.stat(f"{p}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{p}/{d}")} for d in os.listdir(p) if "=" in d}
    before = files(path)
    late = tx.where("year(sale_date) = 2021").limit(5)
    for _ in range(2):  # a rerun gives the same
        assert write_cleaned(late, path, touched_only=True) == 5
        after = files(path)
        assert {d for d in before if before[d] != after[d]} == {"sale_year=2021"} and before.keys() == after.keys()
        assert spark.read.parquet(path).where("sale_year = 2021").count() == 5
    assert spark.read.parquet(path).count() == tx.where("year(sale_date) <> 2021").count() + 5
    features = f"{tmp_dir}/features"
    write_features(tx, features, period_col="sale_date")
    write_features(late, features, period_col="sale_date")
    assert spark.read.parquet(features).groupBy("period_year").count().where("period_year = 2021").first()[1] == 5


def test_each_line_is_parsed_once(spark):
    from shelfcast.operators.cleaning import clean_transactions
    from shelfcast.sources.readers import parse_pos_lines

    header = ["TransactionID", "Date", "Time", "ProductID", "ProductName", "Category", "UnitPrice", "BuyingPrice", "SellingPrice", "Quantity", "Total_LKR"]
    lines = ["T1,2025-01-05,10:30:00,P1,tea,drinks,100,80,90,2,180", None, "T2,2025-01-05"]
    raw = parse_pos_lines(spark.createDataFrame([(x,) for x in lines], "l string"), "l", header)
    cleaned = clean_transactions(raw)
    # Filters and projections behind the parser must not hold copies of it.
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    assert [(r["txn_id"], r["malformed"]) for r in raw.collect()] == [("T1", None), (None, None), (None, "T2,2025-01-05")]
    assert [r["total_amount"] for r in cleaned.collect()] == [180.0]
