"""Raw orders scored from three streams, against the stored tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ontide.operators import scoring
from ontide.streaming import incoming, jobs

LOOKUPS = ["customers", "products", "category_translation", "sellers"]


@pytest.fixture(scope="module")
def raw(spark, tables):
    """The raw tables with a time of arrival: items by the hour after the purchase, payments before it."""
    orders = tables["orders"].filter("order_id % 3 = 0")
    bought = orders.select("order_id", F.col("order_purchase_timestamp").cast("timestamp").alias("at"))
    items = tables["order_items"].join(bought, "order_id")
    payments = tables["payments"].join(bought, "order_id")
    hours = F.expr("make_dt_interval(0, order_item_id)")
    items = items.withColumn("arrived_at", F.col("at") + hours).drop("at")
    payments = payments.withColumn("arrived_at", F.expr("at - INTERVAL 30 minutes")).drop("at")
    return {"orders": orders, "items": items, "payments": payments}


def lookups(tables):
    return {name: tables[name] for name in LOOKUPS}


def profiles(rows):
    return scoring.known_orders(rows)


def differences(one, two):
    """Rows that are not in both, doubles to nine digits."""
    def plain(df):
        doubles = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
        return df.select(*doubles)

    one, two = plain(one), plain(two.select(one.columns))
    return one.exceptAll(two).count() + two.exceptAll(one).count()


def test_stored_tables_give_the_mart(tables, mart, raw):
    found = profiles(incoming.incoming_orders(raw["orders"], raw["items"], raw["payments"], lookups(tables)))
    wanted = profiles(mart.filter("order_id % 3 = 0"))
    delivered = found.join(wanted.select("order_id"), "order_id", "left_semi")
    assert differences(delivered, wanted) == 0
    assert found.count() == raw["orders"].count()


def test_small_lookups_meet_the_parts_at_their_orders(spark, tables, raw, monkeypatch):
    import re

    def joins():
        found = incoming.incoming_orders(raw["orders"], raw["items"], raw["payments"], lookups(tables))
        # a plan's text has the last join first
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        keys = [re.search(r"= (seller_id|part_of)#", line) for line in plan.splitlines() if "Join LeftOuter" in line]
        return [k.group(1) for k in keys if k], found

    order, small = joins()
    assert order == ["seller_id", "part_of"]
    monkeypatch.setattr(incoming.Lookup, "is_small", lambda self, limit_bytes=0: False)
    order, large = joins()
    assert order == ["part_of", "seller_id"]
    assert differences(profiles(small), profiles(large)) == 0


def slices(spark, df, time, path, edges):
    """One file per stretch of time, in order; files are read in the order of their writing."""
    for low, high in zip([None, *edges], [*edges, None]):
        part = df
        if low is not None:
            part = part.filter(F.col(time) >= F.lit(low))
        if high is not None:
            part = part.filter(F.col(time) < F.lit(high))
        part.coalesce(1).write.mode("append").parquet(path)


def run_streams(spark, tables, folders, schemas, out, log, arrival=incoming.Arrival()):
    streams = {n: jobs.read_order_stream(spark, folders[n], schemas[n], files_per_batch=1) for n in folders}
    rows = incoming.incoming_orders(streams["orders"], streams["items"], streams["payments"], lookups(tables), arrival)
    jobs.write_stream(profiles(rows), out, log).awaitTermination()
    return spark.read.parquet(out)


END = dt.datetime(2030, 1, 1)


def closing(spark, kind, schema):
    """An event far ahead, which lets the watermark pass all others."""
    time = "order_purchase_timestamp" if kind == "orders" else "arrived_at"
    columns = [F.lit(END).cast(f.dataType) if f.name == time else F.lit(-1 if f.name == "order_id" else None).cast(f.dataType) for f in schema]
    return spark.range(1).select(*[c.alias(f.name) for c, f in zip(columns, schema)])


def test_streams_give_the_rows_of_the_tables(spark, tables, raw, tmp_path):
    """Early, late and absent parts; items run a slice ahead of their orders."""
    orders = raw["orders"]
    known = sorted((r[0], r[1]) for r in orders.select("order_purchase_timestamp", "order_id").collect())
    edges = [known[len(known) * i // 4][0].replace(hour=0) for i in (1, 2, 3)]
    withs = {r[0] for r in raw["payments"].select("order_id").distinct().collect()}
    lost, bare = [order_id for _, order_id in known if order_id in withs][:2]
    on_time = raw["items"].filter(~F.col("order_id").isin(lost, bare))
    too_late = raw["items"].filter(F.col("order_id") == lost)
    unpaid = raw["payments"].filter(F.col("order_id") != bare)
    folders = {n: str(tmp_path / n) for n in raw}
    schemas = {n: df.schema for n, df in raw.items()}
    slices(spark, orders, "order_purchase_timestamp", folders["orders"], edges)
    slices(spark, on_time, "arrived_at", folders["items"], [e + dt.timedelta(days=60) for e in edges])
    slices(spark, unpaid, "arrived_at", folders["payments"], edges)
    for kind, schema in schemas.items():
        closing(spark, kind, schema).coalesce(1).write.mode("append").parquet(folders[kind])
    # within its order's time, but years behind the stream
    too_late.coalesce(1).write.mode("append").parquet(folders["items"])
    found = run_streams(spark, tables, folders, schemas, str(tmp_path / "out"), str(tmp_path / "log"))
    wanted = profiles(incoming.incoming_orders(orders, on_time, unpaid, lookups(tables)))
    assert differences(found.filter("order_id != -1"), wanted) == 0
    rows = {r.order_id: r for r in found.filter(F.col("order_id").isin(lost, bare)).collect()}
    assert rows[lost].item_count is None and rows[lost].total_payment_value is not None
    assert rows[bare].item_count is None and rows[bare].total_payment_value is None


def test_parts_outside_the_time_do_not_count(tables, raw):
    arrival = incoming.Arrival(early="1 hour", wait="2 hours")
    rows = incoming.incoming_orders(raw["orders"], raw["items"], raw["payments"], lookups(tables), arrival)
    # the second item comes two hours after the purchase, those after it later
    near = raw["items"].filter("order_item_id <= 2").groupBy("order_id").count()
    known = rows.filter("item_count is not null").select("order_id", F.col("item_count").alias("count"))
    assert known.exceptAll(near).isEmpty() and near.exceptAll(known).isEmpty() and not near.isEmpty()
    strict = incoming.Arrival(early="1 minute", wait="1 minute")
    row = incoming.incoming_orders(raw["orders"], raw["items"], raw["payments"], lookups(tables), strict).first()
    assert (row.item_count, row.payment_count) == (None, None)
