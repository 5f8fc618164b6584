import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import metrics
from ledgerloom.sources import delimited, voucher_xml
from ledgerloom.streaming import arrivals, incremental, messages


def test_intents_and_routes(spark):
    rows = [("Aaj ki sales?", "revenue_today"), ("any problem", "alerts"), ("Most sold item", "best_product"),
            ("monthly summary", "report"), ("which one", "help"), ("zzz", "ai_generated"), ("Excel bhejo", "upload_link")]
    df = spark.createDataFrame(rows, "t string, expected string")
    assert df.filter(messages.intent(F.col("t")) != F.col("expected")).count() == 0
    rows = [(" HELLO ", False, "help"), ("upload", False, "not_whitelisted"), ("CSV kaise", True, "upload_link"),
            ("kya haal", True, "ai_generated")]
    df = spark.createDataFrame(rows, "t string, ok boolean, expected string")
    assert df.filter(messages.route(F.col("t"), F.col("ok")) != F.col("expected")).count() == 0


def test_retries_are_dropped_across_batches(spark, tmp_path):
    schema = "message_id string, created_at timestamp"
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    for minute, ids in enumerate((["a", "b", "a"], ["b", "c"])):
        rows = [(i, datetime.datetime(2026, 1, 1, 0, minute)) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = messages.drop_retries(spark.readStream.schema(schema).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(
            availableNow=True).start()
        query.awaitTermination()
    assert sorted(r["message_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_each_arriving_file_is_analysed_once(spark, tmp_path):
    inbox, store, state = (tmp_path / n for n in ("inbox", "store", "state"))
    inbox.mkdir()
    columns = ["Shop", "Date", "Party", "Item", "Amount"]
    seen = []

    def analyse(ledger, batch_id):
        seen.append({r["tenant"]: float(r["current_revenue"]) for r in metrics.revenue(ledger).collect()})

    for name, lines in (("a", ["s1,01/01/2026,x,p,10", "s1,01/01/2026,x,p,10", "s2,01/01/2026,y,p,7"]),
                        ("b", ["s1,02/01/2026,x,p,5"])):
        (inbox / f"{name}.csv").write_text("\n".join([",".join(columns), *lines]) + "\n")
        stream = arrivals.csv_arrivals(spark, str(inbox), columns)
        arrivals.on_arrival(stream, columns, F.col("Shop"), str(store), analyse, str(state)).awaitTermination()
    assert seen == [{"s1": 20.0, "s2": 7.0}, {"s1": 25.0}]
    ledger = spark.read.parquet(str(store))
    assert ledger.select("tenant", "row_id").distinct().count() == 4


def results_of(spark, folder):
    """The newest revenue and best product per tenant."""
    newest = {}
    for name, columns in (("revenue", ("current_revenue", "previous_revenue")), ("top_products", ("product", "revenue", "rank"))):
        for row in spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").orderBy("batch").collect():
            if name == "revenue" or row["rank"] == 1:
                newest[name, row["tenant"]] = tuple(str(row[c]) for c in columns)
    return newest


def expected_of(spark, ledger):
    found = {("revenue", r["tenant"]): (str(r["current_revenue"]), str(r["previous_revenue"])) for r in metrics.revenue(ledger).collect()}
    return found | {("top_products", r["tenant"]): (r["product"], str(r["revenue"]), "1") for r in metrics.top_products(ledger).collect() if r["rank"] == 1}


def keep(out):
    def publish(results, batch):
        for name, table in results.items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
    return publish


def sales_csv(rows, header="Shop,Date,Party,Item,Amount"):
    return "\n".join([header, *(",".join(map(str, r)) for r in rows)]) + "\n"


def test_increments_equal_the_whole_ledger(spark, tmp_path, monkeypatch):
    """Files come in three calls, the second late, headers differ, and spans are merged on the way."""
    monkeypatch.setattr(incremental, "SPAN_BATCHES", 2)
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    inbox.mkdir()
    files = [
        ("a", sales_csv([("s1", "01/03/2026", "x", "tea", 10), ("s2", "02/03/2026", "y", "salt", 7), ("s1", "28/02/2026", "x", '"rice, 1kg"', -4)])),
        ("b", sales_csv([(5, "pot", "05/01/2025", "s1"), (9, "tea", "27/02/2026", "s1")], "Net Amount,Product,Bill Date,Shop")),
        ("c", sales_csv([("s3", "01/01/2026", "z", "oil", 3), ("s1", "02/03/2026", "x", "tea", 1.5), ("s1", "x", "x", "tea", 1)])),
        ("d", sales_csv([("s3", "nothing", "z", "oil", 3)])),
    ]
    for name, text in files:
        (inbox / f"{name}.csv").write_text(text)
        arriving = incremental.csv_arrivals(spark, str(inbox), delimited.named_cell("Shop"))
        incremental.follow(arriving, str(tmp_path / "store"), keep(out), str(tmp_path / "state")).awaitTermination()
    whole, _ = delimited.read_ledger_mixed(spark, str(inbox), delimited.named_cell("Shop"))
    assert results_of(spark, out) == expected_of(spark, whole)
    assert incremental.Store(str(tmp_path / "store")).all_spans(spark, 3).agg(F.sum("n_rows")).first()[0] == 7


def test_a_batch_run_again_replaces_itself_and_old_months_are_not_read(spark, tmp_path, make_ledger):
    store = incremental.Store(str(tmp_path / "store"))
    old = make_ledger([("s1", f"20{y:02d}-{m:02d}-05", "c", "p", 10) for y in range(10, 26) for m in range(1, 13)])
    new = make_ledger([("s1", "2026-01-20", "c", "q", 3), ("s2", "2026-01-21", "d", "q", 4)])
    for batch, rows in enumerate((old, new)):
        store.add(rows, batch)
    again = store.add(new, 1)
    results = store.results(spark, 1, again.select("tenant").distinct())
    whole = old.unionByName(new)
    assert {r["tenant"]: r["current_revenue"] for r in results["revenue"].collect()} == {
        r["tenant"]: r["current_revenue"] for r in metrics.revenue(whole).collect()}
    assert store.all_spans(spark, 1).agg(F.sum("n_rows")).first()[0] == 194
    months = {f.split("month=")[1][:7] for f in results["recent_daily_revenue"].inputFiles() if "month=" in f}
    assert min(months) >= "2025-07" and len(months) <= 7


def test_arriving_vouchers_equal_the_batch_reader(spark, tmp_path):
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    inbox.mkdir()
    line = "<ALLLEDGERENTRIES.LIST><LEDGERNAME>{}</LEDGERNAME><AMOUNT>-{}</AMOUNT></ALLLEDGERENTRIES.LIST>"
    for name, company, rows in (("a", "Ash", [("20260101", "tea", 5), ("20260108", "pot", 8)]), ("b", "Oak", [("20260102", "oil", 2)]),
                                ("c", "Ash", [("20251231", "tea", 4)])):
        vouchers = "".join(f'<VOUCHER VCHTYPE="Sales"><DATE>{d}</DATE>{line.format(p, a)}</VOUCHER>' for d, p, a in rows)
        (inbox / f"{name}.xml").write_text(f"<E><COMPANY>{company}</COMPANY>{vouchers}</E>")
        arriving = incremental.xml_arrivals(spark, str(inbox), "2026-05-01")
        incremental.follow(arriving, str(tmp_path / "store"), keep(out), str(tmp_path / "state")).awaitTermination()
    whole, _ = voucher_xml.read_ledger_xml(spark, str(inbox), "2026-05-01")
    assert results_of(spark, out) == expected_of(spark, whole) and len(results_of(spark, out)) == 4
