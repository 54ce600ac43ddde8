"""Reprocessed rows that repeat a key: the last one counts, for each table on its own."""

from tidewright.operators import load
from tidewright.operators.records import spec_for


def test_no_invoice_or_account_is_lost(spark):
    spec = spec_for({"invoice_natural_key": "n", "account_number": "a"})
    rows = [("t", "b1", 1, "c1", [], (("INV-0",), ("ACC-0",))), ("t", "b1", 2, "c1", [], (("INV-1",), ("ACC-1",))),
            ("t", "b2", 1, "c2", [], (("INV-1",), ("ACC-2",))), ("t", "b2", 2, "c2", ["bad"], (("INV-9",), ("ACC-9",)))]
    annotated = spark.createDataFrame(
        rows, "tenant_id string, batch_id string, row_index long, customer_id string, errors array<string>, "
        "rec struct<invoices: struct<natural_key: string>, accounts: struct<account_number: string>>")
    current = {t: load.empty_table(spark, t) for t in ("invoices", "accounts")}
    after = load.next_tables(annotated, spec, current, None, last_wins=True)
    assert {r.natural_key: r.customer_id for r in after["invoices"].collect()} == {"INV-0": "c1", "INV-1": "c2"}
    assert {r.account_number for r in after["accounts"].collect()} == {"ACC-0", "ACC-1", "ACC-2"}
