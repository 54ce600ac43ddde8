"""From dropped files to merged customers, every stage run twice."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewright.operators.records import InvalidSpec, apply_spec, entry, require_natural_keys, spec_for
from tidewright.plans import onboarding as ob


def store_spec(ws, batch_id, columns):
    """A confirmed spec as a reviewer would leave it."""
    from tidewright.operators import mapping

    document = spec_for(columns)
    rows = [(n, e["source_column"], e["transform"]["function"]) for n, e in document.items()]
    entries = ws.spark.createDataFrame(rows, "f string, c string, t string").select(
        F.struct("f", F.struct(F.col("c").alias("source_column"),
                               F.struct(F.col("t").alias("function"), F.create_map().cast("map<string,string>").alias("params")).alias("transform"),
                               F.lit(None).alias("provenance")).cast(mapping.ENTRY).alias("e")).alias("p"))
    spec = entries.agg(F.map_from_entries(F.collect_list("p")).alias("spec"))
    batch = ws.read("batches").where(F.col("id") == batch_id).select("tenant_id", "source_id")
    drafts = mapping.next_versions(ws.read("mapping_specs"), batch.crossJoin(spec))
    ws.write("mapping_specs", ws.read("mapping_specs").unionByName(drafts))
    ob.confirm(ws, drafts.first()["id"])


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("state")
    crm, billing = tmp_path_factory.mktemp("crm"), tmp_path_factory.mktemp("billing")
    (crm / "crm.csv").write_text(
        "customer_id,company_name,email,kyc_status\n"
        "C-1001,Whitfield & Sons,w@x.example,verified\nC-1002,Café Système,c@x.example,\n"
        "C-1003,Whitfield and Sons Ltd,w@x.example,pending\n,Nobody,n@x.example,verified\nC-1001,Again,a@x.example,verified\n")
    (billing / "billing.csv").write_text(
        "customer_id,invoice_number,amount,currency,issue_date,account_number\n"
        '1001,INV-1,"$1,234.56",USD,2025-03-01,ACC-1\n1003,INV-2,100.00,USD,25/12/2025,ACC-1\n9999,INV-3,5.00,USD,2025-01-01,ACC-9\n'
        "1001,INV-4,-450.00,USD,2025-01-01,ACC-1\n1001,INV-5,abc,USD,2025-01-01,ACC-2\nC-1OO1,INV-6,7.00,USD,03/04/2025,ACC-2\n")
    ws = ob.Workspace(spark, str(root))
    batches = {}
    for folder, kind in ((crm, "crm"), (billing, "billing")):
        landed = ob.land_folder(ws, str(folder), "t1", kind, kind).collect()
        assert [r.is_replay for r in landed] == [False]
        assert [r.is_replay for r in ob.land_folder(ws, str(folder), "t1", kind, kind).collect()] == [True]
        batches[kind] = landed[0].batch_id
    assert ws.raw().count() == 11
    store_spec(ws, batches["crm"], {"customer_natural_key": "customer_id", "legal_name": "company_name", "customer_email": "email"})
    store_spec(ws, batches["billing"], {
        "invoice_natural_key": "invoice_number", "invoice_customer_natural_key": "customer_id", "invoice_amount_minor_units": "amount",
        "invoice_currency": "currency", "invoice_issue_date": "issue_date", "account_number": "account_number"})
    return ws, batches


def test_files_are_known_by_their_rows(loaded, tmp_path):
    ws, _ = loaded
    for name, text in (("a", "id,x\n1,a\n2,b\n"), ("b", "id,x\n2,b\n1,a\n")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "f.csv").write_text(text)
        landed = [ob.land_folder(ws, str(folder), "t2", "crm", "crm").first() for _ in range(2)]
        assert [r.is_replay for r in landed] == [False, True]
    assert ws.read("batches").where(F.col("tenant_id") == "t2").count() == 2


def test_a_batch_without_confirmed_spec_is_refused(loaded):
    ws, _ = loaded
    with pytest.raises(ob.NoConfirmedSpec):
        ob.confirmed_spec(ws, "no such batch")


def test_load_is_repeatable_and_fixes_follow(loaded):
    ws, batches = loaded
    state = None
    for _ in range(2):
        crm = ob.load_batch(ws, batches["crm"], date(2026, 1, 1)).first()
        billing = ob.load_batch(ws, batches["billing"], date(2026, 1, 1)).first()
        assert (crm.total_rows, crm.loaded, crm.quarantined) == (5, 3, 2)
        assert (billing.total_rows, billing.loaded, billing.quarantined) == (6, 2, 4)
        now = [sorted(map(str, ws.read(t).collect())) for t in ("customers", "invoices", "accounts", "quarantine")]
        assert state is None or now == state
        state = now
    customers = {r.natural_key: r for r in ws.read("customers").collect()}
    assert customers["C-1002"].legal_name == "Café Système" and customers["C-1002"].kyc_status == "pending"
    invoices = {r.natural_key: r for r in ws.read("invoices").collect()}
    assert invoices["INV-1"].amount_minor_units == 123456 and invoices["INV-1"].customer_id == customers["C-1001"].id
    assert invoices["INV-2"].issue_date == date(2025, 12, 25) and invoices["INV-2"].status == "open"
    accounts = ws.read("accounts").collect()
    assert [(a.account_number, a.customer_id) for a in accounts] == [("ACC-1", customers["C-1003"].id)]
    entries = {(r.batch_id, r.row_index): r for r in ws.read("quarantine").collect()}
    code = lambda kind, i: entries[(batches[kind], i)].error_codes
    assert code("crm", 3) == ["MISSING_REQUIRED"] and code("crm", 4) == ["DUPLICATE_EXACT"]
    assert code("billing", 2) == ["REF_INTEGRITY_ORPHAN_FK"] and code("billing", 3) == ["BUSINESS_RULE_NEGATIVE_AMOUNT"]
    assert code("billing", 4) == ["TYPE_COERCION_FAILED"]
    assert code("billing", 5) == ["DATE_AMBIGUOUS", "REF_INTEGRITY_ORPHAN_FK"]
    assert entries[(batches["billing"], 5)].explanation == "invoice_issue_date: DATE_AMBIGUOUS; customer_id: REF_INTEGRITY_ORPHAN_FK"
    assert entries[(batches["billing"], 2)].suggested_fix is None

    counts = ob.bulk_fix(ws, "t1", "TYPE_COERCION_FAILED", {"amount": "12.00"}, date(2026, 1, 1)).first()
    assert (counts.processed, counts.loaded, counts.still_open) == (1, 1, 0)
    counts = ob.bulk_fix(ws, "t1", "DATE_AMBIGUOUS", {"issue_date": "2025-04-03"}, date(2026, 1, 1)).first()
    assert (counts.processed, counts.loaded, counts.still_open) == (1, 0, 1)
    after = {(r.batch_id, r.row_index): r for r in ws.read("quarantine").collect()}
    assert after[(batches["billing"], 4)].status == "resubmitted"
    assert after[(batches["billing"], 5)].error_codes == ["REF_INTEGRITY_ORPHAN_FK"]
    assert after[(batches["billing"], 5)].raw["issue_date"] == "2025-04-03"
    assert {r.natural_key for r in ws.read("invoices").collect()} == {"INV-1", "INV-2", "INV-5"}

    # duplicates: found once, refreshed the second time, then merged
    assert tuple(ob.find_duplicates(ws).first()) == (1, 1)
    assert tuple(ob.find_duplicates(ws).first()) == (1, 0)
    pair = ws.read("duplicate_candidates")
    winner = pair.first().customer_id_a
    assert {r.winner for r in ob.merge(ws, pair).collect()} == {winner}
    assert ws.read("customers").count() == 2
    assert {r.customer_id for r in ws.read("invoices").collect()} == {winner}
    assert [r.status for r in ws.read("duplicate_candidates").collect()] == ["merged"]
    with pytest.raises(ValueError):
        ob.merge(ws, pair)


def test_proposed_spec_maps_the_obvious_columns(loaded):
    ws, batches = loaded
    spec_id = ob.propose_spec(ws, batches["billing"], "t1")
    row = ws.read("mapping_specs").where(F.col("id") == spec_id).first()
    assert row.status == "draft" and row.version == 2 and row.parent_version == 1
    chosen = {f: e.source_column for f, e in row.spec.items()}
    assert chosen["invoice_currency"] == "currency" and chosen["account_number"] == "account_number"
    assert chosen["invoice_amount_minor_units"] == "amount"
    ob.confirm(ws, spec_id)
    statuses = {r.version: r.status for r in ws.read("mapping_specs").where(F.col("source_id") == row.source_id).collect()}
    assert statuses == {1: "superseded", 2: "confirmed"}
    with pytest.raises(ValueError):
        ob.confirm(ws, spec_id)


def test_records_of_several_tables_and_refused_specs(spark):
    raw = spark.createDataFrame([("t", "b", 0, {"c": "1001", "n": "INV-1", "a": "ACC-1"})],
                                "tenant_id string, batch_id string, row_index long, raw map<string,string>")
    spec = {"invoice_customer_natural_key": entry("c", "trim"), "invoice_natural_key": entry("n", "trim"), "account_number": entry("a", "trim")}
    row = apply_spec(raw, spec).first()
    assert row.rec.invoices.natural_key == "INV-1" and row.rec.accounts.account_number == "ACC-1"
    assert row.link.invoices == "1001" and row.link.accounts is None and row.errors == []
    with pytest.raises(InvalidSpec):
        require_natural_keys({"legal_name": entry("x", "trim")})


def test_links_see_the_batch_own_customers(spark):
    from tidewright.operators import load

    raw = spark.createDataFrame(
        [("t", "b", i, {"c": c, "name": n, "inv": f"INV-{i}", "ref": r}) for i, (c, n, r) in enumerate(
            [("C-1", "A", "C-2"), ("C-2", "B", "2"), ("C-3", "", "C-1"), ("C-4", "D", "C-3")])],
        "tenant_id string, batch_id string, row_index long, raw map<string,string>")
    spec = {"customer_natural_key": entry("c", "trim"), "legal_name": entry("name", "trim"),
            "invoice_natural_key": entry("inv", "trim"), "invoice_customer_natural_key": entry("ref", "trim")}
    rows = load.annotate(raw, spec, load.empty_table(spark, "customers"), date(2026, 1, 1)).orderBy("row_index").collect()
    codes = [[e.code for e in r.errors] for r in rows]
    # row 2 has no name, so its customer is not there for row 3
    assert codes == [[], [], ["MISSING_REQUIRED"], ["REF_INTEGRITY_ORPHAN_FK"]]
    assert rows[0].customer_id == rows[1].customer_id
