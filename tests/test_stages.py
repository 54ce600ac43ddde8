"""Single steps over stored state: pulls, overrides, single entries, dismissals, metrics, the run ledger."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from test_onboarding import store_spec
from tidewright.plans import onboarding as ob

TODAY = date(2026, 1, 1)


@pytest.fixture(scope="module")
def pulled(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pull")
    items = [{"CustID": f"C-{i}", "CompName": "" if i in (3, 4) else f"Company {i}", "Email": "x@x.example" if i < 3 else f"{i}@x.example"} for i in range(1, 7)]
    for n in (1, 2):
        page = {"items": items[3 * n - 3 : 3 * n], "page": n, "page_size": 3, "total": 6, "has_next": n == 1}
        (folder / f"{n}.json").write_text(json.dumps(page))
    ws = ob.Workspace(spark, str(tmp_path_factory.mktemp("state")))
    landed = ob.land_pull(ws, str(folder), "t", "api").first()
    assert not landed.is_replay and ob.land_pull(ws, str(folder), "t", "api").first().is_replay
    store_spec(ws, landed.batch_id, {"customer_natural_key": "CustID", "legal_name": "CompName", "customer_email": "Email"})
    return ws, landed.batch_id


def test_a_pull_becomes_a_batch_that_loads(pulled):
    ws, batch = pulled
    row = ws.batch(batch)
    assert (row.row_count, row.filename, row.tenant_id) == (6, "pull.json", "t")
    assert [r.raw["CustID"] for r in ws.raw(batch).orderBy("row_index").collect()] == [f"C-{i}" for i in range(1, 7)]
    done = ob.load_batch(ws, batch, TODAY).first()
    assert (done.total_rows, done.loaded, done.quarantined) == (6, 4, 2)


def test_single_entries_are_resolved_or_set_aside(pulled):
    ws, batch = pulled
    entries = {r.row_index: r.id for r in ws.read("quarantine", "t").collect()}
    assert set(entries) == {2, 3}
    still = ob.resolve_entry(ws, "t", entries[2], {"Email": "new@x.example"}, TODAY)
    assert (still.status, still.error_codes, still.raw["Email"]) == ("open", ["MISSING_REQUIRED"], "new@x.example")
    done = ob.resolve_entry(ws, "t", entries[2], {"CompName": "Third"}, TODAY)
    assert done.status == "resubmitted"
    assert ws.read("customers", "t").where("natural_key = 'C-3'").first().email == "new@x.example"
    ob.ignore_entry(ws, "t", entries[3])
    assert {r.row_index: r.status for r in ws.read("quarantine", "t").collect()} == {2: "resubmitted", 3: "ignored"}
    assert ob.bulk_ignore(ws, "t", "MISSING_REQUIRED") == 0
    with pytest.raises(LookupError):
        ob.ignore_entry(ws, "t", "nothing")
    with pytest.raises(LookupError):
        ob.ignore_entry(ws, "another tenant", entries[3])


def test_duplicates_are_listed_and_dismissed(pulled):
    ws, _ = pulled
    assert ob.find_duplicates(ws, 0.5, tenant_id="t").first().candidates == 1
    pair = ob.list_duplicates(ws, "t").first()
    ob.dismiss(ws, "t", [pair.id])
    assert ob.list_duplicates(ws, "t").isEmpty() and ob.list_duplicates(ws, "t", "dismissed").count() == 1
    assert tuple(ob.find_duplicates(ws, 0.5, tenant_id="t").first()) == (1, 0) and ob.list_duplicates(ws, "t").isEmpty()
    with pytest.raises(LookupError):
        ob.dismiss(ws, "t", ["nothing"])


def test_metrics_count_all_stored_tables(pulled):
    ws, _ = pulled
    got = {r.tenant_id: r for r in ob.tenant_metrics(ws, ["t", "nobody"]).collect()}
    assert (got["t"].batches, got["t"].customers, got["t"].quarantine_open, got["t"].quarantine_fixed, got["t"].mapping_specs_confirmed) == (1, 5, 0, 1, 1)
    assert set(got["nobody"][1:]) == {0} and {r.tenant_id for r in ob.tenant_metrics(ws).collect()} == {"t"}


def test_a_draft_is_overridden_in_place(pulled):
    ws, batch = pulled
    draft = ob.propose_spec(ws, batch, "t")
    before = ob.spec_row(ws, draft)
    assert "customer_email" in before.spec
    after = ob.override_spec(ws, draft, {"customer_email": None, "display_name": {"source_column": "CompName"}})
    assert (after.version, after.status) == (before.version, "draft")
    assert "customer_email" not in after.spec and after.spec["display_name"].provenance.method == "human"
    ob.confirm(ws, draft)
    with pytest.raises(ValueError):
        ob.override_spec(ws, draft, {"customer_email": None})
    with pytest.raises(ValueError):
        ob.override_spec(ws, "nothing", {})


def test_a_key_runs_a_stage_once(spark, tmp_path):
    ws = ob.Workspace(spark, str(tmp_path))
    calls = []

    def stage(broken=False):
        calls.append(1)
        row = spark.createDataFrame([(str(len(calls)), "t", "s", "crm")], ob.SOURCES)
        ws.commit({"sources": ws.read("sources", "t").unionByName(row)}, "t")
        assert ws.read("sources", "t").where(F.col("id") == str(len(calls))).count() == 1  # it reads what it has written
        if broken:
            raise RuntimeError("lost")
        return {"id": len(calls)}

    with pytest.raises(RuntimeError):
        ob.once(ws, "t", "land", "k", "f", lambda: stage(True))
    assert ws.read("sources").isEmpty() and ws.read("requests").isEmpty()
    assert ob.once(ws, "t", "land", "k", "f", stage) == ("new", {"id": 2})
    assert ob.once(ws, "t", "land", "k", "f", stage) == ("replay", {"id": 2}) and len(calls) == 2
    with pytest.raises(ob.RequestConflict):
        ob.once(ws, "t", "land", "k", "another", stage)
    assert ob.once(ws, "u", "land", "k", "another", stage)[0] == "new"  # keys belong to a tenant
    assert ob.once(ws, "t", "land", None, "f", stage)[0] == "new" and ob.once(ws, "t", "land", None, "f", stage)[0] == "new"
    assert ws.read("sources", "t").count() == 4 and ws.read("requests").count() == 2
