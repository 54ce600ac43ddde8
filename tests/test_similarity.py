import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewright.functions import similarity
from tidewright.functions.vectors import cosine
from tidewright.operators import evaluate, mapping

# Labelled columns of the seed files, (kind, column, true field or None).
SEED_LABELS = [
    ("crm", c, t) for a, b, t in [
        ("customer_id", "CustID", "customer_natural_key"), ("company_name", "COMPNAME", "legal_name"),
        ("display_name", "DISPNAME", "display_name"), ("email", "EMAIL", "customer_email"),
        ("phone", "PHONE", "customer_phone"), ("country", "CNTRY", "country"), ("industry", "IND_CD", "industry"),
        ("risk_tier", "RISK", "risk_tier"), ("created_at", "DT_CREATE", "customer_created_at"), ("notes", "NOTES", None),
        ("vat_number", "VATNO", "customer_vat_number"), ("employee_count", "EMPCT", "customer_employee_count"),
        ("region", "REGION", "customer_region"),
    ] for c in (a, b)
] + [
    ("billing", "customer_id", "invoice_customer_natural_key"), ("billing", "invoice_number", "invoice_natural_key"),
    ("billing", "amount", "invoice_amount_minor_units"), ("billing", "currency", "invoice_currency"),
    ("billing", "issue_date", "invoice_issue_date"), ("billing", "due_date", "invoice_due_date"),
    ("billing", "status", "invoice_status"), ("billing", "account_number", "account_number"),
    ("billing", "payment_method", None), ("billing", "memo", None),
    ("billing", "tax_amount", "invoice_tax_amount_minor_units"), ("billing", "po_number", "invoice_po_number"),
    ("support", "customer_id", "ticket_customer_natural_key"), ("support", "ticket_ref", "ticket_natural_key"),
    ("support", "subject", "ticket_subject"), ("support", "priority", "ticket_priority"),
    ("support", "status", "ticket_status"), ("support", "opened_at", "ticket_opened_at"),
    ("support", "closed_at", "ticket_closed_at"), ("support", "channel", None), ("support", "assignee", None),
    ("support", "account_number", "account_number"),
]
# Labelled columns of other products' exports.
HELD_OUT_LABELS = [
    ("crm", "AccountId", "customer_natural_key"), ("crm", "Name", "legal_name"), ("crm", "BillingCountry", "country"),
    ("crm", "Phone", "customer_phone"), ("crm", "Email", "customer_email"), ("crm", "Sic", "industry"),
    ("crm", "NumberOfEmployees", "customer_employee_count"), ("crm", "CreatedDate", "customer_created_at"),
    ("crm", "AccountSource", None), ("crm", "hs_object_id", "customer_natural_key"), ("crm", "createdate", "customer_created_at"),
    ("crm", "company", "legal_name"), ("crm", "numemployees", "customer_employee_count"), ("crm", "lifecyclestage", None),
    ("billing", "TxnDate", "invoice_issue_date"), ("billing", "DocNumber", "invoice_natural_key"),
    ("billing", "CustomerRef", "invoice_customer_natural_key"), ("billing", "DueDate", "invoice_due_date"),
    ("billing", "TotalAmt", "invoice_amount_minor_units"), ("billing", "CurrencyRef", "invoice_currency"),
    ("billing", "Balance", None), ("billing", "PrivateNote", None), ("support", "requester_id", "ticket_customer_natural_key"),
    ("support", "priority", "ticket_priority"), ("support", "status", "ticket_status"), ("support", "created_at", "ticket_opened_at"),
    ("support", "subject", "ticket_subject"), ("support", "via_channel", None), ("support", "satisfaction_rating", None),
    ("support", "id", "ticket_natural_key"),
]


def _words(rng, n, alphabet="abcdé 1"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_common_subsequence_matches_brute_force():
    rng = random.Random(1)
    for a, b in zip(_words(rng, 400), _words(rng, 400)):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity.lcs_length(a, b) == table[-1][-1]


def test_jaro_winkler_matches_the_sql_function():
    rng = random.Random(2)
    pairs = pd.DataFrame({"a": _words(rng, 5000), "b": _words(rng, 5000)})
    con = duckdb.connect()
    con.register("p", pairs)
    wanted = np.array([r[0] for r in con.execute("select jaro_winkler_similarity(a, b) from p").fetchall()])
    assert np.abs(similarity.jaro_winkler_batch(pairs.a, pairs.b) - wanted).max() < 1e-12


def test_published_name_only_accuracy(spark):
    rows = [("seed", i, *r) for i, r in enumerate(SEED_LABELS)] + [("held_out", i, *r) for i, r in enumerate(HELD_OUT_LABELS)]
    labels = spark.createDataFrame(rows, "benchmark string, item int, source_kind string, column_name string, truth string")
    by = ["benchmark", "item", "source_kind"]
    ranked = mapping.baseline_ranking(labels.select(*by, "column_name"), ["benchmark", "item"])
    predictions = evaluate.rankings(ranked, by).join(labels, [*by, "column_name"])
    got = {r.benchmark: r for r in evaluate.mapping_accuracy(predictions, ["benchmark"]).collect()}
    assert (got["seed"].mapped_columns, got["seed"].acc_at_1, got["seed"].acc_at_3, got["seed"].precision, got["seed"].recall) == (
        42, 0.9762, 1.0, 0.8542, 0.9762)
    assert (got["held_out"].mapped_columns, got["held_out"].acc_at_1, got["held_out"].acc_at_3, got["held_out"].precision) == (
        24, 0.7917, 1.0, 0.6333)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]
