"""Messy source extracts derived, row by row, from the benchmark tables.

Each extract is one SELECT list, written once and rendered for Spark and for
the SQL twin that checks it. Every row of the base table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.hashing import stable_id
from tidewright.operators.joins import use_all_cores
from tidewright.operators.records import spec_for

AS_OF = "2000-06-01"

SPARK = {
    "div": lambda a, b: f"(({a}) div {b})",
    "thousands": lambda x: f"format_number({x}, 0)",
    "dmy": lambda d: f"date_format({d}, 'dd/MM/yyyy')",
    "mdy": lambda d: f"date_format({d}, 'MM/dd/yyyy')",
    "iso": lambda d: f"date_format({d}, 'yyyy-MM-dd')",
    "plus_days": lambda d, n: f"date_add(cast({d} as date), cast({n} as int))",
}
DUCK = {
    "div": lambda a, b: f"(({a}) // {b})",
    "thousands": lambda x: f"format('{{:,}}', {x})",
    "dmy": lambda d: f"strftime({d}, '%d/%m/%Y')",
    "mdy": lambda d: f"strftime({d}, '%m/%d/%Y')",
    "iso": lambda d: f"strftime({d}, '%Y-%m-%d')",
    "plus_days": lambda d, n: f"(cast({d} as date) + cast({n} as int))",
}


def _tenant(key: str, d: dict) -> str:
    return f"concat('tenant-', cast({d['div'](key, 1000)} as string))"


def invoice_columns(d: dict) -> dict[str, str]:
    k, cents = "o_orderkey", "cast(round(o_totalprice * 100) as bigint)"
    whole = f"cast({d['div'](cents, 100)} as bigint)"
    rest = f"lpad(cast({cents} % 100 as string), 2, '0')"
    plain = f"concat(cast({whole} as string), '.', {rest})"
    money = (
        f"case when {k} % 10 = 0 then concat('$', {d['thousands'](whole)}, '.', {rest}) "
        f"when {k} % 10 = 1 then concat(replace({d['thousands'](whole)}, ',', '.'), ',', {rest}) "
        f"when {k} % 10 = 2 then concat('-', {plain}) "
        f"when {k} % 30 = 3 then 'not-money' "
        f"when {k} % 10 = 3 then cast({whole} as string) else {plain} end"
    )
    return {
        "tenant_id": _tenant("o_custkey", d),
        "batch_id": f"concat('billing-', cast({d['div']('o_custkey', 1000)} as string))",
        "row_index": k,
        "invoice_number": f"case when {k} % 50 = 7 then '' when {k} % 97 = 5 then concat('INV-', cast({k} - 1 as string)) "
        f"else concat('INV-', cast({k} as string)) end",
        "customer_id": f"case when {k} % 83 = 11 then concat('X-', cast(9000000 + o_custkey as string)) "
        f"when {k} % 2 = 0 then concat('C-', cast(100000 + o_custkey as string)) "
        f"else cast(100000 + o_custkey as string) end",
        "amount": money,
        "currency": f"case when {k} % 61 = 3 then '  ' else 'USD' end",
        "issue_date": f"case when {k} % 7 = 0 then {d['dmy']('o_orderdate')} when {k} % 7 = 1 then {d['mdy']('o_orderdate')} "
        f"when {k} % 21 = 2 then 'not-a-date' else {d['iso']('o_orderdate')} end",
        "due_date": d["iso"](d["plus_days"]("o_orderdate", f"{k} % 60 - 5")),
        "status": f"case o_orderstatus when 'O' then ' OPEN ' when 'F' then 'Paid' "
        f"else case when {k} % 3 = 0 then 'bogus' else 'void' end end",
        "account_number": f"case when {k} % 11 = 4 then '' else concat('ACC-', cast(o_custkey as string)) end",
        "tax_amount": f"concat(cast({d['div'](cents, 1000)} as string), '.5')",
        "po_number": f"concat('PO-', cast({k} as string))",
    }


def customer_columns(d: dict) -> dict[str, str]:
    """From customer joined with nation, one extra copy (`twin` = 1) of some."""
    k = "c_custkey"
    prefix = f"concat(chr(cast(65 + {k} % 26 as int)), chr(cast(65 + {d['div'](k, 26)} % 26 as int)), " \
             f"chr(cast(97 + {d['div'](k, 676)} % 26 as int)))"
    return {
        "tenant_id": _tenant(k, d),
        "batch_id": f"concat('crm-', cast({d['div'](k, 1000)} as string))",
        "row_index": f"{k} * 2 + twin",
        "customer_id": f"concat('C-', cast(100000 + {k} + twin * 70000000 as string))",
        "company_name": f"concat({prefix}, ' ', lower(c_mktsegment), ' ', cast({k} as string), "
        f"case when twin = 1 then ' Ltd' else '' end)",
        "email": f"case when {k} % 20 = 3 then '' else concat('u', cast({k} as string), '@ex.com') end",
        "phone": f"concat('+1-555-', lpad(cast({k} % 10000 as string), 4, '0'))",
        "country": f"case when {k} % 31 = 9 then ' ' else n_name end",
        "industry": "lower(c_mktsegment)",
        "risk_tier": f"case when c_acctbal < 1000 then 'HIGH' when c_acctbal < 5000 then ' Medium' "
        f"when {k} % 45 = 8 then 'severe' else 'low' end",
        "kyc_status": f"case {k} % 9 when 0 then 'Verified' when 1 then ' rejected' when 2 then "
        f"case when {k} % 4 = 0 then '' else 'pending' end else 'verified' end",
        "created_at": f"case when {k} % 13 = 5 then '03/04/2025' else concat('20', lpad(cast(10 + {k} % 14 as string), 2, '0'), '-', "
        f"lpad(cast(1 + {k} % 12 as string), 2, '0'), '-', lpad(cast(1 + {k} % 28 as string), 2, '0')) end",
        "employee_count": f"case when {k} % 37 = 6 then 'many' when {k} % 5 = 0 then concat('1_', lpad(cast({k} % 1000 as string), 3, '0')) "
        f"else concat(' ', cast({k} % 900 as string)) end",
        "region": "c_mktsegment",
    }


def ticket_columns(d: dict) -> dict[str, str]:
    k = "event_id"
    return {
        "tenant_id": _tenant("user_id", d),
        "batch_id": f"concat('support-', cast({d['div']('user_id', 1000)} as string))",
        "row_index": k,
        "ticket_ref": f"case when {k} % 53 = 11 then concat('TCK-', cast({k} - 1 as string)) "
        f"else concat('TCK-', cast({k} as string)) end",
        "customer_id": f"case when {k} % 29 = 4 then '' when {k} % 71 = 6 then concat('Z-', cast(user_id as string)) "
        f"when {k} % 3 = 0 then concat('C-', cast(100000 + user_id as string)) else concat('#', cast(100000 + user_id as string)) end",
        "subject": "concat(event_type, ' of ', props)",
        "priority": f"case {k} % 5 when 0 then 'LOW' when 1 then 'medium ' when 2 then 'High' when 3 then 'urgent' else '' end",
        "status": f"case {k} % 4 when 0 then 'open' when 1 then 'Pending' when 2 then 'closed' "
        f"else case when {k} % 3 = 0 then 'solved' else 'Open' end end",
        "opened_at": d["iso"]("ts"),
        "closed_at": f"case when {k} % 4 = 2 then {d['dmy']('ts')} else '' end",
    }


COLUMNS = {"invoices": invoice_columns, "customers": customer_columns, "tickets": ticket_columns}
LEDGER_COLUMNS = ("tenant_id", "batch_id", "row_index")

CUSTOMER_SPEC = spec_for({
    "customer_natural_key": "customer_id", "legal_name": "company_name", "customer_email": "email",
    "customer_phone": "phone", "country": "country", "industry": "industry", "risk_tier": "risk_tier",
    "kyc_status": "kyc_status", "customer_created_at": "created_at", "customer_employee_count": "employee_count",
    "customer_region": "region",
})
INVOICE_SPEC = spec_for({
    "invoice_natural_key": "invoice_number", "invoice_customer_natural_key": "customer_id",
    "invoice_amount_minor_units": "amount", "invoice_currency": "currency", "invoice_issue_date": "issue_date",
    "invoice_due_date": "due_date", "invoice_status": "status", "account_number": "account_number",
    "invoice_tax_amount_minor_units": "tax_amount", "invoice_po_number": "po_number",
})
TICKET_SPEC = spec_for({
    "ticket_natural_key": "ticket_ref", "ticket_customer_natural_key": "customer_id", "ticket_subject": "subject",
    "ticket_priority": "priority", "ticket_status": "status", "ticket_opened_at": "opened_at",
    "ticket_closed_at": "closed_at",
})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(spark: SparkSession, sf_dir: str, extract: str) -> DataFrame:
    """An extract with one string column per source column."""
    if extract == "customers":
        twins = F.explode(F.sequence(F.lit(0), F.when(F.col("c_custkey") % 40 == 7, 1).otherwise(0)))
        base = use_all_cores(table(spark, sf_dir, "customer"), "c_custkey").join(
            table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
        ).withColumn("twin", twins)
    else:
        name, key = {"invoices": ("orders", "o_orderkey"), "tickets": ("events", "event_id")}[extract]
        base = use_all_cores(table(spark, sf_dir, name), key)
    return base.selectExpr(*[f"{sql} as {name}" for name, sql in COLUMNS[extract](SPARK).items()])


def raw(spark: SparkSession, sf_dir: str, extract: str) -> DataFrame:
    """An extract in the landed form: one map of cells per row."""
    rows = flat(spark, sf_dir, extract)
    cells = [c for c in rows.columns if c not in LEDGER_COLUMNS]
    pairs = [part for c in cells for part in (F.lit(c), F.col(c))]
    return rows.select(*LEDGER_COLUMNS, F.create_map(*pairs).alias("raw"))


def flat_sql(extract: str) -> str:
    """The same extract as a SELECT for the checking engine."""
    base = {
        "invoices": "orders",
        "tickets": "events",
        "customers": "(select * from customer join nation on c_nationkey = n_nationkey "
        "cross join (values (0), (1)) t(twin) where twin = 0 or c_custkey % 40 = 7)",
    }[extract]
    return "select " + ", ".join(f"{sql} as {name}" for name, sql in COLUMNS[extract](DUCK).items()) + f" from {base}"


def canonical_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as if loaded before: (id, tenant_id, natural_key, ...)."""
    rows = flat(spark, sf_dir, "customers")
    return rows.select(
        stable_id("customers", F.col("tenant_id"), F.col("customer_id")).alias("id"),
        "tenant_id", F.col("customer_id").alias("natural_key"), F.col("company_name").alias("legal_name"),
        F.nullif("email", F.lit("")).alias("email"), F.nullif(F.trim("country"), F.lit("")).alias("country"),
    )


def id_sql(*parts: str) -> str:
    """The id that `stable_id` gives these SQL expressions of text."""
    return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({p})) || ':' || {p}, '-')" for p in parts) + "))"


CANONICAL_CUSTOMERS_SQL = (
    f"select {id_sql("'customers'", 'tenant_id', 'customer_id')} as id, tenant_id, customer_id as natural_key, "
    "company_name as legal_name, nullif(email, '') as email, nullif(trim(country), '') as country from raw_customers"
)
