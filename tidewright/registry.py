"""Canonical fields: what a source column can be mapped to.

The registry is a constant of 33 rows, so it may always be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Field name | target | type | R = required | enum values | aliases | description
FIELDS_TEXT = """
customer_natural_key | customers.natural_key | string | R | | customer_id, cust_id, custid, client_ref, client_id | Stable customer key given by the source system
legal_name | customers.legal_name | string | R | | company_name, compname, legal_name, account_name | Registered name of the company
display_name | customers.display_name | string | | | display_name, short_name, dispname, nickname | Short name shown for the customer
customer_email | customers.email | email | | | email, e-mail, contact_email, primary_email, email_address | Main e-mail contact
customer_phone | customers.phone | phone | | | phone, phone_number, contact_phone, tel | Main telephone contact
country | customers.country | string | | | country, cntry, country_code, nation | Home country, as a name or a code
industry | customers.industry | string | | | industry, ind_cd, sector, vertical | Business sector
risk_tier | customers.risk_tier | enum | | low, medium, high | risk_tier, risk, risk_level, risk_class | Assigned risk class
kyc_status | customers.kyc_status | enum | R | pending, verified, rejected | kyc_status, kyc, kyc_state, verification_status | Outcome of the know-your-customer check
customer_created_at | customers.created_at | date | | | created_at, dt_create, date_created, created_date, signup_date | Day the source first recorded the customer
customer_vat_number | customers.vat_number | string | | | vat_number, vat_no, vatno, tax_id | Tax registration number
customer_employee_count | customers.employee_count | integer | | | employee_count, num_employees, headcount, empct | Approximate head count
customer_region | customers.region | string | | | region, sales_region, territory | Sales region
account_customer_natural_key | accounts.customer_id | string | R | | customer_id, cust_id, client_id | Key of the customer that owns the account
account_number | accounts.account_number | string | R | | account_number, acct_no, account_id | Number of the account
account_status | accounts.status | enum | | active, closed, suspended | status, account_status, acct_status | State of the account
account_opened_at | accounts.opened_at | date | | | opened_at, open_date, start_date | Day the account was opened
invoice_natural_key | invoices.natural_key | string | R | | invoice_number, invoice_id, inv_no, invoice_ref | Stable invoice key given by the source system
invoice_customer_natural_key | invoices.customer_id | string | R | | customer_id, cust_id, client_id | Key of the customer the invoice was sent to
invoice_amount_minor_units | invoices.amount_minor_units | money_minor_units | R | | amount, amt_usd, amount_usd, total, invoice_amount | Invoiced amount in minor currency units
invoice_currency | invoices.currency | currency_code | R | | currency, curr, ccy | Currency code of the amount
invoice_issue_date | invoices.issue_date | date | R | | issue_date, invoice_date, date_issued | Day the invoice was issued
invoice_due_date | invoices.due_date | date | | | due_date, payment_due, dt_due | Day the payment is due
invoice_status | invoices.status | enum | | open, paid, void, overdue | status, invoice_status, payment_status | Payment state of the invoice
invoice_tax_amount_minor_units | invoices.tax_amount_minor_units | money_minor_units | | | tax_amount, tax, vat_amount | Tax on the invoice in minor currency units
invoice_po_number | invoices.po_number | string | | | po_number, purchase_order, po_ref | Purchase order the invoice refers to
ticket_natural_key | support_tickets.natural_key | string | R | | ticket_ref, ticket_id, case_number | Stable ticket key given by the source system
ticket_customer_natural_key | support_tickets.customer_id | string | R | | customer_id, cust_id, client_id | Key of the customer who opened the ticket
ticket_subject | support_tickets.subject | string | | | subject, title, summary | What the ticket is about
ticket_priority | support_tickets.priority | enum | | low, medium, high, urgent | priority, severity | Urgency of the ticket
ticket_status | support_tickets.status | enum | | open, pending, closed | status, ticket_status | State of the ticket
ticket_opened_at | support_tickets.opened_at | date | | | opened_at, open_date | Day the ticket was opened
ticket_closed_at | support_tickets.closed_at | date | | | closed_at, close_date, resolved_at | Day the ticket was closed
"""

# Which tables each kind of source may feed, the one field every
# kind may carry, the parser and Spark type per field type, and column defaults.
TABLES_BY_KIND = {"crm": ("customers",), "billing": ("invoices",), "support": ("support_tickets",)}
SHARED_FIELDS = ("account_number",)
TRANSFORM_BY_TYPE = {
    "string": "trim",
    "email": "trim",
    "phone": "trim",
    "currency_code": "trim",
    "date": "parse_date",
    "datetime": "parse_date",
    "enum": "map_enum",
    "integer": "to_int",
    "money_minor_units": "to_minor_units",
}
SPARK_TYPE_BY_TRANSFORM = {
    "trim": "string",
    "map_enum": "string",
    "parse_date": "date",
    "to_int": "bigint",
    "to_minor_units": "bigint",
}
COLUMN_DEFAULTS = {"customers": {"kyc_status": "pending"}, "invoices": {"status": "open"}}
MIRROR_OF_NATURAL_KEY = {"invoices": "invoice_number", "support_tickets": "ticket_ref"}
KEYED_TABLES = ("customers", "invoices", "support_tickets")
LINKED_TABLES = ("accounts", "invoices", "support_tickets")


@dataclass(frozen=True)
class CanonicalField:
    ordinal: int
    name: str
    table: str
    column: str
    type: str
    required: bool
    enum_values: tuple[str, ...]
    aliases: tuple[str, ...]
    description: str

    @property
    def is_link(self) -> bool:
        """Link fields carry a customer's key; they resolve to `customer_id`."""
        return self.column == "customer_id"

    @property
    def transform(self) -> str:
        return TRANSFORM_BY_TYPE[self.type]

    @property
    def spark_type(self) -> str:
        return SPARK_TYPE_BY_TRANSFORM[self.transform]


def _words(cell: str) -> tuple[str, ...]:
    return tuple(w.strip() for w in cell.split(",") if w.strip())


def _load() -> dict[str, CanonicalField]:
    fields = {}
    for ordinal, line in enumerate(FIELDS_TEXT.strip().splitlines()):
        name, target, kind, required, enums, aliases, description = (c.strip() for c in line.split("|"))
        table, column = target.split(".")
        fields[name] = CanonicalField(
            ordinal, name, table, column, kind, required == "R", _words(enums), _words(aliases), description
        )
    return fields


FIELDS = _load()


def field(name: str) -> CanonicalField:
    if name not in FIELDS:
        raise KeyError(f"unknown canonical field {name!r}")
    return FIELDS[name]


def fields_of(table: str) -> list[CanonicalField]:
    return [f for f in FIELDS.values() if f.table == table]


def candidate_pool(source_kind: str | None) -> list[CanonicalField]:
    """Fields a source of this kind may map to; every field for an unknown kind."""
    tables = TABLES_BY_KIND.get(source_kind or "")
    if tables is None:
        return list(FIELDS.values())
    return [f for f in FIELDS.values() if f.table in tables or f.name in SHARED_FIELDS]


def registry_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [
            (f.ordinal, f.name, f.table, f.column, f.type, f.required, list(f.enum_values), list(f.aliases),
             f.description, f.transform, f.is_link)
            for f in FIELDS.values()
        ],
        "ordinal int, name string, target_table string, target_column string, type string, required boolean, "
        "enum_values array<string>, aliases array<string>, description string, transform string, is_link boolean",
    )


def pool_frame(spark: SparkSession) -> DataFrame:
    """(pool, field) rows, so that columns meet their candidates in an equi-join."""
    rows = [(kind, f.ordinal, f.name, f.type) for kind in (*TABLES_BY_KIND, "any")
            for f in candidate_pool(kind)]
    return spark.createDataFrame(rows, "pool string, ordinal int, canonical_field string, type string")


def table_schema(table: str) -> list[tuple[str, str]]:
    """(column, Spark type) of a canonical table, in storage order."""
    mapped = [(f.column, f.spark_type) for f in fields_of(table) if not f.is_link]
    if table == "accounts":
        return [("id", "string"), ("tenant_id", "string"), ("customer_id", "string"), *mapped]
    audit = [("content_hash", "string"), ("source_batch_id", "string")]
    if table == "customers":
        columns = [(c, "timestamp" if c == "created_at" else t) for c, t in mapped]
        return [("id", "string"), ("tenant_id", "string"), *columns, ("updated_at", "timestamp"), *audit]
    return [("id", "string"), ("tenant_id", "string"), ("customer_id", "string"), *mapped,
            (MIRROR_OF_NATURAL_KEY[table], "string"), *audit]
