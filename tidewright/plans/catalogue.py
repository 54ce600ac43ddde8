"""The registered queries, each next to its SQL twin where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import registry
from tidewright.functions.parse import Cell, parse_cells
from tidewright.functions.text import explanation
from tidewright.operators import dedupe, evaluate, landing, link, load, mapping, metrics, profile, quarantine, validate
from tidewright.operators.joins import key_counts
from tidewright.operators.records import apply_spec, entry, hold
from tidewright.plans import drops, fixtures, oracle, oracle_mapping
from tidewright.plans.fixtures import CUSTOMER_SPEC, INVOICE_SPEC, LEDGER_COLUMNS, TICKET_SPEC, table
from tidewright.sources import delimited, pages
from tidewright.sources.state import State
from tidewright.session import reliable, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
AS_OF = date.fromisoformat(fixtures.AS_OF)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def joined_codes(errors: str = "errors"):
    return F.array_join(F.array_sort(F.array_distinct(F.col(f"{errors}.code"))), ",")


def annotated(spark: SparkSession, sf: str, extract: str, spec: dict) -> DataFrame:
    customers = fixtures.canonical_customers(spark, sf)
    return load.annotate(fixtures.raw(spark, sf, extract), spec, customers, AS_OF)


# --- parsers -------------------------------------------------------------

PADDED = ("case c_custkey % 4 when 0 then concat(chr(9), ' ', c_name, ' ', chr(160)) when 1 then '   ' "
          "when 2 then concat(c_name, chr(10)) else concat('  ', c_mktsegment) end")


@query("parse_trim", f"select c_custkey, {oracle.text(PADDED)} as value from customer")
def parse_trim(spark, sf):
    padded = table(spark, sf, "customer").selectExpr("c_custkey", f"{PADDED} as padded")
    return parse_cells(padded, {"p": Cell("trim", F.col("padded"))}).select("c_custkey", F.col("p_value").alias("value"))


def _parse(extract: str, column: str, function: str, allowed: tuple[str, ...] = ()) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = fixtures.flat(spark, sf, extract)
        out = parse_cells(rows, {"p": Cell(function, F.col(column), allowed)})
        return out.select("row_index", F.col("p_value").alias("value"), F.col("p_code").alias("error_code"))

    return run


for _name, _args in {
    "parse_date": ("invoices", "issue_date", "parse_date"),
    "parse_int": ("customers", "employee_count", "to_int"),
    "parse_money": ("invoices", "amount", "to_minor_units"),
    "parse_enum": ("invoices", "status", "map_enum", registry.field("invoice_status").enum_values),
}.items():
    query(_name, oracle.parsed_query(*_args))(_parse(*_args))


# --- delimited files -----------------------------------------------------

@query("delimited_rows", drops.expected_sql())
def delimited_rows(spark, sf):
    """The extract, written as files of five layouts and read back from byte ranges."""
    folder = drops.write_drop(spark, sf)
    staged = reliable(delimited.read_folder(spark, folder, range_bytes=1 << 18))
    return drops.drop_rows(spark, sf, delimited.with_row_index(staged))


@query("delimited_files", f"select kind, encoding, delimiter, 'row_no/invoice_number/customer_id/amount/status/note' as header, count(*) as rows "
       f"from ({drops.expected_sql()}) group by all union all "
       f"select 'empty', 'UTF-8', ',', 'row_no/invoice_number/customer_id/amount/status/note', 0")
def delimited_files(spark, sf):
    """What the files of that folder are found to be; a file with a header only counts too."""
    folder = drops.write_drop(spark, sf)
    some = delimited.read_ranges(spark, folder, range_bytes=1 << 16)
    counts = delimited.read_rows(some, folder).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
    files = some.select("path", "encoding", "delimiter").distinct().join(delimited.read_headers(some, folder), "path").join(counts, "path", "left")
    return files.groupBy(drops.kind_of(F.col("path")).alias("kind"), "encoding", "delimiter", F.array_join("header", "/").alias("header")).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


# --- records, validation, linking ---------------------------------------

INVOICES_CHECKED = {**oracle.CUSTOMERS, **oracle.checked("invoices", INVOICE_SPEC)}
TICKETS_CHECKED = {**oracle.CUSTOMERS, **oracle.checked("tickets", TICKET_SPEC)}
CUSTOMERS_CHECKED = {**oracle.CUSTOMERS, **oracle.checked("customers", CUSTOMER_SPEC)}
BY_CODE = ("select split_part(e, ': ', 2) as error_code, count(*) as rows "
           "from (select unnest(errs) as e from checked) group by 1")


@query("error_code_counts", oracle.with_clause(INVOICES_CHECKED) + BY_CODE)
def error_code_counts(spark, sf):
    found = annotated(spark, sf, "invoices", INVOICE_SPEC).select(F.explode("errors").alias("e"))
    return found.groupBy(F.col("e.code").alias("error_code")).agg(F.count(F.lit(1)).alias("rows"))


@query("customer_error_counts", oracle.with_clause(CUSTOMERS_CHECKED) + BY_CODE)
def customer_error_counts(spark, sf):
    found = annotated(spark, sf, "customers", CUSTOMER_SPEC).select(F.explode("errors").alias("e"))
    return found.groupBy(F.col("e.code").alias("error_code")).agg(F.count(F.lit(1)).alias("rows"))


@query("built_tickets", oracle.with_clause(TICKETS_CHECKED) +
       "select batch_id, row_index, v_ticket_natural_key as natural_key, v_ticket_subject as subject, "
       "v_ticket_priority as priority, v_ticket_status as status, v_ticket_opened_at as opened_at, "
       "v_ticket_closed_at as closed_at, v_ticket_customer_natural_key as customer_key from checked")
def built_tickets(spark, sf):
    built = apply_spec(fixtures.raw(spark, sf, "tickets"), TICKET_SPEC)
    return built.select("batch_id", "row_index", "rec.support_tickets.*", F.col("link.support_tickets").alias("customer_key"))


@query("missing_required", oracle.with_clause(INVOICES_CHECKED) +
       "select split_part(e, ': ', 1) as field, count(*) as rows from (select unnest(errs) as e from checked) "
       "where e like '%: MISSING_REQUIRED' group by 1")
def missing_required(spark, sf):
    built = hold(apply_spec(fixtures.raw(spark, sf, "invoices"), INVOICE_SPEC), "errors")
    missing = built.select(F.explode("errors").alias("e")).where(F.col("e.code") == "MISSING_REQUIRED")
    return missing.groupBy(F.col("e.field").alias("field")).agg(F.count(F.lit(1)).alias("rows"))


@query("business_rules", oracle.with_clause(INVOICES_CHECKED) +
       "select row_index, split_part(e, ': ', 1) as field, split_part(e, ': ', 2) as code "
       "from (select row_index, unnest(errs) as e from checked) where e like '%BUSINESS_RULE%'")
def business_rules(spark, sf):
    built = apply_spec(fixtures.raw(spark, sf, "invoices"), INVOICE_SPEC)
    columns = load.mapped_columns(INVOICE_SPEC, "invoices")
    broken = built.withColumn("broken", validate.business_rules(F.col("rec.invoices"), columns, F.lit(AS_OF)))
    return hold(broken, "broken").select("row_index", F.explode("broken").alias("e")).select("row_index", "e.field", "e.code")


# parsers that do not fit their fields: text for a date, a number for a text
MISFIT_SPEC = {**INVOICE_SPEC, "invoice_issue_date": entry("issue_date", "trim"), "invoice_po_number": entry("row_no", "to_int")}


@query("schema_mismatch", oracle.with_clause({**oracle.CUSTOMERS, **oracle.checked(
    "invoices", MISFIT_SPEC, source=f"select *, cast(row_index as varchar) as row_no from ({fixtures.flat_sql('invoices')})")}) + BY_CODE)
def schema_mismatch(spark, sf):
    raw = fixtures.raw(spark, sf, "invoices")
    number = F.create_map(F.lit("row_no"), F.col("row_index").cast("string"))
    raw = raw.withColumn("raw", F.map_concat("raw", number))
    found = load.annotate(raw, MISFIT_SPEC, fixtures.canonical_customers(spark, sf), AS_OF)
    return found.select(F.explode("errors").alias("e")).groupBy(F.col("e.code").alias("error_code")).agg(F.count(F.lit(1)).alias("rows"))


@query("duplicate_exact", oracle.with_clause(TICKETS_CHECKED) +
       "select batch_id, row_index, v_ticket_natural_key as natural_key from checked "
       "where list_contains(errs, 'natural_key: DUPLICATE_EXACT')")
def duplicate_exact(spark, sf):
    built = validate.check_records(apply_spec(fixtures.raw(spark, sf, "tickets"), TICKET_SPEC), TICKET_SPEC, AS_OF)
    flagged = validate.flag_duplicates(built, TICKET_SPEC)
    return flagged.where(F.array_contains("errors.code", "DUPLICATE_EXACT")).select(
        "batch_id", "row_index", F.col("rec.support_tickets.natural_key").alias("natural_key"))


@query("link_resolution", oracle.with_clause(INVOICES_CHECKED) +
       "select tenant_id, link_key, count(*) as rows, min(resolved_id) as customer_id, min(match) as match "
       "from checked where link_key is not null group by 1, 2")
def link_resolution(spark, sf):
    built = apply_spec(fixtures.raw(spark, sf, "invoices"), INVOICE_SPEC).withColumn("link_key", link.effective_key(INVOICE_SPEC))
    keys = key_counts(built, ["tenant_id", "link_key"], "rows")
    return link.resolve_keys(keys, fixtures.canonical_customers(spark, sf)).select(
        "tenant_id", "link_key", "rows", "customer_id", "match")


@query("linked_invoices", oracle.with_clause(INVOICES_CHECKED) +
       "select batch_id, row_index, link_key, resolved_id as customer_id from checked")
def linked_invoices(spark, sf):
    return annotated(spark, sf, "invoices", INVOICE_SPEC).select("batch_id", "row_index", "link_key", "customer_id")


@query("orphan_keys", oracle.with_clause(INVOICES_CHECKED) +
       "select tenant_id, link_key, count(*) as rows from checked "
       "where list_contains(errs, 'customer_id: REF_INTEGRITY_ORPHAN_FK') group by 1, 2")
def orphan_keys(spark, sf):
    found = annotated(spark, sf, "invoices", INVOICE_SPEC)
    orphan = F.array_contains("errors.code", "REF_INTEGRITY_ORPHAN_FK")
    return found.where(orphan).groupBy("tenant_id", "link_key").agg(F.count(F.lit(1)).alias("rows"))


MANGLED = "natural_key[1:2 + (natural_key[3:]::bigint % 4)] || natural_key[4 + (natural_key[3:]::bigint % 4):]"


@query("suggested_fixes", oracle.with_clause({
    **oracle.CUSTOMERS, "orphans": f"select tenant_id, {MANGLED} as link_key from customers",
    **oracle_mapping.nearest_ctes("orphans", "customers", link.SUGGEST_AT)}) +
       "select tenant_id, link_key, natural_key, round(score, 4) as score, suggested_fix from nearest")
def suggested_fixes(spark, sf):
    """Every customer key with one digit left out, matched back to the customers."""
    customers = fixtures.canonical_customers(spark, sf)
    cut = 3 + (F.substring("natural_key", 3, 20).cast("bigint") % 4).cast("int")
    mangled = F.concat(F.substring("natural_key", F.lit(1), cut - 1), F.col("natural_key").substr(cut + 1, F.lit(20)))
    return link.suggest_customer_fix(customers.select("tenant_id", mangled.alias("link_key")), customers)


@query("quarantine_entries", oracle.with_clause(INVOICES_CHECKED) +
       f"select batch_id, row_index, {oracle.CODES} as error_codes, array_to_string(errs, '; ') as explanation, "
       "'open' as status, 'error' as severity from checked where len(errs) > 0")
def quarantine_entries(spark, sf):
    bad = load.rejected(annotated(spark, sf, "invoices", INVOICE_SPEC))
    return bad.select("batch_id", "row_index", joined_codes().alias("error_codes"),
                      explanation(F.col("errors")).alias("explanation"),
                      F.lit("open").alias("status"), F.lit("error").alias("severity"))


@query("quarantine_with_fixes", oracle.with_clause({
    **INVOICES_CHECKED, "orphans": "select distinct tenant_id, link_key from checked where list_contains(errs, 'customer_id: REF_INTEGRITY_ORPHAN_FK')",
    **oracle_mapping.nearest_ctes("orphans", "customers", link.SUGGEST_AT)}) +
       f"select {fixtures.id_sql('batch_id', 'row_index::varchar')} as id, batch_id, row_index, {oracle.CODES} as error_codes, array_to_string(errs, '; ') as explanation, "
       "suggested_fix, 'open' as status from checked left join nearest n on n.tenant_id = checked.tenant_id and n.link_key = checked.link_key "
       "and list_contains(errs, 'customer_id: REF_INTEGRITY_ORPHAN_FK') where len(errs) > 0")
def quarantine_with_fixes(spark, sf):
    rows = reliable(annotated(spark, sf, "invoices", INVOICE_SPEC))
    entries = load.quarantine_rows(rows, fixtures.canonical_customers(spark, sf))
    return entries.select("id", "batch_id", "row_index", F.array_join("error_codes", ",").alias("error_codes"),
                          "explanation", "suggested_fix", "status")


@query("load_summary", oracle.with_clause(INVOICES_CHECKED) +
       "select batch_id, 1 as mapping_spec_version, count(*) as total_rows, count(*) filter (len(errs) = 0) as loaded, "
       "count(*) filter (len(errs) > 0) as quarantined from checked group by 1")
def load_summary(spark, sf):
    return load.load_summary(annotated(spark, sf, "invoices", INVOICE_SPEC), 1)


@query("error_groups", oracle.with_clause(TICKETS_CHECKED) +
       "select c as error_code, count(*) as rows from (select unnest(list_distinct([split_part(x, ': ', 2) for x in errs])) as c "
       "from checked) group by 1")
def error_groups(spark, sf):
    bad = load.rejected(annotated(spark, sf, "tickets", TICKET_SPEC))
    return quarantine.error_groups(bad.select(F.array_distinct("errors.code").alias("error_codes")))


# --- loading --------------------------------------------------------------



def loaded_at():
    return F.lit("2000-06-01 00:00:00").cast("timestamp")


def customer_rows(spark, sf, generation: int) -> DataFrame:
    """Customer rows of two deliveries: the first lacks a region, the second has
    all of them, every tenth with another industry."""
    rows = fixtures.flat(spark, sf, "customers")
    if generation == 1:
        rows = rows.where(F.col("region") != "BUILDING")
    else:
        rows = rows.withColumn("industry", F.when(F.col("row_index") % 20 == 0, "other").otherwise(F.col("industry")))
    kept = ["customer_id", "company_name", "email", "industry"]
    cells = F.create_map(*[x for c in kept for x in (F.lit(c), F.col(c))])
    return rows.select(*LEDGER_COLUMNS, cells.alias("raw"))


SHORT_SPEC = {n: e for n, e in CUSTOMER_SPEC.items()
              if n in ("customer_natural_key", "legal_name", "customer_email", "industry")}


def load_customers(spark, sf, generation, current):
    rows = apply_spec(customer_rows(spark, sf, generation), SHORT_SPEC)
    incoming = load.incoming_records(rows.withColumn("customer_id", F.lit(None)), SHORT_SPEC, "customers").drop("row_index")
    return load.upsert_plan(current, incoming, "customers", load.mapped_columns(SHORT_SPEC, "customers"), loaded_at())


CUSTOMER_GENERATIONS = {
    "raw": fixtures.flat_sql("customers"),
    "g1": "select * from raw where region <> 'BUILDING'",
    "g2": "select * exclude (industry), case when row_index % 20 = 0 then 'other' else industry end as industry from raw",
}


@query("upsert_customers", oracle.with_clause(CUSTOMER_GENERATIONS) +
       "select g2.tenant_id, g2.customer_id as natural_key, g2.company_name as legal_name, nullif(g2.email, '') as email, "
       "g2.industry, 'pending' as kyc_status, case when g1.customer_id is null then 'insert' "
       "when g1.industry <> g2.industry then 'update' else 'noop' end as action "
       "from g2 left join g1 using (tenant_id, customer_id)")
def upsert_customers(spark, sf):
    first = load_customers(spark, sf, 1, load.empty_table(spark, "customers")).drop("_action")
    return load_customers(spark, sf, 2, first).select(
        "tenant_id", "natural_key", "legal_name", "email", "industry", "kyc_status", F.col("_action").alias("action"))


@query("rerun_is_noop", oracle.with_clause(CUSTOMER_GENERATIONS) + "select 'noop' as action, count(*) as rows from g2")
def rerun_is_noop(spark, sf):
    once = load_customers(spark, sf, 2, load.empty_table(spark, "customers")).drop("_action")
    again = load_customers(spark, sf, 2, once)
    return again.groupBy(F.col("_action").alias("action")).agg(F.count(F.lit(1)).alias("rows"))


CLEAN = {**INVOICES_CHECKED, "clean": "select * from checked where len(errs) = 0"}


def clean_invoices(spark, sf):
    return load.accepted(reliable(annotated(spark, sf, "invoices", INVOICE_SPEC)))


@query("upsert_invoices", oracle.with_clause(CLEAN) +
       "select tenant_id, v_invoice_natural_key as natural_key, v_invoice_natural_key as invoice_number, resolved_id as customer_id, "
       "v_invoice_amount_minor_units as amount_minor_units, v_invoice_currency as currency, v_invoice_issue_date as issue_date, "
       "coalesce(v_invoice_status, 'open') as status, 'insert' as action from clean")
def upsert_invoices(spark, sf):
    incoming = load.incoming_records(clean_invoices(spark, sf), INVOICE_SPEC, "invoices").drop("row_index")
    planned = load.upsert_plan(load.empty_table(spark, "invoices"), incoming, "invoices",
                               load.mapped_columns(INVOICE_SPEC, "invoices"), loaded_at())
    return planned.select("tenant_id", "natural_key", "invoice_number", "customer_id", "amount_minor_units", "currency",
                          "issue_date", "status", F.col("_action").alias("action"))


@query("upsert_accounts", oracle.with_clause(CLEAN) +
       "select tenant_id, v_account_number as account_number, arg_max(resolved_id, row_index) as customer_id, 'insert' as action "
       "from clean where v_account_number is not null group by 1, 2")
def upsert_accounts(spark, sf):
    incoming = load.incoming_accounts(clean_invoices(spark, sf), INVOICE_SPEC)
    planned = load.upsert_plan(load.empty_table(spark, "accounts"), incoming, "accounts",
                               load.mapped_columns(INVOICE_SPEC, "accounts"))
    return planned.select("tenant_id", "account_number", "customer_id", F.col("_action").alias("action"))


# Two deliveries of one extract, committed to state tables tenant by tenant: the first has the even rows; the second lacks
# every third row, changes every tenth, and brings nothing for the first tenant, whose rows stay where they are.

FIRST, SECOND, LATE = "row_index % 2 = 0", "row_index % 3 <> 1 and tenant_id <> 'tenant-0'", "row_index % 10 = 0"


def delivered(clean: DataFrame, generation: int, changed: str) -> DataFrame:
    """Clean rows of a delivery, named after it; `changed` is the field of `rec` that differs in the second."""
    rows = clean.where(F.expr(FIRST if generation == 1 else SECOND)).withColumn("batch_id", F.concat(F.lit(f"g{generation}-"), "batch_id"))
    if generation == 1:
        return rows
    later = F.when(F.expr(LATE), F.concat(F.col(f"rec.{changed}"), F.lit(" (2)"))).otherwise(F.col(f"rec.{changed}"))
    return rows.withColumn("rec", F.col("rec").withField(changed, later))


def two_commits(spark, sf, extract: str, spec: dict, name: str, changed: str) -> DataFrame:
    clean = load.accepted(reliable(annotated(spark, sf, extract, spec)))
    state = State(spark, f"{shared_folder(spark).rstrip('/')}/state-{uuid.uuid4().hex}", {name: ", ".join(f"{c} {k}" for c, k in registry.table_schema(name))})
    for generation in (1, 2):
        rows = delivered(clean, generation, changed)
        tenants = [r["tenant_id"] for r in rows.select("tenant_id").distinct().collect()]
        after = load.next_tables(rows, spec, {t: state.read(t, tenants) if t == name else load.empty_table(spark, t) for t in load.tables_of(spec)}, loaded_at())
        state.commit({name: after[name]}, tenants)
    return state.read(name)


def two_commits_sql(fields: dict[str, str], key: str, changed: str) -> str:
    """The table after both deliveries: rows that did not change keep the batch that brought them."""
    shown = ", ".join(f"{value} as {name}" for name, value in fields.items())
    return (f", g1 as (select * from clean where {FIRST}), g2 as (select * from clean where {SECOND}) "
            f"select tenant_id, {key} as natural_key, {shown}, {changed} || case when {SECOND} and {LATE} then ' (2)' else '' end as changed, "
            f"case when {SECOND} and ({LATE} or not {FIRST}) then 'g2-' else 'g1-' end || batch_id as source_batch_id "
            f"from clean where {FIRST} or {SECOND}")


TICKETS_CLEAN = {**TICKETS_CHECKED, "clean": "select * from checked where len(errs) = 0"}


@query("merged_invoices", oracle.with_clause(CLEAN) + two_commits_sql(
    {"invoice_number": "v_invoice_natural_key", "customer_id": "resolved_id", "amount_minor_units": "v_invoice_amount_minor_units"},
    "v_invoice_natural_key", "v_invoice_po_number"))
def merged_invoices(spark, sf):
    return two_commits(spark, sf, "invoices", INVOICE_SPEC, "invoices", "invoices.po_number").select(
        "tenant_id", "natural_key", "invoice_number", "customer_id", "amount_minor_units", F.col("po_number").alias("changed"), "source_batch_id")


@query("merged_tickets", oracle.with_clause(TICKETS_CLEAN) + two_commits_sql(
    {"ticket_ref": "v_ticket_natural_key", "customer_id": "resolved_id", "status": "coalesce(v_ticket_status, 'open')"},
    "v_ticket_natural_key", "v_ticket_subject"))
def merged_tickets(spark, sf):
    return two_commits(spark, sf, "tickets", TICKET_SPEC, "support_tickets", "support_tickets.subject").select(
        "tenant_id", "natural_key", "ticket_ref", "customer_id", "status", F.col("subject").alias("changed"), "source_batch_id")


@query("merged_accounts", oracle.with_clause(CLEAN) +
       f", d as (select *, 1 as g from clean where {FIRST} union all select *, 2 as g from clean where {SECOND}), "
       f"last as (select tenant_id, v_account_number as account_number, g, arg_max(resolved_id, row_index) as customer_id from d "
       f"where v_account_number is not null group by all) "
       f"select tenant_id, account_number, arg_max(customer_id, g) as customer_id from last group by all")
def merged_accounts(spark, sf):
    return two_commits(spark, sf, "invoices", INVOICE_SPEC, "accounts", "invoices.po_number").select("tenant_id", "account_number", "customer_id")


@query("schema_backfill",
       "select coalesce(kyc_status, 'pending') as kyc_status, count(*) as rows from ("
       "select null as kyc_status from customer union all select case s_suppkey % 3 when 0 then 'verified' when 1 then 'rejected' end from supplier"
       ") group by 1")
def schema_backfill(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    status = F.when(F.col("s_suppkey") % 3 == 0, "verified").when(F.col("s_suppkey") % 3 == 1, "rejected")
    new = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), status.alias("kyc_status"))
    merged = load.append_evolved(old, new, {"kyc_status": F.lit("pending")})
    return merged.groupBy("kyc_status").agg(F.count(F.lit(1)).alias("rows"))


# --- quarantine -------------------------------------------------------------

def ticket_quarantine(spark, sf):
    bad = load.rejected(annotated(spark, sf, "tickets", TICKET_SPEC))
    return bad.select("tenant_id", "batch_id", "row_index", "raw", F.array_sort(F.array_distinct("errors.code")).alias("error_codes"),
                      F.lit("error").alias("severity"), explanation(F.col("errors")).alias("explanation"),
                      F.lit(None).cast("string").alias("suggested_fix"), F.lit("open").alias("status"),
                      F.concat_ws("-", "batch_id", "row_index").alias("id"))


@query("quarantine_list", oracle.with_clause(TICKETS_CHECKED) +
       f"select batch_id, row_index, {oracle.CODES} as error_codes, array_to_string(errs, '; ') as explanation from checked "
       "where len(errs) > 0 and tenant_id = 'tenant-0'")
def quarantine_list(spark, sf):
    listed = quarantine.list_quarantine(ticket_quarantine(spark, sf), "tenant-0")
    return listed.select("batch_id", "row_index", F.array_join("error_codes", ",").alias("error_codes"), "explanation")


@query("quarantine_ignore", oracle.with_clause(TICKETS_CHECKED) +
       "select case when list_contains(errs, 'ticket_customer_natural_key: MISSING_REQUIRED') then 'ignored' else 'open' end as status, "
       "count(*) as rows from checked where len(errs) > 0 group by 1")
def quarantine_ignore(spark, sf):
    after = quarantine.ignore(ticket_quarantine(spark, sf), F.array_contains("error_codes", "MISSING_REQUIRED"))
    return after.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


FIXED_TICKETS = fixtures.flat_sql("tickets")
BULK = {
    **TICKETS_CHECKED,
    "chosen": "select row_index from checked where tenant_id = 'tenant-0' and "
    "list_contains([split_part(x, ': ', 2) for x in errs], 'ENUM_INVALID')",
    **oracle.checked("tickets", TICKET_SPEC, "again", source="select r.* exclude (status), 'closed' as status from "
                     f"({FIXED_TICKETS}) r join chosen using (row_index)", duplicates=False),
}


@query("bulk_resolve", oracle.with_clause(BULK) +
       "select count(*) as processed, count(*) filter (len(errs) = 0) as loaded, count(*) filter (len(errs) > 0) as still_open from again")
def bulk_resolve(spark, sf):
    """Tickets with an unknown status, all corrected to `closed` at once."""
    customers = fixtures.canonical_customers(spark, sf)
    entries = reliable(ticket_quarantine(spark, sf))
    chosen = quarantine.with_code(entries, "tenant-0", "ENUM_INVALID")
    again = reliable(quarantine.reprocess(chosen, TICKET_SPEC, customers, {"status": "closed"}, AS_OF))
    return quarantine.bulk_counts(quarantine.resolved_quarantine(entries, again, customers), chosen)


# --- profiling ---------------------------------------------------------------

STATISTICS = ("column_name", "row_count", "null_count", "null_fraction", "distinct_count", "distinct_fraction", "sample_values",
              *[f"{n}_fraction" for n in profile.FRACTIONS])


def shown(profiles: DataFrame) -> DataFrame:
    out = profiles.withColumn("sample_values", F.array_join("sample_values", " | "))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("_fraction") else F.col(c) for c in STATISTICS])


def _profile(extract: str) -> Query:
    return lambda spark, sf: shown(profile.profile(profile.cells_of_raw(fixtures.raw(spark, sf, extract))))


def _cells(extract: str) -> str:
    columns = [c for c in fixtures.COLUMNS[extract](fixtures.DUCK) if c not in LEDGER_COLUMNS]
    return oracle.with_clause({"raw": fixtures.flat_sql(extract), "cells": oracle.cells_sql("from raw", columns)}) + \
        oracle.profile_sql("cells")


for _extract in fixtures.COLUMNS:
    query(f"profile_{_extract}", _cells(_extract))(_profile(_extract))

DOCUMENT_COLUMNS = ["text", "lang", "source", "n_chars"]


@query("profile_documents", oracle.with_clause({"cells": oracle.cells_sql("from documents", DOCUMENT_COLUMNS)}) + oracle.profile_sql("cells"))
def profile_documents(spark, sf):
    return shown(profile.profile(profile.cells_of_table(table(spark, sf, "documents"), DOCUMENT_COLUMNS)))


@query("profile_by_batch", oracle.with_clause({
    "raw": fixtures.flat_sql("customers"),
    "cells": " union all ".join(f"select batch_id, '{c}' as column_name, {c} as value from raw" for c in ("email", "country", "kyc_status")),
}) + "select batch_id, column_name, count(*) as row_count, count(distinct value) as distinct_count from cells group by 1, 2")
def profile_by_batch(spark, sf):
    raw = fixtures.raw(spark, sf, "customers")
    picked = raw.withColumn("raw", F.map_filter("raw", lambda k, v: k.isin("email", "country", "kyc_status")))
    return profile.profile_raw(picked).select("batch_id", "column_name", "row_count", "distinct_count")


@query("profile_merged", oracle.with_clause({"cells": oracle.cells_sql("from events", ["event_type", "user_id", "ts", "value", "props"])}) + oracle.profile_sql("cells"))
def profile_merged(spark, sf):
    """The profile of all events from the stored states of three batches of them, merged in two steps."""
    cells = profile.cells_of_table(table(spark, sf, "events").select("*", (F.col("event_id") % 3).alias("batch")), ["event_type", "user_id", "ts", "value", "props"], ["batch"])
    numbers, hashes = (reliable(df) for df in profile.states(cells, ["batch"]))
    early = profile.merge_states(numbers.where("batch < 2"), hashes.where("batch < 2"))
    late = profile.merge_states(numbers.where("batch = 2"), hashes.where("batch = 2"))
    merged = profile.merge_states(early[0].unionByName(late[0]), early[1].unionByName(late[1]))
    return shown(profile.profile_of_states(*merged))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("numeric_report", " union all ".join(
    f"select '{c}' as column_name, count(*) as rows, count(*) - count({c}) as missing, count(*) filter ({c} = 0) as zeros, "
    f"count(*) filter ({c} < 0) as negative, min({c})::double as minimum, max({c})::double as maximum, round(avg({c}), 4) as mean, "
    f"round(stddev_samp({c}), 4) as std, " + ", ".join(f"quantile_disc({c}, {q})::double as p{int(q * 100):02d}" for q in profile.QUANTILES) +
    " from lineitem" for c in NUMERIC))
def numeric_report(spark, sf):
    report = profile.numeric_report(table(spark, sf, "lineitem"), NUMERIC)
    return report.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("histogram", " union all ".join(
    f"select '{c}' as column_name, bin, round(lo + bin * w, 4) as lower, round(lo + (bin + 1) * w, 4) as upper, count(*) as rows from ("
    f"select lo, w, cast(least(floor(({c} - lo) / w), 9) as int) as bin from lineitem, "
    f"(select min({c})::double as lo, (max({c})::double - min({c})::double) / 10 as w from lineitem)) group by lo, w, bin" for c in NUMERIC))
def histogram(spark, sf):
    return profile.histogram(table(spark, sf, "lineitem"), NUMERIC)


@query("top_values", "select column_name, rank, value, rows from (select *, row_number() over (partition by column_name order by rows desc, value) as rank "
       "from (select column_name, value, count(*) as rows from (" +
       oracle.cells_sql("from orders", ["o_orderstatus", "o_orderpriority", "o_custkey"]) + ") group by 1, 2)) where rank <= 10")
def top_values(spark, sf):
    return profile.top_values(profile.cells_of_table(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]))


# --- landing -------------------------------------------------------------------

def event_rows(spark, sf):
    """Events as landed payloads: one per event type, cells as text."""
    events = table(spark, sf, "events")
    cells = {"event_id": F.col("event_id").cast("string"), "props": F.col("props"), "user": F.col("user_id").cast("string")}
    return events.select(F.col("event_type").alias("tenant_id"), F.col("event_id").alias("row_index"),
                         F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), v)]).alias("raw"))


ROW_JSON = ("concat('{{\"lang\":', to_json({0}lang), ',\"n_chars\":', to_json(cast({0}n_chars as varchar)), ',\"source\":', "
            "to_json({0}source), ',\"text\":', to_json({0}text), '}}')").format("")


@query("row_hashes", f"select doc_id, sha256({ROW_JSON}) as content_hash from documents")
def row_hashes(spark, sf):
    docs = table(spark, sf, "documents")
    cells = F.create_map(*[x for c in ("text", "lang", "source", "n_chars") for x in (F.lit(c), F.col(c).cast("string"))])
    return docs.select("doc_id", landing.row_hash(cells).alias("content_hash"))


EVENT_JSON = ("concat('{\"event_id\":\"', event_id, '\",\"props\":', to_json(props), ',\"user\":\"', user_id, '\"}')")
FINGERPRINTS = {
    "h": f"select event_type, sha256(concat(event_id, '|', sha256({EVENT_JSON}))) as h from events",
    "payloads": "select event_type as tenant_id, sha256(concat_ws('|', count(*)::varchar, " + ", ".join(
        f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::bigint)::varchar" for i in range(4)) + ")) as file_hash, count(*) as row_count from h group by 1",
}


API, CRM, PAIR = "'api'", "'crm'", "'pair'"


@query("payload_fingerprints", oracle.with_clause(FINGERPRINTS) + "select * from payloads")
def payload_fingerprints(spark, sf):
    return landing.payload_fingerprints(event_rows(spark, sf), ["tenant_id"])


@query("batch_replay", oracle.with_clause(FINGERPRINTS) +
       f"select tenant_id, case when tenant_id < 'n' then 'b-' || tenant_id else {fixtures.id_sql('tenant_id', API, 'file_hash')} end as batch_id, "
       "tenant_id < 'n' as is_replay, row_count from payloads")
def batch_replay(spark, sf):
    incoming = landing.payload_fingerprints(event_rows(spark, sf), ["tenant_id"]).withColumn("source_id", F.lit("api"))
    ledger = incoming.where(F.col("tenant_id") < "n").select(
        F.concat(F.lit("b-"), "tenant_id").alias("id"), "tenant_id", "source_id", "file_hash")
    return landing.replay_status(incoming, ledger).select("tenant_id", "batch_id", "is_replay", "row_count")


@query("new_batches", oracle.with_clause(FINGERPRINTS) +
       f"select {fixtures.id_sql('tenant_id', API, 'file_hash')} as id, tenant_id, 'queued' as status, row_count from payloads where tenant_id >= 'n'")
def new_batches(spark, sf):
    incoming = landing.payload_fingerprints(event_rows(spark, sf), ["tenant_id"]).withColumn("source_id", F.lit("api"))
    ledger = incoming.where(F.col("tenant_id") < "n").select(
        F.concat(F.lit("b-"), "tenant_id").alias("id"), "tenant_id", "source_id", "file_hash")
    return landing.new_batches(landing.replay_status(incoming, ledger)).select("id", "tenant_id", "status", "row_count")


@query("register_sources",
       f"select {fixtures.id_sql('lang', 'source', CRM)} as id, lang as tenant_id, source as name, 'crm' as kind from (select distinct lang, source from documents)")
def register_sources(spark, sf):
    seen = table(spark, sf, "documents").select(F.col("lang").alias("tenant_id"), F.col("source").alias("name"), F.lit("crm").alias("kind"))
    empty = spark.createDataFrame([], "id string, tenant_id string, name string, kind string")
    known = landing.register_sources(empty, seen.where(F.col("tenant_id") > "e"))
    return landing.register_sources(known, seen)


REQUESTS = ("select event_id, cast(user_id as varchar) as tenant_id, event_type as endpoint, "
            "case when event_id % 6 = 5 then null else cast(event_id % 40 as varchar) end as key, cast(event_id % 9 as varchar) as fingerprint from events")


@query("request_ledger", oracle.with_clause({
    "req": REQUESTS,
    "led": "select tenant_id, endpoint, key, arg_min(fingerprint, event_id) as was, min(event_id) as first from req where key is not null group by 1, 2, 3",
}) + "select event_id, case when req.key is null or led.first is null then 'new' when req.fingerprint = led.was then 'replay' else 'conflict' end as status, "
    "case when req.fingerprint = led.was then 'stored-' || led.first end as result from req left join led using (tenant_id, endpoint, key)")
def request_ledger(spark, sf):
    events = table(spark, sf, "events")
    requests = events.select(
        "event_id", F.col("user_id").cast("string").alias("tenant_id"), F.col("event_type").alias("endpoint"),
        F.when(F.col("event_id") % 6 != 5, (F.col("event_id") % 40).cast("string")).alias("key"),
        (F.col("event_id") % 9).cast("string").alias("fingerprint"))
    ledger = requests.where(F.col("key").isNotNull()).groupBy("tenant_id", "endpoint", "key").agg(
        F.min_by("fingerprint", "event_id").alias("fingerprint"), F.concat(F.lit("stored-"), F.min("event_id")).alias("result"))
    return landing.request_outcomes(requests, ledger).select("event_id", "status", "result")


def conversation_pages(spark, sf):
    """Conversations as pulls of pages of four turns, one JSON document a page."""
    turns = table(spark, sf, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"), F.count(F.lit(1)).alias("total"))
    item = F.struct("turn", F.struct(F.col("role"), F.col("text")).alias("item"))
    paged = turns.join(last, "conv_id").withColumn("page", F.floor(F.col("turn") / 4) + 1)
    grouped = paged.groupBy("conv_id", "page", "total", "last").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    document = F.to_json(F.struct(
        F.col("turns.item").alias("items"), "page", F.lit(4).alias("page_size"), "total",
        (F.col("page") < F.floor(F.col("last") / 4) + 1).alias("has_next")))
    return grouped.select("conv_id", document.alias("document"))


@query("json_page_items", "select conv_id, turn as row_index, role, text from conversations")
def json_page_items(spark, sf):
    parsed = pages.parse_pages(conversation_pages(spark, sf), "document", ["conv_id"])
    return pages.page_items(parsed, ["conv_id"]).select(
        "conv_id", "row_index", F.col("raw")["role"].alias("role"), F.col("raw")["text"].alias("text"))


@query("json_page_completeness", "select conv_id, count(distinct turn // 4) as page_count, count(*) as item_count, "
       "count(distinct turn // 4) = max(turn) // 4 + 1 as complete from conversations group by 1")
def json_page_completeness(spark, sf):
    parsed = pages.parse_pages(conversation_pages(spark, sf), "document", ["conv_id"])
    return pages.completeness(parsed, ["conv_id"])


# --- mapping -----------------------------------------------------------------

KINDS = {"customers": "crm", "invoices": "billing", "tickets": "support"}


def all_profiles(spark, sf) -> DataFrame:
    """Profiles of the three extracts, as columns of three source kinds."""
    parts = [
        profile.profile(profile.cells_of_raw(fixtures.raw(spark, sf, e))).withColumn("source_kind", F.lit(kind))
        for e, kind in KINDS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


BY_KIND = ["source_kind"]
POOLS = ", ".join(
    f"('{kind}', {f.ordinal}, '{f.name}', '{f.type}')" for kind in registry.TABLES_BY_KIND for f in registry.candidate_pool(kind))
PROFILES = {
    f"cells_{e}": oracle.cells_sql(f"{fixtures.flat_sql(e)}",
                                   [c for c in fixtures.COLUMNS[e](fixtures.DUCK) if c not in LEDGER_COLUMNS])
    for e in KINDS
}
PROFILES["profiles"] = " union all ".join(
    f"select '{kind}' as source_kind, * from ({oracle.profile_sql(f'cells_{e}')})" for e, kind in KINDS.items())


TYPE_SCORE = (
    "case type when 'email' then email_match_fraction "
    "when 'phone' then phone_match_fraction when 'date' then date_parse_fraction when 'integer' then int_parse_fraction "
    "when 'money_minor_units' then float_parse_fraction when 'currency_code' then currency_code_match_fraction "
    "when 'enum' then case when row_count = null_count then 0.5 else greatest(0, 1 - least(distinct_fraction, 1)) end else 0.5 end")
RANKED = {**PROFILES, **oracle_mapping.ranking_ctes("profiles", POOLS, TYPE_SCORE)}


@query("type_scores", oracle.with_clause(PROFILES) +
       f"select source_kind, column_name, field as canonical_field, round({TYPE_SCORE}, 4) as type_score "
       f"from profiles join (values {POOLS}) p(source_kind, ordinal, field, type) using (source_kind)")
def type_scores(spark, sf):
    candidates = mapping.with_candidates(all_profiles(spark, sf))
    return candidates.select("source_kind", "column_name", "canonical_field",
                             F.round(mapping.type_score(F.col("type")), 4).alias("type_score"))


@query("rank_candidates", oracle.with_clause(RANKED) +
       "select source_kind, column_name, rank, field as canonical_field, confidence, round(name_score, 4) as name_score, "
       "round(embedding_score, 4) as embedding_score, round(type_score, 4) as type_score from ranked")
def rank_candidates(spark, sf):
    return mapping.score_columns(reliable(all_profiles(spark, sf)), BY_KIND)


@query("baseline_ranking", oracle.with_clause(RANKED) +
       "select source_kind, column_name, rank, field as canonical_field, round(name_score, 4) as name_score from by_name")
def baseline_ranking(spark, sf):
    return mapping.baseline_ranking(all_profiles(spark, sf).select("source_kind", "column_name"), BY_KIND)


@query("column_mappings", oracle.with_clause(RANKED) + "select source_kind, column_name, best_field, confidence, bucket, candidates from mapped")
def column_mappings(spark, sf):
    ranked = mapping.score_columns(reliable(all_profiles(spark, sf)), BY_KIND)
    mapped = mapping.column_mappings(ranked, BY_KIND)
    return mapped.select(*BY_KIND, "column_name", "best_field", "confidence", "bucket", F.size("candidates").alias("candidates"))


@query("tiebreak_requests", oracle.with_clause({**RANKED, "lines": "select source_kind, string_agg('- ' || field || ': ' || text, chr(10) order by ordinal) as lines "
       f"from (values {POOLS}) p(source_kind, ordinal, field, type) join field_texts on key = field group by 1"}) +
       "select source_kind, column_name, 'Column: ' || column_name || chr(10) || 'Samples: ' || coalesce(nullif(replace(sample_values, ' | ', ', '), ''), 'none') "
       "|| chr(10) || 'Fields:' || chr(10) || lines as request from mapped join profiles using (source_kind, column_name) join lines using (source_kind) where bucket = 'unmapped'")
def tiebreak_requests(spark, sf):
    profiles = reliable(all_profiles(spark, sf))
    mapped = mapping.column_mappings(mapping.score_columns(profiles, BY_KIND), BY_KIND)
    return mapping.tiebreak_requests(mapped, profiles, BY_KIND)


TRUTH = [(KINDS[e], entry_["source_column"], name)
         for e, spec in (("customers", CUSTOMER_SPEC), ("invoices", INVOICE_SPEC), ("tickets", TICKET_SPEC))
         for name, entry_ in spec.items()]
PREDICTED = {
    **RANKED,
    "truth": f"select * from (values {oracle_mapping.truth_values(TRUTH)}) t(source_kind, column_name, truth)",
    "listed": "select source_kind, column_name, list(field order by rank) as ranked from ranked group by 1, 2",
    "named": "select source_kind, column_name, list(field order by rank) as ranked from by_name group by 1, 2",
    "answers": "select source_kind, column_name, 'UNKNOWN' as field from mapped where bucket = 'unmapped' and length(column_name) % 2 = 0",
    "predictions": "select 'name' as pass, source_kind, column_name, truth, ranked[1] as predicted, ranked from named left join truth using (source_kind, column_name) "
    "union all select 'combined', source_kind, column_name, truth, case when bucket <> 'unmapped' then ranked[1] end, ranked "
    "from listed join mapped using (source_kind, column_name) left join truth using (source_kind, column_name) "
    "union all select 'full', source_kind, column_name, truth, ranked[1], ranked "
    "from listed join mapped using (source_kind, column_name) left join truth using (source_kind, column_name)",
}


@query("benchmark_accuracy", oracle.with_clause(PREDICTED) + oracle_mapping.accuracy_sql("predictions"))
def benchmark_accuracy(spark, sf):
    """Name-only, combined and full-pass ranking of the extracts' columns against the specs that load them; columns no
    spec uses have no true field. In the full pass every other undecided column is answered UNKNOWN."""
    profiles = reliable(all_profiles(spark, sf))
    true = F.broadcast(spark.createDataFrame(TRUTH, "source_kind string, column_name string, truth string"))
    combined = mapping.score_columns(profiles, BY_KIND)
    mapped = reliable(mapping.column_mappings(combined, BY_KIND))
    named = mapping.baseline_ranking(profiles.select("source_kind", "column_name"), BY_KIND)
    best = evaluate.rankings(combined, BY_KIND, mapped)
    asked = mapped.where((F.col("bucket") == "unmapped") & (F.length("column_name") % 2 == 0)).select(*BY_KIND, "column_name", F.lit("UNKNOWN").alias("field"))
    passes = {"name": evaluate.rankings(named, BY_KIND), "combined": best, "full": evaluate.full_pass(best, asked, BY_KIND)}
    parts = [df.join(true, [*BY_KIND, "column_name"], "left").withColumn("pass", F.lit(n)) for n, df in passes.items()]
    return evaluate.mapping_accuracy(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["pass"])


# Parts stand for scored columns: one spec per brand, each part a column of it.
def part_mappings(spark, sf):
    names = F.array(*[F.lit(f.name) for f in registry.FIELDS.values()])
    confidence = F.round((F.col("p_partkey") % 100) / 100, 2)
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("tenant_id"), F.lit("any").alias("source_kind"),
        F.concat(F.lit("col_"), F.col("p_partkey")).alias("column_name"),
        F.get(names, F.pmod(F.col("p_partkey") * 7, F.lit(33)).cast("int")).alias("best_field"),
        confidence.alias("confidence"), mapping.bucket(confidence).alias("bucket"))


def part_decisions(spark, sf):
    names = F.array(*[F.lit(f.name) for f in registry.FIELDS.values()], F.lit("UNKNOWN"), F.lit("invented"))
    return table(spark, sf, "part").where(F.col("p_size") <= 25).select(
        F.col("p_brand").alias("tenant_id"), F.concat(F.lit("col_"), F.col("p_partkey")).alias("column_name"),
        F.get(names, F.pmod(F.col("p_partkey"), F.lit(35)).cast("int")).alias("field"), F.lit("table").alias("model"),
        F.lit(0.75).alias("confidence"), F.lit("by hand").alias("reasoning"))


FIELD_LIST = "[" + ", ".join(f"'{n}'" for n in registry.FIELDS) + ", 'UNKNOWN', 'invented']"
PART_ENTRIES = {
    "m": f"select p_brand as tenant_id, 'col_' || p_partkey as column_name, ({FIELD_LIST})[1 + (p_partkey * 7) % 33] as best, "
    f"round((p_partkey % 100) / 100, 2) as conf, case when p_size <= 25 then ({FIELD_LIST})[1 + p_partkey % 35] end as decided from part",
    "c": "select tenant_id, column_name, case when conf < 0.55 and decided is not null and decided <> 'invented' then decided else best end as field, "
    "case when conf < 0.55 and decided is not null and decided <> 'invented' then 'llm' when conf < 0.55 then 'deterministic_fallback' "
    "else 'deterministic' end as method from m",
    "entries": "select tenant_id, field as canonical_field, arg_max(column_name, struct_pack(n := length(column_name), c := column_name)) as source_column, "
    "arg_max(method, struct_pack(n := length(column_name), c := column_name)) as method from c where field <> 'UNKNOWN' group by 1, 2",
}


@query("build_spec", oracle.with_clause(PART_ENTRIES) + "select * from entries")
def build_spec(spark, sf):
    entries = mapping.spec_entries(part_mappings(spark, sf), part_decisions(spark, sf), ["tenant_id"])
    return entries.select("tenant_id", "canonical_field", F.col("entry.source_column").alias("source_column"),
                          F.col("entry.provenance.method").alias("method"))


def supplier_specs(spark, sf):
    """Stored specs: per nation and one of seven sources, a version per supplier."""
    from pyspark.sql import Window

    docs = F.map_from_arrays(
        F.array(F.lit("legal_name"), F.lit("country")),
        F.array(*[F.struct(F.concat(F.lit(c), F.col("s_suppkey")).alias("source_column"),
                           F.struct(F.lit("trim").alias("function"), F.create_map().cast("map<string,string>").alias("params")).alias("transform"),
                           F.struct(F.lit("deterministic").alias("method"), F.lit(None).cast("string").alias("model"), F.lit(0.9).alias("confidence"),
                                    F.lit(None).cast("string").alias("reasoning")).alias("provenance")).cast(mapping.ENTRY) for c in ("n", "c")]))
    order = Window.partitionBy("tenant_id", "source_id").orderBy("s_suppkey")
    status = F.when(F.col("s_suppkey") % 3 == 0, "confirmed").otherwise("draft")
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("t"), F.col("s_nationkey")).alias("tenant_id"),
        F.concat(F.lit("s"), F.col("s_suppkey") % 7).alias("source_id"), "s_suppkey", docs.alias("spec"), status.alias("status"))
    return suppliers.withColumn("version", F.row_number().over(order)).withColumn(
        "parent_version", F.nullif(F.col("version") - 1, F.lit(0))).drop("s_suppkey")


SPECS = ("select cast(s_suppkey as varchar) as id, 't' || s_nationkey as tenant_id, 's' || (s_suppkey % 7) as source_id, "
         "row_number() over (partition by s_nationkey, s_suppkey % 7 order by s_suppkey) as version, "
         "case when s_suppkey % 3 = 0 then 'confirmed' else 'draft' end as status, s_suppkey from supplier")


@query("spec_versions", oracle.with_clause({"specs": SPECS}) +
       "select 't' || n_nationkey as tenant_id, coalesce(max(version), 0) + 1 as version, max(version) as parent_version "
       "from nation left join specs on specs.tenant_id = 't' || n_nationkey and source_id = 's1' group by n_nationkey")
def spec_versions(spark, sf):
    specs = supplier_specs(spark, sf)
    drafts = table(spark, sf, "nation").select(
        F.concat(F.lit("t"), F.col("n_nationkey")).alias("tenant_id"), F.lit("s1").alias("source_id"),
        F.create_map().cast(f"map<string,{mapping.ENTRY}>").alias("spec"))
    return mapping.next_versions(specs, drafts).select("tenant_id", "version", "parent_version")


@query("patch_spec", oracle.with_clause({"specs": SPECS}) +
       "select id, case when status = 'draft' then 'legal_name=new/trim/human' else 'country=c' || id || '/trim/deterministic,legal_name=n' || id || '/trim/deterministic' end as entries, "
       "case when status = 'draft' then 'patched' else 'refused' end as patch from specs")
def patch_spec(spark, sf):
    """Every spec gets a new column for the name and loses the country."""
    specs = supplier_specs(spark, sf)
    named = F.struct(F.lit("new").alias("source_column"), F.lit(None).alias("transform"), F.lit(None).alias("provenance")).cast(mapping.ENTRY)
    patch = F.map_from_arrays(F.array(F.lit("legal_name"), F.lit("country")), F.array(named, F.lit(None).cast(mapping.ENTRY)))
    patched = mapping.patch_specs(specs, specs.select("id", patch.alias("patch")))
    lines = F.transform(F.map_entries("spec"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]["source_column"], F.lit("/"), e["value"]["transform"]["function"], F.lit("/"), e["value"]["provenance"]["method"]))
    return patched.select("id", F.array_join(F.array_sort(lines), ",").alias("entries"), F.col("_patch").alias("patch"))


@query("confirm_spec", oracle.with_clause({
    "specs": SPECS, "latest": "select tenant_id, source_id, max(version) as v from specs where status = 'draft' group by 1, 2"}) +
    "select id, version, case when status = 'draft' and version = v then 'confirmed' when status = 'confirmed' and v is not null then 'superseded' else status end as status "
    "from specs left join latest using (tenant_id, source_id)")
def confirm_spec(spark, sf):
    """The newest draft of every source is confirmed."""
    specs = supplier_specs(spark, sf)
    newest = specs.where(F.col("status") == "draft").groupBy("tenant_id", "source_id").agg(F.max_by("id", "version").alias("id"))
    return mapping.confirm_specs(specs, newest).select("id", "version", "status")


@query("spec_assignments", oracle.with_clause({"specs": SPECS}) +
       "select id, 'n' || id as source_column, 'legal_name' as canonical_field, 'trim' as function from specs where status = 'confirmed' "
       "union all select id, 'c' || id, 'country', 'trim' from specs where status = 'confirmed'")
def spec_assignments(spark, sf):
    confirmed = mapping.confirmed_specs(supplier_specs(spark, sf))
    return mapping.assignments(confirmed).select("id", "source_column", "canonical_field", "function")


@query("cosine_to_centroid", "with d as (select vec_id, label, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings), "
       "c as (select label, i, avg(x::double) as m from d group by 1, 2) "
       "select vec_id, label, round(sum(x::double * m) / (sqrt(sum(x::double * x::double)) * sqrt(sum(m * m))), 4) as score from d join c using (label, i) group by 1, 2")
def cosine_to_centroid(spark, sf):
    from tidewright.functions.vectors import cosine

    vectors = table(spark, sf, "embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
    return vectors.join(centroids, "label").select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("centroid")), 4).alias("score"))


@query("mapping_accuracy",
       "with p as (select source, case when quality = 1 then 'f' || (doc_id % 5) end as truth, case when toxic = 0 then 'f' || (doc_id % 4) end as predicted, "
       "['f' || (doc_id % 4), 'f' || (doc_id % 3), 'f' || (doc_id % 2), 'f4'] as ranked from labels join documents using (doc_id)) "
       "select lang_source as source, mapped_columns, tp, fp, fn, round(case when mapped_columns > 0 then tp / mapped_columns else 0 end, 4) as acc_at_1, "
       "round(case when mapped_columns > 0 then in_top / mapped_columns else 0 end, 4) as acc_at_3, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 4) as precision, "
       "round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 4) as recall from (select source as lang_source, count(truth) as mapped_columns, "
       "count(*) filter (truth = predicted) as tp, count(*) filter (predicted is not null and (truth is null or truth <> predicted)) as fp, "
       "count(*) filter (truth is not null and (predicted is null or truth <> predicted)) as fn, count(*) filter (list_contains(ranked[1:3], truth)) as in_top from p group by 1)")
def mapping_accuracy(spark, sf):
    """Document labels as truth and prediction, per document source."""
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    name = lambda n: F.concat(F.lit("f"), F.col("doc_id") % n)
    cases = joined.select("source", F.when(F.col("quality") == 1, name(5)).alias("truth"), F.when(F.col("toxic") == 0, name(4)).alias("predicted"),
                          F.array(name(4), name(3), name(2), F.lit("f4")).alias("ranked"))
    return evaluate.mapping_accuracy(cases, ["source"])


@query("defect_coverage", oracle.with_clause({
    **TICKETS_CHECKED,
    "expected": "select batch_id, row_index, [x for x in [case when row_index % 29 = 4 then 'MISSING_REQUIRED' end, case when row_index % 53 = 11 then 'DUPLICATE_EXACT' end, "
    "case when row_index % 4 = 3 and row_index % 3 = 0 then 'ENUM_INVALID' end] if x is not null] as codes from checked_raw",
    "e": "select batch_id, row_index, unnest(codes) as code from expected"}) +
    "select code, count(*) as expected, count(*) filter (list_contains([split_part(x, ': ', 2) for x in errs], code)) as found, "
    "count(*) filter (not list_contains([split_part(x, ': ', 2) for x in errs], code)) as missed from e join checked using (batch_id, row_index) group by 1")
def defect_coverage(spark, sf):
    """Injected ticket defects against the codes the checks produced."""
    k = F.col("row_index")
    wanted = [(k % 29 == 4, "MISSING_REQUIRED"), (k % 53 == 11, "DUPLICATE_EXACT"), ((k % 4 == 3) & (k % 3 == 0), "ENUM_INVALID")]
    codes = F.array_compact(F.array(*[F.when(c, code) for c, code in wanted]))
    expected = fixtures.raw(spark, sf, "tickets").select("batch_id", "row_index", codes.alias("codes")).where(F.size("codes") > 0)
    return evaluate.defect_coverage(expected, ticket_quarantine(spark, sf), ["batch_id", "row_index"])


# --- dedupe ------------------------------------------------------------------

def _pairs_sql(blank_is_null: bool, threshold: float = 0.5) -> dict[str, str]:
    def factor(c: str, same: float, other: float) -> str:
        value = f"case when a.{c} = b.{c} then {same} else {other} end"
        return f"case when a.{c} = '' or b.{c} = '' then 1.0 else {value} end" if blank_is_null else value

    jw = "jaro_winkler_similarity(a.legal_name, b.legal_name)"
    name = (f"case when a.legal_name = b.legal_name then 0.85 / 0.001 when {jw} >= 0.9 then 0.5 / 0.02 when {jw} >= 0.7 then 0.3 / 0.05 else 0.02 / 0.9 end")
    same_email = "a.email = b.email" + (" and a.email <> ''" if blank_is_null else "")
    return {
        **oracle.CUSTOMERS,
        "people": "select tenant_id, id, legal_name, coalesce(email, '') as email, coalesce(country, '') as country from customers",
        "scored": f"select a.tenant_id, a.id as customer_id_a, b.id as customer_id_b, cast(0.01 / 0.99 * ({name}) * "
        f"({factor('email', 0.95 / 0.001, 0.05 / 0.999)}) * ({factor('country', 0.6 / 0.3, 0.4 / 0.7)}) as double) as odds "
        f"from people a join people b on a.tenant_id = b.tenant_id and a.id < b.id and "
        f"(substr(a.legal_name, 1, 3) = substr(b.legal_name, 1, 3) or ({same_email}))",
        "pairs": f"select tenant_id, customer_id_a, customer_id_b, round(odds / (1 + odds), 4) as match_probability from scored where odds / (1 + odds) >= {threshold}",
    }


@query("dedupe_pairs", oracle.with_clause(_pairs_sql(False)) + "select * from pairs")
def dedupe_pairs(spark, sf):
    return dedupe.duplicate_candidates(fixtures.canonical_customers(spark, sf))


@query("dedupe_pairs_blank_is_null", oracle.with_clause(_pairs_sql(True)) + "select * from pairs")
def dedupe_pairs_blank_is_null(spark, sf):
    return dedupe.duplicate_candidates(fixtures.canonical_customers(spark, sf), blank_is_null=True)


BY_NAME = 0.02


@query("dedupe_pairs_by_name", oracle.with_clause(_pairs_sql(True, BY_NAME)) + "select * from pairs")
def dedupe_pairs_by_name(spark, sf):
    """At so low a threshold close names alone make a candidate: blocks of names with the same first three characters."""
    return dedupe.duplicate_candidates(fixtures.canonical_customers(spark, sf), BY_NAME, blank_is_null=True)


def twin_pairs(spark, sf):
    """The candidates that blank emails do not cause, as a found set."""
    return reliable(dedupe.duplicate_candidates(fixtures.canonical_customers(spark, sf), blank_is_null=True))


@query("dismissed_candidates", oracle.with_clause(_pairs_sql(True)) +
       f"select {fixtures.id_sql(PAIR, 'tenant_id', 'customer_id_a', 'customer_id_b')} as id, match_probability, 'open' as status from pairs "
       "where tenant_id = 'tenant-0' and customer_id_a >= '8'")
def dismissed_candidates(spark, sf):
    """The open candidates of a tenant after those of the customers with low ids have been dismissed."""
    found = twin_pairs(spark, sf)
    none = spark.createDataFrame([], "id string, tenant_id string, customer_id_a string, customer_id_b string, match_probability double, status string")
    stored = dedupe.upsert_candidates(none, found)
    return dedupe.list_candidates(dedupe.dismiss(stored, F.col("customer_id_a") < "8"), "tenant-0").select("id", "match_probability", "status")


@query("dedupe_upsert", oracle.with_clause(_pairs_sql(True)) +
       "select customer_id_a, customer_id_b, match_probability, case when customer_id_a < '8' then 'dismissed' else 'open' end as status, "
       "customer_id_a >= '8' as new from pairs")
def dedupe_upsert(spark, sf):
    found = twin_pairs(spark, sf)
    stored = found.where(F.col("customer_id_a") < "8").withColumn("match_probability", F.lit(0.5)).withColumn("status", F.lit("dismissed"))
    return dedupe.upsert_candidates(stored, found).select(
        "customer_id_a", "customer_id_b", "match_probability", "status", F.col("_new").alias("new"))


@query("merge_repoint", oracle.with_clause({**_pairs_sql(True), **oracle.checked("invoices", INVOICE_SPEC)}) +
       "select row_index, coalesce(p.customer_id_a, c.resolved_id) as customer_id from checked c "
       "left join pairs p on p.tenant_id = c.tenant_id and p.customer_id_b = c.resolved_id where c.resolved_id is not null")
def merge_repoint(spark, sf):
    """All candidates merged at once; invoices follow to the surviving customer."""
    merges = dedupe.merge_map(twin_pairs(spark, sf))
    linked = reliable(annotated(spark, sf, "invoices", INVOICE_SPEC).select("tenant_id", "row_index", "customer_id"))
    moved = dedupe.repoint(linked.where(F.col("customer_id").isNotNull()), merges, "row_index")
    return moved.select("row_index", "customer_id")


@query("merged_customers", oracle.with_clause(_pairs_sql(True)) + "select id, tenant_id from people where id not in (select customer_id_b from pairs)")
def merged_customers(spark, sf):
    merges = dedupe.merge_map(twin_pairs(spark, sf))
    return dedupe.drop_merged(fixtures.canonical_customers(spark, sf), merges).select("id", "tenant_id")


# --- metrics -----------------------------------------------------------------

@query("tenant_metrics",
       "with t as (select 'N' || n_nationkey as tenant_id, n_nationkey as k from nation union all select 'nobody', -1) "
       "select tenant_id, (select count(*) from part where p_partkey % 25 = k) as batches, (select count(*) from customer where c_nationkey = k) as customers, "
       "(select count(*) from orders join customer on o_custkey = c_custkey where c_nationkey = k) as invoices, "
       "(select count(*) from events where user_id % 25 = k) as support_tickets, "
       "(select count(*) from supplier where s_nationkey = k) as accounts, "
       "(select count(*) from supplier where s_nationkey = k and s_acctbal < 5000) as quarantine_open, "
       "(select count(*) from supplier where s_nationkey = k and s_acctbal >= 5000) as quarantine_fixed, "
       "(select count(*) from part where p_partkey % 25 = k and p_size < 10) as mapping_specs_confirmed from t")
def tenant_metrics(spark, sf):
    """Counts of all eight state tables, kept as state: written tenant by tenant, then counted."""
    tenant = lambda c: F.concat(F.lit("N"), c).alias("tenant_id")
    customer = table(spark, sf, "customer")
    supplier, part = table(spark, sf, "supplier"), table(spark, sf, "part")
    of_nation, of_part = tenant(F.col("s_nationkey")), tenant(F.col("p_partkey") % 25)
    tables = {
        "customers": customer.select(tenant(F.col("c_nationkey"))),
        "invoices": table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(tenant(F.col("c_nationkey"))),
        "accounts": supplier.select(of_nation),
        "support_tickets": table(spark, sf, "events").select(tenant(F.col("user_id") % 25)),
        "batches": part.select(of_part),
        "quarantine": supplier.select(of_nation, F.when(F.col("s_acctbal") < 5000, "open").otherwise("resubmitted").alias("status")),
        "mapping_specs": part.select(of_part, F.when(F.col("p_size") < 10, "confirmed").otherwise("draft").alias("status")),
    }
    state = State(spark, f"{shared_folder(spark).rstrip('/')}/state-{uuid.uuid4().hex}", {t: "tenant_id string, status string" for t in tables})
    state.commit({t: df if "status" in df.columns else df.withColumn("status", F.lit("any")) for t, df in tables.items()})
    asked = table(spark, sf, "nation").select(tenant(F.col("n_nationkey"))).unionByName(spark.createDataFrame([("nobody",)], "tenant_id string"))
    return metrics.tenant_metrics({t: state.read(t) for t in tables}, asked)
