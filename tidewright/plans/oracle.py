"""SQL twins of the jobs, for the engine that checks the results."""

from __future__ import annotations

from collections.abc import Mapping

from tidewright import registry
from tidewright.functions.text import WHITESPACE
from tidewright.operators.records import ordered_fields, tables_of
from tidewright.plans import fixtures


def text(x: str) -> str:
    return f"nullif(trim({x}, '{WHITESPACE}'), '')"


def date_value(t: str) -> str:
    first, second = f"try_cast(split_part({t}, '/', 1) as int)", f"try_cast(split_part({t}, '/', 2) as int)"
    return (
        f"case when regexp_full_match({t}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then try_cast({t} as date) "
        f"when regexp_full_match({t}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') and {first} > 12 then cast(try_strptime({t}, '%d/%m/%Y') as date) "
        f"when regexp_full_match({t}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') and {second} > 12 then cast(try_strptime({t}, '%m/%d/%Y') as date) end"
    )


def int_value(t: str) -> str:
    return f"case when regexp_full_match({t}, '[+-]?\\d+(_\\d+)*') then try_cast(replace({t}, '_', '') as bigint) end"


def money_value(t: str) -> str:
    bare = f"trim(translate({t}, '$€£¥', ''))"
    body = f"(case when starts_with({bare}, '-') then substr({bare}, 2) else {bare} end)"
    comma, dot = f"strpos(reverse({body}), ',')", f"strpos(reverse({body}), '.')"
    number = (
        f"(case when {comma} > 0 and {dot} > 0 and {comma} < {dot} then replace(replace({body}, '.', ''), ',', '.') "
        f"when {comma} > 0 and {dot} = 0 and {comma} = 3 then substr({body}, 1, length({body}) - 3) || '.' || right({body}, 2) "
        f"else replace({body}, ',', '') end)"
    )
    units = f"cast(round(try_cast({number} as decimal(30, 10)), 2) * 100 as bigint)"
    return f"case when starts_with({bare}, '-') then -({units}) else {units} end"


def enum_value(t: str, allowed: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{a}'" for a in allowed)
    return f"case when lower({t}) in ({listed.lower()}) then lower({t}) end"


def value(function: str, t: str, allowed: tuple[str, ...] = ()) -> str:
    return {
        "trim": lambda: t,
        "parse_date": lambda: date_value(t),
        "to_int": lambda: int_value(t),
        "to_minor_units": lambda: money_value(t),
        "map_enum": lambda: enum_value(t, allowed),
    }[function]()


def code(function: str, t: str, v: str) -> str:
    failed = f"{t} is not null and {v} is null"
    if function == "map_enum":
        return f"case when {failed} then 'ENUM_INVALID' end"
    if function == "parse_date":
        both = f"regexp_full_match({t}, '(0?\\d|1[0-2])/(0?\\d|1[0-2])/\\d{{4}}')"
        return f"case when {failed} and {both} then 'DATE_AMBIGUOUS' when {failed} then 'TYPE_COERCION_FAILED' end"
    return f"case when {failed} then 'TYPE_COERCION_FAILED' end"


def with_clause(ctes: Mapping[str, str]) -> str:
    return "with " + ", ".join(f"{name} as ({sql})" for name, sql in ctes.items()) + " "


def parsed_query(extract: str, column: str, function: str, allowed: tuple[str, ...] = ()) -> str:
    return with_clause({
        "raw": fixtures.flat_sql(extract),
        "t": f"select row_index, {text(column)} as t from raw",
        "v": f"select row_index, t, {value(function, 't', allowed)} as value from t",
    }) + f"select row_index, value, {code(function, 't', 'value')} as error_code from v"


CUSTOMERS = {"raw_customers": fixtures.flat_sql("customers"), "customers": fixtures.CANONICAL_CUSTOMERS_SQL}


def checked(
    extract: str, spec: Mapping[str, dict], name: str = "checked", source: str | None = None, duplicates: bool = True
) -> dict[str, str]:
    """CTEs up to `name`: row identity, typed value per field (v_<field>), the
    list `errs` of 'field: CODE' in order, link_key, customer_id, match."""
    fields = ordered_fields(spec)
    tables = tables_of(spec)
    functions = {f.name: spec[f.name]["transform"]["function"] for f in fields}
    texts = ", ".join(f"{text(spec[f.name]['source_column'])} as t_{f.name}" for f in fields)
    values = ", ".join(f"{value(functions[f.name], 't_' + f.name, f.enum_values)} as v_{f.name}" for f in fields)
    codes = []
    for f in fields:
        c = code(functions[f.name], f"t_{f.name}", f"v_{f.name}")
        codes.append(
            f"coalesce({c}, case when t_{f.name} is null then 'MISSING_REQUIRED' end) as c_{f.name}" if f.required
            else f"{c} as c_{f.name}"
        )
    errors = [f"'{f.name}: ' || c_{f.name}" for t in tables for f in fields if f.table == t]
    by_column = {(f.table, f.column): f.name for f in fields}
    for t in tables:
        if t == "invoices":
            fit = {c: n for (u, c), n in by_column.items()
                   if u == t and registry.SPARK_TYPE_BY_TRANSFORM[functions[n]] == registry.field(n).spark_type}
            issued, due, amount = (fit.get(c) for c in ("issue_date", "due_date", "amount_minor_units"))
            if issued:
                errors.append(f"case when v_{issued} > date '{fixtures.AS_OF}' then 'issue_date: BUSINESS_RULE_FUTURE_DATE' end")
            if amount:
                errors.append(f"case when v_{amount} < 0 then 'amount_minor_units: BUSINESS_RULE_NEGATIVE_AMOUNT' end")
            if issued and due:
                errors.append(f"case when v_{due} < v_{issued} then 'due_date: BUSINESS_RULE_DUE_BEFORE_ISSUE' end")
        for f in fields:
            made = registry.SPARK_TYPE_BY_TRANSFORM[functions[f.name]]
            if f.table == t and made != f.spark_type and not f.is_link:
                errors.append(f"case when v_{f.name} is not null then '{f.column}: SCHEMA_VALIDATION_FAILED' end")
    repeats = []
    if duplicates:
        for t in tables:
            key = by_column.get((t, "natural_key"))
            if key:
                repeats.append(
                    f"case when v_{key} is not null and row_number() over (partition by batch_id, v_{key} order by row_index) > 1 "
                    f"then 'natural_key: DUPLICATE_EXACT' end"
                )
    own = [f.name for t in tables if t != "accounts" for f in fields if f.table == t and f.is_link]
    account = [f.name for f in fields if f.table == "accounts" and f.is_link]
    links = [f"v_{n}" for n in own + account]
    link_key = f"coalesce({', '.join(links)})" if links else "null::varchar"
    listed = ", ".join(errors + repeats)
    return {
        f"{name}_raw": source or fixtures.flat_sql(extract),
        f"{name}_t": f"select *, {texts} from {name}_raw",
        f"{name}_v": f"select *, {values} from {name}_t",
        f"{name}_c": f"select *, {', '.join(codes)} from {name}_v",
        f"{name}_e": f"select *, [x for x in [{listed}] if x is not null] as own_errs, {link_key} as link_key from {name}_c",
        f"{name}_digits": "select tenant_id, regexp_replace(natural_key, '\\D', '', 'g') as d, arg_min(id, natural_key) as id "
        "from customers group by 1, 2 having regexp_replace(natural_key, '\\D', '', 'g') <> ''",
        f"{name}_l": f"select e.*, coalesce(x.id, g.id) as resolved_id, "
        f"case when x.id is not null then 'exact' when g.id is not null then 'digits' end as match from {name}_e e "
        f"left join customers x on x.tenant_id = e.tenant_id and x.natural_key = e.link_key "
        f"left join {name}_digits g on x.id is null and g.tenant_id = e.tenant_id and g.d = regexp_replace(e.link_key, '\\D', '', 'g')",
        name: f"select *, case when link_key is not null and resolved_id is null "
        f"then list_append(own_errs, 'customer_id: REF_INTEGRITY_ORPHAN_FK') else own_errs end as errs from {name}_l",
    }


CODES = "array_to_string(list_sort(list_distinct([split_part(x, ': ', 2) for x in errs])), ',')"


def profile_sql(cells: str, by: str = "") -> str:
    """Profile statistics over (column_name, value) rows."""
    group = f"{by}column_name"
    v = "value"

    def share(test: str) -> str:
        return f"coalesce(count(*) filter ({v} is not null and {test}) / nullif(count({v}), 0), 0.0)"

    dates = (
        f"(regexp_full_match({v}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') and try_strptime({v}, '%Y-%m-%d') is not null "
        f"or regexp_full_match({v}, '\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}') and try_strptime({v}, '%Y/%m/%d') is not null "
        f"or regexp_full_match({v}, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') and try_strptime({v}, '%d-%m-%Y') is not null "
        f"or regexp_full_match({v}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') and try_strptime({v}, '%d/%m/%Y') is not null)"
    )
    return (
        f"select {group}, count(*) as row_count, count(*) - count({v}) as null_count, "
        f"round((count(*) - count({v})) / count(*), 6) as null_fraction, count(distinct {v}) as distinct_count, "
        f"round(coalesce(count(distinct {v}) / nullif(count({v}), 0), 0.0), 6) as distinct_fraction, "
        f"coalesce(array_to_string((list_sort(list(distinct {v}) filter ({v} is not null)))[1:5], ' | '), '') as sample_values, "
        f"round({share(dates)}, 6) as date_parse_fraction, "
        f"round({share(f'''regexp_full_match({v}, '[+-]?[0-9]+') and try_cast({v} as bigint) is not null''')}, 6) as int_parse_fraction, "
        f"round({share(f'''try_cast({v} as double) is not null and regexp_full_match({v}, '[0-9.eE+-]+')''')}, 6) as float_parse_fraction, "
        f"round({share(f'''regexp_full_match({v}, '[^@[:space:]]+@[^@[:space:]]+\\.[^@[:space:]]+')''')}, 6) as email_match_fraction, "
        f"round({share(f'''regexp_full_match({v}, '[-0-9+()[:space:]]{{7,20}}')''')}, 6) as phone_match_fraction, "
        f"round({share(f'''regexp_full_match({v}, '[A-Za-z]{{3}}')''')}, 6) as currency_code_match_fraction "
        f"from {cells} group by {group}"
    )


def cells_sql(select: str, columns: list[str], extra: str = "") -> str:
    """(extra column_name, value) rows of a SELECT, nulls included."""
    return " union all ".join(
        f"select {extra}'{c}' as column_name, cast({c} as varchar) as value from ({select})" for c in columns
    )
