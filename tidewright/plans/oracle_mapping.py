"""SQL twins of the scores that have no function in SQL: indel ratios, word-set scores, hashed 3-gram vectors, near keys."""

from __future__ import annotations

from collections.abc import Iterable

from tidewright import registry
from tidewright.operators.mapping import AUTO_ACCEPT, HUMAN_CONFIRM, NAME_WEIGHT, TYPE_WEIGHT, VECTOR_WEIGHT


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence: one row of the usual table per character of `b`."""
    hits = (f"list_prepend(list_transform(range(1, length({a}) + 1), lambda i: 0::bigint), list_transform(string_split({b}, ''), "
            f"lambda ch: list_transform(string_split({a}, ''), lambda x: (x = ch)::bigint)))")
    row = ("lambda old, hit: list_transform(range(1, len(hit) + 1), lambda i: greatest(old[i], list_max(list_transform(range(1, i + 1), "
           "lambda j: hit[j] * (coalesce(old[j - 1], 0) + 1)))))")
    return f"case when length({a}) = 0 or length({b}) = 0 then 0 else list_last(list_reduce({hits}, {row})) end"


def indel_ratio(a: str, b: str) -> str:
    total = f"(length({a}) + length({b}))::double"
    return f"case when {total} = 0 then 100.0::double else 100.0::double * (1 - ({total} - 2 * ({lcs(a, b)})) / {total}) end"


def normalized(c: str) -> str:
    return f"trim(lower(translate(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_-', '  ')))"


def _values(rows: Iterable[tuple]) -> str:
    show = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


def token_set_ctes(pairs: str, into: str) -> dict[str, str]:
    """`into`: (a, b, score) of the distinct (a, b) of `pairs`."""
    words = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda w: w <> ''))"
    joined = lambda ws: f"array_to_string(list_sort({ws}), ' ')"
    rest = lambda x, y: joined(f"list_filter({x}, lambda w: not list_contains({y}, w))")
    return {
        f"{into}_w": f"select distinct a, b, {words('a')} as wa, {words('b')} as wb from {pairs}",
        f"{into}_r": f"select *, {joined('list_filter(wa, lambda w: list_contains(wb, w))')} as shared, {rest('wa', 'wb')} as ra, {rest('wb', 'wa')} as rb from {into}_w",
        f"{into}_s": f"select *, trim(shared || ' ' || ra) as with_a, trim(shared || ' ' || rb) as with_b from {into}_r",
        f"{into}_p": f"select a, b, with_a as x, with_b as y from {into}_s union all select a, b, shared, with_a from {into}_s where shared <> '' "
        f"union all select a, b, shared, with_b from {into}_s where shared <> ''",
        f"{into}_q": f"select a, b, max({indel_ratio('x', 'y')}) as best from {into}_p group by a, b",
        into: f"select a, b, case when len(wa) = 0 or len(wb) = 0 then 0.0 when shared <> '' and (ra = '' or rb = '') then 100.0 else best end::double as score "
        f"from {into}_s join {into}_q using (a, b)",
    }


def name_score_ctes(columns: str, into: str = "names") -> dict[str, str]:
    """`into`: (column_name, canonical_field, name_score), `columns` having column_name."""
    spelled = _values((f.name, n) for f in registry.FIELDS.values() for n in (f.name, *f.aliases))
    return {
        f"{into}_c": f"select distinct column_name, canonical_field, {normalized('column_name')} as a, {normalized('spelling')} as b "
        f"from (select distinct column_name from {columns}), (values {spelled}) s(canonical_field, spelling)",
        **token_set_ctes(f"{into}_c", f"{into}_t"),
        into: f"select column_name, canonical_field, max(score) / 100.0::double as name_score from {into}_c join {into}_t using (a, b) group by 1, 2",
    }


def crc32(t: str) -> str:
    """Of ASCII text."""
    step = "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({t}, ''), lambda ch: ascii(ch)::bigint)), {step}), 4294967295)"


def vector_ctes(texts: str, into: str) -> dict[str, str]:
    """`into`: (key, slot, weight) of the hashed vectors of `texts` (key, text)."""
    return {
        f"{into}_w": f"select key, unnest(regexp_extract_all(lower(text), '[^[:space:]]+')) as w from {texts}",
        f"{into}_g": f"select key, w as gram, 1.0::double as weight from {into}_w union all "
        f"select key, substr(' ' || w || ' ', i::int, 3), 0.5 from (select key, w, unnest(range(1, length(w) + 1)) as i from {into}_w)",
        f"{into}_h": f"select gram, {crc32('gram')} % 256 as slot from (select distinct gram from {into}_g)",
        into: f"select key, slot, sum(weight) as weight from {into}_g join {into}_h using (gram) group by 1, 2",
    }


def ranking_ctes(profiles: str, pools: str, type_score: str) -> dict[str, str]:
    """`ranked`: every candidate of every column of `profiles` with its scores and rank; `by_name`: by names alone."""
    about = _values((f.name, f.description) for f in registry.FIELDS.values())
    double = lambda x: f"{x}::double"
    return {
        **name_score_ctes(profiles),
        "column_texts": f"select source_kind || '/' || column_name as key, column_name || ': sample values are ' || replace(sample_values, ' | ', ', ') as text from {profiles}",
        "field_texts": f"select * from (values {about}) f(key, text)",
        **vector_ctes("column_texts", "cv"), **vector_ctes("field_texts", "fv"),
        "c_norms": "select key, sqrt(sum(weight * weight)) as norm from cv group by 1",
        "f_norms": "select key, sqrt(sum(weight * weight)) as norm from fv group by 1",
        "dots": "select cv.key as c, fv.key as f, sum(cv.weight * fv.weight) as dot from cv join fv using (slot) group by 1, 2",
        "scored": f"select source_kind, {profiles}.column_name, field, ordinal, name_score, coalesce(dot, 0) / (c_norms.norm * f_norms.norm) as embedding_score, ({type_score})::double as type_score "
        f"from {profiles} join (values {pools}) p(source_kind, ordinal, field, type) using (source_kind) "
        "join names on names.column_name = profiles.column_name and names.canonical_field = field "
        "join c_norms on c_norms.key = source_kind || '/' || profiles.column_name join f_norms on f_norms.key = field "
        "left join dots on dots.c = c_norms.key and dots.f = field",
        "ranked": f"select *, row_number() over (partition by source_kind, column_name order by confidence desc, ordinal) as rank from (select *, "
        f"round({double(NAME_WEIGHT)} * name_score + {double(VECTOR_WEIGHT)} * embedding_score + {double(TYPE_WEIGHT)} * type_score, 4) as confidence from scored)",
        "by_name": "select *, row_number() over (partition by source_kind, column_name order by name_score desc, ordinal) as rank from scored",
        "mapped": f"select source_kind, column_name, field as best_field, confidence, case when confidence >= {AUTO_ACCEPT} then 'auto_accept' "
        f"when confidence >= {HUMAN_CONFIRM} then 'human_confirm' else 'unmapped' end as bucket, candidates from ranked "
        "join (select source_kind, column_name, count(*) as candidates from ranked group by 1, 2) using (source_kind, column_name) where rank = 1",
    }


def nearest_ctes(orphans: str, customers: str, at: int, levels: int = 3) -> dict[str, str]:
    """`nearest`: (tenant_id, link_key, natural_key, score) of the best customer key, by all ways of leaving characters
    out of either key (as far as the score allows, `levels` at most: keys of up to 15 characters)."""
    removed = lambda n: f"least({levels}, floor(length(key) * {200 - 2 * at} / {200 - at}.0))"
    out: dict[str, str] = {"near_0": f"select distinct tenant_id, 'o' as side, link_key as key, link_key as part from {orphans} where link_key is not null "
                                     f"union all select distinct tenant_id, 'c', natural_key, natural_key from {customers}"}
    for n in range(1, levels + 1):
        out[f"near_{n}"] = (f"select distinct tenant_id, side, key, part[1:i - 1] || part[i + 1:] as part from (select *, unnest(range(1, length(part) + 1)) as i "
                            f"from near_{n - 1} where {removed(n)} >= {n})")
    out["parts"] = " union all ".join(f"select * from near_{n}" for n in range(levels + 1))
    score = "200.0::double * length(o.part) / (length(o.key) + length(c.key))"
    out["near_pairs"] = (f"select o.tenant_id, o.key as link_key, c.key as natural_key, max({score}) as score from parts o join parts c "
                         "on o.side = 'o' and c.side = 'c' and o.tenant_id = c.tenant_id and o.part = c.part group by 1, 2, 3")
    out["nearest"] = (f"select tenant_id, link_key, natural_key, score, 'Map to existing customer ''' || natural_key || ''' (' || round_even(score, 0)::int || '% match)' as suggested_fix "
                      f"from (select *, row_number() over (partition by tenant_id, link_key order by score desc, natural_key) as r from near_pairs where score >= {at}) where r = 1")
    return out


def truth_values(truth: Iterable[tuple]) -> str:
    return _values(truth)


def accuracy_sql(predictions: str) -> str:
    """Accuracy at 1 and 3, precision and recall over rows (pass, truth, predicted, ranked)."""
    ratio = lambda a, b: f"round(case when {b} > 0 then ({a})::double / ({b}) else 0 end, 4)"
    return (
        f"select pass, mapped_columns, tp, fp, fn, {ratio('tp', 'mapped_columns')} as acc_at_1, {ratio('in_top', 'mapped_columns')} as acc_at_3, "
        f"{ratio('tp', 'tp + fp')} as precision, {ratio('tp', 'tp + fn')} as recall from (select pass, count(truth) as mapped_columns, "
        "count(*) filter (truth = predicted) as tp, count(*) filter (predicted is not null and not coalesce(truth = predicted, false)) as fp, "
        "count(*) filter (truth is not null and not coalesce(truth = predicted, false)) as fn, "
        f"count(*) filter (list_contains(ranked[1:3], truth)) as in_top from {predictions} group by pass)"
    )
