"""The same results in SQL, where SQL can express them."""

RANKED = """
select run_id, "Lane", "Undetermined_Index", "Count", cast(rank as int) as rank from (
  select *, row_number() over (partition by run_id, "Lane" order by "Count" desc, encode("Undetermined_Index")) as rank from (
    select run_id, "Lane", "Undetermined_Index", max("Count") as "Count" from mixing_results
    where run_id is not null and "Lane" is not null and "Undetermined_Index" is not null and "Count" is not null
    group by 1, 2, 3)) where rank <= 5
"""

HEAVY = """
select "Undetermined_Index", cast(sum("Count") as bigint) as total, true as close from mixing_results where "Undetermined_Index" is not null group by 1
having 100 * sum("Count") >= (select sum("Count") from mixing_results where "Undetermined_Index" is not null)
"""

SHARES = """
with ws as (select doc_id, regexp_extract_all(coalesce(text, ''), '\\p{L}+') as w from documents),
p as (select doc_id, unnest(range(1, len(w) + 1)) as pos, len(w) as n, w from ws),
g as (select doc_id, pos, case when pos + 5 <= n then lower(array_to_string(list_slice(w, pos, pos + 5), ' ')) end as gram from p),
f as (select doc_id, pos, gram is not null and row_number() over (partition by doc_id, gram order by pos) > 1 as again from g),
c as (select doc_id, pos, max(cast(again as int)) over (partition by doc_id order by pos rows between 5 preceding and current row) as covered from f)
select d.doc_id, count(c.pos) as words, cast(coalesce(sum(covered), 0) as bigint) as repeated
from documents d left join c on c.doc_id = d.doc_id group by d.doc_id
"""


def oracle_sql() -> dict:
    return {
        "p2_found": f'select run_id, "Lane", "Undetermined_Index" from ({RANKED})',
        "p2_ranked": RANKED,
        "p3_even": "select s as sample, least(k, n) as rows, true as once, true as even, least(k, n) as known from (values ('rest', 500), ('fed', 500)) t(s, k), (select count(*) as n from reads) r",
        "p4_found": f'select "Undetermined_Index" from ({HEAVY}) h',
        "p4_totals": HEAVY,
        "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
        "p7_kept": "select t.source, count(d.doc_id) as documents, true as once, true as capped, true as near from mix_targets t left join documents d on d.source = t.source group by 1",
        "p8_shares": f"select doc_id, words, repeated, round(case when words > 0 then repeated / cast(words as double) else 0 end, 9) as share from ({SHARES}) s",
        "p8_found": f"select doc_id from ({SHARES}) where words > 0 and 10 * repeated >= 6 * words",
    }
