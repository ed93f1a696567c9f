"""DuckDB texts that compute the registered queries another way."""

from __future__ import annotations

from ledgerloom.schema import EXCLUDED_AGENCIES

from .queries import LOOSE_THRESHOLD, PART_ROWS
from .views import duckdb_view

_EXCLUDED = ", ".join(f"'{code}'" for code in EXCLUDED_AGENCIES)

# Ledger with fiscal year `fy`, restored position `full_no` and numbers `e, u, m, b, r`.
_BASE = """
base as (
  select l.*, y || '-' || (y + 1) as fy,
    case when len(position_number) in (10, 11, 12)
      then repeat('0', 13 - len(position_number)) || position_number else position_number end as full_no,
    substr(leave_period, 6, 2) = '06' as june,
    leave_earned::double as e, leave_used::double as u, misc_amt::double as m,
    end_balance::double as b, hourly_rate::double as r
  from (select *, left(leave_period, 4)::int - (substr(leave_period, 6, 2)::int < 7)::int as y from ledger) l
)"""

_BEGIN = "{end} - coalesce(e, 0) + coalesce(u, 0) - coalesce(m, 0)"


def _with(views: str, body: str, base: bool = False) -> str:
    ctes = [f"{v} as ({duckdb_view(v)})" for v in views.split()]
    if base:
        ctes.append(_BASE)
    head, sep, rest = body.partition("--main")
    if sep:
        ctes.append(head.strip().rstrip(","))
        body = rest
    return "with recursive " + ",\n".join(ctes) + "\n" + body


def _ledger(body: str) -> str:
    return _with("ledger", body, base=True)


_REPORTED = f"time_base <> '??' and left(full_no, 3) not in ({_EXCLUDED})"

# Cleaned cells `clean(doc, page, grp, cand, r, c, v)` with rows and columns counted from 0.
_CLEAN = """
filled as (
  select doc, page, grp, cand, row_no, col_no, replace(trim(value, ' ' || chr(160)), chr(160), ' ') as v
  from table_cells where trim(value, ' ' || chr(160)) <> ''
),
clean as (
  select doc, page, grp, cand, v, col_no as label,
    dense_rank() over (partition by doc, page, grp, cand order by row_no) - 1 as r,
    dense_rank() over (partition by doc, page, grp, cand order by col_no) - 1 as c
  from filled
),
shape as (
  select doc, page, grp, cand, max(r) + 1 as nrows, max(c) + 1 as ncols, count(*) + 2 * (max(c) + 1) as score
  from clean group by all
),
"""

# Unified cells `u(doc, page, grp, r, c, v)`, their shapes `t` and row texts `lines`.
_UNIFIED = (
    _CLEAN
    + """
ranked as (
  select *, row_number() over (partition by doc, page, grp order by score desc, cand) as place from shape
),
kept as (
  select k.*, coalesce(sum(nrows) over (partition by doc, page, grp order by place
      rows between unbounded preceding and 1 preceding), 0) as above
  from ranked k join (select doc, page, grp, ncols from ranked where place = 1) using (doc, page, grp, ncols)
),
labels as (
  select doc, page, grp, label, row_number() over (partition by doc, page, grp order by min(place), label) - 1 as c
  from clean join kept using (doc, page, grp, cand) group by doc, page, grp, label
),
u as (
  select doc, page, grp, (above + r)::bigint as r, labels.c, v
  from clean join kept using (doc, page, grp, cand) join labels using (doc, page, grp, label)
),
t as (
  select doc, page, grp, max(r) + 1 as nrows, max(c) + 1 as ncols, count(*) as filled,
    count(*) filter (c = 0) as first_filled, bool_or(regexp_matches(v, '[A-Za-z]')) as letters,
    count(*) filter (regexp_matches(v, '\\$\\d')) as dollars
  from u group by all
),
slots as (
  select doc, page, grp, nrows, ncols, rr.r, cc.c from t, unnest(range(nrows)) as rr(r), unnest(range(ncols)) as cc(c)
),
lines as (
  select doc, page, grp, r, string_agg(coalesce(v, ''), '|' order by c) as line
  from slots left join u using (doc, page, grp, r, c) group by all
),
judged as (
  select *, nrows < 2 or ncols < 2 or filled < 2 as incomplete,
    first_filled <= 2 or first_filled < 0.2 * nrows or not letters or dollars > 0.8 * nrows * ncols as junk
  from t join (select doc, page, grp, md5(string_agg(line, chr(10) order by r)) as content from lines group by all)
    using (doc, page, grp)
),
"""
)

_ACCEPTED = (
    _UNIFIED
    + """
firsts as (
  select * from judged where not incomplete and not junk
  qualify row_number() over (partition by doc, page, content order by grp) = 1
),
accepted as (
  select * from firsts
  qualify content is distinct from lag(content) over (partition by doc order by page, grp)
),
"""
)

# Accepted tables when those with vectors must also be near none kept before them on their page.
_ACCEPTED_BY_VECTORS = _ACCEPTED.replace("accepted as (\n  select * from firsts\n", """
offered as (
  select doc, page, grp, embedding::double[] as v, row_number() over (partition by doc, page order by grp) as n
  from table_vectors semi join firsts using (doc, page, grp)
),
walk as (
  select doc, page, grp, n, [v] as kept, true as keep from offered where n = 1
  union all
  select doc, page, grp, n, case when near then kept else list_append(kept, v) end, not near
  from (select o.*, kept, len(list_filter(kept, lambda k: list_cosine_similarity(k, o.v) > 0.95)) > 0 as near
    from walk join offered o on o.doc = walk.doc and o.page = walk.page and o.n = walk.n + 1)
),
accepted as (
  select * from firsts anti join (select * from walk where not keep) using (doc, page, grp)
""")

_DOCUMENT = (
    _ACCEPTED
    + """
placed as (
  select *, sum(nrows + 1) over (partition by doc order by page, grp) - nrows - 1 as above,
    max(ncols) over (partition by doc) as width
  from accepted
),
document as (
  select doc, (above + r)::bigint as row_no, line || repeat('|', width - ncols) as "values"
  from lines join placed using (doc, page, grp)
  union all select doc, (above + nrows)::bigint, repeat('|', width - 1) from placed
),
"""
)

_DOCUMENT_BY_VECTORS = _ACCEPTED_BY_VECTORS + _DOCUMENT.removeprefix(_ACCEPTED)

# Header words with their group, groups `g`.
_HEADERS = r"""
headers as (
  select *, trim(txt) as word from dense_words
  where regexp_matches(trim(txt), '2023\D*24\D*$') or regexp_matches(trim(txt), '2024\D*25\D*$')
    or regexp_matches(trim(txt), '2025\D*26\D*$')
),
gaps as (
  select *, coalesce(top - lag(top) over (partition by doc, page order by top) > 12, true) as starts from headers
),
grouped as (
  select *, sum(starts::int) over (partition by doc, page order by top) as grp from gaps
),
g as (
  select *, coalesce(lead(hdr_top) over (partition by doc, page order by grp), 792.0) as next_top
  from (select doc, page, grp::bigint as grp, min(top) as hdr_top, max(bottom) as hdr_bottom, count(*) as headers
        from grouped group by all)
),
numbers as (
  select * from dense_words where regexp_matches(replace(txt, ',', ''), '^\$?-?\d[\d,]*(\.\d{2})?$|^-$')
),
spots as (
  select distinct doc, page, grp::bigint as grp, x0, x1, hdr_bottom
  from grouped join g using (doc, page, grp)
),
matched as (
  select s.doc, s.page, s.grp, s.x0, s.x1,
    case when abs(n.x0 - s.x0) <= 60 then n.x0 else (s.x0 + s.x1) / 2 end as column_x
  from spots s join numbers n on n.doc = s.doc and n.page = s.page and n.top > s.hdr_bottom
  qualify row_number() over (partition by s.doc, s.page, s.grp, s.x0, s.x1 order by abs(n.x0 - s.x0), n.top, n.x0) = 1
),
"""

_LINES = """
placed as (
  select *, round_even(top / 3, 0)::bigint as line,
    coalesce(lag(x1) over (partition by doc, page, round_even(top / 3, 0) order by x0, top, x1, txt), 0) as x_end
  from dense_words
),
lines as (
  select doc, page, line,
    string_agg(repeat(' ', greatest(trunc((x0 - x_end) / 10), 1)::bigint) || txt, '' order by x0, top, x1, txt) as text
  from placed group by all
),
"""


def oracle_sql() -> dict[str, str]:
    last = """
last as (
  select fy, ueid, position_number, benefit_id, b as ending from base
  qualify row_number() over (partition by fy, ueid, position_number, benefit_id
    order by leave_period desc, b desc nulls last, source_file desc) = 1
)"""

    def position(extra: str = "") -> str:
        return _ledger(f"""
raw as (select * from base where left(position_number, 3) not in ({_EXCLUDED}) {extra}),
{last.replace("from base", "from raw")},
moved as (
  select fy, ueid, position_number, benefit_id, sum(e) as e, sum(u) as u, sum(m) as m from raw group by all
),
bands as (
  select fy, ueid, department_name, position_number, benefit_name, benefit_id, base_pay, hourly_rate,
    sum(e) as total_earned, sum(u) as total_used, sum(m) as total_misc
  from raw group by all
) --main
select bands.*, {_BEGIN.format(end="ending")} as beginning_balance, ending as ending_balance
from bands left join last using (fy, ueid, position_number, benefit_id)
  left join moved using (fy, ueid, position_number, benefit_id)""")

    def near_duplicates(threshold: float) -> str:
        return _with("vectors", f"""
wide as (select page, ord, embedding::double[] as v from vectors),
walk as (
  select page, ord, [v] as kept, true as keep from wide where ord = 0
  union all
  select page, ord, case when near then kept else list_append(kept, v) end, not near
  from (select wide.page, wide.ord, v, kept,
      len(list_filter(kept, lambda k: list_cosine_similarity(k, v) > {threshold})) > 0 as near
    from walk join wide on wide.page = walk.page and wide.ord = walk.ord + 1)
) --main
select page, ord from walk where keep""")

    liability = _ledger(f"""
employees as (
  select fy, ueid, left(full_no, 3) as agency, org_code, sum(b) as hours, sum(b * r) as owed
  from base where june and {_REPORTED} group by all
) --main
select fy, lpad(raw_org, 4, '0') as org_code, round(hours * 4) / 4 as total_hours,
  round(owed / nullif(hours, 0) * 100) / 100 as weighted_avg_hourly_rate
from (select fy, org_code as raw_org, sum(hours) as hours, sum(owed) as owed from employees group by all)""")
    quarter = "round(sum({}) * 4) / 4"

    def in_order(name: str, order: str) -> str:
        return f"select *, row_number() over (order by {order}) as row_no from ({texts[name]})"

    by_org = "fy desc, try_cast(org_code as int) nulls last"
    texts = {
        "r1_headcount": _ledger("""
select fy, left(full_no, 3) as agency_code, org_code, count(distinct ueid) as employee_count
from base where june group by all"""),
        "r1_headcount_by_agency": _ledger("""
select fy, left(full_no, 3) as agency_code, count(distinct ueid) as employee_count
from base where june group by all"""),
        "r2_nonclas_headcount": _with("ledger non_clas", """
select fy, left(full_no, 3) as agency_code, org_code, count(distinct ueid) as employee_count
from base join non_clas using (ueid, fy) where june group by all""", base=True),
        "r3_leave_balance": _ledger(f"""
select fy, lpad(raw_org, 4, '0') as org_code, cbid, benefit_id, benefit_name, ending_balance from (
  select fy, org_code as raw_org, cbid, benefit_id, benefit_name, {quarter.format("b")} as ending_balance
  from base where june and {_REPORTED} group by all)"""),
        "r4_earned_used": _ledger(f"""
moved as (
  select fy, org_code, cbid, benefit_id, sum(e) as e, sum(u) as u, sum(m) as m
  from base where {_REPORTED} group by all
),
ended as (
  select fy, left(full_no, 3) as agency, org_code, cbid, benefit_id, benefit_name, sum(b) as b
  from base where june and {_REPORTED} group by all
) --main
select fy, lpad(raw_org, 4, '0') as org_code, * exclude (fy, raw_org) from (
  select fy, org_code as raw_org, cbid, benefit_id, benefit_name,
    {quarter.format(_BEGIN.format(end="b"))} as beginning_balance,
    {quarter.format("e")} as total_earned, {quarter.format("u")} as total_used,
    {quarter.format("m")} as total_misc, {quarter.format("b")} as ending_balance
  from ended left join moved using (fy, org_code, cbid, benefit_id) group by all)"""),
        "r4_earned_used_no_fan_out": _ledger(f"""
moved as (
  select fy, left(full_no, 3) as agency, org_code, cbid, benefit_id, benefit_name,
    sum(e) as e, sum(u) as u, sum(m) as m, sum(b) filter (june) as b, count(*) filter (june) as n
  from base where {_REPORTED} group by all
) --main
select fy, lpad(raw_org, 4, '0') as org_code, * exclude (fy, raw_org) from (
  select fy, org_code as raw_org, cbid, benefit_id, benefit_name,
    {quarter.format(_BEGIN.format(end="b"))} as beginning_balance,
    {quarter.format("e")} as total_earned, {quarter.format("u")} as total_used,
    {quarter.format("m")} as total_misc, {quarter.format("b")} as ending_balance
  from moved where n > 0 group by all)"""),
        "r5_liability": liability,
        "r6_pay_rates": _ledger("""
select fy, agency_code, org_code, avg(hourly_rate::double) as avg_pay_rate from (
  select distinct fy, left(full_no, 3) as agency_code, org_code, ueid, hourly_rate
  from base where june and time_base not in ('??', 'INT')) group by all"""),
        "r7_rollforward_agency": _ledger(f"""
known as (select * from base where time_base <> '??'),
moved as (select fy, ueid, benefit_id, sum(e) as e, sum(u) as u, sum(m) as m from known group by all),
ended as (
  select fy, ueid, left(position_number, 3) as agency_code, org_code, cbid, benefit_id, benefit_name, b
  from known where june
) --main
select fy, agency_code, org_code, cbid, benefit_id, benefit_name,
  sum({_BEGIN.format(end="b")}) as beginning_balance,
  sum(e) as total_earned, sum(u) as total_used, sum(m) as total_misc, sum(b) as ending_balance
from ended left join moved using (fy, ueid, benefit_id) group by all"""),
        "r8_rollforward_position": position(),
        "r8_one_year": position("and fy = '1997-1998'"),
        "fiscal_year": _ledger("""
select ueid, leave_period, fy, left(leave_period, 4) || '-' || (left(leave_period, 4)::int + 1) as label_fy
from base"""),
        "full_position": _ledger(f"""
select position_number, full_no as full_position_number, left(full_no, 3) as agency_code,
  left(position_number, 3) as raw_agency_code, lpad(org_code, 4, '0') as org_code,
  left(full_no, 3) not in ({_EXCLUDED}) as reported
from base"""),
        "period_date": _with("ledger", """
select leave_period, strftime(strptime(leave_period || '-01', '%Y-%m-%d'), '%Y-%m-%d') as period_date from ledger"""),
        "measures": _ledger(f"""
select ueid, leave_period, {_BEGIN.format(end="b")} as beginning_balance, b * r as liability,
  round(b / 8 * 4) / 4 as quarter_hours, round(b / nullif(m, 0) * 100) / 100 as ratio,
  try_cast(benefit_name as double) as not_a_number
from base"""),
        "yearly_activity": _ledger("""
select fy, ueid, benefit_id, sum(e) as total_earned, sum(u) as total_used, sum(m) as total_misc
from base group by all"""),
        "june_endings": _ledger("""
select fy, left(full_no, 3) as agency_code, org_code, cbid, benefit_id, benefit_name, sum(b) as end_balance
from base where june group by all"""),
        "employee_liability": _ledger("""
select fy, ueid, left(full_no, 3) as agency_code, org_code, sum(b) as hours, sum(b * r) as total_employee_liability
from base group by all"""),
        "position_totals": _ledger(f"""{last} --main
select fy, ueid, position_number, benefit_id, ending as ending_balance, sum(e) as total_earned,
  sum(u) as total_used, sum(m) as total_misc
from last join base using (fy, ueid, position_number, benefit_id) group by all"""),
        "nonnumeric_audit": _with("dirty_ledger", """
select distinct source_file from dirty_ledger
where end_balance is not null and try_cast(end_balance as double) is null"""),
        "malformed_positions": _with("dirty_ledger", """
padded as (
  select leave_period, department_name, cbid, position_number,
    case when len(position_number) in (10, 11, 12) then lpad(position_number, 13, '0') else position_number end
      as full_position_number
  from dirty_ledger
) --main
select * from padded where len(full_position_number) <> 13 order by all limit 100"""),
        "distinct_periods": _with("ledger", """
select distinct leave_period from ledger where cbid = '1-URGENT' order by 1 limit 10"""),
        "row_count": _with("ledger", "select count(*) as row_count from ledger"),
        "multi_position_employees": _ledger("""
select ueid, fy, count(distinct position_number) as position_count,
  string_agg(distinct position_number, ', ' order by position_number) as positions
from base group by all having count(distinct position_number) > 1"""),
        "distinct_combos": _ledger("""
select count(*) as distinct_combos from (select distinct ueid, fy, position_number from base)"""),
        "july_begin_june_end": _ledger("""
begins as (
  select distinct fy, ueid, position_number, benefit_id, begin_balance as beginning_balance
  from base where substr(leave_period, 6, 2) = '07'
),
ends as (
  select distinct fy, ueid, position_number, benefit_id, end_balance as ending_balance from base where june
),
bands as (
  select fy, ueid, department_name, position_number, benefit_name, benefit_id, base_pay, hourly_rate,
    sum(e) as total_earned, sum(u) as total_used, sum(m) as total_misc
  from base group by all
) --main
select * from bands left join begins using (fy, ueid, position_number, benefit_id)
  left join ends using (fy, ueid, position_number, benefit_id)"""),
        "ingest_files": _with("ledger", _PER_FILE),
        "ingest_from_files": _with("ledger", _PER_FILE),
        "ingest_ragged_files": _with("ledger", """
select source_file, ueid, department_name || chr(10) || '"unit", ' || org_code as department, end_balance,
  case when org_code like '%10' then 'late ' || cbid end as late, null::varchar as last
from ledger
union all select distinct source_file, 'wide', null, '1', 'z', 'z' from ledger"""),
        "requote": _with("ledger", """
texts as (
  select '"' || ueid || '","' || department_name || chr(10) || '""unit"", ' || org_code || '","' || end_balance || '"'
    || case when org_code like '%10' then ',"","late ' || cbid || '"' else '' end as text
  from ledger
  union all select unnest(['"Title, with' || chr(10) || 'a break"', '"ueid","department","end_balance"'])
  from (select distinct source_file from ledger)
) --main
select unnest(string_split(text, chr(10))) as value from texts"""),
        "ingest_audit_from_files": _with("ledger", """
select source_file as file_name, count(*) + 1 as original_row_count, count(*) as imported_row_count
from ledger group by all"""),
        "ingest_audit": _with("ledger", """
select source_file as file_name, count(*) as original_row_count,
  count(*) filter (hourly_rate not like '%7') as imported_row_count
from ledger group by all"""),
        "union_by_name": """
select 'customer' as "SourceSheet", c_name as name, c_mktsegment as segment, null::int as nation from customer
union all select 'supplier', s_name, null, s_nationkey from supplier""",
        "csv_integrity": _with("csv_lines", _BAD_LINES),
        "csv_integrity_preview": _with(
            "csv_lines",
            _BAD_LINES + " qualify row_number() over (partition by source_file order by line_no) <= 20",
        ),
        "part_numbers": f"""
select o_orderkey, o_totalprice, n as row_no, (n - 1) // {PART_ROWS} + 1 as part
from (select *, row_number() over (order by o_totalprice desc, o_orderkey) as n from orders)""",
        "csv_parts": f"""
select o_orderkey::varchar as o_orderkey, o_orderpriority, o_orderstatus,
  case when total <= {PART_ROWS} then 'orders.csv'
       else 'orders_pt' || ((n - 1) // {PART_ROWS} + 1) || '.csv' end as source_file
from (select *, row_number() over (order by o_orderkey desc) as n, count(*) over () as total from orders)
""",
        "ledger_table": liability,
        "replaced_table": """
select o_orderkey, o_orderstatus, o_totalprice * 2 as o_totalprice from orders where o_orderstatus <> 'P'""",
        "suffixed_parts": f"""
select o_orderkey::varchar as o_orderkey, o_orderstatus,
  o_orderstatus || '_pt' || ((row_number() over (partition by o_orderstatus order by o_orderkey) - 1) // {PART_ROWS} + 1)
    || '.csv' as source_file
from orders where o_orderstatus in ('F', 'P')""",
        "csv_integrity_files": _with("csv_lines", _BAD_LINES.replace("select source_file, line_no, value, problems", """
select source_file, place + 1 as line_no, trim(value) as value, problems""").replace("from csv_lines", """
    , row_number() over (partition by source_file order by line_no) as place from csv_lines""")),
        "csv_headers": _with("csv_lines", """
select distinct source_file as file_name, 18 as n, array_to_string(list_transform(range(18), lambda i: 'c' || i), '|') as names
from csv_lines"""),
        "sheet_catalogue": _with("catalogue", """
select distinct sheet_name, filename, filename || '|||' || sheet_name || '$''' as filepath from catalogue"""),
        "lessee_subsets": _with("catalogue", """
select *, sheet_name ilike '%journal%' and sheet_name ilike '%ls%' as is_journal_ls,
  sheet_name ilike '%ls-department note disclos%' as is_department_note,
  sheet_name ilike '%lease%' and sheet_name ilike '%ls%' as is_lease_ls
from catalogue where contains(lower(filename), chr(92) || 'lessee' || chr(92))"""),
        "required_cell": _with("cells", _FAILING + "select * from failing"),
        "quarantine_list": _with("cells", _FAILING + "select file from failing"),
        "first_row_occupied": _with("cells", """
select distinct file, sheet, file || ' - Sheet: ' || sheet as line from cells
where rw = 1 and cl in (1, 2) and val is not null"""),
        "combined_sheets": _with("cells", """
select file, sheet_no, sheet as source_sheet, rw, any_value(val) filter (cl = 1) as c1,
  any_value(val) filter (cl = 2) as c2, null::varchar as c3, null::varchar as c4, null::varchar as c5,
  any_value(val) filter (cl = 6) as c6
from cells group by all"""),
        "je_clean": _with("je", r"""
select file_no, row_no,
  last_value(je_title ignore nulls) over (partition by file_no order by row_no) as je_title,
  coalesce(amount, -1 * col_11) as amount,
  case when contains(debit_credit, 'Dr') then 'D' when contains(debit_credit, 'Cr') then 'C' else 'ERROR' end as d_c,
  coalesce(nullif(regexp_extract(debit_credit, '\d+'), ''), 'XXXX') as account_number,
  trim(regexp_replace(debit_credit, '\d+', '', 'g')) as account_name
from je"""),
        "je_from_cells": r"""
select file, sheet, row_no, last_value(title ignore nulls) over (partition by file, sheet order by row_no) as je_title,
  amount, d_c, account_number, account_name
from (
  select o_custkey::varchar as file, 'LS-JE' as sheet, 10 + o_orderkey as row_no,
    case when o_orderkey % 3 = 0 then 'JE ' || o_orderkey % 50 end as title,
    case when o_orderkey % 2 = 1 then o_orderkey % 777 else -1.0 * (o_orderkey % 1000) end::double as amount,
    ['D', 'C', 'C', 'ERROR'][o_orderkey % 4 + 1] as d_c,
    ['1' || o_orderkey % 900, '2' || o_orderkey % 900, 'XXXX', 'XXXX'][o_orderkey % 4 + 1] as account_number,
    ['Dr  Cash', 'Cr  Payable', 'Cr Suspense', 'n/a'][o_orderkey % 4 + 1] as account_name
  from orders where o_custkey % 5 <> 0)""",
        "header_words": _with("words", r"""
select * from words where regexp_matches(txt, '2023\D*24\D*$|2024\D*25\D*$|2025\D*26\D*$')"""),
        "number_words": _with("words", r"""
select * from words where regexp_matches(replace(txt, ',', ''), '^\$?-?\d[\d,]*(\.\d{2})?$|^-$')"""),
        "header_groups": _with("dense_words", _HEADERS + "--main select * from g"),
        "nearest_numeric": _with("dense_words", _HEADERS + "--main select * from matched"),
        "column_areas": _with("dense_words", _HEADERS + """
cols as (
  select doc, page, grp, list_sort(list(distinct round(column_x, 2))) as xs from matched group by all
) --main
select doc, page, grp, array_to_string(xs, '|') as columns, greatest(0.0, xs[1] - 10) as "left",
  least(612.0, xs[-1] + 10) as "right", greatest(792 - (hdr_top - 6), 792 - (next_top - 6)) as area_top,
  least(792 - (hdr_top - 6), 792 - (next_top - 6)) as area_bottom
from cols join g using (doc, page, grp)"""),
        "text_lines": _with("dense_words", _LINES + "--main select * from lines"),
        "page_text": _with("dense_words", _LINES + """--main
select doc, page, string_agg(text, chr(10) order by line) as text from lines group by all"""),
        "clean_cells": _with("table_cells", _CLEAN + """--main
select doc, page, grp, cand, r as row_no, string_agg(coalesce(v, ''), '|' order by c) as "values"
from (select doc, page, grp, cand, rr.r, cc.c from shape, unnest(range(nrows)) as rr(r), unnest(range(ncols)) as cc(c))
  left join clean using (doc, page, grp, cand, r, c) group by all"""),
        "unify_candidates": _with("table_cells", _UNIFIED + """--main
select doc, page, grp, r as row_no, line as "values" from lines"""),
        "junk_tables": _with("table_cells", _UNIFIED + """--main
select doc, page, grp, nrows, ncols::int as ncols, filled, incomplete, junk from judged"""),
        "exact_dup_tables": _with("table_cells", _UNIFIED + """--main
select doc, page, grp, nrows, ncols::int as ncols from judged
qualify row_number() over (partition by doc, page, content order by grp) = 1"""),
        "near_dup_vectors": near_duplicates(0.95),
        "near_dup_vectors_loose": near_duplicates(LOOSE_THRESHOLD),
        "near_dup_tables": """
select v.doc, v.page, v.grp
from (select vec_id, vec_id // 16 as doc, vec_id // 4 % 4 as page, 2 * (vec_id % 4) as grp from embeddings) v
where not exists (
  select 1 from embeddings e where e.vec_id < v.vec_id and e.vec_id // 4 = v.vec_id // 4 and e.vec_id // 3 = v.vec_id // 3)""",
        "consecutive_dup": _with("table_cells", _ACCEPTED + """--main
select doc, page, grp, nrows, ncols::int as ncols from accepted"""),
        "document_tables": _with("table_cells", _DOCUMENT + "--main select * from document"),
        "review_flags": _with("table_cells", _DOCUMENT + """--main
select doc, coalesce(max(split_part("values", '|', 4)) filter (row_no = 5), '') = '' as needs_review
from document group by all"""),
        "document_tables_vectors": _with("table_cells table_vectors", _DOCUMENT_BY_VECTORS + "--main select * from document"),
        "review_outcomes": _with("review_cells", _DOCUMENT.replace("table_cells", "review_cells") + """--main
select doc, coalesce(max(split_part("values", '|', 4)) filter (row_no = 5), '') = '' as needs_review
from document group by all"""),
        "text_to_columns": _with("text_cells", r"""
parts as (
  select *, string_split(regexp_replace(regexp_replace(trim(value), '\s{2,}', '|', 'g'), '\s(\$?\d)', '|\1', 'g'), '|') as p
  from text_cells
),
wide as (select *, max(len(p)) over (partition by table_no) as width from parts) --main
select table_no, row_no, array_to_string(p, '|') || repeat('|', width - len(p)) as "values" from wide"""),
        "lines_to_columns": _with("text_cells", r"""
parts as (
  select *, string_split_regex(trim(value), '\s{2,}') as p from text_cells where regexp_matches(trim(value), '\s{2,}')
),
wide as (select *, max(len(p)) over (partition by table_no) as width from parts) --main
select table_no, row_no, array_to_string(p, '|') || repeat('|', width - len(p)) as "values" from wide"""),
        "page_json_rows": _with("page_json", """
good as (select page_id, js::json as j from page_json where json_valid(js)),
body as (
  select page_id, i + 1 as line_no, j->>('$.rows[' || i || '].column_1') as column_1,
    j->>('$.rows[' || i || '].column_2') as column_2, j->>('$.rows[' || i || '].column_3') as column_3,
    j->>('$.rows[' || i || '].column_4') as column_4
  from good, unnest(range(json_array_length(j->'$.rows')::bigint)) as x(i)
) --main
select page_id, line_no::int as line_no, column_1, column_2, column_3, column_4 from body
union all select page_id, 0, trim(j->>'$.agency'), '', '', '' from good
union all select page_id, json_array_length(j->'$.rows')::int + 1, '', '', '', '' from good"""),
        "page_json_rejected": _with("page_json", "select * from page_json where not json_valid(js)"),
        "file_names": _with("catalogue", r"""
select filename, left(regexp_replace(filename, '[:\\/?*\[\]]', '_', 'g'), 31) as safe_name,
  right(replace(filename, '.xlsx', ''), 4) as agency
from catalogue"""),
    }
    return texts | {
        "r1_order": in_order("r1_headcount", "fy desc, agency_code, org_code"),
        "r4_order": in_order("r4_earned_used", f"{by_org}, cbid, benefit_id, benefit_name"),
        "r5_order": in_order("r5_liability", by_org),
        "r8_order": in_order(
            "r8_rollforward_position",
            "ueid, fy desc, position_number, benefit_id, benefit_name, department_name, base_pay, hourly_rate",
        ),
    }


_PER_FILE = """
select source_file, count(*) as row_count, count(distinct ueid) as employees, sum(end_balance::double) as end_balance,
  sum(case when source_file like '% A.%' then misc_amt::double end) as misc_amt, min(leave_period) as leave_period
from ledger group by all"""

_BAD_LINES = """
select source_file, line_no, value, problems from (
  select *, concat_ws('; ', case when commas <> 17 then 'Wrong number of columns (' || commas || ' commas)' end,
      case when len(tail) > 255 then 'source_file too long (' || len(tail) || ' chars)' end) as problems
  from (select *, len(value) - len(replace(value, ',', '')) as commas,
      trim(trim(regexp_extract(value, '[^,]*$')), '"') as tail from csv_lines)
) where problems <> ''"""

_FAILING = """
f14 as (
  select file, sheet_no, sheet, any_value(val) filter (rw = 14 and cl = 6) as val from cells
  where file not like '%R19%' and file not like '%Report 19%' and sheet not like '%Diff%' group by all
),
failing as (
  select file, sheet_no, sheet from f14 where val is null or val not like '%Beginning Balance%'
  qualify row_number() over (partition by file order by sheet_no) = 1
) --main
"""
