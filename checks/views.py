"""Views that map the general test tables onto the product's inputs.

Each text is one SELECT that Spark and DuckDB both run; ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_POSITION = """cast(case l_linenumber % 4 when 0 then 1000000000 when 1 then 10000000000
    when 2 then 100000000000 else 1000000000000 end * (l_suppkey % 9 + 1) + l_suppkey as string)"""
_PERIOD = "substr(cast(l_shipdate as string), 1, 7)"

VIEWS = {
    "ledger": f"""
select cast(o_custkey as string) as ueid,
  {_PERIOD} as leave_period,
  {_POSITION} as position_number,
  cast(160 + (o_custkey % 25) * 350 as string) as org_code,
  o_orderpriority as cbid,
  case when l_linenumber = 7 and l_partkey % 2 = 0 then '??'
       when l_linenumber = 6 and l_partkey % 2 = 0 then 'INT' else 'FT' end as time_base,
  concat('Dept ', cast(l_suppkey % 20 as string)) as department_name,
  concat(l_returnflag, l_linestatus) as benefit_id,
  concat('Benefit ', l_returnflag) as benefit_name,
  cast(3000 + (l_partkey % 50) * 100 as string) as base_pay,
  cast(20 + l_partkey % 80 as string) as hourly_rate,
  cast(l_quantity / 4 as string) as leave_earned,
  cast(l_linenumber as string) as leave_used,
  case when l_partkey % 5 = 0 then null else cast(round(l_discount * 100) - 5 as string) end as misc_amt,
  cast(l_quantity * 2 as string) as begin_balance,
  cast(l_quantity * 2.5 as string) as end_balance,
  concat({_PERIOD}, case when l_orderkey % 2 = 0 then ' A' else ' B' end, '.csv') as source_file
from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
    "dirty_ledger": f"""
select {_PERIOD} as leave_period,
  concat('Dept ', cast(l_suppkey % 20 as string)) as department_name,
  l_returnflag as cbid,
  case when l_partkey % 13 = 0 then substr({_POSITION}, 1, 9) else {_POSITION} end as position_number,
  case when l_partkey % 7 = 0 and l_suppkey % 5 = 0 then 'N/A' when l_partkey % 11 = 0 then null
       else cast(l_quantity * 2.5 as string) end as end_balance,
  concat({_PERIOD}, ' ', cast(l_suppkey as string), '.csv') as source_file
from {{lineitem}}""",
    "non_clas": """
select cast(c_custkey as string) as ueid,
  concat(cast(1994 + c_custkey % 8 as string), '-', cast(1995 + c_custkey % 8 as string)) as fy
from {customer} where c_custkey % 3 = 0""",
    "words": """
select l_orderkey as doc, 1 + l_linenumber % 2 as page,
  cast((l_partkey * 37) % 600 as double) as x0, cast((l_partkey * 37) % 600 + 20 as double) as x1,
  cast((l_suppkey * 13 + l_linenumber * 7) % 780 as double) as top,
  cast((l_suppkey * 13 + l_linenumber * 7) % 780 + 10 as double) as bottom,
  case when l_linenumber <= 2
         then concat('202', cast(l_linenumber + 2 as string), '-2', cast(l_linenumber + 3 as string), '*')
       when l_partkey % 11 = 0 then '-' when l_partkey % 7 = 0 then 'Total'
       else concat('$', cast(cast(floor(l_extendedprice) as bigint) as string)) end as txt
from {lineitem}""",
    "dense_words": """
select l_orderkey // 300 as doc, l_partkey % 40 as page,
  (l_partkey * 37 + l_suppkey * 11) % 6000 / 10.0e0 as x0,
  (l_partkey * 37 + l_suppkey * 11) % 6000 / 10.0e0 + 20 as x1,
  cast((l_orderkey * 7 + l_suppkey * 13) % 780 as double) as top,
  cast((l_orderkey * 7 + l_suppkey * 13) % 780 + 10 as double) as bottom,
  case when (l_orderkey * 7 + l_suppkey * 13) % 780 % 90 <= 8 and l_linenumber <= 4 then '2024-25*'
       when l_partkey % 7 = 0 then 'Total'
       else concat('$', cast(cast(floor(l_extendedprice) as bigint) as string)) end as txt
from {lineitem}""",
    "cells": """
select concat('BU', cast(s_suppkey as string), case when s_suppkey % 9 = 0 then ' R19.xlsx' else ' R18.xlsx' end) as file,
  concat(case when k = 3 then 'Diff ' else 'Sheet ' end, cast(k as string)) as sheet, k as sheet_no, rw, cl,
  case when rw = 14 then (case when (s_suppkey + k) % 4 = 0 then null
                               when (s_suppkey + k) % 4 = 1 then 'Ending' else 'FY Beginning Balance' end)
       when (s_suppkey + k) % 5 = 0 then 'title' else null end as val
from {supplier} cross join (values (1), (2), (3)) as ks(k) cross join (values (1, 1), (1, 2), (14, 6)) as cs(rw, cl)""",
    "je": """
select o_custkey as file_no, o_orderkey as row_no,
  case when o_orderkey % 3 = 0 then concat('JE ', cast(o_orderkey % 50 as string)) else null end as je_title,
  case o_orderkey % 4 when 0 then concat('Dr 1', cast(o_orderkey % 900 as string), ' Cash')
    when 1 then concat('Cr 2', cast(o_orderkey % 900 as string), ' Payable 7')
    when 2 then 'Cr Suspense' else 'n/a' end as debit_credit,
  case when o_orderkey % 2 = 0 then null else o_totalprice end as amount,
  cast(o_orderkey % 1000 as double) as col_11
from {orders}""",
    # Journal sheets under eight rows of titles. Headings are in row 9, mirrored in every second
    # file; every fifth file lacks the column of sides.
    "je_cells": """
select cast(o_custkey as string) as file, 'LS-JE' as sheet, cast(10 + o_orderkey as bigint) as rw,
  case when o_custkey % 2 = 0 then k else 5 - k end as cl,
  case k when 1 then (case when o_orderkey % 3 = 0 then concat('JE ', cast(o_orderkey % 50 as string)) else null end)
    when 2 then (case o_orderkey % 4 when 0 then concat('Dr 1', cast(o_orderkey % 900 as string), ' Cash')
      when 1 then concat('Cr 2', cast(o_orderkey % 900 as string), ' Payable 7')
      when 2 then 'Cr Suspense' else 'n/a' end)
    when 3 then (case when o_orderkey % 2 = 0 then null else cast(o_orderkey % 777 as string) end)
    else cast(o_orderkey % 1000 as string) end as val
from {orders} cross join (values (1), (2), (3), (4)) as ks(k)
union all
select distinct cast(o_custkey as string), 'LS-JE', cast(rw as bigint), case when o_custkey % 2 = 0 then k else 5 - k end,
  case when rw < 9 then 'Debit/Credit' when k = 1 then 'JE_Title' when k = 3 then 'Amount' when k = 4 then '11'
       when o_custkey % 5 = 0 then 'Side' else 'Debit/Credit' end
from {orders} cross join (values (1), (2), (3), (4)) as ks(k) cross join (values (1), (8), (9)) as rs(rw)""",
    "catalogue": """
select concat('/w', chr(92), case when s_suppkey % 3 = 0 then 'Lessee' when s_suppkey % 3 = 1 then 'lessor' else 'LESSEE' end,
    chr(92), cast(s_suppkey as string), '.xlsx') as filename,
  sheet_name
from {supplier} cross join (values ('LS-Fund Journal Entries'), ('LS-Department Note disclosure'), ('Lease LS'), ('Cover'))
  as names(sheet_name)""",
    "page_json": """
select o_orderkey as page_id,
  case when o_orderkey % 7 = 0 then '{{bad'
       else concat('{{"agency":" ', cast(o_custkey as string), ' X ","page":', cast(o_orderkey % 5 as string),
         ',"rows":[{{"column_1":"', o_orderpriority, '","column_2":"', cast(o_orderkey as string),
         '","column_3":"","column_4":"-"}}]}}') end as js
from {orders}""",
    # Sixteen orders make one table of 4 x 4 cells, eight tables a page, four pages a document.
    # Candidate 1 lacks the last column; candidate 2 has blank rows between and padded first cells,
    # and in one group its last column has another label.
    "table_cells": """
select doc, page, grp, cand, case when cand = 2 then 2 * r else r end as row_no,
  case when cand = 2 and grp = 3 and c = 3 then 4 else c end as col_no,
  case when cand = 2 and c = 0 then concat('\u00a0 ', value, ' ') else value end as value
from (
  select doc, page, grp, r, c,
    case when grp = 4 and c > 0 then null
         when grp = 5 and c = 0 then null
         when grp = 6 and r > 0 then ' '
         when grp = 7 then concat('Total $', cast(r as string))
         when c = 0 then concat('Fund ', cast(kind as string), ' row ', cast(r as string))
         when c = 1 and doc % 2 = 0 then concat('$', cast(100 + kind as string))
         when c = 2 then '-' else cast(kind as string) end as value
  from (
    select o_orderkey // 512 as doc, (o_orderkey // 128) % 4 as page, (o_orderkey // 16) % 8 as grp,
      (o_orderkey // 4) % 4 as r, o_orderkey % 4 as c,
      case when (o_orderkey // 128) % 4 = 1 then 2 else (o_orderkey // 16) % 8 % 3 end as kind
    from {orders})
) cross join (values (0), (1), (2)) as cs(cand)
where not (cand = 1 and c = 3)""",
    "vectors": """
select vec_id // 10 as page, cast(vec_id % 10 as int) as ord, vec_id, embedding from {embeddings}""",
    # A vector for every second table; every three in a row share one.
    "table_vectors": """
select e.vec_id // 16 as doc, e.vec_id // 4 % 4 as page, 2 * (e.vec_id % 4) as grp, s.embedding
from {embeddings} e join {embeddings} s on s.vec_id = e.vec_id - e.vec_id % 3""",
    "csv_lines": """
select concat('part ', o_orderstatus, '.csv') as source_file, o_orderkey + 2 as line_no,
  concat(cast(o_orderkey as string), repeat(',x', 15), case when o_custkey % 50 = 0 then ',extra' else '' end,
    case when o_custkey % 40 = 0 then '' else ',y' end,
    ',"', case when o_orderkey % 61 = 0 then repeat('f', cast(250 + o_custkey % 10 as int)) else 'leave.csv' end, '" ') as value
from {orders}""",
    "text_cells": """
select o_orderkey // 100 as table_no, o_orderkey as row_no,
  concat(o_orderpriority, case when o_orderkey % 3 = 0 then '  ' else ' ' end,
    case when o_orderkey % 2 = 0 then '$' else '' end, cast(o_orderkey % 977 as string),
    case when o_orderkey % 5 = 0 then '   end note' else ' 7' end) as value
from {orders}""",
}

# Tables whose second row lacks its last cell in every second document.
VIEWS["review_cells"] = f"""
select doc, page, grp, cand, row_no, col_no,
  case when doc % 2 = 0 and row_no in (1, 2) and col_no = 3 then null else value end as value
from ({VIEWS["table_cells"]})"""

TABLES = ("lineitem", "orders", "customer", "supplier", "embeddings", "part", "documents", "pages")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One mapped input as a DataFrame."""
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.replace("//", " div "), **used)


def duckdb_view(name: str) -> str:
    """The same input as text for DuckDB."""
    return VIEWS[name].format(**{t: t for t in TABLES})
