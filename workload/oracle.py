"""SQL counterparts of the registered queries.

Derived dirty data is given by what it stands for, not by parsing it, so the SQL checks the parsers.
"""

from __future__ import annotations

from itertools import combinations

from terrace import constants as K

# --- what the derived orders mean --------------------------------------------------------------------

_CENTS = "cast(round(o_totalprice * 100) as bigint)"
_AMOUNT = f"""case
  when o_orderkey % 10 = 2 then -({_CENTS} / 100.0)
  when o_orderkey % 10 <= 6 then {_CENTS} / 100.0
  when o_orderkey % 10 <= 8 then cast({_CENTS} // 100 as double) end"""
_PRIORITY = """case when o_orderkey % 7 = 0 then null when o_orderkey % 7 = 1 then '  '
  else '  ' || o_orderpriority || chr(9) || ' ' end"""
_BARE_PRIORITY = """case when o_orderkey % 7 = 0 then null when o_orderkey % 7 = 1 then ''
  else o_orderpriority end"""
_STATUS = "case when o_orderkey % 11 <> 0 then o_orderstatus end"
_DIRTY = f"""(select o_orderkey, o_custkey, o_totalprice, o_orderdate, cast({_AMOUNT} as double) as amount,
  {_PRIORITY} as priority, {_BARE_PRIORITY} as bare_priority, {_STATUS} as status from orders)"""


def _issues(*rules: tuple[str, str]) -> str:
    texts = ", ".join(f"case when {test} then '{text}' end" for test, text in rules)
    return f"coalesce(nullif(concat_ws('; ', {texts}), ''), 'PASS')"


_NOT_F_OR_O = "coalesce(upper(status) not in ('F', 'O'), true)"

VALIDATION = {
    "validate_flag": f"""
        select o_orderkey, amount, o_orderdate as tx_date, {_issues(
            ("trim(coalesce(bare_priority, '')) = ''", "Missing priority"),
            ("amount is null", "Invalid number in amount"),
            ("amount < 1000", "amount < 1000.0"),
            ("amount > 400000", "amount > 400000.0"),
            (_NOT_F_OR_O, "Invalid enum status"),
            ("month(o_orderdate) >= 10", "Regex mismatch tx_date"),
        )} as _validation_issues from {_DIRTY} d""",
    "validate_drop": f"""
        select o_orderkey, amount, priority, status from {_DIRTY} d
        where trim(coalesce(bare_priority, '')) <> '' and amount between 1000 and 400000
          and status in ('F', 'O')""",
    "validate_rejects": f"""
        select o_orderkey, amount, status from {_DIRTY} d
        where amount is null or amount > 400000 or status is null""",
    "validate_compare": f"""
        with checked as (select {_issues(
            ("abs(round(l_extendedprice * (1 - l_discount), 2) - l_extendedprice) > 2500",
             "Mismatch net vs l_extendedprice"),
            ("abs(l_discount - l_tax) > 0.03", "Mismatch l_discount vs l_tax"),
        )} as _validation_issues from lineitem)
        select _validation_issues, count(*) as rows from checked group by 1""",
    "validate_unique": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
          case when count(*) over (partition by l_orderkey) > 1 then 'Duplicate l_orderkey'
          else 'PASS' end as _validation_issues from lineitem""",
    "outlier_iqr": """
        with b as (select quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 from events)
        select event_id, value, case when q3 > q1 and (value < q1 - 1.5 * (q3 - q1)
          or value > q3 + 1.5 * (q3 - q1)) then 'Outlier value' else 'PASS' end as _validation_issues
        from events, b""",
    "outlier_zscore": """
        with b as (select avg(value) m, stddev_samp(value) s from events)
        select event_id, value, case when s > 0 and abs(value - m) / s > 2.5 then 'Outlier value'
          else 'PASS' end as _validation_issues from events, b""",
}

CLEANING = {
    "status_summary": """
        select o_orderstatus, round(sum(o_totalprice), 2) as total, count(*) as count,
          round(avg(o_totalprice), 4) as avg from (select distinct * from orders) group by 1""",
    "clean_currency": f"select o_orderkey, amount from {_DIRTY} d",
    "strip_dedup": f"select distinct bare_priority as priority, status from {_DIRTY} d",
    "infer_types": f"""
        select o_orderkey, amount, coalesce(amount, 0.0) as debit_idr, o_orderdate as tx_date,
          nullif(bare_priority, '') as priority, cast(null as double) as saldo from {_DIRTY} d""",
    "date_formats": "select o_orderkey, date_trunc('day', o_orderdate)::timestamp as parsed from orders",
    "fill_nulls_constant": f"""
        select o_orderkey, coalesce(priority, 'none given') as priority,
          coalesce(status, 'none given') as status from {_DIRTY} d""",
    "fill_nulls_template": f"""
        select o_orderkey, o_custkey, coalesce(priority, '-') as priority,
          coalesce(status, 'REVIEW_' || o_orderkey || '_None_{{nope}}') as status from {_DIRTY} d""",
    "harden_types": f"""
        select o_orderkey, amount as total_amount, o_orderdate as tx_date, status from {_DIRTY} d""",
}

SHAPING = {
    "categorize_tiers": """
        select o_orderkey, case when o_totalprice >= 320000 then 'high'
          when o_totalprice >= 250000 and o_totalprice < 280000 then '250000-280000'
          when o_totalprice >= 100000 and o_totalprice < 300000 then 'mid'
          when o_totalprice < 100000 then 'low' else 'Unknown' end as tier from orders""",
    "categorize_conditions": """
        select event_id, case when event_type = 'error' then 'Error'
          when value >= 20 and value < 100 then 'Medium' when value < 20 then 'Low'
          else 'Unknown' end as value_tier from events""",
    "calc_filter": """
        select l_orderkey, l_linenumber, l_partkey, l_quantity as quantity,
          l_returnflag || '-' || l_linestatus as flags,
          round(l_extendedprice * (1 - l_discount), 4) as net from lineitem
        where l_quantity > 45 and l_returnflag in ('A', 'R')
          and l_extendedprice * (1 - l_discount) <> 0""",
    "cast_columns": """
        select o_orderkey, cast(o_custkey as varchar) as o_custkey,
          cast(null as double) as o_orderpriority,
          cast(left(o_orderpriority, 1) as bigint) as rank from orders""",
    "filters_all_ops": """
        select 'equals' as operator, count(*) as rows from part where p_brand = 'Brand#2'
        union all select 'not_equals', count(*) from part where p_size <> 11
        union all select 'greater', count(*) from part where p_retailprice >= 1000
        union all select 'less', count(*) from part where p_size <= 20
        union all select 'between', count(*) from orders where o_totalprice between 1000 and 90000
        union all select 'in', count(*) from orders where o_orderstatus in ('F', 'P')
        union all select 'contains', count(*) from part where p_name ilike '%RED%'
        union all select 'ignored', count(*) from events""",
    "filters_combined": """
        select o_orderkey, o_totalprice from orders
        where o_orderdate between '1996-01-01' and '1998-12-31' and o_orderstatus <> 'P'
          and o_orderpriority ilike '%high%'""",
    "table_search_page": """
        select * from part where concat_ws(' ', p_partkey, lower(p_name), lower(p_brand),
          lower(p_type), p_size, p_retailprice) like '%bolt%'
        order by p_retailprice desc, p_partkey limit 20 offset 20""",
    "sort_rows_nulls_last": f"select o_orderkey, status, o_custkey from {_DIRTY} d",
    "sort_first_rows": f"""
        select * from (select o_orderkey, status, o_custkey, 'down' as direction from {_DIRTY} d
            order by status desc nulls last, o_custkey desc, o_orderkey desc limit 500)
        union all select * from (select o_orderkey, status, o_custkey, 'up' as direction from {_DIRTY} d
            order by status nulls last, o_custkey, o_orderkey limit 500)""",
    "export_csv_back": f"select o_orderkey, coalesce(priority, '') as priority, coalesce(status, '') as status from {_DIRTY} d",
    "archive_back": f"select o_orderkey, status from {_DIRTY} d",
    "topn_customers": """
        select o_custkey, round(sum(o_totalprice), 2) as total, count(*) as orders
        from orders group by 1 order by sum(o_totalprice) desc limit 10""",
    "union_missing_columns": """
        select c_name as name, c_acctbal as balance, c_mktsegment, null::integer as s_nationkey
        from customer union all select s_name, s_acctbal, null, s_nationkey from supplier""",
}

_LEFT = """(select o_orderkey, case when o_orderkey % 9 <> 0 then o_custkey end as k,
  o_totalprice as amount from orders)"""
_RIGHT = """(select case when c_custkey <> 5 then c_custkey end as k, c_name,
  c_acctbal as amount from customer)"""
JOINS = {
    f"join_{how}": f"""
        select {key} as k, o_orderkey, a.amount as amount_x, c_name, b.amount as amount_y
        from {_LEFT} a {how} join {_RIGHT} b on a.k is not distinct from b.k"""
    for how, key in (
        ("left", "a.k"), ("inner", "a.k"), ("right", "b.k"), ("full", "coalesce(a.k, b.k)"),
    )
}
JOINS["join_composite"] = """
    select l_partkey as part, l_suppkey as supplier, count(*) as lines, max(l_quantity) as most
    from lineitem group by 1, 2"""

AGGREGATES = {
    f"rollup_{name}": f"""
        select date_trunc('{unit}', o_orderdate)::timestamp as {name},
          round(sum(o_totalprice), 2) as total, count(*) as count, round(avg(o_totalprice), 8) as avg
        from orders group by 1"""
    for name, unit in (("daily", "day"), ("weekly", "week"), ("monthly", "month"))
}
_PIVOTED = ", ".join(
    f"round(coalesce(sum(o_totalprice) filter (o_orderpriority like '{n}-%'), 0), 2) as p{n}"
    for n in range(1, 6)
)
AGGREGATES |= {
    "pivot_status_priority": f"select o_orderstatus, {_PIVOTED} from orders group by 1",
    "pivot_fixed_columns": """
        select l_returnflag, nullif(count(*) filter (l_linestatus = 'F'), 0) as "F",
          nullif(count(*) filter (l_linestatus = 'O'), 0) as "O" from lineitem group by 1""",
    "agg_null_semantics": """
        with o as (select case when o_orderkey % 11 <> 0 then o_orderpriority end as priority,
          case when o_orderpriority <> '5-LOW' then o_totalprice end as price from orders)
        select priority, round(coalesce(sum(price), 0), 2) as total, count(*) as rows,
          count(price) as priced, min(price) as low, max(price) as high, round(avg(price), 4) as mean
        from o where priority is not null group by 1""",
    "agg_global": """
        select min(l_extendedprice) as min, max(l_extendedprice) as max,
          round(avg(l_extendedprice), 4) as avg, round(sum(l_extendedprice), 2) as sum,
          count(*) as count from lineitem""",
    "table_counts": f"""
        select count(*) as rows, cast(8 as bigint) as columns,
          count(*) - count(priority) as null_priority, count(*) - count(status) as null_status
        from {_DIRTY} d""",
    "table_counts_all": f"""
        with c as (select count(*) as rows, count(*) - count(priority) as p, count(*) - count(status) as s from {_DIRTY} d)
        select name as "column", place, rows, cast(8 as bigint) as columns,
          case name when 'priority' then p when 'status' then s when 'saldo' then rows else 0 end as nulls
        from c, (values ('o_orderkey', 1), ('amount', 2), ('debit_idr', 3), ('tx_date', 4), ('priority', 5), ('status', 6),
          ('o_custkey', 7), ('saldo', 8)) v(name, place)""",
}

# The dirty orders have eight columns: key, amount, debit, date, priority, status, customer, saldo.

_BRAND_TOTAL = "select p_brand, sum({v}) as v from part group by 1"
DASHBOARDS = {
    "kpi_cards": """
        select 'sum' as card, round(sum(o_totalprice), 2) as value from orders
        union all select 'avg', round(avg(o_totalprice), 2) from orders
        union all select 'count', count(*) from orders
        union all select 'filtered', round(max(o_totalprice), 2) from orders where o_orderstatus = 'F'
        union all select 'numeric_filter', count(o_orderkey) from orders where o_custkey = 370
        union all select 'unknown', round(sum(o_totalprice), 2) from orders""",
    "board_one_scan": """
        select 'total' as card, null as label, round(sum(o_totalprice), 2) as value from orders
        union all select 'average', null, round(avg(o_totalprice), 2) from orders where o_orderstatus = 'F'
        union all select 'orders', null, count(*) from orders
        union all select 'one customer', null, count(o_orderkey) from orders where o_custkey = 370
        union all select 'nobody', null, sum(o_totalprice) from orders where o_custkey = -1
        union all select 'by priority', o_orderpriority, count(*) from orders group by 2
        union all select 'by status', o_orderstatus, round(sum(o_totalprice), 2) from orders group by 2
        union all select 'urgent by day', cast(o_orderdate as varchar), round(max(o_totalprice), 2) from orders
            where o_orderpriority = '1-URGENT' group by 2""",
    "chart_bar": """
        select o_orderpriority as name, count(*) as value from orders group by 1 order by 2 desc, 1""",
    "chart_pie": """
        select p_brand as name, round(sum(p_retailprice), 2) as value from part
        where p_type = 'ECONOMY' group by 1 order by 2 desc""",
    "chart_line": """
        select o_orderdate as name, round(avg(o_totalprice), 8) as value from orders
        group by 1 order by 1""",
    "distinct_values": """
        select distinct o_custkey as value from orders where o_custkey is not null
        order by 1 limit 100""",
    "auto_dashboard": """
        select 'Total p retailprice' as card, null as label, round(sum(p_retailprice), 2) as value
        from part
        union all select 'Total p partkey', null, sum(p_partkey) from part
        union all select 'p retailprice by p brand', p_brand, round(sum(p_retailprice), 2)
          from part group by p_brand
        union all select 'p brand Distribution', p_brand, sum(p_partkey) from part group by p_brand
        union all select 'Total Rows', null, count(*) from part
        union all select 'Columns', null, 3""",
    "auto_report": """
        select 'Total o totalprice' as card, null as label, round(sum(o_totalprice), 2) as value
        from orders
        union all select 'Total Records', null, count(*) from orders
        union all (select 'o totalprice by o orderpriority', o_orderpriority,
          round(sum(o_totalprice), 2) from orders group by o_orderpriority
          order by sum(o_totalprice) desc limit 20)
        union all select 'Distribution by o orderstatus', o_orderstatus, count(*)
          from orders group by o_orderstatus
        union all select 'o totalprice over Time', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'),
          round(sum(o_totalprice), 2) from orders group by o_orderdate""",
    "report_detail": "select * from orders order by o_orderkey limit 100",
    "read_only_sql": """
        select p_type, count(*) as parts, round(avg(p_size), 4) as size from part
        group by p_type order by p_type limit 20""",
    # Of the price texts only "1.234" and "123" look like plain numbers.
    "display_numbers": f"""
        with w as (select o_orderkey, o_custkey / 7 as ratio, case when o_orderkey % 10 in (7, 8)
          then {_CENTS} // 100 end as whole from orders)
        select o_orderkey, case when whole < 1000 then whole::double
          when whole < 1000000 then whole / 1000.0 end::double as amount_number,
          case when length(cast(ratio as varchar)) <= 20 then round(ratio, 6) end as ratio_number from w""",
}


def _quality(source: str, columns: int, numbers: list[str], presents: list[str]) -> str:
    """Quality score in SQL over a subquery with named numeric columns."""
    fences = ", ".join(
        f"quantile_cont({n}, 0.25) as {n}_q1, quantile_cont({n}, 0.75) as {n}_q3, count({n}) as {n}_n"
        for n in numbers
    )
    outliers = " + ".join(
        f"(case when {n}_n > 3 and {n}_q3 > {n}_q1 and ({n} < {n}_q1 - 1.5 * ({n}_q3 - {n}_q1) "
        f"or {n} > {n}_q3 + 1.5 * ({n}_q3 - {n}_q1)) then 1 else 0 end)"
        for n in numbers
    )
    cells = " + ".join(f"count({p})" for p in presents)
    return f"""
        with src as {source},
        b as (select {fences} from src),
        c as (select count(*) as rows, {cells} as cells from src),
        o as (select sum({outliers}) as outliers from src, b),
        d as (select count(*) as uniq from (select distinct * from src)),
        p as (select round(cells / (rows * {columns}) * 100.0, 2) as completeness,
          round(uniq / rows * 100.0, 2) as uniqueness, 100.0::double as consistency,
          100.0::double as freshness,
          greatest(0.0, round(100.0 - outliers / (rows * {len(numbers)}) * 100.0, 2)) as accuracy
          from c, o, d),
        s as (select round(completeness * 0.30 + uniqueness * 0.20 + consistency * 0.20
          + freshness * 0.15 + accuracy * 0.15, 1) as score, * from p)
        select *, case when score < 50 then 'Poor' when score < 70 then 'Fair'
          when score < 90 then 'Good' else 'Excellent' end as badge from s"""


_LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]


def _facts(source: str, columns: int, numbers: list[str], texts: list[str]) -> str:
    """Insight rows in SQL over a subquery."""
    parts = [f"select 'size' as kind, null as \"column\", null as column2, count(*)::double as value from {source} s"]
    for n in numbers[:3]:
        parts += [
            f"select '{k}', '{n}', null, {f}({n})::double from {source} s"
            for k, f in (("mean", "avg"), ("max", "max"), ("min", "min"))
        ]
    for n in numbers[:2]:
        parts.append(
            f"select 'outliers', '{n}', null, count(*)::double from {source} s, "
            f"(select quantile_cont({n}, 0.25) q1, quantile_cont({n}, 0.75) q3 from {source} t) b "
            f"where q3 > q1 and ({n} < q1 - 1.5 * (q3 - q1) or {n} > q3 + 1.5 * (q3 - q1)) "
            f"having count(*) > 0"
        )
    for a, b in combinations(numbers, 2):
        parts.append(
            f"select 'correlation', '{a}', '{b}', corr({a}, {b}) from {source} s "
            f"having abs(corr({a}, {b})) >= 0.7"
        )
    for t in texts[:2]:
        parts.append(
            f"select * from (select 'category', '{t}', {t}, count(*)::double from {source} s "
            f"where {t} is not null group by {t} order by count(*) desc, {t} limit 1) c{t}"
        )
    rows = " union all ".join(parts)
    return f'select kind, "column", column2, round(value, 4) as value from ({rows}) f'


def _trend(source: str, date: str, value: str, horizon: int) -> str:
    """Future rows of a linear trend in SQL."""
    return f"""
        p as (select {date} as t, {value} as y,
          row_number() over (order by {date}, {value}) - 1 as x from {source}),
        f as (select regr_slope(y, x) as a, regr_intercept(y, x) as b, count(*) as n,
          max(t) as last from p),
        e as (select stddev_pop(y - (a * x + b)) as s from p, f),
        g as (select last + to_days(cast(i as integer)) as t, a * (n + i - 1) + b as y, s
          from f, e, (select unnest(generate_series(1, {horizon})) as i))"""


def _sentiment(text: str) -> str:
    def hits(words):
        return " + ".join(f"contains(lower({text}), '{w}')::int" for w in words)

    balance = f"(({hits(K.POSITIVE_WORDS)}) - ({hits(K.NEGATIVE_WORDS)}))"
    return f"""case when {balance} > 0 then 'POSITIF' when {balance} < 0 then 'NEGATIF'
        else 'NETRAL' end"""


ANALYTICS = {
    "quality_score": _quality(
        "(select * from lineitem)", 11, _LINE_NUMBERS,
        [*_LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"],
    ),
    "quality_score_dirty": _quality(
        "(select event_type, case when event_type <> 'error' then round(value, 0) end as value, "
        "user_id from events)", 3, ["value", "user_id"], ["event_type", "value", "user_id"],
    ),
    "insight_facts": _facts(
        "(select *, p_retailprice * 2 - p_size as p_cost from part)", 7,
        ["p_partkey", "p_size", "p_retailprice", "p_cost"], ["p_name", "p_brand", "p_type"],
    ),
    "insight_outliers": _facts("(select value, event_type from events)", 2, ["value"], ["event_type"]),
    "correlation_pairs": " union all ".join(
        f"select '{a}' as \"column\", '{b}' as column2, round(corr({a}, {b}), 6) as r from lineitem"
        for a, b in combinations(_LINE_NUMBERS, 2)
    ),
    "most_frequent_value": """
        select l_shipdate as value, count(*) as rows from lineitem group by 1
        order by 2 desc, 1 limit 1""",
    "anomaly_zscore": """
        with s as (select event_id, case when event_type <> 'signup' then value end as value,
          user_id from events),
        m as (select median(value) as mv, median(user_id) as mu from s),
        i as (select event_id, value, coalesce(value, mv) as v, coalesce(user_id, mu)::double as u
          from s, m),
        d as (select avg(v) as av, stddev_samp(v) as sv, avg(u) as au, stddev_samp(u) as su from i),
        z as (select event_id, value,
          least(greatest(abs(v - av) / sv, abs(u - au) / su) / 3.0, 1.0) as score from i, d)
        select event_id, value, round(score, 4) as _anomaly_score,
          case when score > 0.8 then 'ANOMALY' when score > 0.5 then 'SUSPICIOUS'
          else 'NORMAL' end as _anomaly_label from z""",
    "forecast_linear": f"""
        with {_trend("events", "ts", "value", 14)}
        select event_id, ts, value, null::double as value_forecast, null::double as value_lower,
          null::double as value_upper from events
        union all select null, t, null, round(y, 2), round(y - 1.96 * s, 2), round(y + 1.96 * s, 2)
        from g""",
    "forecast_tied_dates": f"""
        with {_trend("orders", "o_orderdate", "o_totalprice", 30)}
        select t as o_orderdate, round(y, 2) as o_totalprice_forecast,
          round(y - 1.96 * s, 2) as o_totalprice_lower, round(y + 1.96 * s, 2) as o_totalprice_upper
        from g""",
    "classify_text": f"select doc_id, {_sentiment('text')} as sentiment_label from documents",
    "classify_turns": f"""
        select conv_id, turn, case when role = 'system' then 'NETRAL' else {_sentiment('text')} end
          as topic_label from conversations""",
}

_DIGITS = "lpad(cast(c_custkey as varchar), 10, '0')"
GOVERNANCE = {
    "mask_pii": f"""
        select c_custkey,
          case c_custkey % 5
            when 0 then 'u' || repeat('*', 2 + length(cast(c_custkey as varchar)))
              || right(cast(c_custkey as varchar), 1) || '@mail.id'
            when 1 then 'a*@mail.id' when 2 then 'z*@mail.id' when 3 then 'no mail' end
            as email_address,
          case c_custkey % 5
            when 0 then left('08' || {_DIGITS}, 4) || '****' || right({_DIGITS}, 4)
            when 1 then '123456' when 2 then '1234****4567' when 3 then '0812****2345' end as phone,
          case c_custkey % 5 when 0 then '3201' || repeat('*', 12) when 1 then '123456789'
            when 2 then '1234******' end as nik,
          case c_custkey % 5 when 0 then '4111-****-****-' || right({_DIGITS}, 4)
            when 1 then '1234 567-8901' when 2 then '1234-****-****-9012' end as card_no
        from customer""",
    "platform_metrics": """
        with r as (select case event_type when 'error' then 'FAILED' when 'signup' then 'RUNNING'
          else 'SUCCESS' end as status, value,
          case when event_type <> 'signup' then user_id * 10 end as done from events),
        m as (
          select 'PIPELINE_SUCCESS_RATE' as metric, cast(floor(
            count(*) filter (status = 'SUCCESS') / count(*) * 100 + 0.5) as bigint) as value from r
          union all select 'TOTAL_ROWS_PROCESSED', cast(sum(done) as bigint) from r
          union all select 'AVG_PIPELINE_DURATION',
            cast(floor(avg(value) filter (status = 'SUCCESS') + 0.5) as bigint) from r
          union all select 'FAILED_PIPELINE_RUNS', count(*) filter (status = 'FAILED') from r)
        select metric, value, scope from m, (values ('all'), ('tenant')) s(scope)
        union all select 'TOTAL_DATA_SOURCES', count(*), 'all' from supplier
        union all select 'TOTAL_DATA_SOURCES', count(*), 'tenant' from supplier where s_nationkey = 0
        union all select 'ACTIVE_PIPELINES', count(*), 'all' from part where p_size > 25
        union all select 'ACTIVE_PIPELINES', count(*), 'tenant' from part
          where p_size > 25 and p_size % 3 = 0
        union all select 'TOTAL_AUDIT_EVENTS', count(*), 'all' from conversations
        union all select 'TOTAL_AUDIT_EVENTS', count(*), 'tenant' from conversations""",
    "latest_run_per_pipeline": """
        select user_id as "pipelineId", ts as "createdAt", event_id as id,
          case event_type when 'error' then 'FAILED' when 'signup' then 'RUNNING'
          else 'SUCCESS' end as status
        from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
    "audit_page": """
        select event_id as id, ts as "createdAt", user_id from events where event_type = 'purchase'
        order by ts desc, event_id desc limit 50 offset 25""",
    "audit_total": "select count(*) as total from events where event_type = 'click'",
    "layer_overview": """
        select 'bronze' as layer, count(*) filter (o_orderstatus = 'F') as tables from orders
        union all select 'silver', count(*) filter (o_orderstatus = 'O') from orders
        union all select 'gold', 0 from orders having count(*) > 0""",
    "recent_items": "select event_id, ts, event_type from events order by ts desc, event_id limit 5",
}

_WIDTHS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
    "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3,
    "conversations": 4,
}
_BATCH = """(select o_orderkey, o_orderstatus,
  case when o_orderpriority <> '5-LOW' then round(o_totalprice + 1, 2) end as price, 'late' as note
  from orders where o_orderstatus <> 'F')"""
_MERGED = f"""
    select coalesce(t.o_orderkey, b.o_orderkey) as o_orderkey,
      coalesce(b.o_orderstatus, t.o_orderstatus) as o_orderstatus,
      case when b.o_orderkey is not null then b.price else t.o_totalprice end as o_totalprice,
      t.o_orderpriority, b.note
    from (select * from orders where o_orderstatus <> 'P') t
    full join {_BATCH} b on t.o_orderkey = b.o_orderkey"""
TABLES = {
    "table_discovery": " union all ".join(
        f"select '{t}' as table_name, cast({n} as bigint) as column_count, count(*) as row_count from {t}"
        for t, n in _WIDTHS.items()
    ),
    "source_profile": "select count(*) as rows_count, cast(5 as bigint) as columns_count from documents",
    "table_total": "select count(*) as total from orders",
    "table_schema": """
        select position, name, type, rows from (values (0, 'event_id', 'INTEGER'),
          (1, 'ts', 'TIMESTAMP'), (2, 'user_id', 'INTEGER'), (3, 'event_type', 'VARCHAR'),
          (4, 'value', 'DECIMAL'), (5, 'props', 'VARCHAR')) t(position, name, type),
          (select count(*) as rows from events) c""",
    "csv_scan": """
        select cast(c_custkey as varchar) as c_custkey, c_name,
          cast(c_nationkey as varchar) as c_nationkey, cast(c_acctbal as varchar) as c_acctbal,
          c_mktsegment from customer""",
    "csv_bad_rows": """
        select cast(o_orderkey as varchar) as key, case when o_orderpriority <> '5-LOW'
          then o_orderstatus || ',' end as status
        from orders where o_orderpriority not in ('2-HIGH', '1-URGENT')""",
    "csv_latin1_late": """
        select cast(c_custkey as varchar) as c_custkey,
          c_name || case when c_custkey > 1000 then ' José' else '' end as c_name from customer""",
    "stream_bad_rows": """
        select cast(o_orderkey as varchar) as key, case when o_orderpriority <> '5-LOW'
          then o_orderstatus || ',' end as status, 4 as _source_id
        from orders where o_orderpriority not in ('2-HIGH', '1-URGENT')""",
    "append_widen": """
        select cast(o_orderkey as integer) as o_orderkey, o_custkey * f as n
        from orders, (values (cast(1 as bigint)), (3000000000), (-1)) as t(f)""",
    "records_array": """
        select cast(event_id as varchar) as event_id, event_type, replace(props, ' ', '') as props
        from events""",
    "records_scan": """
        select cast(event_id as varchar) as event_id, event_type, replace(props, ' ', '') as props
        from events""",
    "bronze_ingest": """
        select cast(s_suppkey as varchar) as s_suppkey, s_name,
          cast(s_nationkey as varchar) as s_nationkey, cast(s_acctbal as varchar) as s_acctbal,
          timestamp '2024-01-01' as _ingested_at, 12 as _source_id from supplier""",
    "extract_landing": """
        select cast(n_nationkey as varchar) as n_nationkey, n_name,
          cast(n_regionkey as varchar) as n_regionkey from nation""",
    "lineage_stamp": """
        select *, timestamp '2024-01-01' as _etl_timestamp, cast(7 as bigint) as _pipeline_run_id,
          cast(3 as bigint) as _source_pipeline_id from nation""",
    "upsert_merge": _MERGED,
    "upsert_table": _MERGED,
    "append_evolve": f"""
        select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, null as note from orders
        where o_orderstatus <> 'P'
        union all select o_orderkey, o_orderstatus, price, null, note from {_BATCH} b""",
    "medallion_flow": f"""
        select status, bare_priority as priority, round(coalesce(sum(amount), 0), 2) as total,
          count(*) as rows, min(o_orderdate) as first, cast(5 as bigint) as _pipeline_run_id,
          cast(2 as bigint) as _source_pipeline_id from {_DIRTY} d
        where status is not null and bare_priority is not null group by 1, 2""",
    "quarantine_flow": f"select o_orderkey, status from {_DIRTY} d where coalesce(status, '') <> 'F'",
    "failed_rows_record": f"""
        select 'Validation rules dropped rows (' || count(*) || ' rows)' as reason
        from {_DIRTY} d where status is null""",
    "output_metadata": """
        select 'BRONZE' as layer, 'raw_events' as "tableName", 'Raw Events' as "displayName",
          count(*) as "rowsCount", timestamp '2024-01-01' as "updatedAt" from events""",
    "incremental_ingest": """
        select cast(c_custkey as varchar) as c_custkey, c_name, c_mktsegment, 3 as _source_id
        from customer""",
    "incremental_upsert": """
        select user_id, ts, event_id, event_type from events
        qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
}

ORACLE = {
    name: sql
    for group in (
        CLEANING, VALIDATION, SHAPING, JOINS, AGGREGATES, DASHBOARDS, ANALYTICS, GOVERNANCE, TABLES,
    )
    for name, sql in group.items()
}
