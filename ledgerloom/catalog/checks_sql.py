"""For each registered query, independent SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from .views_sql import (
    BRIDGE,
    CALLS,
    CONVERTED,
    FILES,
    FLAGS,
    PRICED,
    PRICES,
    RATES,
    RECEIPTS,
    REQUESTED_CALLS,
    RESPONSES,
    RESULTS,
    STATUS,
    request_kinds,
)

FIRST, LAST = "1995-07-01", "2001-06-30"
CALL_FIRST, CALL_LAST = "2024-01-02", "2024-01-29"

_PERIOD = f"""status = 'completed' and total_amount is not null
    and receipt_date between date '{FIRST}' and date '{LAST}'"""

_COST = """cast(sum(input_tokens * input + output_tokens * output
      + cache_read_input_tokens * cache_read + cache_creation_input_tokens * cache_write)
      as decimal(28,4)) * cast(0.000001 as decimal(7,6))"""


def _with(*parts: str) -> str:
    return "with " + ",\n".join(p.strip() for p in parts) + "\n"


def totals() -> dict[str, str]:
    return {
        "month_totals": _with(RECEIPTS) + f"""
            select strftime(receipt_date, '%Y-%m') as month, currency, count(*) as receipts,
              cast(sum(total_amount) as double) as total
            from receipts where {_PERIOD} group by 1, 2""",
        "category_totals": _with(RECEIPTS, BRIDGE) + f"""
            select category, currency, count(*) as receipts,
              cast(sum(total_amount) as double) as total
            from receipts join bridge on receipt_id = id where {_PERIOD} group by 1, 2""",
        "month_totals_eur": _with(RECEIPTS, RATES, CONVERTED) + f"""
            select strftime(receipt_date, '%Y-%m') as month, count(total_eur) as receipts,
              cast(coalesce(sum(total_eur), 0) as double) as total_eur,
              count(*) - count(total_eur) as unconverted
            from converted where {_PERIOD} group by 1""",
        "query_totals": _with(RECEIPTS, RATES, CONVERTED) + f"""
            select currency, count(*) as receipts, cast(sum(total_amount) as double) as total,
              cast(coalesce(sum(total_eur), 0) as double) as total_eur,
              count(*) - count(total_eur) as unconverted
            from converted where {_PERIOD} group by 1""",
        "query_totals_filtered": _with(RECEIPTS, BRIDGE, RATES, CONVERTED) + f"""
            select currency, count(*) as receipts, cast(sum(total_amount) as double) as total,
              cast(coalesce(sum(total_eur), 0) as double) as total_eur,
              count(*) - count(total_eur) as unconverted
            from converted c where {_PERIOD}
              and exists (select 1 from bridge b where b.receipt_id = c.id
                          and b.category in ('Food', 'Health'))
              and merchant ilike '%Customer#00000%'
              and total_amount >= 1000.50 and total_amount <= 400000
            group by 1""",
        "receipts_with_categories": _with(RECEIPTS, BRIDGE) + """
            select r.id, coalesce(string_agg(category, '|' order by category), '') as categories,
              count(category) as n
            from receipts r left join bridge b on b.receipt_id = r.id group by 1""",
        "spending_summary": _with(RECEIPTS, BRIDGE, RATES, CONVERTED) + f"""
            select 'month' as section, strftime(receipt_date, '%Y-%m') as name, currency,
              count(*) as receipts, cast(sum(total_amount) as double) as total,
              cast(null as bigint) as unconverted
            from converted where {_PERIOD} group by 2, 3
            union all
            select 'month_eur', strftime(receipt_date, '%Y-%m'), 'EUR', count(total_eur),
              cast(coalesce(sum(total_eur), 0) as double), count(*) - count(total_eur)
            from converted where {_PERIOD} group by 2
            union all
            select 'category', category, currency, count(*), cast(sum(total_amount) as double), null
            from converted join bridge on receipt_id = id where {_PERIOD} group by 2, 3""",
        "fx_asof": _with(RECEIPTS, RATES, CONVERTED) + """
            select id, cast(fx_rate as double) as fx_rate, fx_date from converted""",
        "eur_conversion": _with(RECEIPTS, RATES, CONVERTED) + """
            select id, currency, cast(total_amount as double) as total_amount,
              cast(total_eur as double) as total_eur from converted""",
        "receipt_lookup": _with(RECEIPTS, BRIDGE) + """
            select r.id, merchant, cast(total_amount as double) as total_amount, status,
              (select coalesce(string_agg(category, '|' order by category), '') from bridge b
               where b.receipt_id = r.id) as categories
            from receipts r where r.id in (select doc_id from labels)""",
        "response_view": _with(RECEIPTS, BRIDGE, RATES, CONVERTED) + """
            select c.id, merchant, strftime(receipt_date, '%Y-%m-%d') as date,
              cast(total_amount as double) as total_amount, currency,
              cast(total_eur as double) as total_eur, cast(fx_rate as double) as fx_rate,
              strftime(fx_date, '%Y-%m-%d') as fx_date, status,
              (select coalesce(string_agg(category, '|' order by category), '') from bridge b
               where b.receipt_id = c.id) as categories
            from converted c""",
    }


def usage() -> dict[str, str]:
    between = f"cast(created_at as date) between date '{CALL_FIRST}' and date '{CALL_LAST}'"
    lines = f"""lines as (
            select endpoint, model, count(*) as calls,
              cast(sum(input_tokens) as bigint) as input_tokens,
              cast(sum(output_tokens) as bigint) as output_tokens,
              cast(sum(cache_read_input_tokens) as bigint) as cache_read_input_tokens,
              cast(sum(cache_creation_input_tokens) as bigint) as cache_creation_input_tokens,
              round({_COST}, 6) as cost_usd,
              count(*) filter (where model_prefix is null) as unpriced_calls
            from priced where {between} group by 1, 2)"""
    return {
        "price_asof": _with(CALLS, PRICES, PRICED) + """
            select id, model, model_prefix, valid_from, cast(input as double) as input,
              cast(output as double) as output, cast(cache_read as double) as cache_read,
              cast(cache_write as double) as cache_write
            from priced""",
        "usage_summary": _with(CALLS, PRICES, PRICED, lines) + """
            select * replace (cast(cost_usd as double) as cost_usd) from lines""",
        "usage_total": _with(CALLS, PRICES, PRICED, lines) + """
            select cast(coalesce(round(sum(cost_usd), 6), 0) as double) as total_cost_usd,
              cast(coalesce(sum(unpriced_calls), 0) as bigint) as unpriced_calls from lines""",
        "usage_stream": _with(CALLS, PRICES, PRICED) + f"""
            select cast(created_at as date) as day, endpoint, model, count(*) as calls,
              cast(sum(input_tokens) as bigint) as input_tokens,
              cast(sum(output_tokens) as bigint) as output_tokens,
              cast(sum(cache_read_input_tokens) as bigint) as cache_read_input_tokens,
              cast(sum(cache_creation_input_tokens) as bigint) as cache_creation_input_tokens,
              cast(round({_COST}, 6) as double) as cost_usd,
              count(*) filter (where model_prefix is null) as unpriced_calls
            from priced group by 1, 2, 3""",
        "price_function": _with(CALLS, PRICES, PRICED) + """
            select model, cast(created_at as date) as day, any_value(model_prefix) as model_prefix,
              cast(any_value(input) as double) as input, count(*) as calls
            from priced group by 1, 2""",
    }


_SPREAD = """
history_rows as (
  select r.id, b.category, r.total_amount as t
  from receipts r join bridge b on b.receipt_id = r.id
  where r.status = 'completed' and r.total_amount is not null {only}),
lists as (select category, list(t order by t) as sorted, count(*) as n from history_rows group by 1),
ranked as (select id, category, row_number() over (partition by category order by t, id) as place
           from history_rows)
"""

# Exact interpolation of the sorted list, skipping the receipt's own place when it has one.
_POINTS = """
tested as (
  select r.id, r.currency, r.total_amount, l.category, l.sorted, k.place,
    l.n - case when k.place is null then 0 else 1 end as sample_size
  from receipts r join bridge b on b.receipt_id = r.id join lists l on l.category = b.category
  left join ranked k on k.id = r.id and k.category = l.category
  where r.total_amount > 0 {tested}),
placed as (
  select *, (9 * (sample_size - 1)) // 10 as lo, (9 * (sample_size - 1)) % 10 as share from tested),
neighbours as (
  select *,
    sorted[lo + 1 + case when place is not null and lo + 1 >= place then 1 else 0 end] as low,
    coalesce(sorted[lo + 2 + case when place is not null and lo + 2 >= place then 1 else 0 end],
             0) as high
  from placed),
candidates as (
  select *, cast((low * (10 - share) + high * share) as decimal(20,2)) * cast(0.1 as decimal(2,1))
      as p90
  from neighbours),
best as (
  select id, currency, total_amount, arg_min(category, (-p90, category)) as category,
    arg_min(sample_size, (-p90, category)) as sample_size, max(p90) as p90
  from candidates where sample_size >= 8 and p90 > 0 group by 1, 2, 3),
fired as (select * from best where total_amount > 4 * p90),
outlier_reasons as (
  select *, concat('Total ', cast(cast(total_amount as decimal(38,2)) as varchar), cur,
    ' is more than 4x the ', cast(cast(p90 as decimal(38,2)) as varchar), cur,
    ' 90th percentile of ', sample_size, ' earlier ', category, ' receipts.') as reason
  from (select *, coalesce(' ' || currency, '') as cur from fired))
"""

_FIRSTS = """
dup_keys as (
  select id, created_at, status, lower(trim(merchant, ' ')) as m, receipt_date as d,
    total_amount as t, currency as c from receipts
  where trim(merchant) <> '' and receipt_date is not null and total_amount is not null),
firsts as (
  select m, d, t, c, arg_min(id, (created_at, id)) as match_id,
    min(created_at) as match_at
  from dup_keys where status = 'completed' {only} group by all),
matches as (
  select k.id, f.match_id, f.match_at from dup_keys k
  join firsts f on k.m = f.m and k.d = f.d and k.t = f.t and k.c is not distinct from f.c
  where k.id <> f.match_id)
"""

_VERDICT = """
reasons as (
  select r.id, r.is_suspicious, r.flag_reason, m.match_id as duplicate_of,
    case when dayofweek(r.receipt_date) = 6 then 'Issued on a Saturday.'
         when dayofweek(r.receipt_date) = 0 then 'Issued on a Sunday.' end as weekend,
    case when m.match_id is not null then concat('Same merchant, date and total as receipt ',
      m.match_id, ', submitted on ', strftime(m.match_at, '%Y-%m-%d'),
      '; possible duplicate submission.') end as duplicate,
    o.reason as outlier
  from receipts r left join matches m on m.id = r.id left join outlier_reasons o on o.id = r.id
  {under_test}),
united as (
  select *, coalesce(weekend, duplicate, outlier) is not null as fired,
    case when trim(flag_reason) <> '' then
      trim(flag_reason) || case when right(trim(flag_reason), 1) in ('.', '!', '?') then '' else '.' end
    end as lead
  from reasons)
select id, is_suspicious or fired as is_suspicious,
  case when fired then concat_ws(' ', lead, weekend, duplicate, outlier) else flag_reason end
    as flag_reason, duplicate_of
from united
"""

_IN_HISTORY = "and r.id < 100000000"
_IN_BATCH = "and (r.status = 'pending' or r.id >= 100000000)"


# Completed responses as receipts, and their categories as the bridge: what the shared
# anomaly fragments need, over the responses instead of the orders.
_TAKEN_IN = """
receipts as (
  select id, c_name as merchant, receipt_date, total_amount, currency,
    case when o_orderstatus = 'P' then 'pending' else 'completed' end as status,
    cast(o_orderdate as timestamp) as created_at, base_flag as is_suspicious,
    base_reason as flag_reason
  from extracted where failure_reason is null),
taken_bridge as (
  select id as receipt_id, unnest(string_split(categories, '|')) as category
  from extracted where failure_reason is null and categories <> '')
"""


def anomalies() -> dict[str, str]:
    spread_all, spread_history = _SPREAD.format(only=""), _SPREAD.format(only=_IN_HISTORY)
    points_all, points_batch = _POINTS.format(tested=""), _POINTS.format(tested=_IN_BATCH)
    firsts_all = _FIRSTS.format(only="")
    firsts_history = _FIRSTS.format(only="and id < 100000000")
    in_batch = "(status = 'pending' or id >= 100000000)"
    fired = """select id, category, sample_size, round(cast(p90 as double), 6) as p90,
              reason from outlier_reasons"""
    return {
        "category_spread": _with(RECEIPTS, BRIDGE) + """
            select category, count(*) as sample_size,
              round(quantile_cont(cast(total_amount as double), 0.9), 4) as p90
            from receipts join bridge on receipt_id = id
            where status = 'completed' and total_amount is not null group by 1""",
        "category_spread_by_currency": _with(RECEIPTS, BRIDGE) + """
            select category, currency, count(*) as sample_size,
              round(quantile_cont(cast(total_amount as double), 0.9), 4) as p90
            from receipts join bridge on receipt_id = id
            where status = 'completed' and total_amount is not null group by 1, 2""",
        "outliers": _with(RECEIPTS, BRIDGE, spread_all, points_all) + fired,
        "outliers_snapshot": _with(RECEIPTS, BRIDGE, spread_history, points_batch) + fired,
        "outliers_replay": _with(RECEIPTS, BRIDGE) + """,
            rows_in as (
              select r.id, r.currency, r.total_amount, b.category, cast(created_at as date) as day,
                r.status = 'completed' and r.total_amount is not null as counts
              from receipts r join bridge b on b.receipt_id = r.id),
            asked as (select distinct category, day from rows_in where total_amount > 0),
            spreads as (
              select a.category, a.day, count(*) as sample_size,
                quantile_cont(cast(h.total_amount as double), 0.9) as p90
              from asked a join rows_in h on h.category = a.category and h.day < a.day and h.counts
              group by 1, 2),
            best as (
              select id, currency, total_amount, arg_min(category, (-p90, category)) as category,
                arg_min(sample_size, (-p90, category)) as sample_size, max(p90) as p90
              from rows_in join spreads using (category, day)
              where total_amount > 0 and sample_size >= 8 and p90 > 0 group by 1, 2, 3),
            fired as (
              select *, coalesce(' ' || currency, '') as cur,
                cast(p90 as decimal(18,3)) as exact from best where total_amount > 4 * p90)
            select id, category, sample_size, round(p90, 6) as p90,
              concat('Total ', cast(cast(total_amount as decimal(38,2)) as varchar), cur,
                ' is more than 4x the ', cast(cast(exact as decimal(38,2)) as varchar), cur,
                ' 90th percentile of ', sample_size, ' earlier ', category, ' receipts.') as reason
            from fired""",
        "sketched_spread": _with(RECEIPTS, BRIDGE) + """
            select category, count(*) as sample_size, true as near
            from receipts r join bridge b on b.receipt_id = r.id
            where r.status = 'completed' and r.total_amount is not null group by 1""",
        "duplicates_replay": _with(RECEIPTS, firsts_all) + """
            select id, match_id as duplicate_of, cast(match_at as date) as submitted
            from matches where id in (select id from receipts where status = 'completed')""",
        "duplicates_snapshot": _with(RECEIPTS, firsts_history) + f"""
            select id, match_id as duplicate_of, cast(match_at as date) as submitted
            from matches where id in (select id from receipts where {in_batch})""",
        "weekend_flags": _with(RECEIPTS) + """
            select id, is_suspicious or weekend is not null as is_suspicious,
              case when weekend is null then flag_reason else concat_ws(' ',
                case when trim(flag_reason) <> '' then trim(flag_reason)
                  || case when right(trim(flag_reason), 1) in ('.', '!', '?') then '' else '.' end
                end, weekend) end as flag_reason
            from (select *, case dayofweek(receipt_date) when 6 then 'Issued on a Saturday.'
                    when 0 then 'Issued on a Sunday.' end as weekend from receipts)""",
        "missing_fields": _with(RECEIPTS) + """
            select id, case when total_amount is null then 'The total is missing.'
              else 'The date is missing.' end as missing_reason
            from receipts where total_amount is null
              or (receipt_date is null and trim(merchant) <> '')""",
        "reconcile_totals": _with(RECEIPTS) + """,
            items as (select l_orderkey as id, sum(cast(cast(l_extendedprice as decimal(12,2))
                * (1 - cast(l_discount as decimal(4,2))) * (1 + cast(l_tax as decimal(4,2)))
                as decimal(18,6))) as items_total from lineitem group by 1)
            select r.id, cast(total_amount as double) as total_amount,
              cast(items_total as double) as items_total
            from receipts r join items i on i.id = r.id
            where abs(total_amount - items_total) > 0.01 * abs(total_amount)""",
        "verdict": _with(RECEIPTS, BRIDGE, spread_all, points_all, firsts_all)
        + "," + _VERDICT.format(under_test="where r.status = 'completed'"),
        "verdict_snapshot": _with(RECEIPTS, BRIDGE, spread_history, points_batch, firsts_history)
        + "," + _VERDICT.format(under_test="where r.status = 'pending' or r.id >= 100000000"),
    }


def requests() -> dict[str, str]:
    return {
        "query_validation": _with(request_kinds("customer", "c_custkey")) + """
            select spec_id, error, from_day, to_day, wanted, needle,
              cast(min_total as double) as min_total, cast(max_total as double) as max_total
            from read""",
        "query_batch": _with(
            RECEIPTS, BRIDGE, RATES, CONVERTED, request_kinds("supplier", "s_suppkey")
        ) + """,
            lists as (select receipt_id, list(category) as names from bridge group by 1),
            answers as (
              select q.spec_id, c.currency, count(*) as receipts,
                cast(sum(total_amount) as double) as total,
                cast(coalesce(sum(total_eur), 0) as double) as total_eur,
                count(*) - count(total_eur) as unconverted
              from read q join converted c on c.receipt_date between q.from_day and q.to_day
              left join lists l on l.receipt_id = c.id
              where q.error is null and c.status = 'completed' and c.total_amount is not null
                and (q.wanted is null or list_has_any(l.names, string_split(q.wanted, '|')))
                and (q.needle is null or contains(lower(c.merchant), lower(q.needle)))
                and (q.min_total is null or c.total_amount >= q.min_total)
                and (q.max_total is null or c.total_amount <= q.max_total)
              group by 1, 2)
            select q.spec_id, q.error, a.currency, a.receipts, a.total, a.total_eur, a.unconverted
            from read q left join answers a on a.spec_id = q.spec_id""",
        "period_report": _with(RECEIPTS, BRIDGE, RATES, CONVERTED) + r""",
            quarters as (
              select distinct date_trunc('quarter', o_orderdate)::date as first from orders),
            spans as (
              select year(first) * 10 + quarter(first) as n, first,
                (first + interval 3 month - interval 1 day)::date as last from quarters),
            periods as (
              select n as period_id, first, last from spans
              union all select n + 100000, (first + interval 100 year)::date,
                (last + interval 100 year)::date from spans
              union all select n + 200000, last, first from spans),
            rows_in as (
              select p.period_id, c.*, strftime(receipt_date, '%Y-%m') as month
              from periods p join converted c on c.receipt_date between p.first and p.last
              where status = 'completed' and total_amount is not null),
            amounts as (
              select period_id, month, currency, count(*) as n, sum(total_amount) as total
              from rows_in group by 1, 2, 3),
            month_lines as (
              select period_id, string_agg(concat(E'\n- ', month, ': ',
                cast(cast(total as decimal(38,2)) as varchar), coalesce(' ' || currency, ''),
                ' over ', n, ' receipt', case when n = 1 then '' else 's' end), ''
                order by month, currency nulls last) as body from amounts group by 1),
            category_amounts as (
              select period_id, category, currency, count(*) as n, sum(total_amount) as total
              from rows_in join bridge on receipt_id = id group by 1, 2, 3),
            category_lines as (
              select period_id, string_agg(concat(E'\n- ', category, ': ',
                cast(cast(total as decimal(38,2)) as varchar), coalesce(' ' || currency, ''),
                ' over ', n, ' receipt', case when n = 1 then '' else 's' end), ''
                order by total desc, category, currency nulls last) as body
              from category_amounts group by 1),
            eur_amounts as (
              select period_id, month, count(total_eur) as n, count(*) - count(total_eur) as left_out,
                coalesce(sum(total_eur), 0) as total from rows_in group by 1, 2),
            eur_lines as (
              select period_id, sum(n) as converted, string_agg(concat(E'\n- ', month, ': ',
                cast(cast(total as decimal(38,2)) as varchar), ' EUR over ', n, ' receipt',
                case when n = 1 then '' else 's' end,
                case when left_out = 1 then ' (1 receipt could not be converted and is left out)'
                     when left_out > 1 then concat(' (', left_out,
                       ' receipts could not be converted and are left out)') else '' end), ''
                order by month) as body from eur_amounts group by 1)
            select p.period_id,
              case when first > last then '"from" must not be later than "to".' end as error,
              case when first > last then null
                when m.body is null then
                  'No completed receipts fall in this period, so there is nothing to report on.'
                else concat('Period: ', strftime(first, '%Y-%m-%d'), ' to ',
                  strftime(last, '%Y-%m-%d'), ' (inclusive).',
                  E'\n\nTotals per month, one line per month and currency. These count each',
                  E'\nreceipt exactly once, so they are the only lines that may be added up:',
                  m.body,
                  E'\n\nTotals per category, one line per category and currency. A receipt with',
                  E'\nmore than one category is counted in full under each of them, so these',
                  E'\nlines overlap and must never be summed into a total:', c.body,
                  case when e.converted > 0 then concat(
                    E'\n\nTotals per month with every currency converted to EUR at the ECB rate on',
                    E'\neach receipt''s date. This is the same spending as the month lines above,',
                    E'\nnot additional spending. Each receipt is counted once, so these lines may',
                    E'\nbe added up, and they are the only figures that combine currencies:',
                    e.body) else '' end) end as report
            from periods p left join month_lines m using (period_id)
            left join category_lines c using (period_id) left join eur_lines e using (period_id)
            """,
    }


_WEEKEND_OF = """case dayofweek({day}) when 6 then 'Issued on a Saturday.'
    when 0 then 'Issued on a Sunday.' end"""


def intake() -> dict[str, str]:
    weekend = _WEEKEND_OF.format(day="receipt_date")
    return {
        "media_types": _with(FILES) + "select id, image_type as media_type, bytes = 0 as is_pdf from seen",
        "upload_checks": _with(FILES) + """
            select id, reject_reason, case when reject_reason is null then
              case when kind = 'pdf' then 'application/pdf' else image_type end end as media_type
            from checked""",
        "file_intake": _with(FILES) + """
            select c.id, 'pending' as status, kind as source_type,
              concat('file-', c.id) as source_filename,
              case bytes when 0 then 9 when 1 then 8 when 2 then 10 when 3 then 8 when 4 then 16
                when 8 then 8 end + octet_length(encode(d.text)) as source_bytes
            from checked c join documents d on d.doc_id = c.id where reject_reason is null""",
        "text_intake": """
            with texts as (select doc_id as id, case doc_id % 7
                when 1 then repeat(chr(129534), 9990) || substr(text, 1, 10)
                when 2 then repeat(chr(129534), 10000) || substr(text, 1, 10) else text end as text
              from documents),
            judged as (select *, case when coalesce(text, '') = '' then 'The text is empty.'
                when length(text) > 10000 then 'The text is longer than 10000 characters.' end as reject_reason
              from texts)
            select id, case when reject_reason is null then 'pending' else 'refused' end as status,
              'text' as source_type, md5(text) as text_md5, reject_reason from judged""",
        "typed_parse": _with(BRIDGE, RESPONSES) + """,
            bad as (select id from extracted where failure_reason is not null
              and failure_reason <> 'A value does not fit its column.'),
            items as (select id, string_agg(concat('item ', n, '/', cast(quantity as bigint), '/',
                category), '|' order by concat('item ', n, '/', cast(quantity as bigint), '/', category))
                as line_items
              from labelled_items group by 1)
            select e.id, case when b.id is null then c_name end as merchant,
              cast(null as varchar) as merchant_details, cast(null as varchar) as "merchant_vatNumber",
              cast(null as varchar) as merchant_phone,
              case when b.id is null then concat('INV ', e.id) end as invoice_number,
              cast(null as varchar) as location,
              case when b.id is not null or e.id % 53 = 0 then null when e.id % 59 = 3 then '1997-02-30'
                when e.id % 107 = 13 then strftime(cast(o_orderdate as date), '%Y-%m')
                when e.id % 109 = 14 then strftime(cast(o_orderdate as date), '%Y')
                else strftime(cast(o_orderdate as date), '%Y-%m-%d') end as date,
              case when b.id is not null or e.id % 61 = 0 then null when e.id % 67 = 4 then 99999999999.0
                else cast(o_totalprice as double) end as total_amount,
              case when b.id is null then case when e.id % 71 = 5 then 'EURO' else currency end end as currency,
              case when b.id is null then o_orderpriority end as payment_method,
              case when b.id is null then 'items' end as category_evidence,
              case when b.id is null then case when e.id % 73 = 6 then 10.5 else cast((e.id % 4) * 0.25 as double) end end
                as confidence_score,
              case when b.id is null then 'none' end as anomaly_evidence,
              case when b.id is null then base_flag end as is_suspicious,
              case when b.id is null then base_reason end as flag_reason,
              case when b.id is null then array_to_string(list_concat(e.names[1:1],
                case when e.id % 9 = 0 then ['Other'] else [] end), '|') end as categories,
              case when b.id is null then coalesce(line_items, '') end as line_items
            from extracted e left join bad b using (id) left join items using (id)""",
        "response_triage": _with(BRIDGE, RESPONSES) + """
            select id, case when failure_reason = 'A value does not fit its column.' then null
              else failure_reason end as failure_reason from extracted""",
        "merged_categories": _with(BRIDGE, RESPONSES) + """
            select id, categories from extracted
            where failure_reason is null or failure_reason = 'A value does not fit its column.'""",
        "completion_cast": _with(BRIDGE, RESPONSES) + f""",
            flagged as (select *, {weekend} as weekend from extracted)
            select id, case when failure_reason is null then 'completed' else 'failed' end as status,
              failure_reason,
              case when failure_reason is null then receipt_date end as receipt_date,
              case when failure_reason is null then cast(total_amount as double) end as total_amount,
              case when failure_reason is null then currency end as currency,
              case when failure_reason is null then cast(confidence_score as double) end
                as confidence_score,
              case when failure_reason is null then categories end as categories,
              case when failure_reason is null then base_flag or weekend is not null end
                as is_suspicious,
              case when failure_reason is not null then null
                when weekend is null then base_reason
                else concat_ws(' ', case when trim(base_reason) <> ''
                  then trim(base_reason) || '.' end, weekend) end as flag_reason
            from flagged""",
        "intake_in_two_batches": _with(
            BRIDGE, RESPONSES, _TAKEN_IN, RATES, CONVERTED,
            _SPREAD.format(only="").replace("join bridge", "join taken_bridge"),
            _POINTS.format(tested="and r.status = 'pending'").replace("join bridge", "join taken_bridge"),
            _FIRSTS.format(only="and false"),
        ) + "," + _VERDICT.format(under_test="").replace(
            "select id, is_suspicious or fired",
            """, stored as (select id, is_suspicious or fired""",
        ) + """)
            select e.id, case when failure_reason is null then 'completed' else 'failed' end as status,
              case when failure_reason is null then cast(e.total_amount as double) end as total_amount,
              cast(c.total_eur as double) as total_eur, s.is_suspicious, s.flag_reason, s.duplicate_of
            from extracted e left join stored s on s.id = e.id left join converted c on c.id = e.id""",
        "intake_whole": _with(BRIDGE, RESPONSES) + """,
            inputs as (
              select *, id % 7 > 0 as known, epoch(cast(o_orderdate as timestamp)) as answered,
                case when id % 7 = 0 or id % 5 < 2 then 'text' when id % 5 = 2 then 'pdf' else 'image' end as kind from extracted)
            select 'receipt' as part, cast(id as varchar) as id, concat_ws('/',
              case when failure_reason is null then 'completed' else 'failed' end, kind,
              case when known and kind <> 'text' then concat('file-', id) else '-' end,
              case when known and kind <> 'text' then cast(id % 1000 as varchar) else '-' end,
              case when known and kind = 'text' then concat('receipt ', id) else '-' end,
              case when known then 'prompt' else '-' end,
              cast(answered - case when known then 3600 else 0 end as bigint), cast(answered as bigint)) as detail
            from inputs
            union all
            select 'call', cast(id as varchar), concat_ws('/', kind, case when id % 3 = 0 then 'm-a' else 'm-b-2' end, id % 4, 1,
              (id % 4) * (id % 100), (id % 4) * 10) from inputs where id % 4 > 0
            union all
            select 'bridge', cast(id as varchar), array_to_string(list_sort(string_split(categories, '|')), '|')
            from extracted where failure_reason is null and categories <> ''""",
        "latest_status": _with(RECEIPTS, STATUS) + """
            select id, arg_max(status, (updated_at, status <> 'pending')) as status,
              cast(epoch(max(updated_at)) as bigint) as updated_at from status_events group by 1""",
        "category_bridge": _with(BRIDGE) + "select receipt_id, category from bridge",
        "category_dimension": _with(BRIDGE) + """,
            fresh as (select distinct category from bridge
                      where category not in ('Food', 'Other', 'Travel & Accommodation'))
            select name, is_new, 3 + (select count(*) from fresh) as last_id,
              3 + (select count(*) from fresh) as ids
            from (select category as name, true as is_new from fresh
                  union all select * from (values ('Food', false), ('Other', false),
                                           ('Travel & Accommodation', false)))""",
        "ledger_rows": _with(CALLS, REQUESTED_CALLS) + """
            select *, count(*) over (partition by request_id) as calls_in_request from requested""",
        "price_seed": """
            with listed as (
              select concat(lower(replace(p_brand, '#', '-')), '-', p_partkey % 400) as model_prefix,
                date '2000-01-01' + p_size as valid_from, p_retailprice as input, p_size
              from part),
            seed as (select model_prefix, valid_from, max(input) as input from listed group by 1, 2),
            stored as (select model_prefix, valid_from, min(input) / 2 as input from listed
                       where p_size > 25 group by 1, 2)
            select model_prefix, valid_from, round(cast(input as double), 4) as input from stored
            union all
            select model_prefix, valid_from, round(cast(input as double), 4) from seed s
            where not exists (select 1 from stored t where t.model_prefix = s.model_prefix
                              and t.valid_from = s.valid_from)""",
        "schema_backfill": _with(RECEIPTS) + """
            select cast(id as varchar) as id, merchant, status, 'text' as source_type,
              false as is_suspicious, cast(null as varchar) as flag_reason,
              cast(null as bigint) as source_bytes, cast(total_amount as double) as total_amount
            from receipts""",
        "delete_propagation": _with(RECEIPTS, BRIDGE, CALLS) + """,
            deleted as (select id from receipts where id % 80 = 0)
            select 'receipts' as part, id as key, '' as detail,
              case when id >= 100000000 and id < 200000000
                and id - 100000000 not in (select id from deleted) then id - 100000000 end as reference
            from receipts where id not in (select id from deleted)
            union all
            select 'bridge', receipt_id, category, null from bridge
            where receipt_id not in (select id from deleted)
            union all
            select 'calls', id, '', case when endpoint in ('text', 'pdf', 'image')
              and id not in (select id from deleted) then id end from calls""",
    }


_RATES_OF = """case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as precision,
  case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as recall"""

_MARKED = """
scored as (select * from results where skipped is null),
marked as (
  select id, source, category, max(e) = 1 as e, max(g) = 1 as g from (
    select id, source, unnest(expected) as category, 1 as e, 0 as g from scored
    union all select id, source, unnest(got), 0, 1 from scored) group by all),
counts as (
  select category, count(*) filter (where e and g) as tp, count(*) filter (where g and not e) as fp,
    count(*) filter (where e and not g) as fn from marked group by 1)
"""

_F1 = "case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end"

_EXACT = "(skipped is null and error is null and expected = got)"


def scoring() -> dict[str, str]:
    base = (BRIDGE, RESULTS)
    side = f"""select {{name}} as side, count(*) as cases,
              avg(case when {{t}}.exact then 1.0 else 0.0 end) as exact_rate,
              sum(len(list_intersect({{t}}.expected, {{t}}.got))) as tp,
              sum(len({{t}}.got) - len(list_intersect({{t}}.expected, {{t}}.got))) as fp,
              sum(len({{t}}.expected) - len(list_intersect({{t}}.expected, {{t}}.got))) as fn"""
    pair_parts = f""",
            judged as (select *, {_EXACT} as exact from results),
            image_side as (select * from judged where source = 'image' and same_as is not null),
            text_side as (select * from judged where skipped is null),
            joined as (select i.*, t.id as text_id, t.exact as t_exact, t.expected as t_expected,
                         t.got as t_got
                       from image_side i left join text_side t on t.id = i.same_as),
            complete as (select * from joined where skipped is null and text_id is not null),
            sides as (
              select 'photo' as side, exact, expected, got from complete
              union all select 'text', t_exact, t_expected, t_got from complete),
            sums as (
              {side.format(name="side", t="sides")} from sides group by 1),
            rated as (select *, {_RATES_OF} from sums),
            summaries as (select side, cases, exact_rate, {_F1} as micro_f1 from rated)
            """
    return {
        "category_scores": _with(*base, _MARKED) + f"""
            select category, tp + fn as support, tp, fp, fn, round(precision, 6) as precision,
              round(recall, 6) as recall, round({_F1}, 6) as f1
            from (select *, {_RATES_OF} from counts)""",
        "micro_scores": _with(*base, _MARKED) + f"""
            select tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall,
              round({_F1}, 6) as f1
            from (select *, {_RATES_OF} from (select cast(sum(tp) as bigint) as tp,
              cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from counts))""",
        "exact_match": _with(*base) + f"""
            select count(*) filter (where skipped is null) as cases,
              count(*) filter (where {_EXACT}) as exact,
              count(*) filter (where skipped is null and error is not null) as errors,
              count(*) filter (where skipped is not null) as skipped,
              round(count(*) filter (where {_EXACT}) / count(*) filter (where skipped is null), 6)
                as exact_rate
            from results""",
        "source_summary": _with(*base) + f""",
            judged as (select *, {_EXACT} as exact from results where skipped is null),
            sums as ({side.format(name="judged.source", t="judged")} from judged group by 1)
            select side as source, cases, round(exact_rate, 6) as exact_rate,
              round({_F1}, 6) as micro_f1
            from (select *, {_RATES_OF} from sums)""",
        "flag_scores": _with(FLAGS) + f"""
            select labelled, tp, fp, fn, tn, round(precision, 6) as precision,
              round(recall, 6) as recall, round({_F1}, 6) as f1,
              round((tp + tn) / labelled, 6) as accuracy
            from (select *, {_RATES_OF} from (
              select count(*) as labelled,
                count(*) filter (where expected_suspicious and suspicious) as tp,
                count(*) filter (where not expected_suspicious and suspicious) as fp,
                count(*) filter (where expected_suspicious and not suspicious) as fn,
                count(*) filter (where not expected_suspicious and not suspicious) as tn
              from flag_results where expected_suspicious is not null))""",
        "flag_mismatches": _with(FLAGS) + """
            select id, expected_suspicious, suspicious from flag_results
            where expected_suspicious <> suspicious""",
        "pair_listing": _with(*base) + pair_parts + """
            select id, same_as as text_id, skipped is null and text_id is not null as paired
            from joined""",
        "pair_scores": _with(*base) + pair_parts + """
            select side, cases, round(exact_rate, 6) as exact_rate, round(micro_f1, 6) as micro_f1
            from summaries""",
        "pair_delta": _with(*base) + pair_parts + """
            select round(sum(case side when 'photo' then exact_rate else -exact_rate end), 6)
                as exact_delta,
              round(sum(case side when 'photo' then micro_f1 else -micro_f1 end), 6) as f1_delta
            from summaries""",
        "mismatches": _with(*base) + f"""
            select id, array_to_string(expected, '|') as expected, array_to_string(got, '|') as got,
              array_to_string(list_sort(list_filter(expected, lambda x: not list_contains(got, x))), '|')
                as missing,
              array_to_string(list_sort(list_filter(got, lambda x: not list_contains(expected, x))), '|')
                as spurious, error
            from results where skipped is null and not {_EXACT}""",
        "score_report": _report(pair_parts),
        "first_cases": """
            select o_orderkey as id from orders order by o_orderkey limit 100""",
    }


def _percent(share: str) -> str:
    return f"cast(cast(round(cast({share} * 100 as decimal(20,10)), 1) as decimal(10,1)) as varchar) || '%'"


def _points(share: str) -> str:
    value = f"cast(round(cast({share} * 100 as decimal(20,10)), 1) as decimal(10,1))"
    return f"case when {share} >= 0 then '+' else '' end || cast({value} as varchar) || 'pp'"


def _padded(text: str, width: int) -> str:
    return f"case when length({text}) >= {width} then {text} else rpad({text}, {width}, ' ') end"


def _report(pair_parts: str) -> str:
    """Every line of the report with its number: (section, key, line number) rows, sorted."""
    cells = " || ".join(_padded(_percent(c), 7) for c in ("precision", "recall", "f1"))
    names = lambda c: f"array_to_string({c}, ', ')"
    gone = "list_sort(list_filter(expected, lambda x: not list_contains(got, x)))"
    extra = "list_sort(list_filter(got, lambda x: not list_contains(expected, x)))"
    key = "lpad(cast(id as varchar), 20, '0') || ' ' || cast(id as varchar)"

    def lines(section: int, order: str, rows: str, *texts: str) -> str:
        listed = ", ".join(texts)
        return f"""select {section} as section, {order} as key, i as line_no, [{listed}][i] as line
            from {rows}, range(1, {len(texts) + 1}) as t(i) where [{listed}][i] is not null"""

    head = "'" + "category".ljust(24) + "support".ljust(9) + "P".ljust(7) + "R".ljust(7) + "F1".ljust(7) + "tp/fp/fn'"
    wide, narrow = "'" + "-" * 72 + "'", "'" + "-" * 48 + "'"
    some = "complete_pairs > 0"
    parts = [
        lines(10, "''", "micro", "'=== Category classification [whole table] ==='", "''", head, wide),
        lines(11, "lpad(cast(1000000000000000000 - tp - fn as varchar), 20, '0') || category", "labels",
              f"{_padded('category', 24)} || {_padded('cast(tp + fn as varchar)', 9)} || {cells} || concat_ws('/', tp, fp, fn)"),
        lines(12, "''", "micro", wide, f"'{'MICRO AVG'.ljust(33)}' || {cells}", "''"),
        lines(13, "''", "matches", f"concat('Exact set match: ', {_percent('rate')}, ' (', exact, '/', cases, ')   Errors: ', errors, '   Skipped: ', skipped)"),
        lines(20, "''", "(select * from matches where skipped > 0)", "''", "concat('Skipped (', skipped, '), scored as nothing either way:')"),
        lines(21, key, "(select * from results where skipped is not null)", f"concat('  ', {_padded('cast(id as varchar)', 30)}, ' ', skipped)"),
        lines(30, "''", "pair_counts", "''", "'=== Photo vs text ==='", "''",
              f"""case when {some} then concat('  ', complete_pairs, ' paired receipts, same expectations on both sides')
                else '  no complete pairs (an image case needs a "same_as" text case, and both have to run)' end""",
              f"case when {some} then '' end", f"case when {some} then '{' ' * 18}{'exact match'.ljust(15)}{'micro F1'.ljust(15)}' end",
              f"case when {some} then {narrow} end"),
        lines(31, "case side when 'text' then '0' else '1' end", "summaries",
              f"case side when 'text' then '{'clean text'.ljust(18)}' else '{'photograph'.ljust(18)}' end || "
              f"{_padded(_percent('exact_rate'), 15)} || {_padded(_percent('micro_f1'), 15)}"),
        lines(32, "''", "(select * from delta where pairs > 0)", narrow, f"'{'delta'.ljust(18)}' || {_padded(_points('de'), 15)} || {_padded(_points('df'), 15)}"),
        lines(33, "''", "(select * from pair_counts where half_pairs > 0)", f"case when {some} then '' end",
              f"case when {some} then '  excluded, only one side ran:' else '  incomplete pairs:' end"),
        lines(34, key, "(select * from joined where not (skipped is null and text_id is not null))", "concat('    ', id)"),
        lines(40, "''", "flag_sums", "''", "'=== Anomaly flag ==='", "''",
              f"""case when labelled = 0 then '  no labelled cases (add expected_suspicious to a case to score it)' else
                concat('  labelled: ', labelled, '   P ', {_percent('precision')}, '   R ', {_percent('recall')}, '   F1 ', {_percent('f1')},
                  '   accuracy ', {_percent('(tp + tn) / labelled')}, '   tp/fp/fn/tn ', concat_ws('/', tp, fp, fn, tn)) end"""),
        lines(41, "''", "(select count(*) as n from flag_wrong having count(*) > 0)", "''", "concat('  Flag mismatches (', n, '):')"),
        lines(42, key, "flag_wrong", "''", "concat('    ', id)", f"concat('      ', {_padded('source', 9)}, ': document ', id)",
              "concat('      expected : ', expected_suspicious, '   got: ', suspicious)",
              "case when suspicious then '      reason   : A short text.' end"),
        lines(50, "''", "(select count(*) as n from wrong having count(*) > 0)", "''", "concat('Mismatches (', n, '):')"),
        lines(51, key, "wrong", "''", "concat('  ', id)", f"concat('    ', {_padded('source', 9)}, ': ', input)",
              f"concat('    expected : ', coalesce(nullif({names('expected')}, ''), '(none)'))",
              f"concat('    got      : ', coalesce(nullif({names('got')}, ''), '(none)'))",
              f"case when len({gone}) > 0 then concat('    missing  : ', {names(gone)}) end",
              f"case when len({extra}) > 0 then concat('    spurious : ', {names(extra)}) end",
              "case when id % 4 = 0 then concat('    evidence : read from ', input) end",
              "case when error is not null then concat('    error    : ', error) end"),
    ]
    rated = f"select *, {_F1} as f1 from (select *, {_RATES_OF} from"
    return _with(BRIDGE, RESULTS, _MARKED, FLAGS) + pair_parts + f""",
        labels as ({rated} counts)),
        micro as ({rated} (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from counts))),
        matches as (
          select count(*) filter (where skipped is null) as cases, count(*) filter (where {_EXACT}) as exact,
            count(*) filter (where skipped is null and error is not null) as errors, count(*) filter (where skipped is not null) as skipped,
            count(*) filter (where {_EXACT}) / count(*) filter (where skipped is null) as rate from results),
        pair_counts as (
          select count(*) filter (where skipped is null and text_id is not null) as complete_pairs,
            count(*) filter (where not (skipped is null and text_id is not null)) as half_pairs from joined),
        delta as (
          select sum(case side when 'photo' then exact_rate else -exact_rate end) as de,
            sum(case side when 'photo' then micro_f1 else -micro_f1 end) as df, max(cases) as pairs from summaries),
        flag_sums as ({rated} (
          select count(*) as labelled, count(*) filter (where expected_suspicious and suspicious) as tp,
            count(*) filter (where not expected_suspicious and suspicious) as fp,
            count(*) filter (where expected_suspicious and not suspicious) as fn,
            count(*) filter (where not expected_suspicious and not suspicious) as tn
          from flag_results where expected_suspicious is not null))),
        flag_wrong as (select * from flag_results where expected_suspicious <> suspicious),
        wrong as (select *, concat('order ', id % 300000000) as input from results where skipped is null and not {_EXACT})
        select row_number() over (order by section, key, line_no) as number, line from (
          {' union all '.join(parts)})"""


#: Queries that answer like another one, by other means.
SAME_ANSWER = {
    "status_stream": "latest_status",
    "duplicates_stream": "duplicates_replay",
    "fx_asof_in_order": "fx_asof",
    "price_asof_in_order": "price_asof",
    "stored_scores": "category_scores",
}


#: A period that holds every receipt and call.
EVER = ("1990-01-01", "2030-12-31")


def _insights(summary: str, usage: str) -> str:
    """The two reports of the whole period in one, with what is said of an empty and of a reversed one."""
    summary = summary.replace(FIRST, EVER[0]).replace(LAST, EVER[1])
    usage = usage.replace(CALL_FIRST, EVER[0]).replace(CALL_LAST, EVER[1])
    return f"""
        select 'whole' as period, section, name, currency, receipts, total, unconverted from ({summary})
        union all
        select 'whole', 'usage', concat_ws(' ', endpoint, model), 'USD', calls, cost_usd, unpriced_calls from ({usage})
        union all
        select 'empty', 'summary', 'No completed receipts fall in this period, so there is nothing to report on.', null, null, null, null
        union all
        select 'reversed', 'error', '"from" must not be later than "to".', null, null, null, null"""


def all_checks() -> dict[str, str]:
    found = {**totals(), **usage(), **anomalies(), **requests(), **intake(), **scoring()}
    found["insights_result"] = _insights(found["spending_summary"], found["usage_summary"])
    return found | {name: found[other] for name, other in SAME_ANSWER.items()}
