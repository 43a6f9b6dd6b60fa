"""The derived views of ``sources.tables`` as DuckDB common table expressions."""

RECEIPTS = """
base_receipts as (
  select o_orderkey as id,
    concat(case when o_orderkey % 3 = 0 then '  ' else '' end,
           case when o_orderkey % 2 = 0 then lower(c_name) else c_name end) as merchant,
    case when o_orderkey % 53 = 0 then null else cast(o_orderdate as date) end as receipt_date,
    case when o_orderkey % 61 = 0 then null else
      cast(cast(o_totalprice as decimal(12,2))
           * (case when o_orderkey % 97 = 0 then 20 else 1 end) as decimal(12,2))
    end as total_amount,
    case c_nationkey % 4 when 0 then 'EUR' when 1 then 'USD' when 2 then 'JPY' else null end
      as currency,
    case when o_orderstatus = 'P' then 'pending' when o_orderkey % 20 = 7 then 'failed'
         else 'completed' end as status,
    cast(o_orderdate as timestamp) as created_at,
    o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW') as is_suspicious,
    case o_orderpriority when '1-URGENT' then 'The total is high for these items'
      when '2-HIGH' then '  ' when '5-LOW' then ' Odd items for this merchant! ' end as flag_reason
  from orders join customer on o_custkey = c_custkey),
receipts as (
  select * from base_receipts
  union all
  select id + 100000000, upper(merchant), receipt_date, total_amount, currency, status,
    created_at + interval 1 day, is_suspicious, flag_reason from base_receipts where id % 40 = 0
  union all
  select id + 200000000, merchant, receipt_date, total_amount, 'GBP', status,
    created_at + interval 1 day, is_suspicious, flag_reason from base_receipts where id % 40 = 1)
"""

_CATEGORY = """case p_type when 'ECONOMY' then 'Food' when 'MEDIUM' then 'Home & Kitchen'
    when 'PROMO' then 'Leisure' when 'SMALL' then 'Health' when 'LARGE' then 'Electronics'
    else 'Transportation' end"""

BRIDGE = f"""
labelled_items as (
  select l_orderkey as id, l_linenumber as n, l_quantity as quantity, {_CATEGORY} as category
  from lineitem join part on l_partkey = p_partkey),
bridge as (select distinct id as receipt_id, category from labelled_items)
"""

RATES = """
fx as (
  select d as rate_date, cur as currency,
    cast((case cur when 'USD' then 90000000 else 700000 end + dayofyear(d) * 1000)
         as decimal(18,0)) * cast(0.00000001 as decimal(18,8)) as rate
  from (select distinct cast(o_orderdate as date) as d from orders)
  cross join (select 'USD' as cur union all select 'JPY')
  where dayofweek(d) not in (0, 6))
"""

# Needs RECEIPTS and RATES.
CONVERTED = """
latest as (select currency, max(rate_date) as rate_date, arg_max(rate, rate_date) as rate
           from fx group by 1),
keyed as (select *, case when total_amount is not null then upper(trim(currency)) end as fx_base
          from receipts),
rated as (
  select k.* exclude (fx_base),
    cast(case when fx_base = 'EUR' then 1 when receipt_date is null then l.rate else f.rate end
         as decimal(18,8)) as fx_rate,
    case when fx_base = 'EUR' then coalesce(receipt_date, date '2001-12-31')
         when receipt_date is null then l.rate_date else f.rate_date end as fx_date
  from keyed k
  asof left join fx f on k.fx_base = f.currency and k.receipt_date >= f.rate_date
  left join latest l on k.fx_base = l.currency),
converted as (
  select *, cast(cast(total_amount as decimal(12,2)) * fx_rate as decimal(12,2)) as total_eur
  from rated)
"""

CALLS = """
calls as (
  select event_id as id,
    case event_type when 'view' then 'text' when 'click' then 'pdf' when 'signup' then 'image'
                    when 'purchase' then 'insights' else 'ask' end as endpoint,
    case user_id % 4 when 0 then 'm-a-1-20240101' when 1 then 'm-a' when 2 then 'm-b-2'
                     else 'x_a' end as model,
    cast(floor(value * 10) as int) as input_tokens, cast(floor(value * 3) as int) as output_tokens,
    cast(event_id % 100 as int) as cache_read_input_tokens,
    cast(event_id % 7 as int) as cache_creation_input_tokens,
    ts as created_at
  from events)
"""

PRICES = """
prices as (
  select * from (values
    ('m-a', date '2000-01-01', cast(1 as decimal(10,4)), cast(5 as decimal(10,4)),
     cast(0.1 as decimal(10,4)), cast(1.25 as decimal(10,4))),
    ('m-a', date '2024-01-15', 2, 10, 0.2, 2.5),
    ('m-a-1', date '2024-01-10', 4, 20, 0.2, 5),
    ('m-b', date '2024-01-20', 10, 50, 0.25, 12.5),
    ('x%a', date '2000-01-01', 9, 9, 9, 9)
  ) as t(model_prefix, valid_from, input, output, cache_read, cache_write))
"""

# Needs CALLS and PRICES.
PRICED = """
priced as (
  select c.*, p.model_prefix, p.valid_from, p.input, p.output, p.cache_read, p.cache_write
  from calls c left join lateral (
    select * from prices
    where starts_with(c.model, prices.model_prefix) and prices.valid_from <= c.created_at
    order by length(prices.model_prefix) desc, prices.valid_from desc limit 1) p on true)
"""

# Needs BRIDGE.
RESULTS = """
text_cases as (
  select o_orderkey as id, 'text' as source, cast(null as bigint) as same_as,
    cast(null as varchar) as skipped,
    case when o_orderkey % 89 = 5 then 'no answer' end as error from orders),
image_cases as (
  select o_orderkey + 300000000 as id, 'image' as source, o_orderkey as same_as,
    case when o_orderkey % 30 = 0 then 'no file' end as skipped,
    cast(null as varchar) as error from orders where o_orderkey % 10 = 0),
cases as (select * from text_cases union all select * from image_cases),
expected_labels as (
  select receipt_id as id, category from bridge
  union all
  select receipt_id + 300000000, category from bridge where receipt_id % 10 = 0),
all_got as (
  select distinct id, category from labelled_items where n <> 2
  union all
  select o_orderkey, 'Other' from orders where o_orderkey % 7 = 0
  union all
  select distinct id + 300000000, category from labelled_items where n <= 2 and id % 10 = 0),
got_labels as (
  select g.* from all_got g join cases c on c.id = g.id
  where c.skipped is null and c.error is null),
results as (
  select c.*,
    coalesce((select list(e.category order by e.category) from expected_labels e where e.id = c.id),
             []) as expected,
    coalesce((select list(g.category order by g.category) from got_labels g where g.id = c.id),
             []) as got
  from cases c)
"""

FLAGS = """
flag_results as (
  select d.doc_id as id, d.source,
    case when l.doc_id is not null then toxic = 1 or quality = 0 end as expected_suspicious,
    n_chars < 400 as suspicious
  from documents d left join labels l on d.doc_id = l.doc_id)
"""

# What the broken responses of ``Tables.responses`` must come to, stated from the orders.
RESPONSES = """
response_items as (
  select id, list_sort(list(distinct category)) as names from labelled_items group by 1),
responses as (
  select o_orderkey as id, o_orderdate, o_totalprice, o_orderpriority, o_orderstatus, c_name,
    c_nationkey % 4 as nation,
    coalesce(i.names, []) as names,
    case when o_orderkey % 41 = 0 then 'The response was cut off before the receipt was finished.'
         when o_orderkey % 43 = 1 then 'The extraction was declined.'
         when o_orderkey % 47 = 2 or o_orderkey % 79 = 7 or o_orderkey % 83 = 8
             or o_orderkey % 89 in (9, 19) or len(coalesce(i.names, [])) > 0
               and (o_orderkey % 97 = 10 or o_orderkey % 101 = 11 or o_orderkey % 103 = 12)
           then 'The response holds no usable extraction.'
         when o_orderkey % 53 <> 0
             and (o_orderkey % 59 = 3 or o_orderkey % 107 = 13 or o_orderkey % 109 = 14)
           then 'A value does not fit its column.'
         when o_orderkey % 61 <> 0 and o_orderkey % 67 = 4
           then 'A value does not fit its column.'
         when o_orderkey % 71 = 5 or o_orderkey % 73 = 6
           then 'A value does not fit its column.' end as failure_reason
  from orders join customer on o_custkey = c_custkey left join response_items i on i.id = o_orderkey),
taxonomy as (
  select * from (values (1, 'Food'), (2, 'Home & Kitchen'), (3, 'Household Supplies'),
    (4, 'Personal Care'), (5, 'Health'), (6, 'Clothing'), (7, 'Transportation'),
    (8, 'Travel & Accommodation'), (9, 'Housing'), (10, 'Electronics'), (11, 'Leisure'),
    (12, 'Education'), (13, 'Services & Fees'), (14, 'Prepared food or drinks'), (15, 'Other'))
  as t(place, name)),
extracted as (
  select r.*,
    (select coalesce(string_agg(name, '|' order by place), '') from taxonomy t
     where list_contains(r.names, t.name) or (t.name = 'Other' and r.id % 9 = 0)) as categories,
    case when id % 53 <> 0 then cast(o_orderdate as date) end as receipt_date,
    case when id % 61 <> 0 then cast(o_totalprice as decimal(12,2)) end as total_amount,
    case nation when 0 then 'EUR' when 1 then 'USD' when 2 then 'JPY' end as currency,
    (id % 4) * 0.25 as confidence_score,
    o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW') as base_flag,
    case o_orderpriority when '1-URGENT' then 'The total is high for these items'
      when '2-HIGH' then '  ' end as base_reason
  from responses r)
"""

FILES = """
files as (
  select doc_id as id, doc_id % 9 as bytes, case when doc_id % 2 = 0 then 'pdf' else 'image' end as kind,
    case doc_id % 5 when 0 then 'application/pdf' when 1 then 'image/jpeg' when 2 then 'image/png'
      when 3 then 'image/webp' else 'text/plain' end as declared_type,
    doc_id % 11 = 0 as too_large
  from documents),
seen as (
  select *, case when bytes = 1 then 'image/jpeg' when bytes = 2 then 'image/png'
    when bytes in (3, 8) then 'image/gif' when bytes = 4 then 'image/webp' end as image_type
  from files),
checked as (
  select *, case
    when bytes = 7 then concat('No ', noun, ' was uploaded. Send the file as multipart/form-data',
                               ' under the field name "file".')
    when too_large then concat('The ', noun, ' is larger than the 10 MB limit.')
    when bytes = 6 then concat('The uploaded ', noun, ' is empty.')
    when kind = 'pdf' and declared_type <> 'application/pdf' then concat(
      'Only application/pdf is accepted, but the upload declared "', declared_type, '".')
    when kind = 'image' and declared_type not in ('image/jpeg', 'image/png', 'image/webp') then concat(
      'Only image/jpeg, image/png, image/gif, image/webp are accepted, but the upload declared "',
      declared_type, '".')
    when kind = 'pdf' and bytes <> 0
      then 'The uploaded file is not a PDF: it does not start with the PDF signature.'
    when kind = 'image' and image_type is null then concat('The uploaded file is not a JPEG, PNG,',
      ' WebP or GIF image: its contents match none of those formats.')
    end as reject_reason
  from (select *, case when kind = 'pdf' then 'PDF' else 'image' end as noun from seen))
"""


def request_kinds(table: str, key: str) -> str:
    """What each kind of ``sources.tables.request_json`` must be read as."""
    return f"""
requests as (
  select {key} as spec_id, {key} % 20 as kind,
    date '1995-01-01' + cast({key} * 7 % 2000 as int) as first,
    date '1995-01-01' + cast({key} * 7 % 2000 + 20 + {key} % 60 as int) as last
  from {table}),
read as (
  select spec_id,
    case when kind in (0, 1, 18) then 'The arguments must be an object.'
      when kind = 2 then 'Unknown argument(s): sql, also.'
      when kind in (3, 4) then '"from" and "to" must be real dates written as YYYY-MM-DD.'
      when kind = 5 then '"from" must not be later than "to".'
      when kind = 6 then concat('"categories" must be null or a list drawn from: Food, ',
        'Home & Kitchen, Household Supplies, Personal Care, Health, Clothing, Transportation, ',
        'Travel & Accommodation, Housing, Electronics, Leisure, Education, Services & Fees, ',
        'Prepared food or drinks, Other.')
      when kind = 7 then '"merchant" must be a string or null.'
      when kind = 8 then '"merchant" must be at most 100 characters.'
      when kind in (9, 10) then '"min_total" and "max_total" must be null or non-negative numbers.'
      when kind = 11 then '"min_total" must not be larger than "max_total".' end as error,
    case when kind in (12, 13, 14, 15, 16, 17, 19) then first end as from_day,
    case when kind in (12, 13, 14, 15, 16, 17, 19) then last end as to_day,
    case kind when 13 then 'Food|Health' when 17 then 'Leisure' end as wanted,
    case kind when 14 then 'CUSTOMER#0000' when 17 then '9' end as needle,
    case kind when 15 then 150000.5 when 17 then 1000 end as min_total,
    case kind when 16 then 90000 when 17 then 400000.25 end as max_total
  from requests)
"""


STATUS = """
status_events as (
  select id, 'pending' as status, created_at as updated_at from receipts
  union all
  select id, status, created_at + to_hours(id % 3) from receipts where status <> 'pending')
"""

REQUESTED_CALLS = """
numbered as (select *, id // 3 as request_no from calls),
requested as (
  select md5(concat('{"request_no":"', request_no, '"}')) as request_id,
    case when request_no % 2 = 0 then cast(request_no as varchar) end as receipt_id,
    case when request_no % 2 = 0 then 'text' else 'ask' end as endpoint,
    model, input_tokens, output_tokens, cache_read_input_tokens, cache_creation_input_tokens
  from numbered where request_no % 50 <> 0)
"""
