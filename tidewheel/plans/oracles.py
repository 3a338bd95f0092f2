"""SQL over the same tables that gives the same rows as each query."""

from __future__ import annotations

from tidewheel.schemas import FORM_FIELDS, LOAD_FIELDS, REPLY_ERROR

STAMP = "'%Y-%m-%d %H:%M:%S.%f'"

LINES = """
with t as (
  select *, case l_returnflag when 'R' then 1 when 'A' then 0 end as target
  from lineitem)"""

LINE_MOMENTS = f"""{LINES},
u as (
  select target, unnest(range(4))::int pos,
         unnest([l_quantity, l_extendedprice, l_discount, l_tax]) x
  from t where target is not null),
cc as (
  select target, count(*) n from t where target is not null group by target),
st as (
  select target as class_, pos, avg(x) theta, var_pop(x) sigma
  from u group by target, pos)"""

ROUNDED = """round(theta, 6) as theta,
  case when sigma > 10000 then round(sigma, 2) else round(sigma, 6) end as sigma"""

LINE_MODEL = f"""{LINE_MOMENTS}
select class_, pos, n * 1.0e0 as class_count,
  round(n * 1.0e0 / (select sum(n) from cc), 9) as class_prior, {ROUNDED}
from st join cc on class_ = target"""

EMBEDDING_MODEL = f"""
with u as (
  select label, unnest(range(len(embedding)))::int pos,
         cast(unnest(embedding) as double) x
  from embeddings),
cc as (select label, count(*) n from embeddings group by label),
st as (
  select label as class_, pos, avg(x) theta, var_pop(x) sigma
  from u group by label, pos)
select class_, pos, n * 1.0e0 as class_count,
  round(n * 1.0e0 / (select sum(n) from cc), 9) as class_prior, {ROUNDED}
from st join cc on class_ = label"""

_TERM = "ln(2e0 * pi() * v_{0}{1}) + ({1} - m_{0}{1}) * ({1} - m_{0}{1}) / v_{0}{1}"
_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line_class(c: int) -> str:
    moments = ", ".join(
        f"avg({f}) m_{c}{f}, var_pop({f}) v_{c}{f}" for f in _FEATURES
    )
    return f"select count(*) n{c}, {moments} from t where target = {c}"


def _line_joint(c: int) -> str:
    terms = " + ".join(_TERM.format(c, f) for f in _FEATURES)
    return f"ln(n{c} * 1.0e0 / (n0 + n1)) - 0.5e0 * ({terms})"


LINE_SCORED = f"""{LINES},
p0 as ({_line_class(0)}),
p1 as ({_line_class(1)}),
s as (
  select t.*, {_line_joint(1)} > {_line_joint(0)} as positive
  from t cross join p0 cross join p1)"""

EMBEDDING_SCORED = """
with long as (
  select vec_id, label, unnest(range(len(embedding)))::int pos,
         cast(unnest(embedding) as double) x
  from embeddings),
st as (
  select label, pos, avg(x) th, var_pop(x) sg from long group by label, pos),
pr as (
  select label, count(*) * 1.0e0 / (select count(*) from embeddings) p
  from embeddings group by label),
ll as (
  select l.vec_id, st.label c,
         -0.5e0 * sum(ln(2e0 * pi() * st.sg) + (l.x - st.th) * (l.x - st.th) / st.sg) s
  from long l join st on l.pos = st.pos group by l.vec_id, st.label),
jl as (select vec_id, c, ln(p) + s j from ll join pr on c = label),
rk as (
  select *, row_number() over (partition by vec_id order by j desc, c) r from jl)"""

MESSAGE = """'{"a":"' || cast(l_quantity as varchar) || '","b":"'
  || cast(l_extendedprice as varchar) || '","c":"' || cast(l_discount as varchar)
  || '","d":"' || cast(l_tax as varchar) || '"}'"""
LINE_CID = "'c-' || l_orderkey || '-' || l_linenumber"

_MEASURES = [
    *_FEATURES,
    "date_diff('day', date '1992-01-01', cast(l_shipdate as date))",
    "month(l_shipdate)",
]
_FORMS = ["{0}", "{0} * {0}", "sqrt(abs({0}))", "abs({0} - 10)", "{0} * l_quantity"]
_WIDE = ", ".join(
    f"cast({form.format(f'cast({m} as double)')} as double)" for m in _MEASURES for form in _FORMS
)
WIDE = f"""{LINES},
w as (
  select row_number() over () as row, l_orderkey, l_linenumber, target, [{_WIDE}] x
  from t),
u as (
  select row, l_orderkey, l_linenumber, target, unnest(range(30))::int pos, unnest(x) x
  from w),
st as (
  select target c, pos, avg(x) theta, var_pop(x) sigma
  from u where target is not null group by target, pos),
pr as (
  select target c, count(*) * 1.0e0 / sum(count(*)) over () p
  from w where target is not null group by target)"""

REPLIES = """
requests as (
  select cast(event_id as varchar) cid, user_id % 3 as inst, ts
  from events where event_type <> 'error'),
replies as (
  select cast(event_id as varchar) cid, user_id % 3 as inst, value > 100 as result,
         ts + to_seconds(event_id * 7 % 30) as reply_ts
  from events where event_type <> 'error' and event_id % 11 <> 0
  union all
  select cast(event_id as varchar), user_id % 3, value > 100,
         ts + to_seconds(event_id * 7 % 30 + 3)
  from events where event_id % 13 = 0 and event_type <> 'signup')"""


def _roundtrip(seconds: int = 15, same_instance: bool = True) -> str:
    instance = "and q.inst = p.inst" if same_instance else ""
    return f"""with {REPLIES},
j as (
  select q.cid, q.inst, q.ts, p.result, p.reply_ts,
         row_number() over (
           partition by q.cid order by p.reply_ts, p.result nulls first) rn
  from requests q left join replies p
    on q.cid = p.cid {instance}
   and p.reply_ts >= q.ts and p.reply_ts < q.ts + to_seconds({seconds})),
o as (select *, reply_ts is not null as ok from j where rn = 1)"""


ROUNDTRIP_ROWS = f"""
select cid, inst, ok, result, strftime(reply_ts, {STAMP}) as reply_ts from o"""

HEADERS = """
h as (
  select event_id, event_type, 'c-' || event_id c, 'r-' || event_id r,
         cast(user_id % 3 as varchar) i
  from events)"""

HEADER_VALUES = f"""with {HEADERS},
f as (
  select event_id,
         case event_type when 'purchase' then c when 'view' then r
              when 'signup' then c end as cid,
         case when event_type in ('purchase', 'view', 'click') then i end as inst
  from h)"""


def _drawn(field: int) -> str:
    digits = f"substr(sha256(event_id || '|{field // 4}|0'), {1 + 13 * (field % 4)}, 13)"
    return f"cast(cast('0x' || {digits} as bigint) as double) / 4503599627370496e0"


def _filled(fields: list[str], value: str, decimals: int) -> str:
    """First, last and summed values of messages with these fields."""
    drawn = ", ".join(value.format(_drawn(i)) for i in range(len(fields)))
    return f"""with v as (select event_id, [{drawn}] x from events)
select event_id, '{",".join(fields)}' as fields, round(x[1], {decimals}) as first,
  round(x[-1], {decimals}) as last, round(list_sum(x), 6) as total from v"""


ORACLES: dict[str, str] = {
    "csv_named_scan": """
select l_orderkey as id, l_returnflag as target, l_quantity as feature_1,
  l_extendedprice as feature_2, l_discount as feature_3, l_tax as feature_4
from lineitem""",
    "model_json_write": f"""{LINE_MOMENTS}
select target as class_, n * 1.0e0 as class_count,
  round(n * 1.0e0 / (select sum(n) from cc), 9) as class_prior from cc""",
    "model_json_read": LINE_MODEL,
    "topic_source": f"""
select {LINE_CID} as cid, {MESSAGE} as value
from lineitem""",
    "topic_sink": f"""{LINE_SCORED}
select cast(positive as varchar) as value, 0::int as place,
  'correlationId' as key, {LINE_CID} as text
from s""",
    "request_producer": """
select event_id,
  '{"event_type":"' || event_type || '","user_id":"' || user_id
    || '","value":"' || cast(value as varchar) || '"}' as value,
  cast(event_id as varchar) as cid, cast(user_id % 3 as varchar) as inst
from events""",
    "results_from_latest": f"""with {REPLIES}
select cid, inst, result, strftime(reply_ts, {STAMP}) as reply_ts
from replies where reply_ts > timestamp '2024-01-16 00:00:00'""",
    "synthetic_load": _filled(LOAD_FIELDS, "{}", 12),
    "form_random_fill": _filled(
        FORM_FIELDS, "cast(printf('%.2f', {}) as double)", 2
    ),
    "lake_listing": """
select event_type as kind, cast(sum(length(cast(event_id as varchar)) + 1) as bigint)
  as n_bytes
from events group by event_type""",
    "lake_ingest": """
select event_type, count(*) as n, cast(sum(event_id) as bigint) as ids,
  cast(sum(user_id) as bigint) as users
from events group by event_type""",
    "event_log": f"""{LINE_SCORED}
select l_orderkey, l_linenumber,
  'in=' || {MESSAGE} || ' headers=[correlationId=' || {LINE_CID} || ',x=T] out='
    || cast(positive as varchar) || ' to=[correlationId=' || {LINE_CID} || ']' as line
from s""",
    "drop_column": f"""{LINES}
select target, l_quantity, l_extendedprice, l_discount, l_tax from t""",
    "label_recode": f"""{LINES}
select l_returnflag, target, count(*) as n from t group by l_returnflag, target""",
    "label_counts": f"""{LINES}
select count(target) as labelled, count(*) - count(target) as unmapped from t""",
    "feature_assembly": f"""{LINES}
select target, 4::int as width, l_quantity as x0, l_extendedprice as x1,
  l_discount as x2, l_tax as x3
from t""",
    "table_shape": """
select count(*) as n_rows, 11::bigint as n_columns from lineitem""",
    "route_filter": f"""with {REPLIES}
select cid, inst, result, strftime(reply_ts, {STAMP}) as reply_ts
from replies where inst = 1""",
    "single_reply_filter": f"""with {REPLIES}
select cid, inst, result, strftime(reply_ts, {STAMP}) as reply_ts
from replies where cid = '26'""",
    "nb_classes": "select distinct label as class_ from embeddings",
    "nb_class_count": f"""{LINES}
select target as class_, count(*) as class_count
from t where target is not null group by target""",
    "nb_class_prior": f"""{LINE_MOMENTS}
select target as class_, round(n * 1.0e0 / (select sum(n) from cc), 9) as class_prior
from cc""",
    "nb_theta": f"{LINE_MOMENTS} select class_, pos, round(theta, 6) as theta from st",
    "nb_sigma": f"""{LINE_MOMENTS}
select class_, pos, sigma from (select class_, pos, {ROUNDED} from st)""",
    "nb_model": LINE_MODEL,
    "nb_model_array": EMBEDDING_MODEL,
    "json_features": """
select l_orderkey, l_linenumber, l_quantity as x0, l_extendedprice as x1,
  l_discount as x2, l_tax as x3
from lineitem""",
    "nb_log_likelihood": f"""{EMBEDDING_SCORED}
select vec_id, c as class_, round(s, 6) as log_likelihood from ll""",
    "nb_log_joint": f"""{EMBEDDING_SCORED}
select vec_id, c as class_, round(j, 6) as log_joint from jl""",
    "nb_proba": f"""{EMBEDDING_SCORED},
mx as (select vec_id, max(j) m from jl group by vec_id),
ex as (select jl.vec_id, c, exp(j - m) e from jl join mx on jl.vec_id = mx.vec_id)
select vec_id, c as class_, round(e / sum(e) over (partition by vec_id), 6) as proba
from ex""",
    "nb_argmax": f"{EMBEDDING_SCORED} select vec_id, c as predicted from rk where r = 1",
    "nb_is_positive": f"{LINE_SCORED} select l_orderkey, l_linenumber, positive from s",
    "nb_predict_batch": f"""{LINE_SCORED}
select target, cast(positive as int) as predicted, positive, count(*) as n
from s group by target, positive""",
    "nb_model_wide": f"""{WIDE}
select c as class_, pos, round(theta, 4) as theta, printf('%.6e', sigma) as sigma
from st""",
    "nb_predict_wide": f"""{WIDE},
j as (
  select row, l_orderkey, l_linenumber, c,
    sum(ln(2e0 * pi() * sigma) + (x - theta) * (x - theta) / sigma) * -0.5e0 s
  from u join st using (pos) group by row, l_orderkey, l_linenumber, c)
select l_orderkey, l_linenumber,
  max(case when c = 1 then s + ln(p) end) > max(case when c = 0 then s + ln(p) end)
    as positive
from j join pr using (c) group by row, l_orderkey, l_linenumber""",
    "nb_predict_array": f"""{EMBEDDING_SCORED}
select e.label, c as predicted, c = 1 as positive, count(*) as n
from rk join embeddings e on rk.vec_id = e.vec_id where r = 1
group by e.label, c""",
    "nb_predict_stream": f"""{LINE_SCORED}
select l_orderkey, l_linenumber, positive as result, cast(null as varchar) as error
from s""",
    "event_counts": f"""{LINE_SCORED}
select count(*) as received, count(*) as scored, 0::bigint as rejected,
  cast(sum(positive::int) as bigint) as positive
from s""",
    "nb_predict_refreshed": f"""{LINES},
p0 as ({_line_class(0)}),
p1 as ({_line_class(1)}),
e0 as ({_line_class(0)} and l_linenumber <= 3),
e1 as ({_line_class(1)} and l_linenumber <= 3)
select l_orderkey, l_linenumber, {_line_joint(1)} > {_line_joint(0)} as result
from t cross join p0 cross join p1 where l_linenumber <= 3
union all
select l_orderkey, l_linenumber, {_line_joint(1)} > {_line_joint(0)}
from t cross join e0 cross join e1 where l_linenumber > 3""",
    "header_decode": f"""with {HEADERS}
select event_id, unnest(range(3))::int as place,
  unnest(['correlationId', 'trace', 'instanceId']) as key, unnest([c, 'T', i]) as text
from h where event_type = 'purchase'
union all
select event_id, unnest(range(3))::int,
  unnest(['instanceId', 'correlationId', 'correlationId']), unnest([i, c, r])
from h where event_type = 'view'
union all
select event_id, unnest(range(2))::int,
  unnest(['trace', 'correlationId']), unnest(['T', c])
from h where event_type = 'signup'
union all
select event_id, unnest(range(3))::int,
  unnest(['correlationId', 'correlationId', 'instanceId']), unnest([c, null, i])
from h where event_type = 'click'""",
    "header_lookup": f"{HEADER_VALUES} select event_id, cid, inst from f",
    "header_forward": f"""{HEADER_VALUES}
select event_id,
  (case when cid is null then 0 else 1 end
    + case when inst is null then 0 else 1 end)::int as n_headers,
  concat_ws(',', 'correlationId=' || cid, 'instanceId=' || inst) as headers
from f""",
    "header_encode": """
select doc_id, md5(text) as digest, octet_length(encode(text)) as n_bytes
from documents""",
    "json_or_raw": """
select event_id,
  case event_type when 'view' then cast(value > 100 as varchar)
       when 'click' then cast(json(props) as varchar)
       when 'signup' then user_id || ' ' || event_type
       when 'purchase' then 'oops ' || props else '' end as parsed,
  case when event_type = 'view' then value > 100 end as flag
from events""",
    "json_or_raw_text": """
select doc_id,
  md5(case when json_valid(text) then cast(json(text) as varchar) else text end)
    as digest,
  json_valid(text) as is_json
from documents""",
    "correlation_id": """
select event_id,
  'consumer-id-' || epoch_us(ts) // 1000 || '-' || md5(cast(event_id as varchar)) as cid
from events""",
    "parse_int_prefix": r"""
select event_id,
  coalesce(try_cast(regexp_extract(event_id || event_type, '^\s*([+-]?\d+)', 1)
    as bigint), 0) as leading,
  coalesce(try_cast(regexp_extract(props, '^\s*([+-]?\d+)', 1) as bigint), 0)
    as not_a_number,
  coalesce(try_cast(regexp_extract(split_part(props, ':', -1), '^\s*([+-]?\d+)', 1)
    as bigint), 0) as inner_number,
  coalesce(try_cast(regexp_extract('-' || cast(value as varchar), '^\s*([+-]?\d+)', 1)
    as bigint), 0) as signed
from events""",
    "reply_envelope": f"""{_roundtrip()}
select cid, ok, case when ok then '{{"ok":true,"result":' || result || '}}'
  else '{{"ok":false,"error":"{REPLY_ERROR}"}}' end as reply
from o""",
    "reply_match": f"""with {REPLIES}
select q.cid, q.inst, strftime(q.ts, {STAMP}) as ts,
  strftime(p.reply_ts, {STAMP}) as reply_ts, p.result
from requests q join replies p
  on q.cid = p.cid and q.inst = p.inst
 and p.reply_ts >= q.ts and p.reply_ts < q.ts + to_seconds(15)""",
    "reply_timeouts": f"""with {REPLIES}
select cid, inst from requests q where not exists (
  select 1 from replies p
  where p.cid = q.cid and p.inst = q.inst
    and p.reply_ts >= q.ts and p.reply_ts < q.ts + to_seconds(15))""",
    "reply_first_wins": f"""{_roundtrip()}
select cid, inst, result, strftime(reply_ts, {STAMP}) as reply_ts from o where ok""",
    "reply_roundtrip": f"{_roundtrip()} {ROUNDTRIP_ROWS}",
    "reply_one_off": f"{_roundtrip(10, same_instance=False)} {ROUNDTRIP_ROWS}",
    "reply_roundtrip_stream": f"""{_roundtrip()}
select cid, inst, ok, result, epoch_us(reply_ts) - epoch_us(ts) as wait_us from o""",
    "visit_count": """
select event_type as page, count(*) as visits from events group by event_type""",
    "visit_number": """
select event_type as page, event_id,
  row_number() over (partition by event_type order by ts, event_id) as visit
from events""",
    "metric_latest": f"""
select event_type as name, cast(user_id as varchar) as user,
  strftime(max(ts), {STAMP}) as ts, arg_max(value, (ts, value)) as value
from events group by event_type, user_id""",
    "metric_selector": """
select event_type as name, cast(user_id as varchar) as user,
  arg_max(value, (ts, value)) as value
from events where event_type = 'purchase' and user_id = 7
group by event_type, user_id""",
    "topic_backlog": f"""with {REPLIES}
select strftime(ts, '%Y-%m-%d') as bucket, count(*) as backlog
from requests q where not exists (select 1 from replies p where p.cid = q.cid)
group by 1""",
}
ORACLES["visit_count_resume"] = ORACLES["visit_count"]
ORACLES["topic_backlog_live"] = """
select count(*) filter (ts < timestamp '2024-01-16') as received,
  count(*) filter (ts >= timestamp '2024-01-16') as backlog
from events where event_type <> 'error'"""
ORACLES["visit_number_live"] = ORACLES["visit_number"]
ORACLES["results_from_latest_stream"] = ORACLES["results_from_latest"]
ORACLES["reply_outcomes_live"] = ORACLES["reply_roundtrip_stream"]
ORACLES["reply_timeouts_live"] = ORACLES["reply_timeouts"]
ORACLES["nb_log_likelihood_long"] = ORACLES["nb_log_likelihood"]
ORACLES["nb_predict_long"] = f"""{EMBEDDING_SCORED}
select vec_id, c as predicted, c = 1 as positive from rk where r = 1"""
