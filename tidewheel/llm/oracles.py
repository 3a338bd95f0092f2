"""SQL for the queries that it can express on small tables."""

from __future__ import annotations

from tidewheel.llm.line_dedup import AUTHORITY, BLOCK_TAG, HIDDEN, LEAST_PAGES, RATIO

SPACE = r"[\x20\x09-\x0D]"
WORDS = f"""list_filter(
    regexp_split_to_array({{0}}, '{SPACE}+'), lambda x: x <> '')"""

# CRC-32 by bytes: a table from the polynomial, then one step a byte.
CRC_TABLE = """
crc as (
  select list_transform(range(256), lambda x: list_reduce(
    range(1, 9), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end,
    x)) as steps)"""
CRC = """xor(4294967295, list_reduce(
    list_transform(regexp_extract_all(hex({0}), '..'), lambda h: cast('0x' || h as bigint)),
    lambda c, b: xor(c >> 8, steps[cast((xor(c, b) & 255) + 1 as int)]),
    cast(4294967295 as bigint)))"""

OP3 = f"""with {CRC_TABLE},
d as (
  select doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 as size,
    {CRC.format("coalesce(text, '')")} as text_crc32
  from documents, crc),
h as (
  select *, coalesce('=' || source, '') as s,
    md5('0' || chr(31) || coalesce(cast(doc_id as varchar), '') || chr(31)
      || text_crc32) as hash
  from d),
r as (
  select *, row_number() over (partition by s order by hash, doc_id) as rank,
    count(*) over (partition by s) as own, count(*) over () as total
  from h),
o as (
  select *, row_number() over (
    order by (2 * rank - 1) * 1.0e0 / (2 * own), hash, doc_id, s) - 1 as place from r),
c as (select *, place * 40 // total as shard from o)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32,
  'rows' as law, cast(shard as int) as shard,
  cast(place - (shard * total + 39) // 40 as bigint) as slot, cast(null as int) as grown_shard
from c"""

OP8 = f"""with recursive
d as (
  select doc_id, {WORDS.format(
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
  )} as w from documents),
h as (
  select distinct doc_id, md5(array_to_string(w[i:i + 4], ' ')) as t
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i
        from d where len(w) > 0)),
n as (select doc_id, count(*) as n from h group by doc_id),
e as (
  select a.doc_id as a, b.doc_id as b
  from h a join h b on a.t = b.t and a.doc_id <> b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n
  having 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r as (
  select doc_id as id, doc_id as reached from documents
  union select r.id, e.b from r join e on e.a = r.reached)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, min(r.reached) as component_id
from d left join n using (doc_id) join r on r.id = d.doc_id
group by d.doc_id, n.n"""

_TRIMMED = f"regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')"
OP9 = f"""with p as (
  select page_id, lower(nullif(regexp_extract(url, '{AUTHORITY}', 1), '')) as host,
    string_split(regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'g'),
      '{BLOCK_TAG}', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) as lines
  from pages),
t as (select host, count(*) as pages from p where host is not null group by host),
l as (
  select host, unnest(list_distinct(list_filter(
    list_transform(lines, lambda x: {_TRIMMED}), lambda x: x <> ''))) as line
  from p where host is not null),
k as (
  select host, list(line) as known from (
    select l.host, line from l join t using (host)
    where pages >= {LEAST_PAGES}
    group by l.host, line, pages having count(*) > {RATIO}e0 * pages)
  group by host),
c as (
  select page_id, lines, list_filter(lines,
    lambda x: {_TRIMMED} = '' or not list_contains(coalesce(known, []), {_TRIMMED})) as stay
  from p left join k using (host)),
s as (
  select *, len(list_filter(lines, lambda x: {_TRIMMED} <> '')) as shown,
    len(list_filter(stay, lambda x: {_TRIMMED} <> '')) as left_
  from c)
select page_id, cast(coalesce(shown, 0) as bigint) as n_lines,
  cast(coalesce(shown - left_, 0) as bigint) as n_dropped,
  sha256(coalesce(array_to_string(stay, chr(10)), '')) as clean_sha256
from s"""

OP10 = f"""with d as (
  select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
h as (
  select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as t
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
r as (select doc_id, i, row_number() over (partition by t order by doc_id, i) as nth from h),
g as (
  select doc_id, list_distinct(flatten(list(range(i, i + 20)))) as gone
  from r where nth > 1 group by doc_id),
k as (
  select doc_id, len(w) as n, len(coalesce(gone, [])) as n_gone, list_filter(
    list_transform(range(1, len(w) + 1), lambda j: case
      when list_contains(coalesce(gone, []), j) then null else w[j] end),
    lambda x: x is not null) as stay
  from d left join g using (doc_id))
select doc_id, cast(n as bigint) as n_words, cast(n_gone as bigint) as n_removed,
  sha256(coalesce(array_to_string(stay, ' '), '')) as kept_sha256
from k"""

OP11 = f"""with recursive {CRC_TABLE},
r as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run
        from documents)
  group by all),
h as (
  select *, {CRC.format("coalesce(cast(doc_id as varchar), '') || ':' || run")} as hash
  from r, crc),
d as (
  select n, case when hash % 97 <> 0 then run else left(run, cast(hash % length(run) as int))
    || substr(run, cast(hash % length(run) as int) + 2) end as word
  from h),
v as (
  select word, cast(sum(n) as bigint) as n from d
  where length(word) >= 5 group by word having sum(n) >= 3),
e as (select word, n, unnest(range(1, length(word) + 1)) as i from v),
k as (
  select word, n, left(word, i - 1) || '_' || substr(word, i + 1) as pattern,
    left(word, i - 1) || substr(word, i + 1) as shorter
  from e),
one as (
  select a.word, b.word as near, b.n as near_n
  from k a join k b on a.pattern = b.pattern and a.word <> b.word),
less as (
  select distinct k.word, v.word as near, k.n, v.n as near_n
  from k join v on v.word = k.shorter),
p as (
  select * from one union all select word, near, near_n from less
  union all select near, word, n from less),
b as (
  select word, near, near_n, count(*) over (partition by word) as n_near,
    row_number() over (partition by word order by near_n desc, near) as place
  from p),
f as (
  select v.word, v.n, cast(coalesce(n_near, 0) as bigint) as n_near,
    case when near_n >= 2 * v.n then near end as form,
    case when near_n >= 2 * v.n then near_n end as form_n
  from v left join b on b.word = v.word and place = 1),
c as (
  select word, word as tip, 0 as hops from f
  union all select c.word, f.form, hops + 1 from c join f on f.word = c.tip
  where f.form is not null)
select word, form, arg_max(tip, hops) as root, n, n_near, form_n
from f join c using (word) group by word, form, n, n_near, form_n"""

OP12 = """with d as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t
  from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
from d join g using (t)"""

ORACLES: dict[str, str] = {
    "op3_interleaved_shards": OP3,
    "op8_jaccard_join": OP8,
    "op9_site_lines": OP9,
    "op10_fm_index_dedup": OP10,
    "op11_spelling_variants": OP11,
    "op12_exact_dedup": OP12,
}
