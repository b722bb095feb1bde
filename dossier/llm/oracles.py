"""SQL that gives the rows of the corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

from . import licenses, mixing
from .licenses import THRESHOLD

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

MIX = f"""with d as (select doc_id, source, {_WORDS}::bigint as size, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, {mixing.KEY_BITS // 4}))::bigint as key from documents),
 s as (select source, sum(size) as source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w from d group by source),
 c as (select *, 3.0 * source_size as cap, sum(source_size) over ()::double as total from s),
 o as (select *, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as caps, sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as rest from c),
 l as (select *, max(case when (total - caps) / rest * w <= cap then (total - caps) / rest end) over () as level from o),
 t as (select *, least(cap, coalesce(level * w, cap)) as target from l),
 g as (select *, floor(target)::bigint as goal, case when source_size > 0 then floor(floor(target) / source_size)::bigint else 0 end as epochs from t),
 r as (select d.*, g.source_size, g.target, g.epochs, sum(d.size) over (partition by d.source, d.key) as words, g.goal - g.epochs * g.source_size - (sum(d.size) over (partition by d.source order by d.key) - sum(d.size) over (partition by d.source, d.key)) as part from d join g on d.source is not distinct from g.source)
 select doc_id, size, source_size::bigint as source_size, target, (epochs * size + case when words > 0 then floor(size * greatest(0, least(part, words))::double / words) else 0 end)::bigint as taken from r"""

_TEMPLATES = ", ".join(
    "('{}', [{}])".format(name, ", ".join("'" + g + "'" for g in licenses.bigrams(t))) for name, texts in licenses.TEMPLATES.items() for t in texts
)
_DICE = f"{(2.0 - THRESHOLD) / THRESHOLD} + 1e-9"  # a coefficient of the threshold bounds the sizes' ratio, so no pair beyond it can count
LICENSES = rf"""with t(license, own) as (values {_TEMPLATES}), tn as (select license, own, row_number() over () as n from t),
 d as (select row_number() over () as r, doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') as text from documents where text is not null),
 u as (select distinct doc_id, unit from (select doc_id, unnest(list_concat(list_concat(string_split(text, chr(10)), regexp_split_to_array(regexp_replace(text, '(?m)^[ \t]*(//+|#+|\*+|--+|;+|/\*+|<!--)', '', 'g'), '\n[ \t]*\n')), [text])) as unit from d)),
 w as (select doc_id, list_filter(regexp_split_to_array(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') as w, unit from u),
 g as (select doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w where len(w) >= 2),
 h as (select doc_id, unit, license, max(2.0 * len(list_intersect(g, own)) / (len(g) + len(own))) as dice from g join t on len(g) <= len(own) * ({_DICE}) and len(own) <= len(g) * ({_DICE}) group by doc_id, unit, license),
 x as (select r, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') as w from d),
 p as (select r, doc_id, unnest(range(1, len(w))) as pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as gram from x where len(w) >= 2),
 o as (select license, n, len(own) as m, unnest(own) as gram from tn),
 i as (select p.r, p.doc_id, o.license, o.n, o.m, p.pos, p.gram from p join o on p.gram = o.gram),
 k as (select a.doc_id, a.license, a.r, a.n, a.pos, count(distinct b.gram) * 1.0 / any_value(a.m) as dice from i a join i b on a.r = b.r and a.n = b.n and b.pos between a.pos and a.pos + a.m - 1 group by all),
 z as (select doc_id, license, dice, 1 as unit from h where dice >= {THRESHOLD} union all select doc_id, license, dice, 0 from k where dice >= {THRESHOLD})
 select doc_id, license, max(dice) as dice, sum(unit)::bigint as n_units from z group by doc_id, license"""

_FOUR = "||".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::bigint >> {20 - 5 * k}) & 31)::int + 1, 1)" for g in range(8) for k in range(1, 5))
WARC = f"""with p as (select page_id, sha1(coalesce(html, '')) as h, strlen(coalesce(html, ''))::bigint as n from pages),
 f as (select h, n, min(page_id) as first from p group by h, n)
 select page_id, p.n as payload_bytes, {_FOUR.replace("substr(h,", "substr(p.h,")} as payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to
 from p join f on p.h = f.h and p.n = f.n"""

SUFFIX = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
 w as (select doc_id, unnest(range(strlen(x)::bigint // 2 - 49)) as k, unnest(list_transform(range(strlen(x)::bigint // 2 - 49), lambda i: md5(substr(x, 2 * i + 1, 100)))) as s from d where strlen(x) >= 100),
 m as (select s, min(doc_id) as least from w group by s),
 g as (select w.doc_id, w.k from w join m on w.s = m.s where w.doc_id > m.least),
 b as (select doc_id, unnest(range(strlen(x)::bigint // 2)) as k, unnest(list_transform(range(strlen(x)::bigint // 2), lambda i: substr(x, 2 * i + 1, 2))) as c from d where strlen(x) > 0),
 c as (select b.doc_id, b.k, b.c, max(g.k) over (partition by b.doc_id order by b.k rows between 49 preceding and current row) is not null as gone from b left join g on g.doc_id = b.doc_id and g.k = b.k),
 e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by k), false) as starts from c),
 a as (select doc_id, count(*) filter (gone)::bigint as n_removed, count(*) filter (starts)::bigint as n_spans, coalesce(string_agg(c, '' order by k) filter (not gone), '') as rest from e group by doc_id)
 select d.doc_id, strlen(x)::bigint // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(rest, ''))) as kept_sha256 from d left join a on a.doc_id = d.doc_id"""

EMBEDDINGS = """with recursive v as (select vec_id, embedding::double[] as v from embeddings),
 e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.95),
 r(node, top) as (select vec_id, vec_id from v union select e.b, r.top from r join e on e.a = r.node),
 c as (select node, min(top) as component from r group by node), n as (select a, count(*) as n from e group by a)
 select v.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component as component_id, c.component = v.vec_id as kept from v join c on c.node = v.vec_id left join n on n.a = v.vec_id"""

HTML = r"""with a as (select page_id, url, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) as t from pages),
 b as (select page_id, url, regexp_replace(regexp_replace(t, '</?(b|i|em|strong|a|span)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') as t from a),
 c as (select page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&nbsp;?', ' ', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as t from b)
 select page_id, url, t as text, length(t)::bigint as n_chars from c"""

_CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, n: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, beside a table ``crc`` of the remainders of all bytes."""
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({text}) + 1), lambda n: ascii(substr({text}, n::int, 1))::bigint)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


CONVERSATIONS = rf"""with recursive tables as ({_CRC_TABLE}),
 k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
 d as (select k.*, {_crc32("key")} % 20 as kind from k, tables),
 w as (select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case kind when 3 then 2 else 1 end)) as copy from d where kind <> 0),
 f as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) as last from w),
 r as (select conv_id, turn, role, text, i, left(role, 1) as c, last = '' as blank, last <> '' and again as duplicate, last <> '' and not again and last not in ('.', '!', '?') as truncated, lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair from f),
 n as (select conv_id, count(*) as n, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated, count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal from r group by conv_id),
 steps(q, c, t) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
 names(c, name) as (values ('u', 'user'), ('a', 'assistant')),
 ins(q, t, edits, price, made) as (select q, q, '', 0, []::varchar[] from (values (0), (1), (2), (3)) v(q) union all
  select ins.q, steps.t, edits || 'I', price + 3, list_append(made, name || ':') from ins join steps on steps.q = ins.t join names using (c) where price < 12),
 p(conv_id, i, q, best) as (select conv_id, 0, 0, {{'cost': 0, 'audit': '', 'made': []::varchar[]}} from n union all
  select conv_id, i, q, min(best) from (
   select p.conv_id, p.i + 1 as i, x.t as q, {{'cost': best.cost + ins.price + x.price + case when truncated and x.edit <> 'D' then 3 else 0 end, 'audit': best.audit || ins.edits || x.edit, 'made': list_concat(best.made, ins.made, case x.edit when 'D' then [] when 'K' then [role || ':' || text] else [name || ':' || text] end)}} as best
   from p join r on r.conv_id is not distinct from p.conv_id and r.i = p.i + 1 join ins on ins.q = p.q
   join (select q, 'D' as edit, 4 as price, q as t, '' as c from (values (0), (1), (2), (3)) v(q) union all select q, 'K', 0, t, c from steps union all select q, 'R', 3, t, c from steps where c <> 's') x
    on x.q = ins.t and (x.edit <> 'K' or x.c = r.c) and (x.edit = 'D' or not (blank or duplicate)) left join names on names.c = x.c) group by conv_id, i, q),
 e as (select p.conv_id, min({{'cost': best.cost + ins.price, 'audit': best.audit || ins.edits, 'made': list_concat(best.made, ins.made)}}) as best from p join n on p.conv_id is not distinct from n.conv_id and p.i = n.n join ins on ins.q = p.q where ins.t in (0, 3) group by p.conv_id),
 o as (select distinct conv_id from conversations)
 select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
 coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.made, chr(10)), '')) as repaired_sha256
 from o left join n on n.conv_id is not distinct from o.conv_id left join e on e.conv_id is not distinct from o.conv_id"""

RUNS = rf"""with tables as ({_CRC_TABLE}),
 d as (select row_number() over () as r, doc_id, coalesce(doc_id::varchar, '') as key, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
 h as (select r, doc_id, w, len(w) as n, {_crc32("key")} as h from d, tables),
 a as (select *, h // 10 as g, case when doc_id is not null and n > 0 and h % 10 = 0 then (h // 10) % n end as a from h),
 p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
 e as (select r, doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[(case when i < a then i else a + (i - a) % p end) + 1]) end as w from p),
 s as (select r, n, unnest(range(n - 15)) as i, unnest(list_transform(range(n - 15), lambda i: md5(array_to_string(w[i + 1:i + 16], ' ')))) as gram from e where n >= 24),
 t as (select x.r, x.i, y.i - x.i as q from s x join s y on x.r = y.r and x.gram = y.gram and y.i > x.i and 3 * (y.i - x.i) <= x.n),
 i as (select r, q, i, i - row_number() over (partition by r, q order by i) as island from t),
 l as (select r, q, min(i) as start, count(*) + 15 + q as length from i group by r, q, island),
 u as (select r, start, length, min(q) as period from l where length >= greatest(24, 3 * q) group by r, start, length),
 b as (select r, count(*) as n_runs, min({{'less': -length::double / period, 'start': start, 'period': period, 'length': length}}) as best, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from u group by r),
 x as (select distinct r, unnest(range(start + period, start + length)) as i from u),
 k as (select r, unnest(range(n)) as i, unnest(w) as w from e),
 c as (select r, string_agg(w, ' ' order by i) as rest from k anti join x using (r, i) group by r)
 select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.start::bigint as start, best.length::bigint as length, best.period::bigint as period, (1000 * best.length // best.period)::bigint as exponent_milli,
 sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(rest, '')) as collapsed_sha256 from e left join b using (r) left join c using (r)"""

ORACLE_SQL = {
    "op3_mix": MIX,
    "op5_html": HTML,
    "op7_licenses": LICENSES,
    "op8_warc": WARC,
    "op9_suffix_dedup": SUFFIX,
    "op10_embeddings": EMBEDDINGS,
    "op11_conversations": CONVERSATIONS,
    "op13_periodic": RUNS,
}
