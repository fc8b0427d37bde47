"""Check SQL (DuckDB) for the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op8_url_templates"] = r"""
with recursive raw as (
  select page_id, row_number() over () as rid,
    case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
cut as (
  select page_id, rid, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from raw),
rules(verdict, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best as (
  select rid, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as rule_verdict from cut join rules
    on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by rid),
segs as (
  select c.*, rule, rule_verdict, list_filter(string_split(path, '/'), lambda s: s <> '') as parts from cut c left join best using (rid)),
norm as (
  select *, list_transform(case when len(parts) > 6 then list_append(parts[1:6], '**') else parts end, lambda s:
    case when s = '**' then s else regexp_replace(regexp_replace(s, '\b[0-9a-fA-F]{16,}\b', '<x>', 'g'), '[0-9]+', '<n>', 'g') end) as ns from segs),
named as (select *, array_to_string(ns, '/') as npath from norm),
p0 as (
  select host, npath, string_split(npath, '/') as ss, count(*) as n, count_if(coalesce(rule_verdict = 'block', false)) as bad, count_if(coalesce(rule_verdict = 'allow', false)) as good, '' as template
  from named group by host, npath),
""" + "".join(f"""
h{k} as (
  select *, ss[{k}] as seg, sum(n) over (partition by host, template, ss[{k}]) as own, sum(n) over (partition by host, template) as al from p{k - 1}),
p{k} as (
  select host, npath, ss, n, bad, good, case when seg is null then template when regexp_matches(seg, '^(<n>|<x>|\\*\\*)') then template || '/' || seg
    when own < 0.05 * al or own < 2 then template || '/*' else template || '/' || seg end as template from h{k}),""" for k in range(1, 8)) + r"""
one as (
  select host, template, sum(bad) as bad, sum(good) as good, regexp_replace(template, '^/[^/]*', '/*') as family from p7 group by host, template),
fam as (
  select *, sum(bad) over (partition by host, family) as ab, sum(bad + good) over (partition by host, family) as az from one),
rated as (select *, case when az > 0 then ab / az else 0.0 end as rate from fam),
pure as (
  select host, template, bad + good = 0 or abs(bad / greatest(bad + good, 1) - rate) <= 1.96 * sqrt(rate * (1 - rate) / greatest(bad + good, 1)) as merged,
    ab, az, bad, good from rated),
final as (
  select host, template, (case when merged then ab else bad end + 0.4::double) / (case when merged then az else bad + good end + 4.0::double) as purity from pure)
select page_id, host, path, rule, coalesce(rule_verdict, case when purity >= 0.5 then 'block' else 'allow' end) as verdict, template, purity
from named join p7 using (host, npath) join final using (host, template)
"""

_MIX = r"""
sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    case max_quality when 1 then 2.0::double when 0 then 0.5::double else 1.0::double end as quality
  from documents left join (select doc_id, max(quality) as max_quality from labels group by doc_id) using (doc_id)),
own as (
  select source, sum(size)::bigint as source_size, count(*) as source_rows,
    list_extract([5, 2, 1], ((row_number() over (order by source nulls last) - 1) % 3 + 1)::int) as weight from sized group by source),
lined as (select *, 2 * source_size / weight as ratio from own),
levels as (
  select *, (1.5::double * sum(source_size) over () - 2 * coalesce(sum(source_size) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from lined),
targets as (
  select source, source_size, least(2.0::double * source_size,
    coalesce((select arg_min(level, ratio) from levels where ratio > level), 0.0) * weight) as target from levels),
keyed as (
  select s.*, source_size, target,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) / quality as k
  from sized s join targets t on s.source is not distinct from t.source),
placed as (
  select *, sum(size) over (partition by source order by k, doc_id, size rows unbounded preceding) - size as start,
    case when source_size > 0 then floor(target / source_size) else 0 end::int as epochs from keyed),
mixed as (
  select *, epochs + case when epochs < 2 and start + size / 2 < target - epochs * source_size then 1 else 0 end as copies from placed)
"""
ORACLE["op9_source_mix"] = "with " + _MIX + """
select doc_id, source, size, source_size, target, (copies * size)::bigint as taken, epochs from mixed
"""

ORACLE["op11_digest_runs"] = r"""
with bare as (select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
ranked as (
  select doc_id, norm, first_value(doc_id) over (partition by norm order by points desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size
  from bare)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from ranked
"""

ORACLE["op13_prefix_audit"] = r"""
with docs as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (
  select rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from docs),
kept as (select lang, term, count(*) as lang_n from words group by lang, term having count(distinct rid) >= 10),
v as (select lang, count(*)::hugeint as v, sum(lang_n)::hugeint as lang_total from kept group by lang),
grp as (select distinct lang, source from docs),
own as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all),
total as (select lang, source, sum(n)::hugeint as total from own group by all),
shares as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // (coalesce(total, 0) + 2 * v) as p,
    1 + (1000000000::hugeint * (lang_n + 2)) // (lang_total + 2 * v) as q
  from grp g join kept k using (lang) join v using (lang) left join total t on t.lang = g.lang and t.source = g.source
    left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
other as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
    left join other o on o.lang = a.lang and o.source = a.source and o.item = b.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from shares where n > 0 and p > q),
numbered as (
  select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pairs union all select * from terms))
select * from numbered where part = 'pair' or rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
