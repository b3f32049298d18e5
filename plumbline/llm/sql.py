"""DuckDB text that the queries must agree with, written as brute force."""

import re

_EDGES = r"""
tags as (select url, unnest(regexp_extract_all(replace(html, '&amp;', '&'), '(?is)<(?:link|meta)\b[^>]*>')) as tag from pages),
links as (select url, case when regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b') then regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    when regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') then regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) end as link from tags),
full_links as (select url, case when contains(link, '://') then link when starts_with(link, '//') then regexp_extract(url, '^(.*?)://', 1) || ':' || link
    else regexp_extract(url, '^(.*?://[^/?#]*)', 1) || case when starts_with(link, '/') then link
    when link[1] in ('?', '#') then path || link else regexp_replace(case when path = '' then '/' else path end, '[^/]*$', '') || link end end as link
    from links join (select distinct url, path from parts) using (url) where link <> ''),
hop as (select a.key as u, b.key as v from full_links f, lateral (select KEY(f.url) as key) a, lateral (select KEY(f.link) as key) b),
reach as (select u as node, v as other from hop union select v, u from hop union select r.node, h.v from reach r join (select u, v from hop union select v, u from hop) h on r.other = h.u),
"""


def _host(u):
    return f"translate(regexp_extract(case when contains({u}, '://') then substr({u}, instr({u}, '://') + 3) else '' end, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(u):
    return f"regexp_extract(case when contains({u}, '://') then substr({u}, instr({u}, '://') + 3) else '' end, '^[^/?#]*([^?#]*)', 1)"


def _key(u):
    query = f"regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^?#]*(\\?[^#]*)?', 1)"
    return f"case when {_host(u)} <> '' then {_host(u)} || case when {_path(u)} = '' then '/' else {_path(u)} end || {query} end"


def _fit(host, path, out):
    r = [("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block")]  # longest first
    pick = " ".join(f"when ('.' || {host}) like '%.{h}' and starts_with({path}, '{p}') then '{v if out == 'verdict' else h + p}'" for h, p, v in r)
    return f"case {pick} end"


def _edges():
    text = _EDGES
    for u in ("f.url", "f.link"):
        text = text.replace(f"KEY({u})", _key(u))
    return text


def _words(lowered):
    text = "coalesce(text, '')"
    if lowered:
        text = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(string_split_regex({text}, '[ \\x09-\\x0D]+'), lambda x: x <> '')"


def _weight(text: str) -> str:
    """Words and one: maximal runs of other than white space, unspaced scripts by their length."""
    from plumbline.llm.mixing import UNSPACED

    scripts = {re.sub(r"\\u(....)", r"\\x{\1}", c): n for c, n in UNSPACED.items()}
    every = f"[{''.join(scripts)}]+"
    words = "len(list_filter(string_split_regex({}, '[ \\x09-\\x0D]+'), lambda x: x <> ''))"
    parts = " + ".join(f"(length({text}) - length(regexp_replace({text}, '[{c}]+', '', 'g'))) / {n}.0" for c, n in scripts.items())
    spaced = words.format(f"regexp_replace({text}, '{every}', ' ', 'g')")
    return f"1 + case when strlen({text}) > length({text}) and regexp_matches({text}, '{every}') then ceil({parts})::bigint + {spaced} else {words.format(text)} end"


def _mixing(temperature=0.7, budget=0.7, seed="mix"):
    """Goals that can be reached, bounded raking as a recursion, calibration and draw."""
    from plumbline.llm.mixing import MARGINALS, SWEEPS, TOLERANCE, TOPICS

    marks = {n: " + ".join(f"(length(t) - length(replace(t, '{m}', ''))) / {len(m)}.0" for m in ms) for n, ms in TOPICS.items()}
    best = f"greatest({', '.join(marks.values())})"
    topic = "case " + " ".join(f"when {best} > 0 and {m} = {best} then '{n}'" for n, m in marks.items()) + " else 'prose' end"
    steps = [
        "d as (select doc_id, source, lang, coalesce(text, '') as t from documents)",
        f"marked as materialized (select doc_id, source, lang, {topic} as topic, {_weight('t')} as tokens from d)",
        "whole as materialized (select sum(tokens)::double as n from marked)",
        "cells as materialized (select source, lang, topic, sum(tokens)::bigint as tokens, sum(tokens) / n as fitted from marked, whole group by source, lang, topic, n)",
    ]

    def filled(name, table, order):
        """What each row of (tokens, fitted) gives: the neediest all, the others in proportion, together the budget."""
        return [
            f"{name}_need as (select *, fitted / tokens as need, (n * {budget} - coalesce(sum(tokens) over ({order} rows between unbounded preceding and 1 preceding), 0))"
            f" / sum(fitted) over ({order} rows between current row and unbounded following) as factor from {table}, whole)",
            f"{name} as materialized (select *, least(1.0, need * (select factor from {name}_need where factor * need <= 1 + 1e-12 order by need desc, factor desc limit 1)) as probability from {name}_need)",
        ]

    for m in MARGINALS:
        steps.append(f"own_{m} as (select {m}, sum(tokens) as tokens, power(sum(fitted), {temperature}) as fitted from cells group by 1)")
        steps.append(f"wanted_{m} as (select {m}, tokens, fitted / sum(fitted) over () as fitted from own_{m})")
        steps += filled(f"goal_{m}", f"wanted_{m}", f"order by fitted / tokens desc, {m} nulls first")
    goals = ", ".join(f"(select tokens * probability / ({budget} * n) from goal_{m} q where q.{m} is not distinct from z.{m}) as goal_{m}" for m in MARGINALS)
    steps.append(f"start as materialized (select z.*, tokens / ({budget} * n) as most, {goals} from cells z, whole)")
    last = f"(select * replace (k + 1 as k, 0.0::double as off) from r where off > {TOLERANCE} and k < {SWEEPS})"
    for m in MARGINALS:
        sums = (
            "sum(case when fitted < most then fitted else 0 end) over w as below, sum(case when fitted < most then 0 else most end) over w as taken,"
            " sum(fitted) over w as share, sum(most) over w as every, max(most / fitted) over w as fill"
        )
        scale = (
            f"case when goal_{m} >= every * (1 - 1e-12) then greatest(1.0, fill) when below > 0 and goal_{m} > taken then (goal_{m} - taken) / below else goal_{m} / share end"
        )
        last = (
            f"(select * exclude (below, taken, share, every, fill) replace (greatest(off, abs(below + taken - goal_{m})) as off, fitted * ({scale}) as fitted)"
            f" from (select *, {sums} from {last} window w as (partition by {m})))"
        )
    steps += [
        f"r as (select 0 as k, 1.0::double as off, * from start union all select * replace (max(off) over () as off) from {last})",
        "raked as (select * exclude (k, off) from r where k = (select max(k) from r))",
        *filled("p", "raked", "order by fitted / tokens desc, source nulls first, lang nulls first, topic"),
        f"drawn as (select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{seed}'), 1, 12))::bigint / 281474976710656.0 as draw from marked)",
    ]
    return (
        f"with recursive {', '.join(steps)} select doc_id, m.source, m.lang, m.topic, m.tokens, round(probability, 9) as probability, draw < probability as sampled from drawn m"
        " join p on p.source is not distinct from m.source and p.lang is not distinct from m.lang and p.topic = m.topic"
    )


SQL = {
    "op1_vector_components": """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select vec_id as node, vec_id as other from v union select r.node, l.y from reach r join link l on r.other = l.x),
least_of as (select node, min(other) as c from reach group by 1), n as (select x, count(*) as n from link group by 1)
select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c, vec_id) as component_id, coalesce(c, vec_id) = vec_id as kept
from embeddings left join least_of on node = vec_id left join n on x = vec_id""",
    "op7_minhash": f"""
with recursive w as (select doc_id, {_words(True)} as w from documents),
s as (select doc_id, case when len(w) < 2 then w else list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) end as s from w),
g as (select doc_id, len(s) as n, unnest(s) as g from s),
link as (select a.doc_id as x, b.doc_id as y from g a join g b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select doc_id as node, doc_id as other from s union select r.node, l.y from reach r join link l on r.other = l.x),
least_of as (select node, min(other) as c from reach group by 1)
select doc_id, len(s)::bigint as n_shingles, c as component_id, c = doc_id as kept from s join least_of on node = doc_id""",
    "op8_substrings": f"""
with w as (select doc_id, {_words(False)} as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50),
h as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from p),
f as (select h, min(doc_id) as d from h group by 1),
gone as (select distinct h.doc_id, i + k as pos from h join f on h.h = f.h and h.doc_id > f.d, range(50) r(k)),
cut as (select doc_id, list(pos) as g from gone group by 1),
kept as (select w.doc_id, len(w) as n, coalesce(len(g), 0) as r, case when g is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda x: not list_contains(g, x)), lambda x: w[x]) end as k
    from w left join cut on cut.doc_id = w.doc_id)
select doc_id, n::bigint as n_words, r::bigint as n_removed, sha256(coalesce(array_to_string(k, ' '), '')) as kept_sha256 from kept""",
    "op9_mixing": _mixing(),
    "op11_filter_audit": rf"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, min(doc_id) over (partition by coalesce(text, '')) as first_id from documents),
w as (select *, {_words(False).replace("coalesce(text, '')", "t")} as w from t),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    concat(case when len(w) < 200 then 'A' else '' end, case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end,
    case when 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t) then 'C' else '' end,
    case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end, case when doc_id > first_id then 'E' else '' end) as fails from w left join l using (doc_id)),
g as (select part, fails, good, toxic, count(*) as n from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, unnest(range(1, 6))::int as step from o),
r as (select part, filter_order, step, filter_order[step] as own,
    sum(case when translate(fails, filter_order[1:step], '') = fails then n else 0 end)::bigint as kept,
    sum(case when contains(fails, filter_order[step]) and translate(fails, filter_order[1:step - 1], '') = fails then n else 0 end)::bigint as removed,
    sum(case when contains(fails, filter_order[step]) and translate(fails, filter_order[1:step - 1], '') <> fails then n else 0 end)::bigint as redundant,
    sum(case when fails = filter_order[step] then n else 0 end)::bigint as unique_fails,
    sum(case when good and contains(fails, filter_order[step]) and translate(fails, filter_order[1:step - 1], '') = fails then n else 0 end)::bigint as good_lost,
    sum(case when toxic and contains(fails, filter_order[step]) and translate(fails, filter_order[1:step - 1], '') = fails then n else 0 end)::bigint as toxic_lost
    from g, s group by 1, 2, 3)
select * exclude (own), sum(removed) over (partition by part, own)::bigint as shapley from r""",
    # CRC-32 byte by byte over every distinct run of words; its table comes from the polynomial
    "op13_resampling": r"""
with recursive bits(v, c, k) as (select i, i, 0 from range(256) r(i) union all select v, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
tab as materialized (select list(c order by v) as t from bits where k = 8),
docs as (select 's' as side, doc_id as id, text from documents union all select 't', item_id, text from benchmark),
w as (select side, id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from docs),
g as (select side, r, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i])) as f from w
    union all select side, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w
    union all select side, r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w),
n as (select side, r, f, count(*) as n from g group by all),
d as (select f, hex(encode(f)) as h from (select distinct f from n)),
b as materialized (select f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 as b from d, tab),
c as (select b, sum(case when side = 's' then n else 0 end) as s, sum(case when side = 't' then n else 0 end) as t from n join b using (f) group by 1),
k as (select b, floor(1000 * ln((t + 1)::double * ((select sum(s) from c) + 10000) / ((s + 1)::double * ((select sum(t) from c) + 10000))))::bigint as gain from c),
x as (select r, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from n join b using (f) join k using (b) where side = 's' group by 1),
y as (select w.id as doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || sha256('42:' || coalesce(w.id::varchar, ''))[1:8])::bigint as h
    from w left join x using (r) where side = 's'),
z as (select doc_id, n_words >= 20 as fit, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from y),
q as (select *, row_number() over (partition by fit order by score desc, doc_id nulls last) as p, count(*) over (partition by fit) as m from z)
select doc_id, n_features, weight, score, case when fit and p <= 5 * m // 100 then p end::bigint as rank from q""",
    "op6_url_rules": f"""
with recursive parts as (select page_id, url, coalesce({_host('url')}, '') as host, coalesce({_path('url')}, '') as path, {_key('url')} as key from pages),
{_edges()}
ruled as (select node, other, {_fit(_host("('x://' || other)"), _path("('x://' || other)"), 'verdict')} as own,
    {_fit(_host("('x://' || node)"), _path("('x://' || node)"), 'verdict')} as mine from reach),
carried as (select node from ruled group by node having bool_or(coalesce(own, mine) = 'block' or mine = 'block') and not bool_or(coalesce(own = 'allow', false) or coalesce(mine = 'allow', false)))
select page_id, host, path, {_fit('host', 'path', 'rule')} as rule,
    coalesce({_fit('host', 'path', 'verdict')}, case when key in (select node from carried) then 'block' end, 'allow') as verdict from parts""",
}
