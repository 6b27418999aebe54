"""SQL for DuckDB that gives the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from .lines import EDITS
from .quality import COMMON, COMMON_FIXED, COMMON_NOISE, MAX_CLASSES, MIN_WORDS_CLASSES, MIN_WORDS_COMMON

WORDS = r"[^\x20\x09-\x0D]+"

OP1 = rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
t as (select doc_id, len(s) as n, unnest(s) as g from s),
e as (select a.doc_id as a, b.doc_id as b from t a join t b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r as (select doc_id as d, doc_id as m from s union select r.d, e.b from r join e on r.m = e.a)
select s.doc_id as doc_id, len(s.s) as n_shingles, c.m as component_id from s join (select d, min(m) as m from r group by d) c on c.d = s.doc_id"""

#: One byte each, for letters beyond ASCII: the edit distance of DuckDB counts bytes. Enough for 27 different ones.
_ONE_BYTE = " || ".join(f"chr({i})" for i in (*range(1, 9), *range(14, 32), 127))

OP2 = rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as j from documents),
o as (select coalesce(string_agg(c, '' order by c), '') as letters from (select distinct c from (select unnest(string_split(text, '')) as c from documents) where unicode(c) > 127)),
f as (select s, translate(s, any_value(letters), substr({_ONE_BYTE}, 1, length(any_value(letters)))) as z, min({{'d': doc_id, 'j': j}}) as p from l, o where regexp_matches(s, '{WORDS}') group by s),
x as (select distinct b.s from f a join f b on a.p < b.p and abs(length(a.s) - length(b.s)) <= {EDITS} and levenshtein(a.z, b.z) <= {EDITS}),
k as (select l.doc_id, l.j, l.s, f.s is not null as word, (f.s is null or (f.p = {{'d': l.doc_id, 'j': l.j}} and x.s is null)) as keep from l left join f on l.s = f.s left join x on l.s = x.s)
select doc_id, coalesce(string_agg(s, chr(10) order by j) filter (keep), '') as text, count(*) filter (word) as n_lines, count(*) filter (not keep) as n_dropped from k group by doc_id"""


def _quality(rows: int) -> str:
    known = ", ".join(f"'{w}'" for w in sorted({w for ws in COMMON.values() for w in ws}))
    hits = ", ".join(f"{{'hits': len(list_filter(k, lambda x: x in ({', '.join(repr(w) for w in ws)}))), 'language': '{c}'}}" for c, ws in COMMON.items())
    listed = " ".join(f"when '{c}' then [{', '.join(f'len(list_filter(k, lambda x: x = {w!r}))' for w in ws)}]" for c, ws in COMMON.items())
    share = lambda c: f"list_transform({c}, lambda x: cast(floor((x * 1000000 + floor(list_sum({c}) / 2)) / greatest(list_sum({c}), 1)) as bigint))"
    sums = lambda c, n: f"[{', '.join(f'sum({c}[{i + 1}])' for i in range(n))}]"
    part = "case when {0} > 0 then {0} * log2(2 * {0} / ({0} + {1})) else 0 end"

    def distance(p: str, q: str, n: int) -> str:
        terms = []
        for i in range(1, n + 1):
            x, y = f"({p}[{i}] / greatest(list_sum({p}), 1))", f"({q}[{i}] / greatest(list_sum({q}), 1))"
            terms.append(f"({part.format(x, y)} + {part.format(y, x)}) / 2")
        return f"sqrt(greatest(0, {' + '.join(terms)}))"

    return rf"""with a as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORDS}') as w from documents),
b as (select *, len(w) as n, list_filter(w, lambda x: x in ({known})) as k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) as lines, list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'g': w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2]}}) as g from a),
u as (select doc_id, unnest(g) as g from b), v as (select doc_id, g.i as i, count(*) over (partition by doc_id, g.g) as c from u),
r as (select doc_id, count(distinct i + o) as n_repeat from v, range(3) z(o) where c > 1 group by doc_id),
c as (select b.*, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n_repeat, 0)::bigint as n_repeat_words,
 length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) as up, length(regexp_replace(t, '[^\p{{Nd}}]', '', 'g')) as di, length(regexp_replace(t, '[^.,;:!?''"()\-]', '', 'g')) as ma, list_max([{hits}]) as h from b left join r using (doc_id)),
d as (select *, (n < 50 or 100 * n_repeat_words > 50 * n) as base_failed, case when h.hits > 0 then h.language end as language, [word_chars - up - di - ma - n_symbols, up, di, length(t) - word_chars, ma, n_symbols] as cl from c),
e as (select *, case language {listed} else [{', '.join(['0'] * 12)}] end as li from d), f as (select *, {share('cl')} as p, list_append(li, n - coalesce(list_sum(li), 0)) as co from e), g as (select *, {share('co')} as q from f),
good as (select doc_id from labels where quality = 1 order by doc_id limit {rows}),
ref as (select language, {sums('p', 6)} as rp, {sums('q', 13)} as rq from g join good using (doc_id) where language is not null and n >= {MIN_WORDS_COMMON} group by language),
al as (select {sums('rp', 6)} as ap, {sums('rq', 13)} as aq from ref), o as (select [{', '.join(['0'] * 12)}, 1] as ot),
nr as (select min(dn) as dn from (select {distance('ot', 'rq', 13)} as dn from ref, o union all select {distance('ot', 'aq', 13)} from al, o)),
j as (select g.*, coalesce(ref.rp, al.ap) as rp, ref.rq as rq, nr.dn as dn from g left join ref using (language) cross join al cross join nr),
k as (select *, case when n >= {MIN_WORDS_CLASSES} then {distance('p', 'rp', 6)} end as dc, case when n >= {MIN_WORDS_CLASSES} then case when language is null then dn else {distance('q', 'rq', 13)} end end as dw from j)
select doc_id, n as n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and coalesce(dc, 0) <= {MAX_CLASSES} + 1.9 / sqrt(greatest(word_chars, 1)) and coalesce(dw, 0) <= {COMMON_FIXED} + {COMMON_NOISE} / sqrt(greatest(n, 1))) as kept from k"""


OP9 = """with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as x, min(page_id) over (partition by coalesce(html, '')) as f from pages)
select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(x, cast(i // 8 * 10 + 1 as bigint), 10) as bigint) >> (35 - 5 * (i % 8))::int) & 31), 1)), '') as payload_digest,
case when f = page_id then 'response' else 'revisit' end as record_type, case when f = page_id then null else f end as refers_to from p"""


def oracle_sql(reference_rows: int) -> dict[str, str]:
    return {"op1_ngram_join": OP1, "op2_line_dedup": OP2, "op8_quality_rules": _quality(reference_rows), "op9_warc": OP9}
