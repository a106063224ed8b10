"""SQL for those corpus queries that SQL can express on whole tables, written from the same parameters."""

from __future__ import annotations

from . import linededup, spelling, urls


def near_vectors_sql(cosine: float) -> str:
    return f"""with recursive v as (select vec_id, label, cast(embedding as double[]) e from embeddings where label is not null and vec_id is not null and embedding is not null
and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {cosine}),
reach as (select vec_id a, vec_id b from v union select r.a, p.b from reach r join p on r.b = p.a),
c as (select a, min(b) component_id from reach group by 1), n as (select a, count(*) n from p group by 1)
select vec_id, cast(coalesce(n.n, 0) as bigint) n_links, coalesce(c.component_id, vec_id) component_id, vec_id = coalesce(c.component_id, vec_id) kept
from embeddings left join c on c.a = vec_id left join n on n.a = vec_id"""


def mix_sql(levels: dict[str, str], weights: dict[str, int], fraction: float, seed: int, epochs: int) -> str:
    names = list(levels)
    ctes = [
        f"""d as (select * from (select doc_id, {', '.join(f"coalesce(cast({e} as varchar), '') {n}" for n, e in levels.items())}, cast(coalesce(ceil(strlen(text) / 4.0), 0) as bigint) tokens from documents) where tokens > 0 and doc_id is not null)""",
        f"leaf as (select {', '.join(names)}, sum(tokens)::hugeint tokens from d group by all)",
    ]

    def weight(depth: int) -> str:
        path = " || '/' || ".join(names[:depth])
        cases = " ".join(f"when '{k}' then {w}" for k, w in sorted(weights.items()) if k.count("/") == depth - 1)
        return f"(case {path} {cases} else 1 end)" if cases else "1"

    alive = " and ".join(f"{weight(k)} > 0" for k in range(1, len(names) + 1))
    ctes.append(f"alive as (select * from leaf where {alive})")
    ctes.append(f"n0 as (select least(floor(sum(tokens) * {fraction}), sum(tokens) * {epochs})::hugeint budget from alive having count(*) > 0)")
    for k in range(1, len(names) + 1):
        here, up = names[:k], names[: k - 1]
        part = f"partition by {', '.join(up)}" if up else ""
        order = f"{part} order by most::double / w::double, {', '.join(here)}"
        join = f"join n{k - 1} using ({', '.join(up)})" if up else "cross join n0"
        ctes += [
            f"k{k} as (select * from (select {', '.join(here)}, (sum(tokens) * {epochs})::hugeint most, any_value({weight(k)})::hugeint w from alive group by {', '.join(here)}) {join})",
            f"""f{k} as (select *, most * (sum(w) over ({order} rows between current row and unbounded following))::hugeint <= (budget - coalesce(sum(most) over ({order} rows between unbounded preceding and 1 preceding), 0)::hugeint) * w as is_full from k{k})""",
            f"""g{k} as (select *, sum(case when is_full then most else 0 end) over ({part})::hugeint given, sum(case when is_full then 0 else w end) over ({part})::hugeint open_w from f{k})""",
            f"n{k} as (select {', '.join(here)}, case when is_full then most else ((budget - given) * w) // open_w end::hugeint budget from g{k})",
        ]
    on = ", ".join(names)
    ctes += [
        f"plan as (select {on}, (budget // tokens)::int whole, budget % tokens part from alive join n{len(names)} using ({on}) where budget > 0)",
        f"""r as (select d.*, whole, part, sum(d.tokens) over (partition by {on} order by md5('{seed}:' || whole || ':' || doc_id), doc_id rows unbounded preceding) upto from d join plan using ({on}))""",
    ]
    return f"""with {', '.join(ctes)} select doc_id, {on}, tokens, epoch::int epoch from (select doc_id, {on}, tokens, unnest(range(whole)) epoch from r union all select doc_id, {on}, tokens, whole from r where upto <= part)"""


def urls_sql(rules) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    fits = lambda h, p: f"((host = {quote(h)} or ends_with(host, {quote('.' + h)})) and starts_with(path, {quote(p)}))"
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = "case " + " ".join(f"when {fits(h, p)} then {quote(h + p)}" for _, h, p in ordered) + " end"
    told = "case " + " ".join(f"when {fits(h, p)} then {quote(v)}" for v, h, p in ordered) + " end"
    host = lambda u: f"translate(coalesce(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), ''), '{urls.UPPER}', '{urls.LOWER}')"
    ctes = [
        f"j as (select *, {rule} rule, {told} told from (select page_id, {host('url')} host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') path from pages))",
        "seed as (select host, avg(case when told = 'allow' then 1.0 else 0.0 end) trust, avg(case when told = 'block' then 1.0 else 0.0 end) distrust from j group by 1)",
        f"link as (select src, translate(dst, '{urls.UPPER}', '{urls.LOWER}') dst from (select {host('url')} src, unnest(regexp_extract_all(html, {quote(urls.HREF)}, 1)) dst from pages))",
        "edge as (select src, dst, count(*) n from link where src <> dst and src <> '' and dst <> '' group by 1, 2)",
        "b as (select true good, src a, dst b, n from edge union all select false, dst, src, n from edge)",
        f"m as (select good, a, b, {urls.DAMPING} * n / sum(n) over (partition by good, a) p from b)",
        f"""r as (select 0 k, * from (select true good, host a, trust r from seed where trust > 0 union all select false, host, distrust from seed where distrust > 0)
union all select k, good, a, sum(x) r from (select r.k + 1 k, good, m.b a, r.r * m.p x from r join m using (good, a) where r.k < {urls.ROUNDS}) group by 1, 2, 3)""",
        "t as (select a host, coalesce(sum(r) filter (where good), 0) trust, coalesce(sum(r) filter (where not good), 0) distrust from r group by 1)",
        "f as (select page_id, host, path, rule, told, round(coalesce(trust, 0), 6)::double trust, round(coalesce(distrust, 0), 6)::double distrust from j left join t using (host))",
    ]
    return f"""with recursive {', '.join(ctes)} select page_id, host, path, rule, coalesce(told, case when distrust >= {urls.LEAST_DISTRUST} and distrust > {urls.RATIO} * trust then 'block' else 'allow' end) verdict, trust, distrust from f"""


def top_products_sql(k: int) -> str:
    return f"""with v as (select vec_id, list_transform(cast(embedding as double[]), lambda x: floor(1024 * x)) e from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, v.vec_id, cast(list_dot_product(q.e, v.e) as bigint) score from v q join v on len(q.e) = len(v.e) and q.vec_id <> v.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as int) rank, vec_id, score from r where rank <= {k}"""


def spelling_sql() -> str:
    """CRC-32 is spelled out: a fold over the bytes with the remainder of each byte worked out beforehand."""
    shifted = "range(256)"
    for _ in range(8):
        shifted = f"list_transform({shifted}, lambda x: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    runs = f"[{spelling.LETTERS}]{{{spelling.LEAST_LENGTH},}}"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""with recursive t as (select {shifted} tab),
r as (select coalesce(cast(doc_id as varchar), '') doc, translate(unnest(regexp_extract_all(text, '{runs}')), '{upper}', '{lower}') w from documents),
d as (select doc, w, count(*) n from r group by all),
h as (select *, hex(encode(doc || ':' || w)) x from d),
c as (select w, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(x) // 2), lambda i: cast('0x' || substr(x, 2 * i::int + 1, 2) as bigint))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) crc from h, t),
k as (select case when crc % {spelling.DAMAGE} = 0 then substr(w, 1, (crc % length(w))::int) || substr(w, (crc % length(w))::int + 2) else w end word, n from c),
v as (select word, sum(n)::bigint n from k where length(word) >= {spelling.LEAST_LENGTH} group by 1 having sum(n) >= {spelling.LEAST_COUNT}),
e as (select word, n, i, substr(word, 1, i::int - 1) || substr(word, i::int + 1) rest from (select word, n, unnest(range(1, length(word) + 1)) i from v)),
p as (select distinct a.word, a.n, b.word t, b.n tn from e a join e b on a.i = b.i and a.rest = b.rest and a.word <> b.word
union select e.word, e.n, v.word, v.n from e join v on e.rest = v.word union select v.word, v.n, e.word, e.n from e join v on e.rest = v.word),
g as (select word, count(*) n_near, arg_min(t, (-tn, t)) t, max(tn) tn from p group by 1),
f as (select v.word, v.n, coalesce(n_near, 0) n_near, case when tn >= {spelling.RATIO} * v.n then t end form, case when tn >= {spelling.RATIO} * v.n then tn end form_n from v left join g using (word)),
o as (select word, word here, 0 k from f union all select o.word, f.form, k + 1 from o join f on f.word = o.here where f.form is not null)
select word, form, root, n, n_near, form_n from f join (select word, arg_max(here, k) root from o group by 1) using (word)"""


def audit_sql() -> str:
    """Each order is added up from the mask cells; the fixed conditions are those of ``audit.text_filters``."""
    return """with recursive d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') words, min(doc_id) over (partition by t) least from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by 1),
m as (select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic, case when len(words) < 200 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
+ case when 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end + case when doc_id > least then 16 else 0 end mask from w left join l using (doc_id)),
c as (select part, mask, count(*) n, sum(good) good, sum(toxic) toxic from m group by 1, 2),
o as (select '' o union all select o || x from o, (select unnest(['A', 'B', 'C', 'D', 'E']) x) where not contains(o, x)),
s as (select o filter_order, step, (1 << (strpos('ABCDE', substr(o, step, 1)) - 1)::int) bit, coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (strpos('ABCDE', substr(o, k::int, 1)) - 1)::int)), 0)::int before from (select o, unnest(range(1, 6))::int step from o where length(o) = 5)),
a as (select part, filter_order, step, bit, coalesce(sum(n) filter (mask & (before | bit) = 0), 0) kept, coalesce(sum(n) filter (mask & before = 0 and mask & bit > 0), 0) removed, coalesce(sum(n) filter (mask & before > 0 and mask & bit > 0), 0) redundant,
coalesce(sum(n) filter (mask = bit), 0) unique_fails, coalesce(sum(good) filter (mask & before = 0 and mask & bit > 0), 0) good_lost, coalesce(sum(toxic) filter (mask & before = 0 and mask & bit > 0), 0) toxic_lost from c cross join s group by 1, 2, 3, 4)
select part, filter_order, step::int step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails, good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, sum(removed) over (partition by part, bit)::bigint shapley from a"""


#: White space as Python's split knows it, in a character class.
BLANK = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def lines_sql() -> str:
    """All runs of lines that start a window, up to where the next window ends, compared with each other as texts."""
    words = linededup.MIN_WORDS
    return f"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 i from documents where text is not null and doc_id is not null),
v as (select doc_id, i, regexp_replace(line, '^[{BLANK}]+|[{BLANK}]+$', '', 'g') line, len(regexp_extract_all(line, '[^{BLANK}]+')) n from l),
k as (select *, row_number() over (partition by doc_id order by i) k, sum(n) over (partition by doc_id order by i) c from v where n > 0),
p as (select a.doc_id, a.k, a.i, b.k last from k a asof join k b on a.doc_id = b.doc_id and a.c - a.n + {words} <= b.c),
d as (select doc_id, list(line order by k) ls, list(i order by k) places from k group by 1),
r as (select doc_id, i start, places[e] stop, md5(array_to_string(ls[k:e], chr(10))) run from (select p.*, ls, places, unnest(range(last, greatest(last, coalesce(lead(last) over (partition by doc_id order by k) - 1, len(ls))) + 1)) e from p join d using (doc_id))),
h as (select run, min(struct_pack(d := doc_id, s := start, e := stop)) head from r group by 1 having count(*) > 1),
g as (select distinct doc_id, unnest(range(start, stop + 1)) i from r join h using (run) where doc_id <> head.d or start > head.e),
t as (select doc_id, string_agg(line, chr(10) order by i) filter (where g.i is null) text, count(g.i) gone from l left join g using (doc_id, i) group by 1)
select doc_id, case when coalesce(gone, 0) = 0 then documents.text else coalesce(t.text, '') end text, coalesce(gone, 0)::int removed_lines from documents left join t using (doc_id)"""
