"""SQL of the queries opN_<name> that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DECONTAMINATION = rf"""
with d as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), i as (
  select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), iw as (
  select distinct item_id, l, array_to_string(w[k : k + l - 1], ' ') as g
  from (select item_id, w, l, unnest(range(1, len(w) - l + 2)) as k
        from (select item_id, w, least(10, len(w)) as l from i where len(w) > 0))
), dw as (
  select doc_id, l, k, array_to_string(w[k : k + l - 1], ' ') as g
  from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as k
        from d, (select distinct l from iw) where len(w) >= l)
), h as (
  select dw.doc_id, dw.k, dw.l, iw.item_id from dw join iw on dw.l = iw.l and dw.g = iw.g
), hw as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + l)) as p from h) group by doc_id
), hi as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hw on d.doc_id = hw.doc_id left join hi on d.doc_id = hi.doc_id
"""

_NEAR_DEDUP = rf"""
with recursive d as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else [array_to_string(w[k : k + 3], ' ') for k in range(1, len(w) - 2)] end) as s
  from d
), u as (
  select doc_id, len(s) as n, unnest(s) as g from s
), links as (
  select a.doc_id as a, b.doc_id as b
  from u a join u b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges as (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id as a, doc_id as b from documents
  union
  select reach.a, edges.b from reach join edges on reach.b = edges.a
), least_of as (
  select a as doc_id, min(b) as component_id from reach group by a
)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, component_id, s.doc_id = component_id as kept
from s join least_of using (doc_id)
"""

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Hosts whose pages make up the list of canonical urls, with or without www., m. or blog.
SPAM_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com")

_URL_FILTER = """
with r as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as h, rest from r
), p as (
  select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path
  from h
), c as (
  select *, case when host <> '' then regexp_replace(host, '^www[.]', '') || regexp_replace(path, '([.]html|/+)$', '') end as canonical
  from p
), listed as (
  select distinct canonical from c
  where regexp_replace(host, '^(www|m|blog)[.]', '') in ('spam-farm.example.org', 'cheap-pills.example.com')
), rules as (
  select * from (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
                        ('allow', 'org', '/fr/')) t(action, name, prefix)
), fits as (
  select page_id, arg_max(name || prefix, length(name || prefix)) as rule, arg_max(action, length(name || prefix)) as action
  from c join rules on (host = name or ends_with(host, '.' || name)) and starts_with(path, prefix)
  group by page_id
)
select c.page_id, host, path, rule,
       coalesce(action, case when listed.canonical is not null then 'block' else 'allow' end) as verdict
from c left join fits on c.page_id = fits.page_id left join listed on c.canonical = listed.canonical
"""


def _vector_codes() -> str:
    """Four Lloyd rounds and the last assignment, one common table each; books(r) has a row for each part and entry."""
    steps = [
        """kept as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
                    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "parts as materialized (select vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] as x from kept, range(4) t(p))",
        "books0 as materialized (select p, cast(dense_rank() over (order by vec_id) - 1 as bigint) as e, x as c from parts where vec_id in (select vec_id from kept order by vec_id limit 256))",
    ]
    for r in range(5):
        square = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
        steps.append(f"found{r} as materialized (select vec_id, p, any_value(x) as x, min(({square}, e)) as m from parts join books{r} using (p) group by vec_id, p)")
        if r < 4:
            steps.append(
                f"""sums{r} as (select p, m[2] as e, i, cast(floor(cast(sum(x[i]) as double) / count(*)) as bigint) as c from found{r}, unnest(range(1, len(x) + 1)) t(i) group by p, m[2], i)"""
            )
            steps.append(f"books{r + 1} as materialized (select b.p, b.e, coalesce(f.c, b.c) as c from books{r} b left join (select p, e, list(c order by i) as c from sums{r} group by p, e) f on b.p = f.p and b.e = f.e)")
    return (
        "with "
        + ", ".join(steps)
        + """, digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as d from books4),
        rows as (select vec_id, string_agg(format('{:02x}', m[2]), '' order by p) as code, cast(sum(m[1]) as bigint) as error from found4 group by vec_id)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, d as codebooks_sha256 from rows join kept using (vec_id), digest"""
    )


_CHAT_FORMAT = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?(SYS|INST|ROLE|TURN)\])', '[\\\1', 'g') as escaped,
         regexp_replace(regexp_replace(role, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?(SYS|INST|ROLE|TURN)\])', '[\\\1', 'g') as escaped_role
  from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(escaped) + case role when 'system' then 14 when 'user' then 15 when 'assistant' then 5 else length(escaped_role) + 25 end) as bigint) as formatted_chars
from e group by conv_id
"""


def _collocations(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    """Phrases of every length from word lists; the weakest cut; those inside a longer phrase of the same count go."""
    lengths = range(1, longest + 1)
    grams = " union all ".join(f"select lang, {k} as k, array_to_string(w[i : i + {k - 1}], ' ') as phrase from (select lang, w, unnest(range(1, len(w) - {k - 2})) as i from p where len(w) >= {k})" for k in lengths)
    return rf"""
with p as (
  select lang, regexp_extract_all(piece, '[^ 	]+') as w
  from (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER}, '[.,;:!?
-]')) as piece from documents)
), f as materialized (
  select lang, k, phrase, count(*) as f from ({grams}) group by all having count(*) >= {least}
), n as (
  select lang, cast(sum(len(w)) as bigint) as n from p group by lang
), c as (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1
), cut as (
  select *, array_to_string(w[1 : j], ' ') as lp, array_to_string(w[j + 1 : k], ' ') as rp from (select *, unnest(range(1, k)) as j from c)
), scored as (
  select cut.lang, cut.phrase, cut.a, cut.j, l.f as l, r.f as r, n.n,
         (1000::hugeint * cut.a * n.n) // (l.f::hugeint * r.f) as score
  from cut join n on n.lang = cut.lang join f l on l.lang = cut.lang and l.phrase = lp join f r on r.lang = cut.lang and r.phrase = rp
), weakest as (
  select lang, phrase, arg_min((a, l, r, n, score), (score, j)) as m from scored group by lang, phrase
), inside as (
  select lang, array_to_string(w[i : i + s - 1], ' ') as phrase, max(a) as longer
  from (select lang, w, a, s, unnest(range(1, k - s + 2)) as i from (select *, unnest(range(2, k)) as s from c where k > 2)) group by 1, 2
), ranked as (
  select weakest.lang, weakest.phrase, m, row_number() over (partition by weakest.lang order by m[5] desc, m[1] desc, encode(weakest.phrase)) as rank
  from weakest left join inside on inside.lang = weakest.lang and inside.phrase = weakest.phrase
  where longer is null or 100 * longer < 100 * m[1]
)
select lang, rank, phrase, m[1] as a, m[2] as l, m[3] as r, m[4] as n, cast(m[5] as bigint) as score from ranked where rank <= {top}
"""


SQL = {
    "op1_url_filter": _URL_FILTER,
    "op8_near_dedup": _NEAR_DEDUP,
    "op9_decontamination": _DECONTAMINATION,
    "op11_vector_codes": _vector_codes(),
    "op12_chat_format": _CHAT_FORMAT,
    "op13_collocations": _collocations(),
}
