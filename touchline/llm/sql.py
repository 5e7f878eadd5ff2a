"""DuckDB statements for the queries of this package that SQL can express."""

from __future__ import annotations

from touchline.llm import secret_scan, url_filter


def _secret_scan() -> str:
    """Places of matches from the lengths of gaps and matches, rule by rule."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cut = ", ".join(
        f"string_split_regex(t, {quote(r.pattern)}) as g{i}, regexp_extract_all(t, {quote(r.pattern)}, 0) as m{i}, regexp_extract_all(t, {quote(r.pattern)}, {r.value}) as v{i}"
        for i, r in enumerate(secret_scan.RULES)
    )
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda s: length(s))), 0)"
    spans = []
    for i, r in enumerate(secret_scan.RULES):
        start = f"({total(f'g{i}[1:k]')} + {total(f'm{i}[1:k-1]')})::bigint"
        spans.append(
            f"list_filter(list_transform(range(1, len(m{i}) + 1), lambda k: {{'s': {start}, 'r': {i}, 'e': {start} + length(m{i}[k]), 'k': '{r.kind}', 'n': length(v{i}[k])}}), lambda z: z.n >= {r.least})"
        )
    base = [r.kind for r in secret_scan.RULES if r.base]
    listed = lambda x: f"array_to_string(list_transform({x}, lambda z: z.k || ':' || z.s || ':' || z.e), ',')"
    return f"""with c as (select doc_id, {cut} from (select doc_id, coalesce(text, '') as t from documents)),
 s as (select doc_id, list_sort({' || '.join(spans)}) as f from c)
 select doc_id, {', '.join(f"len(list_filter(f, lambda z: z.k = '{k}'))::bigint as n_{k}" for k in base)},
 sha256({listed(f"list_filter(f, lambda z: z.k in ({', '.join(map(repr, base))}))")}) as base_sha256, {listed('f')} as spans from s"""


def _jaccard_join(length: int = 3, percent: int = 90) -> str:
    """Sets of shingles, all pairs that share one, and what is reachable over the links."""
    upper, lower = url_filter.UPPER, url_filter.LOWER
    shingle = " || ' ' || ".join(f"w[i+{k}]" for k in range(length))
    return f"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
 s as (select doc_id, case when len(w) = 0 then [] when len(w) < {length} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {length - 2}), lambda i: {shingle})) end as s from d),
 e as (select doc_id, len(s) as n, unnest(s) as x from s),
 p as (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
 r as (select doc_id as a, doc_id as b from s union select r.a, p.b from r join p on p.a = r.b)
 select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id from s join (select a, min(b) as component_id from r group by a) c on c.a = s.doc_id"""


def _url_filter(least_share: float = 0.02, least_count: int = 5, z: float = 1.96, weight: float = 4.0, prior: float = 0.25, reject: float = 0.5, least_labelled: float = 0.1) -> str:
    """The template tree level by level, as a recursion over the paths that still go on."""
    part = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    rule = "case " + " ".join(
        f"when (host = '{h}' or host like '%.{h}') and path like '{p}%' then '{h}{p}|{v}'" for h, p, v in sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))) + " end"
    both = "({a} + {b}) / ({n} + {m})::double"
    differs = lambda a, n, b, m: f"({n} > 0 and {m} > 0 and abs({a} / {n}::double - {b} / {m}::double) > {z} * sqrt({both.format(a=a, b=b, n=n, m=m)} * (1 - {both.format(a=a, b=b, n=n, m=m)}) * (1 / {n}::double + 1 / {m}::double)))"
    odd = f"({differs('sk', 'sn', '(ak-sk)', '(an-sn)')} or {differs('sr', 'sk', '(ar-sr)', '(ak-sk)')})"
    step = lambda chosen: f"case when seg is null then '' when not open then '/**' {chosen} else '/*' end"
    return f"""with recursive u as (select page_id, translate(coalesce(regexp_extract(url, {part}, 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') as host, coalesce(regexp_extract(url, {part}, 2), '') as path from pages),
 f as (select *, {rule} as found from u),
 t as (select host, path, string_split(regexp_replace(path, '^/', ''), '/') as parts, count(*)::bigint as n, count(found)::bigint as k, count(*) filter (found like '%|block')::bigint as r, 0 as level, '' as template, '' as branch, false as ended from f group by 1,2,3
  union all select host, path, parts, n, k, r, level + 1, template || {step("when frequent or odd then '/' || seg")}, branch || {step(f"when odd or (frequent and sk < {least_count}) then '/' || seg when frequent then '/+'")}, seg is null or not open
  from (select *, {odd} as odd, sn >= {least_share} * an and sn >= {least_count} as frequent, an >= {least_count} and ap > 1 as open from (
   select *, sum(n) over s as sn, sum(k) over s as sk, sum(r) over s as sr, sum(n) over b as an, sum(k) over b as ak, sum(r) over b as ar, count(*) over b as ap
   from (select *, parts[level + 1] as seg from t where not ended) window s as (partition by host, branch, seg), b as (partition by host, branch, seg is null)))),
 g as (select * from t where ended),
 b as (select host, branch, (sum(r) + {weight * prior}) / (sum(k) + {weight}) as purity, sum(k) >= {least_count} and sum(k) >= {least_labelled} * sum(n) as told from g group by 1,2)
 select f.page_id, f.host, f.path, split_part(f.found, '|', 1) as rule, case when f.found is not null then split_part(f.found, '|', 2) when b.told and b.purity >= {reject} then 'block' else 'allow' end as verdict, g.template, b.purity
 from f join g on g.host = f.host and g.path = f.path join b on b.host = g.host and b.branch = g.branch"""


def _repetition(window: int = 8, max_repeat: int = 200) -> str:
    """Repeated windows of words; a repeat above ``max_repeat`` words is a repeated window of one word more."""
    space = r"[\x20\x09-\x0D]"
    return f"""with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
 p as (select doc_id, i, array_to_string(w[i:i+{window - 1}], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - {window - 2})) as i from d)),
 c as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + {window})) as j from (select *, count(*) over (partition by doc_id, x) as k from p) where k > 1) group by 1),
 l as (select distinct doc_id from (select doc_id, sha256(array_to_string(w[i:i+{max_repeat}], ' ')) as x from (select doc_id, w, unnest(range(1, len(w) - {max_repeat - 1})) as i from d)) group by doc_id, x having count(*) > 1),
 m as (select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '{space}', '', 'g'))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, coalesce(c.n, 0)::bigint as n_repeat_words, l.doc_id is not null as long
  from d left join c on c.doc_id = d.doc_id left join l on l.doc_id = d.doc_id)
 select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or long) as kept from m"""


def _collocations(least: int = 10, inside: int = 50, top: int = 2000) -> str:
    """All phrases of one to three words counted, then cut, compared with what holds them, and ranked."""
    upper, lower = url_filter.UPPER, url_filter.LOWER
    phrases = " union all ".join(
        f"select lang, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: w[i:i+{k - 1}])) as p from w" if k > 1 else "select lang, unnest(list_transform(w, lambda x: [x])) as p from w" for k in (1, 2, 3))
    score = "1000000 * a::hugeint * a // (l::hugeint * r)"
    return rf"""with w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) as p from documents)),
 f as (select lang, p, count(*) as f from ({phrases}) group by 1, 2 having count(*) >= {least}),
 n as (select lang, sum(len(w)) as n from w group by 1),
 c as (select lang, p, f as a, unnest(range(1, len(p))) as k from f where len(p) > 1),
 k as (select c.*, x.f as l, y.f as r from (select *, p[1:k] as head, p[k+1:] as tail from c) c join f x on x.lang = c.lang and x.p = c.head join f y on y.lang = c.lang and y.p = c.tail),
 s as (select lang, p, a, arg_min(struct_pack(l := l, r := r, score := score), (score, k)) as c from (select *, ({score})::bigint as score from k) group by 1, 2, 3),
 h as (select lang, b, max(a) as longer from (select lang, a, unnest([p[1:2], p[2:3]]) as b from s where len(p) = 3) group by 1, 2),
 d as (select s.lang, array_to_string(p, ' ') as phrase, a, c from s left join h on h.lang = s.lang and h.b = s.p where longer is null or 100 * longer < {inside} * a),
 o as (select *, row_number() over (partition by lang order by c.score desc, a desc, phrase) as rank from d)
 select o.lang, rank::int as rank, phrase, a::bigint as a, c.l::bigint as l, c.r::bigint as r, n.n::bigint as n, c.score::bigint as score from o join n on n.lang = o.lang where rank <= {top}"""


STATEMENTS = {"op12_phrase_collocations": _collocations(), "op10_repetition": _repetition(), "op2_secret_scan": _secret_scan(), "op5_url_filter": _url_filter(), "op8_jaccard_join": _jaccard_join()}
