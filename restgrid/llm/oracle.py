"""DuckDB SQL of the operators that SQL can express."""

from .quality import BASE_REPEAT_PERCENT, BASE_WORDS, CLASSES, COMMON_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS, WINDOW
from .scoring import CALM, MOST_WEIGHT

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_LOWER = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

JACCARD = f"""
with recursive w as (select doc_id, {_LOWER} as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as i from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select u, v from pairs join n x on x.doc_id = u join n y on y.doc_id = v where 100 * k >= 80 * (x.n + y.n - k)),
ends as (select u, v from links union all select v, u from links),
reach as (select u as doc_id, u as r from ends union select reach.doc_id, ends.v from reach join ends on ends.u = reach.r)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id left join (select doc_id, min(r) as component_id from reach group by doc_id) c on c.doc_id = d.doc_id
"""

SUFFIX = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 100) as w from (select doc_id, h, unnest(range(0, greatest(n - 49, 0))) as p from t)),
f as (select w, min(doc_id) as first from w group by w),
lost as (select w.doc_id, p from w join f on f.w = w.w where f.first < w.doc_id),
marked as (select doc_id, p, case when p > coalesce(lag(p) over (partition by doc_id order by p) + 50, -1) then 1 else 0 end as new from lost),
spans as (select doc_id, min(p) as a, max(p) + 50 as z from (select doc_id, p, sum(new) over (partition by doc_id order by p) as k from marked) group by doc_id, k),
gaps as (select doc_id, lag(z, 1, 0) over (partition by doc_id order by a) as a, a as z from spans union all select doc_id, max(z), 1000000000 from spans group by doc_id),
kept as (select g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' order by a) as h from gaps g join t on t.doc_id = g.doc_id group by g.doc_id),
sums as (select doc_id, sum(z - a) as n_removed, count(*) as n_spans from spans group by doc_id)
select t.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept.h, t.h))) as kept_sha256
from t left join sums on sums.doc_id = t.doc_id left join kept on kept.doc_id = t.doc_id
"""

SEARCH = f"""
with w as (select doc_id, unnest({_LOWER}) as w from documents),
tf as (select doc_id, w, count(*) as tf from w group by all),
size as (select d.doc_id, count(w.w) as n from documents d left join w on w.doc_id = d.doc_id group by d.doc_id),
c as (select count(*) as n, sum(n) / count(*) as mean from size),
df as (select w, count(*) as df from tf group by w),
q as (select q.doc_id as query_id, tf.doc_id, round(sum(ln(1 + (c.n - df + 0.5e0) / (df + 0.5e0)) * tf.tf * 2.2e0 / (tf.tf + 1.2e0 * (0.25e0 + 0.75e0 * size.n / c.mean))), 6) as score
 from tf q join df on df.w = q.w join tf on tf.w = q.w join size on size.doc_id = tf.doc_id cross join c where q.doc_id % 100 = 0 group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from q)
select query_id, doc_id, score, place from r where place <= 10
"""

# CRC-32 of a short ASCII text, bit by bit, by its reflected polynomial
_CRC = (
    "xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::ubigint)),"
    " lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: k::ubigint)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)))"
)

LM = f"""
with d as (select doc_id, coalesce({_CRC} % 7 = 2, false) as held_out, list_append({_LOWER}, ' ') as w from documents),
t as (select doc_id, held_out, i, w[i] as w, case when i > 1 then w[i - 1] else ' ' end as h, case when i > 2 then w[i - 2] else ' ' end as g from (select *, unnest(range(1, len(w) + 1)) as i from d)),
one as (select w, count(*) as c from t where not held_out group by w),
two as (select h, w, count(*) as c from t where not held_out group by h, w),
three as (select g, h, w, count(*) as c from t where not held_out and i > 1 group by g, h, w),
u as (select sum(c)::double as n, count(*)::double as v, count(*) filter (c = 1)::double as n1, count(*) filter (c = 2)::double as n2 from one),
k as (select n, v, least(greatest(n1 / (n1 + 2 * n2), 0.1e0), 0.9e0) as d, {MOST_WEIGHT!r}::double * (1 - (select count(*) filter (c = 1)::double / sum(c) from two)) as most from u),
j as (select t.doc_id, t.held_out, coalesce(one.c, 0) as c, coalesce(two.c, 0) as c2, coalesce(three.c, 0) as c3, coalesce(x.c, 0) as ch, case when i > 1 then coalesce(y.c, 0) else 0 end as cgh
 from t left join one on one.w = t.w left join two on two.h = t.h and two.w = t.w left join three on i > 1 and three.g = t.g and three.h = t.h and three.w = t.w left join one x on x.w = t.h left join two y on y.h = t.g and y.w = t.h),
l as (select j.*, n, v, (case when c > 0 then c - d else d * v end) / n as p1, case when ch > 1 then most * (ch - 1) / (ch - 1 + {CALM!r}::double) else 0 end as l2, case when cgh > 1 then {MOST_WEIGHT!r}::double * (cgh - 1) / (cgh - 1 + {CALM!r}::double) else 0 end as l3 from j cross join k),
p as (select *, l2 * c2 / greatest(ch, 1) + (1 - l2) * p1 as p2 from l)
select doc_id, held_out, count(*) as n_tokens, count(*) filter (c > 0) as n_known, cast(max(n) as bigint) as train_tokens, round(sum(log10((c + 1) / (n + v + 1))), 6) as base_score, round(sum(log10(l3 * c3 / greatest(cgh, 1) + (1 - l3) * p2)), 6) as score from p group by doc_id, held_out
"""

_CLASSES = [k.replace("'", "''") for k in CLASSES.values()]
_FREQUENT = "case lang " + " ".join(f"when '{k}' then {v!r}" for k, v in COMMON_WORDS.items()) + " else [] end"
_OUT = lambda kind: f"cast(length(t) - length(regexp_replace(t, '[{kind}]+', '', 'g')) as double)"
_CHARS = "[" + ", ".join([*(_OUT(k) for k in _CLASSES), "cast(length(regexp_replace(t, '[" + "".join(_CLASSES) + "]+', '', 'g')) as double)"]) + "]"


def _distance(p: str, q: str) -> str:
    a, b = f"(list_extract({p}, i) / list_sum({p}))", f"(list_extract({q}, i) / list_sum({q}))"
    term = lambda x, y: f"case when {x} > 0 then {x} * log2(2 * {x} / ({x} + {y})) else 0 end"
    return f"case when list_sum({p}) > 0 and list_sum({q}) > 0 then sqrt(greatest(list_sum([({term(a, b)} + {term(b, a)}) / 2 for i in range(1, len({p}) + 1)]), 0)) else 0 end"


def _list_total(name: str, width: int) -> str:
    return "[" + ", ".join(f"sum(list_extract({name}, {i + 1}))" for i in range(width)) + "]"


QUALITY = f"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce({_CRC} % 2, 0) as part, {_WORDS} as w from documents),
win as (select doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') as s from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from d)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from win) where n > 1),
repeats as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {WINDOW})) as p from twice) group by doc_id),
f as (select d.doc_id, t, lang, part, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) as bigint) as word_chars,
 cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
 cast(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) as bigint) as n_dup_lines,
 coalesce(r.n, 0) as n_repeat_words, {_CHARS} as chars, [cast(len(list_filter(w, lambda x: x = c)) as double) for c in {_FREQUENT}] as common from d left join repeats r on r.doc_id = d.doc_id),
g as (select *, n_words < {BASE_WORDS} or 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words as base_failed, list_append(common, n_words - coalesce(list_sum(common), 0)) as words from f),
ref as (select lang, 1 - part as part, {_list_total("chars", len(CLASSES) + 1)} as rc, list_filter({_list_total("words", max(map(len, COMMON_WORDS.values())) + 1)}, lambda x: x is not null) as rw from g where not base_failed group by lang, part),
h as (select g.*, coalesce(list_sum(chars), 0) >= {MIN_CHARS} and n_words >= {MIN_WORDS} and rc is not null as long, rc, rw from g left join ref on ref.lang = g.lang and ref.part = g.part),
k as (select *, case when long then {_distance("chars", "rc")} else 0 end as cd, case when long then {_distance("words", "rw")} else 0 end as wd from h)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and cd <= {MAX_CHAR_DISTANCE} and wd <= {MAX_WORD_DISTANCE} as kept, round(cd, 6) as char_distance, round(wd, 6) as word_distance from k
"""

TRIE = f"""
with t as (select conv_id, dense_rank() over (order by role, text) as letter, strlen(text) as n, row_number() over (partition by conv_id order by turn nulls first, role, text) as i
 from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
c as (select conv_id, conv_id - conv_id % 5 as base, cast({_CRC.replace("doc_id", "conv_id")} % 9 as bigint) as h from (select distinct conv_id from t)),
b as (select c.conv_id, count(t.i) as head from c left join t on t.conv_id = c.base and t.i <= c.h group by c.conv_id),
r as (select c.conv_id, t.i as d, letter, n from c join t on t.conv_id = c.base and t.i <= c.h
 union all select c.conv_id, t.i - c.h + b.head, letter, n from c join b on b.conv_id = c.conv_id join t on t.conv_id = c.conv_id and t.i > c.h),
f as (select c.conv_id, coalesce(list(letter order by d) filter (d is not null), []) as path, coalesce(list(n order by d) filter (d is not null), []) as sizes from c left join r on r.conv_id = c.conv_id group by c.conv_id),
m as (select conv_id, d, list_slice(path, 1, d) as node, coalesce(sizes[d], 0) as n, d = len(path) as ends from (select *, unnest(range(len(path) + 1)) as d from f)),
x as (select node, d, min(conv_id) as conv_id, count(*) as n_convs, max(n) as n, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256 from m group by node, d),
k as (select list_slice(node, 1, d - 1) as node, count(*) as n_children from x where d > 0 group by 1),
y as (select x.*, coalesce(k.n_children, 0) as n_children from x left join k on k.node = x.node),
s as (select list_slice(node, 1, a) as node, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * n) as saved from (select *, unnest(range(d + 1)) as a from y) group by 1)
select y.conv_id, y.d as depth, p.conv_id as parent_conv_id, y.n_convs, y.n_children, s.n_leaves, cast(s.saved as bigint) as saved_tokens, y.ends_sha256
from y join s on s.node = y.node left join x p on y.d > 0 and p.node = list_slice(y.node, 1, y.d - 1)
"""
