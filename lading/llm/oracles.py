"""DuckDB SQL for the queries of this subpackage that SQL can express at a bearable cost."""

from __future__ import annotations

import math

from .chat import CHAT_SQL
from .quality import ERROR, FENCE, MEASURES

_GROW = (1 + ERROR) / (1 - ERROR)


def _quality_sql() -> str:
    """The measures by windows over words, sketches as counts of buckets, fences, and the verdict."""
    value = f"case when bucket = -1073741824 then 0.0 else pow({_GROW!r}, bucket) * {2 / (_GROW + 1)!r} end"
    limits, outside = [], []
    for name, (least, low) in MEASURES.items():
        limits.append(f"max(case when measure = '{name}' then q3 + {FENCE} * greatest(q3 - q1, {least}) end) as high_{name}")
        outside.append(f"{name} > high_{name}")
        if low:
            limits.append(f"max(case when measure = '{name}' then q1 - {FENCE} * greatest(q3 - q1, {least}) end) as low_{name}")
            outside.append(f"{name} < low_{name}")
    pairs = " union all ".join(f"select lang, source, '{name}' as measure, cast({name} as double) as value from f" for name in MEASURES)
    return f"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select rid, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]'), lambda x: x <> '') as w from d),
u as (select rid, unnest(w) as word, generate_subscripts(w, 1) as i from w),
g as (select rid, i, word || ' ' || lead(word) over (partition by rid order by i) || ' ' || lead(word, 2) over (partition by rid order by i) as g from u),
c as (select rid, i, count(*) over (partition by rid, g) as n from g where g is not null),
r as (select rid, count(distinct i + k) as n_repeat_words from c, (values (0), (1), (2)) t(k) where n > 1 group by rid),
m as (select d.rid, doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from d join w on d.rid = w.rid left join r on d.rid = r.rid),
f as (select *, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, n_symbols / greatest(n_words, 1) as symbols_a_word, word_chars / greatest(n_words, 1) as word_length,
  (len(l) - len(list_distinct(l))) / greatest(len(l), 1) as dup_lines, n_repeat_words / greatest(n_words, 1) as repeats from m),
b as (select lang, source, measure, case when value > 0 then cast(ceil(ln(value) / {math.log(_GROW)!r}) as bigint) else -1073741824 end as bucket, count(*) as n from ({pairs}) group by all),
s as (select *, sum(n) over (partition by lang, source, measure order by bucket) as seen, sum(n) over (partition by lang, source, measure) as total from b),
q as (select lang, source, measure, min(case when seen >= total * 0.25 then bucket end) as b1, min(case when seen >= total * 0.75 then bucket end) as b3 from s group by all),
v as (select lang, source, measure, {value.replace("bucket", "b1")} as q1, {value.replace("bucket", "b3")} as q3 from q),
t as (select lang, source, {", ".join(limits)} from v group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not ({" or ".join(outside)}) as kept
from f join t on f.lang is not distinct from t.lang and f.source is not distinct from t.source"""


EMBEDDING_SQL = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select vec_id as s, vec_id as t from v union select r.s, p.b from r join p on r.t = p.a),
c as (select s as vec_id, min(t) as component_id from r group by s),
n as (select a as vec_id, count(*) as n_links from p group by a)
select c.vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, c.vec_id = component_id as kept from c left join n on c.vec_id = n.vec_id"""

SQL = {"op4_chat_formatting": CHAT_SQL, "op6_quality_rules": _quality_sql(), "op7_embedding_near_dedup": EMBEDDING_SQL}
