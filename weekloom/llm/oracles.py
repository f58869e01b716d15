"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from weekloom.llm.quality import STOP_WORDS

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOW_TEXT = _LOWER.format("coalesce(text, '')")

DECONTAMINATE = f"""
with d as (select doc_id, {_WORDS.format(_LOW_TEXT)} as w from documents),
b as (select item_id, {_WORDS.format(_LOW_TEXT)} as w from benchmark),
win as (
  select distinct item_id, least(len(w), 10) as k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as g
  from (select item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as i from b where len(w) > 0)
),
ks as (select distinct k from win),
pos as (select doc_id, w, unnest(generate_series(1, len(w))) as i from d),
hit as (
  select doc_id, i, p.k, item_id
  from (select doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as g from pos, ks where i + k - 1 <= len(w)) p
  join win on win.k = p.k and win.g = p.g
),
cov as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(generate_series(i, i + k - 1)) as j from hit) group by doc_id),
its as (
  select doc_id, count(*) as n_items, sha256(string_agg(s, ',' order by s)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as s from hit) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov using (doc_id) left join its using (doc_id)
"""

LINE_DEDUP = rf"""
with l as (
  select doc_id, unnest(generate_series(1, len(ls))) as i, ls from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)
),
k as (select doc_id, i, ls[i] as line, {_LOWER.format("trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
c as (select key, max(doc_id) as last_id from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.doc_id, i, line, c.key is not null and k.doc_id <> c.last_id as gone from k left join c on c.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""

QUALITY = rf"""
with d as (select doc_id, coalesce(text, '') as text, {_TOKENS.format("coalesce(text, '')")} as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) as i from d)),
r as (select doc_id, count(distinct j) as n from (
    select doc_id, unnest([i, i + 1, i + 2]) as j from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1) group by doc_id),
m as (select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, len(l) as n_lines, coalesce(r.n, 0) as n_repeat_words,
    len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], x))) as n_stop
  from d left join r using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars / n_words between 2.5 and 12 and n_symbols / word_chars between 0 and 0.1
    and coalesce(n_dup_lines / nullif(n_lines, 0) between 0 and 0.5, true) and n_stop / n_words between 0.05 and 1 as kept
from f
"""

MIX = """
with recursive c as (select source, count(*) as n, pow(cast(count(*) as double), 0.5) as weight from documents group by source),
r as (select source, round((select sum(n) from c) / (select sum(weight) from c) * weight / n, 9) as rate from c),
s(source, rate, k, p, total) as (
  select source, rate, 0, exp(-rate), exp(-rate) from r
  union all
  select source, rate, k + 1, p * rate / (k + 1), total + p * rate / (k + 1) from s where k + 1 < ceil(rate + 12 * sqrt(rate) + 60)
),
u as (select doc_id, source, text, cast('0x' || substr(md5('1|' || doc_id || '|1'), 1, 13) as bigint) / pow(2, 52) as u from documents),
q as (select u.doc_id, u.source, u.text, count(*) as n from u join s on s.source is not distinct from u.source and s.total <= u.u group by all)
select doc_id, source, copy_no, md5('order 1|' || doc_id || '|' || copy_no) as order_key, coalesce(length(text), 0) as text_chars, text
from (select *, unnest(generate_series(1, n)) as copy_no from q)
"""

_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, {10 * k + 1}, 10) as bigint) >> {35 - 5 * j}) & 31 as integer) + 1, 1)" for k in range(4) for j in range(8)
)
WARC = f"""
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, cast(strlen(body) as bigint) as payload_bytes, {_B32} as payload_digest, min(page_id) over (partition by body) as first_id from p)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from d
"""

SUFFIX_DEDUP = """
with d as (select doc_id, lower(hex(coalesce(text, ''))) as h from documents),
n as (select doc_id, h, cast(length(h) // 2 as bigint) as n_bytes from d),
b as (select doc_id, k, substring(h, 1000 * k + 1, 1098) as part from (select doc_id, h, unnest(generate_series(0, n_bytes // 500)) as k from n)),
w as (select doc_id, 500 * k + j as p, substring(part, 2 * j + 1, 100) as s from (select doc_id, k, part, unnest(generate_series(0, least(499, length(part) // 2 - 50))) as j from b where length(part) >= 100)),
f as (select s, min(doc_id) as first_id from w group by s having min(doc_id) < max(doc_id)),
g as (select doc_id, p, max(p + 50) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding) as upto
  from (select distinct w.doc_id, w.p from w join f on w.s = f.s where f.first_id < w.doc_id)),
i as (select doc_id, p, sum(case when upto is null or p > upto then 1 else 0 end) over (partition by doc_id order by p) as span from g),
r as (select doc_id, span, min(p) as a, max(p) + 50 as b from i group by doc_id, span),
l as (select doc_id, list(a order by a) as starts, list(b order by a) as ends, sum(b - a) as n_removed from r group by doc_id)
select n.doc_id, n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(len(starts), 0) as bigint) as n_spans,
  sha256(unhex(case when starts is null then h else list_aggregate(list_transform(generate_series(0, len(starts)), lambda k:
    substring(h, 2 * coalesce(ends[k], 0) + 1, 2 * (coalesce(starts[k + 1], n_bytes) - coalesce(ends[k], 0)))), 'string_agg', '') end)) as kept_sha256
from n left join l using (doc_id)
"""

_WHOLE = "list_transform(embedding, lambda x: cast(floor({} * cast(x as double)) as bigint))"
_FINITE = "embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))"
HARD_NEGATIVES = f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {_WHOLE.format(256)} as v from embeddings where label is not null and {_FINITE}),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_dot_product(cast(a.v as double[]), cast(b.v as double[])) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, other) as integer) as rank, other as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other) <= 5
"""


def _ball_kmeans(clusters: int = 8, rounds: int = 10) -> str:
    """Plain k-means: all distances in each round."""
    steps = [
        f"v as materialized (select vec_id, {_WHOLE.format(1024)} as v from embeddings where len(embedding) = 64 and {_FINITE})",
        f"c0 as materialized (select cast(row_number() over (order by sha256('3:' || vec_id)) - 1 as integer) as k, v as c from v order by sha256('3:' || vec_id) limit {clusters})",
    ]
    for r in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{r} as materialized (select vec_id, any_value(v) as v, min_by(k, (d, k)) as k, min(d) as d from (select vec_id, v, k, cast({far} as bigint) as d from v, c{r}) group by vec_id)")
        if r < rounds:
            steps.append(f"m{r} as (select k, i, sum(x) as s, count(*) as n from (select k, unnest(v) as x, unnest(range(64)) as i from a{r}) group by k, i)")
            mean = "cast((s - ((s % n) + n) % n) // n as bigint)"
            steps.append(f"c{r + 1} as materialized (select k, coalesce(any_value(x), any_value(c)) as c from c{r} left join (select k, list({mean} order by i) as x from m{r} group by k) using (k) group by k)")
    return (
        "with " + ",\n".join(steps) + f"""
select vec_id, k as cluster, d as distance, cast(sum(d) over (partition by k) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (k)
"""
    )


BALL_KMEANS = _ball_kmeans()

ORACLES = {"op1_decontaminate": DECONTAMINATE, "op2_line_dedup": LINE_DEDUP, "op3_warc": WARC, "op6_quality_rules": QUALITY, "op9_mix_sources": MIX, "op11_suffix_dedup": SUFFIX_DEDUP, "op12_hard_negatives": HARD_NEGATIVES, "op13_ball_kmeans": BALL_KMEANS}
