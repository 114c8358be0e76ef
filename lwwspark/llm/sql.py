"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .url_rules import PATTERN_RULES, SITE_RULES

_ESC = "replace(replace(replace({}, '\\', '\\\\'), '#', '\\#'), '</', '<\\/')"

OP1 = f"""
with log as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('### : </turn>') + 1 + length(replace({_ESC.format("role")}, ':', '\\:')) + length({_ESC.format("text")})) as bigint) as formatted_chars
from log group by conv_id
"""


def _op10() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    fits = [
        f"when (host = {quote(r.host)} or ends_with(host, {quote('.' + r.host)})) and starts_with(substr(path, 2), {quote(r.path)}) then {quote(r.name)}"
        for r in sorted(SITE_RULES, key=lambda r: -len(r.name))
    ]
    verdicts = [f"when {quote(r.name)} then {quote(r.verdict)}" for r in SITE_RULES]
    hits = " or ".join(f"regexp_matches(coalesce(lower(url), ''), {quote(r.pattern)})" for r in PATTERN_RULES if r.verdict == "block")
    return f"""
with parts as (
  select page_id, url, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as rest from pages),
split as (
  select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
ruled as (select *, case {" ".join(fits)} end as rule from split)
select page_id, host, path, rule, case rule {" ".join(verdicts)} else case when {hits} then 'block' else 'allow' end end as verdict from ruled
"""


OP10 = _op10()

OP5 = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (
  select vec_id as node, vec_id as seen from embeddings
  union select r.node, l.b from reach r join links l on l.a = r.seen),
c as (select node, min(seen) as component_id from reach group by node),
n as (select a as node, count(*) as n from links group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on c.node = e.vec_id left join n on n.node = e.vec_id
"""

OP7 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

ORACLE_SQL = {"op1_chat": OP1, "op5_embeddings": OP5, "op7_top_k": OP7, "op10_url_filter": OP10}
