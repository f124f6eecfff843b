"""SQL equivalents (DuckDB) of those training-data queries whose results do not hang on learned weights, hash orders or file bytes."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Control strings and marks of the default chat template.
_CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_BEGIN, _AFTER_ROLE, _END = "<|im_start|>", "\n", "<|im_end|>\n"


def _escaped_length(column: str) -> str:
    """Code points of an escaped text: one more for every escape character and every control string."""
    found = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) / {len(c)}" for c in _CONTROLS)
    return f"cast(length({column}) + length({column}) - length(replace({column}, chr(92), '')) + {found} as bigint)"


OP2 = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n as (select *, row_number() over w - 1 as number, lag(role) over w as before from t window w as (partition by conv_id order by turn nulls first, role, text)),
e as (select *, case when before is null then 'start' when before = 'system' then 'ready' when before = 'user' then 'asked' when before = 'assistant' then 'answered' end as state from n),
bad as (select conv_id, number, concat('turn ', number, ': ', case when role = '' then 'no role' else role end, ' after ', state) as why,
 row_number() over (partition by conv_id order by number) as k from e
 where not ((state = 'start' and role in ('system', 'user')) or (state = 'ready' and role = 'user') or (state = 'asked' and role = 'assistant') or (state = 'answered' and role = 'user')))
select n.conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by n.number)) as turns_sha256,
 cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by n.number), '')) as loss_sha256,
 cast(sum({len(_BEGIN + _AFTER_ROLE + _END)} + {_escaped_length("role")} + {_escaped_length("text")}) as bigint) as formatted_chars, max(why) as error
from n left join bad on bad.conv_id = n.conv_id and k = 1 group by n.conv_id"""

OP3 = f"""
with d as (select doc_id, {WORDS} as ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i : i + 12], ' ')) as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d)),
least_ as (select k, min(doc_id) as f from win group by k),
gone as (select distinct doc_id, i + o as p from win join least_ using (k), (select unnest(range(13)) as o) where f < doc_id),
word as (select doc_id, p, ws[p] as w from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as p from d)),
kept as (select doc_id, string_agg(w, ' ' order by p) as t, count(*) as n from word anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""

OP5 = f"""
with d as (select doc_id, {WORDS} as ws from documents),
gram as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from d where len(ws) > 0)),
own as (select doc_id, md5(string_agg(g, chr(10) order by g)) as s, count(*) as n from gram group by doc_id union all select doc_id, 'empty', 0 from d where len(ws) = 0),
node as (select s, min(doc_id) as text_id, max(n) as n from own group by s),
held as (select n.text_id as a, n.n, g.g from node n join gram g on g.doc_id = n.text_id),
link as (select x.a, y.a as b from held x join held y on x.g = y.g and x.a < y.a group by x.a, y.a, x.n, y.n having 9 * count(*) >= 4 * (x.n + y.n)),
both_ as (select a, b from link union all select b, a from link),
reach as (with recursive r as (select text_id as a, text_id as b from node union select r.a, l.b from r join both_ l on r.b = l.a) select a, min(b) as class_id from r group by a)
select doc_id, class_id, text_id, (select count(*) from both_ l where l.a = text_id) as n_links from own join node using (s) join reach on reach.a = text_id"""

OP9 = """
with p as (select page_id, coalesce(html, '') as html from pages),
f as (select page_id, octet_length(encode(html)) as b, sha256(html) as h, case when octet_length(encode(html)) >= 100 then min(page_id) over (partition by html) end as first from p)
select page_id, cast(b as bigint) as payload_bytes, h as payload_digest, case when page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
 case when page_id is distinct from first then first end as refers_to, cast(null as varchar) as error from f"""

#: CRC-32 of a decimal number, by the table that the polynomial's rule gives.
_CRC_TABLE = """crc as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
 lambda c, z: case when c % 2 = 1 then xor(cast(3988292384 as bigint), c // 2) else c // 2 end)) as t)"""
_CRC = """xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint))),
 lambda a, b: xor(t[cast(xor(a, b) % 256 as bigint) + 1], a // 256)), cast(4294967295 as bigint))"""

OP12 = f"""
with {_CRC_TABLE},
own as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
 from conversations where conv_id is not null),
conv as (select c, c - c % 100 as base, {_CRC} % 6 as h from (select distinct c from own), crc),
held as (select c as base, max(pos) as n from own group by c),
turns as (select conv.c, o.pos as depth, o.role, o.text from conv join own o on o.c = conv.base and o.pos <= h
 union all select conv.c, pos - h + least(h, coalesce(n, 0)), role, text from own join conv on conv.c = own.c left join held using (base) where pos > h),
named as (select c, depth, length(text) as chars, md5(string_agg(concat(length(role), ':', role, length(text), ':', text), '') over (partition by c order by depth)) as k from turns
 union all select c, 0, 0, 'root' from conv),
path as (select *, lag(k) over (partition by c order by depth) as up, max(depth) over (partition by c) as deepest from named),
node as (select k, depth, min(up) as up, min(c) as conv_id, count(*) as n_convs, max(chars) as chars,
 sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where deepest = depth), '')) as ends_sha256 from path group by k, depth),
kids as (select up as k, count(*) as n from node group by up),
value as (select node.*, coalesce(n, 0) as n_children, (n_convs - 1) * chars as saved from node left join kids using (k)),
total as (select a.k, count(*) filter (where v.n_children = 0) as n_leaves, sum(v.saved) as saved_tokens from value v join named a on a.c = v.conv_id and a.depth <= v.depth group by a.k)
select v.conv_id, cast(v.depth as bigint) as depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, v.ends_sha256
from value v join total using (k) left join node p on p.k = v.up"""

ORACLES = {"op2_chat_format": OP2, "op3_substring_dedup": OP3, "op5_jaccard_join": OP5, "op9_warc": OP9, "op12_prefix_trie": OP12}
