"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from millrace.llm import chat, phrases, prefix_trie

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
with d as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
q as (select item_id::varchar as item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select item, unnest(range(1, len(w) - least(len(w), 13) + 2)) as j, least(len(w), 13) as k, w from q where len(w) > 0),
win2 as (select item, j, k, array_to_string(w[j:j + k - 1], ' ') as g from win),
lengths as (select distinct k from win2),
grams as (select doc_id, k, unnest(range(1, len(w) - k + 2)) as i, w from d, lengths where len(w) >= k),
found as (select doc_id, i, item, j, k from (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g from grams) join win2 using (k, g)),
hit as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + k)) as p from found) group by 1),
items as (select doc_id, count(distinct item) as n, string_agg(distinct item, ',' order by item) as names from found group by 1),
runs as (select doc_id, item, k, i, i - row_number() over (partition by doc_id, item, k, i - j order by i) as island, i - j as diagonal from found),
longest as (select doc_id, item, count(*) + min(k) - 1 as n, min(i) - 1 as p from runs group by doc_id, item, k, diagonal, island),
best as (select doc_id, n, item, p, row_number() over (partition by doc_id order by n desc, p, item) as r from longest)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(hit.n, 0) as n_hit, coalesce(items.n, 0) as n_items, sha256(coalesce(items.names, '')) as items_sha256,
  coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(d.w) as contaminated, b.n as longest_match, b.item as longest_item, b.p as longest_at
from d left join hit using (doc_id) left join items using (doc_id) left join (select * from best where r = 1) b using (doc_id)
"""

WARC = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by h) as first from p)
select page_id, strlen(html) as payload_bytes,
  array_to_string([substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substring(h, 5 * (k // 4) + 1, 5))::bigint >> (15 - 5 * (k % 4))) & 31) + 1, 1) for k in range(32)], '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from f
"""

MINHASH = rf"""
with recursive d as (select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from g),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n u on u.doc_id = x join n v on v.doc_id = y where 100 * c >= 75 * (u.n + v.n - c)),
both_ways as (select x, y from l union all select y, x from l),
r(doc_id, root) as (select doc_id, doc_id from d union select r.doc_id, b.y from r join both_ways b on r.root = b.x)
select doc_id, coalesce(n.n, 0) as n_shingles, min(root) as component_id, min(root) = doc_id as kept from r left join n using (doc_id) group by doc_id, n.n
"""

ORACLE_SQL = {"op1_decontamination": DECONTAMINATION, "op6_warc": WARC, "op8_minhash": MINHASH, "op9_perspectives": chat.SQL, "op11_phrases": phrases.SQL, "op12_prefix_trie": prefix_trie.SQL}
