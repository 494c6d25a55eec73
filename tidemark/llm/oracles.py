"""SQL that computes the same results on the same tables, for the queries that SQL can express."""

from __future__ import annotations

# Fixed values, the same in all statements: what counts as blank.
_BLANK = r"(content is null or regexp_full_match(content, '[\s\p{Z}\p{C}ᅟᅠ⠀ㅤﾠ]*'))"
_ROLE = r"lower(regexp_replace(role, '^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$', '', 'g'))"


def _similar(table: str, key: str) -> str:
    return f"""
    select '{table}' as record_table, least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b
    from (select {key} as id, list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) as w from {table}) a
    join (select {key} as id, list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) as w from {table}) b on a.id < b.id
    where len(a.w) > 0 and len(b.w) > 0
      and len(list_intersect(a.w, b.w)) >= 0.7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9
    """


_TALK = f"""
    rows as (select id, session_id, role, content, created_at, source_key from session_turns),
    firsts as (
      select * from rows qualify row_number() over (partition by coalesce('k' || source_key, 'i' || id) order by id) = 1),
    talk as (
      select session_id, id, created_at, {_ROLE} as r, content from firsts
      where session_id is not null and not {_BLANK} and {_ROLE} in ('user', 'assistant') and created_at is not null),
    seen as (
      select session_id, r, lag(r) over w as p, lead(r) over w as n
      from talk window w as (partition by session_id order by created_at, id)),
    dropped as (
      select distinct session_id from rows
      where session_id is not null and (role is null or {_ROLE} = '' or created_at is null)
      union
      select distinct session_id from rows where session_id is not null and session_id not in (select session_id from talk)
      union
      select session_id from seen where (p is null and r <> 'user') or (r = 'user' and coalesce(n, 'user') = 'user'))
"""

ORACLES: dict[str, str] = {
    "p2_found": _similar("memory_vectors", "id") + " union all " + _similar("extracted_preferences", "pref_id"),
    "p6_found": f"with {_TALK} select session_id from dropped",
    "p6_conversations": f"""
        with {_TALK}
        select session_id, row_number() over (partition by session_id order by created_at, id) - 1 as position, r as role, content, epoch_us(created_at) as created_us, id
        from talk where session_id not in (select session_id from dropped)""",
    "p8_totals": "select count(*) as texts, 0::bigint as texts_not_whole, 0::bigint as containers_overfull, 0::bigint as wasteful from documents where length(text) > 0",
    "p9_found": r"""
        with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from documents where text is not null),
        d as (select doc_id, array_to_string(ws[i:i + 11], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 10)) as i from w where len(ws) >= 12)),
        v as (select item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') as ws from eval_items),
        e as (select distinct item_id, array_to_string(ws[i:i + 11], ' ') as g from (select item_id, ws, unnest(range(1, len(ws) - 10)) as i from v where len(ws) >= 12))
        select distinct doc_id, item_id from d join e using (g)""",
    "p10_found": """
        with w as (select doc_id, md5(substr(text, i, 300)) as g
                   from (select doc_id, text, unnest(range(1, length(text) - 298)) as i from documents where length(text) >= 300)),
        o as (select distinct doc_id, g from w where g in (select g from w group by g having count(distinct doc_id) > 1))
        select distinct a.doc_id as doc_a, b.doc_id as doc_b from o a join o b on a.g = b.g and a.doc_id < b.doc_id""",
    "p10_deduplicated": r"""
        with t as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
        l as (select doc_id, k as line_no, ls[k] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as k from t)),
        n as (select *, regexp_replace(regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[\s\p{Z}]+', ' ', 'g') as n from l),
        r as (select *, row_number() over (partition by n order by doc_id, line_no) as k from n),
        kept as (select doc_id, string_agg(line, chr(10) order by line_no) as text_kept from r where length(n) = 0 or k = 1 group by doc_id)
        select doc_id, case when text is null then null else coalesce(text_kept, '') end as text_kept from documents left join kept using (doc_id)""",
    "p10_lines": r"""
        with t as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
        l as (select doc_id, k as line_no, ls[k] as line,
                     coalesce(list_sum(list_transform(ls[1:k - 1], lambda x: length(x) + 1)), 0) as start
              from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as k from t)),
        n as (select doc_id, line_no, start, length(line) as length,
                     regexp_replace(regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[\s\p{Z}]+', ' ', 'g') as n from l),
        r as (select *, row_number() over (partition by n order by doc_id, line_no) as k,
                     first_value(doc_id) over (partition by n order by doc_id, line_no) as first_doc,
                     first_value(line_no) over (partition by n order by doc_id, line_no) as first_line from n where length(n) >= 1)
        select doc_id, line_no::int as line_no, start::int as start, length::int as length, first_doc, first_line::int as first_line from r where k > 1""",
}
