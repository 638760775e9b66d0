"""The conversation queries in SQL, to compare with."""

_BLANK = r"\s\x{0085}\x{00a0}\x{00ad}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}"

_JUDGED = rf"""
with m as (
  select session_id, min(id) as id, role, content, sec from (
    select session_id, id, role, content, case when created_at > 1e11 then created_at / 1000 else created_at end as sec
    from session_messages where session_id is not null and regexp_matches(content, '[^{_BLANK}]'))
  group by session_id, role, content, sec),
r as (
  select session_id, id, content, sec, case when lower(trim(role)) in ('user','usr','human','customer') then 'user'
    when lower(trim(role)) in ('assistant','ai','bot','model') then 'assistant'
    when lower(trim(role)) in ('system','sys') then 'system' end as role from m),
o as (
  select *, lag(role) over w as prev, lead(role) over w as next, row_number() over w as seq
  from r window w as (partition by session_id order by sec, id)),
s as (
  select session_id, bool_or(role is null or role <> 'system') as present,
    bool_or(role is null or sec is null or (role = 'system' and prev <> 'system') or (role = 'assistant' and coalesce(prev, 'system') <> 'user')) as broken,
    bool_or(role = 'user' and coalesce(next, '') <> 'assistant') as unanswered
  from o group by session_id),
ids as (select session_id from sessions where session_id is not null union select session_id from session_messages where session_id is not null),
judged as (
  select ids.session_id, case when not coalesce(present, false) then 'empty'
    when broken or ids.session_id not in (select session_id from sessions where session_id is not null) then 'broken'
    when unanswered then 'missing_reply' end as defect
  from ids left join s using (session_id))
"""

FOUND = _JUDGED + "select session_id, defect from judged where defect is not null"
SOUND = _JUDGED + "select o.session_id, seq, role, content, sec as created_at from o join judged using (session_id) where defect is null"
