"""SQL of queries that SQL can express."""

NEAR_DUPLICATES = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from w where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id as id, doc_id as root from documents union select l.b, r.root from r join l on l.a = r.id)
select r.id as doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(root) as component_id, r.id = min(root) as kept
from r left join n on n.doc_id = r.id group by r.id
"""

# CRC-32 of a short ASCII text, a byte at a time and eight shifts a byte.
CRC32 = """xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint), lambda c, b:
  list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda d, i: xor(d >> 1, (d & 1) * 3988292384), xor(c, b)), 4294967295::bigint), 4294967295::bigint)"""

LANGUAGE_FRAME = f"""
select doc_id, {CRC32} % 3 = 1 as held_out, text is null or not regexp_matches(text, '\\pL') as und from documents
"""

QUALITY_FRAME = f"""
select doc_id, {CRC32} % 4 = 2 as held_out, true as agrees from documents
"""

SHARD_BALANCE = """
with n as (select count(*) as n from documents), s as (select unnest(range(8))::int as shard)
select shard, n // 8 + (shard < n % 8)::int as rows, 0::bigint as first_slot, n // 8 + (shard < n % 8)::int - 1 as last_slot, n // 8 + (shard < n % 8)::int as slots from n, s where n // 8 + (shard < n % 8)::int > 0
"""

SHARD_SIZES = """
select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size from documents
"""

MEDIA_FRAME = r"""
with d as (select doc_id, encode(coalesce(text, '')) as b from documents), e as (select *, octet_length(b) as n from d), p as (select *, greatest(1, (n + 575) // 576) * 576 as whole from e)
select doc_id, n as n_bytes, whole::bigint as payload_bytes, sha256(b || repeat('\xFF'::blob, (whole - n)::int)) as payload_sha256 from p
"""


def _spans(kind: str, pattern: str) -> str:
    """SQL of (doc_id, kind, start, match): every match is set off by two marks, and lengths before it add up to its start."""
    return f"""
  {kind}_parts as (select doc_id, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) as parts from d),
  {kind}_each as (select doc_id, parts, unnest(range(2, len(parts) + 1)) as i from {kind}_parts where len(parts) > 1),
  {kind} as (select doc_id, '{kind}' as kind, cast(list_sum(list_transform(parts[1 : i - 1], lambda x: length(replace(x, chr(2), '')))) as bigint) as start, string_split(parts[i], chr(2))[1] as match from {kind}_each)"""


_ASSIGN = """(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRET_BASE = f"""
with d as (select doc_id, replace(replace(coalesce(text, ''), chr(1), ' '), chr(2), ' ') as t from documents),{_spans('assign', _ASSIGN)},{_spans('access', 'AKIA[A-Z0-9]+')},{_spans('hex', '[0-9a-f]+')},
every as (select * from assign where length(regexp_extract(match, '{_ASSIGN}', 1)) >= 8 union all select * from access where length(match) >= 16 union all select * from hex where length(match) >= 32),
told as (select doc_id, count(*) filter (where kind = 'assign') as a, count(*) filter (where kind = 'access') as b, count(*) filter (where kind = 'hex') as c,
  string_agg(kind || ':' || start || ':' || (start + length(match)), ',' order by start, case kind when 'assign' then 0 when 'access' then 1 else 2 end) as spans from every group by doc_id)
select d.doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256 from d left join told on told.doc_id = d.doc_id
"""
