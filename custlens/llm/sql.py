"""The same results as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

LINE_DEDUP = """
with lines as (
 select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as nr
 from documents),
trimmed as (select *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as s from lines),
numbered as (select doc_id, nr, s, row_number() over (partition by doc_id order by nr) as place from trimmed where s <> ''),
threes as (
 select doc_id, place, s || chr(10) || lead(s, 1) over w || chr(10) || lead(s, 2) over w as three,
        [nr, lead(nr, 1) over w, lead(nr, 2) over w] as covers
 from numbered window w as (partition by doc_id order by place)),
ranked as (
 select *, row_number() over (partition by three order by doc_id, place) as nth from threes where three is not null),
gone as (select distinct doc_id, unnest(covers) as nr from ranked where nth > 1)
select t.doc_id, count(*) filter (t.s <> '') as n_lines, count(g.nr) as n_removed,
       coalesce(string_agg(t.line, chr(10) order by t.nr) filter (g.nr is null), '') as text
from trimmed t left join gone g on t.doc_id = g.doc_id and t.nr = g.nr
group by t.doc_id
"""

#: Words are runs of letters, digits and characters outside ASCII.
DECONTAMINATION = r"""
with words as (
 select 'd' as kind, doc_id as id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
 union all
 select 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
sized as (
 select *, len(w) as n, least(5, len(w)) as k from words where len(w) > 0),
lengths as (select distinct k from sized where kind = 'i'),
grams as (
 select distinct s.kind, s.id, l.k, unnest(list_transform(range(1, s.n - l.k + 2), lambda i: array_to_string(s.w[i:i + l.k - 1], ' '))) as gram
 from sized s join lengths l on s.n >= l.k and (s.kind = 'd' or s.k = l.k)),
sizes as (select id, count(*) as n_item from grams where kind = 'i' group by id)
select d.id as doc_id, i.id as item_id, count(*) as n_shared, max(n_item) as n_item,
       count(*)::double / max(n_item) as containment
from grams d join grams i on d.kind = 'd' and i.kind = 'i' and d.k = i.k and d.gram = i.gram join sizes z on z.id = i.id
group by d.id, i.id having count(*) * 100 >= 80 * max(n_item)
"""

#: Words are runs of characters other than ASCII white space.
QUALITY = r"""
with d as (
 select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
threes as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from d where len(w) > 2),
counted as (
 select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from threes),
covered as (select doc_id, unnest([i, i + 1, i + 2]) as place from counted where n > 1),
repeats as (select doc_id, count(distinct place) as n_repeat_words from covered group by doc_id),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
of_lines as (
 select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines,
        count(*) filter (regexp_matches(line, '(\.\.\.|…)[ \t-\r]*$')) as n_cut
 from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
counts as (
 select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
        coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(n_cut, 0) as n_cut,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) as n_letters,
        length(regexp_replace(text, '[^0-9]', '', 'g')) as n_digits
 from d left join repeats using (doc_id) left join of_lines using (doc_id)),
base as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or n_symbols > n_words or (n_lines >= 4 and n_dup_lines * 100 > n_lines * 60)
            or word_chars < 2 * n_words or word_chars > 20 * n_words or n_letters * 100 < 80 * n_words
            or (n_lines >= 4 and n_cut * 100 > n_lines * 60) or n_digits * 2 > word_chars) as kept
from base
"""

SUBSTRING_DEDUP = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, unnest(range(1, len(w) - 33)) as i, w from d where len(w) >= 35),
windows as (select doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) as h from starts),
repeated as (select doc_id, i from (select *, count(*) over (partition by h) as n from windows) where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as place from repeated),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as place from d)
select d.doc_id, max(len(w)) as n_words, count(g.place) as n_removed,
       sha256(coalesce(string_agg(x.word, ' ' order by x.place) filter (g.place is null), '')) as kept_sha256
from d left join words x on x.doc_id = d.doc_id left join gone g on g.doc_id = x.doc_id and g.place = x.place
group by d.doc_id
"""

NGRAM_JOIN = r"""
with recursive d as (
 select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
 select distinct doc_id, unnest(case when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as g
 from d where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
 select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (
 select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
reach as (select doc_id, doc_id as other from d union select r.doc_id, l.b from reach r join links l on r.other = l.a)
select r.doc_id, coalesce(max(s.n), 0) as n_shingles, min(other) as component_id
from reach r left join sizes s on s.doc_id = r.doc_id group by r.doc_id
"""


#: Runs of 16; a tree ends with the level that has one node.
MERKLE = r"""
with recursive
bits as (
 select doc_id, doc_id::varchar as id, 4294967295::bigint as crc, 0 as done from documents where doc_id is not null
 union all
 select doc_id, id, case when step & 1 = 1 then xor(step >> 1, 3988292384) else step >> 1 end, done + 1 from (
  select *, case when done % 8 = 0 then xor(crc, ascii(substr(id, done // 8 + 1, 1))::bigint) else crc end as step
  from bits where done < 8 * length(id))),
chosen as (select distinct doc_id from bits where done = 8 * length(id) and xor(crc, 4294967295) % 5 = 0),
stated as (
 select doc_id, coalesce('=' || source, '') as tree,
  coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
   || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') as head,
  coalesce(octet_length(encode(text)) || ':' || text, '-') as body,
  coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') as low
 from documents),
leaves as (
 select s.doc_id, tree, sha256(head || body) as leaf, sha256(head || case when c.doc_id is null then body else low end) as given,
  row_number() over (partition by tree order by s.doc_id nulls first, sha256(head || body)) - 1 as pos,
  count(*) over (partition by tree) as n, row_number() over () as row_id
 from stated s left join chosen c on c.doc_id = s.doc_id),
nodes as (
 select tree, 0 as level, pos, leaf as digest, n from leaves
 union all
 select tree, level + 1, pos // 16, sha256(string_agg(digest, '' order by pos)), (any_value(n) + 15) // 16
 from nodes where n > 1 group by tree, level, pos // 16),
subroots as (
 select tree, digest, row_number() over (order by tree) - 1 as pos, count(*) over () as n from nodes where n = 1),
tops as (
 select 0 as level, pos, digest, n from subroots
 union all
 select level + 1, pos // 16, sha256(string_agg(digest, '' order by pos)), (any_value(n) + 15) // 16
 from tops where n > 1 group by level, pos // 16),
low as (
 select row_id, tree, 0 as level, pos, given as digest, '' as proof from leaves
 union all
 select row_id, l.tree, any_value(l.level) + 1, any_value(l.pos) // 16,
  sha256(coalesce(string_agg(s.digest, '' order by s.pos) filter (s.pos < l.pos), '') || any_value(l.digest)
   || coalesce(string_agg(s.digest, '' order by s.pos) filter (s.pos > l.pos), '')),
  any_value(l.proof) || coalesce(string_agg(s.digest, '' order by s.pos) filter (s.pos <> l.pos), '')
 from low l join nodes s on s.tree = l.tree and s.level = l.level and s.n > 1 and s.pos // 16 = l.pos // 16 group by row_id, l.tree),
high as (
 select l.row_id, 0 as level, s.pos, l.digest, l.proof from low l join nodes t on t.tree = l.tree and t.level = l.level and t.n = 1
  join subroots s on s.tree = l.tree
 union all
 select row_id, any_value(l.level) + 1, any_value(l.pos) // 16,
  sha256(coalesce(string_agg(s.digest, '' order by s.pos) filter (s.pos < l.pos), '') || any_value(l.digest)
   || coalesce(string_agg(s.digest, '' order by s.pos) filter (s.pos > l.pos), '')),
  any_value(l.proof) || coalesce(string_agg(s.digest, '' order by s.pos) filter (s.pos <> l.pos), '')
 from high l join tops s on s.level = l.level and s.n > 1 and s.pos // 16 = l.pos // 16 group by row_id)
select v.doc_id, v.leaf, u.digest as subroot, r.digest as root, sha256(h.proof) as proof_sha256, h.digest as folded_root,
       h.digest = r.digest as verified, case when v.tree = '' then null else substr(v.tree, 2) end as source, v.pos as rank
from leaves v join subroots u on u.tree = v.tree join tops r on r.n = 1
 join high h on h.row_id = v.row_id and h.level = r.level
"""


def all_sql() -> dict[str, str]:
    return {
        "op1_decontamination": DECONTAMINATION, "op3_substring_dedup": SUBSTRING_DEDUP, "op6_ngram_join": NGRAM_JOIN,
        "op8_line_dedup": LINE_DEDUP, "op10_quality_rules": QUALITY, "op12_merkle_manifest": MERKLE,
    }
