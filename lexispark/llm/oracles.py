"""DuckDB SQL for the queries of this subpackage that SQL can express: brute force over all rows."""

_WORDS = "coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), [])"
_DOC_HASH = "('0x' || substr(md5(coalesce(doc_id::varchar, '') || ' ' || md5(coalesce(text, ''))), 1, 15))::bigint"

ORACLES: dict[str, str] = {
    "op1_ngram_join": f"""
with recursive words as (select doc_id, {_WORDS} as ws from documents),
grams as (
    select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as g
    from words, unnest(range(1, greatest(len(ws) - 3, 2))) as t(i) where len(ws) > 0
), sized as (select doc_id, count(*) as n from grams group by doc_id),
both_have as (
    select a.doc_id as x, b.doc_id as y, count(*) as c from grams a join grams b using (g) where a.doc_id <> b.doc_id group by all
), links as (
    select x, y from both_have join sized s on s.doc_id = x join sized t on t.doc_id = y where 5 * c >= 4 * (s.n + t.n - c)
), reach(x, y) as (
    select doc_id, doc_id from documents union select r.x, l.y from reach r join links l on l.x = r.y
), counted as (select x, count(*) as n from links group by x)
select d.doc_id, coalesce(c.n, 0)::bigint as n_links, m.class_id
from documents d left join counted c on c.x = d.doc_id
join (select x, min(y) as class_id from reach group by x) m on m.x = d.doc_id
""",
    "op2_substring_dedup": f"""
with words as (select doc_id, {_WORDS} as ws from documents),
places as (
    select doc_id, i, ws[i] as w, case when i + 12 <= len(ws) then array_to_string(ws[i : i + 12], ' ') end as g
    from words, unnest(range(1, len(ws) + 1)) as t(i)
), firsts as (select g, min(doc_id) as first_id from places where g is not null group by g),
marked as (
    select p.doc_id, i, w, coalesce(max(case when f.first_id < p.doc_id then 1 end)
        over (partition by p.doc_id order by i rows between 12 preceding and current row), 0) as gone
    from places p left join firsts f on f.g = p.g
), kept as (
    select doc_id, sum(gone) as n_removed, string_agg(w, ' ' order by i) filter (where gone = 0) as text from marked group by doc_id
)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from words d left join kept k on k.doc_id = d.doc_id
""",
    "op6_line_dedup": """
with lines as (
    select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
    from documents where text is not null
), runs as (
    select doc_id, i, line, case when lead(line, 2) over w is not null then [line, lead(line, 1) over w, lead(line, 2) over w] end as run
    from lines window w as (partition by doc_id order by i)
), ranked as (
    select doc_id, i, line, case when run is not null and row_number() over (partition by run order by doc_id, i) > 1 then 1 else 0 end as again
    from runs
), marked as (
    select doc_id, i, line, max(again) over (partition by doc_id order by i rows between 2 preceding and current row) as gone from ranked
), kept as (
    select doc_id, count(*) as n_lines, sum(gone) as n_removed, string_agg(line, chr(10) order by i) filter (where gone = 0) as text
    from marked group by doc_id
)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join kept k on k.doc_id = d.doc_id
""",
    "op7_embedding_join": """
with recursive good as (
    select vec_id, label, embedding::double[] as v from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
    select a.vec_id as x, b.vec_id as y from good a join good b on a.label = b.label and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.v, b.v) >= 0.93
), reach(x, y) as (
    select vec_id, vec_id from embeddings union select r.x, l.y from reach r join links l on l.x = r.y
), counted as (select x, count(*) as n from links group by x)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, m.c as component_id, e.vec_id = m.c as kept
from embeddings e left join counted c on c.x = e.vec_id
join (select x, min(y) as c from reach group by x) m on m.x = e.vec_id
""",
    "op9_mixing": f"""
with base as (
    select doc_id, source, {_DOC_HASH} as h,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
    from documents
), per as (
    select source, sum(size)::bigint as source_size, 2 * sum(size)::bigint as lim,
        [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
    from base group by source
), levels as (
    select *, (1.5::double * sum(source_size) over ()
        - coalesce(sum(lim) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
    from per window w as (order by lim::double / weight, source nulls last rows between unbounded preceding and 1 preceding)
), targets as (
    select source, source_size, least(lim::double, max(level) over () * weight) as target from levels
), needs as (
    select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as repeats from targets
), needed as (
    select *, target - repeats * source_size as need from needs
), groups as (
    select source, h, sum(size)::bigint as held, sum(sum(size)) over (partition by source order by h) as upto
    from base group by source, h
), marked as (
    select g.source, g.h, n.source_size, n.target, n.repeats,
        g.upto < n.need or (g.upto - g.held <= n.need and g.held <= 2 * (n.need - (g.upto - g.held))
            and (g.upto - g.held < n.need or g.held = 0)) as more
    from groups g join needed n on g.source is not distinct from n.source
)
select b.doc_id, b.size, m.source_size::bigint as source_size, m.target,
    (b.size * (m.repeats + case when m.more then 1 else 0 end))::bigint as taken
from base b join marked m on b.source is not distinct from m.source and b.h = m.h
""",
    "op11_source_divergence": r"""
with d as (
    select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents
), w as (select doc, lang, source, unnest(terms) as term from d),
k as (select lang, term from w group by all having count(distinct doc) >= 10),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v from k group by lang),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
full_rows as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join k using (lang) left join c using (lang, source, term)),
p as (
    select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * v) as p from full_rows join v using (lang)
), q as (
    select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang) + 2 * v) as q
    from (select lang, term, sum(n) as n from c group by all) join v using (lang)
), pairs as (
    select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), both_parts as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value
    from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
    union all
    select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p join q using (lang, term) where n > 0 and p > q
)
select * from (
    select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from both_parts
) where part = 'pair' or rank <= 10
""",
    "op12_quality_rules": rf"""
with d as (select row_number() over () as doc, doc_id, coalesce(text, '') as text, {_WORDS} as ws from documents),
lines as (select doc, unnest(string_split(text, chr(10))) as line from d),
by_lines as (select doc, count(*) as n_lines, count(distinct line) as different from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc),
windows as (select doc, i, array_to_string(ws[i : i + 4], ' ') as g from d, unnest(range(1, len(ws) - 3)) as t(i)),
again as (select doc, g from windows group by all having count(*) > 1),
covered as (select w.doc, count(distinct w.i + j) as n from windows w join again using (doc, g), unnest(range(0, 5)) as t(j) group by w.doc),
most as (select doc, max(n) as n from (select doc, w, count(*) as n from (select doc, unnest(ws) as w from d) group by all) group by doc),
counted as (
    select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
        coalesce(n_lines - different, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(m.n, 0) as n_most,
        len(regexp_extract_all(text, '[A-Z]')) as n_upper, len(regexp_extract_all(text, '[a-z]')) as n_lower,
        len(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')) as n_letters, len(regexp_extract_all(text, '!')) as n_marks,
        len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) as n_stutter
    from d left join by_lines using (doc) left join covered c using (doc) left join most m using (doc)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or word_chars > 20 * n_words or 2 * word_chars < 3 * n_words or 10 * n_symbols > n_words
        or 2 * n_dup_lines > n_lines or (n_upper > n_lower and n_upper > 20) or 10 * n_marks > 3 * n_words or 10 * n_letters < 4 * word_chars or 10 * n_stutter > 3 * n_words
        or (5 * n_most > 2 * n_words and n_words >= 20)) as kept
from counted
""",
    "op13_conversation_repair": r"""
with recursive crc as (
    select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as crc
), keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint)),
        lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8))) % 20 as kind
    from conversations, crc
), harmed as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from keyed, unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end))
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from harmed
), judged as (
    select *, case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
        when right(bare, 1) not in ('.', '!', '?') then 'truncated' end as fault, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) as before
    from placed
), walked as (
    select conv_id, count(*) + 1 as i, [
        {'c': 0, 'a': '', 'r': []::varchar[]}, {'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}, {'c': 3, 'a': 'I', 'r': ['assistant:']}, {'c': 0, 'a': '', 'r': []::varchar[]}
    ] as w from judged group by conv_id
    union all
    select conv_id, i, list_transform([2, 2, 3, 2], lambda t, q: list_sort([v[q], {'c': v[t + 1].c + 3, 'a': 'I' || v[t + 1].a, 'r': list_prepend(case t when 2 then 'user:' else 'assistant:' end, v[t + 1].r)}])[1])
    from (
        select conv_id, i, list_transform([2, 2, 3, 2], lambda t, q: list_sort([u[q], {'c': u[t + 1].c + 3, 'a': 'I' || u[t + 1].a, 'r': list_prepend(case t when 2 then 'user:' else 'assistant:' end, u[t + 1].r)}])[1]) as v
        from (
            select w.conv_id, j.i, list_transform([2, 2, 3, 2], lambda t, q: list_sort([
                {'c': w[q].c + 4, 'a': 'D' || w[q].a, 'r': w[q].r},
                {'c': case when fault in ('blank', 'duplicate') then 1000000 else 0 end + case when fault = 'truncated' then 3 else 0 end
                    + case when (q = 1 and initial = 's') then w[2].c when (q in (1, 2, 4) and initial = 'u') then w[3].c when (q = 3 and initial = 'a') then w[4].c else 1000000 end,
                 'a': 'K' || case when initial = 's' then w[2].a when initial = 'u' then w[3].a else w[4].a end,
                 'r': list_prepend(role || ':' || text, case when initial = 's' then w[2].r when initial = 'u' then w[3].r else w[4].r end)},
                {'c': case when fault in ('blank', 'duplicate') then 1000000 else 0 end + case when fault = 'truncated' then 3 else 0 end + 3 + w[t + 1].c,
                 'a': 'R' || w[t + 1].a, 'r': list_prepend(case t when 2 then 'user:' else 'assistant:' end || text, w[t + 1].r)}
            ])[1]) as u
            from walked w join judged j on j.conv_id is not distinct from w.conv_id and j.i = w.i - 1
        )
    )
), best as (select conv_id, w[1] as b from walked where i = 1),
summed as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate,
        count_if(fault = 'truncated') as truncated, count_if(before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
    from judged group by conv_id
)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
    coalesce(illegal, 0)::bigint as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit, sha256(coalesce(array_to_string(b.r, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join best on best.conv_id is not distinct from c.conv_id left join summed s on s.conv_id is not distinct from c.conv_id
""",
}
