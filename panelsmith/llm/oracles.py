"""DuckDB SQL of the training-data queries that SQL can state."""

#: One row per document or item and term, words as the search takes them.
_TERMS = r"""regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SEARCH = f"""
with d as (select doc_id, {_TERMS} as w from documents where text is not null),
full_docs as (select doc_id, len(w) as n, w from d where len(w) > 0),
totals as (select count(*)::bigint as nn, sum(n)::bigint as ll from full_docs),
words as (select doc_id, n, unnest(w) as term from full_docs),
tf as (select doc_id, n, term, count(*)::bigint as tf from words group by all),
items as (select item_id, unnest({_TERMS}) as term from benchmark where text is not null),
wanted as (select item_id, term, count(*)::bigint as times from items group by all),
df as (select term, count(*)::bigint as df from tf where term in (select term from wanted) group by term),
weights as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint as w from df, totals),
scores as (
    select item_id, doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))))::bigint as score
    from wanted join weights using (term) join tf using (term), totals
    group by item_id, doc_id
),
ranked as (
    select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
    from scores where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""

COLLOCATIONS = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
),
split as (select lang, row_number() over () as p, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
places as (select lang, p, unnest(w) as w1, unnest(range(len(w))) as i from split),
following as (
    select lang, w1, lead(w1, 1) over piece as w2, lead(w1, 2) over piece as w3, lead(w1, 3) over piece as w4
    from places window piece as (partition by p order by i)
),
counts as (
    select lang, 1 as size, w1 as phrase, count(*)::bigint as f from following group by all
    union all
    select lang, 2, w1 || ' ' || w2, count(*)::bigint from following where w2 is not null group by all
    union all
    select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*)::bigint from following where w3 is not null group by all
    union all
    select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*)::bigint from following where w4 is not null group by all
),
totals as (select lang, sum(f)::bigint as n from counts where size = 1 group by lang),
cand as materialized (select lang, size, phrase, f, string_split(phrase, ' ') as w from counts where f >= 30),
cuts as (
    select lang, size, phrase, f, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as rest
    from (select *, unnest(range(1, size)) as k from cand where size > 1)
),
parts as (
    select c.lang, c.phrase, c.f as a, k, x.f as l, y.f as r, ((2000000::hugeint * c.f) // (x.f + y.f))::bigint as score
    from cuts c join cand x on x.lang = c.lang and x.phrase = c.head join cand y on y.lang = c.lang and y.phrase = c.rest
),
lowest as (select *, row_number() over (partition by lang, phrase order by score, k) as place from parts),
held as (
    select lang, unnest([w[1:2], w[2:3], w[3:4], w[1:3], w[2:4]]) as inside, w, f from cand where size = 4
    union all
    select lang, unnest([w[1:2], w[2:3]]), w, f from cand where size = 3
),
covering as (select lang, array_to_string(inside, ' ') as phrase, max(f) as most from held group by all),
stay as (
    select p.lang, p.phrase, a, l, r, score
    from lowest p left join covering q on p.lang = q.lang and p.phrase = q.phrase
    where place = 1 and (q.most is null or 100 * q.most < 80 * a)
),
ranked as (
    select s.lang, row_number() over (partition by s.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
    from stay s join totals t on s.lang = t.lang
)
select lang, rank::int as rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""
