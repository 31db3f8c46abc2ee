"""DuckDB SQL for the rows of the queries that SQL can express, on the same tables."""

from __future__ import annotations

from attestry.llm.quality import RULES, STOP_FORMS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def covered(window: int, partition: str) -> str:
    """CTEs that end in g: (doc_id, p) of words under windows that occur again, per ``partition`` or in all documents."""
    return f"""
        s as (select doc_id, w, unnest(range(1, len(w) - {window - 2})) as i from d where len(w) >= {window}),
        h as (select doc_id, i, array_to_string(list_slice(w, i, i + {window - 1}), ' ') as k from s),
        c as (select doc_id, i from (select doc_id, i, count(*) over (partition by {partition}) as n from h) where n > 1),
        g as (select distinct doc_id, i + o as p from c, unnest(range(0, {window})) as t(o))"""


_METRICS = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "alpha_words_ratio": "n_alpha_words / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(n_letters, 1)",
    "exclamations_per_word": "n_exclamations / greatest(n_words, 1)",
    "dup_lines_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "stop_words_ratio": "n_stop_words / greatest(n_words, 1)",
    "distinct_words_ratio": "n_distinct_words / greatest(n_words, 1)",
}
_PASSES = " and ".join(
    f"(n_words < {r.from_words} or ({' and '.join([f'{_METRICS[r.metric]} >= {r.low}'] * (r.low is not None) + [f'{_METRICS[r.metric]} <= {r.high}'] * (r.high is not None))}))"
    for r in RULES
)
_STOP = ", ".join("'" + w + "'" for w in STOP_FORMS)

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
        with d as (select doc_id, coalesce(text, '') as text, {WORDS} as w,
                          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
        {covered(8, "doc_id, k")},
        r as (select doc_id, count(*) as n from g group by 1),
        m as (
            select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
                   len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
                   len(regexp_extract_all(text, '\p{{Lu}}')) as n_upper, len(regexp_extract_all(text, '\p{{L}}')) as n_letters, len(regexp_extract_all(text, '!')) as n_exclamations,
                   len(list_distinct(w)) as n_distinct_words, len(list_filter(w, lambda x: x in ({_STOP}))) as n_stop_words,
                   len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) as n_alpha_words
            from d left join r using (doc_id)
        ), b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
        select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
               n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and {_PASSES} as kept from b""",
    "op5_line_dedup": f"""
        with l as (
            select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos
            from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)
        ), k as (
            select *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l
        ), c as (
            select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5
        ), m as (
            select doc_id, line, pos, coalesce(doc_id < keeper, false) as lost from k left join c using (key)
        )
        select doc_id, count(*)::bigint as n_lines, (count(*) filter (where lost))::bigint as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
        from m group by doc_id""",
    "op8_substring_dedup": f"""
        with d as (select doc_id, {WORDS} as w from documents),
        {covered(35, "k")},
        x as (select doc_id, word, p from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from d)),
        k as (select x.doc_id, count(*) as n, count(g.p) as gone, string_agg(word, ' ' order by x.p) filter (where g.p is null) as kept
              from x left join g on g.doc_id = x.doc_id and g.p = x.p group by 1)
        select doc_id, coalesce(n, 0)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from documents left join k using (doc_id)""",
    "op9_ngram_join": f"""
        with recursive d as (select doc_id, {WORDS.replace("text", LOWER.format("text"), 1)} as w from documents),
        s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 2), ' ') as sh
              from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)),
        n as (select doc_id, count(*) as n from s group by 1),
        z as (select s.doc_id, sh, n from s join n using (doc_id)),
        l as (select a.doc_id as x, b.doc_id as y from z a join z b on a.sh = b.sh and a.doc_id <> b.doc_id and 10 * a.n >= 9 * b.n and 10 * b.n >= 9 * a.n
              group by 1, 2 having 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
        r as (select x as v, x as least from l union select r.v, l.y from r join l on l.x = r.least),
        m as (select v as doc_id, min(least) as least from r group by 1)
        select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(least, doc_id) as component_id
        from documents left join n using (doc_id) left join m using (doc_id)""",
    "op11_hard_negatives": """
        with e as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
            from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2]))::bigint as score
            from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
        ), p as (
            select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5
        )
        select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other) as rank, other as negative_id,
               positive_score, score as negative_score
        from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
        qualify rank <= 5""",
    "op13_gap_sessions": """
        with recursive one as (
            select distinct on (click_id) click_id, client_id, epoch_us(ts) as t, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 900000000, false) as late,
                   coalesce(kind in ('purchase', 'signup') and value >= 60, false) as final, coalesce(floor(100 * value + 0.5), 0)::bigint as cents
            from clicks where click_id is not null and client_id is not null and ts is not null
        ), ordered as (
            select *, lag(t) over w as before, coalesce(lag(final) over w, false) as ended, row_number() over w as pos from one where not late window w as (partition by client_id order by t, click_id)
        ), islands as (
            select *, sum(case when before is null or ended or t - before >= 900000000 then 1 else 0 end) over (partition by client_id order by pos) as island from ordered
        ), starts as (
            select client_id, island, min(t) as t, min(pos) as pos from islands group by 1, 2
            union all
            select i.client_id, i.island, min(i.t), min(i.pos) from starts s join islands i on i.client_id = s.client_id and i.island = s.island and i.t > s.t + 3600000000
            group by 1, 2
        ), marked as (
            select i.*, s.pos is not null as begins, max(s.pos) over (partition by i.client_id order by i.pos) as start_pos,
                   case when s.pos is null or before is null then null when ended then 'end' when i.t - before >= 900000000 then 'gap' else 'length' end as why
            from islands i left join starts s on s.client_id = i.client_id and s.pos = i.pos
        ), sessions as (
            select client_id, start_pos, arg_min(click_id, pos) as session_id, min(t) as start_us, max(t) as end_us, count(*) as n_clicks, sum(cents) as value_cents,
                   arg_max(final, pos) as final, max(pos) as last_pos, sha256(string_agg(click_id::varchar, ',' order by pos)) as path_sha256
            from marked group by 1, 2
        ), spans as (
            select *, lead(start_us) over (partition by client_id order by start_pos) as next_us from sessions
        ), l as (
            select s.client_id, s.start_pos, count(*) as n_late from one o join spans s on s.client_id = o.client_id and o.t >= s.start_us and o.t < coalesce(s.next_us, 9223372036854775807)
            where o.late group by 1, 2
        )
        select s.client_id, session_id, start_us, end_us, n_clicks::bigint as n_clicks, coalesce(n_late, 0)::bigint as n_late, value_cents::bigint as value_cents,
               coalesce(m.why, case when s.final then 'end' else 'none' end) as closed_by, path_sha256
        from spans s left join l using (client_id, start_pos) left join marked m on m.client_id = s.client_id and m.pos = s.last_pos + 1""",
}
