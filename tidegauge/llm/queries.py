"""The thin queries, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import conversations, exact_dedup, fill_middle, graph_search, language_id, language_model, line_dedup, mixing, packing, secrets, simhash, token_counts, toxicity


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_read(spark, sf_dir, "documents"))


def op5_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.learnable(docs), labels)
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    places = F.array_join(F.col("deleted").cast("array<string>"), ",")
    return found.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("deleted").cast("long").alias("n_deleted"), places.alias("deleted_lines"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = mixing.assign(_read(spark, sf_dir, "documents"))
    first = F.floor(F.element_at("uses.position", 1) * 1e9).cast("long")
    return assigned.select("doc_id", "size", "source_size", "target", "taken", F.when(F.size("uses") > 0, first).alias("first_position")).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op8_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op9_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(_read(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    return conversations.audit(rows, conversations.damaged(rows))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.restore(fill_middle.transform(_read(spark, sf_dir, "documents")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(language_id.learnable(docs)))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_backoff_scores": op4_backoff_scores,
    "op5_toxic_passages": op5_toxic_passages,
    "op6_line_dedup": op6_line_dedup,
    "op7_curriculum_mix": op7_curriculum_mix,
    "op8_entropy_secrets": op8_entropy_secrets,
    "op9_graph_neighbours": op9_graph_neighbours,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_fill_middle": op12_fill_middle,
    "op13_language_id": op13_language_id,
}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
        select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
               row_number() over w = 1 as kept, sha256(norm) as text_sha256
        from d window w as (partition by norm order by doc_id nulls last)""",
    "op7_curriculum_mix": r"""
        with recursive d as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                   md5(concat_ws(':', doc_id::varchar, text)) as key from documents),
        s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as n from d group by source),
        w as (select *, (n - 1) % 3 as kind, [3.0::double, 1.0, 2.0][(n - 1) % 3 + 1] as weight, 2.0::double * source_size as cap from s),
        -- sources are fixed at their caps round by round, the rest shared by weight among the others
        fill(round, source, fixed) as (
            select 0, source, false from w
            union all
            select round + 1, source, fixed or level * weight > cap from (
                select f.round, f.source, f.fixed, w.weight, w.cap,
                       (sum(w.source_size) over () * 1.5::double - coalesce(sum(w.cap) filter (f.fixed) over (), 0)) / nullif(sum(w.weight) filter (not f.fixed) over (), 0) as level
                from fill f join w on f.source is not distinct from w.source where f.round < 60)),
        t as (select w.source, w.source_size, w.kind, case when f.fixed then w.cap else
                (sum(w.source_size) over () * 1.5::double - coalesce(sum(w.cap) filter (f.fixed) over (), 0)) / sum(w.weight) filter (not f.fixed) over () * w.weight end as target
              from w join fill f on f.source is not distinct from w.source and f.round = 60),
        p as (select d.doc_id, d.size, t.source_size, t.kind, t.target, round(t.target)::bigint as words,
                coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id nulls last, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as sum_before
              from d join t on d.source is not distinct from t.source),
        q as (select *, case when source_size > 0 then words // source_size else 0 end as full_passes from p),
        r as (select *, greatest(0, least(size, words - full_passes * source_size - sum_before)) as rest, sum_before / greatest(1.0::double, target) as part from q),
        x as (select *, case when size > 0 and (full_passes > 0 or rest > 0) then
                case kind when 0 then case when part < 0.625 then 2 * part / (1.5 + sqrt(1.5 * 1.5 - 2 * part)) else 0.5 + 2 * (part - 0.625) / (1 + sqrt(greatest(0, 1 - 2 * (part - 0.625)))) end
                          when 1 then case when part < 0.5 then 2 * part / 2 else 0.5 + 2 * (part - 0.5) / 2 end
                          else case when part < 0.375 then 2 * part / (0.5 + sqrt(0.25 + 2 * part)) else 0.5 + 2 * (part - 0.375) / (1 + sqrt(1 + 2 * (part - 0.375))) end end end as position from r)
        select doc_id, size::bigint as size, source_size, target, (full_passes * size + rest)::bigint as taken, floor(position * 1e9)::bigint as first_position from x""",
    "op8_entropy_secrets": r"""
        with raw as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
        k(kind, name, pattern) as (values
            (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
            (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]{24,}'), (3, 'entropy', '[A-Za-z0-9+/_=-]{20,}')),
        m as (select r, 0 as kind, regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as hits,
                     string_split_regex(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)') as gaps from raw
              union all select r, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') from raw
              union all select r, 2, regexp_extract_all(text, '[0-9a-f]{24,}'), string_split_regex(text, '[0-9a-f]{24,}') from raw
              union all select r, 3, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), string_split_regex(text, '[A-Za-z0-9+/_=-]{20,}') from raw),
        e as (select r, kind, unnest(hits) as hit, unnest(gaps[1:len(hits)]) as gap, unnest(range(len(hits))) as i from m),
        p as (select r, kind, hit, (sum(len(gap) + len(hit)) over (partition by r, kind order by i))::bigint as stop from e),
        base as (select r, kind, stop - len(hit) as start, stop from p
                 where kind = 2 or kind = 1 and len(hit) >= 20
                    or kind = 0 and len(regexp_extract(hit, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6),
        c as (select row_number() over () as n, r, hit, stop - len(hit) as start,
                     20 * (log2(20) - case when regexp_matches(hit, '^[0-9a-fA-F]+$') then 3.0 else 3.8 end) as most
              from p where kind = 3 and not regexp_matches(hit, '(?i:example|sample|placeholder|dummy|changeme|lorem|xxxx|0123456789|abcdefgh)')
                and not regexp_matches(hit, '^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$')
                and not regexp_matches(hit, '^[0-9+/_=-]+$') and not regexp_matches(hit, '^[^0-9]+$')),
        w as (select n, r, start, most, unnest(range(len(hit) - 19)) as i, hit from c),
        l as (select n, r, start, most, i, unnest(string_split(hit[i + 1:i + 20], '')) as letter from w),
        h as (select n, r, start, most, i, letter, count(*) as times from l group by all),
        s as (select n, r, start, i from h group by n, r, start, i, most having sum(round(1e6 * times * log2(times))) <= floor(1e6 * most)),
        added as (select r, 3 as kind, start + min(i) as start, start + max(i) + 20 as stop from s group by n, r, start),
        every as (select * from base union all
                  select a.* from added a where not exists (select 1 from base b where b.r = a.r and b.start < a.stop and a.start < b.stop)),
        named as (select e.r, e.kind, e.start, k.name || ':' || e.start || ':' || e.stop as span from every e join k using (kind)),
        g as (select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
                     string_agg(span, ',' order by start, kind) filter (kind < 3) as base, string_agg(span, ',' order by start, kind) as spans from named group by r)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
               sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from raw left join g using (r)""",
    "op11_conversation_repair": r"""
        with recursive crc as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)) as t),
        k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint)),
                                lambda x, b: xor(x // 256, t[xor(x, b) % 256 + 1])), 4294967295) % 20 as kind from conversations, crc),
        d as (select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                unnest(case kind when 3 then [0, 1] else [0] end) as copy from k where kind <> 0),
        o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen from d),
        f as (select *, role[1] as initial, lag(role[1]) over (partition by conv_id order by i) || role[1] not in ('su', 'ua', 'au') as illegal,
                case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when seen > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault from o),
        g as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
                count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal from f group by conv_id),
        -- states of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a
        adds(q, n, r) as (values (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
        edits(q, edit, letter, r, price) as (values (0, 'D', '', 0, 4), (1, 'D', '', 1, 4), (2, 'D', '', 2, 4), (3, 'D', '', 3, 4), (0, 'R', '', 2, 3), (1, 'R', '', 2, 3), (2, 'R', '', 3, 3), (3, 'R', '', 2, 3),
                (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0)),
        best(conv_id, i, q, x) as (
            select distinct conv_id, 0::bigint, 0, struct_pack(cost := 0, audit := '') from conversations
            union all
            select conv_id, i, q, min(x) from (
                select b.conv_id, f.i, e.r as q, struct_pack(cost := b.x.cost + 3 * a.n + e.price + case when e.edit <> 'D' and f.fault = 'truncated' then 3 else 0 end, audit := b.x.audit || repeat('I', a.n) || e.edit) as x
                from best b join f on f.conv_id is not distinct from b.conv_id and f.i = b.i + 1 join adds a on a.q = b.q
                join edits e on e.q = a.r and (e.edit = 'D' or f.fault not in ('blank', 'duplicate')) and (e.edit <> 'K' or e.letter = f.initial)) group by conv_id, i, q),
        w as (select b.conv_id, min(struct_pack(cost := b.x.cost + 3 * a.n, audit := b.x.audit || repeat('I', a.n))) as x from best b left join g on g.conv_id is not distinct from b.conv_id
              join adds a on a.q = b.q and a.r in (0, 3) where b.i = coalesce(g.n, 0) group by b.conv_id),
        l as (select conv_id, unnest(string_split(x.audit, '')) as edit, unnest(range(len(x.audit))) as nth from w where x.audit <> ''),
        m as (select *, count(*) filter (edit <> 'I') over v as i, count(*) filter (edit <> 'D') over v as place from l window v as (partition by conv_id order by nth)),
        r as (select m.*, f.role, f.text, coalesce(max((edit = 'K' and place = 1 and f.initial = 's')::int) over (partition by m.conv_id), 0) as shift
              from m left join f on f.conv_id is not distinct from m.conv_id and f.i = m.i and m.edit <> 'I'),
        h as (select conv_id, string_agg(case when edit = 'K' then role when (place - shift) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by nth) as lines from r where edit <> 'D' group by conv_id)
        select w.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
               w.x.cost::bigint as cost, w.x.audit as audit, sha256(coalesce(h.lines, '')) as repaired_sha256
        from w left join g on g.conv_id is not distinct from w.conv_id left join h on h.conv_id is not distinct from w.conv_id""",
    "op12_fill_middle": r"""
        with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as tokens, sha256('1:' || coalesce(doc_id::varchar, '')) as key from documents),
        h as (select doc_id, text, tokens, len(tokens) as n, ('0x' || key[1:8])::bigint as h1, ('0x' || key[9:16])::bigint as h2, ('0x' || key[17:24])::bigint as h3, ('0x' || key[25:32])::bigint as h4 from d),
        c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
                case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
        p as (select *, array_to_string(tokens[1:a], '') as prefix, array_to_string(tokens[a + 1:b], '') as middle, array_to_string(tokens[b + 1:], '') as suffix from c)
        select doc_id, n, form, case when form <> 'plain' then len(prefix) end as prefix_chars, case when form <> 'plain' then len(middle) end as middle_chars,
               sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
               sha256(text) as restored_sha256 from p""",
}
