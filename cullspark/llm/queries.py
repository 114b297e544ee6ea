"""The operators' queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, decontaminate, exact_dedup, langid, lexical, line_dedup, minhash, packing, repair, substring_dedup, warc
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pages_beside(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The pages in the documents' folder; none where the folder has no such table."""
    try:
        return table(spark, sf_dir, "pages")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by all four kinds of evidence: markup and address come from the pages that show them."""
    return langid.documents_identified(spark, table(spark, sf_dir, "documents"), pages_beside(spark, sf_dir))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator for pages themselves; its models come from documents."""
    model = langid.train(table(spark, sf_dir, "documents"))
    return langid.identify(langid.of_pages(table(spark, sf_dir, "pages")), model).withColumnRenamed("id", "page_id").drop("text_hash")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_similar_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed", "n_links")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("text_hash")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(chat.as_tool_calls(table(spark, sf_dir, "conversations")), chat.REPLY)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(repair.damaged(table(spark, sf_dir, "conversations")), of=table(spark, sf_dir, "conversations"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


#: op11: the cheapest edits from the back, as cost and letters in one text that sorts by both; then the lines from the front.


def _step(cost: str, letter: str, of: str) -> str:
    return f"lpad(cast(cast(substr({of}, 1, 10) as bigint) + {cost} as varchar), 10, '0') || '{letter}' || substr({of}, 11)"


def _row(state: int) -> str:
    """The best of a row's edits in a state, given the best after it in each state (v0 to v3)."""
    follow, nxt = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state], (2, 2, 3, 2)[state]
    keep = "case " + " ".join(f"when i = '{i}' then {_step('late', 'K', f'v{to}')}" for i, to in follow.items()) + " end"
    return f"case when bad then {_step('4', 'D', f'v{state}')} else least({_step('4', 'D', f'v{state}')}, {_step('3 + late', 'R', f'v{nxt}')}, coalesce({keep}, '9')) end"


_RE = "case when s = 2 then 'assistant' else 'user' end"
_OP11 = f"""
    with recursive d0 as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
    d1 as (select *, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda j: cast(unicode(substr(k, j, 1)) as bigint)), lambda c, b:
        list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end)), cast(4294967295 as bigint)), 4294967295) % 20 as hit from d0),
    d2 as (select conv_id, turn, case when hit = 4 then 'user' else role end as role, case hit when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
        unnest(case when hit = 3 then [0, 1] else [0] end) as copy from d1 where hit <> 0),
    d3 as (select *, cast(row_number() over (partition by conv_id order by turn nulls first, role, text) as int) as nr from d2),
    d4 as (select *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as said, row_number() over (partition by conv_id, role, text order by nr) > 1 as again, substr(role, 1, 1) as i from d3),
    d as materialized (select *, said = '' as blank, said <> '' and again as dup, said <> '' and not again and right(said, 1) not in ('.', '!', '?') as trunc, said = '' or again as bad,
        coalesce(lag(i) over (partition by conv_id order by nr) || i not in ('su', 'ua', 'au'), false) as odd, case when said <> '' and not again and right(said, 1) not in ('.', '!', '?') then 3 else 0 end as late,
        'k' || coalesce(cast(conv_id as varchar), '') as conv from d4),
    sums as (select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate, count(*) filter (trunc) as truncated, count(*) filter (odd) as illegal, max(nr) as n from d group by 1),
    back as (select conv, n + 1 as nr, '0000000000' as v0, '0000000006II' as v1, '0000000003I' as v2, '0000000000' as v3 from sums
      union all
      select conv, nr, least(r0, {_step('3', 'I', 'i2')}), least(r1, {_step('3', 'I', 'i2')}), i2, least(r3, {_step('3', 'I', 'i2')}) from (
        select *, least(r2, {_step('3', 'I', 'r3')}) as i2 from (
          select b.conv, d.nr, {_row(0)} as r0, {_row(1)} as r1, {_row(2)} as r2, {_row(3)} as r3 from back b join d on d.conv = b.conv and d.nr = b.nr - 1))),
    best as (select conv, cast(substr(v0, 1, 10) as bigint) as cost, substr(v0, 11) as audit from back where nr = 1),
    front as (select conv, audit, 1 as p, 1 as nr, 0 as s, cast(null as varchar) as line from best
      union all
      select f.conv, audit, p + 1, case when e = 'I' then f.nr else f.nr + 1 end, case when e = 'D' then s when e = 'K' then case i when 's' then 1 when 'u' then 2 else 3 end when s = 2 then 3 else 2 end,
        case e when 'I' then {_RE} || ':' when 'K' then role || ':' || text when 'R' then {_RE} || ':' || text end
      from (select *, substr(audit, p, 1) as e from front where p <= length(audit)) f left join d on d.conv = f.conv and d.nr = f.nr),
    said as (select conv, sha256(string_agg(line, chr(10) order by p)) as hash from front where line is not null group by 1)
    select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
      coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(hash, sha256('')) as repaired_sha256
    from (select distinct conv_id, 'k' || coalesce(cast(conv_id as varchar), '') as conv from conversations) c left join sums using (conv) left join best using (conv) left join said using (conv)"""


QUERIES = {f.__name__: f for f in (op1_language_id, language_of_pages, op2_substring_dedup, op3_packing, op4_line_dedup, op5_warc, op6_exact_dedup, op7_minhash, op8_bpe, op9_ann, op10_chat, op11_repair, op12_decontaminate, op13_lexical)}

#: op9_ann finds nearly all of the nearest, which SQL can't express; tests/llm holds it against brute force.
ORACLES = {
    "op11_repair": _OP11,
    "op13_lexical": r"""
        with d0 as (select row_number() over () as nr, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        d as (select nr, doc_id, len(w) as n, w from d0 where len(w) > 0),
        s as (select count(*) as docs, cast(sum(n) as bigint) as length from d),
        p as materialized (select nr, term, count(*) as tf from (select nr, unnest(w) as term from d) group by 1, 2),
        f as (select term, cast(floor(1000 * ln((2.0e0 * docs + 2) / (2.0e0 * count(*) + 1))) as bigint) as weight from p, s group by term, docs),
        q as (select nr, item_id, term, count(*) as times from (select row_number() over () as nr, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term from benchmark) group by 1, 2, 3),
        m as (select nr, doc_id, 25 + (75 * n * docs) // length as m from d, s),
        r as (select q.nr as query, any_value(item_id) as item_id, m.nr, any_value(doc_id) as doc_id, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
          from q join f using (term) join p using (term) join m on m.nr = p.nr group by q.nr, m.nr),
        k as (select item_id, cast(row_number() over (partition by query order by score desc, doc_id) as int) as rank, doc_id, score from r where score > 0)
        select item_id, rank, doc_id, score from k where rank <= 10""",
    "op12_decontaminate": r"""
        with d as (select row_number() over () as nr, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        i as materialized (select distinct item, n, array_to_string(w[k:k + n - 1], ' ') as said from (select *, unnest(range(1, len(w) - n + 2)) as k from (select *, least(10, len(w)) as n from b where len(w) > 0))),
        t as (select nr, n, k, array_to_string(w[k:k + n - 1], ' ') as said from (select nr, n, w, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from i) where len(w) >= n)),
        h as materialized (select nr, t.n, k, item from t join i on t.said = i.said and t.n = i.n),
        p as (select nr, count(distinct j) as n_hit from (select nr, unnest(range(k, k + n)) as j from h) group by 1),
        g as (select nr, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct nr, item from h) group by 1)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join p using (nr) left join g using (nr)""",
    "op5_warc": """
        with p as (select page_id, coalesce(html, '') as html, url from pages),
        d as (select page_id, url, octet_length(encode(html)) as payload_bytes, sha256(html) as payload_digest from p),
        f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
        select page_id, cast(payload_bytes as bigint) as payload_bytes, d.payload_digest,
          case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
          case when first <> page_id then first end as refers_to, url
        from d left join f on d.payload_digest = f.payload_digest and d.payload_bytes >= 100""",
    "op6_exact_dedup": """
        with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents),
        g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, d.text_sha256 from d join g using (text_sha256)""",
    "op10_chat": """
        with m as (select conv_id, turn, role, text from conversations),
        c as (select * from m where role = 'user'), r as (select * from m where role = 'assistant'),
        e as (
          select c.conv_id, c.turn, 'call' as kind, c.conv_id || ':' || c.turn as call_id, r.turn is not null as linked,
            case when c.turn >= 2 and p.turn is null then 'after ' || c.conv_id || ':' || (c.turn - 2) || ' is no call' else '' end as errors,
            '{"arguments":{"prompt":' || to_json(c.text) || ',"turn":' || c.turn || '},"id":"' || c.conv_id || ':' || c.turn || '","name":"reply","result":' || coalesce(cast(to_json(r.text) as varchar), 'null') || '}' as json
          from c left join r on c.conv_id = r.conv_id and r.turn = c.turn + 1 left join c p on p.conv_id = c.conv_id and p.turn = c.turn - 2
          union all
          select r.conv_id, r.turn, 'result', r.conv_id || ':' || (r.turn - 1), false, 'no such call',
            '{"id":"' || r.conv_id || ':' || (r.turn - 1) || '","result":' || to_json(r.text) || '}'
          from r where not exists (select 1 from c where c.conv_id = r.conv_id and c.turn = r.turn - 1)
          union all
          select conv_id, turn, 'message', null, false, '', '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' from m where role not in ('user', 'assistant'))
        select conv_id, turn, row_number() over (partition by conv_id order by turn, kind) - 1 as position, kind, call_id, linked, errors, json from e""",
}
