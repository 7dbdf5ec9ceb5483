"""The registered queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.llm import (bpe, chat, exact_dedup, fingerprints, near_dedup, packing, pii, quality, structure, token_counts,
                           topk_search, toxicity, whitening)
from epochlens.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
PSEUDONYM_KEY = "a key that the operator's user keeps secret"


def vocabulary() -> str:
    """Where the installed vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def held_out(doc_id: str = "doc_id"):
    """The rows that no classifier may learn from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out())
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "clauses", "worst")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.findings(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op5_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.co_train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=~held_out())
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "meta_score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repair(table(spark, sf_dir, "conversations"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.succession(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query for query in (
        op1_toxicity, op2_pii, op3_bpe, op4_best_fit_packing, op5_quality_cotraining, op6_token_counts,
        op7_minhash_near_dedup, op8_exact_dedup, op9_chat_format, op10_topk_search, op11_structure_repair, op12_fingerprints,
        op13_whitening)
}

SQL: dict[str, str] = {
    "op10_topk_search": """
        with ints as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
                      where embedding is not null and len(embedding) > 0
                        and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
             scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
                        from ints q, ints c where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v))
        select query_id, rank::int as rank, vec_id, score from (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
        where rank <= 10""",
    "op8_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))""",
    # An insertion is never cheapest: deleting a neighbour costs less. So an audit has one letter a row. The fold runs from
    # the last row over the four states of the role grammar; each holds nine digits of cost, then the audit.
    "op11_structure_repair": """
        with codes as (
            select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i:
                case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as code),
        keyed as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, list_transform(regexp_extract_all(hex(encode(
                coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))), '..'), lambda x: ('0x' || x)::bigint) as b
            from conversations),
        hashed as (
            select conv_id, turn, role, text,
                   xor(list_reduce(b, lambda c, x: xor(c >> 8, code[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 20 as kind
            from keyed, codes),
        damaged as (
            select conv_id, turn, case when kind = 4 then 'user' else role end as role,
                   case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
                   unnest(range(case when kind = 3 then 2 else 1 end)) as copy
            from hashed where kind <> 0),
        placed as (
            select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body, role[1] as initial,
                   row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as pos,
                   row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen
            from damaged),
        faults as (
            select *, body = '' as blank, body <> '' and seen > 1 as duplicate,
                   body <> '' and seen = 1 and body[-1] not in ('.', '!', '?') as truncated,
                   lag(initial) over (partition by conv_id order by pos) || initial as pair
            from placed),
        signed as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(blank::int) as blank,
                   sum(duplicate::int) as duplicate, sum(truncated::int) as truncated,
                   sum((pair not in ('su', 'ua', 'au'))::int) as illegal,
                   list([case when blank or duplicate then 'd' when initial in ('s', 'u', 'a') then initial else 'x' end,
                         case when truncated then '5' else '0' end] order by pos desc) as signs
            from faults group by conv_id),
        solved as (
            select *, list_reduce(signs, lambda s, x: list_transform([1, 2, 3, 4], lambda g: least(
                lpad((left(s[g], 9)::bigint + 2)::varchar, 9, '0') || 'D' || substr(s[g], 10),
                case when x[1] = 'd' then '999999999' else least(
                    case when g = 3 then '999999999'
                         else lpad((left(s[3], 9)::bigint + 1 + x[2]::int)::varchar, 9, '0') || 'R' || substr(s[3], 10) end,
                    case when g <> 3 then '999999999'
                         else lpad((left(s[4], 9)::bigint + 1 + x[2]::int)::varchar, 9, '0') || 'R' || substr(s[4], 10) end,
                    case when g = 1 and x[1] = 's' then lpad((left(s[2], 9)::bigint + x[2]::int)::varchar, 9, '0') || 'K' || substr(s[2], 10)
                         when g <> 3 and x[1] = 'u' then lpad((left(s[3], 9)::bigint + x[2]::int)::varchar, 9, '0') || 'K' || substr(s[3], 10)
                         when g = 3 and x[1] = 'a' then lpad((left(s[4], 9)::bigint + x[2]::int)::varchar, 9, '0') || 'K' || substr(s[4], 10)
                         else '999999999' end) end)),
                ['000000000', '900000000', '900000000', '000000000'])[1] as best
            from signed),
        audited as (select *, left(best, 9)::bigint as cost, substr(best, 10) as audit from solved),
        kept as (
            select f.*, a.audit[f.pos] as op, row_number() over (partition by f.conv_id order by f.pos) - 1 as place,
                   first_value(f.initial = 's' and a.audit[f.pos] = 'K') over (partition by f.conv_id order by f.pos) as system
            from faults f join audited a on f.conv_id is not distinct from a.conv_id where a.audit[f.pos] <> 'D'),
        texts as (
            select conv_id, sha256(string_agg(case when op = 'K' then role when (place - system::int) % 2 = 0 then 'user' else 'assistant' end
                                              || ':' || text, chr(10) order by pos)) as repaired
            from kept group by conv_id),
        ids as (select distinct conv_id from conversations)
        select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
               coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
               coalesce(audit, '') as audit, coalesce(repaired, sha256('')) as repaired_sha256
        from ids i left join audited a on i.conv_id is not distinct from a.conv_id left join texts t on i.conv_id is not distinct from t.conv_id""",
}
