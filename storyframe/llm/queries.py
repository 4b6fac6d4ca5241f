"""The queries of this subpackage and, where SQL can express them, their oracle SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyframe.llm import mixing
from storyframe.llm.brown import brown_scores
from storyframe.llm.chat import CONTROL, END, TURN, conversation_digests
from storyframe.llm.common import documents
from storyframe.llm.decontaminate import decontaminate
from storyframe.llm.exact_dedup import exact_dedup
from storyframe.llm.language_id import language_id
from storyframe.llm.line_dedup import line_dedup
from storyframe.llm.pii import find_pii
from storyframe.llm.secrets import secret_scan
from storyframe.llm.simhash import simhash_dedup


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_scores(documents(spark, sf_dir), every_word=True)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversation_digests(rows.unionByName(more))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", "n_chars", "block", "slot", "start_char", "in_target")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secrets, op2_brown, op3_exact_dedup, op4_chat, op5_line_dedup, op6_simhash, op7_pii, op8_mixing, op9_language, op10_decontamination)
    return {f.__name__: f for f in own}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Escapes a text as the template does; {0} is the column.
_ESCAPED = (
    "regexp_replace(replace({0}, '\\', '\\\\'), "
    + _sql("(<|\\[)(" + "|".join("".join(f"\\x{{{ord(x):x}}}" for x in c[1:]) for c in CONTROL) + ")")
    + ", '\\1\\\\e\\2', 'g')"
)

_MIXING = f"""
    with recursive d as (
        select doc_id, source, coalesce(length(text), 0) as n_chars, case when source is null then '' else '=' || source end as key,
               md5(coalesce(doc_id::varchar, '')) as h from documents
    ),
    o as (select *, coalesce(sum(n_chars) over (partition by key order by h, doc_id, n_chars rows between unbounded preceding and 1 preceding), 0)::bigint as start_char from d),
    t as (select key, sum(n_chars)::bigint as chars, pow(greatest(sum(n_chars), 1)::double, {mixing.ALPHA}) as raw from d group by key),
    s as (select *, row_number() over (order by key) as i, greatest(1, round(raw * {mixing.QUANTA} / sum(raw) over ()))::bigint as a from t),
    p as (select list(a order by i) as a, sum(a)::bigint as period, count(*) as n from s),
    e(slot, done, who) as (
        select -1::bigint, list_transform(a, lambda x: 0::bigint), 0::bigint from p
        union all
        select slot + 1, list_transform(range(1, n + 1), lambda i: done[i] + (case when i = w then 1 else 0 end)), w
        from (
            select e.slot, e.done, p.n, list_min(list_transform(range(1, p.n + 1), lambda i:
                (case when (e.done[i] * p.period) // p.a[i] <= e.slot + 1 then ((e.done[i] + 1) * p.period + p.a[i] - 1) // p.a[i] else 1000000000 end) * 10000 + i)) % 10000 as w
            from e, p where e.slot + 1 < p.period
        )
    ),
    g as (select who as i, list(slot order by slot) as slots from e where slot >= 0 group by who),
    r as (select s.key, s.a, p.period, g.slots, greatest(1, ceil(s.chars / {mixing.BLOCK_CHARS}))::bigint as blocks from s join g using (i), p),
    z as (select min((blocks // a) * period + slots[blocks % a + 1]) as horizon from r),
    b as (select o.*, start_char // {mixing.BLOCK_CHARS} as block from o)
    select doc_id, source, n_chars, block, (block // a) * period + slots[block % a + 1] as slot, start_char,
           (block // a) * period + slots[block % a + 1] < horizon as in_target
    from b join r using (key), z
"""

_ORACLES = {
    "op8_mixing": _MIXING,
    "op4_chat": f"""
        with c as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
               coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
               sum({len(TURN) + len(END) + 2} + length({_ESCAPED.replace("{0}", "role")}) + length({_ESCAPED.replace("{0}", "text")})) as formatted_chars
        from c group by conv_id
    """,
    "op3_exact_dedup": f"""
        with t as (select doc_id, {_LOWER.format("coalesce(text, '')")} as content from documents)
        select doc_id, max(doc_id) over (partition by content) as keep_id, count(*) over (partition by content) as group_size,
               row_number() over (partition by content order by doc_id desc nulls last) = 1 as kept, sha256(content) as text_sha256
        from t
    """,
    "op5_line_dedup": f"""
        with parts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        l as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from parts),
        k as (select doc_id, line, pos, {_LOWER.format("regexp_replace(line, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g')")} as key from l),
        r as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct coalesce(doc_id::varchar, '')) >= 3),
        m as (select k.doc_id, k.line, k.pos, r.key is not null and r.last is distinct from k.doc_id as gone from k left join r on k.key = r.key)
        select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
        from m group by doc_id
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
