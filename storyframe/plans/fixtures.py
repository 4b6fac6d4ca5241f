"""Tables of chapters, dialogue, voices, characters and jobs, derived from the test tables; each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyframe.functions.text import ETX, STX, strings

TITLES = (
    "Chapter 1: Arrival", "Chapter 2", "Preface", "Part I", "The Long Road", "Index", "Title Page", "", "Chapter 3: Return", "1. Introduction", "Book Two", "Appendix A",
    "Foreword", "Volume III", "Cover", "About the Author", "Copyright 2020", "Acknowledgements", "Epilogue", "A Note on Sources", "Part Second", "Notes", "Dedication", "Chapter 4",
)
SPEAKERS = ("Ann Archer", "Ann", "Mr. Archer", "Bob Baker", "Bob", "Cy Cole", "Dr. Cole", "Dee", "Dee Dunn", "Eve", "Finn Fox", "Fox")
MARKS = ("***", "---", "#", "")
PRONOUNS = ("he/him", "she/her", "they/them", "")
#: What an event of each type does to a job.
STATUS = {"signup": "pending", "view": "processing", "click": None, "purchase": "completed", "error": "failed"}


#: Chapters of a book.
BOOK = 100


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def chapters(spark: SparkSession, sf: str) -> DataFrame:
    """A chapter for each document, a hundred to a book: (book_id, chapter_idx, title, paragraphs), with scene marks set in."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    mark = lambda i: F.get(strings(MARKS), F.floor((F.col("doc_id") + i) / 17) % 4)
    marked = F.flatten(F.transform(F.split("text", "\n"), lambda p, i: F.when((F.col("doc_id") + i) % 17 == 0, F.array(p, mark(i))).otherwise(F.array(p))))
    return d.select(F.floor(F.col("doc_id") / BOOK).alias("book_id"), F.col("doc_id").alias("chapter_idx"), F.get(strings(TITLES), F.col("doc_id") % 24).alias("title"), marked.alias("paragraphs"))


CHAPTERS = f"""
    fx1 as (
        select doc_id // {BOOK} as book_id, doc_id as chapter_idx, ({sql_list(TITLES)})[doc_id % 24 + 1] as title,
               flatten(list_transform(range(len(l)), lambda i: case when (doc_id + i) % 17 = 0 then [l[i + 1], ({sql_list(MARKS)})[((doc_id + i) // 17) % 4 + 1]] else [l[i + 1]] end)) as paragraphs
        from (select *, string_split(text, chr(10)) as l from documents)
    )
"""
#: White space of Unicode and the separators of ASCII, for DuckDB.
SPACES = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\pZ]"
WORDS = "len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"


def dialogue(spark: SparkSession, sf: str) -> DataFrame:
    """A paragraph for each turn: (book_id, chapter_idx, para_idx, text, speaker)."""
    c = table(spark, sf, "conversations")
    name = F.get(strings(SPEAKERS), F.col("conv_id") % 12)
    first = F.substring_index("text", " ", 1)
    text = (
        F.when(F.col("role") == "user", F.concat(F.lit('"'), "text", F.lit('" said '), name))
        .when(F.col("role") == "assistant", F.concat(F.lit(STX), first, F.lit(ETX), F.substring(F.col("text"), F.length(first) + 1, F.length("text"))))
        .otherwise("***")
    )
    return c.select((F.col("conv_id") % 5).alias("book_id"), F.col("conv_id").alias("chapter_idx"), F.col("turn").alias("para_idx"), text.alias("text"), name.alias("speaker"))


DIALOGUE = f"""
    fx2 as (
        select conv_id % 5 as book_id, conv_id as chapter_idx, turn as para_idx, role, text as said, ({sql_list(SPEAKERS)})[conv_id % 12 + 1] as speaker,
               case role when 'user' then '"' || text || '" said ' || ({sql_list(SPEAKERS)})[conv_id % 12 + 1]
                         when 'assistant' then chr(2) || split_part(text, ' ', 1) || chr(3) || substr(text, length(split_part(text, ' ', 1)) + 1) else '***' end as text
        from conversations
    )
"""


def voice_files(spark: SparkSession, sf: str) -> DataFrame:
    """Voice files (voice_ord, stem, source): some names are malformed."""
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    word = F.initcap(F.substring_index("p_name", " ", 1))
    sex = F.when(key % 2 == 0, "M").otherwise("F")
    stem = F.when(key % 13 == 0, word).when(key % 13 == 1, F.concat_ws("-", word, sex)).otherwise(F.concat_ws("-", word, sex, F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.concat(F.lit("P"), key), F.lit("English-North")))
    return p.select(key.alias("voice_ord"), stem.alias("stem"), F.get(strings(("compiled", "builtin", "user")), (key % 3).cast("int")).alias("source"))


VOICES = """
    fx3 as (
        select p_partkey as voice_ord,
               case p_partkey % 13 when 0 then w when 1 then w || '-' || sex
                    else w || '-' || sex || '-' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || '-P' || p_partkey || '-English-North' end as stem,
               ['compiled', 'builtin', 'user'][p_partkey % 3 + 1] as source
        from (select *, upper(substr(p_name, 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) as w, case when p_partkey % 2 = 0 then 'M' else 'F' end as sex from part)
    ),
    voices as (
        select voice_ord, source, split_part(stem, '-', 1) as name, case split_part(stem, '-', 2) when 'M' then 'Male' when 'F' then 'Female' end as gender,
               nullif(split_part(stem, '-', 3), '') as dataset, nullif(split_part(stem, '-', 4), '') as speaker_id, nullif(regexp_extract(stem, '^[^-]*-[^-]*-[^-]*-[^-]*-(.*)$', 1), '') as accent
        from fx3
    )
"""


def characters(spark: SparkSession, sf: str) -> DataFrame:
    """Characters (book_id, character_id, pronoun, prominence, ord): customers of a nation with their number of orders."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("prominence"))
    c = table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(
        F.col("c_nationkey").alias("book_id"), F.col("c_name").alias("character_id"), F.get(strings(PRONOUNS), (F.col("c_custkey") % 4).cast("int")).alias("pronoun"),
        F.coalesce("prominence", F.lit(0)).cast("long").alias("prominence"), F.col("c_custkey").alias("ord"),
    )


CHARACTERS = f"""
    fx4 as (
        select c_nationkey as book_id, c_name as character_id, ({sql_list(PRONOUNS)})[c_custkey % 4 + 1] as pronoun, coalesce(n, 0) as prominence, c_custkey as ord
        from customer left join (select o_custkey, count(*) as n from orders group by o_custkey) on c_custkey = o_custkey
    )
"""


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of jobs (job_id, seq, ts, status, progress, error_message)."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts",
        F.create_map(*[x for k, v in STATUS.items() if v for x in (F.lit(k), F.lit(v))])[F.col("event_type")].alias("status"),
        F.when(F.col("event_type") == "click", F.least(F.abs("value"), F.lit(100.0))).alias("progress"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"),
    )


JOBS = """
    fx5 as (
        select user_id as job_id, event_id as seq, ts,
               case event_type when 'signup' then 'pending' when 'view' then 'processing' when 'purchase' then 'completed' when 'error' then 'failed' end as status,
               case when event_type = 'click' then least(abs(value), 100.0) end as progress, case when event_type = 'error' then props end as error_message
        from events
    ),
    ends as (select job_id, min(seq) as e from fx5 where status in ('completed', 'failed', 'cancelled') group by job_id),
    live as (select fx5.* from fx5 left join ends using (job_id) where e is null or seq <= e),
    state as (
        select job_id, arg_max(status, seq) filter (where status is not null) as status, arg_max(progress, seq) filter (where progress is not null) as progress,
               arg_max(error_message, seq) filter (where error_message is not null) as error_message, min(seq) as first_seq
        from live group by job_id
    )
"""


def names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of one book (book_id, name): two-word part names, their words, and those with a title."""
    p = table(spark, sf, "part").select(F.initcap("p_name").alias("name")).distinct()
    each = F.explode(F.concat(F.array("name"), F.split("name", " "), F.array(F.concat(F.lit("Mr. "), F.substring_index("name", " ", -1)))))
    return p.select(F.lit("parts").alias("book_id"), each.alias("name")).distinct()


_CAP = "upper(substr({0}, 1, 1)) || lower(substr({0}, 2))"
NAMES = f"""
    fx6 as (
        select distinct 'parts' as book_id, unnest([a || ' ' || b, a, b, 'Mr. ' || b]) as name
        from (select distinct {_CAP.format("split_part(p_name, ' ', 1)")} as a, {_CAP.format("split_part(p_name, ' ', 2)")} as b from part)
    )
"""
