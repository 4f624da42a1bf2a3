"""Structured inputs derived from the flat test tables, once for Spark and once as SQL for the other engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MD_LINE = """case when ln % 13 = 5 then '# Problems'
  when ln % 17 = 3 then concat('![', case when doc_id % 2 = 0 then 'a' else '' end, '](img', cast(doc_id % 3 as string), '.png)')
  when ln % 17 = 4 then concat('![b](img', cast(doc_id % 3 as string), '.png)')
  when ln % 11 = 7 then ''
  when ln % 19 = 6 then concat('$$x_', cast(ln as string), '$$')
  when ln % 9 = 0 then concat(repeat('#', cast(1 + (doc_id + ln) % 4 as int)), ' ', cast(1 + cast(floor(ln / 27) as bigint) as string), '.',
    cast(1 + (cast(floor(ln / 9) as bigint) * 2) % 3 as string), ' Title')
  when ln % 5 = 1 then concat('`c', cast(ln as string), '` and $v_', cast(ln as string), '$ ', line)
  else line end"""
_OUTLINE = """select o_custkey as doc_id, pos, case when pos % 3 = 0 then 1 else 2 end as level, concat('t', cast(o_orderkey as string)) as title,
  cast(2 + sum(1 + o_orderkey % 40) over (partition by o_custkey order by pos rows between unbounded preceding and current row) as bigint) as page,
  cast(20 + sum(1 + o_orderkey % 40) over (partition by o_custkey) as bigint) as total_pages
  from (select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as bigint) as pos from orders) q"""
_MEMORY = "select conv_id as doc_id, turn as para_index, text as content_en, concat('zh:', text) as content_zh, turn % 2 = 0 as is_done from conversations"
_INCOMING = """select conv_id as doc_id, turn as para_index, case when (conv_id + turn) % 5 = 0 then concat(text, '!') else text end as content_en
  from conversations where (conv_id + turn) % 7 <> 0 union all select conv_id, turn + 100, text from conversations where turn % 3 = 0"""
_PROGRESS = """select user_id as file_id, event_id % 8 as ord, event_id as seq, cast(floor(event_id / 400) as bigint) as run,
  case event_type when 'view' then 'queued' when 'click' then 'parsing' when 'signup' then 'translating' when 'purchase' then 'done' else 'error' end as status from events"""
#: Common words make room for what prose lacks.
_TEX = ((" the ", r" \dag "), (" de ", r" $ x $ \ddag"), (" of ", r"\tag{1} \tag {2}"), (" in ", "\u2028"), (" la ", "\u2029"), (" and ", r"\Rho\Rho "), (" und ", "\x0b\x07"), (" that ", "\u200b|"), (" is ", r"\|||"), (" que ", r"\rm b \it"))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sql(spark: SparkSession, d: str, query: str, name: str) -> DataFrame:
    return spark.sql(query.replace(f"from {name}", f"from {{{name}}}"), **{name: table(spark, d, name)})


def md_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))
    return lines.select("doc_id", "ln", F.expr(_MD_LINE).alias("line"))


def md(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.operators.lines import join_lines

    return join_lines(md_lines(spark, d))


def tex(spark: SparkSession, d: str) -> DataFrame:
    text = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), _TEX, F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.alias("md"))


def outline(spark, d):
    return _sql(spark, d, _OUTLINE, "orders")


def memory(spark, d):
    return _sql(spark, d, _MEMORY, "conversations")


def incoming(spark, d):
    return _sql(spark, d, _INCOMING, "conversations")


def progress(spark, d):
    return _sql(spark, d, _PROGRESS, "events")


LINES_SQL = "lines as (select doc_id, (unnest(generate_series(1, len(string_split(text, chr(10))))) - 1)::int as ln, unnest(string_split(text, chr(10))) as line from documents)"
MD_LINES_SQL = f"{LINES_SQL}, md_lines as (select doc_id, ln, {_MD_LINE} as line from lines)"
MD_SQL = f"{MD_LINES_SQL}, md as (select doc_id, string_agg(line, chr(10) order by ln) as md from md_lines group by doc_id)"
TEX_SQL = f"tex as (select doc_id, {reduce(lambda c, p: f"replace({c}, '{p[0]}', '{p[1]}')", _TEX, 'text')} as md from documents)"
OUTLINE_SQL = f"outline as ({_OUTLINE})"
MEMORY_SQL = f"memory as ({_MEMORY}), incoming as ({_INCOMING})"
PROGRESS_SQL = f"progress as ({_PROGRESS})"
