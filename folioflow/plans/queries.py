"""One query an operator, and the same in SQL for an engine of another make."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import blocks as B
from folioflow.operators import images, integrity, lines, memory, outline
from folioflow.operators.chunking import chunks
from folioflow.operators.tables import tables_to_markdown
from folioflow.plans import config, inputs, pipeline
from folioflow.plans.inputs import MD_LINES_SQL, MD_SQL, MEMORY_SQL, OUTLINE_SQL, PROGRESS_SQL, TEX_SQL, table
from folioflow.plans.translate import echo
from folioflow.sources import files
from folioflow.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _big(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))


# --- text ---

_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _p1(x: str) -> str:
    return f"replace(replace(replace({x}, '\u2028', chr(10)), '\u2029', chr(10) || chr(10)), chr(11), chr(10))"


def _names(x: str, names) -> str:
    for a, b in names:
        for _ in range(2):
            x = rf"regexp_replace({x}, '\\{a}([^a-zA-Z]|$)', '\\{b}\1', 'g')"
    return x


def _p3(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\$ +', '$', 'g'), ' +\$', '$', 'g')"


def _p4(x: str) -> str:
    return rf"regexp_replace({x}, '(\\tag\s*\{{[^}}]*\}}\s*)+(\\tag\s*\{{[^}}]*\}})', '\2', 'g')"


def _tokens(x: str) -> str:
    letters, han = f"length(regexp_replace({x}, '[^a-zA-Z]', '', 'g'))", f"length(regexp_replace({x}, '[^{T.HAN}]', '', 'g'))"
    return f"trunc({letters} * 0.3::double + {han} * 0.6::double + (length({x}) - {letters} - {han}) * 0.25::double)::bigint"


def _on_tex(name: str, f, expr: str) -> None:
    query(name, f"with {TEX_SQL} select doc_id, {expr} as md from tex")(lambda s, d: inputs.tex(s, d).select("doc_id", f(F.col("md")).alias("md")))


_on_tex("p1_unicode_breaks", T.unicode_breaks, _p1("md"))
_on_tex("p2_latex_typos", T.latex_typos, _names("md", T.TYPOS))
_on_tex("p3_dollar_spaces", T.dollar_spaces, _p3("md"))
_on_tex("p4_last_tags", T.last_tags, _p4("md"))
_on_tex("p5_normalize", T.normalize_markdown, _p4(_p3(_names(_p1("md"), T.TYPOS))))
_on_tex("p7_control_chars", T.drop_controls, f"regexp_replace(md, '{T.CONTROLS}', '', 'g')")
_on_tex("p9_escape_cell", T.escape_cell, "replace(" + r"regexp_replace(regexp_replace(md, '(^|[^\\])\|', '\1\\|', 'g'), '(^|[^\\])\|', '\1\\|', 'g')" + ", chr(10), '<br>')")
_on_tex("p19_canonical_latex", T.canonical_latex, f"regexp_replace({_names('md', T.ALIASES)}, '{_WS}', '', 'g')")
_on_tex("p28_html_escape", T.html_escape, "replace(replace(replace(replace(md, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>')")


@query("p6_tokens", f"select lang, count(*) as docs, sum({_tokens('text')})::bigint as tokens from documents group by lang")
def _(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))


_IMG_SQL = r"'!\[(.*?)\]\(([^)]+)\)'"


@query("p10_cell_images", f"with {MD_LINES_SQL} select doc_id, ln::bigint as ln, '<td>' || regexp_replace(line, {_IMG_SQL}, " + r"""'<img src="\2" style="max-height:40px;display:inline-block;" alt="\1">', 'g') || '</td>' as line from md_lines""")
def _(s, d):
    cells = inputs.md_lines(s, d).withColumn("line", F.concat(F.lit("<td>"), "line", F.lit("</td>")))
    return _big(cells.select("doc_id", "ln", T.cell_images(F.col("line")).alias("line")))


_CELL = "concat('<td rowspan=\"1\" colspan=', cast(n_nationkey as string), ' COLSPAN=1>', n_name, '</td><td rowspan=\"1', cast(n_regionkey as string), '\">')"


@query("p11_unit_spans", "select n_nationkey::bigint as n_nationkey, " + r"""regexp_replace(regexp_replace(""" + _CELL + r""", '(?i)\s*rowspan\s*=\s*(?:"1"|''1''|1\b)', '', 'g'), '(?i)\s*colspan\s*=\s*(?:"1"|''1''|1\b)', '', 'g') as cell from nation""")
def _(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), T.drop_unit_spans(F.expr(_CELL)).alias("cell"))


@query(
    "p12_tables",
    """with r as (select n_regionkey, string_agg('| ' || n_name || ' | ' || cast(n_nationkey as string) || ' |', chr(10) order by n_nationkey) as rows from nation group by n_regionkey)
select n_regionkey::bigint as n_regionkey, 'x' || chr(10) || case when n_regionkey % 2 = 0 then '| R | R |' else '| R |  |' end || chr(10) || '| --- | --- |' || chr(10) || rows || chr(10) || 'y' as md from r""",
)
def _(s, d):
    row = F.concat(F.lit("<tr><td>"), "n_name", F.lit(" </td><TD>"), F.col("n_nationkey").cast("string"), F.lit("</td></tr>"))
    rows = B.join_ordered(table(s, d, "nation").withColumn("row", row), ["n_regionkey"], "n_nationkey", "row", "rows", "\n")
    head = F.when(F.col("n_regionkey") % 2 == 0, '<table border="1"><tr><th colspan="2">R</th></tr>').otherwise("<table><tr><td>R</td></tr>")
    return rows.select(F.col("n_regionkey").cast("bigint").alias("n_regionkey"), tables_to_markdown(F.concat(F.lit("x\n"), head, "rows", F.lit("</table>\ny"))).alias("md"))


@query("p13_post_process")
def _(s, d):
    return pipeline.post_process(inputs.md(s, d))


@query("p14_is_url", "select page_id, regexp_matches(lower(url), '^https?://') as is_url from pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", T.is_url(F.col("url")).alias("is_url"))


_PARTS = f"list_filter(list_transform(string_split_regex({_strip('md')}, '\\n{{2,}}'), lambda p: {_strip('p')}), lambda p: p <> '')"
_CLOSE = "strpos(substr(p, 3), '$$')"
_ONE = "[struct_pack(kind := {k}, content := {c})]"
_BLOCKS_SQL = f"""{MD_SQL}, cut as (select doc_id, flatten(list_transform({_PARTS}, lambda p:
  case when not starts_with(p, '$$') then {_ONE.format(k="'text'", c="p")}
  when {_CLOSE} > 0 and {_strip(f"substr(p, {_CLOSE} + 4)")} <> '' then
    [struct_pack(kind := 'latex', content := regexp_replace(substr(p, 1, {_CLOSE} + 3), '{_WS}+$', '')), struct_pack(kind := 'text', content := {_strip(f"substr(p, {_CLOSE} + 4)")})]
  else {_ONE.format(k="'latex'", c="p")} end)) as b from md),
  blocks as (select doc_id, unnest(generate_series(0, len(b) - 1))::bigint as idx, unnest(b).kind as type, unnest(b).content as content from cut)"""


def _blocks(s, d):
    return _big(B.split_blocks(inputs.md(s, d)))


query("p15_blocks", f"with {_BLOCKS_SQL} select doc_id, idx, type, content from blocks")(_blocks)
_CODE_RE = "'`([^`\\n]+)`'"
_MASK = f"array_to_string(list_transform(generate_series(1, len(string_split_regex(md, {_CODE_RE}))), lambda i: string_split_regex(md, {_CODE_RE})[i] || coalesce(repeat(' ', len(regexp_extract_all(md, {_CODE_RE})[i])), '')), '')"


@query("p16_code_spans", f"with {MD_SQL} select doc_id, array_to_string(regexp_extract_all(md, {_CODE_RE}, 1), '|') as spans from md")
def _(s, d):
    return inputs.md(s, d).select("doc_id", F.array_join(T.code_spans(F.col("md")), "|").alias("spans"))


@query("p17_mask", f"with {MD_SQL} select doc_id, {_MASK} as md from md")
def _(s, d):
    return inputs.md(s, d).select("doc_id", T.mask_code(F.col("md")).alias("md"))


def _spans_sql(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '(?s)\\$\\$.+?\\$\\$|\\$.+?\\$'), lambda m: case when starts_with(m, '$$') and ends_with(m, '$$') and len(m) > 4 then substr(m, 3, len(m) - 4) else substr(m, 2, len(m) - 2) end)"


@query("p18_math_spans", f"with {MD_SQL} select doc_id, array_to_string({_spans_sql(_MASK)}, '|') as spans from md")
def _(s, d):
    return inputs.md(s, d).select("doc_id", F.array_join(T.math_spans(F.col("md")), "|").alias("spans"))


def _pairs(s, d):
    en = inputs.md(s, d).withColumnRenamed("md", "en")
    return en.withColumn("zh", F.when(F.col("doc_id") % 4 == 0, F.replace("en", F.lit("$v_"), F.lit("$w_"))).otherwise(F.col("en")))




def _bare(x: str) -> str:
    return f"regexp_replace({x}, '{_WS}', '', 'g')"


_MASKED = f"masked as (select doc_id, {_MASK} as en from md)"


@query(
    "p20_warnings",
    f"with {MD_SQL}, {_MASKED}, spans as (select doc_id, {_spans_sql('en')} as x, {_spans_sql("case when doc_id % 4 = 0 then replace(en, '$v_', '$w_') else en end")} as y from masked) "
    f"select doc_id, (len(list_filter(generate_series(1, least(len(x), len(y))), lambda i: {_bare('x[i]')} <> {_bare('y[i]')})) + (len(x) <> len(y))::int)::bigint as warnings from spans",
)
def _(s, d):
    return _pairs(s, d).select("doc_id", F.size(integrity.warnings(F.col("en"), F.col("zh"))).cast("bigint").alias("warnings"))


def _broken(text):
    """Other code and formulas, display ones too, where doc_id is a multiple of 4: a repair brings all of the source back."""
    bad = F.col(text)
    for a, b in (("$v_", "$w_"), ("`c", "`k"), ("$$x_", "$$y_")):
        bad = F.replace(bad, F.lit(a), F.lit(b))
    return F.when(F.col("doc_id") % 4 == 0, bad).otherwise(F.col(text))


@query("p20_repair", f"with {MD_LINES_SQL} select doc_id, ln::bigint as ln, line from md_lines")
def _(s, d):
    return _big(inputs.md_lines(s, d).select("doc_id", "ln", integrity.repair(F.col("line"), _broken("line")).alias("line")))


@query("p20_repair_documents")
def _(s, d):
    """Whole documents; prose may hold lone dollars, so that SQL can't say which spans pair."""
    return inputs.md(s, d).select("doc_id", integrity.repair(F.col("md"), _broken("md")).alias("md"))


def _entries(s, d):
    rows = inputs.md_lines(s, d).where(T.strip(F.col("line")) != "")
    return rows.select("doc_id", F.col("ln").cast("bigint").alias("idx"), "line", F.col("line").alias("content"))


_ENTRIES_SQL = f"{MD_LINES_SQL}, entries as (select doc_id, ln::bigint as idx, line as content from md_lines where {_strip('line')} <> '')"


@query("p21_encode", f"with {_ENTRIES_SQL} select doc_id, string_agg('[BLK:' || idx || ']' || chr(10) || content, chr(10) || chr(10) order by idx) as raw from entries group by doc_id")
def _(s, d):
    return B.encode_markers(_entries(s, d), ["doc_id"])


@query("p22_decode", f"with {_ENTRIES_SQL} select doc_id, idx, {_strip('content')} as zh from entries where idx % 10 <> 0")
def _(s, d):
    """Markers of every tenth line are lost, others come twice."""
    sent = _entries(s, d)
    twice = sent.where("idx % 10 = 5").select("doc_id", (F.col("idx") + 100_000).alias("k"), "idx", F.lit("again").alias("content"))
    rows = sent.where("idx % 10 <> 0").select("doc_id", F.col("idx").alias("k"), "idx", "content").unionByName(twice)
    rows = rows.withColumn("m", F.concat(F.lit("[BLK:"), F.col("idx").cast("string"), F.lit("]\n"), "content"))
    return B.decode_markers(B.join_ordered(rows, ["doc_id"], "k", "m", "raw"), ["doc_id"])


_ERROR = ("case o_orderkey % 3 when 0 then 429 when 1 then 500 end as status", "case when o_orderkey % 5 = 0 then '3' when o_orderkey % 7 = 0 then 'soon' when o_orderkey % 11 = 0 then '-2' end as retry_after", "o_orderkey % 4 as attempt")


@query("p23_backoff", f"select o_orderkey, case when try_cast(retry_after as double) is not null then greatest(0.0::double, try_cast(retry_after as double)) else case when status = 429 then 10.0::double else 5.0::double end * pow(2.0::double, attempt) end as seconds from (select o_orderkey, {', '.join(_ERROR)} from orders)")
def _(s, d):
    rows = table(s, d, "orders").selectExpr("o_orderkey", *_ERROR)
    return rows.select("o_orderkey", T.backoff_seconds(F.col("status"), F.col("retry_after"), F.col("attempt")).alias("seconds"))


@query("p24_page_clamp", f"with {OUTLINE_SQL} select doc_id, pos, greatest(1, least(page, total_pages - 30)) as page from outline")
def _(s, d):
    return inputs.outline(s, d).select("doc_id", "pos", T.clamp_page(F.col("page"), F.col("total_pages") - 30).alias("page"))


_LINK = "concat('see ![a](book_ch', cast(o_custkey % 12 as string), '_zh.assets/image-', cast(o_orderkey as string), '.png) (x_ch.assets/y)')"


@query("p25_asset_paths", f"select o_orderkey, regexp_replace({_LINK}, " + r"'\(([^()\s]*)_ch(\d+)_zh\.assets/([^()/]+)\)', '(\1_zh.assets/\2_\3)', 'g') as md from orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", T.rewrite_assets(F.expr(_LINK), F.col("o_custkey"), "_zh").alias("md"))


@query("p26_short_name", "select page_id, '_' || substr(sha256(url), 1, 12) as doc_id from pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", T.short_name(F.col("url")).alias("doc_id"))


@query(
    "p27_config",
    """select * from (values ('translate.max_tokens', '65536'), ('translate.temperature', '0.3'), ('translate.thinking', 'true'), ('translate.effort', '"high"'), ('parse.backend', '"hybrid"'),
('parse.effort', '"medium"'), ('parse.timeout', '90'), ('chunk.target_tokens', '30000'), ('chunk.max_paragraphs', '200'), ('chunk.min_retention', '0.95'), ('run.parallel', 'false'), ('run.workers', '64'),
('run.parsers', '1'), ('run.max_chapter_pages', '100'), ('run.integrity', 'true')) t(name, value)""",
)
def _(s, d):
    return config.flat(s, config.load('{"run": {"parallel": false, "unknown": 1}, "more": {}, "parse": {"timeout": 90}, "translate": {"thinking": true}}'))


@query("p29_first_image", f"with {MD_LINES_SQL} select doc_id, ln::bigint as ln, regexp_extract(line, {_IMG_SQL}, 1) as alt, nullif(regexp_extract(line, {_IMG_SQL}, 2), '') as src from md_lines")
def _(s, d):
    alt, src = T.first_image(F.col("line"))
    return _big(inputs.md_lines(s, d).select("doc_id", "ln", alt.alias("alt"), src.alias("src")))


# --- filters and aggregates over blocks ---


@query("f1_translatable", f"with {_BLOCKS_SQL} select doc_id, idx, content from blocks where type = 'text'")
def _(s, d):
    return B.translatable(_blocks(s, d)).select("doc_id", "idx", "content")


@query("f7_local_images", f"with {MD_LINES_SQL} select doc_id, ln::bigint as ln from md_lines where regexp_extract(line, {_IMG_SQL}, 2) <> '' and not regexp_matches(lower(regexp_extract(line, {_IMG_SQL}, 2)), '^https?://')")
def _(s, d):
    _, src = T.first_image(F.col("line"))
    return _big(inputs.md_lines(s, d).where(src.isNotNull() & ~T.is_url(src)).select("doc_id", "ln"))


_HEAD_SQL = r"'^(#{1,6})\s+(\d+(?:\.\w+)*)(?:\s|$)'"


@query("f8_headings", f"with {MD_LINES_SQL} select doc_id, ln::bigint as ln, regexp_extract(line, {_HEAD_SQL}, 2) as number, regexp_matches(line, '(?i)problem|exercise|reference|bibliography|appendix') as closes from md_lines where regexp_matches(line, '^#')")
def _(s, d):
    return _big(inputs.md_lines(s, d).where(F.col("line").startswith("#")).select("doc_id", "ln", F.regexp_extract("line", lines.HEADING, 2).alias("number"), F.col("line").rlike(lines.KEYWORDS).alias("closes")))


@query("f10_suffix", "select page_id from pages where lower(url) like '%.pdf' or lower(url) like '%1'")
def _(s, d):
    return table(s, d, "pages").where(F.lower("url").like("%.pdf") | F.lower("url").like("%1")).select("page_id")


@query("a1_pending_size", f"with {MEMORY_SQL}, t as (select doc_id, string_agg(content_en, chr(10) || chr(10) order by para_index) as t, sum(length(content_en))::bigint as chars from memory where not is_done group by doc_id) select doc_id, chars, {_tokens('t')} as tokens from t")
def _(s, d):
    rows = memory.pending(inputs.memory(s, d))
    both = B.join_ordered(rows, ["doc_id"], "para_index", "content_en", "t").withColumn("tokens", T.estimate_tokens(F.col("t"))).drop("t")
    return rows.groupBy("doc_id").agg(F.sum(F.length("content_en")).alias("chars")).join(both, "doc_id")


@query("a2_block_counts", f"with {_BLOCKS_SQL} select doc_id, count(*) filter (type = 'text') as n_text, count(*) filter (type = 'latex') as n_latex from blocks group by doc_id")
def _(s, d):
    return _blocks(s, d).groupBy("doc_id").agg(F.count_if(F.col("type") == "text").alias("n_text"), F.count_if(F.col("type") == "latex").alias("n_latex"))


@query("a3_merge", f"with {_BLOCKS_SQL} select doc_id, string_agg(content, chr(10) || chr(10) order by idx) as md from blocks group by doc_id")
def _(s, d):
    return B.join_ordered(_blocks(s, d), ["doc_id"], "idx", "content", "md")


@query("a4_retention", f"with {MEMORY_SQL} select doc_id, (count(*) filter (is_done))::double / count(*) as retention from memory group by doc_id")
def _(s, d):
    return inputs.memory(s, d).groupBy("doc_id").agg((F.count_if("is_done") / F.count("*")).alias("retention"))


@query("a5_failures", f"with {PROGRESS_SQL}, r as (select *, sum((status <> 'error')::int) over (partition by file_id, ord order by seq) as g from progress) select file_id, ord, (max_by(c, seq))::bigint as failures from (select file_id, ord, seq, sum((status = 'error')::int) over (partition by file_id, ord, g order by seq) as c from r) group by file_id, ord")
def _(s, d):
    """Failures in a row at the end of each part's log."""
    w = Window.partitionBy("file_id", "ord").orderBy("seq")
    runs = inputs.progress(s, d).withColumn("g", F.sum((F.col("status") != "error").cast("int")).over(w))
    last = runs.groupBy("file_id", "ord").agg(F.max("g").alias("g"))
    return runs.join(last, ["file_id", "ord", "g"]).groupBy("file_id", "ord").agg(F.count_if(F.col("status") == "error").alias("failures"))


@query("a6_distinct_images", f"with {MD_LINES_SQL}, i as (select doc_id, min(ln) as first, regexp_extract(line, {_IMG_SQL}, 2) as name from md_lines where regexp_extract(line, {_IMG_SQL}, 2) <> '' group by all) select doc_id, name, row_number() over (partition by doc_id order by first) as number, 'image-' || row_number() over (partition by doc_id order by first) || '.png' as new_name from i")
def _(s, d):
    return images.references(inputs.md(s, d))


@query("a9_outline_depth", f"with {OUTLINE_SQL} select doc_id, max(level)::bigint as depth, count(*) as marks from outline group by doc_id")
def _(s, d):
    return inputs.outline(s, d).groupBy("doc_id").agg(F.max("level").cast("bigint").alias("depth"), F.count("*").alias("marks"))


@query("a11_summary", f"with {PROGRESS_SQL} select count(*) filter (status = 'error') as failed, count(*) as total from progress")
def _(s, d):
    return inputs.progress(s, d).agg(F.count_if(F.col("status") == "error").alias("failed"), F.count("*").alias("total"))


# --- translation memory ---


def _state(name: str, f, sql: str) -> None:
    query(name, f"with {MEMORY_SQL} {sql}")(lambda s, d: f(inputs.memory(s, d), inputs.incoming(s, d)))


_ALL = "doc_id, para_index"
_state(
    "m2_upsert",
    memory.upsert,
    f"select {_ALL}, case when i.doc_id is null then m.content_en else i.content_en end as content_en, content_zh, case when i.doc_id is null then is_done else coalesce(is_done and m.content_en = i.content_en, false) end as is_done from memory m full join incoming i using ({_ALL})",
)
_state("m3_prune", memory.prune, f"select * from memory m where exists (select 1 from incoming i where i.doc_id = m.doc_id and i.para_index = m.para_index)")
_state("m2_m3_align", memory.align, f"select {_ALL}, i.content_en, content_zh, coalesce(is_done and m.content_en = i.content_en, false) as is_done from incoming i left join memory m using ({_ALL})")
_state("m4_pending", lambda m, i: memory.pending(m), f"select {_ALL}, content_en from memory where not is_done")
_state("m6_mark_done", lambda m, i: memory.mark_done(m, i.select(*memory.KEY, F.concat(F.lit("new:"), "content_en").alias("zh"))), f"select {_ALL}, m.content_en, coalesce('new:' || i.content_en, content_zh) as content_zh, is_done or i.doc_id is not null as is_done from memory m left join incoming i using ({_ALL})")
_state("m5_mark_one", lambda m, i: memory.mark_done(m, i.where("doc_id = 1 and para_index = 1").select(*memory.KEY, F.lit("z").alias("zh"))), f"select {_ALL}, content_en, case when hit then 'z' else content_zh end as content_zh, is_done or hit as is_done from (select *, doc_id = 1 and para_index = 1 and exists (select 1 from incoming where doc_id = 1 and para_index = 1) as hit from memory)")
_state("m7_lookup", lambda m, i: memory.translations(m).where("doc_id = 2 and para_index = 0"), f"select {_ALL}, content_zh as zh from memory where is_done and doc_id = 2 and para_index = 0")
_state("m8_translations", lambda m, i: memory.translations(m), f"select {_ALL}, content_zh as zh from memory where is_done")
_state("m9_all_done", lambda m, i: memory.all_done(m), "select doc_id, count(*) filter (not is_done) = 0 as all_done from memory group by doc_id")
_state("m10_reset", memory.reset, f"select {_ALL}, content_en, content_zh, is_done and not exists (select 1 from incoming i where i.doc_id = m.doc_id and i.para_index = m.para_index) as is_done from memory m")
_state("m11_clear", lambda m, i: memory.clear(m), "select * from memory where false")


def _translated(s, d):
    return _blocks(s, d).where("type = 'text' and idx % 3 <> 0").select("doc_id", "idx", F.concat(F.lit("zh:"), "content").alias("zh"))


_TRANSLATED = f"{_BLOCKS_SQL}, translated as (select doc_id, idx, 'zh:' || content as zh from blocks where type = 'text' and idx % 3 <> 0)"


@query("j1_assemble", f"with {_TRANSLATED} select doc_id, idx, content as en, case when type = 'latex' then content else coalesce(zh, content) end as zh from blocks left join translated using (doc_id, idx)")
def _(s, d):
    return B.assemble(_blocks(s, d), _translated(s, d))


@query("j2_missing", f"with {_TRANSLATED} select doc_id, idx from blocks b where type = 'text' and not exists (select 1 from translated t where t.doc_id = b.doc_id and t.idx = b.idx)")
def _(s, d):
    return B.missing(B.translatable(_blocks(s, d)), _translated(s, d)).select("doc_id", "idx")


@query("j6_image_files", f"with {MD_LINES_SQL}, r as (select distinct doc_id, regexp_extract(line, {_IMG_SQL}, 2) as name from md_lines where regexp_extract(line, {_IMG_SQL}, 2) <> '') select doc_id, name, case name when 'img0.png' then '/z/img0.png' when 'img1.png' then '/b/img1.png' end as path from r")
def _(s, d):
    found = s.createDataFrame([("/a/img0.png",), ("/z/img0.png",), ("/b/img1.png",), ("/b/other.png",)], "path string")
    return images.match_files(images.references(inputs.md(s, d)), found).select("doc_id", "name", "path")


@query("j9_fresh_wins", f"with {MEMORY_SQL} select {_ALL}, coalesce(i.content_en, m.content_zh) as zh from (select * from memory where is_done) m full join incoming i using ({_ALL})")
def _(s, d):
    fresh = inputs.incoming(s, d).select(*memory.KEY, F.col("content_en").alias("fresh"))
    return memory.translations(inputs.memory(s, d)).join(fresh, memory.KEY, "full_outer").select(*memory.KEY, F.coalesce("fresh", "zh").alias("zh"))


@query("j10_to_parse", "select doc_id from documents where not exists (select 1 from pages where page_id = doc_id)")
def _(s, d):
    return files.to_parse(table(s, d, "documents").select("doc_id"), table(s, d, "pages").select(F.col("page_id").alias("doc_id")))


# --- ordered state ---

def _headings_sql(chapter: str, back: str, open_: str) -> str:
    return f"""{MD_LINES_SQL},
h1 as (select *, nullif(regexp_extract(line, {_HEAD_SQL}, 2), '') as number, regexp_extract(line, '^(#{{1,6}})\\s', 1) as hashes,
  regexp_extract(line, '^#{{1,6}}\\s+(\\S.*)', 1) as title from md_lines),
h2 as (select *, regexp_matches(number, '^\\d+(\\.\\d+)*$') as digits, len(string_split(number, '.')) as depth,
  try_cast(string_split(number, '.')[1] as bigint) as first,
  case when regexp_matches(number, '^\\d+(\\.\\d+)*$') then list_transform(string_split(number, '.'), lambda p: cast(p as bigint)) end as parts from h1),
h3 as (select *, {chapter} as chapter from h2),
h4 as (select *, {back} as back, number is null and title <> '' and regexp_matches(title, '(?i)problem|exercise|reference|bibliography|appendix') and {open_} as keyword from h3),
h5 as (select *, coalesce(max(case when keyword or (number is not null and not digits and not back) then 1 else 0 end) over w, 0) = 1 as closed,
  max(case when not back then parts end) over w as most from h4 window w as (partition by doc_id, chapter order by ln rows between unbounded preceding and 1 preceding)),
h6 as (select *, coalesce(digits and parts <= most, false) as falls from h5),
headed as (select doc_id, ln::bigint as ln, case when number is not null and (back or closed or falls) then regexp_replace(line, '^#+\\s*', '') when number is not null then repeat('#', depth::int) || substr(line, length(hashes) + 1) else line end as line,
  keyword or (number is not null and not back and not closed and (not digits or falls)) as warned from h6)"""


_SERIAL = _headings_sql("max(first) over (partition by doc_id order by ln rows between unbounded preceding and current row)", "coalesce(first < chapter, false)", "chapter is not null")
_SINGLE = _headings_sql("0", "false", "true")


def _headed(s, d, chapters):
    rows = lines.repair_headings(inputs.md_lines(s, d), chapters)
    return _big(rows.select("doc_id", "ln", "line", F.col("warning").isNotNull().alias("warned")))


query("w1_headings", f"with {_SERIAL} select * from headed")(lambda s, d: _headed(s, d, True))
query("w2_chapter_headings", f"with {_SINGLE} select * from headed")(lambda s, d: _headed(s, d, False))


@query(
    "a10_chapter_warnings",
    f"""with {_SINGLE} select source as doc_id, doc_id * 1000000 + ln::bigint as ord, '[T' || doc_id || '] ' || case when keyword then 'chapter ends: ' || {_strip('title')}
 when not digits then 'not a plain number, chapter ends: ' || number else 'number falls back, now text: ' || number end as warning
 from h6 join documents using (doc_id) where keyword or (number is not null and not closed and (not digits or falls))""",
)
def _(s, d):
    """Documents as chapters of their source."""
    found = lines.repair_headings(inputs.md_lines(s, d), chapters=False).where("warning is not null")
    names = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"))
    return pipeline.chapter_warnings(found.select(F.col("doc_id").cast("string").alias("key"), F.col("ln").alias("ord"), "warning"), names)


@query("a10_warnings", f"with {_SERIAL} select doc_id, count(*) as warnings from headed where warned group by doc_id")
def _(s, d):
    return _headed(s, d, True).where("warned").groupBy("doc_id").agg(F.count("*").alias("warnings"))


_CHAPTERS_SQL = f"""{OUTLINE_SQL}, marks as (select *, greatest(1, least(page, total_pages)) - 1 as page0 from outline where level = 1),
chapters as (select doc_id, -1::bigint as ord, 'front matter' as title, 0::bigint as start0, min_by(page0, pos) - 1 as end0 from marks group by doc_id having min_by(page0, pos) > 0
 union all select doc_id, pos, title, page0, coalesce(lead(page0) over (partition by doc_id order by pos) - 1, total_pages - 1) from marks),
ranges as (select * from chapters where start0 <= end0)"""


def _ranges(s, d):
    return outline.chapter_ranges(inputs.outline(s, d))


query("w3_chapters", f"with {_CHAPTERS_SQL} select * from ranges")(_ranges)
query("f6_splittable", f"with {_CHAPTERS_SQL} select r.* from ranges r where (select count(*) from ranges q where q.doc_id = r.doc_id) >= 2")(lambda s, d: outline.splittable(_ranges(s, d)))
_SUBS_SQL = f"{_CHAPTERS_SQL}, subs as (select r.*, o.pos, o.title as mark, o.page - 1 as page0 from ranges r join outline o on o.doc_id = r.doc_id and o.level = 2 and o.page - 1 between r.start0 and r.end0)"


@query("j5_sub_marks", f"with {_SUBS_SQL} select doc_id, ord, pos, mark, page0 from subs")
def _(s, d):
    return outline.sub_marks(_ranges(s, d), inputs.outline(s, d)).select("doc_id", "ord", "pos", "mark", "page0")


@query(
    "w4_sub_chapters",
    f"""with {_SUBS_SQL}, big as (select *, count(*) over c as n, row_number() over (c order by page0, pos) as sub, lead(page0) over (c order by page0, pos) as next from subs where end0 - start0 + 1 > 40 window c as (partition by doc_id, ord)),
cut as (select doc_id, ord, sub, title || ' — ' || mark as title, case when sub = 1 then start0 else page0 end as start0, coalesce(next - 1, end0) as end0 from big where n >= 2)
select doc_id, ord, 0::bigint as sub, title, start0, end0 from ranges r where not exists (select 1 from cut c where c.doc_id = r.doc_id and c.ord = r.ord) union all select * from cut where start0 <= end0""",
)
def _(s, d):
    return outline.split_large(_ranges(s, d), inputs.outline(s, d), 40)


@query(
    "w5_image_dedup",
    f"""with {MD_LINES_SQL}, i as (select doc_id, ln, line, regexp_extract(line, {_IMG_SQL}, 1) as alt, nullif(regexp_extract(line, {_IMG_SQL}, 2), '') as src from md_lines where {_strip('line')} <> ''),
g as (select *, coalesce(src = lag(src) over (partition by doc_id order by ln), false) as again from i),
n as (select *, sum((not again)::int) over (partition by doc_id order by ln) as island from g),
k as (select doc_id, min(ln)::bigint as ln, first(line order by (alt = '')::int, ln) as line from n group by doc_id, island)
select doc_id, ln, line from k union all select doc_id, ln::bigint, line from md_lines where {_strip('line')} = ''""",
)
def _(s, d):
    return _big(lines.dedup_images(inputs.md_lines(s, d)))


query("w4_unsplit", f"with {_CHAPTERS_SQL} select doc_id, ord, 0::bigint as sub, title, start0, end0 from ranges")(lambda s, d: outline.split_large(_ranges(s, d), inputs.outline(s, d), 0))

#: Several images a document, as Markdown and as HTML, some below folders, some alike in name, some on the web.
_IMAGE_LINE = """case when ln % 7 = 2 then concat('<img alt="z" src="pic', cast(ln % 5 as string), '.jpg">') when ln % 7 = 3 then concat('![u](https://e.org/', cast(ln as string), '.png)')
 when ln % 7 = 4 then concat('![c', cast(ln as string), '](sub/pic', cast(ln % 3 as string), '.jpg)') when ln % 7 = 5 then concat('![](p.', cast(doc_id % 4 as string), '.png)') else replace(line, '![', '') end"""
_NAME_SQL = r"""regexp_extract(regexp_extract(line, '^!\[.*?\]\(([^)]+)\)$', 1) || regexp_extract(line, '^<img alt="z" src="([^"]+)">$', 1), '([^/]+)$', 1)"""
_IMAGES_SQL = f"""{MD_LINES_SQL}, il as (select doc_id, ln, {_IMAGE_LINE} as line from md_lines), io as (select *, case when not contains(line, '://') then nullif({_NAME_SQL}, '') end as name from il),
ir as (select doc_id, name, row_number() over (partition by doc_id order by min(ln)) as number from io where name is not null group by doc_id, name),
renumbered as (select doc_id, ln, case when name is null then line else '![' || regexp_extract(line, '^!\\[(.*?)\\]', 1) || '](book.assets/image-' || number || regexp_extract(name, '[^.](\\.[^.]+)$', 1) || ')' end as line from io left join ir using (doc_id, name))"""


def _image_md(s, d):
    return lines.join_lines(inputs.md_lines(s, d).withColumn("line", F.expr(_IMAGE_LINE)))


@query("w6_many_images", f"with {_IMAGES_SQL} select doc_id, string_agg(line, chr(10) order by ln) as md from renumbered group by doc_id")
def _(s, d):
    return _image_md(s, d).select("doc_id", images.renumber(F.col("md"), "book.assets").alias("md"))


@query("a6_many_images", f"with {_IMAGES_SQL} select doc_id, name, number, 'image-' || number || regexp_extract(name, '[^.](\\.[^.]+)$', 1) as new_name from ir")
def _(s, d):
    return images.references(_image_md(s, d))


@query("w6_image_renumber", f"with {MD_SQL} select doc_id, regexp_replace(md, '!\\[(.*?)\\]\\(img\\d\\.png\\)', '![\\1](book.assets/image-1.png)', 'g') as md from md")
def _(s, d):
    return inputs.md(s, d).select("doc_id", images.renumber(F.col("md"), "book.assets").alias("md"))


_PREFIX_SQL = " or ".join(f"starts_with(l, '{p}')" for p in lines.BLOCK_PREFIXES)
_SOFT = f"""{MD_LINES_SQL}, f0 as (select doc_id, ln, case when ln % 23 = 8 then '$$' when ln % 29 = 10 then '```' else line end as line from md_lines),
s1 as (select *, {_strip('line')} as s, regexp_replace(line, '^{_WS}+', '') as l from f0),
s2 as (select *, starts_with(s, '```') or coalesce(sum(starts_with(s, '```')::int) over (partition by doc_id order by ln rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as code from s1),
s3 as (select *, (not code and s = '$$')::int as flip, case when not code and s <> '$$' and (starts_with(s, '$$') or ends_with(s, '$$')) then (not ends_with(s, '$$'))::int end as fix from s2),
s4 as (select *, sum(flip) over (partition by doc_id order by ln) as flips from s3),
s5 as (select *, last_value(case when fix is not null then struct_pack(a := fix, b := flips) end ignore nulls) over (partition by doc_id order by ln rows between unbounded preceding and 1 preceding) as p, coalesce(lag(flips) over (partition by doc_id order by ln), 0) as before from s4),
s6 as (select *, not code and not ((coalesce(p.a, 0) + before - coalesce(p.b, 0)) % 2 = 1) and not (l = '' or {_PREFIX_SQL}) as plain from s5),
s7 as (select *, plain and coalesce(lag(plain) over (partition by doc_id order by ln), false) and regexp_matches(regexp_replace(lag(line) over (partition by doc_id order by ln), '{_WS}+$', ''), '[\\p{{L}}\\p{{N}}_]$') as joins from s6),
s8 as (select *, sum((not coalesce(joins, false))::int) over (partition by doc_id order by ln) as island from s7)"""


@query("p8_soft_wraps", f"with {_SOFT} select doc_id, island::bigint as ln, string_agg(line, ' ' order by ln) as line from s8 group by doc_id, island")
def _(s, d):
    rows = inputs.md_lines(s, d).withColumn("line", F.when(F.col("ln") % 23 == 8, "$$").when(F.col("ln") % 29 == 10, "```").otherwise(F.col("line")))
    return _big(lines.merge_soft_wraps(rows))


def _packed(s, d):
    rows = table(s, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("idx"), F.col("text").alias("content"))
    return chunks(rows, 2000, 10)


query("w7_chunks")(_packed)


@query("w7_invariants", f"select source as doc_id, count(*) as paragraphs, 0::bigint as repeated, true as ordered, true as small, sum({_tokens('text')})::bigint as tokens from documents group by source")
def _(s, d):
    """Each paragraph once, in order, in chunks of no more than ten."""
    rows = _packed(s, d)
    per = rows.groupBy("doc_id", "chunk_no").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.count_distinct("idx").alias("kinds"))
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    per = per.withColumn("ok", F.coalesce(F.lag("hi").over(w) < F.col("lo"), F.lit(True)))
    return per.groupBy("doc_id").agg(F.sum("n").alias("paragraphs"), F.sum(F.col("n") - F.col("kinds")).alias("repeated"), F.bool_and("ok").alias("ordered"), F.bool_and(F.col("n") <= 10).alias("small"), F.sum("tokens").alias("tokens"))


@query("w8_log_ring", f"with {MD_LINES_SQL} select doc_id, ln::bigint as ln, line from md_lines qualify row_number() over (partition by doc_id order by ln desc) <= 20")
def _(s, d):
    return _big(lines.tail(inputs.md_lines(s, d), 20))


@query("s7_log_tail", f"with {MD_LINES_SQL} select doc_id, ln::bigint as ln, line from md_lines qualify row_number() over (partition by doc_id order by ln desc) <= 40")
def _(s, d):
    return _big(lines.tail(inputs.md_lines(s, d)))


@query("s8_truthy", "select conv_id, turn, lower(role) in ('true', '1', 'yes', 'user') as v from conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", (T.truthy(F.col("role")) | (F.lower("role") == "user")).alias("v"))


@query("s9_json_config", "select event_id, case when event_id % 2 = 0 then '8' else '64' end as workers from events")
def _(s, d):
    given = F.from_json(F.when(F.col("event_id") % 2 == 0, F.lit('{"run": {"workers": "8"}}')).otherwise("not json"), "run map<string,string>")
    merged = config.with_defaults(F.coalesce(given["run"], F.create_map().cast("map<string,string>")), F.create_map(F.lit("workers"), F.lit("64")))
    return table(s, d, "events").select("event_id", merged["workers"].alias("workers"))


@query("t2_mark_order", f"with {OUTLINE_SQL} select doc_id, title, row_number() over (partition by doc_id order by page, pos) as n from outline where level = 2")
def _(s, d):
    w = Window.partitionBy("doc_id").orderBy("page", "pos")
    return inputs.outline(s, d).where("level = 2").select("doc_id", "title", F.row_number().over(w).cast("bigint").alias("n"))


@query("t5_first_path", "select n_regionkey::bigint as n_regionkey, min(n_name) as path from nation group by n_regionkey")
def _(s, d):
    return table(s, d, "nation").groupBy(F.col("n_regionkey").cast("bigint").alias("n_regionkey")).agg(F.min("n_name").alias("path"))


@query("u3_file_list", "select distinct url from pages")
def _(s, d):
    return table(s, d, "pages").select("url").dropDuplicates(["url"])


# --- translation ---


@query("x2_request", f"with {_ENTRIES_SQL} select doc_id, idx, {_strip('content')} as source, 'zh:' || {_strip('content')} as zh from entries")
def _(s, d):
    from folioflow.plans.translate import call

    sent = _entries(s, d)
    answers = B.decode_markers(call(B.encode_markers(sent, ["doc_id"]), echo, ["doc_id"]), ["doc_id"])
    return sent.join(answers, ["doc_id", "idx"]).select("doc_id", "idx", T.strip(F.col("content")).alias("source"), "zh")


@query("x4_blank", "select conv_id, turn, case when turn % 3 = 0 then ' ' else 'zh:' || text end as zh, (turn % 3 <> 0)::int::bigint as attempts from conversations")
def _(s, d):
    """Blank texts are never sent."""
    from folioflow.plans.translate import call

    asked = table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("text")).alias("raw"))
    return _big(call(asked, lambda raw: f"zh:{raw}", ["conv_id", "turn"]).select("conv_id", "turn", F.col("raw").alias("zh"), "attempts"))


@query("x1_retries", "select o_orderkey, case when o_orderkey % 5 < 3 then 'zh:' || o_orderkey end as raw, case when o_orderkey % 5 >= 3 then 'ValueError()' end as error, least(o_orderkey % 5 + 1, 3)::bigint as attempts from orders")
def _(s, d):
    """A service that fails a request's first calls, up to four: three tries bring the others home."""
    from folioflow.plans.translate import Settings, call

    class Stubborn:
        def __init__(self):
            self.calls = {}

        def __call__(self, raw):
            self.calls[raw] = self.calls.get(raw, 0) + 1
            if self.calls[raw] <= int(raw) % 5:
                raise ValueError
            return f"zh:{raw}"

    asked = table(s, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("raw"))
    return _big(call(asked, Stubborn(), ["o_orderkey"], Settings(patience=0)))


@query("x5_translate", f"with {MEMORY_SQL} select {_ALL}, case when is_done then content_zh else 'zh:' || {_strip('content_en')} end as zh from memory")
def _(s, d):
    from folioflow.plans.translate import translate

    done, _ = translate(inputs.memory(s, d), echo, _work(s))
    return memory.translations(done)


def _work(s: SparkSession) -> str:
    """Below the folder that driver and executors share."""
    import uuid

    base = s.conf.get("spark.checkpoint.dir", None)
    if not base:
        if s.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/folioflow"
    return f"{base.rstrip('/')}/translate-{uuid.uuid4().hex}"


@query("x10_pipeline")
def _(s, d):
    return pipeline.run(inputs.md(s, d), _work(s))["zh"]


@query("x8_parse_only", f"with {MD_SQL}, r as (select doc_id, regexp_replace(md, '!\\[(.*?)\\]\\(img\\d\\.png\\)', '![\\1](images.assets/image-1.png)', 'g') as md from md) select doc_id, {_p4(_p3(_names(_p1('md'), T.TYPOS)))} as md from r")
def _(s, d):
    return pipeline.parsed_only(inputs.md(s, d), "images.assets")


def _parts(s, d):
    """Documents as chapters of their source; some have no text."""
    rows = inputs.md(s, d).join(table(s, d, "documents").select("doc_id", "source"), "doc_id")
    broken = F.col("doc_id") % 50 == 7
    return rows.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.when(~broken, F.col("md")).alias("md"), F.when(broken, "no text").alias("error"))


@query("x7_chapters")
def _(s, d):
    return pipeline.run_chapters(_parts(s, d), _work(s))["zh"]


@query("x7_failures", "select source as doc_id, doc_id as ord, 'chapter' as kind, 'T' || doc_id as name, 'no text' as error from documents where doc_id % 50 = 7")
def _(s, d):
    return pipeline.run_chapters(_parts(s, d), _work(s))["failures"]


@query("x1_failed_requests", f"with {_ENTRIES_SQL} select doc_id, case when doc_id % 3 = 0 then 'ValueError()' end as error from entries group by doc_id")
def _(s, d):
    from folioflow.plans.translate import call

    def sometimes(raw: str) -> str:
        if raw.startswith("0"):
            raise ValueError
        return raw

    asked = _entries(s, d).select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 3).cast("string").alias("raw"))
    return call(asked, sometimes, ["doc_id"]).select("doc_id", "error")


@query("x3_fallback", f"with {_ENTRIES_SQL} select doc_id, idx, 'zh:' || content as zh from entries where idx % 10 = 0")
def _(s, d):
    """Single requests for the paragraphs whose markers were lost."""
    from folioflow.plans.translate import call

    entries = _entries(s, d)
    lost = B.missing(entries, entries.where("idx % 10 <> 0"))
    return call(lost.select("doc_id", "idx", F.col("content").alias("raw")), echo, ["doc_id", "idx"]).select("doc_id", "idx", F.col("raw").alias("zh"))


@query("s1_discover")
def _(s, d):
    return files.discover(s, d, "*.parquet").select("relative", "doc_id", "length")


@query("s2_outlines")
def _(s, d):
    def reader(content: bytes):
        return len(content), [(1, "a", 1), (2, "b", 2)]

    return files.outlines(files.discover(s, d, "*.parquet"), reader)


_SIZE_SQL = "octet_length(encode(html))"


@query("s2_page_counts", f"select page_id::varchar as doc_id, case when {_SIZE_SQL} % 7 = 0 then 0 else {_SIZE_SQL} // 100 end as total_pages, (case when {_SIZE_SQL} % 7 = 0 then 0 else {_SIZE_SQL} % 3 end)::bigint as marks from pages")
def _(s, d):
    """Documents without an outline, and ones that can't be read, among others."""

    def reader(content: bytes):
        if len(content) % 7 == 0:
            raise ValueError
        return len(content) // 100, [(1, "a", 1)] * (len(content) % 3)

    rows = table(s, d, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.col("html").cast("binary").alias("content"))
    return files.outlined(rows, reader).select("doc_id", "total_pages", F.size("marks").cast("bigint").alias("marks"))


@query("s3_parse_pages", f"select page_id::varchar as doc_id, case when {_SIZE_SQL} % 7 <> 0 then length(html) || ':' || substr(html, 1, 20) end as md, case when {_SIZE_SQL} % 7 = 0 then 'ValueError(''no text'')' end as error from pages")
def _(s, d):
    """A failure is a row."""

    def parser(content: bytes) -> str:
        if len(content) % 7 == 0:
            raise ValueError("no text")
        text = content.decode()
        return f"{len(text)}:{text[:20]}"

    rows = table(s, d, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.col("html").cast("binary").alias("content"))
    return files.parse(rows, parser).select("doc_id", "md", "error")


@query("s3_parse")
def _(s, d):
    def parser(content: bytes) -> str:
        return f"{len(content)} bytes"

    return files.parse(files.discover(s, d, "*.parquet"), parser).select("doc_id", "md", "error")


# --- progress ---


@query("f9_progress_lines", f"with {PROGRESS_SQL} select file_id, ord::bigint as ord, seq, run, status from progress where seq % 5 <> 0 and seq % 7 <> 0")
def _(s, d):
    events = inputs.progress(s, d).withColumn("title", F.lit("t"))
    rows = progress.encode(events.where("seq % 5 <> 0 and seq % 7 <> 0"))
    others = events.where("seq % 5 = 0 or seq % 7 = 0").select(F.when(F.col("seq") % 5 == 0, "plain log line").otherwise(progress.PREFIX + "{broken").alias("value"))
    return _big(progress.parse(rows.unionByName(others)).drop("title"))


_LATEST = f"{PROGRESS_SQL}, latest as (select file_id, ord, max_by(status, seq) as status, max(seq) as seq from progress group by file_id, ord)"
_ROLL = "case when bool_or(status in ('translating', 'parsing')) then 'working' when bool_or(status = 'queued') then 'queued' when bool_or(status = 'error') then 'partial' else 'done' end"
query("r3_latest_status", f"with {_LATEST} select * from latest")(lambda s, d: progress.latest(inputs.progress(s, d)))
query("r4_file_status", f"with {_LATEST} select file_id, {_ROLL} as status from latest group by file_id")(lambda s, d: progress.roll_up(progress.latest(inputs.progress(s, d))))
query("a7_roll_up", f"with {PROGRESS_SQL} select file_id, {_ROLL} as status from progress group by file_id")(lambda s, d: progress.roll_up(inputs.progress(s, d)))
query("r6_current_run", f"with {PROGRESS_SQL} select * from progress p where run = (select max(run) from progress q where q.file_id = p.file_id)")(lambda s, d: progress.current_run(inputs.progress(s, d)))
query("r7_with_queued", f"with {PROGRESS_SQL} select file_id, ord, seq, status from progress union all select distinct file_id, ord, -1, 'queued' from progress")(lambda s, d: progress.with_queued(inputs.progress(s, d)))


@query("a8_finished", f"with {_LATEST}, p as (select file_id, bool_or(status = 'error') as failed from latest where file_id % 3 <> 0 group by file_id), o as (select file_id, max_by(status, seq) as status from progress group by file_id) select file_id, case when status = 'done' and coalesce(failed, false) then 'partial' when failed is not null and status in ('parsing', 'translating') then 'working' else status end as status from o left join p using (file_id)")
def _(s, d):
    events = inputs.progress(s, d)
    return progress.finished(progress.latest(events.where("file_id % 3 <> 0")), events.groupBy("file_id").agg(F.max_by("status", "seq").alias("status")))


# --- reports and names ---

_TITLE = "concat(' ', o_orderpriority, '/a:b*c?\"<', cast(o_orderkey as string), '>|\\ ')"


@query("k2_part_names", "select o_orderkey, case when o_custkey < 10 then '0' else '' end || o_custkey || '_' || trim(regexp_replace(" + _TITLE + r""", '[\\/:*?"<>|]', '_', 'g')) || '.md' as name from orders""")
def _(s, d):
    title = F.concat(F.lit(" "), "o_orderpriority", F.lit('/a:b*c?"<'), F.col("o_orderkey").cast("string"), F.lit(">|\\ "))
    return table(s, d, "orders").select("o_orderkey", T.part_name(F.col("o_custkey"), title).alias("name"))


@query("k3_warning_report", f"with {MEMORY_SQL} select doc_id, doc_id || '_warnings.md' as name, '# Heading warnings: ' || doc_id || chr(10) || chr(10) || string_agg('- ' || content_en, chr(10) order by para_index) || chr(10) as md from memory where not is_done group by doc_id")
def _(s, d):
    return files.warning_report(memory.pending(inputs.memory(s, d)).select("doc_id", F.col("para_index").alias("ord"), F.col("content_en").alias("warning")))


@query("k4_failure_report", f"with {PROGRESS_SQL} select file_id as doc_id, file_id || '_failed.md' as name, '# Failures: ' || file_id || chr(10) || chr(10) || string_agg('- [' || coalesce(case when seq % 2 = 0 then 'chapter' end, 'unknown') || '] ' || coalesce(case when seq % 3 = 0 then status end, file_id::varchar) || ': ' || coalesce(case when seq % 5 = 0 then 'late' end, 'unknown error'), chr(10) order by seq) || chr(10) as md from progress where status = 'error' group by file_id")
def _(s, d):
    rows = inputs.progress(s, d).where("status = 'error'")
    some = lambda n, v: F.when(F.col("seq") % n == 0, v)
    return files.failure_report(rows.select(F.col("file_id").alias("doc_id"), F.col("seq").alias("ord"), some(2, F.lit("chapter")).alias("kind"), some(3, F.col("status")).alias("name"), some(5, F.lit("late")).alias("error")))


@query("flagship_blocks", f"with {_BLOCKS_SQL}, n as (select doc_id, type, {_tokens('content')} as tokens from blocks) select lang, count(*) filter (type = 'text') as n_text, count(*) filter (type = 'latex') as n_latex, sum(tokens)::bigint as tokens from n join documents using (doc_id) group by lang")
def flagship(s: SparkSession, d: str) -> DataFrame:
    """Blocks of each kind and their tokens by language."""
    lang = table(s, d, "documents").select("doc_id", "lang")
    rows = _blocks(s, d).withColumn("tokens", T.estimate_tokens(F.col("content"))).join(lang, "doc_id")
    return rows.groupBy("lang").agg(F.count_if(F.col("type") == "text").alias("n_text"), F.count_if(F.col("type") == "latex").alias("n_latex"), F.sum("tokens").alias("tokens"))
