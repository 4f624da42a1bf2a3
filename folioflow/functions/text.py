"""Markdown, LaTeX and HTML text functions: Column to Column, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What must be recognised and what it becomes.
TYPOS = (("dag", "dagger"), ("ddag", "ddagger"), ("lamba", "lambda"), ("Rho", "rho"), ("Bbb", "mathbb"))
ALIASES = (*TYPOS, ("Epsilon", "epsilon"), ("bf", "mathbf"), ("rm", "mathrm"), ("it", "textit"), ("cal", "mathcal"))
HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{2F800}-\x{2FA1F}"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{200b}-\x{200f}\x{2028}\x{2029}\x{feff}\x{fff0}-\x{ffff}]+"
#: White space as Unicode has it, which trim() alone doesn't.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
IMAGE = r"!\[(.*?)\]\(([^)]+)\)"
CODE = r"`([^`\n]+)`"
MATH = r"(?s)(?<!\\)\$\$(.+?)\$\$|(?<!\\)\$(.+?)\$"
WEIGHTS = {"letter": 0.3, "han": 0.6, "other": 0.25}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def rebuild(text: Column, pattern: str, change) -> Column:
    """text with change(hit) in place of each hit of pattern: gaps and hits are zipped, so no offsets are needed."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.concat(gap, F.coalesce(change(hit), F.lit(""))))
    return F.array_join(parts, "")


def unicode_breaks(text: Column) -> Column:
    for bad, good in (("\u2028", "\n"), ("\u2029", "\n\n"), ("\x0b", "\n")):
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def _commands(text: Column, names) -> Column:
    for old, new in names:
        text = F.regexp_replace(text, rf"\\{old}(?![a-zA-Z])", rf"\\{new}")
    return text


def latex_typos(text: Column) -> Column:
    return _commands(text, TYPOS)


def dollar_spaces(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\$ +", r"\$"), r" +\$", r"\$")


def last_tags(text: Column) -> Column:
    """Of \\tag{...} in a row only the last stays."""
    return F.regexp_replace(text, r"\\tag\s*\{[^}]*\}\s*(?=\\tag\s*\{[^}]*\})", "")


def normalize_markdown(text: Column) -> Column:
    return last_tags(dollar_spaces(latex_typos(unicode_breaks(text))))


def estimate_tokens(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, "[^a-zA-Z]", ""))
    han = F.length(F.regexp_replace(text, f"[^{HAN}]", ""))
    rest = F.length(text) - letters - han
    w = {k: F.lit(v) for k, v in WEIGHTS.items()}
    return (letters * w["letter"] + han * w["han"] + rest * w["other"]).cast("bigint")


def drop_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, "")


def escape_cell(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"(?<!\\)\|", r"\\|"), F.lit("\n"), F.lit("<br>"))


def cell_images(text: Column) -> Column:
    """Markdown images inside <td> as inline <img>."""
    inline = '<img src="$2" style="max-height:40px;display:inline-block;" alt="$1">'
    return rebuild(text, r"(?s)<td[^>]*>.*?</td>", lambda cell: F.regexp_replace(cell, IMAGE, inline))


def drop_unit_spans(text: Column) -> Column:
    """rowspan and colspan of one. The value must end there, so that 10 to 19 stay whole."""
    for name in ("rowspan", "colspan"):
        text = F.regexp_replace(text, rf"(?i)\s*{name}\s*=\s*(?:\"1\"|'1'|1(?![0-9]))", "")
    return text


def is_url(path: Column) -> Column:
    return F.lower(path).rlike("^https?://")


def code_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CODE), F.lit(1))


def mask_code(text: Column) -> Column:
    return rebuild(text, CODE, lambda hit: F.rpad(F.lit(""), F.length(hit), " "))


def math_spans(text: Column) -> Column:
    """Inner texts of formulas, display first, beside code."""
    whole = F.regexp_extract_all(mask_code(text), F.lit(MATH), F.lit(0))
    display = lambda m: m.startswith("$$") & m.endswith("$$") & (F.length(m) > 4)  # noqa: E731  $$x$ is a formula $x
    return F.transform(whole, lambda m: F.when(display(m), F.substr(m, F.lit(3), F.length(m) - 4)).otherwise(F.substr(m, F.lit(2), F.length(m) - 2)))


def canonical_latex(text: Column) -> Column:
    """For comparison: aliases first, then no white space."""
    return F.regexp_replace(_commands(text, ALIASES), SPACE, "")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def first_image(line: Column) -> tuple[Column, Column]:
    """Alternative text and source of the first image; no source: no image."""
    src = F.regexp_extract(line, IMAGE, 2)
    return F.regexp_extract(line, IMAGE, 1), F.when(src != "", src)


def short_name(path: Column) -> Column:
    return F.concat(F.lit("_"), F.substring(F.sha2(path, 256), 1, 12))


def part_name(order: Column, title: Column) -> Column:
    safe = strip(F.regexp_replace(title, r'[\\/:*?"<>|]', "_"))
    return F.concat(F.format_string("%02d", order), F.lit("_"), safe, F.lit(".md"))


def rewrite_assets(text: Column, chapter: Column, suffix: str) -> Column:
    """Links to a chapter's own folder of images, as links to the merged one; both know the chapter as a column."""
    return F.regexp_replace(text, rf"\(([^()\s]*)_ch(\d+){suffix}\.assets/([^()/]+)\)", rf"(\1{suffix}.assets/\2_\3)".replace("\\1", "$1").replace("\\2", "$2").replace("\\3", "$3"))


def clamp_page(page: Column, total: Column) -> Column:
    return F.greatest(F.lit(1), F.least(page, total))


def backoff_seconds(status: Column, retry_after: Column, attempt: Column) -> Column:
    given = retry_after.try_cast("double")
    return F.when(given.isNotNull(), F.greatest(F.lit(0.0), given)).otherwise(F.when(status == 429, 10.0).otherwise(5.0) * F.pow(F.lit(2.0), attempt))


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin("true", "1", "yes"), F.lit(False))
