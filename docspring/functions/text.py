"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results.
WHITE = r"(?U)[\s\x1c-\x1f]"
FIGURE = r"(?i)\b(figure|fig\.|chart|graph|diagram)\b"
TABLE = r"(?i)\b(table\s+\d+|schedule\s+[ivx\d]|million\b|billion\b|\$\s*[\d,]+)\b"
DOLLARS = r"\$\s*\d"
AMOUNT = r"(?i)\d\s+(million|billion)\b"
PAGE_CLAUSE = r"(?i)\b(?:only\s+)?(?:on\s+)?pages?\s*(\d+)\s*(?:-|–|to)\s*(\d+)\b"
FIGURE_CUE = r"(?<![\p{L}\p{N}])(?:(?:figures?[ :.]|fig[. ])[ \t\r\n:.\-]{0,23}\p{Nd}|(?:figures?|fig)\p{Nd})"
JUDGED = "image|figure|visual|table|combination|multi-modal|multimodal"
LABEL_DROPPED = r"(?U)[^\w\s\-;,./()%+]"
ELLIPSIS, CUT = "…", "...[truncated]"
CRITERIA = ("factual_alignment_with_reference", "completeness_vs_reference", "handling_of_visual_or_numeric_claims", "clarity", "overall")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space (in Unicode's sense) at both ends."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_text(c: Column | str) -> Column:
    """NUL removed, white space collapsed to single spaces, ends stripped."""
    return F.trim(F.regexp_replace(F.replace(col(c), F.lit("\0"), F.lit("")), WHITE + "+", " "))


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores, with repeats, in order."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def strip_page_clause(c: Column | str) -> Column:
    """struct(query, lo, hi): "pages 4-8" and the like removed; lo and hi (1-based, ordered) of the first, else null."""
    c = col(c)
    first, second = (F.regexp_extract(c, PAGE_CLAUSE, k).try_cast("long") for k in (1, 2))
    has = c.rlike(PAGE_CLAUSE)
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(c, PAGE_CLAUSE, " "), WHITE + "+", " "))
    return F.struct(F.when(has, cleaned).otherwise(c).alias("query"), F.when(has, F.least(first, second)).alias("lo"), F.when(has, F.greatest(first, second)).alias("hi"))


def window_step(size: int, overlap: int) -> int:
    return max(size - min(overlap, max(size - 1, 0)), 1)


def windows(c: Column | str, size: int, overlap: int) -> Column:
    """array of struct(start, text): windows of `size` characters, also the tail that lies wholly in the one before.

    The text is cut into pieces of a step in one pass, and a window is put together from those that it covers, so long texts
    aren't counted off from their beginning for each window."""
    c, step = col(c), window_step(size, overlap)
    pieces = F.regexp_extract_all(c, F.lit(f"(?s)(.{{1,{step}}})"), 1)

    def cut(held: Column) -> Column:
        at = F.when(F.size(held) > 0, F.sequence(F.lit(0), F.size(held) - 1)).otherwise(F.array().cast("array<int>"))
        text = lambda i: F.substring(F.array_join(F.slice(held, i + 1, F.lit(-(-size // step))), ""), 1, size)
        return F.transform(at, lambda i: F.struct((i * step).alias("start"), text(i).alias("text")))

    return F.flatten(F.transform(F.array(pieces), cut))  # the pieces as a variable: they are made once


def content_type(c: Column | str, note: Column | str | None = None) -> Column:
    sample = F.substring(col(c), 1, 800)
    noted = F.coalesce(F.contains(F.lower(col(note)), F.lit("table")), F.lit(False)) if note is not None else F.lit(False)
    return F.when(sample.rlike(FIGURE), "figure_ref").when(sample.rlike(TABLE) | noted, "table_dense").when(sample.rlike(DOLLARS) | sample.rlike(AMOUNT), "numeric_heavy").otherwise("narrative")


def section_hint(c: Column | str, most: int = 96) -> Column:
    """The first line that isn't blank, cut with an ellipsis; null if there is none."""
    lines = F.filter(F.transform(F.split(col(c), r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]"), strip), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most - 1), F.lit(ELLIPSIS))).otherwise(first)


def clip(c: Column | str, most: int, nul: bool = True) -> Column:
    """NUL removed, stripped; longer texts end with a mark and are most - 1 characters long."""
    c = strip(F.replace(col(c), F.lit("\0"), F.lit("")) if nul else col(c))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 15), F.lit(CUT))).otherwise(c)


def untrusted(tag: str, c: Column | str, most: int, attribute: str | None = None, value: Column | str | None = None, fallback: str = "field") -> Column:
    """A clipped text between delimiters, so that a model can take it as data."""
    head = F.lit("")
    if attribute:
        safe = F.substring(F.regexp_replace(col(value), r"(?U)[^\w\-]+", "_"), 1, 64)
        head = F.concat(F.lit(f" {attribute}="), F.coalesce(F.nullif(safe, F.lit("")), F.lit(fallback)))
    return F.concat(F.lit(f"<<<{tag}"), head, F.lit(">>>\n"), clip(c, most), F.lit(f"\n<<<END_{tag}"), head, F.lit(">>>"))


def untrusted_layout(role: Column | str, c: Column | str, most: int = 2500) -> Column:
    return untrusted("UNTRUSTED_PDF_LAYOUT_TEXT", c, most, "role", role, "layout")


def untrusted_table(c: Column | str, most: int = 12000) -> Column:
    return untrusted("UNTRUSTED_PDF_TABLE_EXPORT", c, most)


def untrusted_eval(label: Column | str, c: Column | str, most: int) -> Column:
    return untrusted("UNTRUSTED_EVAL_DATA", c, most, "field", label, "field")


def has_figure_cue(*snippets: Column | str) -> Column:
    """A numbered figure is named in the snippets that aren't blank, joined by newlines, within 8000 characters."""
    parts = F.filter(F.array(*(strip(F.coalesce(col(s), F.lit(""))) for s in snippets)), lambda x: x != "")
    return F.lower(F.substring(F.array_join(parts, "\n"), 1, 8000)).rlike(FIGURE_CUE)


def safe_label(c: Column | str, most: int = 120) -> Column:
    """Labels of evaluation rows without characters that could carry instructions; "unknown" if nothing is left."""
    cleaned = strip(F.regexp_replace(col(c), LABEL_DROPPED, ""))
    cut = F.when(F.length(cleaned) > most, F.concat(F.substring(cleaned, 1, most - 15), F.lit(CUT))).otherwise(cleaned)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("unknown"))


def is_judged(c: Column | str) -> Column:
    """Rows about figures, tables and mixtures."""
    return F.lower(safe_label(c)).rlike(JUDGED)


def table_cell(c: Column | str, most: int = 500) -> Column:
    """A Markdown table's cell."""
    s = strip(F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    s = F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 12), F.lit(f"{ELLIPSIS} [truncated]"))).otherwise(s)
    return F.replace(F.replace(s, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def metric_cell(c: Column | str) -> Column:
    """Three decimals, or a dash for what is no number."""
    x = col(c).try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit("—")).otherwise(F.format_string("%.3f", x))


def judge_scores(c: Column | str) -> Column:
    """The five scores (1 to 5) in a judge's answer: its outermost {...}, within a code fence or not; null if any is missing."""
    body = F.regexp_extract(col(c), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, ", ".join(f"{n} string" for n in CRITERIA))
    whole = [F.when(parsed[n].rlike(r"^[1-5](\.0+)?$"), parsed[n].try_cast("double").cast("int")) for n in CRITERIA]
    good = whole[0].isNotNull()
    for x in whole[1:]:
        good = good & x.isNotNull()
    return F.when(good, F.struct(*(x.alias(n) for x, n in zip(whole, CRITERIA, strict=True))))
