"""String column functions: pure ``Column -> Column``.

All run JVM-side inside whole-stage codegen.  Character classes are spelled
out (``\\p{L}\\p{N}_`` for a word character, ``[\\t\\n\\x0B\\f\\r ]`` for
whitespace) so that Java regex here and RE2 in the SQL oracle agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\t\n\x0B\f\r "
WS = f"[{SPACE}]"

# Citation URL layout and the quota phrases that stop a fetch run.
CITATION_URL_PREFIX = "https://supreme.justia.com/cases/federal/us/"
QUOTA_PHRASES = [
    "quota",
    "rate limit",
    "too many requests",
    "resource_exhausted",
    "exceeded your current quota",
    "daily limit exceeded",
    "monthly limit exceeded",
]
TRUNCATION_MARKER = "... [content truncated]"
PROMPT_SUFFIX = "\n---\n\nPlease provide the filtered pre-decision content:"


def lit_str(s: str) -> Column:
    return F.lit(s).cast("string")


def strip(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) == "", F.lit(None).cast("string")).otherwise(c)


def citation_to_url(cite: Column, prefix: str = CITATION_URL_PREFIX) -> Column:
    """``329 U.S. 1`` → ``<prefix>329/1/``; anything else (or NULL/'') → NULL."""
    pat = rf"^(\d+){WS}+U\.S\.?{WS}+(\d+)"
    vol = F.regexp_extract(cite, pat, 1)
    page = F.regexp_extract(cite, pat, 2)
    return F.when(cite.isNull() | (vol == ""), F.lit(None).cast("string")).otherwise(
        F.concat(F.lit(prefix), vol, F.lit("/"), page, F.lit("/")))


def sanitize_citation(cite: Column, ext: str = ".txt") -> Column:
    """NULL → ``unknown``; drop characters outside word/space/.-; runs of
    whitespace → ``_``; then the extension."""
    kept = F.regexp_replace(cite, rf"[^{WORD}{SPACE}.\-]", "")
    base = F.regexp_replace(kept, f"{WS}+", "_")
    return F.when(cite.isNull(), F.lit("unknown" + ext)).otherwise(F.concat(base, F.lit(ext)))


def sanitize_case_id(case_id: Column, ext: str = ".txt") -> Column:
    """Each character outside word/-/. becomes ``_``; then the extension."""
    return F.concat(F.regexp_replace(case_id, rf"[^{WORD}\-.]", "_"), F.lit(ext))


def slugify_name(name: Column) -> Column:
    """Drop characters outside word/space/-; strip; runs of - or space → _."""
    s = strip(F.regexp_replace(name, rf"[^{WORD}{SPACE}\-]", ""))
    return F.regexp_replace(s, rf"[\-{SPACE}]+", "_")


def birth_year(birth_death: Column) -> Column:
    """``born (\\d{4})`` when the text says 'born', else ``\\((\\d{4})``."""
    y = F.when(birth_death.contains("born"), F.regexp_extract(birth_death, r"born (\d{4})", 1)) \
        .otherwise(F.regexp_extract(birth_death, r"\((\d{4})", 1))
    return F.when(birth_death.isNull() | (y == ""), F.lit(None).cast("string")).otherwise(y)


def strip_date_notes(s: Column) -> Column:
    """Remove ``(...)`` and ``[...]`` notes with their surrounding space."""
    a = F.regexp_replace(s, rf"{WS}*\([^)]*\){WS}*", "")
    b = F.regexp_replace(a, rf"{WS}*\[[^\]]*\]{WS}*", "")
    return strip(b)


def first_heading_pos(text: Column) -> Column:
    """1-based position of the first ``=== X ===`` line, 0 if none."""
    return F.regexp_instr(text, F.lit(r"(?md)^=== .* ===$"))


def substr_from(text: Column, pos: Column) -> Column:
    """Suffix of ``text`` starting at 1-based ``pos``."""
    return text.substr(pos, F.lit(2147483647))


def drop_intro(text: Column) -> Column:
    """Cut everything before the first ``=== X ===`` line (then strip)."""
    pos = first_heading_pos(text)
    return F.when(pos > 0, strip(substr_from(text, pos))).otherwise(text)

# Heading words that mark the start of the court section.
SECTION_WORDS = ["Supreme Court", "SCOTUS", "Associate Justice", "Chief Justice"]


def section_pos(text: Column) -> Column:
    """1-based start of the earliest heading naming the court, 0 if none."""
    alt = "|".join(w.replace(".", r"\.") for w in SECTION_WORDS)
    return F.regexp_instr(text, F.lit(f"(?id)=== .*(?:{alt}).*==="))


def truncate_at_section(text: Column) -> Column:
    pos = section_pos(text)
    return F.when(pos > 0, strip(text.substr(F.lit(1), pos - 1))).otherwise(text)


def clean_trailing_ws(text: Column) -> Column:
    """Per-line trailing whitespace removed (blank lines collapse), then strip."""
    return strip(F.regexp_replace(text, rf"(?m){WS}+$", ""))


def collapse_blank(text: Column) -> Column:
    """3+ newlines → 2; runs of blanks/tabs → one space."""
    a = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(a, r"[ \t]+", " ")


def word_count(text: Column) -> Column:
    """Whitespace-delimited tokens (Python ``len(s.split())``)."""
    return F.coalesce(F.size(F.filter(F.split(text, f"{WS}+"), lambda t: t != "")), F.lit(0))


def parse_votes(votes: Column) -> Column:
    """``code:vote; code:vote`` → distinct member codes in first-seen order."""
    kept = F.filter(F.split(votes, ";"), lambda p: strip(p) != "")
    return F.array_distinct(F.transform(kept, lambda p: F.split(strip(p), ":").getItem(0)))


def normalize_path(p: Column) -> Column:
    return F.regexp_replace(strip(p), r"\\", "/")


def basename(p: Column) -> Column:
    """Last component after either separator."""
    return F.element_at(F.split(p, r"[/\\]"), -1)


def canonical_base(name: Column) -> Column:
    """Drop ``.txt`` then a trailing ``_vN`` / ``-vN``."""
    return F.regexp_replace(F.regexp_replace(name, r"(?i)\.txt$", ""), r"[_\-]v\d+$", "")


def name_from_file(fname: Column) -> Column:
    return F.replace(F.replace(fname, F.lit(".txt"), F.lit("")), F.lit("_"), F.lit(" "))


def error_class(msg: Column) -> Column:
    """True when the lower-cased message mentions a quota phrase."""
    low = F.lower(msg)
    cond = F.lit(False)
    for p in QUOTA_PHRASES:
        cond = cond | low.contains(p)
    return F.coalesce(cond, F.lit(False))


def split_tenure(tenure: Column) -> Column:
    """``start – end (Status)`` → struct(start, end, status); no dash → ''."""
    parts = F.split(tenure, "–", 2)
    has = F.size(parts) > 1
    start = F.when(has, strip(parts.getItem(0))).otherwise(F.lit(""))
    rest = F.when(has, parts.getItem(1)).otherwise(F.lit(""))
    status = F.regexp_extract(rest, r"\(([^)]*)\)", 1)
    end = strip(F.regexp_replace(rest, r"\([^)]*\)", ""))
    return F.struct(start.alias("tenure_start"), end.alias("tenure_end"), status.alias("tenure_status"))


def truncate_to_budget(text: Column, prompt_len: int, budget: int = 30000, slack: int = 200) -> Column:
    """When prompt + newline + text + request suffix exceed ``budget``, keep
    ``budget - prompt_len - slack`` characters and append the marker."""
    total = F.length(text) + F.lit(prompt_len + 1 + len(PROMPT_SUFFIX))
    keep = budget - prompt_len - slack
    return F.when(total > budget, F.concat(text.substr(F.lit(1), F.lit(keep)), F.lit(TRUNCATION_MARKER))) \
        .otherwise(text)


def year_from_id(case_id: Column) -> Column:
    """``int(id[:4])``; failure → 0."""
    head = strip(F.substring(case_id, 1, 4))
    return F.coalesce(head.try_cast("int"), F.lit(0))


def year_from_text(s: Column) -> Column:
    """First 4-digit run, NULL when none."""
    y = F.regexp_extract(s, r"(\d{4})", 1)
    return F.when(y == "", F.lit(None).cast("int")).otherwise(y.try_cast("int"))


def parse_long_date(s: Column) -> Column:
    """``March 4, 1801`` or ``4 March 1801`` → date, else NULL."""
    return F.coalesce(F.try_to_timestamp(s, F.lit("MMMM d, yyyy")),
                      F.try_to_timestamp(s, F.lit("d MMMM yyyy"))).cast("date")
