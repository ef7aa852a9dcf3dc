"""String columns: names, keys, addresses, dates and their formats. Null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FORM_CATEGORIES

#: Characters that no file name may have.
UNSAFE = ':*?"<>|/\\'


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_file_name(col: Column | str) -> Column:
    """An id as a file name: each unsafe character becomes ``_``."""
    return F.translate(_c(col), UNSAFE, "_" * len(UNSAFE))


def base_name(col: Column | str, most: int = 200) -> Column:
    """A name as a file's base name: unsafe characters as ``_``, single spaces, ``unnamed`` if nothing is left."""
    text = F.trim(F.regexp_replace(safe_file_name(col), r"(?U)\s+", " "))
    return F.left(F.coalesce(F.nullif(text, F.lit("")), F.lit("unnamed")), F.lit(most))


def slug(col: Column | str) -> Column:
    """Runs of other characters than letters, digits, dot, underscore and hyphen as one ``_``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(col), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def without_prefix(col: Column | str, prefixes: list[str]) -> Column:
    """The text without the first of these prefixes that it has."""
    col = _c(col)
    out = col
    for prefix in reversed(prefixes):
        out = F.when(F.startswith(col, F.lit(prefix)), F.substring(col, len(prefix) + 1, 1 << 30)).otherwise(out)
    return out


def reference_label(col: Column | str) -> Column:
    """``V2_short_def`` as ``V2: Short def``; a text without ``_`` stays as it is."""
    col = _c(col)
    rest = F.replace(F.regexp_extract(col, r"^[^_]*_(.*)$", 1), F.lit("_"), F.lit(" "))
    return F.when(F.contains(col, F.lit("_")), F.concat(F.substring_index(col, "_", 1), F.lit(": "), F.upper(F.left(rest, F.lit(1))), F.substring(rest, 2, 1 << 30))).otherwise(col)


def company(col: Column | str) -> Column:
    """Company of a display name: the text before the first `` (``; ``Unknown`` without one."""
    return F.coalesce(F.nullif(F.trim(F.substring_index(_c(col), " (", 1)), F.lit("")), F.lit("Unknown"))


def first_ticker(col: Column | str) -> Column:
    """First group of capitals, digits, hyphens and dots in brackets; ``N/A`` without one."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(col), r"\(([A-Z0-9\-.]+)\)", 1), F.lit("")), F.lit("N/A"))


def strict_name(col: Column | str) -> Column:
    """(company, tickers) of ``Company (T1, T2) (CIK n)``; null for names of another form."""
    form = r"^(.+?)\s*\(([^)]+)\)\s*\(CIK\s+[^)]+\)"
    return F.when(F.rlike(_c(col), F.lit(form)), F.struct(F.trim(F.regexp_extract(_c(col), form, 1)).alias("company"), F.trim(F.regexp_extract(_c(col), form, 2)).alias("tickers")))


def ticker_list(col: Column | str) -> Column:
    """All tickers of a display name as an array; an empty array without any."""
    group = F.regexp_extract(_c(col), r"\(([A-Z,\s-]+)\)\s+\(CIK", 1)
    return F.filter(F.transform(F.split(group, ","), lambda t: F.trim(t)), lambda t: t != "")


def document_urls(ciks: Column | str, adsh: Column | str, name: Column | str, base: str) -> Column:
    """Addresses of a filing's document, one per issuer: base/cik/adsh without hyphens/name."""
    return F.transform(_c(ciks), lambda c: F.concat_ws("/", F.lit(base.rstrip("/")), c, F.replace(_c(adsh), F.lit("-"), F.lit("")), _c(name)))


def file_of_id(col: Column | str) -> Column:
    """The part of an ``adsh:file name`` id after the first colon."""
    return F.substring(_c(col), F.instr(_c(col), ":") + 1, F.length(_c(col)))


def extension(col: Column | str) -> Column:
    """Lower-case extension of a path; empty without one."""
    return F.lower(F.regexp_extract(_c(col), r"\.([^./\\]+)$", 1))


def padded_key(col: Column | str, width: int = 10) -> Column:
    """A number as text with leading zeros."""
    return F.lpad(_c(col).cast("string"), width, "0")


def query_string(pairs: list[tuple[str, Column | str]]) -> Column:
    """``name=value`` pairs joined by ``&``; null and empty values are left out."""
    parts = [F.when(_c(v).isNotNull() & (_c(v).cast("string") != ""), F.concat(F.lit(f"{n}="), F.url_encode(_c(v).cast("string")))) for n, v in pairs]
    return F.concat_ws("&", *parts)


def entity_name(title: Column | str, tickers: Column | str, cik: Column | str) -> Column:
    """``title (T1, T2) (CIK n)``; the ticker group only where there are tickers."""
    group = F.when(F.size(_c(tickers)) > 0, F.concat(F.lit(" ("), F.array_join(_c(tickers), ", "), F.lit(")"))).otherwise("")
    return F.concat(_c(title), group, F.lit(" (CIK "), _c(cik), F.lit(")"))


def range_start(macro: Column | str, to_date: Column | str, otherwise: Column | str | None = None) -> Column:
    """First date of a range ``Ny`` or ``Nd`` before a date (29 February falls on the 28th).

    Another unit after a number gives the date itself; what is no macro leaves ``otherwise`` as it is.
    """
    n = F.regexp_extract(_c(macro), r"^\s*([+-]?\d+).$", 1).try_cast("int")
    unit = F.lower(F.right(_c(macro), F.lit(1)))
    start = F.when(unit == "y", F.add_months(_c(to_date), -12 * n)).when(unit == "d", F.date_sub(_c(to_date), n)).otherwise(_c(to_date))
    return F.when(n.isNotNull(), start).otherwise(F.lit(None).cast("date") if otherwise is None else _c(otherwise).cast("date"))


def duration(seconds: Column | str) -> Column:
    """``h:mm:ss h``."""
    s = F.floor(_c(seconds)).cast("long")
    return F.format_string("%d:%02d:%02d h", F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60)


def duration_words(seconds: Column | str) -> Column:
    """``HHh MMm SSs``."""
    s = F.floor(_c(seconds)).cast("long")
    return F.format_string("%02dh %02dm %02ds", F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60)


def timed_label(name: Column | str, ms: Column | str) -> Column:
    """``name (12.3 ms/ctx)``; the name alone without a time."""
    return F.when(_c(ms).isNotNull(), F.format_string("%s (%.1f ms/ctx)", _c(name), _c(ms).cast("double"))).otherwise(_c(name))


def comma_list(col: Column | str) -> Column:
    """Parts of a comma list, stripped, without empty ones."""
    return F.filter(F.transform(F.split(_c(col), ","), lambda t: F.trim(t)), lambda t: t != "")


def joined(col: Column | str, by: str = "; ") -> Column:
    """An array as one text; null gives an empty text."""
    return F.coalesce(F.array_join(_c(col), by), F.lit(""))


def keyword_combination(col: Column | str, none: str = "[no keywords]") -> Column:
    """Sorted, trimmed keywords as ``['a', 'b']``."""
    keys = F.array_sort(F.transform(_c(col), lambda t: F.trim(t)))
    return F.when(_c(col).isNull() | (F.size(_c(col)) == 0), F.lit(none)).otherwise(F.concat(F.lit("['"), F.array_join(keys, "', '"), F.lit("']")))


def plain_keyword(col: Column) -> Column:
    """A keyword in lower case without quotation marks around it."""
    return F.lower(F.btrim(col, F.lit("\"'")))


def category_code(col: Column | str) -> Column:
    """The code of a group of forms, from its name in any case or from the code itself; the code of all for anything else."""
    by_name = F.create_map(*[F.lit(x) for pair in FORM_CATEGORIES.items() for x in pair])
    given = F.when(_c(col).isin([v for v in FORM_CATEGORIES.values() if v]), _c(col))
    return F.coalesce(F.try_element_at(by_name, F.upper(_c(col))), given, F.lit(FORM_CATEGORIES["ALL"]))


def stable_id(*cols: Column | str) -> Column:
    """SHA-256 of the columns as JSON, the same for the same values."""
    return F.sha2(F.to_json(F.struct(*[_c(c) for c in cols])), 256)


def posix_path(col: Column | str) -> Column:
    return F.replace(_c(col), F.lit("\\"), F.lit("/"))


def summary_line(parts: list[tuple[str, Column | str]], by: str = "  |  ") -> Column:
    """``label: value`` pairs that have a value, joined."""
    return F.concat_ws(by, *[F.when(_c(v).isNotNull() & (_c(v).cast("string") != ""), F.concat(F.lit(f"{n}: "), _c(v).cast("string"))) for n, v in parts])


def compact_options(options: Column | str) -> Column:
    """A string map as sorted ``k`` (for true) or ``k=v`` parts."""
    entries = F.array_sort(F.map_entries(_c(options)))
    return F.array_join(F.transform(entries, lambda e: F.when(F.lower(e["value"]) == "true", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))), ", ")
