"""Text functions: strip, line split, language, paths, keys, times, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seclake.fixed_values import (
    EXTENSION_LANGUAGE,
    LANGUAGE_SNIFF_CHARS,
    LINE_BREAK,
    OTHER_EMOJI,
    RARE_BREAKS,
    SCANNED_EXTENSIONS,
    SEVERITY_EMOJI,
    WHITESPACE,
)
from seclake.functions.lookup import look_up, quoted


def strip(text: Column) -> Column:
    """Remove all Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def lines_text(text: str) -> str:
    """SQL text that breaks ``text`` at every line boundary, with no empty last line."""
    # Most text breaks at newlines only, and a one-character split needs no pattern.
    rare = " OR ".join(f"contains({text}, {quoted(c)})" for c in RARE_BREAKS)
    parts = (
        f"CASE WHEN {rare} THEN split({text}, {quoted(LINE_BREAK)}, -1) "
        f"ELSE split({text}, '\\n', -1) END")
    # A one-element transform binds the parts, so that the text is split once.
    return (
        f"element_at(transform(array({parts}), parts -> CASE WHEN element_at(parts, -1) = '' "
        "THEN slice(parts, 1, size(parts) - 1) ELSE parts END), 1)")


def split_lines(column: str = "text") -> Column:
    """Lines of a text column, without an empty last line."""
    return F.expr(lines_text(column))


def language_by_content(text: Column) -> Column:
    """Language sniffed from the first characters of the stripped text (F1)."""
    head = F.substring(strip(text), 1, LANGUAGE_SNIFF_CHARS)
    return (
        F.when(head.contains("#include") | head.contains("int main("), "cpp")
        .when(head.contains("const ") | head.contains("let "), "javascript")
        .otherwise("python")
    )


def extension(path: Column) -> Column:
    """Last ``.suffix`` of the base name; leading dots start no suffix."""
    return F.regexp_extract(path, r"(?:^|/)\.*[^/.][^/]*(\.[^./]*)$", 1)


def language_by_path(path: Column) -> Column:
    """Language from the lower-cased extension (F2)."""
    return look_up(EXTENSION_LANGUAGE, extension(F.lower(path)), "unknown")


def is_scanned_path(path: Column) -> Column:
    """Case-sensitive suffix test for repository scans."""
    first, *rest = [path.endswith(suffix) for suffix in SCANNED_EXTENSIONS]
    for test in rest:
        first = first | test
    return first


def normal_path(path: Column) -> Column:
    """Forward slashes, null as empty text."""
    return F.translate(F.coalesce(path, F.lit("")), "\\", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def secure_name(path: Column) -> Column:
    """Base name with ``_secure`` put before the extension."""
    name, ext = base_name(path), extension(path)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.concat(stem, F.lit("_secure"), ext)


def report_key(path: Column, at: Column) -> Column:
    """``security_report_<base name>_<time>``, dots turned to underscores."""
    return F.concat(
        F.lit("security_report_"),
        F.translate(base_name(path), ".", "_"),
        F.lit("_"),
        F.date_format(at, "yyyyMMdd_HHmmss"),
    )


def owasp_prefix(category: Column) -> Column:
    """Text before the first `` - `` (F8)."""
    return F.substring_index(category, " - ", 1)


def prefixed_category(path: Column, category: Column) -> Column:
    """``[file] category``."""
    return F.concat(F.lit("["), base_name(path), F.lit("] "), category)


def iso_text(at: Column) -> Column:
    """UTC time as ISO-8601 text ending in Z."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def micros_of_iso(text: Column) -> Column:
    """Microseconds since 1970 of ISO text with suffix Z or an offset; null if bad."""
    return F.unix_micros(text.try_cast("timestamp"))


def stable_id(*keys: Column) -> Column:
    """Id made from the keys, so that a rerun gives the same id.

    The keys are written as a JSON list: their borders and nulls can't be mistaken.
    """
    return F.sha2(F.to_json(F.array(*[k.cast("string") for k in keys])), 256)


def change_line(severity: Column, category: Column, line: Column, advice: Column) -> Column:
    """One change-log line of a finding."""
    return F.concat(
        look_up(SEVERITY_EMOJI, severity, OTHER_EMOJI),
        F.lit(" ["), severity, F.lit("] "), category,
        F.lit(" (line "), line.cast("string"), F.lit("): "), advice,
    )


def message(template: str, *values: Column) -> Column:
    """Fill the ``%s`` places of a fixed text (F16)."""
    return F.format_string(template, *[v.cast("string") for v in values])


def camel(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(part.title() for part in tail)


def camel_case(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """snake_case columns to camelCase (P1). ``rename`` overrides single names."""
    names = rename or {}
    return df.select([F.col(c).alias(names.get(c, camel(c))) for c in df.columns])
