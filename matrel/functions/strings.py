"""String expressions of the command-line and file layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compare_no_case(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by upper case."""
    x, y = F.upper(a), F.upper(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def parse_name_values(text: Column) -> Column:
    """Map of a list of name=value, parted by comma, semicolon or space; a bare name is "true"; of a name that comes again
    the last value counts."""
    parts = F.filter(F.split(text, "[,; ]+"), lambda p: p != "")
    pair = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.when(F.instr(p, "=") > 0, F.trim(F.regexp_replace(p, "^[^=]*=", ""))).otherwise(F.lit("true")).alias("v")))
    last = F.filter(pair, lambda p, i: ~F.exists(F.slice(pair, i + 2, F.greatest(F.size(pair), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def true_string(text: Column) -> Column:
    return F.upper(text).isin("TRUE", "YES", "1")


def pad(text: Column, width: int, fill: str = "0") -> Column:
    """Left padding that never cuts."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


def trim_spaces(text: Column) -> Column:
    return F.trim(text)


def replace_all(text: Column, what: str, by: str) -> Column:
    return F.replace(text, F.lit(what), F.lit(by))


def space_out(text: Column) -> Column:
    """A space before a capital that a small letter follows, and after a small letter before a capital."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2"))


def bytes_text(n: Column) -> Column:
    """Steps of 1000, one decimal: 999b, 1.5kB, 2.0MB ..."""
    v = n.cast("double")
    return (
        F.when(v < 1e3, F.concat(n.cast("long").cast("string"), F.lit("b")))
        .when(v < 1e6, F.format_string("%.1fkB", v / 1e3))
        .when(v < 1e9, F.format_string("%.1fMB", v / 1e6))
        .otherwise(F.format_string("%.1fGB", v / 1e9))
    )


def milliseconds_text(ms: Column) -> Column:
    """h:mm:ss.mmm"""
    n = ms.cast("long")
    part = lambda unit, size: F.pmod(F.floor(n / F.lit(unit)), F.lit(size)).cast("long")
    return F.format_string("%d:%02d:%02d.%03d", F.floor(n / F.lit(3_600_000)).cast("long"), part(60_000, 60), part(1000, 60), F.pmod(n, F.lit(1000)).cast("long"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def base_name(path: Column) -> Column:
    return strip_extension(file_name(path))


def replace_extension(path: Column, ext: str) -> Column:
    return F.concat(strip_extension(path), F.lit(ext if ext.startswith(".") else "." + ext))


def strip_end_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "/+$", "")


def file_index(path: Column) -> Column:
    """The number that ends the base name, or -1."""
    return F.coalesce(F.regexp_extract(base_name(path), "([0-9]{1,9})$", 1).try_cast("int"), F.lit(-1))


def parse_vector(text: Column) -> Column:
    """Doubles parted by white space; inf and -inf are read, tokens that are no number give null."""
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""), lambda t: t.try_cast("double"))


def vector_text(x: Column, separator: str = " ") -> Column:
    return F.array_join(F.transform(x, lambda v: v.cast("string")), separator)


def break_text(text: str, width: int, indent: str = "") -> str:
    """Lines of at most width characters; a longer token is cut and ends in three dots."""
    lines, line = [], ""
    for token in text.split():
        if len(token) > width:
            token = token[: max(0, width - 3)] + "..."
        if line and len(line) + 1 + len(token) > width:
            lines.append(line)
            line = token
        else:
            line = f"{line} {token}" if line else token
    return "\n".join(indent + x for x in [*lines, line] if x)
