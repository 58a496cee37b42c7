"""Named Column builders: the closed vocabulary of transforms and casts, and the normalisations of feed values.

Nothing raises on a value: what cannot be read becomes null, and callers decide what a null means.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a text editor sees it: ASCII controls, separators and the Unicode spaces.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: What sources write for "nothing", for yes and for no.
NULL_TOKENS = ("", "NULL", "NONE", "N/A", "NA", "NAN", "#N/A", "-", "UNKNOWN")
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
#: Date words of the two mask styles, and the four formats a cast tries.
STRPTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM"}
MASKS = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH24": "HH", "MI": "mm", "SS": "ss"}
CAST_FORMATS = ("yyyy-M-d", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "M-d-yyyy")


def trim(c: Column) -> Column:
    """Without white space at either end; values without any are passed through."""
    return F.when(c.rlike(f"^{SPACE}|{SPACE}$"), F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")).otherwise(c)


def blank(c: Column) -> Column:
    """Missing, or nothing but white space."""
    return c.isNull() | ~c.rlike(SPACE.replace("[", "[^", 1))


def concat(c: Column, with_: str) -> Column:
    return F.concat(c, F.lit(with_))


def concat_columns(separator: str, *columns: Column) -> Column:
    return F.concat_ws(separator, *columns)


def substring(c: Column, start: int, length: int | None = None) -> Column:
    """From a start counted from 0. Negative starts and lengths are refused."""
    if start < 0 or (length is not None and length < 0):
        raise ValueError("substring takes no negative start or length")
    return F.substring(c, start + 1, 1 << 30 if length is None else length)


def date_pattern(fmt: str) -> str:
    """The Java pattern of an strptime format or a mask. Numbers beside a separator may lack their leading zero, as
    strptime has it; adjoining numbers keep their width."""
    words = STRPTIME if "%" in fmt else MASKS
    tokens = re.findall("|".join(sorted(words, key=len, reverse=True)) + "|.", fmt)
    if not any(t in words for t in tokens):
        raise ValueError(f"no date field in {fmt!r}")
    out = []
    for i, t in enumerate(tokens):
        beside = (i and tokens[i - 1] in words) or (i + 1 < len(tokens) and tokens[i + 1] in words)
        word = words.get(t)
        if word is None:
            if "%" in fmt and t == "%":
                raise ValueError(f"unknown field in {fmt!r}")
            out.append(f"'{t}'" if t.isalpha() else t)
        else:
            out.append(word[0] if len(word) == 2 and word not in ("yy",) and not beside else word)
    return "".join(out)


def parse_date(c: Column, fmt: str) -> Column:
    """An ISO date (text) by exactly one format, or null."""
    pattern = date_pattern(fmt)
    return F.date_format(F.when(c.rlike(text_shape(pattern)), F.try_to_timestamp(c, F.lit(pattern))), "yyyy-MM-dd")


def text_shape(pattern: str) -> str:
    """What a text must look like before a parser is asked: a failed parse costs a hundred times a failed match."""
    one = {"yyyy": r"\d{4}", "yy": r"\d\d", "MMMM": r"\p{L}+", "MMM": r"\p{L}+"} | {x: r"\d\d" for x in ("MM", "dd", "HH", "mm", "ss")} | {x: r"\d\d?" for x in "MdHms"}
    parts = re.findall(r"'[^']*'|yyyy|yy|MMMM|MMM|MM|dd|HH|mm|ss|.", pattern)
    return "^" + "".join(one.get(p) or re.escape(p.strip("'")) for p in parts) + "$"


def cast_int(c: Column) -> Column:
    """A whole number within 64 bits, as text; ``4.2`` and larger numbers are null."""
    return F.when(trim(c).rlike(r"^[+-]?\d+$"), trim(c).try_cast("long").cast("string"))


def cast_decimal(c: Column) -> Column:
    plain = trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(plain & trim(c).try_cast("decimal(38,10)").isNotNull(), trim(c))


def cast_bool(c: Column) -> Column:
    word = F.lower(trim(c))
    return F.when(word.isin(*TRUE_WORDS), "true").when(word.isin(*FALSE_WORDS), "false")


def cast_moment(c: Column) -> Column:
    """A timestamp by the first of CAST_FORMATS that fits; slashes read as dashes. ``YYYYMMDD`` is not among them."""
    plain = F.regexp_replace(trim(c), "/", "-")
    first, *rest = [F.when(plain.rlike(text_shape(f)), F.try_to_timestamp(plain, F.lit(f))) for f in CAST_FORMATS]
    return F.coalesce(first, *rest)


def cast_date(c: Column) -> Column:
    return F.date_format(cast_moment(c), "yyyy-MM-dd")


def cast_timestamp(c: Column) -> Column:
    return F.date_format(cast_moment(c), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


CASTS = {"string": lambda c: c, "int": cast_int, "int64": cast_int, "decimal": cast_decimal, "bool": cast_bool, "date": cast_date, "timestamp": cast_timestamp}
#: Transform name: its builder and the arguments it must and may have.
TRANSFORMS = {
    "trim": (trim, (), ()),
    "upper": (F.upper, (), ()),
    "lower": (F.lower, (), ()),
    "concat": (lambda c, **a: concat(c, a["with"]), ("with",), ()),
    "substring": (lambda c, start, length=None: substring(c, int(start), None if length is None else int(length)), ("start",), ("length",)),
    "parse_date": (lambda c, format: parse_date(c, format), ("format",), ()),  # noqa: A002
}


def null_tokens(c: Column) -> Column:
    """Blanks and the words for nothing become null."""
    return F.when(F.upper(trim(c)).isin(*NULL_TOKENS), None).otherwise(c)


def unquoted(c: Column) -> Column:
    """Without the quotes that wrap the whole value."""
    return F.regexp_replace(trim(c), r"^(['\"])(.*)\1$", "$2")


def split_name(c: Column) -> Column:
    """``LAST, FIRST`` at the first comma; without one ``FIRST LAST`` at the last space. A struct (first, last)."""
    comma, text = c.contains(","), trim(c)
    first = F.when(comma, trim(F.element_at(F.split(c, ",", 2), 2))).otherwise(F.regexp_extract(text, r"^(.*?)(?:\s+\S+)?$", 1))
    last = F.when(comma, trim(F.element_at(F.split(c, ",", 2), 1))).otherwise(F.regexp_extract(text, r"\s(\S+)$", 1))
    return F.struct(first.alias("first"), F.nullif(last, F.lit("")).alias("last"))


def flag(c: Column) -> Column:
    """Yes and no as a boolean; blank is null, not false."""
    return F.when(blank(c), None).otherwise(cast_bool(c) == "true")


def any_date(c: Column) -> Column:
    """A timestamp from the shape of its text: 8, 12, 14 or 17 digits, ISO, or month first; a bare year is its first day."""
    text = trim(c)
    digits = F.when(text.rlike(r"^\d+$"), F.length(text))
    millis = F.concat(F.substring(text, 1, 14), F.lit("."), F.substring(text, 15, 3))
    read = lambda t, f: F.try_to_timestamp(t, F.lit(f))
    return (
        F.when(digits == 4, read(F.concat(text, F.lit("0101")), "yyyyMMdd")).when(digits == 8, read(text, "yyyyMMdd"))
        .when(digits == 12, read(text, "yyyyMMddHHmm")).when(digits == 14, read(text, "yyyyMMddHHmmss"))
        .when(digits == 17, read(millis, "yyyyMMddHHmmss.SSS")).otherwise(F.coalesce(cast_moment(text), read(text, "M/d/yyyy H:m")))
    )


def without_sentinel(d: Column, today: Column | None = None) -> Column:
    """Dates before 1900 or beyond next year are placeholders."""
    this = F.year(today if today is not None else F.current_date())
    return F.when((F.year(d) <= 1900) | (F.year(d) > this + 1), None).otherwise(d)


def icd(c: Column) -> Column:
    return F.translate(F.upper(trim(c)), ".", "")


def ndc11(c: Column) -> Column:
    """Eleven digits from 4-4-2, 5-3-2, 5-4-1 or plain 11 digits; anything else is null."""
    parts = F.split(trim(c), "-")
    padded = F.concat(F.lpad(F.get(parts, F.lit(0)), 5, "0"), F.lpad(F.get(parts, F.lit(1)), 4, "0"), F.lpad(F.get(parts, F.lit(2)), 2, "0"))
    return F.when(trim(c).rlike(r"^(\d{4}-\d{4}-\d{2}|\d{5}-\d{3}-\d{2}|\d{5}-\d{4}-\d|\d{5}-\d{4}-\d{2})$"), padded).when(trim(c).rlike(r"^\d{11}$"), trim(c))


def npi_valid(c: Column) -> Column:
    """Ten digits whose check digit holds under the issuer prefix."""
    return F.coalesce(c.rlike(r"^\d{10}$") & F.call_function("luhn_check", F.concat(F.lit("80840"), c)), F.lit(False))


def first_npi(c: Column) -> Column:
    """The first valid one of a list, or the one in ``Name (NPI)``."""
    return F.get(F.filter(F.regexp_extract_all(c, F.lit(r"(\d{10})"), F.lit(1)), npi_valid), F.lit(0))


def zip_parts(c: Column) -> Column:
    part = lambda i: F.nullif(F.regexp_extract(trim(c), r"^(\d{5})(?:-?(\d{4}))?$", i), F.lit(""))
    return F.struct(part(1).alias("zip5"), part(2).alias("zip4"))


def code_list(c: Column) -> Column:
    """Codes of a list in any of ``, ; |``, normalised, blanks dropped."""
    return F.filter(F.transform(F.split(c, r"[,;|]"), icd), lambda x: x != "")


def bill_type(facility: Column, classification: Column, frequency: Column) -> Column:
    return F.concat_ws("", facility, classification, frequency)


def tin_list(c: Column) -> Column:
    """Nine-digit tax ids of a list, dashes dropped."""
    return F.filter(F.transform(F.split(c, r"[,;|\s]+"), lambda x: F.translate(x, "-", "")), lambda x: x.rlike(r"^\d{9}$"))


def amount(c: Column) -> Column:
    """Money as decimal(18,4): symbols and thousands dropped, parentheses negative."""
    bare = F.regexp_replace(trim(c), r"[$,\s()]", "")
    value = bare.try_cast("decimal(18,4)")
    return F.when(trim(c).rlike(r"^\(.*\)$"), -value).otherwise(value)


def identifier_shape(c: Column) -> Column:
    """What an identifier looks like: a beneficiary id, a state client id, a provider number, a tax id, or its pattern of 9 and A."""
    text = F.upper(trim(c))
    pattern = F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[A-Z]", "A")
    return (
        F.when(text.rlike(r"^[1-9][A-Z][A-Z0-9]\d[A-Z][A-Z0-9]\d[A-Z]{2}\d{2}$"), "MBI").when(text.rlike(r"^[A-Z]{2}\d{5}[A-Z]$"), "CIN")
        .when(npi_valid(text), "NPI").when(text.rlike(r"^\d{2}-?\d{7}$"), "TIN").otherwise(pattern)
    )
