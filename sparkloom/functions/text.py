"""Text functions as column expressions: they stay in the JVM and in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- mail subjects and search ----------------------------------------------------------------------------------------


def normalize_subject(subject: Column) -> Column:
    """Without one leading reply or forward mark (``Re:``, ``Fwd:``, ``FW:``, any case), trimmed."""
    return F.regexp_replace(F.regexp_replace(subject, r"(?i)^(re|fwd|fw):\s*", ""), r"^\s+|\s+$", "")


def contains_like(text: Column, keyword: str) -> Column:
    """Whether a text contains a keyword, case-insensitively; ``%`` and ``_`` are wildcards, a backslash is a backslash.

    What ``ILIKE`` says, in one pass of the text: the pieces between ``%`` are looked for one after the other, each where it
    comes first. ``ILIKE`` tries all places of all pieces, which grows with the square of a text's length for ``%word%`` between two more ``%``.
    """
    low, wanted = F.lower(text), F.lower(F.lit(keyword))
    if not re.search("[%_]", keyword):
        return F.coalesce(F.contains(low, wanted), F.lit(False))
    quoted = F.regexp_replace(wanted, F.lit(r"[\\^$.|?*+()\[\]{}]"), F.lit(r"\\$0"))
    pieces = F.regexp_replace(F.translate(quoted, "_", "."), F.lit("%+"), F.lit(r")(?>.*?"))
    return F.coalesce(F.rlike(low, F.concat(F.lit("(?s)^(?>.*?"), pieces, F.lit(")"))), F.lit(False))


# -- file names ------------------------------------------------------------------------------------------------------

#: A date of the years 1900 to 2099 with separators, what may stand around a level mark, the marks of each level.
DATE = r"(?:19|20)[0-9]{2}[-_#.~]?(?:0[1-9]|1[0-2])[-_#.~]?(?:0[1-9]|[12][0-9]|3[01])[-_#.~]?"
LEFT_MARKS = " ([_(【-"
RIGHT_MARKS = " )]_）】"
LEVELS = {0: "", 1: "PUB,NOR", 2: "INT", 3: "CON", 4: "CLA"}


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def strip_date_prefix(name: Column) -> Column:
    """Without dates like 20240131 or 2024-01-31, and a separator after each."""
    return F.regexp_replace(name, DATE, "")


def add_date_prefix(name: Column, modified: Column, created: Column) -> Column:
    """``yyyyMMdd_`` of the later stamp, in place of any date that is there."""
    return F.concat(F.date_format(F.greatest(modified, created), "yyyyMMdd"), F.lit("_"), strip_date_prefix(name))


def strip_marks(name: Column, marks: list[str]) -> Column:
    """Without the given marks, and the characters around them, where they stand between the characters that may.

    Each mark is looked for once, from left to right: what comes to stand beside each other by a removal isn't looked at again.
    """
    left, right = (f"[{re.escape(x)}]" for x in (LEFT_MARKS, RIGHT_MARKS))
    for mark in marks:
        name = F.regexp_replace(name, f"{left}{re.escape(mark)}{right}", "")
    return name


def set_level(name: Column, level: int) -> Column:
    """The name with the first mark of one level, all level marks and digits that it had removed; level 0 only removes."""
    marks = [m for names in LEVELS.values() for m in names.split(",") if m]
    bare = strip_marks(name, [*marks, *map(str, range(1, 10))])
    return F.concat(bare, F.lit(f"({LEVELS[level].split(',')[0]})")) if level else bare


#: Which keyword of a name makes a module's description; the first that is found counts.
KINDS = {
    "cli": "Command-line interface for",
    "gui": "Graphical user interface for",
    "core": "Core functionality for",
    "util": "Utility functions for",
    "model": "Data models for",
    "test": "Tests for",
}


def classify_stem(name: Column, parent: Column) -> Column:
    """A module's description by the first keyword in its name, else by the name in title case."""
    found = F.when(F.lit(False), F.lit(""))
    for keyword, label in KINDS.items():
        found = found.when(F.contains(F.lower(name), F.lit(keyword)), F.concat(F.lit(f"{label} "), parent, F.lit(".")))
    return found.otherwise(F.concat(title_case(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(" module.")))


def title_case(text: Column) -> Column:
    """Every run of letters with a large first letter and small ones after it, whatever stands between runs."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


# -- versions --------------------------------------------------------------------------------------------------------

#: The grammar of semantic versions. Numbers have no leading zeros, also as parts of a pre-release.
NUMBER = r"0|[1-9][0-9]*"
PRE_PART = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
BUILD_PART = r"[0-9A-Za-z-]+"
VERSION_CORE = rf"({NUMBER})\.({NUMBER})\.({NUMBER})(?:-({PRE_PART}(?:\.{PRE_PART})*))?(?:\+({BUILD_PART}(?:\.{BUILD_PART})*))?"
VERSION = rf"^v?{VERSION_CORE}$"


def parse_version(text: Column) -> Column:
    """Struct of major, minor, patch (decimals, null beyond 38 digits), pre and build; null if the text isn't a semantic version."""
    number = lambda i: F.regexp_extract(text, VERSION, i).try_cast("decimal(38,0)")
    made = F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), F.regexp_extract(text, VERSION, 4).alias("pre"), F.regexp_extract(text, VERSION, 5).alias("build"))
    return F.when(text.rlike(VERSION), made)


def next_number(digits: Column) -> Column:
    """The number after a number in digits, of any length."""
    nines = F.length(F.regexp_extract(digits, "(9*)$", 1))
    head = F.substring(digits, F.lit(1), F.length(digits) - nines)
    up = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), (F.substring(head, -1, 1).try_cast("int") + 1).cast("string"))
    return F.concat(F.when(head == "", "1").otherwise(up), F.repeat(F.lit("0"), nines))


def bump_version(text: Column, part: str) -> Column:
    """The next version: the part goes up by one, those below become 0, pre-release and build go. Null if it is no version."""
    at = ["major", "minor", "patch"].index(part)
    number = lambda i: F.regexp_extract(text, VERSION, i + 1)
    parts = [number(i) if i < at else next_number(number(i)) if i == at else F.lit("0") for i in range(3)]
    return F.when(text.rlike(VERSION), F.concat_ws(".", *parts))


def bump_assignment(line: Column, part: str) -> Column:
    """A line such as ``version = "1.2.3"`` with its version bumped; what stands before, and the quotes, stay."""
    pattern = rf"""^(\s*(?:__version__|version)\s*=\s*["'])({VERSION_CORE})(["'].*)$"""
    piece = lambda i: F.regexp_extract(line, pattern, i)
    return F.when(line.rlike(pattern), F.concat(piece(1), bump_version(piece(2), part), piece(8))).otherwise(line)


# -- other -----------------------------------------------------------------------------------------------------------


def compression_ratio(old: Column, new: Column) -> Column:
    """How much smaller in per cent; null where there was nothing."""
    return (F.lit(1.0) - F.try_divide(new.cast("double"), old.cast("double"))) * 100


def requirement_name(line: Column) -> Column:
    """The name in a ``name==version`` line, null for other lines."""
    return F.when(F.contains(line, F.lit("==")), F.trim(F.split_part(line, F.lit("=="), F.lit(1))))


def requirement_version(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("==")), F.trim(F.split_part(line, F.lit("=="), F.lit(2))))
