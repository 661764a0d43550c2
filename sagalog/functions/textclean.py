"""Repairs of extracted page text, captions and page ranges, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import BadArguments

#: White space as the reference dialect has it (no vertical tab), word characters, the en dash.
WS = r"[\t\n\f\r ]"
WORD = r"[\p{L}\p{N}]"
DASH = "–"
#: Only the letters next to the split matter; as they are not taken up, one pass joins chains too.
HYPHEN_SPLIT = rf"(?<={WORD}){WS}*\n{WS}*-{WS}*\n{WS}*(?={WORD})"
CITATION = rf"\[{WS}*\n+{WS}*([0-9]+){WS}*\n+{WS}*\]"
NUMBER_RANGE = rf"([0-9][0-9,.]*)[ \t]*\n+[ \t]*{DASH}[ \t]*\n+[ \t]*([0-9])"
PROSE_DASH = rf"([^\t\n\f\r ])[ \t]*\n+[ \t]*{DASH}[ \t]*\n+[ \t]*([^\t\n\f\r ])"
PAGE_BREAK = r"\n*\f\n*"
TRIM = r"^[\s\x85\p{Z}]+|[\s\x85\p{Z}]+\z"
#: Caption labels at the start of a line; the first rule that matches wins.
_END = r"(?:[.\t\n\f\r —–:]|\z)"
CAPTIONS = tuple(
    f"^({label}){_END}"
    for label in (
        r"Figure [0-9]+-[0-9]+",
        r"Рисунок [0-9]+(?:\.[0-9]+)?",
        r"Рис\. [0-9]+(?:\.[0-9]+)?",
        r"Мал\. [0-9]+(?:\.[0-9]+)?",
        rf"Схема (?:№{WS}*)?[0-9]+(?:\.[0-9]+)?",
        r"Table [0-9]+-[0-9]+",
    )
)
PAGE_MARKER = r"^<!-- page ([0-9]+) -->"


def rejoin(c: Column) -> Column:
    """Hyphen splits, citations, number ranges, dashes."""
    for pattern, into in ((HYPHEN_SPLIT, "-"), (CITATION, "[$1]"), (NUMBER_RANGE, f"$1{DASH}$2"), (PROSE_DASH, f"$1 {DASH} $2")):
        c = F.regexp_replace(c, pattern, into)
    return c


def number_pages(c: Column) -> Column:
    """Form feeds become page markers, counted from 2."""
    parts = F.split(c, PAGE_BREAK)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("\n\n<!-- page "), (i + 1).cast("string"), F.lit(" -->\n\n"), p))), "")


def clean(c: Column) -> Column:
    """Markdown working copy of extracted text; null stays null."""
    body = F.regexp_replace(F.regexp_replace(number_pages(rejoin(c)), r"\n{3,}", "\n\n"), TRIM, "")
    return F.concat(F.lit("<!-- page 1 -->\n\n"), body, F.lit("\n"))


def normalise_lines(c: Column) -> Column:
    """Runs of spaces and tabs to one space, line ends trimmed, no newlines at either end."""
    lines = F.split(F.regexp_replace(c, r"[ \t]+", " "), "\n")
    joined = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"[\s\x85\p{Z}]+\z", "")), "\n")
    return F.regexp_replace(joined, r"^\n+|\n+\z", "")


def caption_label(line: Column) -> Column:
    """Label of a caption line, null for any other line."""
    return reduce(lambda a, b: F.coalesce(a, b), [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in CAPTIONS])


def page_marker(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, PAGE_MARKER, 1), F.lit("")).try_cast("int")


def is_local_path(c: Column) -> Column:
    """Not empty, not absolute and never above the folder it starts in."""
    depth = F.aggregate(
        F.split(c, "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda acc, part: F.struct(
            (acc["d"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)).alias("d"),
            F.least(acc["low"], acc["d"] + F.when(part == "..", -1).otherwise(0)).alias("low"),
        ),
        lambda acc: acc["low"],
    )
    return (c != "") & ~c.startswith("/") & (depth >= 0)


def join_path(folder: str, file: Column) -> Column:
    """folder/file with ``.``, ``..`` and doubled slashes resolved."""
    whole = F.concat(F.lit(folder + "/" if folder else ""), file)
    kept = F.aggregate(
        F.split(whole, "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when((part == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((part == "..") & whole.startswith("/"), acc)
        .otherwise(F.concat(acc, F.array(part))),
    )
    path = F.concat(F.when(whole.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(path == "", ".").otherwise(path)


def page_range(page: int | None = None, pages: str | None = None) -> tuple[int, int] | None:
    """(from, to) of a page argument, None for all pages; ``page`` wins over ``pages`` ("N-M", ASCII digits, no blanks)."""
    if page:
        if page < 1:
            raise BadArguments(f"page must be at least 1, got {page}")
        return page, page
    if not pages:
        return None
    found = re.fullmatch(r"\+?([0-9]{1,18})-\+?([0-9]{1,18})", pages)
    if not found:
        raise BadArguments(f"invalid page range {pages!r}, expected N-M")
    first, last = int(found[1]), int(found[2])
    if first < 1 or last < first:
        raise BadArguments(f"invalid page range {pages!r}")
    return first, last


def split_list(text: str) -> list[str]:
    """Comma-separated values, trimmed, empty ones dropped."""
    return [x.strip() for x in text.split(",") if x.strip()]
