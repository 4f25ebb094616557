"""Text functions as column expressions: tokens, hashes, labels, locators, clips, globs and times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the search contract.
LABEL_RUNES, STEM_RUNES, SNIPPET_RUNES = 60, 5, 280


def tokens(x: Column) -> Column:
    """Lower-cased runs of letters and digits; no stemming, no empties."""
    return F.array_remove(F.split(F.lower(x), r"[^\p{L}\p{Nd}]+"), "")


def content_hash(x: Column) -> Column:
    """The first 16 bytes of SHA-256, as hex."""
    return F.substring(F.sha2(x, 256), 1, 32)


def collapsed(x: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def clipped(x: Column, runes: int) -> Column:
    return F.when(F.char_length(x) > runes, F.concat(F.substring(x, 1, runes), F.lit("…"))).otherwise(x)


def head_and_tail(x: Column, runes: int) -> Column:
    """A third of the room for the beginning, two thirds for the end."""
    head = runes // 3
    return F.when(F.char_length(x) > runes, F.concat(F.substring(x, 1, head), F.lit("\n…\n"), F.right(x, F.lit(runes - head)))).otherwise(x)


def embed_text(prefix: Column, text: Column) -> Column:
    return F.when(F.coalesce(prefix, F.lit("")) == "", text).otherwise(F.concat(prefix, F.lit("\n\n"), text))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def attr(attrs: Column, key: str) -> Column:
    """A missing attribute reads as the empty string."""
    return F.coalesce(attrs[key], F.lit(""))


def attr_pairs(attrs: Column) -> Column:
    """k=v pairs in order of the key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")


def label(node_id: Column, kind: Column, attrs: Column, text: Column) -> Column:
    """Title, name or the attribute named like the kind; else the last path element; else the first text; else the id."""
    named = [F.when(attr(attrs, k) != "", attr(attrs, k)) for k in ("title", "name")]
    by_kind = F.coalesce(attrs[kind], F.lit(""))
    path = F.when(F.contains(node_id, F.lit("/")), base_name(node_id))
    return clipped(collapsed(F.coalesce(*named, F.when(by_kind != "", by_kind), F.when(path != "", path), F.when(F.trim(text) != "", text), node_id)), LABEL_RUNES)


def locator(line: Column, end_line: Column) -> Column:
    """:a-b, :a, or nothing where no line is known."""
    return F.when(F.coalesce(line, F.lit(0)) == 0, "").when(line == end_line, F.concat(F.lit(":"), line)).otherwise(F.concat(F.lit(":"), line, F.lit("-"), end_line))


def line_of(text: Column, start: Column) -> Column:
    """1 and the line ends before the place start (from 0)."""
    return F.length(F.substring(text, F.lit(1), start)) - F.length(F.replace(F.substring(text, F.lit(1), start), F.lit("\n"), F.lit(""))) + 1


def glob_regex(glob: str) -> str:
    """**/ any folders, ** anything, * within a folder, ? one character within a folder; anchored."""
    out, i = "", 0
    while i < len(glob):
        for mark, pattern in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if glob.startswith(mark, i):
                out, i = out + pattern, i + len(mark)
                break
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^(?s:{out})$"


def any_glob(path: Column, globs: list[str]) -> Column:
    return F.rlike(path, F.lit("|".join(map(glob_regex, globs)))) if globs else F.lit(False)


def since(value: str, now: Column) -> Column:
    """A date, an RFC 3339 time, or an age such as 72h or 30d before now."""
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)([smhd])", value):
        seconds = float(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]
        return F.timestamp_micros((F.unix_micros(now) - int(seconds * 1e6)).cast("long"))
    return F.to_timestamp(F.lit(value))


def numeric_or_hex(token: Column) -> Column:
    """All digits, or seven or more hex digits with a digit among them."""
    return F.rlike(token, F.lit(r"^\d+$")) | (F.rlike(token, F.lit(r"^[0-9a-f]{7,}$")) & F.rlike(token, F.lit(r"\d")))


def is_entity_name(name: Column) -> Column:
    """One to four tokens, none of them a number, two runes at least."""
    t = tokens(name)
    return (F.size(t) >= 1) & (F.size(t) <= 4) & (F.char_length(name) >= 2) & ~F.exists(t, numeric_or_hex)


def normal_id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), collapsed(F.lower(name)))


def script(x: Column) -> Column:
    """The script of the first letter outside Latin; Latin if there is none."""
    first = F.regexp_extract(x, r"([\p{L}&&[^\p{IsLatin}]])", 1)
    out = F.when(first == "", "latin")
    for name in ("Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Devanagari", "Thai"):
        out = out.when(F.rlike(first, F.lit(rf"\p{{Is{name}}}")), name.lower())
    return out.otherwise("other")
