"""Text functions: normalisation, identifiers, numbers, cell references."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """(from, to) of every character that decomposes to one ASCII letter or digit and marks; built by rule."""
    pairs = []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1 and base.isascii() and base.isalnum():
            pairs.append((c, base))
    bmp = [(c, b) for c, b in pairs if ord(c) < 0x10000]
    return "".join(c for c, _ in bmp), "".join(b for _, b in bmp)


@lru_cache(maxsize=1)
def _longer_map() -> dict[str, str]:
    """Characters that decompose to several, an ASCII letter or digit among them (ligatures, fractions, units); built by rule."""
    out = {}
    for code in range(0x80, 0x10000):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(base) > 1 and any(x.isascii() and x.isalnum() for x in base):
            out[chr(code)] = base
    return out


def normalize_text(v: Column) -> Column:
    """Compatibility forms and accents off, lower case, anything but a-z and 0-9 to one space, trimmed; null is empty.

    Most texts have no character that stands for several; only those that do are taken apart.
    """
    plain = F.translate(F.regexp_replace(F.coalesce(v, F.lit("")), r"\p{M}+", ""), *accent_map())
    longer = _longer_map()
    known = F.str_to_map(F.lit("\x01".join(f"{k}\x02{x}" for k, x in longer.items())), F.lit("\x01"), F.lit("\x02"))
    apart = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")
    whole = F.when(plain.rlike("[" + "".join(longer) + "]"), apart).otherwise(plain)
    return F.trim(F.regexp_replace(F.lower(whole), "[^a-z0-9]+", " "))


def first_number(v: Column) -> Column:
    """The first number of a text, with a comma read as a point; null if there is none."""
    return F.regexp_extract(F.replace(v, F.lit(","), F.lit(".")), r"(-?[0-9]+(?:[.][0-9]+)?)", 1).try_cast("double")


def normalize_identifier(v: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(v, F.lit("")), "[^0-9A-Za-z]+", ""))


def neighbour_identifier(v: Column) -> Column:
    """A cell's name as neighbour lists compare it: upper case, no white space, no doubled underscores."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(v, F.lit(""))), r"\s+", ""), "_+", "_")


def neighbour_key(v: Column) -> Column:
    """Site key of a name: its identifier without the technology in front and the number behind."""
    return F.regexp_replace(F.regexp_replace(neighbour_identifier(v), "^[234]G_", ""), "_[0-9]+$", "")


def cluster_base(site: Column) -> Column:
    """The name that co-located sites share: without the number behind."""
    return F.regexp_replace(site, "_[0-9]+$", "")


def site_base(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, "(?i)^[234]G_", ""))


def parse_azimuth(v: Column) -> Column:
    return F.trim(F.replace(v, F.lit(","), F.lit("."))).try_cast("double")


def lte_band(sheet: Column, file: Column) -> Column:
    """Band by the sheet's name, then by the file's: 800 before 2100 before 2600 (so 1800 reads as 800)."""

    def of(v: Column) -> Column:
        t = normalize_text(v)
        return F.when(t.contains("800"), "L800").when(t.contains("2100"), "L2100").when(t.contains("2600"), "L2600")

    return F.coalesce(of(sheet), of(file))


def column_index(letters: Column) -> Column:
    """0-based index of column letters."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64)) - 1


def cell_ref(row: Column, col: Column) -> Column:
    """A1 reference of 0-based row and column, up to three letters."""
    letter = lambda n: F.char(65 + n)
    third = F.when(col >= 702, letter(F.floor((col - 702) / 676) % 26)).otherwise("")
    second = F.when(col >= 26, letter(F.floor((col - 26) / 26) % 26)).otherwise("")
    return F.concat(third, second, letter(col % 26), (row + 1).cast("string"))


def is_flag_on(v: Column) -> Column:
    return F.lower(F.trim(F.coalesce(v, F.lit("")))).isin("1", "true", "yes", "on")


def slug(v: Column) -> Column:
    return F.regexp_replace(F.lower(normalize_text(v)), "[^a-z0-9]+", "-")


def identifier_cost(text: Column, identifier: Column) -> Column:
    """Edits between an identifier and the best window of digits in a text; 0 if the digits hold it, length + 10 without digits."""
    own = normalize_identifier(identifier)
    groups = F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))
    stream = F.array_join(groups, "")
    size = F.length(own)
    windows = F.when(F.length(stream) >= size, F.transform(F.sequence(F.lit(1), F.length(stream) - size + 1), lambda i: F.substr(stream, i, size))).otherwise(F.array().cast("array<string>"))
    best = F.array_min(F.transform(F.concat(groups, windows), lambda w: F.levenshtein(w, own)))
    return F.when(stream.contains(own) & (F.size(groups) > 0), 0).when(F.size(groups) == 0, size + 10).otherwise(best)


def content_key(content: Column) -> Column:
    """What equal images are known by."""
    return F.sha1(content)
