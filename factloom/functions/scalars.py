"""Scalar helpers as column expressions, with plain-Python twins where the driver needs them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCATION = r"^(.*):(\d+|\?):(\d+|\?):(\d+|\?):(\d+|\?)$"


def parse_location(text: Column) -> Column:
    """'file:sl:sc:el:ec' (columns 1-based, ? where unknown) → struct(file, sl, sc, el, ec) with 0-based columns."""
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(text, LOCATION, i), F.lit("?")), F.lit("999999999")).cast("int")
    return F.when(text.rlike(LOCATION), F.struct(F.regexp_extract(text, LOCATION, 1).alias("file"), part(2).alias("sl"), (part(3) - 1).alias("sc"), part(4).alias("el"), (part(5) - 1).alias("ec")))


def format_location(file: Column, sl: Column, sc: Column, el: Column, ec: Column) -> Column:
    """The inverse of parse_location."""
    show = lambda c, add: F.coalesce((c + add).cast("string"), F.lit("?"))
    return F.concat_ws(":", file, show(sl, 0), show(sc, 1), show(el, 0), show(ec, 1))


def contains(outer: Column, inner: Column) -> Column:
    """Range containment of location structs of one file."""
    begin = lambda x: F.struct(x["sl"], x["sc"])
    end = lambda x: F.struct(x["el"], x["ec"])
    return (begin(outer) <= begin(inner)) & (end(outer) >= end(inner))


def is_array_index(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def is_internal_property(text: Column) -> Column:
    """Pseudo-properties of containers and prototypes."""
    return text.rlike(r"^(%|\[\[)")


def is_unlikely_accessor(prop: Column) -> Column:
    return prop.isin("[[Prototype]]", "prototype", "toString") | is_array_index(prop)


def percent(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100)


def ternary_or(*values: Column) -> Column:
    """True > Maybe (null) > False: SQL's OR."""
    out = values[0]
    for v in values[1:]:
        out = out | v
    return out


def normalize_module_name(name: Column) -> Column:
    """Leading ./ and ../ steps are dropped."""
    return F.regexp_replace(name, r"^(\.\.?/)+", "")


def snippet(text: Column, most: int = 20) -> Column:
    """White space collapsed; beyond 2 x most characters, only the ends are shown."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > 2 * most, F.concat(F.substring(flat, 1, most), F.lit("..."), F.substring(flat, -most, most))).otherwise(flat)


def common_prefix(texts: list[str]) -> str:
    if not texts:
        return ""
    lo, hi = min(texts), max(texts)
    n = next((i for i, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
    return lo[:n]


def hash53(text: str, seed: int = 0) -> int:
    """A 53-bit hash of UTF-16 code units by two interleaved multiplications (the public cyrb53)."""
    h1, h2, m = 0xDEADBEEF ^ seed, 0x41C6CE57 ^ seed, 0xFFFFFFFF
    raw = text.encode("utf-16-le", "surrogatepass")
    for u in (int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)):
        h1, h2 = ((h1 ^ u) * 2654435761) & m, ((h2 ^ u) * 1597334677) & m
    a = (((h1 ^ (h1 >> 16)) * 2246822507) & m) ^ (((h2 ^ (h2 >> 13)) * 3266489909) & m)
    b = (((h2 ^ (h2 >> 16)) * 2246822507) & m) ^ (((a ^ (a >> 13)) * 3266489909) & m)
    return 4294967296 * (2097151 & b) + a


def glob_to_regex(glob: str) -> str:
    """A path glob → an anchored regular expression: *, **, ?, [..], {a,b} (nested) and the groups @( +( *( ?( !( ."""
    out, i, groups = "", 0, []
    while i < len(glob):
        c = glob[i]
        if c in "@+*?!" and glob[i + 1 : i + 2] == "(":
            groups.append({"@": ")", "+": ")+", "*": ")*", "?": ")?", "!": "))[^/]*?"}[c])
            out += "(?!(?:" if c == "!" else "(?:"
            i += 2
        elif c == "(":
            groups.append(")")
            out, i = out + "(?:", i + 1
        elif c == ")" and groups:
            out, i = out + groups.pop(), i + 1
        elif c == "|" and groups:
            out, i = out + "|", i + 1
        elif glob.startswith("/**/", i):
            out, i = out + "/(?:.*/)?", i + 4
            continue
        elif glob.startswith("**/", i) and i == 0:
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif c == "{" and _closes(glob, i):
            groups.append(")")
            out, i = out + "(?:", i + 1
        elif c == "}" and groups:
            out, i = out + groups.pop(), i + 1
        elif c == "," and groups and _in_braces(glob, i):
            out, i = out + "|", i + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def _closes(glob: str, i: int) -> bool:
    depth = 0
    for c in glob[i:]:
        depth += (c == "{") - (c == "}")
        if not depth:
            return True
    return False


def _in_braces(glob: str, i: int) -> bool:
    return glob[:i].count("{") > glob[:i].count("}")


def matches_glob(text: Column, glob: str) -> Column:
    return text.rlike(glob_to_regex(glob))
