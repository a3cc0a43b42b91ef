"""Text functions as columns: paths, splitting, substitution, placeholders, escaping."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_length(s: Column) -> Column:
    return F.octet_length(s)


def basename(p: Column) -> Column:
    """Last part of a path without trailing slashes; ``.`` if empty, ``/`` if only slashes."""
    bare = F.rtrim(p, F.lit("/"))
    return F.when(p == "", ".").when(bare == "", "/").otherwise(F.substring_index(bare, "/", -1))


def clean(p: Column) -> Column:
    """A path without empty and ``.`` parts, and with ``..`` taken away from what stands before it."""
    rooted = p.startswith("/")
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        up = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        back = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(x != "..", F.concat(done, F.array(x))).when(up, back).when(rooted, done).otherwise(F.concat(done, F.array(x)))

    joined = F.array_join(F.aggregate(parts, none, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))


def dirname(p: Column) -> Column:
    return clean(F.when(p.contains("/"), F.regexp_extract(p, "^(.*/)[^/]*$", 1)).otherwise(F.lit(".")))


def abspath(p: Column, folder: str) -> Column:
    return clean(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), p)))


def contains(s: Column, part: Column | str) -> Column:
    return F.contains(s, F.lit(part) if isinstance(part, str) else part)


def split(s: Column, delimiter: str = "") -> Column:
    """Cut at a literal delimiter; without one, into characters."""
    return F.filter(F.split(s, ""), lambda x: x != "") if delimiter == "" else F.split(s, r"\Q" + delimiter + r"\E")


def sub(s: Column, pattern: str, replacement: str) -> Column:
    """Replace all; ``$1`` and ``${1}`` are groups, a group named by more than digits is empty."""
    if re.search(r"\(\?[=!<]|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    groups = re.compile(pattern).groups

    def ref(m: re.Match) -> str:
        name = m[1] or m[2]
        return f"${{g{name}}}" if name.isdigit() and int(name) <= groups else ""

    target = re.sub(r"\$(?:\{(\w+)\}|(\w+))", ref, replacement.replace("\\", "\\\\"))
    return F.regexp_replace(s, pattern, re.sub(r"\$\{g(\d+)\}", r"$\1", target))


def char_at(s: Column, i: int) -> Column:
    """Character ``i`` from 0, or from the end if negative; raises outside the text."""
    place = F.lit(i + 1) if i >= 0 else F.length(s) + i + 1
    ok = (place >= 1) & (place <= F.length(s))
    return F.when(ok, s.substr(place, F.lit(1))).otherwise(F.raise_error(F.lit(f"index {i} out of range")))


def template(*parts: Column | str) -> Column:
    """Parts joined; null parts are empty."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def product(*lists: Column) -> Column:
    """All joins of one element of each list, the first list varying slowest."""
    def times(left: Column, right: Column) -> Column:
        return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, b))))

    return reduce(times, lists)


def placeholders(pattern: str, path: Column, index: Column) -> Column:
    """``{}`` or ``{^}`` the path, ``{@}`` its base name, ``{^S}`` and ``{@S}`` without the suffix S, ``{#}`` the index, ``{{}}`` a literal ``{}``."""
    out, at = [], 0
    for m in re.finditer(r"\{\{\}\}|\{([\^@#]?)([^{}]*)\}", pattern):
        out.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        sign, suffix = m[1], m[2]
        if m[0] == "{{}}":
            out.append(F.lit("{}"))
        elif sign == "#" and not suffix:
            out.append(index.cast("string"))
        elif sign in ("^", "@") or (not sign and not suffix):
            own = basename(path) if sign == "@" else path
            if suffix:
                own = F.when(own.endswith(suffix), own.substr(F.lit(1), F.length(own) - len(suffix))).otherwise(own)
            out.append(own)
        else:
            out.append(F.lit(m[0]))
    return F.concat(*out, F.lit(pattern[at:]))


def memory(amount: Column, form: str = "megabytes") -> Column:
    """``8G`` as ``8000`` (``megabytes``: G and GB count a thousand, other units one, halves round up) or as ``8gb`` (``suffix``)."""
    if form == "suffix":
        return F.when(amount == "", amount).otherwise(F.concat(F.lower(amount), F.lit("b")))
    number = F.regexp_extract(amount, r"^([0-9]*\.?[0-9]*)", 1).try_cast("double")
    scale = F.when(F.upper(F.regexp_extract(amount, r"^[0-9.]+(.*)$", 1)).isin("G", "GB"), 1000).otherwise(1)
    return F.when(number.isNull(), amount).otherwise(F.floor(number * scale + 0.5).cast("bigint").cast("string"))


def elide(s: Column, n: int) -> Column:
    """Texts of more than ``n`` bytes cut to ``n - 1`` bytes and an ellipsis."""
    return F.when(F.octet_length(s) > n, F.concat(F.substring(F.encode(s, "UTF-8"), 1, n - 1).cast("string"), F.lit("…"))).otherwise(s)


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def dot_quote(s: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def safe_name(s: Column) -> Column:
    """A host's name for files: slashes, backslashes and white space become underscores."""
    return F.translate(s, "/\\ \t\n", "_____")


def option_name(s: Column) -> Column:
    """A variable's name from a command line's option: hyphens become underscores."""
    return F.replace(s, F.lit("-"), F.lit("_"))


def job_name(s: Column) -> Column:
    """A name for schedulers that allow no slash."""
    return F.replace(s, F.lit("/"), F.lit("_"))
