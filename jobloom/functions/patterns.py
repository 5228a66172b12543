"""Patterns are written once, in the dialect in which RE2 and JavaScript agree: ASCII ``\\b`` and ``\\w``, folded case.

``java`` turns one into Java's dialect, where ``\\b`` knows Unicode letters and ``\\s`` doesn't know the no-break space.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"  # Java's \w is ASCII and, unlike ranges, costs no folding
#: White space as JavaScript knows it: Java's two ready-made kinds, tested without folding, but for two characters.
SPACE, SPACES = r"[\x{FEFF}\h\v&&[^\x{85}\x{180E}]]", "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_LISTED = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def java(pattern: str, fold: bool | None = True) -> str:
    """The pattern for Spark's functions; ``fold`` None: a part of one."""
    out, k, inside, spaced = [], 0, False, False
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\b" and not inside:
            out.append(_BOUNDARY)
        elif two == r"\s" and inside == "[":
            out.append(SPACE[1 : SPACE.index("&")])
            spaced = True
        elif two == r"\s":
            out.append(_LISTED if inside else SPACE)
        elif two[0] == "\\":
            out.append(two)
        else:
            if spaced and two[0] == "]":  # the class without the two characters; a dash at its end would join them
                out[-1:] = [r"\-" if out[-1] == "-" else out[-1], SPACE[SPACE.index("&") : -1]]
            inside = inside or (two if two == "[^" else "[" if two[0] == "[" else False)
            if two[0] == "]":
                inside = spaced = False
            out.append(r"\&" if inside and two[0] == "&" else two[0])
            k -= 1
        k += 2
    return ("(?iu)" if fold else "") + "".join(out)


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, those in groups and classes left whole."""
    out, depth, inside, k = [""], 0, False, 0
    while k < len(pattern):
        c = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
        if not inside and c in "()":
            depth += 1 if c == "(" else -1
        inside = (inside or c == "[") and c != "]"
        if c == "|" and not depth and not inside:
            out.append("")
        else:
            out[-1] += c
        if depth < 0:
            return []  # not one group
        k += len(c)
    return out


def _quick(pattern: str) -> str:
    """The pattern for a test alone: of ``\\b(x|y)\\b`` each boundary becomes what its neighbour makes of it, behind a look at the first character."""
    word, bounded = r"\w", re.fullmatch(r"\\b\((.*)\)\\b", pattern, re.S)
    grouped = re.fullmatch(r"\((?!\?)(.*)\)", pattern, re.S)
    if grouped and not bounded and len(parts := _alternatives(grouped[1])) > 1:
        return "(?:" + "|".join(map(_quick, parts)) + ")"
    if not bounded or not (parts := _alternatives(bounded[1])):
        return java(pattern, None)
    kinds: dict[str, list[str]] = {}
    for alt in parts:
        first, last = alt[:1], alt[-1:] if alt[-2:-1] != "\\" else ""
        kind = "any" if not first or alt[1:2] in "?*{" or not (first.isalnum() or first == "_") else "ascii" if first.isascii() else "other"
        end = f"(?!{word})" if last.isascii() and last.isalnum() else f"(?={word})" if last.isalpha() else _BOUNDARY
        kinds.setdefault(kind, []).append((first, java(alt, None) + end))
    out = []
    for kind, alts in kinds.items():
        start = {"ascii": f"(?<!{word})", "other": f"(?<={word})", "any": _BOUNDARY}[kind]
        look = "" if kind == "any" else f"(?=[{''.join(sorted({f for f, _ in alts}))}])"
        out.append(f"{look}{start}(?:{'|'.join(a for _, a in alts)})")
    return f"(?:{'|'.join(out)})"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def has(text: Column, pattern: str, fold: bool = True) -> Column:
    """Whether the pattern matches anywhere; a lower-cased text needs no ``fold`` for a pattern in lower case."""
    return F.rlike(text, F.lit(("(?iu)" if fold else "") + _quick(pattern)))


def signs(pattern: str) -> list[str] | None:
    """Lower-case strings of which a text that matches holds at least one: plain text of each alternative; None if one has none at the start of a part."""
    bounded = re.fullmatch(r"\\b\((.*)\)\\b", pattern, re.S) or re.fullmatch(r"\((?!\?)(.*)\)", pattern, re.S)
    out = set()
    for alt in (_alternatives(bounded[1]) if bounded else []) or [pattern]:
        if alt != pattern and alt[:1] in ("\\", "(") and (inner := signs(alt)):
            out.update(inner)
            continue
        plain = [""]
        for part in re.split(r"\\s[+*]", alt):  # every part is needed: the longest tells most
            m = re.match(r"(?:\\b)?([\w#@:-]*)", part)
            plain.append(m[1][:-1] if part[m.end() :][:1] in tuple("?*{") else m[1])
        if not max(plain, key=len):
            return None
        out.add(max(plain, key=len).lower())
    return sorted(out)


def likely(text: Column, pattern: str, of: list[str] | None = None) -> Column:
    """``has`` for a lower-cased text, looked for only where one of the pattern's signs stands: most texts are spared the expression."""
    of, match = of or signs(pattern), has(text, pattern, fold=bool(re.search("[A-Z]", pattern)))
    if of is None:
        return match
    shortest = [x for x in of if not any(y != x and y in x for y in of)]
    seen = F.lit(False)
    for x in shortest:
        seen = seen | F.contains(text, F.lit(x))
    return F.when(seen, match).otherwise(F.when(text.isNotNull(), False))


def _parts(pattern: str) -> list[str]:
    """The alternatives that a pattern's test is made of, each with the pattern's boundaries."""
    bounded = re.fullmatch(r"\\b\((?!\?)(.*)\)\\b", pattern, re.S)
    if bounded and (parts := _alternatives(bounded[1])):
        return [rf"\b(?:{x})\b" for x in parts]
    grouped = re.fullmatch(r"\((?!\?)(.*)\)", pattern, re.S)
    return (_alternatives(grouped[1]) if grouped else []) or _alternatives(pattern)


def plain_part(alt: str) -> tuple[str, bool]:
    """The longest text, in lower case, that every match of an alternative holds, and whether the alternative is nothing else.

    What is optional, repeated, a class or inside of a group tells nothing.
    """
    runs, whole, k, depth, inside = [""], True, 0, 0, False
    if bounded := re.fullmatch(r"\\b\(\?:([^()|]*)\)\\b", alt):
        return plain_part(bounded[1])[0], False
    while k < len(alt):
        c = alt[k : k + 2] if alt[k] == "\\" else alt[k]
        k += len(c)
        if inside or depth:
            inside = (inside or c == "[") and c != "]"
            depth += 0 if inside else (c == "(") - (c == ")")
            continue
        plain = c[1] if len(c) == 2 and not c[1].isalnum() else c if len(c) == 1 and c not in "[(.^$?*+{}" else None
        if plain is not None:
            runs[-1] += plain
            continue
        whole, inside, depth = False, c == "[", int(c == "(")
        if c in "?*{":
            runs[-1] = runs[-1][:-1]
        if c == "{":
            k = alt.index("}", k) + 1
        runs.append("")
    return max(runs, key=len).lower(), whole


def lowered(text: Column) -> Column:
    """The text in lower case for ``met``: letters that only folding makes equal to others become those."""
    odd = "\u017f\u1c80\u1c81\u1c82\u1c83\u1c84\u1c85\u1c86"
    return let(F.lower(text), lambda low: F.when(any_part(low, odd), F.translate(low, odd, "s\u0432\u0434\u043e\u0441\u0442\u0442\u044a")).otherwise(low))


def met(low: Column, pattern: str) -> Column:
    """``has`` for a text of ``lowered``, alternative by alternative: plain text is looked for as such, an expression only where its longest plain part stands."""
    out, behind = F.lit(False), {}
    for alt in _parts(pattern):
        part, whole = plain_part(alt)
        if whole and part:
            out = out | F.contains(low, F.lit(part))
        else:
            behind.setdefault((part,) if len(part) > 1 else _group_parts(alt), []).append(alt)
    for parts, alts in behind.items():
        rule = F.rlike(low, F.lit(java("|".join(alts), fold=bool(re.search("[A-Z]", "".join(alts))))))
        out = out | (any_part(low, parts) & rule if parts else rule)
    return out


def _group_parts(alt: str) -> tuple[str, ...]:
    """The plain parts of which a match holds one at least, by the first group that has one in each of its alternatives."""
    for group in re.findall(r"\((?:\?:)?([^()]*)\)(?![?*{])", alt):
        parts = [plain_part(x)[0] for x in _alternatives(group)]
        if parts and min(map(len, parts)) > 1:
            return tuple(x for x in dict.fromkeys(parts) if not any(y != x and y in x for y in parts))
    return ()


def any_part(low: Column, parts: Iterable[str]) -> Column:
    """Whether a text holds one of these strings."""
    out = F.lit(False)
    for x in parts:
        out = out | F.contains(low, F.lit(x))
    return out


def first(text: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, java(pattern), group), F.lit(""))


#: Characters beyond U+FFFF, which count as two where texts are counted in UTF-16, and the mark that stands for their second half.
ASTRAL, HALF = "[\\x{10000}-\\x{10FFFF}]", "\uE000"


def around(text: Column, pattern: str, before: int, after: int) -> Column:
    """The first match with up to so many characters, counted in UTF-16, on its sides, or null.

    It is found by its place, as a pattern for it would try each start; ``regexp_instr`` counts in UTF-16, ``substring``
    doesn't, so a mark stands for the second half of a character that counts as two.  One that the window cuts goes.
    """
    rule = java(pattern)
    halves = lambda x: F.when(F.rlike(x, F.lit(ASTRAL)), F.regexp_replace(x, f"({ASTRAL})", f"$1{HALF}")).otherwise(x)
    place = F.struct(F.regexp_instr(text, F.lit(rule)).alias("at"), F.length(halves(F.regexp_extract(text, rule, 0))).alias("size"))
    low = lambda p: F.greatest(p["at"] - before, F.lit(1))
    cut = lambda p: F.when(p["at"] > 0, F.substring(halves(text), low(p), p["at"] + p["size"] + after - low(p)))
    whole = lambda w: F.when(F.rlike(w, F.lit(f"{ASTRAL}|{HALF}")), F.regexp_replace(w, f"{ASTRAL}(?!{HALF})|{HALF}", "")).otherwise(w)
    return let(let(place, cut), whole)


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(group))


def replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, java(pattern), by)


def sql_has(text: str, pattern: str) -> str:
    """The same test in DuckDB."""
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({text}, '(?i){quoted}')"
