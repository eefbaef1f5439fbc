"""Bit fields and their values in free text, English and Chinese; and the repair of cut-off JSON.  Arrow functions: run
grouping and sentence logic don't fit column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def _text(x: object) -> str:
    return x if isinstance(x, str) else ""


FIELD = "array<struct<offset: int, size: int, convention: string>>"

# English positions count from 0 and Chinese ones from 1; both are examples of how such documents write them.
_EN_RANGE = re.compile(r"bits?\s*(\d+)\s*(?:to|through|-|~|至|到)\s*(?:bits?\s*)?(\d+)", re.I)
_EN_ONE = re.compile(r"bit\s*(\d+)", re.I)
_ZH_RANGE = re.compile(r"第\s*(\d+)\s*位?\s*(?:到|至|-|~)\s*第?\s*(\d+)\s*位")
_ZH_PAIR = re.compile(r"第\s*(\d+)\s*位?\s*(?:和|、)\s*第?\s*(\d+)\s*位")
_ZH_ONE = re.compile(r"第\s*(\d+)\s*位")


def fields_of(text: str | None) -> list[tuple[int, int, str]]:
    """(offset, size, convention) of each field, ranges first, then pairs, then single bits; distinct by offset and size.  A single Chinese position inside
    a Chinese range or adjacent pair is part of that field and none of its own."""
    out: list[tuple[int, int, str]] = []
    seen: set[tuple[int, int]] = set()
    inside: set[int] = set()
    rest = text or ""

    def add(low: int, high: int, how: str) -> None:
        if (key := (low, high - low + 1)) not in seen and low >= 0:
            seen.add(key)
            out.append((*key, how))

    def taken(pattern: re.Pattern, use) -> None:
        nonlocal rest
        for m in pattern.finditer(rest):
            use(*(int(g) for g in m.groups()))
        rest = pattern.sub(lambda m: " " * len(m[0]), rest)

    taken(_EN_RANGE, lambda a, b: add(min(a, b), max(a, b), "en"))

    def span(a: int, b: int) -> None:
        inside.update(range(min(a, b), max(a, b) + 1))
        add(min(a, b) - 1, max(a, b) - 1, "zh")

    def pair(a: int, b: int) -> None:
        if abs(a - b) == 1:
            span(a, b)
        else:
            add(a - 1, a - 1, "zh")
            add(b - 1, b - 1, "zh")

    taken(_ZH_RANGE, span)
    taken(_ZH_PAIR, pair)
    taken(_EN_ONE, lambda a: add(a, a, "en"))
    taken(_ZH_ONE, lambda a: None if a in inside else add(a - 1, a - 1, "zh"))
    return out


def bit_fields(text: Column) -> Column:
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [{"offset": a, "size": n, "convention": c} for a, n, c in fields_of(_text(x))])

    return F.pandas_udf(run, FIELD)(text)


# How an assertion is written (quotes, words that set, patterns of pairs and of single bits), and the words that deny one.
_QUOTED = r"[\"'“‘]?\s*([01])(?!\d)\s*[\"'”’]?"
_ZH_SET, _EN_SET = "(?:设置为|设为|置为|为|=|＝)", r"(?:set\s+to|=|＝|are|as|is|设置为|设为|置为|为)"
_ZH_VALUES = re.compile(rf"第\s*(\d+)\s*位?\s*[和、与]\s*第?\s*(\d+)\s*位.{{0,20}}?{_ZH_SET}\s*{_QUOTED}\s*[和、与,，]\s*{_QUOTED}")
_EN_VALUES = re.compile(rf"bits?\s*(\d+)\s+and\s+(?:bit\s*)?(\d+)(?:(?!bit\s*\d).)*?{_EN_SET}\s*{_QUOTED}\s*(?:and|,)\s*{_QUOTED}", re.I)
_ZH_VALUE = re.compile(rf"第\s*(\d+)\s*位.{{0,10}}?{_ZH_SET}\s*{_QUOTED}")
_EN_VALUE = re.compile(rf"(?<![A-Za-z])bit\s*(\d+)(?:(?!bit\s*\d).){{0,10}}?{_EN_SET}\s*{_QUOTED}", re.I)
# What denies an assertion inside of it, and what denies it from before, in its sentence.
_DENIED_INSIDE = re.compile(r"[不未非禁勿]|\b(?:not|never|no)\b", re.I)
_DENIED_BEFORE = re.compile(r"不得|禁止|不应|不可|不能|不允许|无需|无须|不要|切勿|\b(?:not|never|no)\b", re.I)


def _asserted(sentence: str, pattern: re.Pattern) -> list[re.Match]:
    """Matches in a sentence that nothing inside or before them denies; what is said after them doesn't matter."""
    first = _DENIED_BEFORE.search(sentence)
    return [m for m in pattern.finditer(sentence) if not _DENIED_INSIDE.search(m[0]) and (first is None or m.start() < first.end())]


def _two(bits: dict[int, int]) -> tuple[int, int, int]:
    low, high = sorted(bits)
    return low, 2, 2 * bits[high] + bits[low]


def values_of(text: str | None) -> list[tuple[int, int, int]]:
    """(offset, size 2, value) for two adjacent bits that a sentence sets, in text order, unless it denies that before or inside of the assertion; the higher bit counts more.
    They are set as a pair ("bits 9 and 10 are 1 and 0", values in quotes or not), or one after the other ("bit8=0, bit9=0"): exactly two neighbours in a row."""
    out = []
    for sentence in re.split(r"[.;。；\n]", text or ""):
        found: dict[int, tuple[int, int, int]] = {}  # by place
        rest = sentence
        for pattern, base in ((_EN_VALUES, 0), (_ZH_VALUES, 1)):
            for m in _asserted(sentence, pattern):
                bits = {int(m[1]) - base: int(m[3]), int(m[2]) - base: int(m[4])}
                if max(bits) - min(bits) == 1:
                    found[m.start()] = _two(bits)
            rest = pattern.sub(lambda m: " " * len(m[0]), rest)
        # bits set one by one, those of the two ways to count apart; a run ends where the next is no neighbour
        single = sorted((m.start(), base, int(m[1]) - base, int(m[2])) for pattern, base in ((_EN_VALUE, 0), (_ZH_VALUE, 1)) for m in _asserted(rest, pattern))
        ends = [i for i in range(1, len(single) + 1) if i == len(single) or single[i][1] != single[i - 1][1] or abs(single[i][2] - single[i - 1][2]) != 1]
        for begin, end in zip([0, *ends], ends, strict=False):
            if end - begin == 2:
                found[single[begin][0]] = _two({bit: value for _, _, bit, value in single[begin:end]})
        out += [found[at] for at in sorted(found)]
    return list(dict.fromkeys(out))


def bit_values(text: Column) -> Column:
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [{"offset": a, "size": n, "value": v} for a, n, v in values_of(_text(x))])

    return F.pandas_udf(run, "array<struct<offset: int, size: int, value: int>>")(text)


def repaired(text: str | None) -> str | None:
    """The first JSON object of a model's answer: thoughts and fences taken off, and what is cut off closed; null without any."""
    t = re.sub(r"<think>.*?(</think>|$)", "", text or "", flags=re.S)
    at = t.find("{")
    if at < 0:
        return None
    closing, quoted, escaped, end = [], False, False, None
    for i, c in enumerate(t[at:], at):
        if quoted:
            quoted, escaped = (True, c == "\\" and not escaped) if escaped or c != '"' else (False, False)
        elif c == '"':
            quoted = True
        elif c in "{[":
            closing.append("}" if c == "{" else "]")
        elif c in "}]":
            if not closing or closing.pop() != c:
                return None
            if not closing:
                end = i + 1
                break
    body = t[at:end] if end else t[at:].rstrip("\\" if escaped else "") + '"' * quoted
    for candidate in (body, body.rstrip().rstrip(","), re.sub(r',?\s*"[^"]*"\s*:?\s*$', "", body)):
        candidate += "" if end else "".join(reversed(closing))
        try:
            json.loads(candidate)
        except ValueError:
            continue
        return candidate
    return None


def repaired_json(text: Column) -> Column:
    return F.pandas_udf(lambda t: t.map(lambda x: repaired(_text(x))), "string")(text)
