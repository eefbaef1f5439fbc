"""Scalar text functions of the traceability analysis, as column expressions.

Every vocabulary is an argument; nothing here knows the words of a project.  Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _alternatives(words: Sequence[str]) -> str:
    """A case-insensitive pattern that finds any of the words; none of them finds nothing."""
    return "(?i)(" + "|".join(f"\\Q{w}\\E" for w in words) + ")" if words else "$^"


def labels(text: Column) -> Column:
    """Label numbers: every L followed by digits in either case, wherever it stands, upper-case, first-seen order, distinct."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("([Ll][0-9]+)"), F.lit(1)), F.upper))


def category(text: Column, analog: Sequence[str], discrete: Sequence[str], bus: Sequence[str]) -> Column:
    """label, analog, discrete, bus or other: the first whose evidence the text has."""
    return (
        F.when(F.size(labels(text)) > 0, "label").when(text.rlike(_alternatives(analog)), "analog")
        .when(text.rlike(_alternatives(discrete)), "discrete").when(text.rlike(_alternatives(bus)), "bus").otherwise("other")
    )


def direction(text: Column, strong_send: Sequence[str], strong_receive: Sequence[str], send: Sequence[str], receive: Sequence[str]) -> Column:
    """send or receive if only one side has strong words; else if only one side has any; else ''."""
    s, r = text.rlike(_alternatives(strong_send)), text.rlike(_alternatives(strong_receive))
    a, b = text.rlike(_alternatives([*strong_send, *send])), text.rlike(_alternatives([*strong_receive, *receive]))
    return F.when(s & ~r, "send").when(r & ~s, "receive").when(a & ~b, "send").when(b & ~a, "receive").otherwise("")


_SDI = r"(?:^|[^A-Za-z0-9_])SDI[ :=]*([0-9]+)"


def sdi_first(text: Column) -> Column:
    return F.regexp_extract(text, _SDI, 1)


def sdi_all(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_SDI), F.lit(1)))


def name_parts(name: Column) -> Column:
    """Words of a compound name: cut at _ - and blanks, at camel case and at digits, lower-case, without pure digits, distinct."""
    parts = F.regexp_extract_all(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), F.lit("([A-Za-z]+)"), F.lit(1))
    return F.array_distinct(F.transform(parts, F.lower))


def identifier_parts(name: Column, noise: Sequence[str] = ()) -> Column:
    """The whole identifier in upper case, then its fragments of 3 characters or more; noise words left out.  What isn't an identifier gives none."""
    up = F.upper(name)
    parts = F.concat(F.array(up), F.filter(F.split(up, "[_/]"), lambda p: F.length(p) >= 3))
    good = F.array_distinct(F.filter(parts, lambda p: ~p.isin(list(noise)) if noise else F.lit(True)))
    return F.when(name.rlike("^[A-Za-z][A-Za-z0-9_]{2,}$"), good).otherwise(F.array().cast("array<string>"))


def text_identifiers(text: Column, noise: Sequence[str] = ()) -> Column:
    """All identifier parts of a text, distinct."""
    found = F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9_]{2,})"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(found, lambda n: identifier_parts(n, noise))))


def text_tokens(text: Column, noise: Sequence[str] = (), phrases: dict[str, str] | None = None) -> Column:
    """The identifier parts of a text, and the token of each phrase of a ruleset's dictionary that it holds (see `phrases`); distinct."""
    if not phrases:
        return text_identifiers(text, noise)
    from .phrases import phrase_tokens

    return F.array_union(text_identifiers(text, noise), phrase_tokens(text, phrases))


def profile_key(path: Column) -> Column:
    """Label/leaf for a dotted path with a segment that begins with L and digits (the label alone where the leaf is it), else parent/leaf."""
    seg = F.split(path, "\\.")
    label = F.regexp_extract(F.element_at(F.filter(seg, lambda s: s.rlike("^L[0-9]+")), 1), "^(L[0-9]+)", 1)
    at = F.array_position(F.transform(seg, lambda s: s.rlike("^L[0-9]+")), True)
    leaf = F.element_at(seg, -1)
    parent = F.when(F.size(seg) > 1, F.element_at(seg, -2)).otherwise("")
    return F.when((at > 0) & (at == F.size(seg)), F.concat(label, F.lit("/__label__"))).when(at > 0, F.concat_ws("/", label, leaf)).otherwise(F.concat_ws("/", parent, leaf))


_FAMILY = r"^L[0-9]+_(?:[0-9]+_)?[A-Z]+[0-9]+_"


def family(leaf: Column) -> Column:
    """A leaf without its label, message and channel prefix."""
    return F.regexp_replace(leaf, _FAMILY, "")


def block_key(path: Column) -> Column:
    """Label/family of a labelled path, the profile key of another."""
    key = profile_key(path)
    return F.when(key.rlike("^L[0-9]+/"), F.concat_ws("/", F.split_part(key, F.lit("/"), F.lit(1)), family(F.split_part(key, F.lit("/"), F.lit(2))))).otherwise(key)


def protocol(bus: Column, path: Column) -> Column:
    """Protocol class from the bus, the path and whether it has a label."""
    labelled = path.rlike("(^|\\.)L[0-9]+")
    return F.when(labelled, "labelled_word").when(F.upper(bus).startswith("CAN"), "frame").when(F.lower(bus).contains("discrete"), "discrete").when(F.lower(bus).contains("analog"), "analog").otherwise("unsupported")


def identity_key(protocol_class: Column, device: Column, path: Column) -> Column:
    leaf = F.element_at(F.split(path, "\\."), -1)
    return F.when(protocol_class == "labelled_word", block_key(path)).when(protocol_class.isin("discrete", "analog"), family(leaf)).otherwise(F.concat_ws("/", device, family(leaf)))


def channels(text: Column) -> Column:
    """Channel names A1..B4 that stand alone, sorted, distinct."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda c: c.rlike("^[AB][1-4]$"))))


def specificity(word: Column) -> Column:
    """precise with digits after 3 letters or more, or 8 letters; moderate from 5 letters; else generic."""
    letters, digits = F.length(F.regexp_extract(word, "^([A-Za-z]+)", 1)), F.length(F.regexp_extract(word, "([0-9]+)$", 1))
    return F.when(((letters >= 3) & (digits > 0)) | (letters >= 8), "precise").when(letters >= 5, "moderate").otherwise("generic")


def boundary_match(word: Column, name: Column) -> Column:
    """Whether the word is the name, a part of it at _ on either side, or after _ and before a digit; a digit never runs on into another one."""
    w, n = F.lower(word), F.lower(name)
    at = F.instr(n, w)
    before, after = F.substring(n, at - 1, F.lit(1)), F.substring(n, at + F.length(w), F.lit(1))
    runs_on = after.rlike("^[0-9]$") & w.rlike("[0-9]$")
    inner = (at > 1) & (before == "_") & ((after == "_") | (after.rlike("^[0-9]$") & ~runs_on))
    return (w == n) | F.startswith(n, F.concat(w, F.lit("_"))) | F.endswith(n, F.concat(F.lit("_"), w)) | inner


def strip_suffix(word: Column, suffixes: Sequence[str]) -> Column:
    """One suffix off, where more than it is there."""
    return F.regexp_replace(word, "(.)(" + "|".join(f"\\Q{s}\\E" for s in sorted(suffixes, key=len, reverse=True)) + ")$", "$1") if suffixes else word


def has_named_component(text: Column) -> Column:
    return text.rlike("(^|[^A-Za-z0-9])[A-Za-z]{2,}[0-9]+([^A-Za-z0-9]|$)")


def channel_suffix(name: Column) -> Column:
    """The n and letter of a trailing _R<n>[letter]; '' without."""
    return F.regexp_extract(name, "_R([0-9]+[a-z]?)$", 1)


def signal_numbers(text: Column, constants: Sequence[str] = ()) -> Column:
    """Numbers of three digits or more, without known constants, first-seen order."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("([0-9]{3,})"), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, constants)).cast("array<string>"))


def listed_names(text: Column, noise: Sequence[str] = ()) -> Column:
    """Upper-case names with at least one _, order kept, distinct, noise left out."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)"), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, noise)).cast("array<string>"))


def protocol_hint(text: Column, words: Sequence[str]) -> Column:
    """Whether a text speaks of protocol fields: one of the words, or a bit at one of the label's places."""
    return text.rlike(_alternatives(words)) | text.rlike("(?i)bits? *[1-8]([^0-9]|$)")


def plain_name(name: Column) -> Column:
    """A name without its RX_, TX_ and DS prefixes, however many, in upper case."""
    return F.regexp_replace(F.upper(name), "^(RX_|TX_|DS[0-9]*_)+", "")


def sign_text(kind: Column, range_min: Column, offset: Column, size: Column) -> Column:
    """What a negative range proves of a BNR field: it is a two's complement number whose highest bit is the sign, inside its size.  Bits count from 1, offsets from 0; '' where any of it is
    missing or the range is not negative."""
    top = offset.cast("long") + size.cast("long")
    said = F.format_string("bits %d to %d begin at %s and so hold a two's complement number: bit %d (offset %d) is its sign, one of the %d", offset.cast("long") + 1, top, range_min.cast("string"), top, top - 1, size.cast("long"))
    number = F.regexp_extract(F.regexp_replace(range_min.cast("string"), ",", ""), r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when((F.trim(kind) == "BNR") & (number < 0) & offset.isNotNull() & size.isNotNull(), said).otherwise("")


def pair_value(positions: Column, values: Column) -> Column:
    """The code of bits set one by one: the higher bit counts more."""
    pairs = F.array_sort(F.arrays_zip(positions.alias("p"), values.alias("v")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(1).alias("m")), lambda a, x: F.struct((a["n"] + a["m"] * x["v"]).cast("int").alias("n"), (a["m"] * 2).cast("int").alias("m")), lambda a: a["n"])


def span_text(offset: Column, size: Column) -> Column:
    return F.when(size == 1, F.format_string("bit %d", offset)).otherwise(F.format_string("bits %d-%d", offset, offset + size - 1))


def octal(label: Column, digits: int = 3) -> Column:
    """Padded with zeros, never cut."""
    return F.when(F.length(label) < digits, F.lpad(label, digits, "0")).otherwise(label)


def stars(n: Column) -> Column:
    return F.concat(F.repeat(F.lit("*"), n), F.repeat(F.lit("."), 5 - n))


def star_label(n: Column) -> Column:
    return F.when(n >= 5, "full agreement").when(n == 4, "agreement in substance").when(n == 3, "majority").when(n == 2, "key disagreement").otherwise("no consensus")


def first_number(text: Column) -> Column:
    """The first signed decimal of a display string such as '12 bits'."""
    return F.regexp_extract(text, "(-?[0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double")


def display_path(names: Column) -> Column:
    """Layer names joined by dots, without empty ones and without a name that repeats the one before it."""
    full = F.filter(F.transform(names, lambda n: F.trim(F.coalesce(n, F.lit("")))), lambda n: n != "")
    return F.array_join(F.filter(full, lambda x, i: (i == 0) | (x != F.get(full, i - 1))), ".")


def has_frame_word(name: Column, words: Sequence[str]) -> Column:
    parts = F.concat(F.split(F.lower(name), "[._ -]"), F.array(F.lower(name)))
    return F.arrays_overlap(parts, F.array(*map(F.lit, words)))


def bus_type(tag: Column, name: Column, prefixes: Sequence[str], inner: Sequence[str]) -> Column:
    """The first prefix that the tag begins with, else the first word that it has; then the same of the full name; else ''."""
    tests = [(F.upper(c).startswith(p), p) for c in (tag, name) for p in prefixes]
    tests = tests[: len(prefixes)] + [(F.upper(tag).contains(w), w) for w in inner] + tests[len(prefixes) :] + [(F.upper(name).contains(w), w) for w in inner]
    out = F.lit("")
    for test, word in reversed(tests):
        out = F.when(F.coalesce(test, F.lit(False)), word).otherwise(out)
    return out


def repaired_names(text: Column) -> Column:
    """White space after _ taken out."""
    return F.regexp_replace(text, "_\\s+", "_")


def category_name(value: Column, names: dict[str, str]) -> Column:
    """The name under which a category is shown; one without a name shows itself."""
    out = value
    for k, shown in names.items():
        out = F.when(value == k, shown).otherwise(out)
    return out


def with_synonyms(words: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(req_id, word): each word (req_id, word) and all of the first synonym group (g, canonical, alias) that has it."""
    m = synonyms.select("g", F.col("canonical").alias("word")).union(synonyms.select("g", "alias")).distinct()
    first = words.join(m, "word").groupBy("req_id", "word").agg(F.min("g").alias("g")).select("req_id", "g")
    return words.select("req_id", "word").union(first.join(m, "g").select("req_id", "word")).distinct()


def lists_with_synonyms(lists: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(req_id, words): all words of a requirement's lists (req_id, words) and their synonyms (see `with_synonyms`), sorted; none for requirements without a word.  Lists are looked up once for all
    requirements that have them, and no word of a requirement is shuffled by itself."""
    own = lists.groupBy("req_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("words")))).alias("own"))
    each = own.select("own").distinct().select(F.col("own").alias("req_id"), F.explode("own").alias("word"))
    full = with_synonyms(each, synonyms).groupBy(F.col("req_id").alias("own")).agg(F.array_sort(F.collect_list("word")).alias("words"))
    return own.join(full, "own").select("req_id", "words")


def coded_meanings(values: DataFrame, fields: DataFrame) -> DataFrame:
    """(case_id, offset, size, value, field, coded): each assembled value (case_id, offset, size, value) with the first field (case_id, offset, size, name, coded, ord) of its case at the same
    bits that has a coded set, and that set if all such fields have the same one; null where there is none."""
    known = fields.where(F.trim(F.coalesce("coded", F.lit(""))) != "").groupBy("case_id", "offset", "size").agg(
        F.min_by("name", "ord").alias("field"), F.min(F.trim("coded")).alias("_least"), F.max(F.trim("coded")).alias("_most"))
    out = values.join(known, ["case_id", "offset", "size"], "left")
    return out.withColumn("coded", F.when(F.col("_least") == F.col("_most"), F.col("_least"))).drop("_least", "_most")
