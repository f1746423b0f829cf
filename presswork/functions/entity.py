"""Canonical names, types and flags of entities as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions import fixed
from presswork.functions.text import split_camel, squeeze, strip_outer_punct, text, title_case



def lookup(c: Column, table: dict[str, str]) -> Column:
    """The table's value for ``c`` or null; the table is a literal, never a join."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def entity_key(c: Column, camel: bool = True) -> Column:
    s = F.lower(split_camel(c) if camel else squeeze(c))
    s = F.regexp_replace(s, "['’]", "")
    s = F.regexp_replace(s, fixed.ENTITY_PUNCT, " ")
    return squeeze(F.regexp_replace(s, "[-_]+", " "))


def canonical_name(c: Column) -> Column:
    """Outer marks, a leading article and a trailing possessive go; then the safe names, capitals, generic terms, title case."""
    s = strip_outer_punct(split_camel(c))
    s = F.regexp_replace(s, r"(?i)^(the|a|an)\s+", "")
    s = squeeze(F.regexp_replace(s, "(?i)('s|’s)$", ""))
    k = entity_key(s)
    return (
        F.when(lookup(k, fixed.SAFE_NAMES).isNotNull(), lookup(k, fixed.SAFE_NAMES))
        .when(s.rlike("^[A-Z]{2,6}$"), s)
        .when(k.isin(*fixed.GENERIC_TECHNOLOGY), title_case(k))
        .otherwise(title_case(s))
    )


def type_name(c: Column) -> Column:
    k = squeeze(F.translate(F.lower(squeeze(c)), "-/", "  "))
    return F.coalesce(lookup(k, fixed.TYPE_NAMES), F.lit("other"))


def repaired_type(name: Column, raw: Column) -> Column:
    k = entity_key(name)
    return (
        F.when(lookup(k, fixed.TYPE_HINTS).isNotNull(), lookup(k, fixed.TYPE_HINTS))
        .when(k.isin(*fixed.GENERIC_ACTORS), "person")
        .when(k.isin(*fixed.GENERIC_PLACES), "government_institution")
        .otherwise(type_name(raw))
    )


def any_match(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def surface_name(c: Column) -> Column:
    """Second canonical name, for scored rows: outer marks and glued time fragments go; then the map, capitals, title case."""
    s = squeeze(c)
    for pattern, keep in zip(fixed.SURFACE_EDGES, ("", "", "", "$1", "")):
        s = F.regexp_replace(s, pattern, keep)
    s = squeeze(s)
    known = lookup(entity_key(s, camel=False), fixed.SURFACE_NAMES)
    return F.when(known.isNotNull(), known).when(s.rlike("^[A-Z]{2,8}$"), s).otherwise(title_case(s))


def low_value(name: Column, kind: Column) -> Column:
    """Whether a name says too little for its type: a generic actor, place or technology."""
    k = entity_key(name, camel=False)
    return F.coalesce(
        ((kind == "person") & k.isin(*fixed.GENERIC_ACTORS)) | ((kind == "government_institution") & k.isin(*fixed.GENERIC_PLACES))
        | ((kind == "technology") & k.isin(*fixed.LOW_VALUE_TECHNOLOGY)), F.lit(False))


def numeric_junk(c: Column) -> Column:
    s = squeeze(c)
    return (F.length(s) <= 1) | any_match(s, fixed.NUMBER_NAMES)


def price_like(c: Column) -> Column:
    s = squeeze(c)
    return (s == "") | any_match(s, fixed.PRICE_NAMES)


def catalog_like(c: Column) -> Column:
    s = squeeze(c)
    marks = r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(fixed.CATALOG_MARKS) + r")([^\p{L}\p{N}_]|$)"
    return any_match(s, fixed.CATALOG_NAMES) | s.rlike(marks)


def news_source(c: Column) -> Column:
    return entity_key(c).isin(*fixed.NEWS_SOURCES)


def generic_actor(c: Column) -> Column:
    return entity_key(c).isin(*fixed.GENERIC_ACTORS)


def low_value_place(c: Column) -> Column:
    k = entity_key(c)
    return k.isin(*fixed.GENERIC_PLACES) | k.rlike(fixed.NUMBERED_PLACE)


def fragment_of_person(c: Column, kind: Column) -> Column:
    s = squeeze(c)
    return (kind == "person") & ~s.contains(" ") & ((F.length(s) <= 2) | s.rlike(fixed.SINGLE_NAME))


def tier(n_docs: Column) -> Column:
    return (
        F.when(n_docs >= fixed.HEAD_DOCS, "head").when(n_docs >= fixed.MID_DOCS, "mid")
        .when(n_docs >= fixed.TAIL_DOCS, "tail").otherwise("below_tail"))


def first_matching(c: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], default: str = "Other") -> Column:
    """Category of the first rule with a pattern in the text, whatever the case."""
    t = F.lower(text(c))
    out = None
    for name, patterns in rules:
        hit = t.rlike("|".join(patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def keep_row(name: Column, kind: Column, least: int = 2) -> Column:
    """Whether a row is worth scoring: a real name, no price, promotion, fragment, weak place or weak technology."""
    s = squeeze(name)
    k = entity_key(name, camel=False)
    weak_place = (kind == "government_institution") & ~k.isin(*fixed.PLACES_KEPT) & (
        k.isin(*fixed.GENERIC_PLACES) | price_like(name) | catalog_like(name))
    weak_tech = (kind == "technology") & (
        k.isin(*fixed.WEAK_TECHNOLOGY) | k.rlike(fixed.MODEL_FAMILY) | (k.startswith("ai ") & (F.size(F.split(k, " ")) >= 3)))
    return (
        (F.length(s) >= least) & ~price_like(s) & ~catalog_like(s) & ~F.coalesce(fragment_of_person(s, kind), F.lit(False))
        & ~F.coalesce(weak_place, F.lit(False)) & ~F.coalesce(weak_tech, F.lit(False)))


def displayable(name: Column) -> Column:
    """Whether a name may be shown in rankings."""
    n = text(name)
    marks = r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(fixed.HIDDEN_WORDS) + r")([^\p{L}\p{N}_]|$)"
    return ~(any_match(n, fixed.HIDDEN_NAMES) | n.rlike(marks)) & ~entity_key(name, camel=False).isin(*fixed.WEAK_TECHNOLOGY)
