"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions import fixed


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """White space of every kind to single spaces, ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(text(c), fixed.SPACE_JAVA, " "))


def squeeze_lower(c: Column) -> Column:
    return F.lower(squeeze(c))


def words_pattern(terms: tuple[str, ...]) -> str:
    """Any of the terms as whole words, whatever the case."""
    return r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(terms) + r")([^\p{L}\p{N}_]|$)"


def has_words(c: Column, terms: tuple[str, ...]) -> Column:
    return text(c).rlike(words_pattern(terms))


def keyword_flag(c: Column, terms: tuple[str, ...] = fixed.KEYWORDS) -> Column:
    return has_words(c, terms).cast("int")


def token_estimate(c: Column) -> Column:
    """Runs of white space plus one."""
    return F.regexp_count(text(c), F.lit(fixed.SPACE_JAVA)) + 1


def strip_outer_punct(c: Column) -> Column:
    return F.btrim(text(c), F.lit(fixed.OUTER_PUNCT))


def split_camel(c: Column) -> Column:
    return squeeze(F.regexp_replace(text(c), "([a-z])(?=[A-Z])", "$1 "))


def ner_text(c: Column, limit: int = fixed.NER_CHARS) -> Column:
    """Cut first, squeezed then: offsets count in the squeezed text."""
    return squeeze(F.left(text(c), F.lit(limit)))


def title_case(c: Column, keep: str = "^[^a-z]{1,4}$") -> Column:
    """Word by word: short capitals stay, plain letters are capitalised, the rest is unchanged."""
    word = lambda w: (
        F.when(w.rlike(keep) & w.rlike("[A-Z]"), w)
        .when(w.rlike("^[A-Za-z]+$"), F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1_000_000))))
        .otherwise(w))
    return F.array_join(F.transform(F.split(squeeze(c), " "), word), " ")


def compact(c: Column, limit: int, mark: str = " ...") -> Column:
    """At most ``limit`` characters and then the mark, so the result may be longer by the mark."""
    s = squeeze(c)
    return F.when(F.length(s) > limit, F.concat(F.rtrim(F.left(s, F.lit(limit))), F.lit(mark))).otherwise(s)


def length_bucket(n: Column) -> Column:
    return F.when(n < 40, "short").when(n < 120, "medium").otherwise("long")


def suspect(c: Column) -> Column:
    """1 for sentences that look like page furniture, by rules in order."""
    t = text(c)
    return (
        F.when(F.length(t) < 25, 1)
        .when(has_words(t, fixed.MENU_TERMS), 1)
        .when(t.rlike(fixed.URL_MARKS), 1)
        .when(t.rlike(fixed.SCRIPT_MARKS), 1)
        .when(has_words(t, fixed.SOCIAL_TERMS) & (F.length(t) < 120), 1)
        .when(~t.rlike(r"[\p{L}\p{N}]"), 1)
        .when(~t.rlike("[.!?]") & (F.regexp_count(t, F.lit("[A-Za-z]")) < 20), 1)
        .otherwise(0)
    )


def topic_text(c: Column) -> Column:
    """Line ends made one kind, addresses to a token, squeezed."""
    t = F.regexp_replace(text(c), "\r\n?", "\n")
    return squeeze(F.regexp_replace(t, r"(https?://|www\.)[^\s]+", " URLTOKEN "))


def sha1_hex(c: Column) -> Column:
    return F.sha1(text(c).cast("binary"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def short_label(c: Column, limit: int) -> Column:
    """The part before ``||``, underscores as spaces, cut with an ellipsis."""
    s = F.replace(F.substring_index(text(c), "||", 1), F.lit("_"), F.lit(" "))
    return F.when(F.length(s) > limit, F.concat(F.left(s, F.lit(limit - 1)), F.lit("…"))).otherwise(s)


def labelled_input(fields: list[tuple[str, Column, bool]]) -> Column:
    """Lines ``label: value``; lines of optional fields vanish when the value is empty."""
    lines = []
    for label, value, optional in fields:
        line = F.concat(F.lit(f"{label}: "), value)
        lines.append(F.when(value != "", line) if optional else line)
    return F.concat_ws("\n", *lines)
