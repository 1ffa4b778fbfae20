"""Text functions with the semantics of Python's str methods, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """str.strip(): all Unicode white space; null stays null."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def py_tokens(c: Column | str) -> Column:
    """str.split(): runs of white space, no empty tokens; null gives null."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    """len(str.split()) without building the tokens; null counts 0."""
    return F.coalesce(F.regexp_count(col(c), F.lit(r"(?U)\S+")), F.lit(0))


def falsy(c: Column | str, other: Column | str) -> Column:
    """`a or b`: b where a is null or empty."""
    return F.coalesce(F.nullif(col(c), F.lit("")), col(other))


def sentences(c: Column | str, longer_than: int = 0) -> Column:
    """Parts between full stops (decimals split too), stripped, longer than `longer_than` characters."""
    return F.filter(F.transform(F.split(col(c), r"\."), py_strip), lambda s: F.length(s) > longer_than)


def regex_sentences(c: Column | str) -> Column:
    """Parts between runs of . ! ?, stripped, without empty ones."""
    return F.filter(F.transform(F.split(col(c), r"[.!?]+"), py_strip), lambda s: s != "")


def first_sentence(c: Column | str) -> Column:
    return F.split_part(col(c), F.lit("."), F.lit(1))


def after_last(c: Column | str, marker: str) -> Column:
    """The stripped text after the last marker, the whole text if there is none."""
    return py_strip(F.split_part(col(c), F.lit(marker), F.lit(-1)))


def tagged(c: Column | str, tag: str, whole: bool = False) -> Column:
    """What stands between <tag> and </tag>, over lines; if there is none, the whole text or an empty one."""
    c = col(c)
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(c.rlike(pattern), py_strip(F.regexp_extract(c, pattern, 1))).otherwise(py_strip(c) if whole else F.when(c.isNotNull(), ""))


def normalized_answer(c: Column | str) -> Column:
    """Lower case, stripped, without anything but letters, numbers, underscores and white space."""
    return py_strip(F.regexp_replace(py_strip(F.lower(col(c))), r"(?U)[^\p{L}\p{N}_\s]", ""))


def unfenced(c: Column | str) -> Column:
    """The first fenced block of a Markdown text without its language, the text itself if there is none."""
    c = col(c)
    block = F.try_element_at(F.split(c, "```"), F.lit(2))
    return py_strip(F.regexp_replace(F.coalesce(block, c), r"^json", ""))


def first_object(c: Column | str) -> Column:
    """The first {...} without nesting, null if there is none."""
    return F.nullif(F.regexp_extract(col(c), r"(?s)\{[^}]+\}", 0), F.lit(""))


def outer_object(c: Column | str) -> Column:
    """From the first { to the last }, null if there is none."""
    return F.nullif(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), F.lit(""))


def ngrams(tokens: Column | str, n: int) -> Column:
    """The n-grams of an array, joined by spaces; fewer tokens than n give an empty array. The array should be a column that
    isn't computed in the same projection, or it is computed again for each n-gram."""
    t = col(tokens)
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def has_any(c: Column | str, bank: tuple[str, ...]) -> Column:
    """1.0 if a word of the bank stands anywhere in the lower-case text, else 0.0; null gives 0.0."""
    lower = F.lower(col(c))
    hit = F.lit(False)
    for word in bank:
        hit = hit | F.contains(lower, F.lit(word))
    return F.coalesce(hit.cast("double"), F.lit(0.0))


def hits(c: Column | str, bank: tuple[str, ...]) -> Column:
    """The words of the bank that stand in the lower-case text, in the bank's order."""
    lower = F.lower(col(c))
    return F.array_compact(F.array(*[F.when(F.contains(lower, F.lit(w)), F.lit(w)) for w in bank]))


def template(pattern: str, **parts: Column | str) -> Column:
    """str.format with named fields: each {name} is replaced by its column; null stands empty."""
    out: list[Column] = []
    at = 0
    for match in re.finditer(r"\{(\w+)\}", pattern):
        out += [F.lit(pattern[at : match.start()]), F.coalesce(col(parts[match[1]]).cast("string"), F.lit(""))]
        at = match.end()
    return F.concat(*out, F.lit(pattern[at:]))


def zero_padded(c: Column | str, width: int) -> Column:
    """f"{n:0{width}d}": longer numbers stay whole."""
    return F.format_string(f"%0{width}d", col(c).cast("long"))


def first_or_scalar(c: Column | str) -> Column:
    """Of a JSON text: the first element of an array, the text of a scalar; null for an empty array."""
    c = col(c)
    return F.when(F.ltrim(c).startswith("["), F.try_variant_get(F.try_parse_json(c), "$[0]", "string")).otherwise(c)


def video_id(c: Column | str) -> Column:
    """Ids stay strings; a trailing .0 of a number is taken off."""
    return F.regexp_replace(py_strip(c), r"\.0$", "")
