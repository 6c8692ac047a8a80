"""Folding, n-grams, redaction, clipping and paths as Column expressions.

Lengths are in code points. Only Unicode normalisation and stemming, which Spark lacks, are Python functions.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.functions import patterns as P
from turnstone.functions.batches import by_value

_composed = by_value(T.StringType(), lambda t: None if t is None else unicodedata.normalize("NFC", t))


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nfc(text: Column | str) -> Column:
    """Canonical composition. Below U+0300 nothing composes; only texts with other characters are sent to Python."""
    text = col(text)
    return F.coalesce(_composed(F.when(text.rlike(P.MAY_COMPOSE), text)), text)


def has_cjk(text: Column | str) -> Column:
    return col(text).rlike(f"[{P.CJK}]")


def cjk_spans(text: Column | str) -> Column:
    """Runs of CJK characters, in order."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(f"[{P.CJK}]+"), F.lit(0))


def span_grams(span: Column) -> Column:
    """Overlapping grams of two and three characters, by place; a single character is its own gram."""
    n = F.char_length(span)
    two_three = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)),
            lambda i: F.when(i + 2 <= n, F.array(F.substring(span, i, 2), F.substring(span, i, 3))).otherwise(F.array(F.substring(span, i, 2))),
        )
    )
    return F.when(n == 1, F.array(span)).otherwise(two_three)


def cjk_grams(*texts: Column | str) -> Column:
    """Distinct grams of all texts in the order they're first seen."""
    spans = F.concat(*[cjk_spans(t) for t in texts])
    return F.array_distinct(F.flatten(F.transform(spans, span_grams)))


def latin_fold(text: Column | str) -> Column:
    """ASCII words, numbers and the signs of paths, in lower case; everything else is one blank. Expects composed text."""
    out = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[^A-Za-z0-9_./:@+-]+", " ")
    return F.lower(F.trim(out))


def query_tokens(text: Column | str) -> Column:
    """The folded words of a query: two characters at least, the first 64."""
    return F.slice(F.filter(F.split(latin_fold(text), " "), lambda t: F.char_length(t) >= 2), 1, P.MAX_QUERY_TOKENS)


def mask_secrets(text: Column | str) -> Column:
    """Secrets replaced, pattern after pattern. A pattern whose hint the text lacks is not searched for."""
    text = col(text)
    lower, out = F.lower(text), text
    for (pattern, label), hint in zip(P.SECRETS, P.SECRET_HINTS, strict=True):
        able = text.rlike(P.LONG_RUN)
        if hint:
            able = F.contains(lower, F.lit(hint[0]))
            for h in hint[1:]:
                able = able | F.contains(lower, F.lit(h))
        # Below a lambda what was replaced so far is made once, though it's named twice.
        out = F.get(F.transform(F.array(out), lambda x: F.when(able, F.regexp_replace(x, F.lit(pattern), F.lit(label))).otherwise(x)), F.lit(0))  # noqa: B023
    return out


def cut(text: Column | str, most: int) -> Column:
    """The first characters with a note of how much is gone."""
    out = col(text)
    n = F.char_length(out)
    return F.when(n > most, F.concat(F.substring(out, 1, most), F.lit("\n…[truncated "), (n - most).cast("string"), F.lit(" chars]"))).otherwise(out)


def redact(text: Column | str, most: int = 12_000) -> Column:
    """Secrets replaced, then cut; null is empty. For long texts mask into a column first, and cut that."""
    return cut(mask_secrets(F.coalesce(col(text), F.lit(""))), most)


def clip(text: Column | str, most: int) -> Column:
    out = F.coalesce(col(text), F.lit(""))
    return F.when(F.char_length(out) <= most, out).otherwise(F.concat(F.substring(out, 1, most), F.lit("…")))


def is_sensitive(path: Column | str) -> Column:
    path = col(path)
    return F.element_at(F.split(path, r"[/\\]"), -1).rlike(P.SENSITIVE_PATH) | path.rlike(P.SENSITIVE_PATH)


def display_path(path: Column | str, root: Column | str, home: str | None = None) -> Column:
    """Relative to the project where inside it, from ``~`` where below the home folder, else as it is."""
    slashed, base = (F.replace(col(x), F.lit("\\"), F.lit("/")) for x in (path, root))
    out = F.when(slashed == base, F.lit(".")).when(F.startswith(slashed, F.concat(base, F.lit("/"))), F.substr(slashed, F.char_length(base) + 2))
    if home:
        below = home.replace("\\", "/") + "/"
        out = out.when(F.startswith(slashed, F.lit(below)), F.concat(F.lit("~/"), F.substr(slashed, F.lit(len(below) + 1))))
    return out.otherwise(slashed)


def squeeze(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"[{P.BLANK}]+", " ")


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"^[{P.BLANK}]+|[{P.BLANK}]+$", "")


def sentences(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), P.SENTENCE_END), strip), lambda s: s != "")


def first_of(arguments: Column | str, names: tuple[str, ...]) -> Column:
    """The first value that isn't blank among the names, by exact name, then whatever the case. ``arguments``: a map of strings."""
    arguments = col(arguments)
    exact = [F.try_element_at(arguments, F.lit(n)) for n in names]

    def named(name: str) -> Column:
        return F.try_element_at(F.filter(F.map_entries(arguments), lambda e: F.lower(e["key"]) == name.lower()), F.lit(-1))["value"]

    loose = [named(n) for n in names]
    some = lambda v: F.when(strip(v) != "", v)
    return F.coalesce(*[some(v) for v in [*exact, *loose]])
