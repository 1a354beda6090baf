"""Column builders without a window: rounding, maths, dates and text."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s+"
#: A small English stop list; callers pass their own for another corpus.
STOP_WORDS = (
    "a about after again all am an and any are as at be because been before being both but by can did do does doing down during each few "
    "for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on "
    "once only or other our out over own same she so some such than that the their them then there these they this those through to too "
    "under until up very was we were what when where which while who whom why will with you your"
).split()


def rounded(x: Column, digits: int) -> Column:
    """Round half to even on the scaled double (what numpy does)."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def polarity(positive: Column, negative: Column) -> Column:
    return positive - negative


def softmax(*logits: Column) -> list[Column]:
    """Stable: the largest logit is taken off first."""
    top = F.greatest(*logits)
    total = sum((F.exp(x - top) for x in logits[1:]), F.exp(logits[0] - top))
    return [F.exp(x - top) / total for x in logits]


def direction(x: Column) -> Column:
    """1 where x > 0, else 0; null stays null."""
    return (x > 0).cast("int")


def clipped(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null (greatest and least would skip it)."""
    made = x
    if low is not None:
        made = F.when(made < low, F.lit(low)).otherwise(made)
    if high is not None:
        made = F.when(made > high, F.lit(high)).otherwise(made)
    return made


def min_max(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low); a constant column becomes 0."""
    return (x - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)


def min_max_inverse(z: Column, low: Column, high: Column) -> Column:
    return z * F.when(high == low, F.lit(1.0)).otherwise(high - low) + low


def loose_timestamp(text: Column) -> Column:
    """Null where the text is no timestamp."""
    return F.try_to_timestamp(text)


def strict_date(text: Column) -> Column:
    """yyyy-MM-dd; anything else is an error (ANSI mode)."""
    return F.to_date(text, "yyyy-MM-dd")


def iso_local(text: Column) -> Column:
    """The wall-clock time of an ISO text; a numeric offset is cut off, not applied. A trailing Z is not an offset."""
    return F.try_to_timestamp(F.regexp_replace(text, r"[+-]\d{2}:\d{2}$", ""))


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def day_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def without_zone(stamp: Column) -> Column:
    return stamp.cast("timestamp_ntz")


def newlines_to_stops(text: Column) -> Column:
    """Runs of line ends become '. '; both ends are stripped of white space."""
    return stripped(F.regexp_replace(text, r"[\n\r]+", ". "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def squeezed(text: Column) -> Column:
    """White space (no-break space too) collapses to one space."""
    return stripped(F.regexp_replace(text, WS, " "))


def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def unescaped(text: Column) -> Column:
    """HTML entities decoded; there is no built-in for it."""
    return F.pandas_udf(_unescape, "string")(text)


def without_teasers(text: Column) -> Column:
    """Cuts a teaser ('ALSO READ', 5 to 300 characters) up to the full stop that ends it; the stop stays."""
    end = r"(?=\.\s+[A-Z]|\.\s*$)"
    return F.regexp_replace(text, rf"(?s)ALSO\s*READ\s*[:\-\u2013]?\s*.{{5,300}}?{end}", "")


def clean_article(text: Column) -> Column:
    return squeezed(without_teasers(unescaped(text)))


def source_domain(url: Column) -> Column:
    """First two labels of the host, without www; null where there is none."""
    return F.nullif(F.regexp_extract(url, r"https?://(?:www\.)?([\w\-]+\.\w+)", 1), F.lit(""))


def section_of(url: Column) -> Column:
    return F.when(url.contains("/business/"), "Business").when(url.contains("/market/"), "Market").otherwise("Other")


def is_article_url(url: Column, host: str, excluded: tuple[str, ...] = ()) -> Column:
    """Of the host, ends in -digits or /digits, and holds none of the excluded parts."""
    made = url.contains(host) & url.rlike(r"[-/]\d+/?$")
    for part in excluded:
        made = made & ~url.contains(part)
    return made


def alnum_only(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^a-zA-Z0-9\s]", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda t: t != "")


def without_stop_words(words: Column, stop: list[str] = STOP_WORDS) -> Column:
    """A filter, not a set difference: repeated words stay."""
    listed = F.array(*map(F.lit, stop))
    return F.filter(words, lambda t: ~F.array_contains(listed, t))


_IRREGULAR = {"men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose", "people": "people", "news": "news", "series": "series"}


def lemma(word: Column) -> Column:
    """Noun lemma by suffix rules and a list of exceptions (stands in for a dictionary, which would plug in here)."""
    rules = (
        F.when(word.rlike("[^aeiou]ies$") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ss|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("[^su]s$") & (F.length(word) > 3), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )
    for plural, singular in _IRREGULAR.items():
        rules = F.when(word == plural, F.lit(singular)).otherwise(rules)
    return rules


def normalised_text(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Lower case, letters and digits only, no stop words, nouns in their base form, joined by spaces."""
    return F.array_join(F.transform(without_stop_words(tokens(alnum_only(F.lower(text))), stop), lemma), " ")


def title_and_body(title: Column, body: Column, sep: str = ". ", body_max: int | None = 300, most: int | None = 512) -> Column:
    """Nulls count as empty; the body and the whole are cut at their limits."""
    body = F.coalesce(body, F.lit(""))
    made = F.concat(F.coalesce(title, F.lit("")), F.lit(sep), F.substring(body, 1, body_max) if body_max else body)
    return F.substring(made, 1, most) if most else made


def or_neutral(text: Column) -> Column:
    """A null or blank text becomes 'neutral'."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit("neutral")).otherwise(text)


def without_suffix(name: Column, suffix: str) -> Column:
    return F.regexp_replace(name, F.lit("\\Q" + suffix + "\\E$"), F.lit(""))


def token_windows(words: Column, size: int = 510, overlap: int = 256) -> Column:
    """Windows of ``size`` content tokens that overlap by ``overlap`` of size + 2; none for no tokens, the last ends with the text."""
    step = size + 2 - 2 - overlap
    n = F.size(words)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / F.lit(step))).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(words, i * step + 1, F.lit(size)))


def encoded_windows(ids: Column, size: int = 510, overlap: int = 256, first: int = 101, last: int = 102, pad: int = 0) -> Column:
    """Sub-word ids as windows of size + 2: a special id in front, one behind, padded to full length; with the mask of what is no padding."""

    def window(w):
        whole = F.concat(F.array(F.lit(first)), w, F.array(F.lit(last)))
        fill = F.lit(size + 2) - F.size(whole)
        ones, zeros = F.array_repeat(F.lit(1), F.size(whole)), F.array_repeat(F.lit(0), fill)
        return F.struct(F.concat(whole, F.array_repeat(F.lit(pad), fill)).alias("ids"), F.concat(ones, zeros).alias("mask"))

    return F.transform(token_windows(ids.cast("array<int>"), size, overlap), window)
