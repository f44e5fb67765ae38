"""Text expressions: cleaning, emoticons, hashtags, tokens and n-grams.

``[\\p{L}\\p{N}_]`` is used as the word class, so accented and non-Latin words
stay whole.  Patterns use possessive quantifiers where they can: whole texts are
processed and must not exhaust the matcher's stack.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from epiflux.functions.fixed_values import STOP_WORDS, TERM_RULES

# What counts as markup, link, number, emoticon, hashtag and token.
NONWORDS = r"(?i)<[^>]++>|https?://[!$-_a-z]++|(?:\d++,?+)++(?:\.?\d++)?+"
EMOTICON = r"[:=;][oO\-]?[D)\](/\\OpP]?"
HASHTAG = r"(?:^|\s)(#[\p{L}\p{N}_]+)"
TOKEN = r"[\p{L}\p{N}_]{2,}+"
HASHTAG_LIST = r"u'hashtags': (.*?), u'urls':"

_TAG_LIST = "array<struct<text:string>>"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_nonwords(value) -> Column:
    """Remove HTML tags, links and numbers."""
    return F.regexp_replace(_col(value), NONWORDS, "")


def normalize_terms(value) -> Column:
    """Rewrite spelling families to one term, rule after rule."""
    text = _col(value)
    for pattern, term in TERM_RULES:
        text = F.regexp_replace(text, pattern, term)
    return text


def prepare_text(value) -> Column:
    return normalize_terms(strip_nonwords(value))


def emoticons(value) -> Column:
    """All emoticons in reading order; link prefixes are taken out first."""
    text = F.regexp_replace(_col(value), "https?://", "")
    return F.regexp_extract_all(text, F.lit(EMOTICON), F.lit(0))


def hashtags(value) -> Column:
    """Lower-cased hashtags that start a word."""
    return F.regexp_extract_all(F.lower(_col(value)), F.lit(HASHTAG), F.lit(1))


def entity_hashtags(value) -> Column:
    """Distinct hashtag texts of a stringified entities field.

    NULL without a hashtag list; ``['']`` when the list is empty or unreadable.
    """
    text = _col(value)
    found = text.rlike(HASHTAG_LIST)
    listed = F.regexp_extract(text, HASHTAG_LIST, 1)
    # the u of a u'...' literal only follows an opening mark
    listed = F.regexp_replace(listed, r"(^|[\[{,: ])u'", "$1'")
    listed = F.regexp_replace(listed, "'", '"')
    parsed = F.from_json(listed, _TAG_LIST, {"mode": "PERMISSIVE"})
    tags = F.array_sort(F.array_distinct(F.filter(parsed["text"], lambda tag: tag.isNotNull())))
    complete = (F.size(parsed) > 0) & (F.size(F.filter(parsed["text"], lambda tag: tag.isNull())) == 0)
    return F.when(
        found, F.when(complete, tags).otherwise(F.array(F.lit("")))
    )


def tokens(value, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Words of two or more characters that are no stop words, repeats kept."""
    words = F.regexp_extract_all(_col(value), F.lit(TOKEN), F.lit(0))
    stop = list(stop_words)
    return F.filter(words, lambda word: ~word.isin(stop)) if stop else words


def with_bigrams(words) -> Column:
    """Words followed by the pairs of neighbouring words."""
    words = _col(words)
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda left, right: F.concat_ws(" ", left, right),
    )
    return F.concat(words, pairs)


def single_line(value) -> Column:
    """Tabs and newlines become spaces, for line-based sinks."""
    return F.translate(_col(value), "\t\n", "  ")
