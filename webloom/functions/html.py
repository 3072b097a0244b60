"""Links, words and titles of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns that decide what counts as a tag, a link, a word, a heading, a paragraph and a title.
TAG, HREF, QUOTED_HREF = "<([^/][^>]*)>", "href=", r'(?i)<a\s+(?:[^>]*?\s+)?href="([^"]*)"'
CLEAN_TAG, PUNCTUATION, LINE_ENDS = "<.*?>", "[.,:;!?'\"()-]", r"[\t\n\r]"
SCRIPT, STYLE, ANY_TAG, NO_LETTER = "(?s)<script[^>]*>.*?</script>", "(?s)<style[^>]*>.*?</style>", "<[^>]+>", "[^a-zA-Z ]"
HEADING, PARAGRAPH = "(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", "(?is)<p[^>]*>(.*?)</p>"
HEAD, TITLE = "(?is)<head[^>]*>(.*?)</head>", "(?is)<title[^>]*>(.*?)</title>"


def extract_links(html: Column) -> Column:
    """Targets of ``a`` elements, in order: each part of the tag with ``href=``, without its first and last character."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(TAG), F.lit(1)), lambda t: F.lower(F.split(t, r"\s+")[0]) == "a")
    parts = F.flatten(F.transform(tags, lambda t: F.filter(F.split(t, r"\s+"), lambda x: F.contains(x, F.lit(HREF)))))
    values = F.filter(F.transform(parts, lambda x: F.substring(x, F.locate("=", x) + 1, F.length(x))), lambda x: F.length(x) > 1)
    return F.transform(values, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def extract_quoted_links(html: Column) -> Column:
    """Targets of ``a`` elements whose href is in double quotes, trimmed."""
    return F.transform(F.regexp_extract_all(html, F.lit(QUOTED_HREF), F.lit(1)), lambda x: F.trim(x))


def page_clean(html: Column) -> Column:
    """The page in lower case with tags (that end on their line), punctuation and line ends as spaces."""
    bare = F.regexp_replace(F.lower(html), CLEAN_TAG, " ")
    return F.regexp_replace(F.regexp_replace(bare, PUNCTUATION, " "), LINE_ENDS, " ")


def page_words(html: Column) -> Column:
    """Distinct words of ``page_clean``."""
    return F.array_distinct(F.array_remove(F.split(page_clean(html), " "), ""))


def html_text(html: Column) -> Column:
    """Letters a to z and white space of a page without scripts, styles and tags."""
    text = F.regexp_replace(F.regexp_replace(html, SCRIPT, " "), STYLE, " ")
    return F.lower(F.regexp_replace(F.regexp_replace(text, ANY_TAG, " "), NO_LETTER, " "))


def words_of(text: Column) -> Column:
    """What stands between spaces, repeats included."""
    return F.filter(F.split(text, " +"), lambda x: x != "")


def html_words(html: Column) -> Column:
    """Words of ``html_text``, repeats included."""
    return words_of(html_text(html))


def html_word_total(html: Column) -> Column:
    """What term frequencies are divided by: the words, less one if the text doesn't begin with a space."""
    return F.size(html_words(html)) - F.when(html_text(html).startswith(" "), 0).otherwise(1)


def heading_paragraph_words(html: Column) -> Column:
    """Words of all headings, then of all paragraphs, repeats included."""
    blocks = F.concat(F.regexp_extract_all(html, F.lit(HEADING), F.lit(1)), F.regexp_extract_all(html, F.lit(PARAGRAPH), F.lit(1)))
    clean = F.transform(blocks, lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, ANY_TAG, " "), NO_LETTER, " ")))
    return words_of(F.array_join(clean, " "))


def page_title(html: Column) -> Column:
    """The first title within the first head; null without one."""
    inside = F.regexp_extract(html, HEAD, 1)
    return F.when(html.rlike(HEAD) & inside.rlike(TITLE), F.regexp_extract(inside, TITLE, 1))
