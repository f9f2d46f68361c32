"""Column functions over text: white space, tokens, hashes, page markers.

White space is that of ECMAScript, spelt out: neither Java's ``\\s`` nor its
Unicode variant has exactly these characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space and line terminators of ECMAScript.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: Any character but a line terminator of ECMAScript.
DOT = r"[^\n\r\u2028\u2029]"
#: The same characters, each once.
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_MARKER = "<!-- page ([0-9]+) -->"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.trim(_col(c), F.lit(WS_CHARS))


def ws_tokens(c: Column | str) -> Column:
    """Tokens between white space; none for blank text, null for null."""
    bare = strip(c)
    return F.when(bare == "", F.array().cast("array<string>")).when(bare.isNotNull(), F.split(bare, f"{WS}+"))


def token_count(c: Column | str) -> Column:
    """Number of tokens, an int."""
    bare = strip(c)
    return F.when(bare == "", F.lit(0)).when(bare.isNotNull(), F.regexp_count(bare, F.lit(f"{WS}+")) + 1)


def normalize_text(c: Column | str) -> Column:
    """Lower case, stripped, runs of white space as one space."""
    return F.regexp_replace(strip(F.lower(_col(c))), f"{WS}+", " ")


def content_hash(c: Column | str) -> Column:
    """SHA-256 of the normalised text, as lower-case hex."""
    return F.sha2(normalize_text(c), 256)


def split_pages(c: Column | str) -> Column:
    """Pages of form-feed separated text: (page_num from 1, text), stripped; blank pages leave gaps in the numbers."""
    pages = F.transform(F.split(_col(c), "\f", -1), lambda t, i: F.struct((i + 1).alias("page_num"), strip(t).alias("text")))
    return F.filter(pages, lambda p: p.text != "")


def inject_page_marker(text: Column | str, page: Column | str) -> Column:
    """The page's marker as a line of its own: after the first line that is not blank if it begins with ``#``, else in front."""
    text, page = _col(text), _col(page)
    marker = F.concat(F.lit("<!-- page "), page.cast("string"), F.lit(" -->"))
    # Blank lines, then a line whose first character that is not white space is #.
    head = F.regexp_extract(text, rf"^(?:{WS}*\n)?(?:(?!\n){WS})*#[^\n]*", 0)
    behind = F.concat(head, F.lit("\n"), marker, F.substr(text, F.length(head) + 1))
    return F.when(head != "", behind).otherwise(F.concat(marker, F.lit("\n"), text))


def join_pages(pages: Column | str) -> Column:
    """One text of an array of (page_num, text), each page with its marker, two line breaks between."""
    return F.array_join(F.transform(_col(pages), lambda p: inject_page_marker(p.text, p.page_num)), "\n\n")


def page_of(c: Column | str) -> Column:
    """Number of the last page marker in a text, as a string; empty without one."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(_col(c), F.lit(_MARKER), 1), F.lit(-1)), F.lit(""))


def without_markers(c: Column | str) -> Column:
    """The text without page markers, stripped."""
    return strip(F.regexp_replace(_col(c), "<!-- page [0-9]+ -->\n?", ""))


def search_text(path: Column | str, text: Column | str) -> Column:
    """Headings joined by " > " in front of the text, which stands alone without any."""
    path, text = _col(path), _col(text)
    return F.when(F.size(path) == 0, text).otherwise(F.concat(F.array_join(path, " > "), F.lit("\n\n"), text))
