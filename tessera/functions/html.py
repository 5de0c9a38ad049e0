"""HTML extraction as column expressions.

A page is parsed with regular expressions only, so extraction is a narrow
projection: no shuffle, no Python, one pass over the ``html`` column.

Rules (the page is first stripped of <script>, <style> and comments, in the
order in which they begin; one that is not closed goes to the end of the page;
a '>' inside a quoted attribute does not end a tag):
  * title: text of the first <title>; 'No title found' when the tag is
    absent, null when it is empty;
  * headings: h1-h3 in document order, inner markup removed, stripped;
  * paragraphs: every <p ...> opens a paragraph that ends at </p>, at the
    next <p>, at a block element's start, at the end of its enclosing block
    (HTML5 implied end tag) or at the end of the page;
  * links: every href of an <a> tag, quoted or not, duplicates kept, not made
    absolute.
Entities are decoded last.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws, _c, ColumnOrName

# Named entities: those of HTML 4 and XML, a no-break space read as a blank.
ENTITIES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'", "nbsp": " "}
RE_ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"

NO_TITLE = "No title found"

# What follows a tag's name up to its end: a '>' inside a quoted value is no end;
# where quotes don't pair up, the first '>' is.
TAG_REST = r"""(?:(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)"""
# Comments, scripts and styles, whichever begins first; an open one goes to the end.
RE_HIDDEN = r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style)\b.*?(?:</\1\s*>|\z)"
RE_TITLE_TAG = r"(?i)<title\b"
RE_TITLE = rf"(?is)<title\b{TAG_REST}(.*?)</title\s*>"
RE_HEADING = rf"(?is)<h[1-3]\b{TAG_REST}(.*?)</h[1-3]\s*>"
RE_P_OPEN = rf"(?i)<p(?=[\s>]){TAG_REST}"
RE_BLOCK_CLOSE = r"(?i)(</(?:article|div|body|section|td|li|main|html)\s*>)"
RE_BLOCK_OPEN = (r"(?i)(<(?:address|article|aside|blockquote|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|main|nav|ol|pre|"
                 r"section|table|ul)\b)")
RE_PARAGRAPH = r"(?s)<p>(.*?)</p>"
VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
# The attributes before the first one that is named href, then its value.
RE_HREF = (rf"""(?is)<a(?=[\s/])(?:[\s/]*+(?!href\s*=)[^\s"'>=/]++(?:\s*+=\s*+{VALUE})?+|[\s/]*+["'=])*+"""
           rf"""[\s/]*+href\s*=\s*{VALUE}""")
RE_QUOTES = r"""^["']|["']$"""
RE_TAG = f"<{TAG_REST}"


def decode_entities(c: ColumnOrName) -> Column:
    """Every entity once, from left to right ('&amp;lt;' is the text '&lt;');
    decimal, hexadecimal and named ones; anything else stays as it is."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def code_point(n: Column) -> Column:
        ok = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, RE_ENTITY, 1)
        ch = (F.when(F.lower(name).startswith("#x"), code_point(F.conv(F.substr(name, F.lit(3)), 16, 10).cast("long")))
              .when(name.startswith("#"), code_point(F.substr(name, F.lit(2)).cast("long")))
              .when(name != "", names[name]))
        return F.when(ch.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(ch, F.substr(p, F.length(name) + 2)))

    c = _c(c)
    decoded = F.transform(F.split(c, "&"), lambda p, i: F.when(i == 0, p).otherwise(piece(p)))
    return F.when(F.contains(c, F.lit("&")), F.array_join(decoded, "")).otherwise(c)


def content_html(html: ColumnOrName) -> Column:
    """HTML without scripts, styles and comments."""
    return F.regexp_replace(_c(html), RE_HIDDEN, "")


def text_of(fragment: Column) -> Column:
    """Markup removed, entities decoded, whitespace stripped."""
    return strip_ws(decode_entities(F.regexp_replace(fragment, RE_TAG, "")))


def page_title(clean: ColumnOrName) -> Column:
    """H01 on cleaned HTML."""
    c = _c(clean)
    raw = F.regexp_extract(c, RE_TITLE, 1)
    return (F.when(~c.rlike(RE_TITLE_TAG), F.lit(NO_TITLE))
            .otherwise(F.nullif(decode_entities(raw), F.lit(""))))


def page_headings(clean: ColumnOrName) -> Column:
    """Array of h1-h3 texts in document order."""
    return F.transform(F.regexp_extract_all(_c(clean), F.lit(RE_HEADING), F.lit(1)), text_of)


def page_paragraphs(clean: ColumnOrName) -> Column:
    """Array of paragraph texts in document order."""
    h = F.regexp_replace(_c(clean), RE_P_OPEN, "</p><p>")
    h = F.regexp_replace(F.regexp_replace(h, RE_BLOCK_CLOSE, "</p>$1"), RE_BLOCK_OPEN, "</p>$1")
    h = F.concat(h, F.lit("</p>"))           # the last one may be open
    return F.transform(F.regexp_extract_all(h, F.lit(RE_PARAGRAPH), F.lit(1)), text_of)


def page_links(clean: ColumnOrName) -> Column:
    """Array of href values (quotes removed, entities decoded)."""
    quoted = F.regexp_extract_all(_c(clean), F.lit(RE_HREF), F.lit(2))
    return F.transform(quoted, lambda q: decode_entities(F.regexp_replace(q, RE_QUOTES, "")))


def page_text(headings: ColumnOrName, paragraphs: ColumnOrName) -> Column:
    """Headings then paragraphs joined by a space (uncut)."""
    return F.array_join(F.concat(_c(headings), _c(paragraphs)), " ")
