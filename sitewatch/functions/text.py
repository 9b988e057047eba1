"""HTML text functions: visible text, fingerprint, title, description.

No DOM is built.  The recipe below is a fixed sequence of JVM regular
expressions; it reproduces the text a forgiving HTML parser returns (blocks removed with their content, tags removed with
nothing in their place, entities decoded, whitespace collapsed).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) -------------------
# Elements removed together with their content before text is taken.
REMOVED_ELEMENTS = ("script", "style", "noscript", "iframe")
# Numeric references (&#NNN; / &#xHH;, semicolon optional): code points 0x80-0x9F follow the Windows-1252 table of the
# HTML standard:
WINDOWS_1252_C1 = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021,
    0x88: 0x02C6, 0x89: 0x2030, 0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8E: 0x017D, 0x91: 0x2018,
    0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022, 0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC,
    0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A, 0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}
# C1 code points kept as they are (no Windows-1252 meaning).
C1_KEPT = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
# ---------------------------------------------------------------------------

# what may be a reference, as far as it may go
REF_RE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"

# a tag begins with a letter, "/", "!" or "?" and may hold ">" inside quotes; what never ends goes to the end
ATTRIBUTES_RE = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
BLOCKS_RE = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(
    rf"<{t}(?=[\s/>]){ATTRIBUTES_RE}>.*?(?:</{t}(?=[\s/>])[^>]*>|\z)" for t in REMOVED_ELEMENTS)
TAG_RE = rf"(?s)<[A-Za-z/!?]{ATTRIBUTES_RE}>|<[A-Za-z/!?][^>]*>"
SPACE_RE = r"(?U)\s+"
EDGE_SPACE_RE = r"(?U)^\s+|\s+$"
TITLE_RE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
# First <meta> whose name attribute is exactly "description" (value compared
# case-sensitively, attribute order free).
META_DESC_TAG_RE = (
    r"(?is)<meta(?=\s)(?=[^>]*?\sname\s*=\s*(?:\"(?-i:description)\"|'(?-i:description)'"
    r"|(?-i:description)(?=[\s/>])))[^>]*>")
CONTENT_ATTR_RE = r"(?is)\scontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_blocks(html) -> Column:
    """Remove comments and script/style/noscript/iframe elements with content."""
    return F.regexp_replace(_col(html), BLOCKS_RE, "")


def _let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable once (``body`` may use it often
    without copying the expression tree)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _char_of_numeric_ref(ref: Column) -> Column:
    """The character a numeric reference stands for, as the HTML standard (and
    Python's ``html.unescape``) decodes it; built from UTF-16 code units."""
    digits = F.regexp_extract(ref, r"&#[xX]?([0-9a-fA-F]+)", 1)
    is_hex = F.regexp_extract(ref, r"&#([xX]?)", 1) != ""
    # more than 7 significant digits is beyond U+10FFFF in either base
    too_long = F.length(F.regexp_replace(digits, "^0+", "")) > 7
    raw = (F.when(too_long, F.lit(0x110000)).when(is_hex, F.conv(digits, 16, 10).cast("long"))
           .otherwise(digits.cast("long")))

    def remap(c):
        mapped = None
        for k, v in WINDOWS_1252_C1.items():
            mapped = (F.when(c == k, F.lit(v)) if mapped is None else mapped.when(c == k, F.lit(v)))
        return mapped.otherwise(c)

    def to_char(cp):
        bad = (cp == 0) | cp.between(0xD800, 0xDFFF) | (cp > 0x10FFFF)
        dropped = (cp.between(0x1, 0x8) | (cp == 0xB) | cp.between(0xE, 0x1F) | cp.between(0x7F, 0x9F)
                   | cp.between(0xFDD0, 0xFDEF) | ((cp.bitwiseAND(0xFFFE)) == 0xFFFE))
        dropped = dropped & ~cp.isin(*C1_KEPT) & ~cp.isin(*WINDOWS_1252_C1.values())

        def units(c):
            hi = F.lit(0xD800) + F.shiftright(c - 0x10000, 10)
            lo = F.lit(0xDC00) + (c - 0x10000).bitwiseAND(0x3FF)
            return (F.when(c < 0x10000, F.lpad(F.hex(c), 4, "0"))
                    .otherwise(F.concat(F.lpad(F.hex(hi), 4, "0"), F.lpad(F.hex(lo), 4, "0"))))
        safe = F.when(bad, F.lit(0xFFFD).cast("long")).otherwise(cp)
        return F.when(dropped, F.lit("")).otherwise(F.decode(F.unhex(_let(safe, units)), "UTF-16BE"))

    return _let(_let(raw, remap).cast("long"), to_char)


@functools.lru_cache(maxsize=1)
def _named_refs() -> tuple[str, str, int]:
    """JSON maps of all named references, and of those that need no semicolon, with
    the longest of the latter; the table is the standard library's."""
    import json
    from html.entities import html5
    short = {k: v for k, v in html5.items() if not k.endswith(";")}
    return json.dumps(html5), json.dumps(short), max(map(len, short))


def _decoded_ref(ref: Column) -> Column:
    """What a reference stands for: a number's character, the named one, the longest
    name it begins with and the rest, or itself."""
    every, short, longest = _named_refs()
    kind = "map<string,string>"
    name = F.substring(ref, 2, 40)
    # constants: the optimizer parses each map once
    named = F.element_at(F.from_json(F.lit(every), kind), name)
    prefixes = [F.concat(F.element_at(F.from_json(F.lit(short), kind), F.substring(name, 1, n)), F.substring(name, n + 1, 40))
                for n in range(longest, 1, -1)]
    return F.when(ref.startswith("&#"), _char_of_numeric_ref(ref)).otherwise(F.coalesce(named, *prefixes, ref))


def decode_entities(text) -> Column:
    """Every character reference decoded as ``html.unescape`` of the standard library
    does it, in the JVM: the text is cut at its references and put together again.
    Texts without "&" skip the work."""
    t = _col(text)
    between = F.split(t, REF_RE, -1)
    refs = F.transform(F.regexp_extract_all(t, F.lit(REF_RE), 0), _decoded_ref)
    whole = F.array_join(F.zip_with(between, F.concat(refs, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(F.instr(t, "&") > 0, whole).otherwise(t)


def py_strip(text) -> Column:
    """Python-style ``str.strip()``: trims Unicode whitespace, not only blanks."""
    return F.regexp_replace(_col(text), EDGE_SPACE_RE, "")


def collapse_space(text) -> Column:
    return F.trim(F.regexp_replace(_col(text), SPACE_RE, " "))


def visible_text_from_stripped(stripped) -> Column:
    """Text of a document whose blocks were already removed (see ``strip_blocks``)."""
    return collapse_space(decode_entities(F.regexp_replace(_col(stripped), TAG_RE, "")))


def visible_text(html) -> Column:
    """Visible text; no separator between tags; whitespace collapsed; trimmed."""
    return visible_text_from_stripped(strip_blocks(html))


def fingerprint(html) -> Column:
    """SHA-256 hex of the UTF-8 visible text."""
    return F.sha2(visible_text(html), 256)


def title_from_stripped(stripped) -> Column:
    """P5 on a block-stripped document: first <title>, entities decoded, stripped."""
    return py_strip(decode_entities(F.regexp_extract(_col(stripped), TITLE_RE, 1)))


def title(html) -> Column:
    """P5: text of the first <title> ('' if none)."""
    return title_from_stripped(strip_blocks(html))


def description_raw_from_stripped(stripped) -> Column:
    """The undecoded content attribute of the first description meta tag."""
    tag = F.regexp_extract(_col(stripped), META_DESC_TAG_RE, 0)
    return F.concat(F.regexp_extract(tag, CONTENT_ATTR_RE, 1),
                    F.regexp_extract(tag, CONTENT_ATTR_RE, 2),
                    F.regexp_extract(tag, CONTENT_ATTR_RE, 3))


def description_from_stripped(stripped) -> Column:
    """P6 on a block-stripped document."""
    return py_strip(decode_entities(description_raw_from_stripped(stripped)))


def description(html) -> Column:
    """Content of the first <meta name="description"> ('' if missing/empty)."""
    return description_from_stripped(strip_blocks(html))
