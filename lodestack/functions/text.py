"""Text expressions: tokens, headings, headings' labels, page artifacts, math signals, keywords, entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.strip sees it, and the patterns of headings, pages, citations and math.
WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
MARKDOWN = r"^(#{1,6})\s+(.+)$"
NUMBERED = r"^(\d+(?:\.\d+)*)[.\s]+([A-Z].{2,})$"
CAPITALS = r"^[A-Z0-9\s\-–—:,./()]{3,79}$"
REFERENCE_NAMES = ("references", "bibliography", "works cited")
REFERENCES = (r"(?i)^[ \t]*(?:#{1,6}[ \t]+)?(?:\d+(?:\.\d+)*\.?[ \t]+|Section[ \t]+\d+(?:\.\d+)*[ \t]*[:.\-][ \t]+)?"
              r"(?:References|Bibliography|Works[ \t]+Cited|Citations)[ \t]*[:.\-]?[ \t]*$")
SPACED_REFERENCES = r"(?i)^[ \t]*R[ \t]E[ \t]F[ \t]E[ \t]R[ \t]E[ \t]N[ \t]C[ \t]E[ \t]?S?[ \t]*$"
PAGE = r"(?i)^(?:Page\s*)?\d+(?:\s*of\s*\d+)?\s*$"
OPENER = r"^\s*\[\d+(?:\s*,\s*\d+)*\]\s+\S"
AUTHOR = r"\b[A-Z][a-z]+,\s+[A-Z]\."
YEAR = r"\b(?:19|20)\d{2}[a-z]?\b"
YEAR_BRACKET = r"[\(\[](?:19|20)\d{2}[a-z]?[\)\]]"
DOI = r"(?i)\bdoi\s*:\s*10\.\d{4,}"
ARXIV = r"(?i)\barxiv\s*:\s*\d{4}\.\d{4,}"
URL = r"(?i)https?://\S+"
URL_WORD = r"^(?:https?://|ftp://|www\.)|^[0-9a-fA-F\-]{20,}$"
DISPLAY_MATH = r"(?s)\$\$.*?\$\$|\\begin\{(equation|align|eqnarray|gather)(\*?)\}.*?\\end\{\1\2\}"
INLINE_MATH = r"(?<!\$)\$(?!\$)[^\n$]+?(?<!\$)\$(?!\$)|(?s)\\\(.+?\\\)"
GREEK = "[αβγδεζηθικλμνξοπρστυφχψωΓΔΘΛΞΠΣΦΨΩ∂∇\U0001d400-\U0001d7ff]"
MATH_SYMBOL = "[∑∫∏√∞≤≥≠≈⟨⟩⊕⊗⋅]"
RAISED = "[₀-₉⁰-⁹²³¹]"
_LETTER = "A-Za-zΑ-Ωα-ω\U0001d400-\U0001d7ff"
FUNCTION = rf"(?<![{_LETTER}])[{_LETTER}]\([{_LETTER}·][\s,)·|]"
# Stop words of keywords, English and Persian.
STOP_EN = """
    a an the this that these those and or but if then else for of to in on at by with without from as is are was were be been being do does did has
    have had it its it's they them their we us our you your i me my he she his her not no yes can could should would may might must will shall about
    into over under between within across per via using use used uses also more most such than very much many some any all each both few other another
    which who whom whose what when where why how here there out up down off again only own same so
    """.split()
STOP_FA = """
    و در به از که این آن را با برای تا یا اما اگر چون های ها هم یک دو می نمی است بود شد باشد کند کرد شده خود ما شما او آنها ایشان من تو آنان
    نیز هر چه چی کجا کی چرا چگونه چند بر بی روی زیر بین درباره مورد طور همه بعضی دیگر
    """.split()


def terms(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs of two or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{2,})"), 1)


# The characters of WS.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def token_count(text: Column) -> Column:
    """Tokens without a vocabulary: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def alpha_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.length(text)).otherwise(F.lit(0.0))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def text_lines(text: Column) -> Column:
    """Non-blank lines, at every line end."""
    return F.filter(F.split(text, LINE_END), lambda x: strip(x) != "")


def heading(line: Column) -> Column:
    """struct(level, title) of a heading line, else null: Markdown, numbered, then capitals; level 1 opens a section, 2 a subsection."""
    s = strip(line)
    hashes, number = F.regexp_extract(s, MARKDOWN, 1), F.regexp_extract(s, NUMBERED, 1)

    def of(level: Column, title: Column) -> Column:
        return F.struct(level.cast("int").alias("level"), strip(title).alias("title"))

    return (F.when(s.rlike(MARKDOWN), of(F.when(F.length(hashes) == 1, 1).otherwise(2), F.regexp_extract(s, MARKDOWN, 2)))
            .when(s.rlike(NUMBERED), of(F.when(F.instr(number, ".") == 0, 1).otherwise(2), F.regexp_extract(s, NUMBERED, 2)))
            .when((F.length(s) < 80) & s.rlike(CAPITALS), of(F.lit(1), s)))


def heading_label(text: Column, longest: int = 80) -> Column:
    """A clean chapter label, or "" where the heading is of no use."""
    s = strip(F.regexp_replace(text, r"\s+", " "))
    s = strip(F.regexp_replace(s, r"^#{1,6}\s*", ""))
    s = strip(F.regexp_replace(s, r"^(?:[IVXLCDM]+\.|[A-Z]\.|(?:\d+\.)+\d*\.?)\s+", ""))
    s = strip(F.regexp_replace(s, r"[.:\-–—,;]+\s*$", ""))
    bad = F.contains(s, F.lit("�")) | (F.length(s) > longest) | ~s.rlike(r"\p{L}")
    return F.coalesce(F.when(bad, "").otherwise(s), F.lit(""))


def without_page_lines(text: Column) -> Column:
    """text without the lines that hold a page number only."""
    return F.array_join(F.filter(lines(text), lambda x: ~strip(x).rlike(PAGE)), "\n")


def is_citation(line: Column) -> Column:
    located = line.rlike(YEAR_BRACKET) | line.rlike(DOI) | line.rlike(ARXIV)
    return located & (line.rlike(OPENER) | line.rlike(AUTHOR))


def opens_references(line: Column) -> Column:
    """Whether a line is the heading of the references."""
    title = F.regexp_replace(F.lower(strip(heading(line)["title"])), "[:.]+$", "")
    named = reduce(lambda a, b: a | b, [(title == n) | title.startswith(n + " ") for n in REFERENCE_NAMES]) | (title == "citations")
    return F.coalesce(named, F.lit(False)) | line.rlike(REFERENCES) | line.rlike(SPACED_REFERENCES)


def math_signals(text: Column) -> Column:
    """How many of five independent signs of mathematics outside LaTeX are there."""
    parts = F.split(text, "=")
    near = F.exists(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.length(x) < 200)
    touched = text.rlike(r"\p{L}=|=\p{L}")
    signs = [text.rlike(GREEK), text.rlike(MATH_SYMBOL), text.rlike(RAISED), near & touched, text.rlike(FUNCTION)]
    return reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(False)).cast("int") for s in signs])


def has_math(text: Column, least: int = 2) -> Column:
    t = F.coalesce(text, F.lit(""))
    return t.rlike(DISPLAY_MATH) | t.rlike(INLINE_MATH) | (math_signals(t) >= least)


def keyword_tokens(text: Column) -> Column:
    """Content words in order: lower case, letters first, without stop words and ASCII words of two letters."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\x{200C}", ""))
    found = F.regexp_extract_all(t, F.lit(r"(?U)(?<![\w])([\p{L}][\w'’]*)"), 1)
    stop = F.array(*map(F.lit, STOP_EN + STOP_FA))
    return F.filter(found, lambda x: (F.length(x) > 1) & ~((F.length(x) == 2) & x.rlike("^[\\x00-\\x7F]+$")) & ~F.array_contains(stop, x))


def capital_runs(text: Column) -> Column:
    """Distinct names: runs of capitalised ASCII words, one space between, in order of first sight."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*)*)\b"), 1))
