"""Column functions over text. All are null on null input and defined on the empty text; none needs Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities and what they stand for, in the order in which they are decoded.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")]
# Characters that are escaped, in order.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
# Formatting tags that may stay in text.
ALLOWED_TAGS = ["b", "i", "u", "s", "strong", "em", "sup", "sub"]
# Marks that open a list item as bullets.
BULLETS = "\\-•●○▪▫–—➤‣›▶►∙★☆*"
#: A Roman numeral up to 39; the empty text also fits and is to be excluded.
ROMAN = "x{0,3}(ix|iv|v?i{0,3})"
# Words that open an item of a structured text.
SECTION_WORDS = "section|article|part|chapter|item|note|step|appendix|references"
SECTION_WORDS_HI = "अध्याय|भाग|खंड|परिशिष्ट"
# Names of the Latin letters, written in Devanagari.
LETTER_NAMES = "ए|बी|सी|डी|ई|एफ|जी|एच|आई|जे|के|एल|एम|एन|ओ|पी|क्यू|आर|एस|टी|यू|वी|डब्ल्यू|एक्स|वाई|ज़ेड"


def squeeze(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^ | $", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def repetition_key(c: Column) -> Column:
    """The form in which a line is compared with those of other pages."""
    return F.lower(squeeze(strip_tags(c)))


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Each pair in turn, as plain text."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def decode_entities(c: Column) -> Column:
    return replace_all(c, ENTITIES)


def escape_html(c: Column) -> Column:
    return replace_all(c, ESCAPES)


def sanitize(c: Column) -> Column:
    """Everything escaped, but for the allowed formatting tags without attributes."""
    escaped = replace_all(c, ESCAPES[:3])
    return F.regexp_replace(escaped, f"&lt;(/?(?:{'|'.join(ALLOWED_TAGS)}))&gt;", "<$1>")


def plain_text(c: Column) -> Column:
    """Without tags and equation placeholders."""
    return squeeze(F.regexp_replace(strip_tags(c), r"\{\{EQ:\d+\}\}", ""))


def unescape_markdown(c: Column) -> Column:
    """Escaped asterisk, back-tick and tilde become plain; an escaped dollar stays."""
    return replace_all(c, [("\\*", "*"), ("\\`", "`"), ("\\~", "~")])


def is_roman(c: Column) -> Column:
    return (F.length(c) > 0) & F.lower(c).rlike(f"^{ROMAN}$")


def _captured_roman(c: Column, pattern: str) -> Column:
    return is_roman(F.lower(F.regexp_extract(c, pattern, 1)))


def is_list_item(c: Column) -> Column:
    """Whether a line opens with a bullet, a number, a letter, a Roman numeral up to 39 or a section word. False on the empty text."""
    shapes = [
        rf"^[{BULLETS}]\s",
        r"^([0-9०-९]+\.)+\s|^[0-9०-९]+\)\s|^\([0-9०-९]+\)\s|^\[[0-9०-९]+\]\s",
        r"^\([a-zA-Zअ-ह]\)\s|^\[[a-zA-Zअ-ह]\]\s|^[a-zA-Zअ-ह][.)]\s",
        rf"^\((?:{LETTER_NAMES})\)\s|^(?:{LETTER_NAMES})[.)]\s",
        rf"(?i)^(?:{SECTION_WORDS})\b",
        rf"^(?:{SECTION_WORDS_HI})([^\p{{L}}\p{{M}}\p{{N}}_]|$)",
    ]
    plain = reduce(lambda a, b: a | b, [c.rlike(s) for s in shapes])
    return plain | _captured_roman(c, r"(?i)^\(([ivxlcdm]+)\)\s") | _captured_roman(c, r"(?i)^([ivxlcdm]{2,})[.)]\s")


def list_level(c: Column) -> Column:
    """0: number, bullet or section word; 1: Roman numeral; 2: letter; -1: no marker. Roman numerals go before letters."""
    t = strip(c)
    return (
        F.when(t.rlike(r"^(\d+\.)+\s|^\d+\)\s|^\(\d+\)\s|^\[\d+\]\s"), 0)
        .when(_captured_roman(t, r"(?i)^\(([ivxlcdm]+)\)\s") | _captured_roman(t, r"(?i)^([ivxlcdm]{2,})[.)]\s"), 1)
        .when(t.rlike(r"^\([a-zA-Z]\)\s|^[a-zA-Z][.)]\s|^\[[a-zA-Z]\]\s"), 2)
        .when(t.rlike(rf"^[{BULLETS}]\s"), 0)
        .when(t.rlike(rf"(?i)^(?:{SECTION_WORDS})\b"), 0)
        .when(t.isNotNull(), -1)
    )


def list_prefix_strip(c: Column) -> Column:
    """Without a leading bullet, number or letter of a list."""
    return F.regexp_replace(strip(c), rf"^([{BULLETS}]|\(?[0-9०-९]+[.)]|\(?[a-zA-Z][.)])\s+", "")


def numbering_depth(c: Column) -> Column:
    """Of a title: one more than the dots in its leading number; chapter or part 1; section or article 2; else null."""
    t = strip(c)
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)\.?\s", 1)
    return F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).when(t.rlike(r"(?i)^(chapter|part)\b"), 1).when(t.rlike(r"(?i)^(section|article)\b"), 2)


def join_lines(lines: Column) -> Column:
    """Lines of an array put together: an item opens a new line; a hyphen before a lower-case letter is dropped; else a space. Empty lines are skipped; no lines: the empty text."""
    kept = F.filter(lines, lambda x: strip(x) != "")

    def step(acc: Column, line: Column) -> Column:
        t = strip(line)
        first = F.substring(t, 1, 1)
        return (
            F.when(is_list_item(t), F.concat(acc, F.lit("\n"), t))
            .when(acc.endswith("-") & (F.lower(first) == first) & (F.upper(first) != first), F.concat(F.regexp_replace(acc, "-$", ""), t))
            .otherwise(F.concat(acc, F.lit(" "), t))
        )

    return F.when(F.size(kept) > 0, F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.element_at(kept, 1), step)).otherwise(F.lit(""))


def split_references(c: Column) -> Column:
    """A line with three or more markers [n] or (n) gets a line for each."""
    many = (F.regexp_count(c, F.lit(r"\[\d+\]|\(\d+\)")) >= 3) & ~c.contains("\n")
    return F.when(many, F.regexp_replace(c, r" +(\[\d+\] |\(\d+\) )", "\n$1")).otherwise(c)


def margin_number(c: Column) -> Column:
    """A number of one to four digits at the margin before ten or more characters of text that opens with a letter or bracket; else null."""
    n = F.regexp_extract(c, r"^\s*(\d{1,4})\s+([A-Za-z(].*)$", 1)
    rest = F.regexp_extract(c, r"^\s*(\d{1,4})\s+([A-Za-z(].*)$", 2)
    return F.when((n != "") & (F.length(rest) >= 10) & ~is_list_item(rest), n.cast("int"))


def csv_field(c: Column) -> Column:
    """Quoted, inner quotes doubled; null is an empty field without quotes."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))


def base_name(c: Column) -> Column:
    """A file's name without folders, extension and the suffix of raw output."""
    name = F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(name, "_ocr_data$", "")


def mime_type(c: Column) -> Column:
    e = F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(e.isin("jpg", "jpeg"), "image/jpeg").when(e == "png", "image/png").when(e == "pdf", "application/pdf").when(e == "json", "application/json").when(c.isNotNull(), "application/octet-stream")


def hex_colour(c: Column) -> Column:
    """Six upper-case digits; three are doubled; anything else is 999999."""
    h = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "^#", ""))
    three = F.concat(*(F.repeat(F.substring(h, i, 1), 2) for i in (1, 2, 3)))
    return F.when(h.rlike("^[0-9A-F]{6}$"), h).when(h.rlike("^[0-9A-F]{3}$"), three).otherwise("999999")


def mask_secret(c: Column) -> Column:
    """The prefix up to the first hyphen after sk, twelve dots, the last four characters."""
    prefix = F.regexp_extract(c, "^(sk-[a-z]*-?|[A-Za-z]{2,4}-)", 1)
    return F.concat(prefix, F.repeat(F.lit("•"), 12), F.right(c, F.lit(4)))


def clean_reply(c: Column) -> Column:
    """Code fences and html or body wrappers go; a table is cut out and closed if its end is missing."""
    t = strip(F.regexp_replace(c, r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    t = strip(F.regexp_replace(t, r"(?i)</?(?:html|body)[^>]*>", ""))
    start, end = F.locate("<table", t), F.length(t) - F.locate(">elbat/<", F.reverse(t)) + 1
    cut = F.when(F.locate("</table>", t) > 0, F.substr(t, start, end - start + 1)).otherwise(F.concat(F.substr(t, start, F.length(t)), F.lit("</table>")))
    return F.when(start > 0, cut).otherwise(t)


def font_name(c: Column) -> Column:
    """A font's name in lower case, without the six-letter prefix of a subset."""
    return F.lower(strip(F.regexp_replace(strip(c), r"^[A-Z]{6}\+", "")))


# Pangrams that vision models make up, as patterns.
PANGRAMS = [r"THE\s+QUICK\s+BROWN\s+FOX\s+JUMPS?\s+OVER\s+THE\s+LAZY\s+DOG", r"THE\s+FIVE\s+BOXING\s+WIZARDS\s+JUMP\s+QUICKLY", r"PACK\s+MY\s+BOX\s+WITH\s+FIVE\s+DOZEN\s+LIQUOR\s+JUGS"]


def has_pangram(c: Column) -> Column:
    plain = strip_tags(c)
    return reduce(lambda a, b: a | b, [plain.rlike(f"(?i){p}") for p in PANGRAMS])


def strip_pangrams(c: Column) -> Column:
    """Without made-up pangrams, whatever tags their words stand in, and without the empty tags that are left; the empty text if nothing else was there."""
    gap = r"(?:\s*</?(?:strong|em|b|i|u|s|sup|sub)>\s*)*"
    out = c
    for p in PANGRAMS:
        words = p.split(r"\s+")
        tolerant = gap + rf"(?:\s+|{gap})".join(words) + gap + r"\.?"
        out = F.regexp_replace(out, f"(?i){tolerant}", "")
    for t in ALLOWED_TAGS:
        out = F.regexp_replace(out, rf"<{t}>\s*</{t}>", "")
    return F.when(has_pangram(c), squeeze(out)).otherwise(c)
