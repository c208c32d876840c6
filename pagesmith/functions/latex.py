"""Column functions over LaTeX as a recogniser returns it: every character apart, words in font commands. Null gives null, unless said otherwise.

A formula is read as tokens: a command, an escaped sign, or one character. What
is looked at is the token's drawing: nothing for fonts, braces and spaces, one
character for a command that has one in print, ``⌘`` for every other command.
A measurement is then a short text in that alphabet, and a small grammar of
quantities, substances and labels says which texts are one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"(?s)(\\[A-Za-z]+|\\.|.)"
# Commands that set a font for the group that follows, those that set it from there on, and those that set a size.
FONTS = ["bf", "boldsymbol", "mathbf", "mathfrak", "mathrm", "mathsf", "mathtt", "mbox", "text", "textbf", "textrm", "textsf", "texttt", "tt"]
SWITCHES = ["bf", "it", "rm", "sf", "tt"]
SIZES = ["big", "Big", "bigg", "Bigg", "left", "right"]
# Commands that have a character of their own in print.
SYMBOLS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "µ",
    "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    "approx": "≈", "cdot": "·", "circ": "°", "geq": "≥", "infty": "∞", "langle": "⟨", "leq": "≤", "neq": "≠", "pm": "±", "rangle": "⟩", "sim": "~", "star": "*", "times": "×",
}
# Units that a number is read with, without a micro sign.
UNITS = "M mM nM uM pM L mL nL uL pL g mg ng ug pg kg m cm mm nm s h min mol".split()
#: A command that is drawn as no character, and the accent that the grammar knows.
OTHER, DOT = "⌘", "˙"
#: Where a command starts and ends, while spaces are set.
BEFORE, AFTER = "\ue000", "\ue001"

_NUMBER = "[0-9][0-9.,]*"
_WORD = "[A-Za-z]+"
_ELEMENT = "[A-Z][a-z]?"
_ION = rf"{_ELEMENT}\^?[0-9]*[+-]"
#: Texts that are a measurement as a whole, by kind; a final period belongs to none.
GRAMMAR = {
    "quantity": rf"[()<>=]*~?{_NUMBER}(?:-{_NUMBER})?(?:{'|'.join(UNITS)}|{_WORD}/{_WORD}|%[)]?|\^?°[CF]|µ(?:{_WORD}(?:/{_WORD})?(?:\^[0-9]+)?|[µι]))",
    "about": rf"~{_NUMBER}|{DOT}?·=?{_NUMBER}",
    "factor": rf"_?{_NUMBER}×|×[0-9]?",
    "spread": r"±(?:S\.?D|s\.?d|SEM)?",
    "count": r"\(?[Nn]=[0-9]+\)?",
    "acidity": rf"pH{{0,2}}{_NUMBER}",
    "ion": rf"{_ION}+",
    "substance": rf"(?:{_ELEMENT}[0-9]*(?:_[0-9]+)?){{2,}}",
    "variant": r"\(?[A-Z]Δ[0-9]+\)?",
    "cited": r"[A-Z][A-Za-z]*[0-9]*\^[0-9]+",
    "label": rf"[αβγδεχφψω]·?[-.]?(?:{_WORD})?|·[αβγδχφω]|\([a-z]-[a-z]\)|[a-z]",
}
#: Texts that make a measurement of all they stand in: a significance, a power of ten, an optical density, a dissolved substance, a gene or protein with its ion.
WITHIN = [r"P[<>=]", rf"{_NUMBER}×10\^", r"OD_?[0-9]+=[0-9]", r"[0-9]\.?:?[munp]?M:?[A-Za-z0-9_-]", rf"(?:[A-Z]{{2,}}[0-9]*|[A-Z]\|[A-Za-z0-9]+)\+{_ION}"]
MEASUREMENT = rf"^(?:{'|'.join(GRAMMAR.values())})\.?$|{'|'.join(WITHIN)}"
#: What a text of plain characters is made of.
PLAIN = "^[A-Za-z0-9.,:/°%×#&$+-]+$"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


_SILENT = {f"\\{c}": "" for c in [*FONTS, *SWITCHES, *SIZES]}
_SIGNS = {f"\\{c}": c for c in "%#&$"}
_GAPS = {" ": "", "\t": "", "\n": "", "\r": "", "~": "", "\\ ": ""}
#: Drawings by token, for the eye of the grammar.
DRAWN = {**_SILENT, **_SIGNS, **_GAPS, "{": "", "}": "", "\\dot": DOT, **{f"\\{k}": v for k, v in SYMBOLS.items()}}


def _tokens(latex: Column) -> Column:
    return F.regexp_extract_all(latex, F.lit(TOKEN), F.lit(1))


def drawn(latex: Column) -> Column:
    """The text that a formula is in the alphabet of the grammar."""
    return F.array_join(F.transform(_tokens(latex), lambda t: F.coalesce(F.try_element_at(_map(DRAWN), t), F.when(t.startswith("\\"), F.lit(OTHER)), t)), "")


def compact(latex: Column) -> Column:
    """One form of LaTeX for notations: without fonts, sizes, braces and spaces but for one between a command and a letter or digit. Applied to its result it changes nothing."""
    keep = _map({**_SILENT, **_SIGNS, **_GAPS, "{": "", "}": ""})
    c = F.array_join(F.transform(_tokens(latex), lambda t: F.coalesce(F.try_element_at(keep, t), F.when(t.rlike(r"^\\[A-Za-z]"), F.concat(F.lit(BEFORE), t, F.lit(AFTER))), t)), "")
    return F.translate(F.regexp_replace(F.regexp_replace(c, f"([A-Za-z0-9]){BEFORE}", "$1 "), f"{AFTER}([A-Za-z0-9])", " $1"), BEFORE + AFTER, "")


def is_measurement(latex: Column) -> Column:
    """Whether a formula is the notation of a measurement, a substance, a label or the like."""
    return drawn(latex).rlike(MEASUREMENT)


def is_no_equation(latex: Column) -> Column:
    """Whether a formula is text taken for one: null or empty; a measurement; or plain characters, without a command but fonts of groups and without a power or index of a letter. Letters in a group of their own count as letters."""
    text = drawn(latex)
    mathematics = latex.rlike(rf"\\(?!(?:{'|'.join(f for f in FONTS if f != 'mathfrak')})\s*\{{)(?:[A-Za-z]+|[^A-Za-z%#&$ ])") | text.rlike(r"[A-Za-z][\^_]|[\^_][A-Za-z]")
    return F.when(F.coalesce(latex, F.lit("")) == "", True).otherwise(is_measurement(latex) | (~mathematics & F.regexp_replace(text, r"[\^_]", "").rlike(PLAIN)))


def to_plain(latex: Column) -> Column:
    """A formula as plain text: letters and signs for commands, other commands gone. Inside a font's group characters close up and only marked spaces count; a group starts a word; spaces go after a command, within numbers, between sign and digit and around a slash."""
    glyphs = _map({**_SIGNS, "^": "", "_": "", **{f"\\{k}": v for k, v in SYMBOLS.items()}})
    switches = [f"\\{x}" for x in SWITCHES if x not in FONTS]

    def step(s: Column, t: Column) -> Column:
        font, gap, marked = t.isin(*(f"\\{x}" for x in FONTS)), t.rlike(r"^\s$"), t.isin("~", "\\ ")
        command = t.rlike(r"^\\[A-Za-z]")
        ink = F.coalesce(F.try_element_at(glyphs, t), F.when(t.startswith("\\"), F.lit("")), t)
        out = F.when(font, F.concat(s["out"], F.lit(" "))).when(t.isin("{", "}", *switches), s["out"]).when(marked & ~s["eat"], F.concat(s["out"], F.lit(" "))).when(gap & ~s["eat"] & (s["depth"] == 0), F.concat(s["out"], F.lit(" "))).when(gap | marked, s["out"]).otherwise(F.concat(s["out"], ink))
        depth = F.when((t == "{") & (s["armed"] | (s["depth"] > 0)), s["depth"] + 1).when(t == "}", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(out.alias("out"), depth.alias("depth"), (font | (s["armed"] & gap)).alias("armed"), (command & ~font | s["eat"] & (gap | marked | t.isin("{", "}"))).alias("eat"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("armed"), F.lit(False).alias("eat"))
    text = F.aggregate(_tokens(latex), start, step)["out"]
    close = r"(?<=[0-9.])\s+(?=[0-9.])|(?<=[0-9])\s+(?=[+-])|(?<=[+-])\s+(?=[0-9])|\s+(?=/)|(?<=/)\s+|^\s+|\s+$"
    return F.regexp_replace(F.regexp_replace(text, close, ""), r"\s+", " ")


def equation_span(latex: Column, index: Column, block: Column) -> Column:
    """What stands for an equation in text: its plain text if it is none, else its placeholder, a block's with line breaks around it. An empty formula with an image is kept by the caller."""
    mark = F.concat(F.lit("{{EQ:"), index.cast("string"), F.lit("}}"))
    return F.when(is_no_equation(latex), to_plain(latex)).when(block, F.concat(F.lit("\n"), mark, F.lit("\n"))).otherwise(mark)
