"""Problem 1: sentence boundaries, by a finite transducer over character classes.

The rules live in ``_step``; ``machine()`` compiles them into one transition
table and one emission table by walking all reachable states. A short text is
run from the start state, many texts of a batch side by side. A long text is
cut into chunks; the chunk is then a function from states to states, the
functions are composed by a parallel prefix scan, and each chunk is run again
from the state that the scan gives it. Both ways give the same boundaries.

Null, empty and blank texts have no sentence. Every visible character of any
other text is in just one sentence. Tags (<b>, <i>) and characters without
width count for nothing in the rules; tags stay with the words they enclose.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

from pagesmith.llm.common import HYPHENS, INVISIBLE, SPACES, fold_words

SP, NL, DOT, GLUE, MDOT, HARD, STRONG, ELL, UP, LOW, UNC, CJK, THAI, DIG, COMMA, DASH, OTHER, CONT = range(18)
OPEN = 18  # 18..23: openers of the kinds below; 24..29: their closers; 30, 31: " and '; 32, 33: “ and ”, whose role depends
#: Kinds of enclosure: 1 “ ”, 2 « », 3 corner brackets, 4 ", 5 ', 6 round and square brackets, 7 „ “
KINDS = 7
N_CLASSES = OPEN + 2 * KINDS
CLOSE = OPEN + KINDS
#: Long texts are cut into chunks of so many symbols.
CHUNK = 4096

TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]{0,9}>")
_DROP = re.compile(rf"</?[A-Za-z][A-Za-z0-9]{{0,9}}>|[{INVISIBLE}]")
_OPENING = re.compile(r"<[A-Za-z]")

# Abbreviations that never end a sentence, whatever follows.
_NEVER = """dr st ste mt prof mr mrs ms messrs capt col gen lt maj sgt rev hon gov pres sen rep vs viz cf ca approx bldg fig figs
tab vol vols pp eq eqs ch chap sr sra srta dra mme mlle mgr vgl bzgl evtl ggf inkl núm pág págs fig figs párr cap
проф акад рис табл стр им ул д-р см ср डॉ प्रो पृ क्र सं रु कि मी श्री पं डा மு பக் ரூ கே எண் திரு ดร""".split()
# Abbreviations that end no sentence where a number follows.
_BEFORE_NUMBER = "no nos nr sec secs art arts al abs bl bd min max s v h p q r c n t par ch sect ed с т п гл ст л".split()
# Abbreviations that may well be the last word of a sentence.
_MAYBE = "etc usw bzw co ltd inc corp bros jr plc esq u.s u.k e.u p.m a.m al ff г гг в вв руб тыс млн др".split(" ")
# Two-part abbreviations that end no sentence.
_PAIRS = ["z. b", "d. h", "u. a", "i. d", "s. o", "s. u", "o. ä", "p. ej", "т. е", "т. к", "i. e", "e. g", "i.e", "e.g", "z.b", "d.h", "c.-à-d", "c. à d"]
# Names of the months after a German ordinal.
_MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"

_LETTER = r"[^\W\d_]"
#: Vowel signs and other marks that belong to a word but are no word characters of the pattern language.
_MARKS = "\u0300-\u036f\u0900-\u0903\u093a-\u094f\u0962\u0963\u0b82\u0bbe-\u0bcd\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"
_DOTS = re.compile(
    rf"(?P<ell>\.{{2,}}|(?:\. ){{2,}}\.)"
    rf"|(?P<ordinal>(?<![\w.,])\d{{1,2}})\.(?=\s(?:{_MONTHS})\b)"
    rf"|(?P<item>(?:(?<=\n)|\A)[ \t]*\(?\d{{1,3}})\.(?=\s)"
    rf"|(?P<word>(?<![\w.{_MARKS}])(?:{_LETTER}[{_MARKS}]*\.[ ]?)?{_LETTER}[\w{_MARKS}-]{{0,7}}?(?:\.{_LETTER}[\w{_MARKS}-]{{0,5}}){{0,3}})\.(?=(?P<next>[ \t]*\n?[ \t]*[\"'\u201c\u201e«(]?)(?P<what>.?))",
    re.S,
)
#: A time that opens its sentence: the clause is still to come.
_TIME_FIRST = re.compile(r"\b(?:At|By|Around|Before|After|Since|Until)\s+\d[\d.:]*\s*[ap]\.\s?m\.")
_INDIC = re.compile(r"[ऀ-෿]")


def _dot_class(word: str, what: str) -> int:
    """The class of the full stop after word; what: the first character after it and its space."""
    w = word.lower().strip()
    last = re.split(r"[. ]", w)[-1]
    if w in _PAIRS:
        return GLUE
    if last in _BEFORE_NUMBER and what.isdigit() and last != "г":
        return GLUE
    if w in _MAYBE or word.islower() and w.replace(" ", "") in ("p.m", "a.m", "т.д", "т.п"):
        return MDOT
    if last in _NEVER:
        return GLUE
    if last in _MAYBE:
        return MDOT
    if _INDIC.match(w):
        return GLUE if "." in w or len(w) <= 2 else DOT
    if len(last) == 1 and last.isalpha():
        if word[-1:].isupper():
            return GLUE if what.isupper() or what.isdigit() or "." in w else DOT
        return GLUE if not what.isupper() else MDOT
    if "." in w and all(len(x) <= 4 for x in w.split(".")):
        return MDOT
    return DOT


@cache
def classes() -> np.ndarray:
    """The class of each code point of the basic plane."""
    t = np.full(0x10000, OTHER, dtype=np.uint8)
    for o in range(0x10000):
        c = chr(o)
        k = unicodedata.category(c)
        if k[0] == "L" or k[0] == "M":
            if 0x0E00 <= o < 0x0E80 or 0x0E80 <= o < 0x0F00 or 0x1000 <= o < 0x10A0 or 0x1780 <= o < 0x1800:
                t[o] = THAI
            elif 0x2E80 <= o < 0xA4D0 or 0xF900 <= o < 0xFB00 or 0xFF66 <= o < 0xFFA0:
                t[o] = CJK
            else:
                t[o] = UP if k in ("Lu", "Lt") else LOW if k == "Ll" else UNC
        elif k == "Nd":
            t[o] = DIG
        elif k in ("Zs", "Cc", "Zp"):
            t[o] = SP
    for cs, k in ((SPACES + " \t\r\v\f", SP), ("\n  \x85", NL), (".", DOT), ("!?‼⁇⁈⁉؟", HARD), ("。！？।॥۔｡︒﹖﹗።", STRONG), ("…", ELL), (",;:،؛、，；：", COMMA), ("—–-" + HYPHENS + "―", DASH), ("と然接便就并随说道问喊地的后って", CONT)):
        for c in cs:
            t[ord(c)] = k
    for kind, (a, b) in enumerate((("“", "”"), ("«‹", "»›"), ("「『《〈【", "」』》〉】"), ('"', '"'), ("'", "'"), ("([（［{", ")]）］}"), ("„‚", "“")), 1):
        for c in a:
            t[ord(c)] = OPEN + kind - 1
        for c in b:
            if c not in "\"'“":
                t[ord(c)] = CLOSE + kind - 1
    for c in "{}":
        t[ord(c)] = OTHER
    for c in "¿¡":
        t[ord(c)] = UP
    t[ord("฿")] = OTHER
    return t


# A state: enclosure's kind, whether it opened the sentence, what ended last, white space since, sentence begun, sentence at a line's start, Thai.
NONE, E_DOT, E_MDOT, E_HARD, E_STRONG, E_ELL, E_CARRY, E_QUOTED, E_BRACKET, E_GLUE = range(10)
_ENDS = {DOT: E_DOT, MDOT: E_MDOT, HARD: E_HARD, STRONG: E_STRONG, ELL: E_ELL}
START = (0, 0, NONE, 0, 0, 1, 0)


def _ends_before(t: int, w: int, line: int, thai: int, c: int) -> bool:
    """Whether a sentence that is outside of enclosures ends before a visible symbol of class c."""
    opener = OPEN <= c < CLOSE
    closer = CLOSE <= c < CLOSE + KINDS
    if w == 3:
        return True
    if closer or c in (COMMA, DOT, MDOT, GLUE, HARD, STRONG, ELL):
        return w == 2 and t in (E_DOT, E_HARD, E_STRONG, E_QUOTED)
    if t == E_GLUE:
        return False
    if t == E_STRONG:
        return True
    if t == E_CARRY:
        return (w >= 1 and (c in (UP, DIG) or opener)) or (w == 0 and c == OPEN + 2)
    if t == E_QUOTED:
        return (w == 0 and (c == CJK or c == OPEN + 2)) or (w >= 1 and c not in (LOW, DASH))
    if t == E_BRACKET:
        return w >= 1 and c not in (LOW, DASH)
    if t in (E_DOT, E_HARD, E_ELL) and w >= 1:
        return c not in (LOW, DASH)
    if t == E_MDOT and w >= 1:
        return c not in (LOW, DASH, OTHER) or opener
    if w == 2:
        return c != LOW and bool(line or thai)
    if w == 1 and thai:
        return c in (THAI, UP, UNC, CJK)
    return False


def _step(s: tuple, c: int) -> tuple[tuple, int]:
    """The rules: the state after a symbol of class c, and whether a sentence starts with it."""
    kind, first, t, w, begun, line, thai = s
    if c == SP:
        return ((kind, first, t, max(w, 1), begun, line, thai) if begun else s), 0
    if c == NL:
        return ((kind, first, t, 3 if w >= 2 else 2, begun, line, thai) if begun else (0, 0, NONE, 0, 0, 1, 0)), 0
    starts = 0
    if not begun:
        starts = 1
    elif kind:
        # An enclosure that was never closed ends with its paragraph.
        starts = int(w == 3)
    else:
        starts = int(_ends_before(t, w, line, thai, c))
    if starts:
        kind, first, t, line, thai = 0, 0, NONE, int(w >= 2 or not begun), 0
    opener, closer = OPEN <= c < CLOSE, CLOSE <= c < CLOSE + KINDS
    if kind:
        if c == CLOSE + kind - 1 or (kind in (4, 5) and c == OPEN + kind - 1) or (kind == 7 and c == OPEN) or (kind == 1 and c == CLOSE):
            inner = t in (E_DOT, E_MDOT, E_HARD, E_STRONG, E_ELL)
            if kind == 6:
                after = E_BRACKET if inner and first else NONE
            else:
                after = (E_CARRY if first else E_QUOTED) if inner else NONE
            return (0, 0, after, 0, 1, line, thai), starts
        return (kind, first, _ENDS.get(c, NONE), 0, 1, line, thai), starts
    if opener:
        return (c - OPEN + 1, int(bool(starts)), NONE, 0, 1, line, thai), starts
    if closer:
        return (0, 0, t, 0, 1, line, thai), starts
    if c == GLUE:
        return (0, 0, E_GLUE, 0, 1, line, thai), starts
    if c in _ENDS:
        # A stop at the very start of a sentence ends nothing.
        return (0, 0, NONE if starts else (t if c in (DOT, ELL) and t == E_STRONG else _ENDS[c]), 0, 1, line, thai), starts
    if c == THAI:
        thai = 1
    elif c in (UP, LOW, UNC, CJK, CONT):
        thai = 0
    return (0, 0, NONE, 0, 1, line, thai), starts


@cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """The compiled transducer: next state and emission by [state, class]; state 0 is the start."""
    index, todo, rows = {START: 0}, [START], []
    while todo:
        s = todo.pop()
        row = []
        for c in range(N_CLASSES):
            n, e = _step(s, c)
            if n not in index:
                index[n] = len(index)
                todo.append(n)
            row.append((index[n], e))
        rows.append((index[s], row))
    nxt = np.zeros((len(index), N_CLASSES), dtype=np.int16)
    out = np.zeros((len(index), N_CLASSES), dtype=np.uint8)
    for i, row in rows:
        nxt[i] = [n for n, _ in row]
        out[i] = [e for _, e in row]
    return nxt, out


def symbols(text: str) -> np.ndarray:
    """Class of each character of a text without tags and invisible characters."""
    folded = fold_words(text)
    raw = np.frombuffer(folded.encode("utf-32-le"), dtype=np.uint32)
    # Beyond the first plane: ideographs, symbols, and letters of other scripts stand for one of their kind.
    kind = np.where((raw >= 0x20000) & (raw < 0x40000), 0x4E00, np.where((raw >= 0x1F000) & (raw < 0x1FB00), 0x263A, 0x61))
    cls = classes()[np.where(raw < 0x10000, raw, kind)].copy()
    if "'" in folded or "’" in folded:
        for m in re.finditer("['’]", folded):
            i = m.start()
            before, after = folded[i - 1 : i], folded[i + 1 : i + 2]
            if before.isalnum() and (after.isalnum() or not after):
                cls[i] = OTHER
            elif m.group() == "’":
                cls[i] = CLOSE + 4 if not before.isspace() else OTHER
            elif after.isalnum() and (not before or before.isspace() or not before.isalnum()) and not after.isspace():
                cls[i] = OPEN + 4
            elif before.isspace() or not before:
                cls[i] = OTHER
    if "." in folded:
        for m in _DOTS.finditer(folded):
            k = m.lastgroup
            if m.group("ell"):
                cls[m.start() : m.end()] = ELL
            elif m.group("ordinal") or m.group("item"):
                cls[m.end() - 1] = GLUE
            elif m.group("word"):
                word = m.group("word")
                for i in range(len(word) - 1):
                    if word[i] == ".":
                        cls[m.start() + i] = GLUE
                cls[m.end() - 1] = _dot_class(word, m.group("what"))
        for m in _TIME_FIRST.finditer(folded):
            cls[m.end() - 1] = GLUE
    if "…" in folded:
        for m in re.finditer("…+", folded):
            near = [cls[j] for j in (m.start() - 1, m.end()) if 0 <= j < len(cls)]
            if any(k in (CJK, CONT, STRONG) for k in near):
                cls[m.start() : m.end()] = STRONG
    return cls


def _run(cls: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Emissions of one text by plain steps; for tests and for the tail of the scan."""
    nxt, out = machine()
    e = np.zeros(len(cls), dtype=np.uint8)
    for i, c in enumerate(cls.tolist()):
        e[i] = out[state, c]
        state = int(nxt[state, c])
    return e, state


def scan_long(cls: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Emissions of a long text: chunks as functions of the state, composed by a parallel prefix scan."""
    nxt, out = machine()
    n_states = len(nxt)
    n = -(-len(cls) // chunk)
    padded = np.full(n * chunk, SP, dtype=np.uint8)
    padded[: len(cls)] = cls
    grid = padded.reshape(n, chunk)
    f = np.broadcast_to(np.arange(n_states, dtype=np.int16), (n, n_states)).copy()
    for t in range(chunk):
        f = nxt[f, grid[:, t, None]]
    # Inclusive scan: after the step with distance d, f[i] is the function of the 2 d chunks that end with i.
    d = 1
    while d < n:
        g = f.copy()
        g[d:] = np.take_along_axis(f[d:], f[:-d].astype(np.int64), axis=1)
        f, d = g, 2 * d
    state = np.zeros(n, dtype=np.int16)
    state[1:] = f[:-1, 0]
    e = np.zeros((n, chunk), dtype=np.uint8)
    for t in range(chunk):
        c = grid[:, t]
        e[:, t] = out[state, c]
        state = nxt[state, c]
    return e.reshape(-1)[: len(cls)]


def emissions(batch: list[np.ndarray]) -> list[np.ndarray]:
    """Where sentences start, of each text's symbols: short texts side by side, long ones by the scan."""
    nxt, out = machine()
    result: list[np.ndarray | None] = [None] * len(batch)
    order = sorted((i for i in range(len(batch)) if len(batch[i]) <= CHUNK), key=lambda i: len(batch[i]))
    for at in range(0, len(order), 1024):
        part = order[at : at + 1024]
        m = max((len(batch[i]) for i in part), default=0)
        grid = np.full((m, len(part)), SP, dtype=np.uint8)
        for j, i in enumerate(part):
            grid[: len(batch[i]), j] = batch[i]
        e = np.zeros((m, len(part)), dtype=np.uint8)
        state = np.zeros(len(part), dtype=np.int16)
        for t in range(m):
            c = grid[t]
            e[t] = out[state, c]
            state = nxt[state, c]
        for j, i in enumerate(part):
            result[i] = e[: len(batch[i]), j]
    for i, cls in enumerate(batch):
        if result[i] is None:
            result[i] = scan_long(cls)
    return result  # type: ignore[return-value]


def prepare(text: str | None) -> tuple[str, np.ndarray | None]:
    """The text without tags and invisible characters, and the place of each kept character (None: all kept)."""
    if not text:
        return "", None
    if "<" not in text and text.isascii() or not _DROP.search(text):
        return text, None
    keep = np.ones(len(text), dtype=bool)
    for m in _DROP.finditer(text):
        keep[m.start() : m.end()] = False
    return _DROP.sub("", text), np.flatnonzero(keep)


def spans(texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """Of each text its sentences as (start, end) in code points, in order. Null, empty and blank texts: none."""
    prepared = [prepare(t) for t in texts]
    found = emissions([symbols(p) if p else np.zeros(0, dtype=np.uint8) for p, _ in prepared])
    return [_cut(t or "", p, at, e) for t, (p, at), e in zip(texts, prepared, found, strict=True)]


_BLANK = frozenset(" \t\r\n\v\f\x85  " + SPACES + INVISIBLE)


def _cut(text: str, kept: str, at: np.ndarray | None, e: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(e)
    if at is not None:
        if not len(starts) and not any(c not in _BLANK for c in text):
            return []
        starts = at[starts].tolist()
        starts = [_with_tags(text, s) for s in starts] or [0]
        starts[0] = 0
    else:
        starts = starts.tolist()
    result = []
    for s, end in zip(starts, [*starts[1:], len(text)] if starts else [], strict=True):
        while s < end and text[s] in _BLANK:
            s += 1
        while end > s and text[end - 1] in _BLANK:
            end -= 1
        if s < end:
            result.append((s, end))
    return result


def _with_tags(text: str, s: int) -> int:
    """The start moved back over the opening tags that stand right before it."""
    while s > 0:
        if text[s - 1] in INVISIBLE:
            s -= 1
        elif text[s - 1] == ">" and (i := text.rfind("<", 0, s)) >= 0 and _OPENING.match(text, i) and TAG.fullmatch(text, i, s):
            s = i
        else:
            break
    return s


def sentence_spans(df, text: str = "content", start: str = "start_pos", end: str = "end_pos"):
    """DataFrame operator: one row a sentence, with all columns of df but the text, and the columns start and end.

    Rows whose text is null, empty or blank give no row; equal rows give equal
    sentences each. Columns of df named like the new ones are replaced.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    from pagesmith.llm.common import lists, map_arrow

    keep = [c for c in df.columns if c not in (text, start, end)]
    made = "_spans"
    wanted = df.select(*keep, F.col(text).alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"{made}_s array<int>", f"{made}_e array<int>"])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = spans(b.column(len(keep)).to_pylist())
        n = np.array([len(x) for x in found], dtype=np.int32)
        flat = np.array([p for x in found for p in x], dtype=np.int32).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), lists(flat[:, 0], n, pa.int32()), lists(flat[:, 1], n, pa.int32())], names=[*keep, f"{made}_s", f"{made}_e"])

    done = map_arrow(wanted, run, schema)
    pair = F.explode(F.arrays_zip(F.col(f"{made}_s"), F.col(f"{made}_e"))).alias("_p")
    return done.select(*keep, pair).select(*keep, F.col(f"_p.{made}_s").alias(start), F.col(f"_p.{made}_e").alias(end))
