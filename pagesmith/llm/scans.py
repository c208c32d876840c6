"""Problem 5: traces of paper in text of scanned pages: running heads and page numbers, words broken at line ends, misread words, paragraphs over page ends.

Lines of a page, in reading order, are labelled by a linear-chain conditional
model as header, footer, body, or break (last line of a paragraph), with
features of the layout: where the line's region lies, whether it is a line of
its own, whether it is the page's number or one of the job's running heads, how
it ends and how the next one starts. The model learns from the lines of regions
that are typed header or footer, from those that are not, and from lines of the
former put into the latter. Header and footer lines in other regions are
furniture. Without them, the last paragraph of a page and the first of the next
are one sequence for the same model: what it does not label a break goes on.

Pages are put together once, with their running heads, and kept; one pass of
Python over them gives the words of all pages, counted within a batch, and what
the lines of scanned ones hold. Words are looked up in the counts of all words
of all regions, which are joined and never sent to the driver: a broken word is
written as the corpus writes it, a word that digital pages do not know is
corrected to a frequent word that differs by what scanners take for each other.

Null, empty and blank contents have no lines; regions without a page that is
known to be scanned or not are left out; a null join_broken_pages is false.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesmith.llm.common import HYPHENS, Shared, bounded_sample, kept, map_arrow
from pagesmith.llm.crf import Chain, batches

HEADER, FOOTER, BODY, BREAK = LABELS = range(4)
BITS = 16
#: Features of a line at most.
WIDE = 24
#: Pages of the sample that the labels are learned from.
TRAIN_PAGES = 2500
#: How often the right word must be there, and how many times as often as the misread one.
KNOWN, TIMES = 3, 10

# What scanners take for what, as it is read and as it is printed.
MISREAD = [("c", "e"), ("e", "c"), ("l", "t"), ("l", "i"), ("f", "t"), ("b", "h"), ("h", "b"), ("ri", "n"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("ii", "ü"), ("vv", "w"), ("h", "li"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("6", "é"), ("8", "b"), ("9", "g"), ("i", "l"), ("o", "c"), ("u", "ii"), ("n", "u"), ("u", "n"), ("nn", "m"), ("t", "f"), ("q", "g"), ("7", "t"), ("3", "e"), ("4", "a")]
# Words that follow a hyphen which stands for a left-out part.
_SUSPENDED = frozenset("und oder bzw and or y e o et ou u sowie bis to".split())

_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_NUMBER = re.compile(r"\s*(?:page|p\.?|pg\.?|seite|s\.|pág\.?|página|पृष्ठ|стр\.?|第)?\s*[-–—\[(|]*\s*(\d{1,5}|[ivxlcdm]{1,9})\s*(?:(?:/|of|von|de|sur|из)\s*\d{1,5})?\s*[-–—\])|.]*\s*(?:页|ページ)?\s*", re.I)
_HEAD_NUMBER = re.compile(r"^\s*\d{1,5}\s{2,}|\s{2,}\d{1,5}\s*$")
_ENDS = re.compile(r"[.!?。！？।۔؟…:][\"'”“»)’」』\]]*\s*$")
_OUTER = re.compile(r"^[^\w]+|[^\w]+$")
_TAGS = re.compile(r"</?[bi]>")
# What a word broken at the end of a line or page ends with: hyphens, and the soft hyphen and the not sign that scanners read for them.
BREAKS = HYPHENS + "\u00ac\u00ad"
_BROKEN = re.compile(rf"\S+[-{BREAKS}](?:\n\S+|\s*\Z)")
_HYPHEN_END = re.compile(rf"[^\W\d_][-{BREAKS}]$")


def roman(s: str) -> int:
    if not s or not _ROMAN.fullmatch(s):
        return 0
    v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in s.lower()]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def is_page_number(line: str, page: int) -> bool:
    """Whether the line is nothing but this page's number, in any of the usual dresses."""
    m = _NUMBER.fullmatch(line)
    if not m:
        return False
    n = int(m.group(1)) if m.group(1).isdigit() else roman(m.group(1))
    return n == page


def head_form(line: str) -> str:
    """A line without the page number at its side, as running heads are compared."""
    return re.sub(r"\s+", " ", _HEAD_NUMBER.sub("", line)).strip().lower()


def line_features(lines: list[dict], k: int, page: int, height: float, opened: bool | None = None, region_end: bool = True) -> list[str]:
    """Of line k of a sequence of lines; opened: whether the transducer of sentences sees no start in the next line, if it was asked; region_end: whether the region's end may be looked at."""
    x = lines[k]
    t = x["text"].strip()
    y0, y1 = x["y0"], x["y1"]
    zone = x["zone"] = "?" if y0 is None or not height else "top" if y1 < 0.08 * height else "bottom" if y0 > 0.92 * height else "body"
    number, head = is_page_number(t, page), bool(x["head"])
    aside = head and bool(_HEAD_NUMBER.search(x["text"]))
    own = x["lines"] == 1
    edge = "first" if k == 0 else "last" if k == len(lines) - 1 else "mid"
    after = lines[k + 1]["text"].lstrip()[:1] if k + 1 < len(lines) else ""
    start = "none" if not after else "low" if after.islower() else "up" if after.isupper() else "digit" if after.isdigit() else "other"
    ends = "hyphen" if _HYPHEN_END.search(t) else "mark" if _ENDS.search(t) else "open"
    f = [f"z {zone}", f"e {edge}", f"number {number}", f"head {head}", f"aside {aside}", f"own {own}", f"low {t[:1].islower()}", f"n {min(len(t) // 12, 6)} {number or head}"]
    f += [f"number own {number} {own}", f"head own zone {head} {own} {zone}", f"head edge {head} {own} {edge}", f"number zone {number} {own} {zone}", f"plain own zone {number or head} {own} {zone}"]
    f += [f"end {ends}", f"end next {ends} {start}"]
    if opened is not None:
        after = lines[k + 1]["text"].lstrip() if k + 1 < len(lines) else ""
        f += [f"open {opened}", f"open next {opened} {start}", f"from {after[:3]}", f"from {after[:6]}", f"to {t[-3:]}"]
    if region_end:
        f += [f"last {x['i'] == x['lines'] - 1}", f"last end {x['i'] == x['lines'] - 1} {ends}"]
    return f


_NUMBERS: dict[str, int] = {}


def _row(features: list[str]) -> np.ndarray:
    out = np.full(WIDE, -1, dtype=np.int64)
    for j, x in enumerate(features):
        n = _NUMBERS.get(x)
        if n is None:
            n = _NUMBERS[x] = xxhash.xxh3_64_intdigest(x) & ((1 << BITS) - 1)
        out[j] = n
    return out


def _rows(lines: list[dict], page: int, height: float, opened: list[bool] | None = None, region_end: bool = True) -> np.ndarray:
    return np.array([_row(line_features(lines, k, page, height, opened[k] if opened else None, region_end)) for k in range(len(lines))], dtype=np.int64).reshape(-1, WIDE)


def page_lines(regions: list[dict]) -> list[dict]:
    """Lines of a page's regions in reading order; a region's heads holds the digests of its job's running heads that it may have."""
    out = []
    for r in regions:
        c = r["content"]
        if not c or c.isspace():
            continue
        parts = [x for x in _TAGS.sub("", c).split("\n") if x.strip()]
        heads = r["heads"] or ()
        for j, x in enumerate(parts):
            head = r["region_type"] == "header" or (bool(heads) and _digest(head_form(x)) in heads)
            out.append({"text": x, "y0": r["y0"], "y1": r["y1"], "head": head, "lines": len(parts), "i": j, "type": r["region_type"], "region": r["region_id"], "zone": "?"})
    return out


def _digest(form: str) -> int:
    return xxhash.xxh64_intdigest(form.encode()) >> 1


def goes_on(pairs: list[tuple[str, str]]) -> list[bool]:
    """Of each (tail, head) whether the transducer of sentences sees no start where head begins."""
    from pagesmith.llm.sentences import emissions, symbols

    out = [False] * len(pairs)
    asked, texts = [], []
    for i, (tail, head) in enumerate(pairs):
        if not tail or not head:
            continue
        tail = tail.replace("\n", " ")
        if _HYPHEN_END.search(tail):
            out[i] = head[:1].islower()
        elif not re.search(r"[!?。！？।۔؟][\"'”“»)’」』\]]*$", tail):
            asked.append((i, len(tail) + 1))
            texts.append(symbols(tail + " " + head))
    for (i, n), e in zip(asked, emissions(texts) if texts else [], strict=True):
        out[i] = not e[n]
    return out


def train(pages: list[tuple[int, float, list[dict]]], seed: int = 4) -> Chain:
    """pages: (page number, height, regions in reading order)."""
    rng = np.random.default_rng(seed)
    todo: list[tuple[list[dict], list[int], int, float]] = []
    for page, height, regions in pages:
        lines = page_lines(regions)
        if not lines:
            continue
        for x in lines:
            # A head may stand on one page only, where no other names it a head.
            if x["type"] == "header" and rng.random() < 0.15:
                x["head"] = False
        y = [HEADER if x["type"] == "header" else FOOTER if x["type"] == "footer" else BREAK if x["i"] == x["lines"] - 1 else BODY for x in lines]
        # What ends a page without a final mark goes on, as far as a page can tell.
        body = [k for k, v in enumerate(y) if v > FOOTER]
        if body and lines[body[-1]]["type"] == "text" and not _ENDS.search(lines[body[-1]]["text"].strip()):
            y[body[-1]] = BODY
        for put in (False, True, True, True):
            seq, lab = [dict(x) for x in lines], list(y)
            if put:
                # A head or number of the page strays into a paragraph, or its region passes for text.
                loose = [(x, v) for x, v in zip(lines, y, strict=True) if v <= FOOTER]
                spots = [k for k, x in enumerate(lines) if x["type"] == "text" and x["lines"] > 1]
                if not loose or not spots:
                    continue
                s = lines[spots[int(rng.integers(len(spots)))]]
                own = [k for k, x in enumerate(lines) if x["region"] == s["region"]]
                at = int(rng.choice([own[0], own[-1] + 1, *(own[int(rng.integers(len(own)))] for _ in range(2))]))
                x, v = loose[int(rng.integers(len(loose)))]
                stray = dict(x, y0=s["y0"], y1=s["y1"], lines=s["lines"] + 1, i=1, region=s["region"])
                number = is_page_number(stray["text"].strip(), page)
                stray["head"] = stray["head"] or not number
                if number and rng.random() < 0.3:
                    # The number of another page is a line like any other.
                    stray["text"] = re.sub(r"\d+", lambda m: str(int(m.group()) + int(rng.integers(2, 40))), stray["text"]) if any(c.isdigit() for c in stray["text"]) else stray["text"] + "v"
                    v = BODY
                keep = [k for k in range(len(seq)) if not (lab[k] <= FOOTER and rng.random() < 0.5)]
                seq2, lab2 = [], []
                for k in range(len(seq) + 1):
                    if k == at:
                        seq2.append(stray)
                        lab2.append(v)
                    if k < len(seq) and k in keep:
                        seq2.append(seq[k])
                        lab2.append(lab[k])
                seq, lab = seq2, lab2
                mine = [x for x in seq if x["region"] == s["region"]]
                for i, x in enumerate(mine):
                    x["i"], x["lines"] = i, len(mine)
            todo.append((seq, lab, page, height))
    sequences = [(_rows(seq, page, height), np.zeros(len(seq), dtype=np.int8), np.array(lab)) for seq, lab, page, height in todo]
    # Ends of pages: two texts that follow each other, and one text cut in two.
    ends: list[tuple[str, str, int]] = []
    for _, _, regions in pages:
        texts = [_TAGS.sub("", r["content"]).strip() for r in regions if r["region_type"] == "text" and r["content"] and not r["content"].isspace()]
        ends += [(a, b, BREAK) for a, b in zip(texts, texts[1:])]
        for t in texts:
            # Between words; where words have no spaces, anywhere.
            gaps = [m.start() for m in re.finditer(" ", t)]
            gaps = gaps if len(gaps) > len(t) / 15 else list(range(2, len(t) - 2))
            if len(gaps) > 4:
                k = gaps[int(rng.integers(1, len(gaps) - 1))]
                if not _ENDS.search(t[:k].strip()):
                    ends.append((t[:k].strip(), t[k:].strip(), BODY))
    for x, n, (_, _, v) in zip(*_end_rows([(a, b) for a, b, _ in ends]), ends, strict=True):
        if n >= 0:
            y = np.full(len(x), BODY)
            y[n], y[-1] = v, BREAK
            sequences.append((x, np.zeros(len(x), dtype=np.int8), y))
    return Chain(len(LABELS), BITS).fit(sequences, epochs=8, rate=0.3) if sequences else Chain(len(LABELS), BITS)


def _end_rows(pairs: list[tuple[str, str]]) -> tuple[list[np.ndarray], list[int]]:
    """Features of each (last text of a page, first text of the next) as one sequence, and where in it the first ends; -1 if one of them has no line. The transducer is asked at that place only; ends of regions are not looked at."""
    opened = goes_on([(a.strip(), b.strip()) for a, b in pairs])
    rows, at = [], []
    for (a, b), o in zip(pairs, opened, strict=True):
        parts = [[x for x in t.split("\n") if x.strip()] for t in (a, b)]
        lines = [{"text": x, "y0": None, "y1": None, "head": False, "lines": len(p) + 1, "i": i, "zone": "?"} for p in parts for i, x in enumerate(p)]
        n = len(parts[0]) - 1 if parts[0] and parts[1] else -1
        view = [True] * len(lines)
        if n >= 0:
            view[n] = o
        rows.append(_rows(lines, -1, 0.0, view, False))
        at.append(n)
    return rows, at


def _marginals(chain: Chain, rows: list[np.ndarray]) -> list[np.ndarray]:
    """Of each sequence of feature rows the probability of each label of each line."""
    out = [np.zeros((0, len(LABELS)))] * len(rows)
    for g in batches([len(x) for x in rows], most=20_000):
        length = max(len(rows[i]) for i in g)
        f, mask = np.full((len(g), length, WIDE), -1, dtype=np.int64), np.zeros((len(g), length), dtype=bool)
        for r, i in enumerate(g):
            f[r, : len(rows[i])], mask[r, : len(rows[i])] = rows[i], True
        p, _ = chain.marginals(chain.emissions(f), np.zeros(mask.shape, np.int8), mask)
        for r, i in enumerate(g):
            out[i] = p[r, : len(rows[i])]
    return out


def label(chain: Chain, pages: list[tuple[int, float, list[dict]]]) -> list[tuple[list[dict], np.ndarray]]:
    """Of each page its lines, and the probability of each to be a header or footer."""
    lines = [page_lines(regions) for _, _, regions in pages]
    p = _marginals(chain, [_rows(x, page, height) for x, (page, height, _) in zip(lines, pages, strict=True)])
    return [(x, q[:, HEADER] + q[:, FOOTER]) for x, q in zip(lines, p, strict=True)]


def carries_on(chain: Chain, pairs: list[tuple[str, str]]) -> list[bool]:
    """Of each (last text of a page, first text of the next) whether the last line of the one is no break before the other."""
    rows, at = _end_rows(pairs)
    return [n >= 0 and bool(p[n, BODY] > p[n, BREAK]) for n, p in zip(at, _marginals(chain, rows), strict=True)]


def token(word: str) -> str:
    """A word in lower case without outer punctuation."""
    return _OUTER.sub("", word).lower()


_TOKENS: dict[str, str] = {}


def _token(word: str) -> str:
    t = _TOKENS.get(word)
    if t is None:
        if len(_TOKENS) > 300_000:
            _TOKENS.clear()
        t = _TOKENS[word] = token(word)
    return t


def _scanned(chain: Chain, pages: list[tuple[int, float, list[dict]]]) -> list[dict]:
    """Of each scanned page: furniture lines, words, broken words, first and last text without furniture."""
    out = []
    for (page, _, _), (lines, p) in zip(pages, label(chain, pages), strict=True):
        furniture, texts = [], {}
        for x, v in zip(lines, p, strict=True):
            if x["type"] in ("header", "footer"):
                continue
            if v > 0.5:
                furniture.append((x["region"], x["text"]))
            elif x["type"] == "text":
                texts.setdefault(x["region"], []).append(x["text"].strip())
        words, broken = [], []
        for region, ls in texts.items():
            seen = set()
            skip = False
            for a, b in zip(ls, [*ls[1:], None]):
                parts = a.split()
                if skip and parts:
                    parts = parts[1:]
                skip = False
                if b is not None and parts and _HYPHEN_END.search(parts[-1]) and b[:1].isalpha() and not b[:1].isupper() | (b[:1] != b[:1].lower()):
                    broken.append((region, parts[-1][:-1], b.split()[0]))
                    parts, skip = parts[:-1], True
                elif parts and _HYPHEN_END.search(parts[-1]):
                    parts = parts[:-1]
                seen.update(map(_token, parts))
            words += [(region, w) for w in seen if len(w) >= 2 and any(c.isalpha() for c in w)]
        ids = list(texts)
        first, last = (ids[0], "\n".join(texts[ids[0]])) if ids else None, (ids[-1], "\n".join(texts[ids[-1]])) if ids else None
        out.append({"furniture": furniture, "words": words, "broken": broken, "first": first, "last": last})
    return out


def _digital(regions: list[dict]) -> dict:
    """Of a page that is not scanned: its first text."""
    first = next(((r["region_id"], _TAGS.sub("", r["content"])) for r in regions if r["region_type"] == "text"), None)
    return {"furniture": [], "words": [], "broken": [], "first": first, "last": None}


_SEEN = "job_id string, page_number int, joined boolean, furniture array<struct<region_id:bigint,line:string>>, words array<struct<region_id:bigint,word:string>>, broken array<struct<region_id:bigint,left:string,right:string>>, first_id bigint, first_text string, last_id bigint, last_text string, word string, clean bigint, total bigint"


def paged_regions(regions: DataFrame, pages: DataFrame, options: DataFrame, deliveries: DataFrame | None = None) -> DataFrame:
    """One row a page that is known to be scanned or not: (job_id, page_number, scanned, height, joined, regions in reading order, each with the digests of its job's running heads that it has).

    A region's running heads are found by a join of digests of (job, line); only
    digests are shuffled. deliveries: the rows to take lines from, if the
    regions are themselves the outcome of a shuffle.
    """
    d = (regions if deliveries is None else deliveries).where("content IS NOT NULL AND job_id IS NOT NULL AND region_id IS NOT NULL")
    form = F.lower(F.trim(F.regexp_replace(F.regexp_replace("l", r"^\s*\d{1,5}\s{2,}|\s{2,}\d{1,5}\s*$", ""), r"\s+", " ")))
    lines = lambda x: x.select("job_id", "region_id", F.explode(F.split(F.regexp_replace("content", "</?[bi]>", ""), "\n")).alias("l")).select("region_id", form.alias("form"), F.xxhash64("job_id", form).alias("k")).where("form <> ''")
    heads = lines(d.where("region_type = 'header'")).select("k").distinct()
    hits = lines(d.where("region_type <> 'header'")).join(heads, "k", "left_semi").groupBy("region_id").agg(F.collect_set("form").alias("heads"))
    joined = options.where("job_id IS NOT NULL").groupBy("job_id").agg(F.max(F.coalesce("join_broken_pages", F.lit(False))).alias("joined"))
    on = pages.where("scanned IS NOT NULL").groupBy("job_id", "page_number").agg(F.max("scanned").alias("scanned"), F.max("height").alias("height")).join(joined, "job_id", "left")
    r = regions.where("content IS NOT NULL AND trim(content) <> ''").join(hits, "region_id", "left").join(on, ["job_id", "page_number"])
    each = F.struct("block_idx", "region_id", "region_type", F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"), "content", "heads")
    return r.groupBy("job_id", "page_number").agg(F.any_value("scanned").alias("scanned"), F.any_value("height").alias("height"), F.coalesce(F.any_value("joined"), F.lit(False)).alias("joined"), F.sort_array(F.collect_list(each)).alias("regions"))


def _with_digests(regions: list[dict]) -> list[dict]:
    for r in regions:
        if r["heads"]:
            r["heads"] = {_digest(x) for x in r["heads"]}
    return regions


def fitted(paged: DataFrame, most: int = TRAIN_PAGES) -> Chain:
    """The labels' model, fitted on a bounded sample of scanned pages."""
    rows = bounded_sample(paged.where("scanned").withColumn("_k", F.concat_ws("/", "job_id", F.col("page_number").cast("string"))), "_k", most).collect()
    rows.sort(key=lambda r: (r["h"], r["_k"]))
    return train([(r["page_number"], r["height"] or 0.0, _with_digests([x.asDict() for x in r["regions"]])) for r in rows])


def seen(paged: DataFrame, shared: Shared) -> DataFrame:
    """Rows of two kinds, kept: of each page what its lines hold; and words with how often they stand on digital pages and on all, counted within a batch. Words at broken line ends are not counted."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = b.to_pylist()
        made: list[dict] = [{}] * len(rows)
        clean, total = Counter(), Counter()
        for i, r in enumerate(rows):
            for x in r["regions"]:
                ws = list(map(_token, _BROKEN.sub(" ", _TAGS.sub("", x["content"])).split()))
                total.update(ws)
                if not r["scanned"]:
                    clean.update(ws)
            if not r["scanned"]:
                made[i] = _digital(r["regions"])
        on = [i for i, r in enumerate(rows) if r["scanned"]]
        for at in range(0, len(on), 200):
            part = on[at : at + 200]
            for i, x in zip(part, _scanned(shared.get(), [(rows[i]["page_number"], rows[i]["height"] or 0.0, _with_digests(rows[i]["regions"])) for i in part]), strict=True):
                made[i] = x
        keys = [w for w in total if len(w) >= 2 and any(x.isalpha() for x in w)]
        n, m = len(rows), len(keys)
        pad = lambda values, kind: pa.array([*values, *[None] * m], kind)
        pair = lambda names, key: pad([[dict(zip(names, t)) for t in x[key]] for x in made], pa.list_(pa.struct([(c, pa.int64() if c == "region_id" else pa.string()) for c in names])))
        one = lambda key, i, kind: pad([x[key][i] if x[key] else None for x in made], kind)
        columns = [pad([r["job_id"] for r in rows], pa.string()), pad([r["page_number"] for r in rows], pa.int32()), pad([r["joined"] for r in rows], pa.bool_())]
        columns += [pair(("region_id", "line"), "furniture"), pair(("region_id", "word"), "words"), pair(("region_id", "left", "right"), "broken")]
        columns += [one("first", 0, pa.int64()), one("first", 1, pa.string()), one("last", 0, pa.int64()), one("last", 1, pa.string())]
        columns += [pa.array([*[None] * n, *v], k) for v, k in ((keys, pa.string()), ([clean[w] for w in keys], pa.int64()), ([total[w] for w in keys], pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SEEN.split(", ")])

    return kept(map_arrow(paged, run, _SEEN))


#: Letters up to which a word's variants are made; longer ones are compared with words of the same skeleton.
MADE = 64
# What misread characters have in common with the printed ones.
_SKELETON = str.maketrans({**dict.fromkeys("ltif17ruünmhb68é", "i"), **dict.fromkeys("ceo03", "c"), "d": "ci", "w": "v", "9": "g", "q": "g", "5": "s", "4": "a"})


def skeleton(word: str) -> str:
    """The same for a word and whatever it may be a misreading of, by any number of characters."""
    return re.sub("i+", "i", re.sub("v+", "v", word.translate(_SKELETON)))


def changes(word: str, right: str, most: int = 2) -> int:
    """How many misread places lead from right to word; most + 1 if more."""
    i = 0
    while i < len(word) and i < len(right) and word[i] == right[i]:
        i += 1
    if word[i:] == right[i:]:
        return 0
    if not most:
        return 1
    return min((1 + changes(word[i + len(a) :], right[i + len(b) :], most - 1) for a, b in MISREAD if word.startswith(a, i) and right.startswith(b, i)), default=most + 1)


def variants(word: str, most: int = 2) -> dict[str, int]:
    """What a word may be if one or two of its places were misread, and how many."""
    out: dict[str, int] = {}
    frontier = [(word, 0)]
    for n in range(1, most + 1):
        fresh = []
        for w, at in frontier:
            for read_as, printed in MISREAD:
                i = w.find(read_as, at)
                while i >= 0:
                    v = w[:i] + printed + w[i + len(read_as) :]
                    if v not in out and v != word:
                        out[v] = n
                        fresh.append((v, i + len(printed)))
                    i = w.find(read_as, i + 1)
        frontier = fresh
    return out


def corrections(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, right) of (word, n): the frequent word that each is a misreading of; others give no row.

    Variants are made in Python and joined with the counts; very long words are
    joined by their skeleton and compared. Of those that are frequent enough the
    one with fewest changes, then the most frequent, is taken.
    """
    usual = counts.where((F.col("total") >= KNOWN) & (F.col("clean") >= 1)).select(F.col("word").alias("right"), "total")
    w = words.where(~F.col("word").rlike(r"^\d+(st|nd|rd|th)$"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [(word, k, v, c) for word, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for v, c in variants(word).items()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int32()))], names=["word", "n", "right", "changes"])

    short = map_arrow(w.where(F.length("word") <= MADE).select("word", "n"), run, "word string, n bigint, right string, changes int", spread=False).join(usual, "right")
    bones = lambda df, c: map_arrow(df.where(F.length(c) > MADE - 4).select(c), lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([skeleton(x) for x in b.column(0).to_pylist()], pa.string())], names=[c, "bones"]), f"{c} string, bones string", spread=False)

    def compare(b: pa.RecordBatch) -> pa.RecordBatch:
        n = [changes(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32())], names=["word", "right", "changes"])

    long = bones(w.where(F.length("word") > MADE), "word").join(bones(usual, "right"), "bones").where("word <> right").select("word", "right")
    long = map_arrow(long, compare, "word string, right string, changes int", spread=False).where("changes <= 2").join(w.select("word", "n"), "word").join(usual, "right")
    good = short.unionByName(long.select(*short.columns)).where(F.col("total") >= TIMES * F.col("n"))
    return good.groupBy("word").agg(F.min_by("right", F.struct("changes", -F.col("total"), "right")).alias("right"))


def broken_forms(broken: DataFrame) -> DataFrame:
    """(region_id, whole, hyphened, middle, tail, head) of (region_id, left, right): the forms that a broken word is looked up by. A hyphen that stands for a left-out part breaks no word."""
    suspended = F.lower(F.regexp_replace("right", r"[^\p{L}]", "")).isin(*_SUSPENDED)
    clean = lambda c: F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    b = broken.where(~suspended).select("region_id", F.regexp_replace(F.lower("left"), r"^[^\p{L}\p{N}]+", "").alias("left"), clean(F.col("right")).alias("right"))
    b = b.withColumn("tail", F.regexp_extract("left", r"[^'’-]*$", 0)).withColumn("head", F.regexp_extract("right", r"^[^'’-]*", 0))
    return b.select("region_id", F.concat("left", "right").alias("whole"), F.concat_ws("-", "left", "right").alias("hyphened"), F.concat("tail", "head").alias("middle"), "tail", "head")


FORMS = ("whole", "hyphened", "middle", "tail", "head")


def mended(forms: DataFrame, looked: DataFrame) -> DataFrame:
    """(region_id, fixed, odd): the whole word, with the hyphen where the corpus writes it so; odd: the corpus has it nowhere else. looked: word, total."""
    each = forms.withColumn("f", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).alias("word")) for i, c in enumerate(FORMS))))).select("region_id", "whole", "hyphened", "tail", "head", F.col("f.i").alias("i"), F.col("f.word").alias("word"))
    hit = each.join(looked.select("word", "total"), "word", "left").groupBy("region_id", "whole", "hyphened", "tail", "head").agg(*(F.coalesce(F.max(F.when(F.col("i") == i, F.col("total"))), F.lit(0)).alias(f"n_{c}") for i, c in enumerate(FORMS)))
    keep = F.when((F.col("n_hyphened") > 0) | (F.col("n_whole") > 0), F.col("n_hyphened") > F.col("n_whole")).when(F.col("n_middle") > 0, F.lit(False)).otherwise((F.col("n_tail") >= 3) & (F.col("n_head") >= 3) & (F.length("tail") >= 3) & (F.length("head") >= 3))
    return hit.select("region_id", F.when(keep, F.col("hyphened")).otherwise(F.col("whole")).alias("fixed"), (~keep & (F.col("n_whole") == 0)).alias("odd"))


def page_pairs(pages: DataFrame, shared: Shared) -> DataFrame:
    """(last_id, last_text, first_id, first_text) of consecutive pages of jobs whose pages are joined, where the second goes on with the first."""
    first = pages.where("first_id IS NOT NULL").select("job_id", "page_number", "first_id", "first_text")
    last = pages.where("last_id IS NOT NULL AND joined").select("job_id", (F.col("page_number") + 1).alias("page_number"), "last_id", "last_text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(carries_on(shared.get(), list(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True))), pa.bool_()))

    return map_arrow(last.join(first, ["job_id", "page_number"]).select("last_id", "last_text", "first_id", "first_text"), run, "last_id bigint, last_text string, first_id bigint, first_text string", spread=False)


def word_counts(found: DataFrame) -> DataFrame:
    """(word, clean, total) of what ``seen`` gives: how often each word stands on digital pages, and on all."""
    return found.where("word IS NOT NULL").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("total").alias("total"))


def sent(spark: SparkSession, chain: Chain) -> Shared:
    """A model for the workers, without the weights that are zero."""
    rows = np.flatnonzero(np.abs(chain.weights).max(axis=1) > 1e-4)

    def load(v: tuple) -> Chain:
        c = Chain(len(LABELS), BITS)
        c.weights[v[0]], c.edges = v[1], v[2]
        return c

    return Shared(spark, (rows, chain.weights[rows], chain.edges), load)


def flaws(spark: SparkSession, regions: DataFrame, pages: DataFrame, options: DataFrame, deliveries: DataFrame | None = None) -> DataFrame:
    """(region_id, flaw, fixed) as the problem states them. regions: one row a region_id; deliveries: the rows they come from."""
    paged = kept(paged_regions(regions, pages, options, deliveries))
    shared = sent(spark, fitted(paged))
    found = seen(paged, shared)
    counts = word_counts(found)
    on = found.where("word IS NULL")
    pairs = page_pairs(on, shared)
    over = F.when(F.col("last_text").rlike(rf"\p{{L}}[-{BREAKS}]$") & F.col("first_text").rlike(r"^\p{Ll}"), F.struct(F.col("last_id").alias("region_id"), F.regexp_replace(F.regexp_extract("last_text", r"(\S+)$", 1), f"[-{BREAKS}]$", "").alias("left"), F.regexp_extract("first_text", r"^(\S+)", 1).alias("right")))
    pairs = kept(pairs.select("last_id", "first_id", over.alias("over")))
    forms = broken_forms(on.select(F.explode("broken").alias("b")).select("b.*").unionByName(pairs.where("over IS NOT NULL").select("over.*"))).distinct()
    words = on.select(F.explode("words").alias("w")).select("w.*")
    # Every word that is asked for is looked up once: those of scanned pages, and the forms of broken ones.
    asked = words.select("word", F.lit(1).alias("as_word"), F.lit(0).alias("as_form")).unionByName(forms.select(F.explode(F.array(*FORMS)).alias("word"), F.lit(0).alias("as_word"), F.lit(1).alias("as_form")))
    looked = kept(asked.groupBy("word").agg(F.max("as_word").alias("as_word"), F.max("as_form").alias("as_form")).join(counts, "word", "left").where("as_form = 1 OR coalesce(clean, 0) = 0"))
    right = kept(corrections(looked.where("coalesce(clean, 0) = 0").select("word", F.coalesce("total", F.lit(1)).alias("n")), counts))
    misread = words.join(right, "word").select("region_id", F.lit("misread").alias("flaw"), F.col("right").alias("fixed"))
    furniture = on.select(F.explode("furniture").alias("f")).select("f.region_id", F.lit("furniture").alias("flaw"), F.col("f.line").alias("fixed"))
    split = pairs.select(F.col("last_id").alias("region_id"), F.lit("split").alias("flaw"), F.col("first_id").cast("string").alias("fixed"))
    fixed = mended(forms, looked.where("as_form = 1"))
    hyphen = fixed.join(right, F.col("odd") & (F.col("fixed") == F.col("word")), "left").select("region_id", F.lit("hyphen").alias("flaw"), F.coalesce("right", "fixed").alias("fixed"))
    return misread.unionByName(furniture).unionByName(split).unionByName(hyphen).distinct()
