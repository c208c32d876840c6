"""Problem 7: passages of test items in texts, by counted q-grams in diagonal bands and verification of what is left.

Texts and items are reduced to letters and digits: case, accents, look-alikes,
widths, punctuation and white space are gone, so a passage keeps its form
whatever its layout. A passage of w words of an item, w at least half of the
item's, with at most a tenth of them replaced, shares a number of q-grams with
the item that the q-gram lemma bounds from below; they lie on diagonals that
differ by no more than the replaced words' lengths, which sets the width of the
item's bands. So of each text only pairs (item, band) with as many hits are
kept, and these are aligned within the band: runs of hits on a diagonal are
exact matches, the best chain of them is the alignment's frame, and what lies
between two of them is aligned word by word.

Items are taken in blocks of bounded size, each broadcast and held against all
texts. Null and empty texts and items without letters give no row. Equal texts
under other ids each give their rows.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesmith.llm.common import FOLD, INVISIBLE, Shared, map_arrow

#: Share of an item's words that a passage needs, and share of its words that may be replaced.
LEAST, REPLACED = 0.5, 0.1
#: Least diagonals of a band, and by how many characters a replaced word may be longer or shorter than the item's: a band is twice as wide as an item's replaced words may drift together, and bands overlap by half, so that one of them holds the whole passage.
BAND, DRIFT = 128, 64
#: Places of one q-gram in an item from which it is no seed, if the item's bound stays positive without it.
FREQUENT = 32
#: Characters of items in a block that is broadcast at once.
BLOCK_CHARS = 8_000_000
#: Lengths of q-grams, tried from the longest: the first whose bound by the lemma is positive for the item.
Q = (16, 8, 4, 2, 1)


@cache
def _table() -> np.ndarray:
    """Letter or digit that a code point counts as; 0: none, 1: white space."""
    t = np.zeros(0x110000, dtype=np.uint32)
    own = [(0xD800, 0xE000), (0x3400, 0xA000), (0xAC00, 0xD7B0), (0x20000, 0xE0000)]
    for a, b in own:
        t[a:b] = np.arange(a, b)
    for o in range(0x20000):
        if any(a <= o < b for a, b in own):
            continue
        c = chr(o)
        if c.isspace():
            t[o] = 1
            continue
        c = FOLD.get(o, c)
        d = unicodedata.normalize("NFKD", c)
        c = FOLD.get(ord(d[0]), d[0]) if unicodedata.category(d[0])[0] in "LN" else c
        k = unicodedata.category(c)
        if k[0] in "LN" or k == "Mc" or (k == "Mn" and not 0x300 <= ord(c) < 0x370 and c not in INVISIBLE and c not in "़়"):
            t[o] = ord(c.lower()[0])
    return t


_WIDE = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


@dataclass
class Reduced:
    """Letters and digits of several texts, one after the other."""

    code: np.ndarray  # the characters
    word: np.ndarray  # number of the word that each is in, counted through all texts
    at: np.ndarray  # where each text starts, and the end


def reduce(texts: list[str]) -> Reduced:
    joined = "".join(texts)
    if not joined.isascii() and any(c in joined for c in _WIDE):
        texts = [t if t.isascii() else "".join(_WIDE.get(c, c) for c in t) for t in texts]
        joined = "".join(texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    code = _table()[raw]
    kept = code > 1
    # A word starts with the first kept character after white space or after the start of a text.
    gap = np.cumsum(code == 1)
    at = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
    gap = gap[kept] if len(raw) else gap
    starts = np.ones(len(gap), dtype=bool)
    starts[1:] = gap[1:] != gap[:-1]
    starts[at[:-1][at[:-1] < len(gap)]] = True
    return Reduced(code[kept].astype(np.uint64), np.cumsum(starts) - 1, at)


def grams(code: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram that starts at each place but the last q - 1; q is a power of two."""
    h = code * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    mul, n = 0xBF58476D1CE4E5B9, 1
    while n < q:
        h = h[:-n] * np.uint64(mul & 0xFFFFFFFFFFFFFFFF) + h[n:] if len(h) > n else h[:0]
        mul, n = mul * mul, 2 * n
    return h ^ (h >> np.uint64(32))


def bound(lengths: np.ndarray, q: int) -> int:
    """The fewest q-grams that a passage of the item shares with it, by the lemma; lengths: characters of each word."""
    n = len(lengths)
    total = np.concatenate([[0], np.cumsum(lengths)])
    longest = np.concatenate([[0], np.cumsum(np.sort(lengths)[::-1])])
    least = None
    for w in range(max(1, int(np.ceil(n * LEAST))), n + 1):
        chars = total[w:] - total[:-w]
        e = int(w * REPLACED)
        # A replaced word of c characters touches c + q - 1 q-grams; of long items the longest words of the whole item stand for those of a passage, which makes the bound lower, not wrong.
        lost = (np.sort(np.lib.stride_tricks.sliding_window_view(lengths, w), axis=1)[:, w - e :].sum(axis=1) if n <= 200 else longest[e]) + e * (q - 1)
        low = int((chars - q + 1 - lost).min())
        least = low if least is None else min(least, low)
    return least or 0


def limit(lengths: np.ndarray) -> tuple[int, int]:
    """The longest q whose bound is positive, and that bound."""
    for q in Q:
        if (b := bound(lengths, q)) > 0:
            return q, b
    return Q[-1], 1


def limits(texts: list[str]) -> list[tuple[int, int]]:
    """Of each text its length of q-grams and its bound; texts without letters have any."""
    r = reduce(texts)
    words = [r.word[a:b] for a, b in zip(r.at, r.at[1:])]
    return [limit(np.bincount(w - w[0])) if len(w) else (Q[-1], 1) for w in words]


class Items:
    """Items prepared for search: of each q used, the sorted q-grams with where they occur."""

    def __init__(self, ids: list[int], texts: list[str], limits: list[tuple[int, int]] | None = None):
        """limits: of each item its length of q-grams and its bound, where they are known."""
        r = reduce(texts)
        self.ids, self.code, self.at = ids, r.code, r.at
        self.words = []  # of each item the start of each word, and its end
        by_q: dict[int, list[int]] = {}
        self.least = np.zeros(len(ids), dtype=np.int64)
        self.width = np.full(len(ids), BAND, dtype=np.int64)
        for i in range(len(ids)):
            w = r.word[r.at[i] : r.at[i + 1]]
            starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
            self.words.append(np.concatenate([starts, [len(w)]]))
            if len(w):
                lengths = np.diff(self.words[i])
                q, self.least[i] = limits[i] if limits else limit(lengths)
                self.width[i] = max(BAND, 2 * DRIFT * int(len(lengths) * REPLACED))
                by_q.setdefault(q, []).append(i)
        self.index = {}
        for q, members in by_q.items():
            h, item, pos = [], [], []
            for i in members:
                g = grams(self.code[self.at[i] : self.at[i + 1]], q)
                places = np.arange(len(g), dtype=np.int64)
                _, back, count = np.unique(g, return_inverse=True, return_counts=True)
                often = count[back] > FREQUENT
                if often.any() and self.least[i] > often.sum():
                    # A passage can lose no more hits than there are such places, so the bound stays one.
                    self.least[i] -= often.sum()
                    g, places = g[~often], places[~often]
                h.append(g)
                item.append(np.full(len(g), i, dtype=np.int64))
                pos.append(places)
            h, item, pos = np.concatenate(h), np.concatenate(item), np.concatenate(pos)
            order = np.argsort(h, kind="stable")
            h, item, pos = h[order], item[order], pos[order]
            keys, first = np.unique(h, return_index=True)
            bitmap = np.zeros(1 << 22, dtype=bool)
            bitmap[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.index[q] = (keys, np.concatenate([first, [len(h)]]), item, pos, bitmap)


def _segments(r: Reduced, items: Items, q: int) -> np.ndarray:
    """Exact matches in bands with enough hits: rows (text, item, place in text, place in item, length, band)."""
    keys, first, item, pos, bitmap = items.index[q]
    h = grams(r.code, q)
    none = np.zeros((0, 6), dtype=np.int64)
    hit = np.flatnonzero(bitmap[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
    if not len(hit):
        return none
    k = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1)
    same = keys[k] == h[hit]
    hit, k = hit[same], k[same]
    text = np.searchsorted(r.at, hit, side="right") - 1
    # Not over the end of a text.
    inside = hit + q <= r.at[text + 1]
    hit, k, text = hit[inside], k[inside], text[inside]
    if not len(hit):
        return none
    n = first[k + 1] - first[k]
    where = np.repeat(first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    text, place = np.repeat(text, n), np.repeat(hit, n)
    place = place - r.at[text]
    it, ip = item[where], pos[where]
    diag = place - ip
    kept = []
    low = int(diag.min())
    for half in (0, 1):
        band = (diag - low + half * (items.width[it] // 2)) // items.width[it]
        group = (text * len(items.ids) + it) * (int(band.max()) + 1) + band
        _, back, count = np.unique(group, return_inverse=True, return_counts=True)
        ok = count[back] >= items.least[it]
        kept.append(np.stack([text[ok], it[ok], place[ok], ip[ok], diag[ok], band[ok] * 2 + half], axis=1))
    rows = np.concatenate(kept)
    if not len(rows):
        return none
    rows = rows[np.lexsort((rows[:, 2], rows[:, 4], rows[:, 5], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, [0, 1, 4, 5]] != rows[:-1, [0, 1, 4, 5]]).any(axis=1) | (rows[1:, 2] != rows[:-1, 2] + 1)
    at = np.flatnonzero(new)
    size = np.diff(np.concatenate([at, [len(rows)]])) + q - 1
    s = rows[at]
    return np.stack([s[:, 0], s[:, 1], s[:, 2], s[:, 3], size, s[:, 5]], axis=1)


def _passage(segments: list[tuple[int, int, int]], words: np.ndarray, code: np.ndarray, item: np.ndarray, word: np.ndarray) -> bool:
    """Whether the exact matches (place in text, place in item, length) of a band make a passage; word: the number of the word of each character of the text."""
    n = len(words) - 1
    need = int(np.ceil(n * LEAST))
    # The chain of matches that covers most of the item.
    segments = sorted(segments, key=lambda s: (s[1], s[0]))
    ds, is_, ss = np.array(segments, dtype=np.int64).T
    best, before = ss.copy(), np.full(len(segments), -1)
    for j in range(1, len(segments)):
        cut = np.maximum(0, np.maximum(is_[:j] + ss[:j] - is_[j], ds[:j] + ss[:j] - ds[j]))
        gain = np.where((ds[:j] < ds[j]) & (is_[:j] < is_[j]) & (cut < ss[j]), best[:j] + ss[j] - cut, 0)
        k = int(gain.argmax())
        if gain[k] > best[j]:
            best[j], before[j] = gain[k], k
    j = int(best.argmax())
    chain = []
    while j >= 0:
        chain.append(segments[j])
        j = before[j]
    chain.reverse()
    # Of each word of the item: 0 not in the text, 1 replaced, 2 there; and where the run breaks.
    state = np.zeros(n, dtype=np.int8)
    breaks = np.zeros(n + 1, dtype=bool)
    covered = np.zeros(words[-1], dtype=bool)
    for d, i, size in chain:
        covered[i : i + size] = True
    whole = np.add.reduceat(covered, words[:-1]) == np.diff(words)
    state[whole] = 2
    lo = int(np.searchsorted(words, chain[0][1], side="left"))
    hi = int(np.searchsorted(words, chain[-1][1] + chain[-1][2], side="right")) - 1
    # A first or last word that goes on in the text is another word.
    d, i, _ = chain[0]
    if lo < n and words[lo] == i and d > 0 and word[d] == word[d - 1]:
        state[lo] = 0
    d, i, size = chain[-1]
    if hi > 0 and words[hi] == i + size and d + size < len(word) and word[d + size] == word[d + size - 1]:
        state[hi - 1] = 0
    for (d1, i1, s1), (d2, i2, _) in zip(chain, chain[1:]):
        end_i, end_d = i1 + s1, d1 + s1
        a = int(np.searchsorted(words, min(end_i, i2), side="right")) - 1
        b = int(np.searchsorted(words, max(end_i, i2), side="left"))
        gap_i, gap_d = i2 - end_i, d2 - end_d
        if gap_i <= 0 and gap_d <= 0:
            continue
        if gap_i <= 0:
            # Characters of the text between two neighbours of the item: a word put in breaks the run.
            if gap_d - gap_i > 0 and word[d2 - gap_i if gap_i < 0 else d2] - word[end_d - 1] > 1:
                breaks[max(a, 0)] = True
            continue
        # Words a to b of the item against the words of the text in their place.
        left = int(words[a])
        start = end_d - (end_i - left)
        theirs = np.unique(word[max(start, 0) : max(d2 + int(words[b] - i2), 0)], return_index=True)[1] + max(start, 0) if b <= n else np.zeros(0, int)
        stop = d2 + int(words[b] - i2)
        if len(theirs) == b - a:
            edges = [*theirs.tolist(), stop]
            for k in range(b - a):
                x, y = code[edges[k] : edges[k + 1]], item[words[a + k] : words[a + k + 1]]
                state[a + k] = 2 if len(x) == len(y) and (x == y).all() else 1
        elif 0 < gap_d <= 2 * gap_i + 24 and abs(len(theirs) - (b - a)) <= max(1, (b - a) // 2):
            state[a:b][state[a:b] == 0] = 1
        else:
            breaks[a : b + 1] = True
    # Beyond the chain words are compared one by one: one that stands alone between replaced ones is too short for a match.
    theirs = np.concatenate([np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])), [len(word)]])
    same = lambda k, o: np.array_equal(code[theirs[o] : theirs[o + 1]], item[words[k] : words[k + 1]])
    there = np.flatnonzero(state == 2)
    if len(there):
        d, i, _ = chain[0]
        k = int(there[0])
        at = d + int(words[k]) - i
        o = int(np.searchsorted(theirs, at))
        if 0 <= at < len(word) and theirs[o] == at:
            while k > 0 and o > 0:
                k, o = k - 1, o - 1
                state[k] = 2 if same(k, o) else 1
        d, i, _ = chain[-1]
        k = int(there[-1]) + 1
        at = d + int(words[k]) - i
        o = int(np.searchsorted(theirs, at))
        if 0 <= at < len(word) and theirs[o] == at:
            while k < n and o < len(theirs) - 1:
                state[k] = 2 if same(k, o) else 1
                k, o = k + 1, o + 1
    # A run: words there or replaced, without a break; it starts and ends with a word that is there.
    bad = np.concatenate([[0], np.cumsum(state == 1)])
    out = np.concatenate([[0], np.cumsum((state == 0) | breaks[:-1])])
    for start in np.flatnonzero(state == 2).tolist():
        ends = np.arange(start + need, n + 1)
        if not len(ends):
            break
        size = ends - start
        first_break = int(breaks[start])
        fine = (state[ends - 1] == 2) & (out[ends] - out[start] - first_break * (state[start] != 0) <= 0) & (bad[ends] - bad[start] <= np.floor(size * REPLACED + 1e-9))
        if fine.any():
            return True
    return False


def search(texts: list[str], items: Items) -> list[tuple[int, int]]:
    """(number of the text, item_id) of each leak."""
    r = reduce(texts)
    found: set[tuple[int, int]] = set()
    for q in items.index:
        s = _segments(r, items, q)
        if not len(s):
            continue
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:, [0, 1, 5]] != s[:-1, [0, 1, 5]]).any(axis=1)
        bounds = [*np.flatnonzero(new).tolist(), len(s)]
        for a, b in zip(bounds, bounds[1:]):
            t, i = int(s[a, 0]), int(s[a, 1])
            if (t, items.ids[i]) in found:
                continue
            lo, hi = r.at[t], r.at[t + 1]
            if _passage([tuple(x) for x in s[a:b, 2:5].tolist()], items.words[i], r.code[lo:hi], items.code[items.at[i] : items.at[i + 1]], r.word[lo:hi]):
                found.add((t, items.ids[i]))
    return sorted(found)


def leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item): every text that holds a passage of an item."""
    spark: SparkSession = documents.sparkSession
    wanted = benchmark.where(F.col(item_text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("bigint").alias("item"), F.col(item_text).alias("text")).distinct()
    chars = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(chars) // block_chars))
    kind = dict(documents.dtypes)[key]
    source = documents.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(key, text)
    result = None
    for n in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == n).collect()
        texts = [x["text"] for x in rows]
        shared = Shared(spark, ([x["item"] for x in rows], texts, limits(texts)), lambda v: Items(*v))

        def run(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            prepared = shared.get()
            keys, docs = [], []
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                for t, i in search(texts[at : at + 500], prepared):
                    docs.append(at + t)
                    keys.append(i)
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs, pa.int64())), pa.array(keys, pa.int64())], names=[key, item])

        part = map_arrow(source, run, f"`{key}` {kind}, `{item}` bigint")
        result = part if result is None else result.unionByName(part)
    return result.distinct()

