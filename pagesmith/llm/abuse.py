"""Problem 8: abusive, hateful and sexual content, by a linear-chain conditional random field over tokens.

Tokens are first brought to one form: look-alikes and characters without width
are gone, letters spelled apart are joined, stretched letters shortened, digits
and signs that stand for letters read as those, and a word with asterisks is
scored as the worst known word that it can be. Scripts without spaces are
labelled by character. Forward-backward gives each token its probability to be
in a toxic span; a sentence's score is their mean, or that of its surest four if
three are sure; of one or two tokens it is the least. Every sentence of every
document is scored; the document's score is the highest.

Training (on the driver): fixed labelled sentences, and the reviewers' verdicts
on a bounded sample of documents (TRAIN_TOXIC, TRAIN_CLEAN). Verdicts hold for
whole documents, may be wrong and may contradict each other; the majority
counts, ties and nulls do not. Within a document marked toxic the sentences
whose words lean clearly to such documents are labelled, the others are not
used; documents marked clean are clean but for sentences that lean as clearly.

Null, empty and blank texts have score 0 and no spans.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesmith.llm.abuse_seeds import ADDRESS, CLEAN, FRAMES, NAMES, TOXIC
from pagesmith.llm.common import FOLD, INVISIBLE, LOOK_ALIKE, Shared, bounded_sample, lists, map_arrow
from pagesmith.llm.crf import Chain, batches

BITS = 18
MASK = (1 << BITS) - 1
#: Documents of the sample: those marked toxic, those marked clean, and any others, which are the background that words lean against.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_OTHERS = 3000, 4000, 6000
#: Mean log odds from which a sentence of a document marked toxic is taken for the toxic one.
CLEAR = 2.0
#: Score from which a document is a case.
THRESHOLD = 0.5

_MARKS = "̀-ͯऀ-ःऺ-ॏ॑-ॗॢॣঁ-৿஀-௿ؐ-ًؚ-ٰٟ"
_TOKEN = re.compile(rf"[぀-ヿ㐀-鿿々]|[฀-๿]|(?:(?![฀-๿぀-ヿ㐀-鿿々])[\w$@*{_MARKS}{INVISIBLE}])+|[.!?。！？।۔؟\n]+")
_PLAIN = re.compile(r"[a-z]+|[^\W\d_a-z]+")
_SPELLED = re.compile(rf"(?<![\w{_MARKS}])[^\W\d_](?:([ .\-·_])[^\W\d_])(?:\1[^\W\d_])+(?![\w{_MARKS}])")
_STRETCHED = re.compile(r"(\w)\1{2,}")
_END = frozenset(".!?。！？।۔؟\n")
# Signs that stand for letters.
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a"})
_INVISIBLE = dict.fromkeys(map(ord, INVISIBLE))
_LETTER = re.compile(r"[^\W\d_]")


def plain(token: str) -> str:
    """The form in which a token is looked up."""
    w = token
    if not w.isascii():
        w = w.translate(_INVISIBLE)
        if any(c in LOOK_ALIKE or ord(c) >= 0xFF00 for c in w) and (any("a" <= c.lower() <= "z" for c in w) or all(c in LOOK_ALIKE or ord(c) >= 0xFF00 or not c.isalpha() for c in w)):
            w = w.translate(FOLD)
    w = w.casefold()
    if any(c in "0134578$@9" for c in w) and _LETTER.search(w) and sum(c.isdigit() for c in w) <= len(w) // 2 + 1:
        w = w.translate(_SIGNS)
    w = _STRETCHED.sub(r"\1", w)
    return "#" if w.isdigit() else w


def _h(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts)) & MASK


@dataclass
class Tokens:
    """Tokens of a text: forms, places, kind of the edge into each, its sentence."""

    forms: list[str]
    at: list[tuple[int, int]]
    edge: list[int]


class Model:
    """The fitted chain with the numbers of the words met so far; labels: 0 clean, 1 toxic."""

    def __init__(self, chain: Chain, vocabulary: list[str]):
        self.chain, self.vocabulary = chain, vocabulary
        d = chain.weights
        self.lean = (d[:, 1] - d[:, 0]).astype(np.float32)
        self.stars: dict[str, str] = {}
        self.by_length: dict[int, list[str]] = {}
        for w in vocabulary:
            self.by_length.setdefault(len(w), []).append(w)
        self.forget()

    def forget(self) -> None:
        self.of: dict[str, int] = {}
        self.codes: list[int] = []
        self.ends: list[bool] = []
        self.address: list[bool] = []

    @staticmethod
    def load(v: tuple) -> Model:
        rows, values, edges, words = v
        c = Chain(2, BITS)
        c.weights[rows] = values
        c.edges = edges
        return Model(c, words)

    def dump(self) -> tuple:
        rows = np.flatnonzero(np.abs(self.chain.weights).max(axis=1) > 1e-3)
        return rows, self.chain.weights[rows], self.chain.edges, self.vocabulary

    def form(self, token: str) -> str:
        w = plain(token)
        if "*" in w and _LETTER.search(w):
            if w not in self.stars:
                if len(self.stars) > 100_000:
                    self.stars.clear()
                p = re.compile("".join("." if c == "*" else re.escape(c) for c in w))
                fits = [x for x in self.by_length.get(len(w), ()) if p.fullmatch(x)]
                self.stars[w] = max(fits, key=lambda x: self.lean[_h("w", x)], default=w)
            return self.stars[w]
        return w

    def number(self, token: str) -> int:
        """Numbers are by token as it stands; the code of its form is what features are made of."""
        w = self.form(token)
        self.of[token] = n = len(self.codes)
        self.codes.append(_h("w", w))
        self.ends.append(token[0] in _END)
        self.address.append(plain(token) in ADDRESS)
        return n


def tokens(text: str) -> tuple[list[str], str]:
    """Tokens of a text and the text they were taken from, in which letters spelled apart are joined (padded, so that places stay)."""
    if _SPELLED.search(text):
        text = _SPELLED.sub(lambda m: m.group().replace(m.group(1), "").ljust(len(m.group())), text)
    return _TOKEN.findall(text), text


def feature_rows(codes: np.ndarray) -> np.ndarray:
    """Features of a chain of codes: the word, it with the one before and after, and those two with it."""
    n = len(codes)
    before, after, two = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    before[1:], after[:-1], two[2:] = codes[:-1], codes[1:], codes[:-2]
    mix = lambda a, b, s: ((a * 0x9E3779B1 + b * 0x85EBCA77 + s) ^ ((a * 0xC2B2AE3D + b) >> 13)) & MASK
    return np.stack([codes, mix(before, codes, 1), mix(codes, after, 2), mix(mix(two, before, 3), codes, 4)], axis=1)


def score(model: Model, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int, float]]]]:
    """Of each text its score and its toxic spans (start, end, score)."""
    if len(model.of) > 400_000:
        model.forget()
    numbers: list[list[int]] = []
    get = model.of.get
    taken: list[str] = []
    for t in texts:
        if not t:
            numbers.append([])
            taken.append("")
            continue
        found, u = tokens(t)
        got = list(map(get, found))
        if None in got:
            got = [model.number(w) if (n := get(w)) is None else n for w in found]
        numbers.append(got)
        taken.append(u)
    codes, ends = np.array(model.codes, dtype=np.int64), np.array(model.ends, dtype=bool)
    sizes = np.array([len(n) for n in numbers])
    flat = np.fromiter((x for n in numbers for x in n), np.int64, int(sizes.sum()))
    at = np.concatenate([[0], np.cumsum(sizes)])
    result: list[tuple[float, list[tuple[int, int, float]]]] = [(0.0, [])] * len(texts)
    if not len(flat):
        return result
    c, e = codes[flat], ends[flat]
    # Texts are parted by two codes that no word has, so that no feature reaches over.
    spread = np.arange(len(flat)) + 2 * np.repeat(np.arange(len(texts)), sizes)
    wide = np.zeros(len(flat) + 2 * len(texts), dtype=np.int64)
    wide[spread] = c
    lean = model.lean[feature_rows(wide)].sum(axis=1)[spread]
    edge = np.zeros(len(flat), dtype=np.int8)
    edge[1:] = e[:-1]
    p = np.zeros(len(flat))
    for g in batches([int(n) for n in sizes], most=200_000):
        length = int(sizes[g].max())
        inside = np.arange(length) < sizes[g][:, None]
        places = np.where(inside, at[:-1][g][:, None] + np.arange(length), 0)
        s = np.zeros((len(g), length, 2), np.float32)
        s[:, :, 1] = np.where(inside, lean[places], 0)
        m, _ = model.chain.marginals(s, np.where(inside, edge[places], 0), inside)
        p[places[inside]] = m[:, :, 1][inside]
    # Sentences: tokens of a text up to a final mark.
    owner = np.repeat(np.arange(len(texts)), sizes)
    word = np.flatnonzero(~e)
    if not len(word):
        return result
    cut = np.ones(len(word), dtype=bool)
    cut[1:] = (np.diff(word) > 1) | (owner[word[1:]] != owner[word[:-1]])
    first = np.flatnonzero(cut)
    n = np.diff(np.append(first, len(word)))
    q = p[word]
    value = np.add.reduceat(q, first) / n
    # A few tokens that are sure make a long sentence a case.
    for k in np.flatnonzero(np.add.reduceat((q > 0.5).astype(np.int64), first) >= 3).tolist():
        value[k] = max(value[k], float(np.sort(q[first[k] : first[k] + n[k]])[-4:].mean()))
    # Of one or two tokens all must pass, as there is no run that bears the one out, and not all may be words of address.
    address = np.array(model.address, dtype=bool)[flat[word]]
    short = n < 3
    value[short] = np.where(np.logical_and.reduceat(address, first), 0.0, np.minimum.reduceat(q, first))[short]
    text = owner[word[first]]
    best = np.zeros(len(texts))
    np.maximum.at(best, text, value)
    spans: dict[int, list[tuple[int, int, float]]] = {}
    found_at: dict[int, list[tuple[int, int]]] = {}
    for k in np.flatnonzero(value > THRESHOLD).tolist():
        i = int(text[k])
        sure = word[first[k] : first[k] + n[k]][q[first[k] : first[k] + n[k]] > 0.5] - at[i]
        if len(sure):
            if i not in found_at:
                found_at[i] = [x.span() for x in _TOKEN.finditer(taken[i])]
            where = found_at[i]
            spans.setdefault(i, []).append((where[int(sure[0])][0], where[int(sure[-1])][1], float(value[k])))
    return [(float(v), spans.get(i, [])) for i, v in enumerate(best)]


def _sentences(forms: list[str], ends: list[bool]) -> list[list[str]]:
    out, now = [], []
    for w, e in zip(forms, ends, strict=True):
        if e:
            if now:
                out.append(now)
            now = []
        else:
            now.append(w)
    return [*out, now] if now else out


def train(toxic: list[str], clean: list[str], others: list[str] = ()) -> Model:  # type: ignore[assignment]
    """A model from the fixed sentences, texts of documents that reviewers found toxic and clean, and texts of any documents, most of them clean."""

    def cut(text: str) -> list[list[str]]:
        found, _ = tokens(text)
        return _sentences([plain(w) for w in found], [w[0] in _END for w in found])

    lines = [line for block in TOXIC.values() for line in block.split("\n")]
    lines += [f.format(NAMES[i % len(NAMES)], NAMES[(i + 5) % len(NAMES)]) for i in range(len(NAMES)) for f in FRAMES]
    bad = [s for line in lines for s in cut(line)]
    good = [s for line in CLEAN.split("\n") for s in cut(line)]
    t_docs, c_docs = [cut(t) for t in toxic], [cut(t) for t in [*clean, *others]]
    # How words, and pairs of words, lean: documents that have them, of either kind.
    def keys(s: list[str]) -> set:
        return set(s) | set(zip(s, s[1:]))

    in_toxic, in_clean = Counter(), Counter()
    for docs, count in ((t_docs, in_toxic), (c_docs, in_clean)):
        for d in docs:
            count.update(set().union(*(keys(s) for s in d)) if d else ())
    nt, nc = max(1, len(t_docs)), max(1, len(c_docs))

    def lean(s: list[str]) -> float:
        """Mean log odds of what toxic documents hold often enough to tell, at the lower end of its error; 0 where little does."""
        known = [k for k in keys(s) if in_toxic[k] >= 3]
        if len(known) < 3 or len(known) < 0.5 * len(set(s)):
            return 0.0
        t = np.array([in_toxic[k] for k in known], dtype=float)
        c = np.array([in_clean[k] for k in known], dtype=float)
        return float(np.mean(np.log((t - np.sqrt(t) + 0.3) / (nt + 1)) - np.log((c + 0.3) / (nc + 1))))

    def units(s: list[str]) -> set:
        """Words; of scripts that are labelled by character, pairs of neighbours."""
        return {w for w in s if len(w) > 1 or w.isascii()} | {(a, b) for a, b in zip(s, s[1:]) if len(a) == len(b) == 1 and not a.isascii()}

    seeds = set().union(*map(units, bad)) - set().union(*map(units, good))
    rare = 0.02 * nc

    def like_seeds(s: list[str]) -> bool:
        r = [w for w in units(s) if in_clean[w] < rare]
        hit = sum(w in seeds for w in r)
        return hit >= 2 and hit >= 0.5 * len(r)

    pos, neg = [(s, 4) for s in bad], [(s, 4) for s in good]
    for d in t_docs:
        for s in d:
            v = lean(s) if len(s) >= 3 else 0.0
            if v > CLEAR:
                pos.append((s, 1))
            elif v < CLEAR / 3 and not like_seeds(s):
                neg.append((s, 1))
    for d in c_docs:
        neg += [(s, 1) for s in d if lean(s) < CLEAR / 2 and not like_seeds(s)]
    rng = np.random.default_rng(11)
    # Clean sentences that share words with toxic ones are worth most; of the rest a part is enough.
    worst = {w for s, _ in pos for w in s}
    near = [x for x in neg if x[1] > 1 or sum(w in worst for w in x[0]) >= 0.5 * len(x[0])]
    far = [x for x in neg if x[1] == 1]
    most = 6 * len(pos) + 2000
    near, far = ([x[i] for i in rng.permutation(len(x))[:most]] for x in (near, far))
    pool = [(s, 1) for s, n in pos for _ in range(n)] + [(s, 0) for s, n in near + far for _ in range(n)]
    pool = [pool[i] for i in rng.permutation(len(pool))]
    code = {w: _h("w", w) for s, _ in pool for w in s}
    dot = _h("w", ".")
    sequences, at = [], 0
    while at < len(pool):
        part = pool[at : at + int(rng.integers(2, 7))]
        at += len(part)
        c, edge, y = [], [], []
        for s, lab in part:
            c += [code[w] for w in s] + [dot]
            edge += [1] + [0] * len(s)
            y += [lab] * (len(s) + 1)
        sequences.append((feature_rows(np.array(c, dtype=np.int64)), np.array(edge), np.array(y)))
    chain = Chain(2, BITS).fit(sequences, epochs=6, rate=0.25, decay=1e-4)
    vocabulary = sorted(w for w, n in Counter(w for s, k in pos for w in set(s)).items() if "*" not in w and (n >= 2 or any(w in s for s in bad)))
    return Model(chain, vocabulary)


def fitted(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", most_toxic: int = TRAIN_TOXIC, most_clean: int = TRAIN_CLEAN, most_others: int = TRAIN_OTHERS) -> Model:
    """The model fitted on a bounded sample of documents with verdicts: those with the smallest digest of their id."""
    votes = labels.where(F.col(toxic).isNotNull()).groupBy(key).agg(F.avg(F.col(toxic).cast("double")).alias("v")).where("v <> 0.5")
    votes = votes.select(key, (F.col("v") > 0.5).alias("bad"))
    marked = bounded_sample(votes.where("bad").select(key, "bad"), key, most_toxic).unionByName(bounded_sample(votes.where("NOT bad").select(key, "bad"), key, most_clean))
    marked = marked.join(documents.select(key, text), key)
    others = bounded_sample(documents.select(key, text), key, most_others).join(votes.where("bad").select(key), key, "left_anti").withColumn("bad", F.lit(None).cast("boolean"))
    rows = marked.unionByName(others).where(F.length(text) > 0).select("h", "bad", F.col(text).alias("t")).collect()
    rows.sort(key=lambda r: (r["h"], r["t"]))
    return train(*([r["t"] for r in rows if r["bad"] is x] for x in (True, False, None)))


def toxicity(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, *extra, score, starts, ends): every document's score and the places of its toxic spans."""
    kinds = dict(documents.dtypes)
    shared = Shared(documents.sparkSession, model.dump(), Model.load)
    keep = [key, *extra]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.get()
        texts = b.column(len(keep)).to_pylist()
        found = [x for i in range(0, len(texts), 500) for x in score(m, texts[i : i + 500])]
        n = np.array([len(s) for _, s in found], dtype=np.int32)
        flat = np.array([p[:2] for _, s in found for p in s], dtype=np.int32).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array([v for v, _ in found], pa.float64()), lists(flat[:, 0], n, pa.int32()), lists(flat[:, 1], n, pa.int32())], names=[*keep, "score", "starts", "ends"])

    return map_arrow(documents.select(*keep, text), run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double, starts array<int>, ends array<int>"]))
