"""Problem 3: the language of words, sentences and texts, by a linear-chain conditional random field.

Words are labelled by forward-backward over a text, with features of the word
itself, its affixes, character n-grams, lists of frequent words and its script;
transitions are learned, those across a sentence's end apart from those within.
A sentence's language is that of its words together, with the mean of their
marginals as confidence; titles in quotation marks inside a sentence and
placeholders have no vote.

The model is fitted on the driver: on the sentences of ``lexicon`` and on a
bounded sample of texts (TRAIN_TEXTS) whose sentences the word lists and scripts
label with a clear lead; the text's own label only counts where both agree.

Null, empty and blank texts, and texts without words of a language, have no
language: no sentence, or language null with confidence 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesmith.llm.common import Shared, bounded_sample, fold_words, lists, map_arrow, strip_invisible
from pagesmith.llm.crf import Chain, batches, hashed
from pagesmith.llm.lexicon import FREQUENT, LANGUAGES, NO_LANGUAGE, SENTENCES
from pagesmith.llm.sentences import TAG, spans

NONE = len(LANGUAGES)
BITS = 17
#: Texts of the sample that the model is fitted on, besides the fixed sentences.
TRAIN_TEXTS = 3000
#: Sentences of a language that training takes from the sample.
TRAIN_SENTENCES = 700
#: Confidence from which a sentence is written in a language, and the least number of its words.
SURE, WORDS = 0.6, 2

_MARKS = "̀-ͯऀ-ःऺ-ॏ॑-ॗॢॣ஀-௿ؐ-ًؚ-ٰٟ"
_WORD = re.compile(rf"[぀-ヿ㐀-鿿ｦ-ﾟ々〆]+|[฀-๿]+|(?:(?![฀-๿぀-ヿ㐀-鿿])[^\W\d_])(?:(?![฀-๿぀-ヿ㐀-鿿])[\w{_MARKS}])*(?:['’](?:(?![฀-๿぀-ヿ㐀-鿿])[^\W\d_])+)*")
#: Marks of templates and programs: what they hold is no language.
_PLACEHOLDER = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|\$\{.*?\}|<%.*?%>|<<.*?>>|«\w+»|%\w+%|\[[^\]\n]{1,40}\]|\{\d+\}|\(null\)|[A-Z0-9]{1,8}(?:[-/][A-Z0-9]+)+|https?://\S+|www\.\S+|\b\w+\.(?:pdf|html?|docx?)\b")
_QUOTED = re.compile(r"\"[^\"\n]{1,90}\"|“[^”\n]{1,90}”|«[^»\n]{1,90}»|„[^“\n]{1,90}“|「[^」\n]{1,60}」|《[^》\n]{1,60}》")
_ENDING = re.compile(r"[.!?。！？।۔؟]")
_SCRIPTS = (("th", "฀-๿"), ("ta", "஀-௿"), ("ur", "؀-ۿ"), ("kana", "぀-ヿｦ-ﾟ"), ("han", "㐀-鿿々〆"), ("ru", "Ѐ-ӿ"), ("deva", "ऀ-ॿ"))
_SCRIPT = [(n, re.compile(f"[{r}]")) for n, r in _SCRIPTS]
_LEX = {k: frozenset(v.split()) for k, v in FREQUENT.items()}
_ONE_LANGUAGE = {"th": "th", "ta": "ta", "ur": "ur", "ru": "ru", "kana": "ja"}


@cache
def script(word: str) -> str:
    for name, pattern in _SCRIPT:
        if pattern.search(word):
            return name
    return "latin"


def features(word: str, kana: bool) -> list[str]:
    """Names of a word's features; kana: whether its sentence has kana."""
    w = unicodedata.normalize("NFC", word).lower().replace("’", "'")
    s = script(w)
    f = ["b", f"s:{s}"]
    if s in ("han", "kana", "th"):
        return [*f, f"k:{s}:{kana}"]
    f += [f"w:{w}", f"p:{w[:3]}", f"x:{w[-3:]}", f"y:{w[-2:]}"]
    f += [f"l:{k}" for k, words in _LEX.items() if w in words]
    if "'" in w:
        f += [f"a:{w.split(chr(39))[0]}", f"w:{w.split(chr(39))[-1]}"]
    e = f"^{w[:14]}$"
    f += [f"3:{e[i : i + 3]}" for i in range(len(e) - 2)] + [f"4:{e[i : i + 4]}" for i in range(len(e) - 3)]
    return f


class Words:
    """Words of a text for the chain: word, kind of the edge into it, its sentence, whether it votes."""

    def __init__(self, text: str, sentences: list[tuple[int, int]]):
        self.words: list[tuple[str, bool]] = []
        self.edge: list[int] = []
        self.sentence: list[int] = []
        self.vote: list[bool] = []
        for k, (a, b) in enumerate(sentences):
            s = fold_words(strip_invisible(TAG.sub("", text[a:b])))
            s = re.sub(r"-\n(?=\w)", "", s)
            if any(c in s for c in "{}$%<[«(.:-/"):
                s = _PLACEHOLDER.sub(" ", s)
            quoted = [m.span() for m in _QUOTED.finditer(s) if not _ENDING.search(m.group()[:-1])] if any(c in s for c in "\"“«„「《") else []
            kana = bool(_SCRIPT[3][1].search(s))
            first = True
            for m in _WORD.finditer(s):
                w = m.group()
                if sum(c.isupper() for c in w) > 1 and any(c.isdigit() for c in w):
                    continue
                self.words.append((w, kana))
                self.edge.append(int(first))
                self.sentence.append(k)
                self.vote.append(not any(x < m.start() and m.end() < y for x, y in quoted))
                first = False


class Model:
    """The fitted chain, with the scores of the words met so far."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.of: dict[tuple[str, bool], int] = {}
        self.scores = np.zeros((0, chain.labels), dtype=np.float32)
        self.rows: list[np.ndarray] = []

    @staticmethod
    def load(weights: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Model:
        rows, values, edges = weights
        c = Chain(NONE + 1, BITS)
        c.weights[rows] = values
        c.edges = edges
        return Model(c)

    def dump(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.flatnonzero(np.abs(self.chain.weights).max(axis=1) > 1e-3)
        return rows, self.chain.weights[rows], self.chain.edges

    def _number(self, w: tuple[str, bool]) -> int:
        f = np.array(hashed(features(*w), BITS), dtype=np.int64)
        self.rows.append(self.chain.weights[f].sum(axis=0))
        self.of[w] = n = len(self.rows) - 1
        return n

    def label(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float, int]]]:
        """Of each text its sentences: (start, end, label, confidence, voting words); label NONE: no language."""
        if len(self.of) > 300_000:
            self.of, self.rows = {}, []
        cut = spans(texts)
        chains = [Words(t or "", s) for t, s in zip(texts, cut, strict=True)]
        numbers = [[self.of[w] if w in self.of else self._number(w) for w in c.words] for c in chains]
        table = np.array(self.rows, dtype=np.float32).reshape(len(self.rows), self.chain.labels)
        out: list[list[tuple[int, int, int, float, int]]] = [[(a, b, NONE, 0.0, 0) for a, b in s] for s in cut]
        for g in batches([len(n) for n in numbers]):
            length = max(len(numbers[i]) for i in g)
            ids, edge, mask = np.zeros((len(g), length), np.int64), np.zeros((len(g), length), np.int8), np.zeros((len(g), length), bool)
            for r, i in enumerate(g):
                n = len(numbers[i])
                ids[r, :n], edge[r, :n], mask[r, :n] = numbers[i], chains[i].edge, True
            p, _ = self.chain.marginals(table[ids], edge, mask)
            for r, i in enumerate(g):
                c = chains[i]
                s, v = np.array(c.sentence), np.array(c.vote)
                total = np.zeros((len(cut[i]), self.chain.labels))
                count = np.bincount(s[v], minlength=len(cut[i]))
                np.add.at(total, s[v], p[r, : len(s)][v])
                best = total.argmax(axis=1)
                for k in np.flatnonzero(count):
                    out[i][k] = (*cut[i][k], int(best[k]), float(total[k, best[k]] / count[k]), int(count[k]))
        return out


def guess(words: list[str]) -> tuple[str | None, bool]:
    """Label of a sentence by scripts and word lists alone, and whether it leads clearly. hi-Latn counts as hi."""
    scripts = Counter(script(w) for w in words)
    if not scripts:
        return None, False
    s, n = scripts.most_common(1)[0]
    if scripts["kana"]:
        s, n = "kana", scripts["kana"] + scripts["han"]
    if n < 0.7 * len(words):
        return None, False
    if s in _ONE_LANGUAGE:
        return _ONE_LANGUAGE[s], True
    if s == "han":
        return "zh", True
    names = ("hi", "mr") if s == "deva" else ("en", "fr", "de", "es", "hi-Latn")
    low = [w.lower() for w in words]
    score = sorted(((sum(w in _LEX[k] for w in low), k) for k in names), reverse=True)
    clear = score[0][0] >= 2 and score[0][0] >= 1.7 * score[1][0]
    return score[0][1].split("-")[0], clear


def train(texts: list[tuple[str, str | None]]) -> Model:
    """A model from (text, label) samples and the fixed sentences; labels are as found, wrong ones do little harm."""
    examples: list[tuple[list[tuple[str, bool]], int]] = []
    for k, block in SENTENCES.items():
        for line in block.split("\n"):
            w = Words(line, [(0, len(line))]).words
            examples += [(w, LANGUAGES.index(k.split("-")[0]))] * (6 if k == "hi-Latn" else 3)
    rng = np.random.default_rng(3)
    for _ in range(150):
        pick = rng.choice(NO_LANGUAGE, size=int(rng.integers(2, 12)))
        examples.append(([(str(x).capitalize() if i == 0 else str(x), False) for i, x in enumerate(pick)], NONE))
    taken: Counter[str] = Counter()
    cut = spans([t for t, _ in texts])
    for (t, _), sentences in zip(texts, cut, strict=True):
        c = Words(t, sentences)
        by: dict[int, list[tuple[str, bool]]] = {}
        for w, s in zip(c.words, c.sentence, strict=True):
            by.setdefault(s, []).append(w)
        for w in by.values():
            k, clear = guess([x for x, _ in w])
            if k and clear and len(w) >= (1 if script(w[0][0]) in ("han", "kana", "th") else 4) and taken[k] < TRAIN_SENTENCES:
                taken[k] += 1
                examples.append((w, LANGUAGES.index(k)))
    # Several sentences make a text, so that the edges between sentences are learned: mostly of one language, at times of two.
    order = rng.permutation(len(examples))
    by_label: dict[int, list[int]] = {}
    for i in order:
        by_label.setdefault(examples[i][1], []).append(int(i))
    chains, pool = [], [i for lab in sorted(by_label) for i in by_label[lab]]
    at = 0
    while at < len(pool):
        n = int(rng.integers(1, 5))
        part = pool[at : at + n]
        if rng.random() < 0.4:
            part.append(int(rng.integers(len(examples))))
        chains.append(part)
        at += n
    cache_: dict[tuple[str, bool], list[int]] = {}
    sequences, chained = [], []
    for part in chains:
        words, edge, y = [], [], []
        for i in part:
            w, lab = examples[i]
            words += w
            edge += [1] + [0] * (len(w) - 1) if w else []
            y += [lab] * len(w)
        if not words:
            continue
        chained.append(([cache_.setdefault(w, hashed(features(*w), BITS)) for w in words], np.array(edge), np.array(y)))
    chained.sort(key=lambda c: max(map(len, c[0])))
    for f, edge, y in chained:
        x = np.full((len(f), max(map(len, f))), -1, dtype=np.int64)
        for r, row in enumerate(f):
            x[r, : len(row)] = row
        sequences.append((x, edge, y))
    return Model(Chain(NONE + 1, BITS).fit(sequences, epochs=5))


def fitted(documents: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", most: int = TRAIN_TEXTS) -> Model:
    """The model fitted on a sample of so many texts."""
    rows = bounded_sample(documents.select(key, text, label), key, most).select("h", F.col(text).alias("t"), F.col(label).alias("l")).collect()
    return train([(r["t"], r["l"]) for r in sorted(rows, key=lambda r: r["h"]) if r["t"] and len(r["t"]) > 20])


def sentence_languages(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, starts, ends, langs, confidences, words): arrays with an entry a sentence; lang null where there is none."""
    kind = dict(df.dtypes)[key]
    shared = Shared(df.sparkSession, model.dump(), Model.load)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.get()
        texts = b.column(1).to_pylist()
        found = [x for i in range(0, len(texts), 1000) for x in m.label(texts[i : i + 1000])]
        n = np.array([len(x) for x in found], dtype=np.int32)
        flat = [y for x in found for y in x]
        lang = pa.array([LANGUAGES[y[2]] if y[2] < NONE else None for y in flat], pa.string())
        at = np.zeros(len(n) + 1, dtype=np.int32)
        np.cumsum(n, out=at[1:])
        columns = [lists(np.array([y[j] for y in flat], dtype=t), n, p) for j, t, p in ((0, np.int32, pa.int32()), (1, np.int32, pa.int32()), (3, np.float64, pa.float64()), (4, np.int32, pa.int32()))]
        return pa.RecordBatch.from_arrays([b.column(0), columns[0], columns[1], pa.ListArray.from_arrays(pa.array(at), lang), columns[2], columns[3]], names=[key, "starts", "ends", "langs", "confidences", "words"])

    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, starts array<int>, ends array<int>, langs array<string>, confidences array<double>, words array<int>")


def named_languages(options: DataFrame, codes: DataFrame) -> DataFrame:
    """(job_id, lang): the languages that a job's latest ocr_lang names."""
    latest = options.where("job_id IS NOT NULL").groupBy("job_id").agg(F.max_by("ocr_lang", F.struct(F.col("received_at"), F.col("submitted_at"), F.coalesce("ocr_lang", F.lit("")))).alias("ocr_lang"))
    each = latest.select("job_id", F.explode(F.split("ocr_lang", ",")).alias("code")).select("job_id", F.lower(F.trim(F.regexp_replace("code", r"\s+", " "))).alias("code"))
    known = codes.where("ocr_code IS NOT NULL AND lang IS NOT NULL").select(F.lower(F.trim("ocr_code")).alias("code"), "lang").distinct()
    return each.join(known, "code").select("job_id", "lang").distinct()


def written_languages(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, lang, confidence): the languages in which a text has at least one whole sentence, with the best sentence's confidence.

    A sentence counts from a confidence of SURE and WORDS words on; in scripts
    without spaces one unbroken run of letters is enough.
    """
    s = sentence_languages(df, key, text, model)
    one = s.select(key, F.explode(F.arrays_zip("langs", "confidences", "words")).alias("s")).select(key, F.col("s.langs").alias("lang"), F.col("s.confidences").alias("confidence"), F.col("s.words").alias("words"))
    sure = one.where(F.col("lang").isNotNull() & (F.col("confidence") >= SURE) & ((F.col("words") >= WORDS) | F.col("lang").isin("th", "zh", "ja")))
    return sure.groupBy(key, "lang").agg(F.max("confidence").alias("confidence"))
