"""Problem 6: encoding of texts with a public byte-level BPE vocabulary, by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can be last in
the prefix's encoding: the encoding of the prefix without it must end with a
token that the merges would not join with it. ``last_tokens`` finds it for all
prefixes from left to right; reading the table backwards from the end gives the
encoding, appending bytes only adds rows, and after an edit only the rows from
the edit on are computed again.

Pieces are what the vocabulary's pattern splits a text into, so they are short
and few; each worker keeps the pieces it has met, up to a bound, and a batch is
put together from their ids without a loop over tokens. Null and empty texts
have the empty list. Texts are taken as they stand; strings of special tokens
are ordinary text.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesmith.llm.common import Shared, lists, map_arrow

#: Fixed value: the pattern that splits a text into pieces before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: A worker forgets its pieces when it holds so many.
PIECES_KEPT = 400_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 characters for themselves, the others counted on from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and tokens of a byte-level BPE: which two tokens make a token, and which tokens end a byte string."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[int, int, int]]):
        self.tokens = tokens
        self.joined = {(a, b): c for a, b, c in merges}
        n = max(tokens.values()) + 1
        self.left, self.right = list(range(n)), list(range(n))
        for a, b, c in merges:
            self.left[c], self.right[c] = a, b
        # Tokens by their bytes from the last to the first.
        self.edges: dict[tuple[int, int], int] = {}
        self.ends: dict[int, int] = {}
        count = 0
        for raw, i in tokens.items():
            node = 0
            for b in reversed(raw):
                if (nxt := self.edges.get((node, b))) is None:
                    count += 1
                    nxt = self.edges[node, b] = count
                node = nxt
            self.ends[node] = i
        self.compatible = cache(self._compatible)

    @staticmethod
    def parse(raw: str) -> tuple[dict[bytes, int], list[tuple[int, int, int]]]:
        """Tokens and merges of a vocabulary file's text."""
        model = json.loads(raw)["model"]
        of = _byte_letters()
        vocab = {k: i for k, i in model["vocab"].items() if all(c in of for c in k)}
        merges = [(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        reachable = {c for _, _, c in made} | {i for k, i in vocab.items() if len(k) == 1}
        return {bytes(of[c] for c in k): i for k, i in vocab.items() if i in reachable}, made

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a then b stays so: no merge along the seam comes before those that make a and b."""
        limit = len(self.left) + 1
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            # Undo the later of the two merges; what stands at the seam then must not have merged earlier.
            if a > b:
                limit, a = a, self.right[a]
                if a == limit:
                    limit, b = b + 1, self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    if a == limit:
                        return True

    def last_tokens(self, raw: bytes, known: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        """Of each non-empty prefix its last token and that token's length; known: the rows of a prefix of raw, which are extended."""
        rows = list(known or [])
        edges, ends, fits = self.edges, self.ends, self.compatible
        for end in range(len(rows) + 1, len(raw) + 1):
            node, best, at = 0, None, end
            found = []
            while at > 0 and (node := edges.get((node, raw[at - 1]))) is not None:
                at -= 1
                if (i := ends.get(node)) is not None:
                    found.append((i, end - at))
            for i, size in reversed(found):
                if size == end or fits(rows[end - size - 1][0], i):
                    best = (i, size)
                    break
            rows.append(best)  # type: ignore[arg-type]
        return rows

    def encode_piece(self, raw: bytes) -> list[int]:
        return read_back(self.last_tokens(raw))


def read_back(rows: list[tuple[int, int]]) -> list[int]:
    """The encoding that a table of last tokens holds."""
    ids, at = [], len(rows)
    while at:
        i, size = rows[at - 1]
        ids.append(i)
        at -= size
    return ids[::-1]


class Encoder:
    """Texts to ids, with the pieces met so far."""

    def __init__(self, vocabulary: Vocabulary, pieces_kept: int = PIECES_KEPT):
        self.vocabulary, self.pieces_kept = vocabulary, pieces_kept
        self.split = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.of: dict[str, int] = {}
        self.flat: list[int] = []
        self.at: list[int] = [0]

    def _piece(self, piece: str) -> int:
        self.of[piece] = n = len(self.at) - 1
        self.flat += self.vocabulary.encode_piece(piece.encode("utf-8", "surrogatepass"))
        self.at.append(len(self.flat))
        return n

    def encode(self, text: str | None) -> list[int]:
        values, _ = self.encode_batch([text])
        return values.tolist()

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's ids."""
        if len(self.of) > self.pieces_kept:
            self.forget()
        numbers: list[int] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        get = self.of.get
        for k, t in enumerate(texts):
            if not t:
                continue
            pieces = self.split(t)
            got = list(map(get, pieces))
            if None in got:
                got = [self._piece(p) if (n := get(p)) is None else n for p in pieces]
            numbers += got
            sizes[k] = len(got)
        index = np.array(numbers, dtype=np.int64)
        at = np.array(self.at, dtype=np.int64)
        flat = np.array(self.flat, dtype=np.int32)
        first, each = at[index], at[index + 1] - at[index]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(first - total[:-1], each) + np.arange(total[-1])]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[bounds[1:]] - total[bounds[:-1]]


class Growing:
    """A text that grows or is edited, with its ids kept up to date from the table of its last pieces."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.pieces, self.text = vocabulary, [], ""
        self.replace(0, 0, text)

    def append(self, more: str) -> list[int]:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> list[int]:
        """The ids after text[start:end] has become new. Pieces well before the edit stay; a table whose piece only grew is extended; pieces after it that recur stay too."""
        text = self.text[:start] + new + self.text[end:]
        kept, at = 0, 0
        while kept < len(self.pieces) and at + len(self.pieces[kept][0]) <= start:
            at += len(self.pieces[kept][0])
            kept += 1
        # The pattern looks ahead one character past white space, so the two pieces before an edit are split again.
        for _ in range(2):
            if kept:
                kept -= 1
                at -= len(self.pieces[kept][0])
        old = {p: rows for p, rows in self.pieces[kept:]}
        fresh = []
        for p in regex.findall(PATTERN, text[at:]):
            if (rows := old.get(p)) is None:
                raw = p.encode("utf-8", "surrogatepass")
                grown = next((r for q, r in old.items() if q and p.startswith(q)), None)
                rows = self.vocabulary.last_tokens(raw, grown)
            fresh.append((p, rows))
        self.pieces, self.text = self.pieces[:kept] + fresh, text
        return self.ids()

    def ids(self) -> list[int]:
        return [i for _, rows in self.pieces for i in read_back(rows)]


def load(path: str = VOCABULARY) -> Encoder:
    with open(path, encoding="utf-8") as f:
        return Encoder(Vocabulary(*Vocabulary.parse(f.read())))


def token_ids(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>): one row for each row of df, equal rows included; null and empty texts have the empty list.

    The vocabulary file (of fixed size, under 2 MB) is read on the driver and broadcast.
    """
    spark: SparkSession = df.sparkSession
    with open(path, encoding="utf-8") as f:
        shared = Shared(spark, f.read(), lambda raw: Encoder(Vocabulary(*Vocabulary.parse(raw))))
    kind = dict(df.dtypes)[key]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        e = shared.get()
        parts = [e.encode_batch(b.column(1).slice(i, 500).to_pylist()) for i in range(0, b.num_rows, 500)]
        ids, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return pa.RecordBatch.from_arrays([b.column(0), lists(ids, sizes, pa.int32())], names=[key, "ids"])

    return map_arrow(df.select(F.col(key), F.col(text)), run, f"`{key}` {kind}, ids array<int>")
