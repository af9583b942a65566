"""Operator 8: byte-pair encoding and decoding through a pair occurrence index.

The words of an Arrow batch (a part of its partition) that were not met before are laid out in one symbol
array. An index over that array maps every adjacent pair that has a merge rank to all its positions. Ranks are taken in ascending order; each is
applied to all its positions at once, and the pairs that come to stand beside a merged symbol are added
to the lists of their own ranks. Words repeat, so each worker keeps what it has encoded, up to a bound.

Defined results: null and empty texts give no ids and an empty decoded text; special tokens in a text
become their ids; repeated rows give repeated rows; other columns pass through untouched.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, keep_only, list_of, named, pieces, unfolded

#: White space as the tokenizer's pattern has it; str.split() also takes \x1c to \x1f.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words that a worker keeps before it starts anew (some 300 bytes each).
CACHED_WORDS = 150_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    own = set(seen)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class PairIndexBpe:
    """A word-end BPE vocabulary (tokenizers' JSON), with merges applied by rank over a pair index."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for k, v in (*vocab.items(), *self.specials.items()):
            self.tokens[v] = k
        self.inner = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in byte_symbols()], np.int64)
        self.width = len(self.tokens)
        keys, made = [], []
        for a, b in model["merges"]:
            keys.append(vocab[a] * self.width + vocab[b])
            made.append(vocab[a + b])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks, self.made = np.array(keys, np.int64)[order], order.astype(np.int64), np.array(made, np.int64)
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.spaces = regex.compile(rf"[{SPACE}]+")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.special = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)")
        self.known: dict[str, bytes] = {"": b""}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where there is none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def words_of(self, text: str) -> list[str]:
        return self.spaces.split(text) if self.odd.search(text) else text.split()

    def normal_pieces(self, word: str) -> list[bytes]:
        """A word's pre-tokens as UTF-8: composed, lower-cased letter by letter, split by the pattern."""
        if word.isascii():
            word = word.lower()
            if word.isalpha() or not word:
                return [word.encode()]
        else:
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        return [p.encode() for p in self.pieces.findall(word)]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word), by the pair occurrence index."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1  # each word is followed by a stop symbol
        n = int(ends[-1]) + 1
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        sym = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        sym[ends] = -1
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        after[-1] = n - 1
        before[0] = n - 1  # a stop symbol stands on either side
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(at: np.ndarray) -> None:
            """Add the pairs that start at these positions to the lists of their ranks."""
            rank = self.rank_of(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            starts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            for r, part in zip(rank[starts].tolist(), np.split(at, starts[1:]), strict=True):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(heap, r)
                lists[r].append(part)

        pair_of = np.empty(len(self.keys), np.int64)
        pair_of[self.ranks] = self.keys
        file(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            parts = lists.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            left, right = divmod(int(pair_of[r]), self.width)
            nxt = after[at]
            fresh = (sym[at] == left) & (sym[nxt] == right)
            if not fresh.all():
                at, nxt = at[fresh], nxt[fresh]
            if left == right and len(at) > 1:  # of overlapping pairs in a run, every other one from the left
                at = np.sort(at)
                nxt = after[at]
                new_run = np.r_[True, nxt[:-1] != at[1:]]
                first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                pick = (np.arange(len(at)) - first) % 2 == 0
                at, nxt = at[pick], nxt[pick]
            if not len(at):
                continue
            sym[at] = self.made[r]
            sym[nxt] = -2
            far = after[nxt]
            after[at] = far
            before[far] = at
            prior = before[at]
            file(np.unique(np.concatenate([prior[sym[prior] >= 0], at])))
        word = np.repeat(np.arange(len(words)), lengths + 1)
        keep = sym >= 0
        return sym[keep], np.bincount(word[keep], minlength=len(words))

    def learn(self, words: set[str]) -> None:
        """Encode words that are not known yet."""
        new = sorted(words)
        if not new:
            return
        spelt = [[] if w in self.specials else self.normal_pieces(w) for w in new]
        distinct = list({p: None for s in spelt for p in s if p})
        if distinct:
            ids, counts = self.merge(distinct)
            raw, ends = ids.astype("<i4").tobytes(), (np.cumsum(counts) * 4).tolist()
            of = {p: raw[a:b] for p, a, b in zip(distinct, [0, *ends[:-1]], ends, strict=True)}
        else:
            of = {}
        for w, s in zip(new, spelt, strict=True):
            self.known[w] = self.specials[w].to_bytes(4, "little") if w in self.specials else b"".join([of[p] for p in s if p])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        split: list[list[str]] = []
        for text in texts:
            if not self.special.search(text):
                split.append(self.words_of(text))
                continue
            row, at = [], 0
            for m in self.special.finditer(text):
                row += self.words_of(text[at : m.start()])
                row.append(m[0])
                at = m.end()
            split.append(row + self.words_of(text[at:]))
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        self.known[""] = b""
        get = self.known.get
        found = [list(map(get, row)) for row in split]
        lacking = [i for i, ids in enumerate(found) if None in ids]
        self.learn({w for i in lacking for w, ids in zip(split[i], found[i], strict=True) if ids is None})
        for i in lacking:
            found[i] = list(map(get, split[i]))
        return [b"".join(ids) for ids in found]

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes without a decoder: the tokens' own strings, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_loaded: dict[str, PairIndexBpe] = {}


def loaded(path: str) -> PairIndexBpe:
    """A worker's own tokenizer, which keeps its words from task to task."""
    if path not in _loaded:
        _loaded[path] = PairIndexBpe(path)
    return _loaded[path]


def bpe_encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, drop_text: bool = False) -> DataFrame:
    """docs with an array<int> column of token ids and, if named, a column of the text decoded from them.

    Columns named ids or decoded are replaced; with drop_text the text is left out of the result.
    No row is dealt out anew: each Arrow batch is encoded where it is read.
    """
    made = [c for c in (ids, decoded) if c]
    through = [c for c in docs.columns if c not in made and not (drop_text and c == text)]
    given = docs.select(carried(through), named(text).alias("text"))
    schema = T.StructType([given.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] + [T.StructField("decoded", T.StringType(), False)] * bool(decoded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        keep_only("bpe", _loaded.clear)
        for whole in batches:
            for batch in pieces(whole):
                row, texts = batch.columns
                parts = [np.frombuffer(b, "<i4") for b in bpe.encode([t or "" for t in texts.to_pylist()])]
                cols = [row, list_of(parts, pa.int32())]
                if decoded:
                    cols.append(pa.array([bpe.decode(p) for p in parts], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    own = [named(c).alias(name) for c, name in zip(schema.names[1:], made, strict=True)]
    return given.mapInArrow(run, schema).select(*unfolded(through), *own)


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """One row a document: the digests of its ids and of the text decoded from them."""
    return bpe_encode(docs.select("doc_id", "text"), path, decoded="decoded", drop_text=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
