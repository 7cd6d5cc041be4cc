"""Encoding of a corpus with a public byte-level BPE through a transducer lexicon.

1. Pre-tokens are counted over the whole corpus; those seen at least ``min_count``
   times, at most ``lexicon_size`` of them, are merged exactly and compiled into a
   minimal acyclic transducer (`automaton.Transducer`), whose arcs add up to the index
   of the word's ids. It is one file that each Python worker maps into memory.
2. Every text is split into pre-tokens with array operations over whole batches,
   distinct pre-tokens are looked up in the transducer, all at once, and those it does not
   hold are merged exactly from the vocabulary's ranks.

Defined cases: null and empty texts give an empty list; special-token strings in a text
are ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from folioforge.llm.automaton import Transducer
from folioforge.session import cut, shared_file, shared_folder

#: Default place of the vocabulary files; a parameter everywhere below.
TOKENIZER_DIR = "/opt/tokenizers"
LEXICON_SIZE = 65_536
MIN_COUNT = 2
#: Slots of a worker's memory of words, after which it starts anew.
MEMORY = 400_000
#: Characters that are split at once.
SLICE = 2_000_000

# The white space of Unicode's White_Space property.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_O, _L, _N, _W, _END = 0, 1, 2, 3, 4
_SEP = 0x10FFFF + 1


class Splitter:
    """The pre-tokenizer pattern of the byte-level BPE as array operations."""

    def __init__(self) -> None:
        lut = np.zeros(_SEP + 1, np.uint8)
        for cp in range(0x110000):
            c = unicodedata.category(chr(cp))[0]
            if c == "L":
                lut[cp] = _L
            elif c == "N":
                lut[cp] = _N
        lut[WHITE] = _W
        lut[_SEP] = _END
        self.lut = lut
        rng = np.random.default_rng(20240229)
        self.mix = rng.integers(1, 2**63, 0x110001, dtype=np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.powers = self.unpowers = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                p = np.full(n, self.base, np.uint64)
                p[0] = 1
                self.powers = np.multiply.accumulate(p)
                p = np.full(n, self.inverse, np.uint64)
                p[0] = 1
                self.unpowers = np.multiply.accumulate(p)

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code points, start of each pre-token, its end, its text), texts being parted by a sentinel."""
        raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
        lens = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
        total = int(lens.sum()) + len(raw) + 1
        cp = np.full(total, _SEP, np.uint32)
        at = np.concatenate([[0], np.cumsum(lens + 1)]) + 1
        body = np.frombuffer(b"".join(raw), np.uint32)
        inside = np.ones(total, bool)
        inside[0] = False
        inside[at[1:] - 1] = False
        cp[inside] = body
        k = self.lut[np.minimum(cp, _SEP)]
        start = np.zeros(total, bool)
        change = k[1:] != k[:-1]
        start[1:] = change
        # a single blank before a run belongs to it
        start[1:] &= ~((k[1:] != _W) & (cp[:-1] == 32))
        # the last white space before a run stands alone or joins it
        nxt = np.empty_like(k)
        nxt[:-1], nxt[-1] = k[1:], _END
        start |= (k == _W) & (nxt != _W) & (nxt != _END)
        start &= k != _END
        # contractions
        quote = np.flatnonzero(start & (cp == 39) & (nxt == _L))
        if len(quote):
            a, b = cp[quote + 1], cp[np.minimum(quote + 2, total - 1)]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            hit = quote[one | two]
            step = np.where(two[one | two] & ~one[one | two], 3, 2)
            start[hit + 1] = False
            rest = hit + step
            start[rest[k[rest] == _L]] = True
        s = np.flatnonzero(start)
        e = np.empty_like(s)
        e[:-1] = s[1:]
        if len(s):
            e[-1] = total
            # a pre-token ends at the sentinel of its text
            text = np.searchsorted(at, s, side="right") - 1
            e = np.minimum(e, at[text + 1] - 1)
        else:
            text = np.zeros(0, np.int64)
        return cp, s, e, text

    def keys(self, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """64-bit fingerprints of the pre-tokens: a polynomial over random values of the code points."""
        self._grow(len(cp) + 1)
        with np.errstate(over="ignore"):
            h = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum(self.mix[np.minimum(cp, 0x110000)] * self.powers[: len(cp)], out=h[1:])
            return (h[e] - h[s]) * self.unpowers[s]


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Pre-tokens to ids in one Python worker: memory, then transducer, then exact merges."""

    def __init__(self, vocabulary: str, lexicon: str | None = None) -> None:
        import tiktoken

        self.splitter = Splitter()
        self.exact = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks_of(vocabulary), special_tokens={})
        self.lexicon = Transducer.open(lexicon) if lexicon else None
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.offset = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _merge(self, word: bytes) -> list[int]:
        return self.exact._encode_single_piece(word)

    def _learn(self, keys: list[int], words: list[bytes]) -> None:
        known = self.lexicon.lookup(words) if self.lexicon else [None] * len(words)
        for key, word, ids in zip(keys, words, known):
            if ids is None:
                ids = self._merge(word)
            n = len(self.slot)
            if n >= len(self.offset):
                self.offset = np.concatenate([self.offset, np.zeros_like(self.offset)])
                self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.offset[n], self.length[n] = self.used, len(ids)
            self.used += len(ids)
            self.slot[key] = n

    def slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(slot, text) of each pre-token."""
        cp, s, e, text = self.splitter.split(texts)
        if not len(s):
            return np.zeros(0, np.int64), text
        codes, uniques = pd.factorize(self.splitter.keys(cp, s, e))
        if len(self.slot) + len(uniques) > MEMORY:
            self._clear()
        names = uniques.tolist()
        new = [i for i, key in enumerate(names) if key not in self.slot]
        if new:
            first = np.empty(len(uniques), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            at = first[new]
            words = [cp[a:b].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace") for a, b in zip(s[at].tolist(), e[at].tolist())]
            self._learn([names[i] for i in new], words)
        by = np.fromiter((self.slot[key] for key in names), np.int64, len(names))
        return by[codes], text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        slot, text = self.slots(texts)
        n = self.length[slot]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.offset[slot] - (ends - n), n) + np.arange(total)
        return self.flat[at], np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64) if len(text) else np.zeros(len(texts), np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        slot, text = self.slots(texts)
        return np.bincount(text, weights=self.length[slot], minlength=len(texts)).astype(np.int64)


def slices(texts: list[str | None]) -> list[tuple[int, int]]:
    """Ranges of texts of about `SLICE` characters; a longer text is one range."""
    out, a, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > SLICE:
            out.append((a, i))
            a, size = i, 0
        size += n
    out.append((a, len(texts)))
    return out


_workers: dict[tuple[str, str | None], Encoder] = {}


def worker_encoder(vocabulary: str, lexicon: str | None) -> Encoder:
    """One encoder for each Python worker, which Spark reuses for task after task."""
    key = (vocabulary, lexicon)
    if key not in _workers:
        _workers.clear()
        _workers[key] = Encoder(vocabulary, lexicon)
    return _workers[key]


@functools.cache
def worker_splitter() -> Splitter:
    """One splitter for each Python worker; its tables take a while to fill."""
    return Splitter()


def vocabulary_file(tokenizer: str, tokenizer_dir: str = TOKENIZER_DIR) -> str:
    return f"{tokenizer_dir}/{tokenizer}.tiktoken"


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word BINARY, n BIGINT): how often each pre-token occurs in all rows; counted in each task before the shuffle."""

    def count(batches):
        splitter = worker_splitter()
        words: dict[int, bytes] = {}
        numbers: dict[int, int] = {}

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in numbers], pa.binary()), pa.array(list(numbers.values()), pa.int64())], ["word", "n"])
            words.clear()
            numbers.clear()

        for batch in batches:
            rows = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(rows):
                cp, s, e, _ = splitter.split(rows[a:b])
                if not len(s):
                    continue
                codes, uniques = pd.factorize(splitter.keys(cp, s, e))
                n = np.bincount(codes, minlength=len(uniques)).tolist()
                first = np.empty(len(uniques), np.int64)
                first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
                for key, c, i in zip(uniques.tolist(), n, first.tolist()):
                    if key in numbers:
                        numbers[key] += c
                    else:
                        numbers[key] = c
                        words[key] = cp[s[i] : e[i]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
                if len(numbers) > MEMORY:
                    yield from flush()
        yield from flush()

    return texts.select(F.col(column).cast("string")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(texts: DataFrame, column: str, vocabulary: str, lexicon_size: int = LEXICON_SIZE, min_count: int = MIN_COUNT) -> str:
    """The file of the transducer over the corpus's frequent words.

    What reaches the driver is bounded by ``lexicon_size`` words: those of the largest counts, of each count all or none.
    """
    spark = texts.sparkSession
    counted = cut(word_counts(texts, column).where(F.col("n") >= min_count), "words")
    # the least count of which all words fit; a row for each distinct count, and those are few as they add up to the corpus
    least, held = None, 0
    for n, words_of_it in counted.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect():
        held += words_of_it
        if held > lexicon_size:
            break
        least = n
    words = sorted(bytes(r.word) for r in counted.where(F.col("n") >= least).select("word").collect()) if least else []
    import tiktoken

    exact = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks_of(vocabulary), special_tokens={})
    made = Transducer.compile({w: exact._encode_single_piece(w) for w in words})
    path = shared_file(spark, "lexicon", ".npz")
    if path:
        made.save(path)
        return path
    # Spark brings a file of the shared folder to every executor
    jvm = spark.sparkContext._jvm
    path = f"{shared_folder(spark, 'lexicon')}/lexicon-{uuid.uuid4().hex}"
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    out.write(bytearray(made.dump()))
    out.close()
    spark.sparkContext.addFile(path)
    return "files:" + path.rsplit("/", 1)[1]


def _resolved(lexicon: str | None) -> str | None:
    return SparkFiles.get(lexicon[6:]) if lexicon and lexicon.startswith("files:") else lexicon


def encode(df: DataFrame, key: str, column: str, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR, lexicon_size: int = LEXICON_SIZE, min_count: int = MIN_COUNT) -> DataFrame:
    """(key, ids ARRAY<INT>) for every row of ``df``."""
    vocabulary = vocabulary_file(tokenizer, tokenizer_dir)
    lexicon = build_lexicon(df, column, vocabulary, lexicon_size, min_count)
    source = df.select(F.col(key), F.col(column).cast("string").alias("text"))
    kind = source.schema[key].dataType.simpleString()

    def run(batches):
        enc = worker_encoder(vocabulary, _resolved(lexicon))
        for batch in batches:
            rows = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(rows):
                ids, n = enc.encode(rows[a:b])
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], [key, "ids"])

    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, column: str, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(key, n_tokens BIGINT): 0 for null and empty texts."""
    vocabulary = vocabulary_file(tokenizer, tokenizer_dir)
    source = df.select(F.col(key), F.col(column).cast("string").alias("text"))
    kind = source.schema[key].dataType.simpleString()

    def run(batches):
        enc = worker_encoder(vocabulary, None)
        for batch in batches:
            rows = [t or "" for t in batch.column(1).to_pylist()]
            n = np.concatenate([enc.counts(rows[a:b]) for a, b in slices(rows)]) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], [key, "n_tokens"])

    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens long")


__all__ = ["Encoder", "Splitter", "build_lexicon", "cut", "encode", "token_counts", "word_counts"]
