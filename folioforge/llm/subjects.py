"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

A sentence is the average of its words' vectors, a word the average of the vectors of itself
and of its character n-grams, so that misspellings and inflections are near their words; every subject has
its own logistic output. The model is trained on the sentences of a bounded sample of the labelled
documents. In each round every partition computes the gradient over its sentences, the driver adds the
gradients up and sends the stepped model back. Documents with one label teach
from the start; those with several, once the model can tell which of their labels a sentence is about.

Scoring reads every document: each distinct word is reduced to its contribution to the outputs once, a
sentence deals with the subjects whose output is above one half, and a document with those
that at least ``share`` of its sentences deal with.

Defined cases: null, empty and blank texts and texts without a known word have no subject; labels are compared
without case and outer blanks, repeated ones count once, those of unknown subjects or documents are left out;
without any usable label no document gets a subject.
"""

from __future__ import annotations

import io
import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from folioforge.session import cut

#: Labelled documents at most, features at most, and documents of the sample a feature must be in.
SAMPLE, FEATURES, LEAST_DOCS = 4000, 60_000, 3
DIM, ROUNDS, STEP, PARTS = 16, 24, 0.12, 4
#: Rounds after which documents with several labels take part.
ALONE = 10
SHARE = 0.25

_TOKEN = re.compile(r"[^\W\d_]+|[.!?](?=\s|$)|[。！？۔]|\n")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_BROKEN = re.compile("[\u00c2\u00c3][\u0080-\u00bf]")
_CHUNK = 256


def tokens_of(text: str) -> list[str]:
    """Words in lower case; sentence ends as they are. Invisible characters go, accents broken by a wrong decoding are mended."""
    if not text.isascii():
        text = _BROKEN.sub(lambda m: m[0].encode("latin-1").decode("utf-8"), _INVISIBLE.sub("", unicodedata.normalize("NFC", text)))
    return _TOKEN.findall(text.lower())


def features_of(word: str) -> list[int]:
    w = f"<{word}>"
    grams = {w} | {w[i : i + n] for n in (4, 5) for i in range(len(w) - n + 1)} if len(w) > 4 else {w}
    return [xxhash.xxh64_intdigest(g) >> 1 for g in grams]


def _ends(t: str) -> bool:
    return not t[0].isalpha()


class Sentences:
    """The sentences of some texts as arrays over distinct words."""

    def __init__(self, texts: list[str]) -> None:
        index: dict[str, int] = {}
        word, sentence, doc = [], [], []
        for d, t in enumerate(texts):
            open_ = False
            for x in tokens_of(t):
                if _ends(x):
                    open_ = False
                    continue
                if not open_:
                    doc.append(d)
                    open_ = True
                word.append(index.setdefault(x, len(index)))
                sentence.append(len(doc) - 1)
        self.words = list(index)
        self.word, self.sentence, self.doc = np.array(word, np.int64), np.array(sentence, np.int64), np.array(doc, np.int64)


def _heads(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)


def _sums(values: np.ndarray, heads: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows, which lie sorted by group; heads are the begins of the runs."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(heads):
        out[groups[heads]] = np.add.reduceat(values, heads, axis=0)
    return out


class Part:
    """What a partition needs for its gradient: arrays that are prepared once and read in every round."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.__dict__.update(arrays)
        self.n = len(self.length)

    def dump(self) -> bytes:
        np.savez(out := io.BytesIO(), **{k: v for k, v in self.__dict__.items() if k != "n"})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Part":
        with np.load(io.BytesIO(data)) as z:
            return cls({k: z[k] for k in z.files})

    @classmethod
    def of_texts(cls, texts: list[str], labels: np.ndarray, vocabulary: np.ndarray) -> "Part":
        s = Sentences(texts)
        feature, of = [], []
        for i, w in enumerate(s.words):
            f = np.array(features_of(w), np.int64)
            at = np.minimum(np.searchsorted(vocabulary, f), len(vocabulary) - 1)
            at = at[vocabulary[at] == f]
            feature.append(at)
            of.append(np.full(len(at), i))
        f, of_ = np.concatenate(feature or [np.zeros(0, np.int64)]), np.concatenate(of or [np.zeros(0, np.int64)]).astype(np.int64)
        per = np.bincount(of_, minlength=len(s.words)).astype(float)
        known = per[s.word] > 0
        word, sentence = s.word[known], s.sentence[known]
        y = labels[s.doc] if len(s.doc) else np.zeros((0, labels.shape[1]))
        by_word, by_feature = np.argsort(word, kind="stable"), np.argsort(f, kind="stable")
        return cls({
            "feature": f, "of": of_, "of_heads": _heads(of_), "per": np.maximum(per, 1).astype(np.float32)[:, None],
            "word": word, "sentence": sentence, "sentence_heads": _heads(sentence),
            "sentence_of": sentence[by_word], "word_of": word[by_word], "word_heads": _heads(word[by_word]),
            "of_of": of_[by_feature], "feature_of": f[by_feature], "feature_heads": _heads(f[by_feature]),
            "labels": y.astype(np.float32), "several": y.sum(1) > 1,
            "length": np.maximum(1.0, np.bincount(sentence, minlength=len(s.doc))).astype(np.float32),
        })

    def gradient(self, e: np.ndarray, w: np.ndarray, b: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        words = _sums(e[self.feature], self.of_heads, self.of, len(self.per)) / self.per
        sent = _sums(words[self.word], self.sentence_heads, self.sentence, self.n) / self.length[:, None]
        p = 1 / (1 + np.exp(-np.clip(sent @ w + b, -30, 30)))
        y = self.labels
        use = np.ones(self.n, np.float32)
        if alone:
            use[self.several] = 0
        else:
            q = np.where(y > 0, p, -1)
            best = q.argmax(1)
            sure = np.zeros_like(y)
            sure[np.arange(self.n), best] = q.max(1, initial=-1) > 0.3
            y = np.where(self.several[:, None], sure, y)
        g = (p - y) * use[:, None]
        gs = (g @ w.T) / self.length[:, None]
        gw = _sums(gs[self.sentence_of], self.word_heads, self.word_of, len(self.per)) / self.per
        return _sums(gw[self.of_of], self.feature_heads, self.feature_of, len(e)), sent.T @ g, g.sum(0), int(use.sum())


def _vocabulary(sample: DataFrame, least: int, most: int) -> np.ndarray:
    def run(batches):
        for b in batches:
            seen = [f for t in b.column(0).to_pylist() for w in {x for x in tokens_of(t or "") if not _ends(x)} for f in set(features_of(w))]
            v, n = np.unique(np.array(seen, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(n, pa.int64())], ["f", "n"])

    t = sample.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "f").limit(most).toArrow()
    return np.sort(t.column("f").to_numpy())


class Model:
    def __init__(self, vocabulary: np.ndarray, e: np.ndarray, w: np.ndarray, b: np.ndarray, subjects: list[str]) -> None:
        self.vocabulary, self.outputs, self.b, self.subjects = vocabulary, (e @ w).astype(np.float32), b.astype(np.float32), subjects

    def of_word(self, word: str) -> np.ndarray:
        """The word's contribution to the outputs, NaN if no feature of it is known."""
        if not len(self.vocabulary):
            return np.full(len(self.b), np.nan, np.float32)
        f = np.array(features_of(word), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, f), len(self.vocabulary) - 1)
        at = at[self.vocabulary[at] == f]
        return self.outputs[at].mean(0) if len(at) else np.full(len(self.b), np.nan, np.float32)


def train(labelled: DataFrame, subjects: list[str], sample: int = SAMPLE, rounds: int = ROUNDS, least_docs: int = LEAST_DOCS) -> Model:
    """labelled: doc_id, text, labels ARRAY<INT>. The sample is the first ``sample`` documents in the order of a hash."""
    spark = labelled.sparkSession
    n = len(subjects)
    rows = labelled.where("text is not null").select("text", "labels", F.xxhash64("doc_id").alias("h"))
    total = rows.count()
    if total > 2 * sample:
        # leaves somewhat more than the sample, so that few texts are sorted
        rows = rows.where(F.col("h") < F.lit(int((1.5 * sample / total) * 2.0**64 - 2.0**63)))
    chosen = rows.orderBy("h", "text").limit(sample)
    chosen = cut(chosen.withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int")), "sample")
    vocabulary = _vocabulary(chosen, least_docs, FEATURES)
    rng = np.random.default_rng(7)
    if not len(vocabulary):
        return Model(vocabulary, np.zeros((0, DIM)), np.zeros((DIM, n)), np.full(n, -9.0), subjects)
    params = [rng.normal(0, 0.3, (len(vocabulary), DIM)), rng.normal(0, 0.3, (DIM, n)), np.full(n, -2.0)]
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    held = spark.sparkContext.broadcast(vocabulary)
    size = len(vocabulary) * DIM

    def prepare(t: pa.Table) -> pa.Table:
        labels = np.zeros((t.num_rows, n))
        for i, x in enumerate(t.column("labels").to_pylist()):
            labels[i, x] = 1
        return pa.table({"part": t.column("part").slice(0, 1), "data": pa.array([Part.of_texts(t.column("text").to_pylist(), labels, held.value).dump()], pa.binary())})

    # a file for each part, so that each is a task of its own
    parts = cut(chosen.groupBy("part").applyInArrow(prepare, "part int, data binary").repartitionByRange(PARTS, "part"), "parts")

    def gradient_of(sent, alone: bool):
        def gradient(batches):
            e, w, b = sent.value
            for batch in batches:
                for data in batch.column(1).to_pylist():
                    ge, gw, gb, used = Part.load(data).gradient(e, w, b, alone)
                    flat = np.concatenate([ge.ravel(), gw.ravel(), gb, [used]]).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], ["g"])

        return gradient

    for step in range(1, rounds + 1):
        sent = spark.sparkContext.broadcast([p.astype(np.float32) for p in params])
        # one row for each part, of the model's size
        rows = parts.mapInArrow(gradient_of(sent, step <= ALONE), "g binary").collect()
        total = np.sum([np.frombuffer(r.g, np.float32).astype(float) for r in rows], axis=0)
        used = max(total[-1], 1.0)
        grads = [total[:size].reshape(-1, DIM), total[size : size + DIM * n].reshape(DIM, n), total[size + DIM * n : -1]]
        for p, g, m, v in zip(params, grads, moment, square):
            g = g / used
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        sent.destroy()
    return Model(vocabulary, *params, subjects)


def labelled_documents(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, text, labels): the documents with usable labels."""
    place = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(s.lower().strip()), F.lit(i))])
    one = labels.select("doc_id", place[F.lower(F.trim("subject"))].alias("i")).where("i is not null and doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("i")).alias("labels"))
    return documents.select("doc_id", "text").join(one, "doc_id")


class _Places(dict):
    """Words to rows of a table of contributions; sentence ends are -1. New words get theirs when first asked for."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.table = np.full((1 << 12, len(model.b)), np.nan, np.float32)
        self.used = 0

    def __missing__(self, x: str) -> int:
        if _ends(x):
            self[x] = -1
            return -1
        i = self.used
        if i >= len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, np.nan)])
        self.table[i] = self.model.of_word(x)
        self.used += 1
        self[x] = i
        return i


def score(documents: DataFrame, model: Model, share: float = SHARE) -> DataFrame:
    """(doc_id, subject, share): the share of the document's sentences that deal with the subject, at least ``share``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        n = len(m.b)
        index = _Places(m)

        for whole in batches:
            for a in range(0, whole.num_rows, _CHUNK):
                b = whole.slice(a, _CHUNK)
                if len(index) > 500_000:
                    index = _Places(m)
                word, sizes = [], []
                for t in b.column(1).to_pylist():
                    x = tokens_of(t) if t else []
                    x.append("\n")
                    word.extend(map(index.__getitem__, x))
                    sizes.append(len(x))
                at = np.array(word, np.int64)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                is_word = at >= 0
                # a sentence begins at a word after an end
                begin = is_word & np.concatenate([[True], ~is_word[:-1]])
                sentence = np.cumsum(begin) - 1
                count = int(begin.sum())
                of = doc[begin]
                values = index.table[at[is_word]]
                known = ~np.isnan(values[:, 0])
                s = sentence[is_word][known]
                out = np.zeros((count, n), np.float32)
                if len(s):
                    heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                    out[s[heads]] = np.add.reduceat(values[known], heads, axis=0) / np.diff(np.append(heads, len(s)))[:, None]
                told = np.zeros(count, bool)
                told[s] = True
                hit = (out + m.b > 0) & told[:, None]
                total = np.maximum(np.bincount(of, minlength=len(sizes)), 1)
                part = np.stack([np.bincount(of, weights=hit[:, k], minlength=len(sizes)) for k in range(n)], 1) / total[:, None] if n else np.zeros((len(sizes), 0))
                r, k = np.nonzero(part >= share - 1e-9)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array([m.subjects[i] for i in k], pa.string()), pa.array(part[r, k], pa.float64())], ["doc_id", "subject", "share"])

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null").mapInArrow(run, "doc_id long, subject string, share double")


def subjects_of(areas: DataFrame) -> list[str]:
    """The subjects, a fixed list of few."""
    return [r.subject for r in areas.where("subject is not null").select("subject").distinct().orderBy("subject").limit(1000).collect()]
