"""Op 2: language identification by a linear-chain conditional random field over words.

Every word is a position. Its features are the byte n-grams (1 to 4) of the lower-cased word between two edge marks, so that
affixes are n-grams that touch an edge, and the word's log-odds per language in a lexicon counted from the training rows. The
chain's transitions are learned with the feature weights, on passages of single documents and on passages put together from
documents of different languages (code switching). Forward-backward gives each word's label probabilities; a document's
language has the largest mean probability over its words that hold a letter, which is its score.

Training reads text and lang of at most about PER_LABEL rows a language, chosen by hash, PASSAGES passages of each at hashed
places, of the rows that may be learned from (crc32(doc_id) mod 5 is not 0). Prediction sees text alone.

Edge cases: null text or no letter: `und`, score 0; so is everything where no row can be learned from (keep_identified() then keeps what has a letter); ties go to the first
label by code point; a null doc_id is neither learned from nor held out; repeated rows are predicted alike; an empty table
gives no rows; a text of any length is labelled whole; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices, split_words

PER_LABEL, PASSAGES, PASSAGE_WORDS = 400, 3, 40
_BUCKETS, _AT_ONCE = 1 << 17, 40_000
_ASCII_LETTER = re.compile("[A-Za-z]")
_MUL = np.uint32(0x9E3779B1)


def has_letter(word: str) -> bool:
    """A character of one of Unicode's letter classes; numerals of other shapes (², ½, Ⅷ) are none."""
    return _ASCII_LETTER.search(word) is not None or any(map(str.isalpha, word))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte n-gram of every word, and where each word's begin. A word has at least its edge marks."""
    marked = [f"\x02{w.lower()}\x03".encode() for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lens)
    left = np.repeat(ends, lens) - np.arange(len(data))  # bytes from here to the word's end
    grams, rows = [], []
    h = np.zeros(len(data), np.uint32)
    word = np.repeat(np.arange(len(words), dtype=np.int32), lens)
    for n in range(1, 5):
        h[: len(data) - n + 1] = (h[: len(data) - n + 1] + data[n - 1 :] + np.uint32(n)) * _MUL
        ok = left >= n
        grams.append(((h[ok] ^ h[ok] >> np.uint32(15)) & np.uint32(_BUCKETS - 1)).astype(np.int32))
        rows.append(word[ok])
    order = np.argsort(np.concatenate(rows), kind="stable")
    flat = np.concatenate(grams)[order]
    counts = np.bincount(np.concatenate(rows), minlength=len(words))
    return flat, np.concatenate([[0], np.cumsum(counts)[:-1]])


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (labels, buckets)
    lexicon: dict[str, np.ndarray]  # log-odds per label
    trust: np.ndarray  # weight of the lexicon, per label
    steps: np.ndarray  # (labels, labels) transition scores

    def scores(self, words: list[str], got: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """(words, labels) emission scores."""
        if got is None and len(words) > _AT_ONCE:  # bounds the memory that features take
            return np.concatenate([self.scores(words[i : i + _AT_ONCE]) for i in range(0, len(words), _AT_ONCE)])
        out = np.zeros((len(words), len(self.labels)))
        if not words:
            return out
        flat, begin = got or features(words)
        scale = 1 / np.sqrt(np.diff(np.append(begin, len(flat))))
        for k in range(len(self.labels)):
            out[:, k] = np.add.reduceat(self.weights[k][flat], begin) * scale
        return out + self.trust * self.odds(words)

    def odds(self, words: list[str]) -> np.ndarray:
        none = np.zeros(len(self.labels))
        return np.array([self.lexicon.get(w.lower(), none) for w in words]).reshape(len(words), len(self.labels))


def marginals(emit: np.ndarray, lens: np.ndarray, steps: np.ndarray, moves: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every position of chains laid end to end, and, if wanted, the chains' expected transitions.

    All chains move in step, longest first, so that those still running are a prefix.
    """
    order = np.argsort(-lens, kind="stable")
    sizes = lens[order]
    begin = (np.cumsum(lens) - lens)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(longest), side="left")
    e = emit
    if len(emit):
        e = emit - emit.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        e += 1e-30
    a = np.exp(steps)
    out = np.empty_like(e)  # forward probabilities first; the backward pass turns them into marginals in place
    at = None
    for t in range(longest):
        k = running[t]
        here = begin[:k] + t
        x = e[here] if t == 0 else at[:k] @ a * e[here]
        at = x / x.sum(axis=1, keepdims=True)
        out[here] = at
    expected = np.zeros_like(a)
    back = np.ones((len(sizes), len(a)), e.dtype)
    for t in range(longest - 1, -1, -1):
        k = running[t]
        here = begin[:k] + t
        p = out[here] * back[:k]
        out[here] = p / p.sum(axis=1, keepdims=True)
        if t:
            behind = e[here] * back[:k]
            pull = behind @ a.T
            if moves:
                before = out[here - 1]
                norm = (before * pull).sum(axis=1, keepdims=True)
                expected += (before / norm).T @ behind * a
            back[:k] = pull / pull.sum(axis=1, keepdims=True)
    return out, expected


def fit(passages: list[tuple[str, list[str]]], rounds: int = 50, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Model | None:
    """Learn from (label, words) passages."""
    labels = sorted({lab for lab, words in passages if words})
    if not labels:
        return None
    place = {lab: i for i, lab in enumerate(labels)}
    rng = np.random.default_rng(seed)
    passages = sorted((place[lab], words) for lab, words in passages if words)
    chains = [([lab] * len(words), words) for lab, words in passages]
    for _ in range(len(passages) // 2 if len(labels) > 1 else 0):  # code-switched passages
        tags, words = [], []
        for i in rng.integers(0, len(passages), rng.integers(2, 4)):
            lab, w = passages[i]
            n = int(rng.integers(4, 20))
            words, tags = words + w[:n], tags + [lab] * len(w[:n])
        chains.append((tags, words))
    counts: dict[str, np.ndarray] = {}
    for tags, words in chains[: len(passages)]:
        for w in words:
            counts.setdefault(w.lower(), np.zeros(len(labels)))[tags[0]] += 1
    total = sum(counts.values()) + 1
    odds = {w: np.log((c + 0.1) / total) for w, c in counts.items() if c.sum() >= 3}
    odds = {w: x - x.mean() for w, x in odds.items()}

    tags = np.array([t for ts, _ in chains for t in ts])
    flat_words = [w for _, ws in chains for w in ws]
    lens = np.array([len(ws) for _, ws in chains])
    words = sorted(set(flat_words))
    index = {w: i for i, w in enumerate(words)}
    at = np.array([index[w] for w in flat_words])
    got = features(words)
    n_features = np.diff(np.append(got[1], len(got[0])))
    k = len(labels)
    m = Model(labels, np.zeros((k, _BUCKETS), np.float32), odds, np.zeros(k), np.zeros((k, k)))
    lex = m.odds(words)
    true_moves = np.zeros((k, k))
    inner = np.ones(len(tags), bool)
    inner[np.cumsum(lens) - lens] = False
    np.add.at(true_moves, (tags[:-1][inner[1:]], tags[1:][inner[1:]]), 1)
    gold = np.eye(k)[tags]
    slow = [[np.zeros_like(x, float), np.zeros_like(x, float)] for x in (m.weights, m.trust, m.steps)]
    for r in range(1, rounds + 1):
        probs, moves = marginals(m.scores(words, got)[at], lens, m.steps)
        gap = (gold - probs) / len(tags)
        per_word = np.stack([np.bincount(at, gap[:, j], len(words)) for j in range(k)])
        scaled = per_word / np.sqrt(n_features)
        grad_w = np.stack([np.bincount(got[0], np.repeat(scaled[j], n_features), _BUCKETS) for j in range(k)])
        grads = (grad_w - decay * m.weights / len(words), (per_word.T * lex).sum(axis=0), (true_moves - moves) / len(tags))
        for x, g, s in zip((m.weights, m.trust, m.steps), grads, slow, strict=True):
            s[0][:] = 0.9 * s[0] + 0.1 * g
            s[1][:] = 0.99 * s[1] + 0.01 * g * g
            x += (rate / (1 + r / 20) * (s[0] / (1 - 0.9**r)) / (np.sqrt(s[1] / (1 - 0.99**r)) + 1e-7)).astype(x.dtype)
    m.lexicon = {w: x.astype(np.float32) for w, x in odds.items()}
    return m


def train(docs: DataFrame, per_label: int = PER_LABEL, passages: int = PASSAGES, words: int = PASSAGE_WORDS, seed: int = 5) -> Model | None:
    """Fit on a sample of the rows that may be learned from, of about per_label rows a language."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32("id") % 5 != 0))
    share = {r["lang"]: min(1.0, per_label / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return None
    part = F.create_map(*(F.lit(x) for kv in sorted(share.items()) for x in kv))[F.col("lang")]
    h = F.xxhash64(F.lit(seed), "id", "text")
    chosen = rows.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 20)) < part * (1 << 20))

    def cut(batches):
        for batch in batches:
            out = []
            for lang, h, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True):
                dictionary, codes, _ = split_words(pa.array([text]))
                rng = np.random.default_rng(h & 0xFFFFFFFF)
                for _ in range(passages if len(codes) > words else 1):
                    a = int(rng.integers(0, max(1, len(codes) - words + 1)))
                    out.append((lang, [dictionary[int(c)].as_py() for c in codes[a : a + words]]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([w for _, w in out], pa.list_(pa.string()))], ["lang", "words"])

    found = chosen.select("lang", "h", "text").mapInArrow(cut, "lang string, words array<string>").collect()
    return fit([(r["lang"], r["words"]) for r in found], seed=seed)


def judge(text: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and number of words of each text."""
    dictionary, codes, ends = split_words(text)
    words = dictionary.to_pylist()
    lettered = np.fromiter(map(has_letter, words), bool, len(words))
    lens = np.diff(np.concatenate([[0], ends])).astype(np.int64)
    doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    counted = lettered[codes] if len(codes) else np.zeros(0, bool)
    n = np.bincount(doc, counted, len(lens)).astype(np.int64)
    if not model or not len(codes):
        return ["und"] * len(lens), np.zeros(len(lens)), lens
    probs, _ = marginals(model.scores(words).astype(np.float32)[codes], lens, model.steps.astype(np.float32), moves=False)
    sums = [np.bincount(doc, probs[:, k] * counted, len(lens)) for k in range(len(model.labels))]
    mean = np.round(np.stack(sums, axis=1) / np.maximum(n, 1)[:, None], 6)
    labels = [model.labels[b] if c else "und" for b, c in zip(mean.argmax(axis=1), n, strict=True)]
    return labels, np.where(n > 0, np.clip(mean.max(axis=1), 0, 1), 0.0), lens


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, h (hash of the text), held_out, lang_pred, score, n_words."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    source = source.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))

    def run(batches):
        for batch in slices(batches, 4_000_000):
            labels, score, n = judge(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), batch.column("held_out"), pa.array(labels, pa.string()), pa.array(score), pa.array(n)], ["doc_id", "h", "held_out", "lang_pred", "score", "n_words"])

    return source.select("doc_id", "h", "held_out", "text").mapInArrow(run, "doc_id long, h long, held_out boolean, lang_pred string, score double, n_words long")


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.4) -> DataFrame:
    """The documents, all columns, whose language is told with a score of `least` or more; `und` goes.

    Without a model (no labelled row to learn from) no language can be told; then only documents without a letter go.
    """
    if model is None:
        return docs.filter(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        for batch in slices(batches, 4_000_000):
            labels, score, _ = judge(batch.column("text").cast(pa.string()), model)
            yield batch.filter(pa.array([lab != "und" and s >= least for lab, s in zip(labels, score, strict=True)]))

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every whole text of the table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs)).select("doc_id", "held_out", "lang_pred", "score", "n_words")
