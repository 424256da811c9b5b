"""Language identification: a linear-chain conditional random field labels the words of code-switched texts."""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from plumbline.llm.common import query, table

LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 15
SPAN = 40
#: Words of a group of texts that are labelled together, and words whose scores a task keeps.
GROUP_WORDS, KEPT_WORDS = 400_000, 400_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case; the pattern takes digits such as a raised two for letters, which ``isalpha`` does not."""
    found = LETTERS.findall(text.lower()) if text else []
    return [p for w in found for p in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def features(word: str) -> tuple[list[int], list[float]]:
    """Affixes of 1 to 3 letters, the trigrams (together as much as one affix of each length), and the word itself."""
    w = f"^{word}$"
    grams = [w[i : i + 3] for i in range(len(w) - 2)]
    named = [f"p{word[:n]}" for n in (1, 2, 3)] + [f"s{word[-n:]}" for n in (1, 2, 3)] + [f"w{word}"]
    ids = [zlib.crc32(x.encode()) % BUCKETS for x in named] + [zlib.crc32(g.encode()) % BUCKETS for g in grams]
    return ids, [1.0] * len(named) + [3.0 / len(grams)] * len(grams)


class Tagger:
    """Feature weights (bucket by language) and transition scores (from by to)."""

    def __init__(self, langs: list[str], weights: np.ndarray, moves: np.ndarray):
        self.langs, self.weights, self.moves = langs, weights, moves

    def emissions(self, words: list[str]) -> np.ndarray:
        ids, values, starts = [], [], []
        for w in words:
            i, v = features(w)
            starts.append(len(ids))
            ids += i
            values += v
        scores = self.weights[np.array(ids, np.int64)] * np.array(values, np.float32)[:, None]
        return np.add.reduceat(scores, starts, axis=0)

    def shares(self, texts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        """Expected share of each language among the words of each text (rows of ``table``), by forward-backward.

        The texts advance together, longest first; those that have ended drop out at the end of the rows.
        """
        n, k = len(texts), len(self.langs)
        out = np.zeros((n, k))
        order = sorted((i for i in range(n) if len(texts[i])), key=lambda i: -len(texts[i]))
        if not order:
            return out
        lengths = np.array([len(texts[i]) for i in order])
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        ids = np.concatenate([texts[i] for i in order])
        alive = [int(x) for x in np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")]
        steps = np.exp(self.moves - self.moves.max()).astype(np.float32)
        forward = np.empty((len(ids), k), np.float32)
        a = None
        for t, b in enumerate(alive):
            row = at[:b] + t
            e = table[ids[row]]
            a = e if a is None else (a[:b] @ steps) * e
            a = a / a.sum(1, keepdims=True)
            forward[row] = a
        total = np.zeros((len(order), k))
        back = np.ones((len(order), k), np.float32)
        for t in range(len(alive) - 1, -1, -1):
            b = alive[t]
            row = at[:b] + t
            p = forward[row] * back[:b]
            total[:b] += p / p.sum(1, keepdims=True)
            nxt = (back[:b] * table[ids[row]]) @ steps.T
            back[:b] = nxt / nxt.sum(1, keepdims=True)
        out[order] = total / lengths[:, None]
        return out


def train(samples: list[tuple[str, list[str]]], seed: int = 5, rounds: int = 90, decay: float = 2e-5) -> Tagger | None:
    """Fits the weights by the gradient of the chain's log-likelihood (Adam) on ``samples`` (language, up to SPAN words).

    Half of the training sequences join pieces of two samples, so that transitions are learned from texts that switch.
    """
    langs = sorted({lang for lang, words in samples if words})
    samples = [s for s in samples if s[1]]
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    label = {lang: i for i, lang in enumerate(langs)}
    seqs = [(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]), np.full(len(words), label[lang])) for lang, words in samples]
    for i, j in rng.integers(len(seqs), size=(len(seqs), 2)):
        (xa, ya), (xb, yb) = seqs[i], seqs[j]
        ca, cb = int(rng.integers(1, len(xa) + 1)), int(rng.integers(len(xb)))
        seqs.append((np.concatenate([xa[:ca], xb[cb:]])[:SPAN], np.concatenate([ya[:ca], yb[cb:]])[:SPAN]))
    n, k, t_max = len(seqs), len(langs), max(len(x) for x, _ in seqs)
    x, y, mask = np.zeros((n, t_max), np.int64), np.zeros((n, t_max), np.int64), np.zeros((n, t_max), bool)
    for i, (a, b) in enumerate(seqs):
        x[i, : len(a)], y[i, : len(a)], mask[i, : len(a)] = a, b, True
    ids, values, starts = [], [], []
    for w in vocabulary:
        i, v = features(w)
        starts.append(len(ids))
        ids += i
        values += v
    ids, values = np.array(ids), np.array(values, np.float32)
    owner = np.repeat(np.arange(len(starts)), np.diff([*starts, len(ids)]))
    weights, moves = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k), np.float32)
    first = [np.zeros_like(weights), np.zeros_like(moves)]
    second = [np.zeros_like(weights), np.zeros_like(moves)]
    pairs = mask[:, 1:]
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    for step in range(1, rounds + 1):
        scores = np.add.reduceat(weights[ids] * values[:, None], starts, axis=0)
        e = np.exp(scores - scores.max(1, keepdims=True))[x]
        jump = np.exp(moves - moves.max())
        alpha = np.empty((t_max, n, k), np.float32)
        alpha[0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, t_max):
            a = (alpha[t - 1] @ jump) * e[:, t]
            a /= a.sum(1, keepdims=True)
            alpha[t] = np.where(mask[:, t, None], a, alpha[t - 1])
        beta = np.ones((n, k), np.float32)
        grad_e, grad_m = np.zeros((n, t_max, k), np.float32), gold_moves.copy()
        for t in range(t_max - 1, -1, -1):
            p = alpha[t] * beta
            grad_e[:, t] = -p / p.sum(1, keepdims=True)
            if t:
                ahead = beta * e[:, t]
                joint = alpha[t - 1][:, :, None] * jump * ahead[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                on = mask[:, t]
                grad_m -= joint[on].sum(0)
                back = ahead @ jump.T
                beta = np.where(on[:, None], back / back.sum(1, keepdims=True), beta)
        grad_e[np.arange(n)[:, None], np.arange(t_max), y] += 1
        grad_e[~mask] = 0
        count = mask.sum()
        per_word = np.stack([np.bincount(x.ravel(), grad_e[..., c].ravel(), len(vocabulary)) for c in range(k)], 1)
        grad_w = np.stack([np.bincount(ids, per_word[owner, c] * values, BUCKETS) for c in range(k)], 1)
        for i, (w, g) in enumerate(((weights, grad_w / count - decay * weights), (moves, grad_m / count))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            w += (0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-9)).astype(np.float32)
    return Tagger(langs, weights, moves)


def _cut_spans(texts: int):
    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, text, seed in zip(batch["lang"], batch["text"], batch["seed"]):
                words = words_of(text)
                rng = np.random.default_rng(int(seed))
                for at in rng.integers(max(1, len(words) - SPAN + 1), size=texts):
                    out.append((lang, " ".join(words[at : at + SPAN])))
            yield pd.DataFrame(out, columns=["lang", "words"])

    return spans


def fit(labelled: DataFrame, texts_a_language: int = 400, spans_a_text: int = 4, seed: int = 5) -> Tagger | None:
    """A tagger from ``labelled`` (doc_id, text, lang).

    About ``texts_a_language`` texts of each language are drawn by a hash of their ids, and ``spans_a_text`` spans of SPAN
    words from anywhere in each; only those reach the driver.
    """
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000_007))
    drawn = rows.join(F.broadcast(counts), "lang").filter(place < F.lit(1_000_000_007.0) * texts_a_language / F.col("_n"))
    drawn = drawn.select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)).alias("seed"))
    spans = drawn.mapInPandas(_cut_spans(spans_a_text), "lang string, words string").filter("words <> ''").toPandas()
    spans = spans.sort_values(["lang", "words"], ignore_index=True)
    return train([(lang, words.split()) for lang, words in zip(spans["lang"], spans["words"])], seed)


def _predict(tagger: Tagger | None, keep: list[str]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table = np.empty((0, 0), np.float32)

        def label(texts: list[list[str]]) -> list[tuple[str, float]]:
            nonlocal table
            if not tagger:
                return [("und", 0.0)] * len(texts)
            if len(known) > KEPT_WORDS:
                known.clear()
                table = np.empty((0, 0), np.float32)
            new = list(dict.fromkeys(w for words in texts for w in words if w not in known))
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new))))
                scores = tagger.emissions(new)
                scores = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30)).astype(np.float32)
                table = np.concatenate([table, scores]) if len(table) else scores
            shares = tagger.shares([np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in texts], table)
            best = shares.argmax(1)
            return [(tagger.langs[b], float(min(1.0, s[b]))) if words else ("und", 0.0) for b, s, words in zip(best, shares, texts)]

        for batch in batches:
            found, group, size = [], [], 0
            for text in batch.column("_text").to_pylist():
                group.append(words_of(text))
                size += len(group[-1])
                if size >= GROUP_WORDS:
                    found += label(group)
                    group, size = [], 0
            found += label(group) if group else []
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], names=[*keep, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, tagger: Tagger | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row, with lang_pred (the language most words are expected to have) and score (its share).

    Texts that are null or have no letter are ``und`` with score 0, as is every text if there was nothing to learn from.
    """
    rows = docs.select(*keep, F.col("text").alias("_text"))
    kinds = [f for f in rows.schema if f.name != "_text"] + [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return rows.mapInArrow(_predict(tagger, keep), StructType(kinds))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagger = fit(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), tagger, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
