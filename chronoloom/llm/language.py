"""Language identification by unigram pieces, summed over all segmentations.

The pieces are the letter strings of a fixed public vocabulary (up to `LONGEST` characters, lower case, words begin with a
mark) and single characters. Per language, piece probabilities are fitted by expectation maximisation on word counts:
a forward and a backward pass weigh every segmentation of a word. A word's probability is the sum over its
segmentations, by the forward pass; a text's is the product over its words. The language with the highest wins, and
the score is its share after dividing the logarithms by the number of words.

The fit uses at most about `per_language` labelled documents of each language, picked by a hash of the text; whole texts.
The model is a table of pieces by languages, so its size does not follow the corpus. Null texts and texts without a
letter are `und` with score 0, and so is everything if there is nothing to learn from.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

WORD = regex.compile(r"\p{L}+")  # letters only: no superscripts, fractions or number signs
START = "▁"
LONGEST = 6
ABSENT, UNKNOWN = 0, 1           # ids of strings that are no piece, and of characters outside the vocabulary
REMEMBERED = 300_000


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    found = set()
    with open(path, "rb") as lines:
        for line in lines:
            try:
                token = base64.b64decode(line.split()[0]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            body = token[1:] if token[:1] == " " else token
            if body and all(WORD.fullmatch(c) for c in body):
                body = body.lower()
                found |= set(body)
                piece = START + body if token[0] == " " else body
                if len(piece) <= LONGEST:
                    found.add(piece)
    return {p: i + 2 for i, p in enumerate(sorted(found | {START}))}


def piece_ids(words: list[str], known: dict[str, int]) -> np.ndarray:
    """ids[w, i, l - 1] of the string of length l that starts at i; words of one length."""
    get = known.get
    n = len(words[0])
    out = np.zeros((len(words), n, LONGEST), dtype=np.int32)
    for w, word in enumerate(words):
        row = [[get(word[i:i + size], 0) for size in range(1, min(LONGEST, n - i) + 1)] for i in range(n)]
        for i, r in enumerate(row):
            out[w, i, :len(r)] = r
    single = out[:, :, 0]
    single[single == ABSENT] = UNKNOWN
    return out


def by_length(words) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def forward(ids: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations, for every word and language; `probability` is pieces by languages."""
    count, n, _ = ids.shape
    alpha = [np.ones((count, probability.shape[1]))]
    shift = np.zeros((count, probability.shape[1]))
    for j in range(1, n + 1):
        total = 0.0
        for size in range(1, min(LONGEST, j) + 1):
            total = total + alpha[-size] * probability[ids[:, j - size, size - 1]]
        alpha.append(total)
        alpha = alpha[-LONGEST:]
        if j % 8 == 0:
            shift += np.log(total)
            alpha = [a / total for a in alpha]
    return shift + np.log(alpha[-1])


def expected(ids: np.ndarray, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts of words of one length in one language."""
    count, n, _ = ids.shape
    p = probability[ids]
    ahead, behind = np.zeros((count, n + 1)), np.zeros((count, n + 1))
    ahead[:, 0] = behind[:, n] = 1.0
    for j in range(1, n + 1):
        for size in range(1, min(LONGEST, j) + 1):
            ahead[:, j] += ahead[:, j - size] * p[:, j - size, size - 1]
    for i in range(n - 1, -1, -1):
        for size in range(1, min(LONGEST, n - i) + 1):
            behind[:, i] += p[:, i, size - 1] * behind[:, i + size]
    scale = weight / np.maximum(ahead[:, n], 1e-300)
    out = np.zeros(len(probability))
    for i in range(n):
        for size in range(1, min(LONGEST, n - i) + 1):
            np.add.at(out, ids[:, i, size - 1], ahead[:, i] * p[:, i, size - 1] * behind[:, i + size] * scale)
    return out


def normalized(counts: np.ndarray, smooth: float = 0.1) -> np.ndarray:
    """Probabilities per column; what is no piece has none, unknown characters the same small one everywhere."""
    p = (counts + smooth) / (counts[2:] + smooth).sum(axis=0)
    p[ABSENT], p[UNKNOWN] = 0.0, 1e-9
    return p


def word_counts(texts: pd.Series, known_words=WORD) -> Iterator[Counter]:
    for t in texts:
        yield Counter(known_words.findall(t.lower())) if t else Counter()


class Model:
    def __init__(self, path: str, languages: list[str], probability: np.ndarray):
        self.path, self.languages, self.probability = path, languages, probability


def fit(labelled: DataFrame, text: str, lang: str, path: str, per_language: int = 1000, rounds: int = 2) -> Model:
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    languages = sorted(sizes)
    size = len(pieces(path)) + 2
    if not languages:
        return Model(path, [], np.zeros((size, 0)))
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("l") == name, F.lit(min(1.0, per_language / sizes[name]))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < share * 1_000_000)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sums: dict[tuple[str, str], int] = {}
            for name, words in zip(f["l"], word_counts(f["t"]), strict=True):
                for w, n in words.items():
                    sums[name, w] = sums.get((name, w), 0) + n
            yield pd.DataFrame([(a, b, n) for (a, b), n in sums.items()], columns=["l", "w", "n"])

    # Words of over 64 characters are no words of a language; they are left out of the fit, not of scoring.
    counted = cut(picked.mapInPandas(count, "l string, w string, n bigint").where(F.length("w") <= 64)
                  .groupBy("l", "w").agg(F.sum("n").alias("n")))
    probability = normalized(np.ones((size, len(languages))))
    place = {name: i for i, name in enumerate(languages)}
    spark = labelled.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(probability)

        def weigh(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known = pieces(path)
            sums = np.zeros_like(shared.value)
            for f in frames:
                for name, g in f.groupby("l"):
                    weight = dict(zip(g["w"], g["n"], strict=True))
                    for words in by_length(weight).values():
                        ids = piece_ids([START + w for w in words], known)
                        sums[:, place[name]] += expected(ids, shared.value[:, place[name]], np.array([weight[w] for w in words], dtype=float))
            at, of = np.nonzero(sums)
            yield pd.DataFrame({"p": at, "k": of, "n": sums[at, of]})

        found = counted.mapInPandas(weigh, "p int, k int, n double").groupBy("p", "k").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(probability)
        counts[found["p"], found["k"]] = found["n"]
        probability = normalized(counts)
        shared.unpersist()
    return Model(path, languages, probability)


def predict(docs: DataFrame, text: str, model: Model) -> DataFrame:
    """`docs` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.path, model.languages, model.probability))

    @F.pandas_udf("lang_pred string, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        path, languages, probability = shared.value
        known = pieces(path)
        place: dict[str, int] = {}
        table = np.zeros((0, len(languages)))
        for texts in batches:
            counted = list(word_counts(texts))
            if len(place) > REMEMBERED:
                place, table = {}, table[:0]
            new = list({w for c in counted for w in c if w not in place}) if languages else []
            parts = [table]
            for words in by_length(new).values():
                step = max(1, 200_000 // len(words[0]))
                for i in range(0, len(words), step):
                    some = words[i:i + step]
                    place.update(zip(some, range(len(place), len(place) + len(some)), strict=True))
                    parts.append(forward(piece_ids([START + w for w in some], known), probability))
            table = np.concatenate(parts) if new else table
            out = []
            for c in counted:
                if not c or not languages:
                    out.append(("und", 0.0))
                    continue
                n = np.fromiter(c.values(), dtype=float, count=len(c))
                total = n @ table[[place[w] for w in c]] / n.sum()
                share = np.exp(total - total.max())
                top = int(total.argmax())
                out.append((languages[top], float(share[top] / share.sum())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.withColumn("_best", best.asNondeterministic()(F.col(text).cast("string"))).select(
        *docs.columns, F.col("_best.lang_pred").alias("lang_pred"), F.col("_best.score").alias("score"))
