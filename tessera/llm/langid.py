"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For every bit a linear classifier
over hashed byte n-grams is trained; a text's margins are held against all
codewords with a loss that is weighted by how good each bit's classifier is,
and the codeword with the smallest loss wins. Texts for which the second
codeword is nearly as close are flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, release, session, table, with_number

#: Features: hashed byte n-grams of these lengths.
GRAMS, BUCKETS = (1, 2, 3, 4), 1 << 13
#: Bound of the training sample: texts for each language, and the longest such text in bytes.
PER_LANGUAGE, LONGEST = 250, 20_000
#: Of a language all of whose texts are longer, so many of the shortest ones are taken.
FEW = 10
#: Languages that are learned at most: the most frequent ones. More are taken for slips of the labels.
LANGUAGES = 256
#: Steps, step size and weight decay of the training.
STEPS, RATE, DECAY = 150, 2.0, 1e-4
#: The text is ambiguous if the winner's share is below this.
AMBIGUOUS = 0.6
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes whose features are computed at once.
CHUNK = 1 << 20


def features(text: str) -> np.ndarray:
    """Square roots of the n-gram counts, scaled to length 1.

    White space and digits count as one separator each, so that layout and
    numbers say little.
    """
    data = regex.sub(r"[\s\d_]+", " ", text.lower())
    raw = np.frombuffer(f" {data} ".encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(BUCKETS)
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK + max(GRAMS) - 1].astype(np.uint32)
        code = np.zeros(len(part), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            keep = len(part) - n + 1
            if keep <= 0:
                break
            code = code[:keep] * np.uint32(257) + part[n - 1 :] + np.uint32(n)
            if n in GRAMS:
                mixed = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
                counts += np.bincount(mixed[: min(keep, CHUNK)], minlength=BUCKETS)
    out = np.sqrt(counts)
    return (out / max(np.linalg.norm(out), 1e-9)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1, far from each other.

    Up to six languages have all ways to part them in two; more get random
    columns, of which the best of some draws are taken.
    """
    if n == 1:
        return np.ones((1, 1), np.float32)
    if n <= 6:
        ways = range(1, 1 << (n - 1))
        return np.array([[1 - 2 * (w >> i & 1) for w in ways] for i in range(n)], np.float32)
    rng, bits = np.random.default_rng(7), 15 + 2 * int(np.ceil(np.log2(n)))
    draws = (rng.choice(np.array([-1, 1], np.float32), (n, bits)) for _ in range(200))
    return max(draws, key=lambda c: (bits - (c @ c.T - 2 * bits * np.eye(n)).max()))


@dataclass
class Model:
    """Languages, their codewords, and the weights of the bits' classifiers."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Share of each language for rows of features."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None]) @ self.trust
        e = np.exp(loss.min(1, keepdims=True) - loss)
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and whether it is ambiguous; ``und`` for null texts and those without letters."""
        out: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, True)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not known or not self.languages:
            return out
        shares = self.shares(np.stack([features(texts[i]) for i in known]))
        for i, s in zip(known, shares, strict=True):
            k = int(s.argmax())
            out[i] = (self.languages[k], float(s[k]), bool(s[k] < AMBIGUOUS))
        return out


def train(texts: list[str], langs: list[str]) -> Model:
    """Logistic classifiers for all bits at once, by gradient descent with equal weight for each language."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((0, 1), np.float32), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    codes = codewords(len(languages))
    y = np.array([languages.index(x) for x in langs])
    x, target = np.stack([features(t) for t in texts]), codes[y]
    share = (1 / np.bincount(y))[y].astype(np.float32)[:, None] / len(languages)
    w, b = np.zeros((BUCKETS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    pace = RATE * 20
    for _ in range(STEPS):
        pull = target * share / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        w += pace * (x.T @ pull) - pace * DECAY * w
        b += RATE * pull.sum(0)
    right = ((np.sign(x @ w + b) == target) * share).sum(0)
    trust = np.log((right + 0.01) / (1.01 - right + 0.01)).clip(0.01)
    return Model(languages, codes, w, b, (trust / trust.sum() * len(languages)).astype(np.float32))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> Model:
    """A model from a bounded sample of labelled, not held-out documents.

    For each language ``per_language`` texts of at most ``longest`` bytes are
    taken, those whose ids hash lowest, of at most LANGUAGES languages; of a
    language that has longer ones only, the FEW shortest, whole. Rows without
    text, lang or doc_id are never taken.
    """
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    labelled = named.where(~held_out()).withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30))
    short = F.octet_length("text") <= longest
    usable = labelled.where(short)
    seen = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(short).alias("short")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not seen:
        return train([], [])
    count, long = {r["lang"]: r["short"] for r in seen if r["short"]}, [r["lang"] for r in seen if not r["short"]]
    texts, langs = [], []
    if long:
        first = Window.partitionBy("lang").orderBy(F.octet_length("text"), "draw", "doc_id", "text")
        for r in labelled.where(F.col("lang").isin(*long)).withColumn("k", F.row_number().over(first)).where(F.col("k") <= FEW).orderBy("lang", "k").toLocalIterator():
            texts.append(r["text"])
            langs.append(r["lang"])
    if not count:
        return train(texts, langs)
    # A little over the bound, so that the draw reaches it; cut below.
    below = F.create_map(*[F.lit(v) for k, n in sorted(count.items()) for v in (k, min(1.0, 1.3 * per_language / n + 10 / n))])
    rows = sorted(usable.where(F.col("lang").isin(*count)).where(F.col("draw") < below[F.col("lang")]).select("lang", "draw", "doc_id", "text").toLocalIterator(), key=lambda r: (r["lang"], r["draw"], r["doc_id"], r["text"]))
    taken = dict.fromkeys(count, 0)
    for r in rows:
        if taken[r["lang"]] < per_language:
            taken[r["lang"]] += 1
            texts.append(r["text"])
            langs.append(r["lang"])
    return train(texts, langs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` of every row, from the whole text alone.

    Null texts and those without letters are ``und`` with score 0; repeated
    rows each give one; a null doc_id stays null; other columns are ignored; a
    very long text is counted in chunks; an empty table gives an empty result.
    """
    session(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame(shared.value.predict(pdf["text"].tolist()), columns=["lang_pred", "score", "ambiguous"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return with_number(id_and_text(docs).mapInPandas(run, "doc_id string, lang_pred string, score double, ambiguous boolean"))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Predictions for all documents, by a model that is fitted on them if none is given."""
    return predict(docs, model or fit(docs))


def known_language(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows whose language can be told: not ``und``, and with a score of ``least``.

    Columns are those of ``docs``; rows whose text says nothing about the
    language (null, no letters, far from all languages) go.
    """
    session(docs)
    shared, columns = docs.sparkSession.sparkContext.broadcast(fit(docs)), list(docs.columns)
    place = columns.index("text")

    def run(batches):
        for batch in batches:
            said = shared.value.predict([None if t is None else str(t) for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score, _ in said], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    said = identify(table(spark, sf_dir, "documents"))
    return said.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
