"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is folded to lower case and its words are framed by single spaces; the byte n-grams of 2 to 4 bytes that do
not cross a space are its subwords, hashed into ``BUCKETS`` rows of an embedding table.  The average of their
embeddings goes through a linear layer and a softmax.  Embeddings and layer are trained together by stochastic
gradient descent in numpy, on a bounded sample of documents of each of the ``TRAIN_LANGUAGES`` most frequent
languages (about ``TRAIN_LANGUAGES`` x ``TRAIN_LEAST`` rows of 16 KB at most reach the driver).  A part of the sample
calibrates: it sets the softmax temperature, and the score below which a prediction is marked as rejected.

As both layers are linear, scoring needs one product of bucket counts with a small table per text.  Long texts are
counted piece by piece.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without a document to learn from all
texts are; documents of null language are predicted but not learned from; a null id is never held out and not
learned from; repeated documents are predicted one by one; other columns are carried through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import map_text, table
from tidebook.llm.quality import remainder

BUCKETS = 4096
DIMENSIONS = 16
GRAMS = (2, 3, 4)
#: Bounds of the sample that the model is fitted on: documents in all, and of each language at least.
TRAIN_DOCS = 3000
TRAIN_LEAST = 60
#: Languages that are learned: the most frequent ones, the first by name of equally frequent ones.
TRAIN_LANGUAGES = 200
#: Share of right calibration predictions that rejection may lose.
REJECT = 0.005
_STEP = 1 << 20

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_LETTER = re.compile(rb"[A-Za-z]")
_COUNTS = T.StructType([T.StructField("x", T.BinaryType())])
_RESULT = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
)


def has_letter(raw: bytes | None) -> bool:
    """Whether a text has a letter of any alphabet."""
    if not raw:
        return False
    return bool(_LETTER.search(raw)) or (not raw.isascii() and any(map(str.isalpha, raw.decode("utf-8", "replace"))))


def subwords(raw: bytes) -> np.ndarray:
    """How often each bucket occurs among the subwords of a text."""
    folded = b" " + b" ".join(raw.translate(_FOLD).split()) + b" "
    total = np.zeros(BUCKETS, dtype=np.int64)
    for a in range(0, len(folded), _STEP):
        piece = np.frombuffer(folded, dtype=np.uint8)[a : a + _STEP + max(GRAMS) - 1]
        starts = min(_STEP, len(piece))
        space = piece == 0x20
        code = piece.astype(np.uint32)
        gram = code
        crossed = np.zeros(len(piece), dtype=bool)
        for n in range(2, max(GRAMS) + 1):
            if len(piece) < n:
                break
            # a space may only begin or end a subword
            crossed = crossed[: len(piece) - n + 1] | (space[n - 2 : -1] if n > 2 else np.zeros(len(piece) - 1, dtype=bool))
            gram = gram[: len(piece) - n + 1] * np.uint32(0x01000193) + code[n - 1 :]
            if n in GRAMS:
                hashed = (gram * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(20)
                total += np.bincount(hashed[:starts][~crossed[:starts]], minlength=BUCKETS)
    return total


@dataclass
class LanguageModel:
    """Languages, the product of embeddings and layer, bias, temperature and rejection score."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of rows of averaged subwords."""
        return _softmax((x @ self.weights + self.bias) / self.temperature)

    def predict(self, texts: list[bytes | None]) -> list[dict]:
        """Language, score and rejection of each text."""
        found = []
        for raw in texts:
            if not self.languages or not has_letter(raw):
                found.append({"lang": "und", "score": 0.0, "rejected": True})
                continue
            counts = subwords(raw)
            p = self.probabilities((counts / max(1, counts.sum()))[None])[0]
            best = int(np.argmax(p))
            score = min(1.0, float(p[best]))
            found.append({"lang": self.languages[best], "score": score, "rejected": score < self.reject_below})
        return found


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, names: list[str], epochs: int = 40, batch: int = 32, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Train on rows of averaged subwords (sums 1) and their languages; every fifth row calibrates."""
    languages = sorted(set(names))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    y = np.array([languages.index(v) for v in names])
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < len(languages) or not held.any():
        held[:] = False
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    train = np.flatnonzero(~held)
    scale = np.sqrt(BUCKETS / 8)  # averages over many buckets are small
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(train)
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            xs = x[rows] * scale
            hidden = xs @ embed
            error = _softmax(hidden @ layer + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = error @ layer.T
            layer -= step * hidden.T @ error
            bias -= step * error.sum(0)
            embed -= step * xs.T @ back
    model = LanguageModel(languages, scale * (embed @ layer), bias)
    check = np.flatnonzero(held) if held.any() else train
    z = x[check] @ model.weights + bias
    losses = []
    for t in np.geomspace(0.05, 20, 60):
        p = _softmax(z / t)[np.arange(len(check)), y[check]]
        losses.append((float(-np.log(np.maximum(p, 1e-12)).mean()), float(t)))
    model.temperature = min(losses)[1]
    p = model.probabilities(x[check])
    right = np.sort(p.max(1)[p.argmax(1) == y[check]])
    model.reject_below = float(right[int(REJECT * len(right))]) if len(right) else 0.0
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Fit on about ``train_docs`` documents that are not held out, spread over the languages, picked by a hash of id and text; copies count once."""
    known = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")
    ).where(F.col("lang").isNotNull() & F.col("id").isNotNull() & (remainder("id", 3) != 1))
    frequent = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(TRAIN_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in frequent.collect()}
    if not counts:
        return fit(np.zeros((0, BUCKETS)), [])
    each = max(TRAIN_LEAST, train_docs // len(counts))
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, each / n))])
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_003)) / 1_000_003.0
    sample = known.where(place < share[F.col("lang")])  # null, so false, for a language that is not learned
    # copies of a row are taken once, so that the sample is bounded whatever is repeated
    sample = sample.groupBy("id", "lang", F.xxhash64("text").alias("t")).agg(F.first("text").alias("text"))

    def make():
        def run(texts):
            return [{"x": subwords(t).astype("<f4").tobytes() if has_letter(t) else None} for t in texts]

        return run

    rows = map_text(sample, "text", make, _COUNTS, "f", ["id", "lang"], True).where("f.x IS NOT NULL").select("id", "lang", "f.x").collect()
    rows.sort(key=lambda r: (str(r["id"]), r["lang"]))
    x = np.array([np.frombuffer(r["x"], dtype="<f4") for r in rows], dtype=np.float32).reshape(len(rows), BUCKETS)
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    return fit(x, [r["lang"] for r in rows])


def annotate(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language", carry: list[str] | None = None) -> DataFrame:
    """Documents with a struct column: language, score, and whether the score is too low to be relied on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, text_col, lambda: shared.value.predict, _RESULT, out, carry, binary=True)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return annotate(docs, train(docs), carry=["doc_id"]).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.rejected").alias("rejected"),
    )
