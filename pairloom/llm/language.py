"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For each bit, a logistic classifier over hashed byte n-grams (two
and three bytes of the lower-cased text, with each stretch of non-letters as one space) predicts whether
the text's language has it. A text gets the language whose codeword has the least loss, where a bit's
logistic loss is weighted by how often that bit was right on training rows of that language.

The classifiers are fitted on at most FIT_ROWS labelled rows, as many of each language (those of least
hash of doc_id and text, of the FIT_ROWS commonest languages); whole texts of all documents are scored. Null texts and those without a letter are 'und'
with score 0, as is everything if no labelled row is there. Repeated rows are scored alike. Empty table:
no rows. Only doc_id and text are read for a prediction; nulls in lang are left out of training. A doc_id
that repeats brings all its rows to the fit, within its bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, crc_mod, small_batches, table, thinned

FIT_ROWS = 3000
BUCKETS = 1 << 13
EXHAUSTIVE = 6  # up to so many languages, all two-way splits are bits
STEPS, RATE, DECAY = 150, 4.0, 1e-4
AMBIGUOUS = 0.2  # a smaller lead of the best language's score is flagged
UND = "und"


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +-1: all splits of few languages, else the most separated of some random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        splits = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, float).T
    rng, best, far = np.random.default_rng(seed), None, -1.0
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        same = code @ code.T
        np.fill_diagonal(same, -bits)
        least = (bits - same.max()) / 2
        if least > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, least
    return best


def gram_counts(texts) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams of an Arrow array of texts, a row each, and which texts have a letter."""
    import pyarrow as pa
    import pyarrow.compute as pc

    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"\PL+", " ")
    out = np.zeros((len(clean), BUCKETS), np.float32)
    letters = pc.match_substring_regex(clean, r"\pL").to_numpy(zero_copy_only=False)
    for k, t in enumerate(clean.to_pylist()):
        b = np.frombuffer(f" {t.strip()} ".encode(), np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(263) + b[2:]
        codes = np.concatenate([two * np.uint32(2654435761), three * np.uint32(2246822519)]) >> np.uint32(32 - 13)
        out[k] = np.bincount(codes, minlength=BUCKETS)
    return out, letters


def normal(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x


class Codes:
    """The fitted classifiers."""

    def __init__(self, names: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.names, self.code, self.weights, self.bias, self.trust = names, code, weights, bias, trust

    def bits(self, counts: np.ndarray) -> np.ndarray:
        return normal(counts) @ self.weights + self.bias

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Chances of the languages, a row for each text."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        worth = -(loss * self.trust[None]).sum(2)
        p = np.exp(worth - worth.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit_codes(names: list[str], x: np.ndarray, which: np.ndarray) -> Codes:
    """Logistic regression for each bit on rows of normal(), by full-batch gradient steps with momentum."""
    code = codewords(len(names))
    y = code[which].astype(np.float32)
    share = np.bincount(which, minlength=len(names)).astype(float)
    row = (1 / share[which] / len(names))[:, None].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS if len(names) > 1 else 0):
        g = -y * row / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        vw = 0.9 * vw - RATE * (x.T @ g + DECAY * w)
        vb = 0.9 * vb - RATE * g.sum(0)
        w, b = w + vw, b + vb
    right = ((x @ w + b) * y > 0).astype(float)
    trust = np.stack([right[which == k].mean(0) for k in range(len(names))])
    return Codes(names, code, w, b, trust / np.maximum(trust.mean(1, keepdims=True), 1e-9))


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Codes | None:
    """docs: doc_id, text, lang, already without held-out rows."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    some, each = thinned(known, "lang", rows, F.col("doc_id"))
    if not each:
        return None
    some = bounded(some, "lang", each).select("lang", "text")

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                x, ok = gram_counts(part.column("text"))
                packed = [np.concatenate([nz.astype("<u4"), r[nz].astype("<u4")]).tobytes() for r in x for nz in [np.flatnonzero(r)]]
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(ok), pa.array(packed, pa.binary())], names=["lang", "ok", "x"])

    got = some.mapInArrow(features, "lang string, ok boolean, x binary").where("ok").toArrow()
    names = sorted(set(got["lang"].to_pylist()))
    if not names:
        return None
    x = np.zeros((got.num_rows, BUCKETS), np.float32)  # the one large table on the driver: FIT_ROWS times BUCKETS numbers
    for k, raw in enumerate(got["x"]):
        at, n = np.frombuffer(raw.as_buffer(), "<u4").reshape(2, -1)
        own = np.sqrt(n)
        x[k, at] = own / max(float(np.linalg.norm(own)), 1e-9)
    return fit_codes(names, x, np.searchsorted(names, got["lang"].to_pylist()))


def predict(docs: DataFrame, model: Codes | None, names_: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs' columns, and by names_: the language, its score, and whether it leads by little."""
    small_batches(docs.sparkSession)

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            names, scores, close = [], [], []
            for k in range(0, batch.num_rows, 64):
                x, ok = gram_counts(batch.column("text").slice(k, 64))
                if model is None:
                    names += [UND] * len(ok)
                    scores += [0.0] * len(ok)
                    close += [True] * len(ok)
                    continue
                p = model.decode(model.bits(x))
                best = p.argmax(1)
                top = p[np.arange(len(p)), best]
                second = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
                names += [model.names[b] if o else UND for b, o in zip(best, ok, strict=True)]
                scores += np.where(ok, top, 0.0).tolist()
                close += ((top - second < AMBIGUOUS) | ~ok).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())], names=[*batch.schema.names, *names_])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    more = [StructField(n, t) for n, t in zip(names_, (StringType(), DoubleType(), BooleanType()), strict=True)]
    return docs.mapInArrow(judge, StructType([*docs.schema.fields, *more]))


def known(docs: DataFrame, model: Codes | None, least: float = 0.5) -> DataFrame:
    """docs in a learnt language, with a score of at least least."""
    names = tuple(f"{w} of {''.join(docs.columns)}" for w in ("language", "score", "doubt"))  # no columns of docs
    return predict(docs, model, names).where((F.col(f"`{names[0]}`") != UND) & (F.col(f"`{names[1]}`") >= least)).select(*docs.columns)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    model = fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
