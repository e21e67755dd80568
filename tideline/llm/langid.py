"""Language identification by hierarchical discrimination.

A text's language family is predicted first (multinomial logistic regression);
one-versus-one linear support vector machines then separate the languages
within the family. Both see hashed counts of letter pairs and triples of the
whole text, square-rooted and scaled to length 1. Models are fitted by
``pyspark.ml`` on at most about ``rows_per_language`` texts of each language,
chosen by a hash of the text; prediction runs over whole texts in Arrow batches.

The score is the family's probability times the language's mean one-versus-one
probability within it.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
repeated rows get equal results; without any labelled text all are ``und``;
an empty table gives an empty result. A language outside ``FAMILIES`` is a
family of its own. Only text (and, in training, its label) is read.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import free_name, own_columns, stored

UNKNOWN = "und"
DIMENSIONS = 4096

#: fixed values: ISO 639-1 codes by language family
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz ky",
    "indic": "hi ur bn pa mr gu ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_STEP = 1 << 20


def _letters() -> np.ndarray:
    """1 for code points of the basic plane that are letters."""
    return np.array([chr(c).isalpha() for c in range(0x10000)], dtype=bool)


_IS_LETTER = _letters()


def features(text: str, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Hashed pair and triple counts, or None if the text has no letter."""
    out, any_letter = np.zeros(dimensions), False
    low = text.lower()
    for at in range(0, len(low), _STEP):  # long texts in steps, overlapping by two
        u = np.frombuffer((" " + low[max(0, at - 2):at + _STEP] + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        big = u > 0xFFFF
        letter = _IS_LETTER[np.where(big, 0, u)]
        if big.any():
            letter[big] = [chr(c).isalpha() for c in u[big]]
        any_letter = any_letter or bool(letter.any())
        u = np.where(letter, u, 32)
        u = u[np.concatenate([[True], (u[1:] != 32) | (u[:-1] != 32)])]
        pair = u[:-1] * 0x9E3779B1 + u[1:] * 0x85EBCA77
        triple = pair[:-1] + u[2:] * 0xC2B2AE3D + 0x27D4EB2F
        codes = np.concatenate([pair, triple])
        codes ^= codes >> 15
        out += np.bincount((codes * 0x2545F491 >> 13) % dimensions, minlength=dimensions)
    if not any_letter:
        return None
    out = np.sqrt(out)
    return out / np.linalg.norm(out)


@dataclass
class LanguageModel:
    dimensions: int = DIMENSIONS
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None  # [dimensions + 1, families]
    pairs: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    pair_weights: dict[str, np.ndarray] = field(default_factory=dict)  # [dimensions + 1, pairs]; > 0: the second

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text, self.dimensions) if text else None
        if x is None or not self.families:
            return UNKNOWN, 0.0
        p = np.ones(1)
        if len(self.families) > 1:
            z = x @ self.family_weights[:-1] + self.family_weights[-1]
            p = np.exp(z - z.max())
            p /= p.sum()
        k = int(p.argmax())
        name = self.families[k]
        langs = self.members[name]
        if len(langs) == 1:
            return langs[0], float(p[k])
        w = self.pair_weights[name]
        second = 1 / (1 + np.exp(-2 * np.clip(x @ w[:-1] + w[-1], -50, 50)))
        share, votes = np.zeros(len(langs)), np.zeros(len(langs))
        for (i, j), q in zip(self.pairs[name], second):
            share[i] += 1 - q
            share[j] += q
            votes[j if q > 0.5 else i] += 1
        best = max(range(len(langs)), key=lambda i: (votes[i], share[i], -i))
        return langs[best], float(p[k] * share[best] / (len(langs) - 1))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 1000,
          dimensions: int = DIMENSIONS, iterations: int = 30) -> LanguageModel:
    """Fit on the labelled rows of ``docs``: about ``rows_per_language`` different
    texts of each language, each once however many copies it has."""
    ship_package(docs.sparkSession)
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    found = {r[0]: r[1] for r in rows.select("lang", "h").distinct().groupBy("lang").count().collect()}
    model = LanguageModel(dimensions)
    if not found:
        return model
    part = F.create_map(*[x for k, n in sorted(found.items()) for x in (F.lit(k), F.lit(min(1.0, rows_per_language / n)))])

    @F.pandas_udf("array<double>")
    def vector(b: pd.Series) -> pd.Series:
        return pd.Series([features(t, dimensions) for t in b])

    rows = rows.filter(F.pmod("h", F.lit(1 << 20)) < part[F.col("lang")] * (1 << 20)).dropDuplicates(["lang", "h"])
    rows = stored(rows.select("lang", vector("t").alias("v")).filter("v is not null"), "language-sample")
    kept = sorted(r[0] for r in rows.select("lang").distinct().collect())
    for code in kept:
        model.members.setdefault(FAMILY_OF.get(code, code), []).append(code)
    model.families = sorted(model.members)
    number = {c: k for k, f in enumerate(model.families) for c in model.members[f]}
    v = array_to_vector("v").alias("features")
    if len(model.families) > 1:
        cls = F.create_map(*[x for c in kept for x in (F.lit(c), F.lit(float(number[c])))])
        fit = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=iterations, standardization=False).fit(
            rows.select(cls[F.col("lang")].alias("label"), v))
        model.family_weights = np.vstack([fit.coefficientMatrix.toArray().T, fit.interceptVector.toArray()])
    for name, langs in model.members.items():
        model.pairs[name] = list(combinations(range(len(langs)), 2))
        ws = []
        for i, j in model.pairs[name]:
            two = rows.filter(F.col("lang").isin(langs[i], langs[j])).select((F.col("lang") == langs[j]).cast("double").alias("label"), v)
            fit = LinearSVC(regParam=1e-4, maxIter=iterations, standardization=False).fit(two)
            ws.append(np.append(fit.coefficients.toArray(), fit.intercept))
        if ws:
            model.pair_weights[name] = np.stack(ws, axis=1)
    return model


def predicted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dimensions * (families + pairs) floats

    @F.pandas_udf("lang_pred string, score double")
    def run(b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in b], columns=["lang_pred", "score"])

    got = free_name(docs, "__p")
    out = docs.withColumn(got, run(F.col(text_col)))
    return out.select(*own_columns(docs), f"{got}.lang_pred", f"{got}.score")
