"""Language identification in two levels: family first, then the language inside it.

One linear support vector machine per pair of families and per pair of languages of
a family, on hashed counts of 1 to 3 byte runs of the whole lower-cased text.  Pairs
vote; ties go to the larger sum of margins.  Each machine is fitted by dual
coordinate descent in a task of its own, on a sample of labelled documents bounded
per language (``TRAIN_DOCS`` expected, by a hash of the row, all where there are
fewer).  Prediction is one pass over all documents without a shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0;
without any labelled row every document is ``und``; a null id is never held out;
equal texts get equal predictions; a language of no known family is a family alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, named
from .words import give_back, pieces, utf8

TRAIN_DOCS = 600      # bound of the sample, per language
SLICES, SLICE_WORDS = 2, 8   # short slices of each training text, so that short texts are learnt too
BITS, ORDERS = 12, 3
COST, EPOCHS = 1.0, 12
PIECE_DOCS = 256
UNKNOWN = "und"

# Families of languages by ISO 639 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi mr ne bn",
    "semitic": "ar he",
}

_TABLE = np.full(256, 32, np.uint8)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs.split()), f"only {lang}")


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents: first, end, unit-length vectors, and whether each has a letter."""
    data, offsets = utf8(column)
    size = 1 << BITS
    for a, b, _, _ in pieces(data, offsets):
        for i in range(a, b, PIECE_DOCS):
            j = min(b, i + PIECE_DOCS)
            raw, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            low = _TABLE[raw].astype(np.uint32)
            doc = np.repeat(np.arange(j - i), np.diff(at))
            counts, code = np.zeros((j - i) * size), np.zeros(len(low), np.uint32)
            for n in range(ORDERS):
                code = low if n == 0 else (code[:-1] << np.uint32(8)) | low[n:]
                inside = doc[: len(code)] == doc[n:] if n else slice(None)
                slot = (code + np.uint32(n + 1)) * np.uint32(2654435761) >> np.uint32(32 - BITS)
                counts += np.bincount(doc[: len(code)][inside] * size + slot[inside], minlength=len(counts))
            x = np.sqrt(counts.reshape(j - i, size)).astype(np.float32)
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            letter = np.bincount(doc, weights=_ASCII[raw], minlength=j - i) > 0
            for k in np.flatnonzero(~letter & (np.diff(at) > 0)):
                letter[k] = any(c.isalpha() for c in raw[at[k] : at[k + 1]].tobytes().decode("utf-8", "ignore"))
            yield i, j, x / np.maximum(norm, 1e-9), letter


def fit(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Weights and bias of a linear support vector machine; y is 1 or -1; classes weigh alike."""
    cost = np.where(y > 0, COST * len(y) / (2 * max(1, (y > 0).sum())), COST * len(y) / (2 * max(1, (y < 0).sum())))
    w, alpha, row = np.zeros(x.shape[1] + 1), np.zeros(len(y)), np.ones(x.shape[1] + 1)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            row[:-1] = x[i]  # only one row at a time is held as doubles
            new = min(max(alpha[i] - (y[i] * (row @ w) - 1) / (row @ row), 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * row
                alpha[i] = new
    return w


class _Rows:
    """Rows kept as their non-zero places and values; a row is asked for, one at a time, as a whole."""

    def __init__(self, width: int) -> None:
        self.row, self.places, self.values = np.zeros(width, np.float32), [], []

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.places), len(self.row)

    def add(self, rows: np.ndarray) -> None:
        for row in rows:
            at = np.flatnonzero(row)
            self.places.append(at.astype(np.uint16))  # 1 << BITS places at most
            self.values.append(row[at])

    def __getitem__(self, i: int) -> np.ndarray:
        self.row[:] = 0
        self.row[self.places[i]] = self.values[i]
        return self.row


def _fit_pair(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["side", "text"], ignore_index=True)
    rng = np.random.default_rng(len(rows))
    texts, side = rows["text"].tolist(), rows["side"].tolist()
    for text, s in list(zip(texts, side)):
        words = text.split()
        for _ in range(SLICES if len(words) > SLICE_WORDS else 0):
            k = int(rng.integers(0, len(words) - SLICE_WORDS))
            texts.append(" ".join(words[k : k + int(rng.integers(1, SLICE_WORDS + 1))]))
            side.append(s)
    x = _Rows(1 << BITS)
    for _, _, v, _ in features(pa.array(texts)):
        x.add(v)
    w = fit(x, np.where(np.array(side), 1.0, -1.0), 7)
    x = v = texts = None
    give_back()
    return pd.DataFrame({"pair": [rows["pair"][0]], "weights": [w.astype(np.float64).tobytes()]})


class Model:
    """Languages by family, and the pairs of names with their weights."""

    def __init__(self, langs: list[str], pairs: list[tuple[str, str]], weights: np.ndarray) -> None:
        self.langs, self.pairs, self.weights = langs, pairs, weights
        self.families: dict[str, list[str]] = {}
        for lang in langs:
            self.families.setdefault(family(lang), []).append(lang)

    def vote(self, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner (index into names) of each row, and its mean chance against the others."""
        n = len(margins)
        if len(names) == 1:
            return np.zeros(n, np.int64), np.ones(n)
        votes, total = np.zeros((n, len(names))), np.zeros((n, len(names)))
        for p, (a, b) in enumerate(self.pairs):
            if a in names and b in names:
                m = margins[:, p]
                chance = 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
                for who, c in ((names.index(a), chance), (names.index(b), 1 - chance)):
                    votes[:, who] += (c > 0.5) + 1e-3 * c
                    total[:, who] += c
        best = votes.argmax(1)
        return best, total[np.arange(n), best] / (len(names) - 1)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.weights[:-1] + self.weights[-1] if len(self.pairs) else np.zeros((len(x), 0))
        names = sorted(self.families)
        fam, score = self.vote([f"family {f}" for f in names], margins)
        out, chance = np.empty(len(x), object), score.copy()
        for k, f in enumerate(names):
            rows = np.flatnonzero(fam == k)
            if len(rows):
                pick, c = self.vote(self.families[f], margins[rows])
                out[rows] = [self.families[f][i] for i in pick]
                chance[rows] *= c
        return out.tolist(), chance

    def label(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Predicted language and score of each text."""
        pred, score = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
        if self.langs:
            for i, j, x, letter in features(column):
                names, chance = self.predict(x)
                pred[i:j] = np.where(letter, np.array(names, object), UNKNOWN)
                score[i:j] = np.where(letter, chance, 0.0)
            x = names = chance = letter = None
            give_back()
        return pred, score


def train(docs: DataFrame, learn=None, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on rows of ``docs`` (text, lang) for which the condition ``learn`` holds."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if learn is not None:
        known = known.where(learn)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    langs = sorted(counts)
    families = {lang: family(lang) for lang in langs}
    pairs = [(f"family {a}", f"family {b}") for a, b in combinations(sorted(set(families.values())), 2)]
    pairs += [(a, b) for a, b in combinations(langs, 2) if families[a] == families[b]]
    if not pairs:
        return Model(langs, [], np.zeros((1, 0)))
    spark = docs.sparkSession
    plan = [(lang, p, side) for lang in langs for p, pair in enumerate(pairs) for side, name in enumerate(pair) if name in (lang, f"family {families[lang]}")]
    plan = [(lang, p, side == 0, min(1.0, train_docs / counts[lang])) for lang, p, side in plan]
    places = F.broadcast(spark.createDataFrame(plan, "lang string, pair int, side boolean, share double"))  # one row per language and pair
    spot = F.pmod(F.xxhash64("text", "lang", *([] if "doc_id" not in docs.columns else ["doc_id"])), F.lit(1_000_000)) / F.lit(1e6)
    sample = known.select("lang", "text", spot.alias("spot")).join(places, "lang").where(F.col("spot") < F.col("share"))
    fitted = sample.select("pair", "side", "text").groupBy("pair").applyInPandas(_fit_pair, "pair int, weights binary").toPandas().sort_values("pair")
    weights = np.zeros(((1 << BITS) + 1, len(pairs)))
    for pair, raw in zip(fitted["pair"], fitted["weights"]):
        weights[:, pair] = np.frombuffer(raw)
    return Model(langs, pairs, weights)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced.  Only texts go to Python."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(text: pa.Array) -> pa.Array:
        pred, score = shared.value.label(text)
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score)], ["lang_pred", "score"])

    told = F.arrow_udf(label, "lang_pred string, score double")("text")
    return docs.select(*named(kept), told.alias("_llm_label")).select(*named(kept), "_llm_label.lang_pred", "_llm_label.score")


def held_out(remainder: int = 2, parts: int = 4):
    return crc_of_id() % parts == remainder


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, learnt from the documents that are not held out."""
    model = train(docs.select("doc_id", "text", "lang"), ~held_out())
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def known_language(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told, learnt from all labelled ones; their columns as they are."""
    model = train(docs.select("doc_id", "text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.label(text)[0] != UNKNOWN)

    return docs.where(F.arrow_udf(known, "boolean")("text"))
