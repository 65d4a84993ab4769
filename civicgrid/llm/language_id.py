"""Language identification by hierarchical discrimination.

A linear model names the language family first; inside a family, linear support
vector machines for each pair of its languages vote. Features are the square
roots of the relative frequencies of hashed byte n-grams (1 to 4) of the whole
lower-cased text, letters only.

The models are fitted on a bounded sample: at most ``MAX_TRAIN`` labelled
documents, the same number for each language where there are so many, chosen by
a hash of id and text. A language outside ``FAMILIES`` joins the family with the
most similar mean, from ``KIN`` on, else it is a family of its own.

Of equal margins the family, and of equal votes the language, that comes first
by name wins. A null text, or one without any letter, is ``und`` with score 0; so is all when
no document is labelled. Repeated rows get repeated results; an empty table
gives no rows. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicgrid.llm.common import add_by_text, chunks

MAX_TRAIN = 4000
#: Texts handled at once inside a task.
ROWS = 256
BITS = 11
DIMENSIONS = 1 << BITS
UNDETERMINED = "und"
#: Cosine of two languages' mean features from which a language without a known family joins another's.
KIN = 0.9

#: Families of some languages by their ISO 639-1 codes.
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "is"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca"), "romance"),
    **dict.fromkeys(("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
}

LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def ngram_features(texts: list[str | None]) -> np.ndarray:
    """One row of ``DIMENSIONS`` for each text, of length 1 (0 for a text without letters)."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for at, to, encoded in chunks([None if t is None else t.lower() for t in texts]):
        codes = LETTERS[np.frombuffer(b"    ".join(encoded) + b"    ", np.uint8)].astype(np.uint32)
        doc = np.repeat(np.arange(len(encoded), dtype=np.int64) * DIMENSIONS, [len(x) + 4 for x in encoded])[: len(codes)]
        total, gram = np.zeros(len(encoded) * DIMENSIONS), np.zeros(len(codes), np.uint32)
        for n in range(1, 5):
            gram = gram[: len(codes) - n + 1] * np.uint32(257) + codes[n - 1 :]
            keep = (codes[: len(gram)] != 32) | (codes[n - 1 :] != 32)
            slot = ((gram * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519)) >> np.uint32(32 - BITS)
            total += np.bincount(doc[: len(gram)][keep] + slot[keep], minlength=len(total))
        counts = total.reshape(-1, DIMENSIONS)
        out[at:to] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Linear machines of squared hinge loss, a column for each column of ``y`` (+1 or -1): weights and biases.

    Each side of a machine weighs the same. Accelerated gradient steps on all rows.
    """
    centre = x.mean(axis=0)
    x = x - centre  # the only copy
    share = np.where(y > 0, 0.5 / np.maximum(1, (y > 0).sum(axis=0)), 0.5 / np.maximum(1, (y < 0).sum(axis=0)))
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    step = 1.0 / (2 * float(np.einsum('ij,ij->i', x, x).max(initial=0) + 1) + penalty)
    vw, vb, t = w, b, 1.0
    for _ in range(rounds):
        short = np.maximum(0, 1 - y * (x @ vw + vb))
        g = (-2 * share * y * short).astype(np.float32)
        nw, nb = vw - step * (x.T @ g + penalty * vw), vb - step * g.sum(axis=0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w.astype(np.float32), (b - centre @ w).astype(np.float32)


def families_of(x: np.ndarray, langs: np.ndarray, languages: list[str], known: dict[str, str]) -> dict[str, str]:
    """A family for each language: the known one, or that of the most similar language before it in the list or known."""
    means = {lang: x[langs == lang].mean(axis=0) for lang in languages}
    means = {lang: m / max(float(np.linalg.norm(m)), 1e-12) for lang, m in means.items()}
    of = {lang: known[lang] for lang in languages if lang in known}
    for lang in languages:
        if lang not in of:
            alike = max(((float(means[lang] @ means[other]), of[other]) for other in of), default=(0.0, ""))
            of[lang] = alike[1] if alike[0] >= KIN else f"only {lang}"
    return of


class Hierarchy:
    """The fitted models: one machine for each family against the rest, and one for each pair inside a family."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str] | None = None):
        known = FAMILIES if families is None else families
        langs = np.array(langs, object)
        self.languages = sorted(set(langs))
        of = families_of(x, langs, self.languages, known)
        self.families = sorted(set(of.values()))
        self.members = [[lang for lang in self.languages if of[lang] == f] for f in self.families]
        target = np.array([of[lang] for lang in langs], object)
        self.top = fit_svm(x, np.stack([np.where(target == f, 1.0, -1.0) for f in self.families], axis=1).astype(np.float32)) if len(self.families) > 1 else None
        self.pairs = []
        for members in self.members:
            own = []
            for a, b in combinations(members, 2):
                rows = (langs == a) | (langs == b)
                own.append((a, b, *fit_svm(x[rows], np.where(langs[rows] == a, 1.0, -1.0)[:, None].astype(np.float32))))
            self.pairs.append(own)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each row. A score is the product of the logistic margins by which family and language won."""
        n = len(x)
        out, score = np.full(n, UNDETERMINED, object), np.zeros(n)
        if not self.languages:
            return out, score
        best, sure = np.zeros(n, int), np.ones(n)
        if self.top:
            margin = x @ self.top[0] + self.top[1]
            best = margin.argmax(axis=1)
            ordered = np.sort(margin, axis=1)
            sure = 1 / (1 + np.exp(-4 * (ordered[:, -1] - ordered[:, -2])))
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(best == f)
            if not len(rows):
                continue
            votes, least = np.zeros((len(rows), len(members))), np.full((len(rows), len(members)), np.inf)
            for a, b, w, bias in self.pairs[f]:
                m = (x[rows] @ w + bias)[:, 0]
                for lang, side in ((a, m), (b, -m)):
                    k = members.index(lang)
                    votes[:, k] += (side > 0) + np.tanh(side) / (4 * len(members))
                    least[:, k] = np.minimum(least[:, k], side)
            won = votes.argmax(axis=1)
            out[rows] = np.array(members, object)[won]
            score[rows] = sure[rows] / (1 + np.exp(-4 * least[np.arange(len(rows)), won]))
        return out, score


def training_rows(docs: DataFrame, usable: Column, limit: int = MAX_TRAIN) -> DataFrame:
    """At most ``limit`` labelled documents: of each language the first of a share, by a hash of their id and text."""
    labelled = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return labelled.select("text", "lang").limit(0)
    share = max(1, limit // len(counts))
    # a first cut by rate, three times the share, leaves little to be ranked
    rate = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, (3 * share + 100) / n))])
    turn = F.xxhash64("doc_id", "text", F.lit(11))
    drawn = labelled.withColumn("turn", turn).filter(F.pmod("turn", F.lit(1_000_003)) / F.lit(1_000_003.0) < rate[F.col("lang")])
    ranked = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("turn", "doc_id", "text")))
    return ranked.filter(F.col("place") <= share).orderBy("place", "lang").limit(limit).select("text", "lang")


def fit(docs: DataFrame, usable: Column, limit: int = MAX_TRAIN) -> Hierarchy:
    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[at : at + ROWS] for whole in batches for at in range(0, len(whole), ROWS)):
            rows = [i for i, t in enumerate(batch["text"]) if has_letter(t)]
            x = ngram_features([batch["text"].iloc[i] for i in rows]).astype(np.float16)
            yield pd.DataFrame({"lang": batch["lang"].iloc[rows].to_numpy(), "x": [v.tobytes() for v in x], "sample": 0})

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "x"])
        x = np.frombuffer(b"".join(rows["x"]), np.float16).reshape(len(rows), -1).astype(np.float32)
        return pd.DataFrame({"model": [pickle.dumps(Hierarchy(x, rows["lang"].to_list()))]})

    sample = training_rows(docs, usable, limit).mapInPandas(featured, "lang string, x binary, sample int")
    # one task for the bounded sample, so that the driver only gets the model
    fitted = sample.groupBy("sample").applyInPandas(train, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else Hierarchy(np.zeros((0, DIMENSIONS), np.float32), [])


def identify(docs: DataFrame, usable: Column, limit: int = MAX_TRAIN, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (doc_id), lang_pred and score; ``usable`` says which rows may teach."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang"), usable, limit))  # some hundred KB for each pair of languages

    def predict(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        lang, score = model.value.predict(ngram_features(texts))
        empty = np.array([not has_letter(t) for t in texts], bool)
        lang[empty], score[empty] = UNDETERMINED, 0.0
        return lang, score

    return add_by_text(docs, predict, "lang_pred string, score double", keep or ["doc_id"], ROWS)
