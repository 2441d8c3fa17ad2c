"""Language identification by mixture inference over character n-grams.

Every language is a distribution over hashed letter trigrams. A document is a mixture of languages: its shares
are estimated by expectation-maximisation, and a language joins the set only while the penalised likelihood gains.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import trim

UNDETERMINED = "und"


@dataclass(frozen=True)
class Learning:
    """sample bounds the fit: that many labelled documents of each language are expected, chosen by a hash of the id."""

    sample: int = 3000
    buckets: int = 1 << 17
    smoothing: float = 0.05
    #: Trigrams overlap: three of them count as one observation.
    overlap: float = 3.0
    penalty: float = 2.0
    rounds: int = 30
    seed: int = 7


@dataclass(frozen=True)
class Model:
    languages: list[str]
    logp: np.ndarray  # language x bucket
    known: np.ndarray  # buckets met in learning
    prior: np.ndarray
    how: Learning


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


#: Trigrams that are hashed at once.
CHUNK = 1 << 18


def trigrams(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how often) of the distinct trigrams of the whole text's lower-cased letters; each run of anything else counts as one space."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.where(letter, cp, np.uint32(32))
    a = np.concatenate([np.array([32], np.uint32), a[np.concatenate([[True], letter[1:] | letter[:-1]])], np.array([32], np.uint32)])
    if len(a) <= CHUNK:
        return np.unique(_hashed(a, buckets), return_counts=True)
    counts = np.zeros(buckets, np.int64)
    for s in range(0, len(a) - 2, CHUNK):
        counts += np.bincount(_hashed(a[s : s + CHUNK + 2], buckets), minlength=buckets)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _hashed(a: np.ndarray, buckets: int) -> np.ndarray:
    a = a.astype(np.uint64)
    mixed = a[:-2] * np.uint64(0x9E3779B185EBCA87) ^ a[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ a[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, how: Learning) -> Model:
    """The model of labelled rows; rows without text or language teach nothing. Languages are few: one row each is collected."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    languages = sorted(sizes)
    counts = np.zeros((len(languages), how.buckets), np.float64)
    if languages:
        share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, how.sample / sizes[k]))])
        drawn = F.pmod(F.xxhash64(id_col, F.lit(how.seed)), F.lit(1 << 30)) < share[F.col(lang_col)] * (1 << 30)
        buckets = how.buckets

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for lang, texts in b.groupby("lang")["t"]:
                    n = np.zeros(buckets, np.int64)
                    for t in texts:
                        at, times = trigrams(t, buckets)
                        n[at] += times
                    at = np.flatnonzero(n)
                    yield pd.DataFrame({"lang": lang, "k": at, "n": n[at]})

        grams = rows.filter(drawn).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).mapInPandas(count, "lang string, k long, n long")
        table = grams.groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()  # at most languages x buckets rows
        counts[table["lang"].map(languages.index).to_numpy(int), table["k"].to_numpy(int)] = table["n"]
    met = counts.sum(axis=0) > 0
    total = counts.sum(axis=1, keepdims=True) + how.smoothing * max(1, int(met.sum()) + 1)
    logp = np.log((counts + how.smoothing) / total).astype(np.float32)
    prior = np.log(np.array([sizes[k] for k in languages], float) / max(1, sum(sizes.values())))
    return Model(languages, logp, met, prior, how)


def _mixture(g: np.ndarray, times: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Shares of the rows of g (log-likelihoods, language x distinct trigram) by EM, and the log-likelihood reached."""
    top, n = g.max(axis=0), times.sum()
    p, share = np.exp(g - top), np.full(len(g), 1 / len(g))
    for _ in range(rounds):
        share = share * ((p / (share @ p)) @ times) / n
    return share, float((np.log(np.maximum(share @ p, 1e-300)) + top) @ times)


def infer(model: Model, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
    """(language, score, shares). The score is the share times the language's posterior times the part of trigrams known."""
    grams, times = trigrams(text, model.how.buckets) if text else (np.empty(0, np.int64),) * 2
    if not len(grams) or not model.languages:
        return UNDETERMINED, 0.0, []
    how, g, n = model.how, model.logp[:, grams].astype(np.float64), int(times.sum())
    alone = g @ times / how.overlap + model.prior
    chosen, share = [int(alone.argmax())], np.ones(1)
    best = float(g[chosen[0]] @ times)
    while len(chosen) < len(model.languages):
        now = np.logaddexp.reduce(g[chosen] + np.log(np.maximum(share, 1e-300))[:, None], axis=0)
        gain = np.exp(np.minimum(g - now, 50)) @ times / n  # over 1: a little of that language raises the likelihood
        gain[chosen] = 0
        j = int(gain.argmax())
        if gain[j] <= 1 + 1e-6:
            break
        new_share, reached = _mixture(g[[*chosen, j]], times, how.rounds)
        if (reached - best) / how.overlap <= how.penalty * np.log(n + 1):
            break
        chosen, share, best = [*chosen, j], new_share, reached
    top = int(share.argmax())
    posterior = 1 / np.exp(np.minimum(alone - alone.max(), 0)).sum()
    score = float(share[top] * posterior * (model.known[grams] @ times) / n)
    order = np.argsort(-share)
    return model.languages[chosen[top]], min(max(score, 0.0), 1.0), [(model.languages[chosen[i]], float(share[i])) for i in order]


def identify(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", how: Learning | None = None) -> DataFrame:
    """docs with lang_pred, score and languages (structs of lang and share, the largest first).

    learn_from says which rows teach; predictions see the text alone. Null, empty and letterless texts are
    `und` with score 0, as are all if nothing could be learned. Columns of docs by those names are replaced. Repeated
    rows teach and are named as often as they come; an empty table gives an empty one.
    """
    model = fit(docs.filter(F.coalesce(learn_from, F.lit(True))), id_col, text_col, lang_col, how or Learning())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred string, score double, languages array<struct<lang string, share double>>>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = [infer(shared.value, t) for t in texts]
        trim()
        return pd.DataFrame({"lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "languages": [[{"lang": k, "share": s} for k, s in x[2]] for x in out]})

    named = docs.drop("lang_pred", "score", "languages", "__language").withColumn("__language", predict(F.col(text_col)))
    return named.select("*", "__language.*").drop("__language")


def remainder(id_col: str, n: int) -> Column:
    """CRC-32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string")) % n
