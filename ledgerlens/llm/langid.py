"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts the n-grams of every labelled text in one pass; each task
hands on one row of counts per language and bin, so the model is
``languages x 2^BITS`` numbers at any scale. The log-probability matrix is
broadcast, and batches of texts are scored by gathering its columns at the
texts' n-grams. The score of the winner is its posterior probability.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text if there is nothing to learn from; ties go to the first
language in alphabetical order; rows with a null language are not learned
from; repeated rows are learned and scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams

ORDERS = (1, 2, 3)
BITS = 15
SMOOTHING = 0.5
MAX_LANGUAGES = 256     # bounds the broadcast matrix; more are an error
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", orders=ORDERS, bits: int = BITS):
    """(languages, log-probabilities [language, bin], log-priors) from all rows with a language."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"),
                                                              F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, part in b.groupby("lang"):
                own = held.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                own[-1] += len(part)
                texts = [t.lower() for t in part["text"] if isinstance(t, str)]
                for segments in ngrams.chunks(texts, max(orders) - 1):
                    own[:-1] += np.bincount(ngrams.hashed(segments, orders, bits)[0], minlength=1 << bits)
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bin": at, "n": own[at]})

    if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the model would have no bound")
    found = (rows.mapInPandas(count, "lang string, bin long, n long")
             .groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas())  # languages x bins at most
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), (1 << bits) + 1))
    counts[found["lang"].map({l: i for i, l in enumerate(langs)}).to_numpy(int), found["bin"].to_numpy(int)] = found["n"]
    docs, grams = counts[:, -1], counts[:, :-1] + SMOOTHING
    logp = np.log(grams / grams.sum(axis=1, keepdims=True))
    return langs, logp.astype(np.float32), np.log(docs / max(1, docs.sum()))


def score_texts(texts: list[str], logp: np.ndarray, prior: np.ndarray, orders=ORDERS, bits: int = BITS) -> np.ndarray:
    """Log-likelihood plus prior of each text under each language."""
    out = np.tile(prior, (len(texts), 1))
    for segments in ngrams.chunks([t.lower() for t in texts], max(orders) - 1):
        bins, owner = ngrams.hashed(segments, orders, bits)
        which = np.fromiter((i for i, _, _ in segments), np.int64, len(segments))
        for lang in range(len(prior)):
            np.add.at(out[:, lang], which, np.bincount(owner, logp[lang][bins], len(segments)))
    return out


def predict(docs: DataFrame, model, text_col: str = "text") -> Column:
    """Column struct(lang_pred, score) for ``docs``."""
    langs, logp, prior = model
    shared = docs.sparkSession.sparkContext.broadcast((logp, prior))

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        own = [t if isinstance(t, str) else "" for t in texts]
        lang, score = np.full(len(own), UNKNOWN, object), np.zeros(len(own))
        if langs and own:
            logs = score_texts(own, *shared.value)
            best = logs.argmax(axis=1)
            post = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            known = np.fromiter((LETTER.search(t) is not None for t in own), bool, len(own))
            lang[known] = np.array(langs, object)[best[known]]
            score[known] = post[known]
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return guess(F.col(text_col))
