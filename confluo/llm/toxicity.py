"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic texts and unlabelled texts train linear classifiers in numpy.
With the class prior p, the risk is p * R+(positives) + max(0, R-(unlabelled) -
p * R-(positives)): the second part estimates the risk on the negatives and is
kept from falling below zero, where a classifier would only be memorising.

A text's features are the distinct words it holds, as 64-bit hashes.  Training
reads a bounded sample of labelled rows (``most_positive``, ``most_unlabelled``,
documented parameters); the class prior is counted over all labelled rows, and
every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType

from confluo.llm.common import folding, separators_word, text_slices, word_hashes

#: The key of the bias among the weights: no word hash is looked up by it.
BIAS = None
#: What says that nothing was learned: every text scores next to 0.
NOTHING = {BIAS: -30.0}


def _distinct_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(texts, text numbers, word hashes)`` for runs of texts: each text's
    distinct words, by text and hash."""
    separator, folded = separators_word(), folding()
    for _, data, offsets in text_slices(texts, 4 << 20):
        hashes, ends = word_hashes(data, offsets, separator, folded)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(ends))
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        yield len(offsets) - 1, text[new], hashes[new]


@arrow_udf(ArrayType(LongType()))
def distinct_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The hashes of a text's distinct words."""
    for batch in batches:
        parts = []
        for n, text, hashes in _distinct_words(batch):
            offsets = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64))))
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))


def train(words: list[np.ndarray], positive: np.ndarray, prior: float, n_words: int, steps: int = 300,
          rate: float = 0.05, decay: float = 2e-4, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier: Adam on the non-negative risk with
    the logistic loss.  ``words``: the word numbers of each text."""
    lengths = np.array([len(w) for w in words])
    flat = np.concatenate([*words, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    pos, unl = positive, ~positive
    n_pos, n_unl = max(1, pos.sum()), max(1, unl.sum())
    w = np.zeros(n_words + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(owner, w[flat], len(words)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        soft = np.logaddexp(0, z)  # the loss of calling a text clean
        negative = soft[unl].sum() / n_unl - prior * soft[pos].sum() / n_pos
        g = np.zeros(len(words))
        if negative >= -beta:
            g[pos] = prior * (s[pos] - 1) / n_pos - prior * s[pos] / n_pos
            g[unl] = s[unl] / n_unl
        else:  # step back from where the negatives' risk fell below zero
            g[pos] = prior * s[pos] / n_pos
            g[unl] = -s[unl] / n_unl
        grad = np.append(np.bincount(flat, g[owner], n_words), g.sum())
        grad[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def telling_words(flat: np.ndarray, owner: np.ndarray, positive: np.ndarray, least_z: float) -> np.ndarray:
    """The words whose share of texts differs between the confirmed toxic and
    the unlabelled ones by at least ``least_z`` standard errors.  ``flat``: the
    texts' distinct words, ``owner``: the text of each."""
    n_unl, n_pos = max(1, int((~positive).sum())), max(1, int(positive.sum()))
    words, number = np.unique(flat, return_inverse=True)
    toxic = positive[owner]
    p, u = (np.bincount(number[k], minlength=len(words)).astype(float) for k in (toxic, ~toxic))
    both = (u + p + 1) / (n_unl + n_pos + 2)
    z = (p / n_pos - u / n_unl) / np.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_unl))
    return words[np.abs(z) >= least_z]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", prior: float | None = None, most_positive: int = 3000, most_unlabelled: int = 18000,
        models: int = 3, least_z: float = 4.0, plain_prior: float = 0.1) -> dict[int | None, float]:
    """Word weights by word hash (:data:`BIAS`: the bias), the mean of up to
    ``models`` classifiers.

    ``labels`` must hold the rows to learn from only.  A row labelled several
    times counts as toxic if any label says so; null labels and ids are left
    out, and labels of ids that ``docs`` lacks teach nothing.  The samples,
    chosen by a hash of the id, are about ``most_positive`` confirmed toxic
    texts and ``most_unlabelled`` texts whose label is not looked at: of the
    labelled rows, or, where all labels are positive, of ``docs``.  Each
    classifier sees all the positives and its share of the rest, and uses the
    words that :func:`telling_words` keeps.

    ``prior``: the share of toxic texts among the unlabelled; by default that
    of positive labels, and ``plain_prior`` where all labels are positive.
    Without a positive label, or without a text for one, or without any text
    that is not confirmed, or where no word tells the two apart, there is
    nothing to learn: the result is :data:`NOTHING` and every text scores next
    to 0.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).dropna() \
        .groupBy("id").agg(F.max("y").alias("y"))
    n = marked.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("p")).first()
    if not n.p:
        return dict(NOTHING)
    plain = n.p == n.n  # positive labels only
    if prior is None:
        prior = plain_prior if plain else n.p / n.n
    pick = lambda bound, total, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) < int(
        (1 << 30) * min(1.0, bound / max(1, total)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    chosen = marked.where("y = 1").where(pick(most_positive, n.p, "toxicity")).select("id", F.lit(True).alias("positive"))
    rest = (texts.select("id").distinct() if plain else marked).where(
        pick(most_unlabelled, docs.count() if plain else n.n, "unlabelled")).select("id", F.lit(False).alias("positive"))
    chosen = chosen.unionByName(rest)  # at most both bounds, give or take the hash
    which = F.when(F.col("positive"), F.sequence(F.lit(0), F.lit(models - 1))).otherwise(
        F.array(F.pmod(F.xxhash64("id", F.lit("model")), F.lit(models)).cast("int")))
    # texts become word hashes where they are read: no task gathers whole texts
    rows = texts.join(F.broadcast(chosen), "id").select("positive", distinct_words(F.col("text")).alias("words"),
                                                        which.alias("models"))
    rows = rows.select("positive", "words", F.explode("models").alias("model"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        positive = pdf["positive"].to_numpy(bool)
        if positive.all() or not positive.any():
            return pd.DataFrame({"word": [], "weight": []})
        owner = np.repeat(np.arange(len(pdf)), pdf["words"].map(len))
        flat = np.concatenate(pdf["words"].to_list()).astype(np.int64)
        known = telling_words(flat, owner, positive, least_z)
        if not len(known):  # the prior alone says nothing of a text
            return pd.DataFrame({"word": [], "weight": []})
        at = np.searchsorted(known, flat)
        kept = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == flat))
        ids = np.split(at[kept], np.searchsorted(owner[kept], np.arange(1, len(pdf))))
        w, bias = train(ids, positive, prior, len(known))
        return pd.DataFrame({"word": pd.array([*known, None], "Int64"), "weight": [*w, bias]})

    learned = rows.groupBy("model").applyInPandas(learn, "word long, weight double")
    sums = {r.word: (r.total, r.n) for r in learned.groupBy("word").agg(F.sum("weight").alias("total"), F.count("*").alias("n")).collect()}
    if BIAS not in sums:
        return dict(NOTHING)
    taught = sums[BIAS][1]
    return {word: total / taught for word, (total, _) in sums.items()}


def score(weights: dict[int | None, float], text: Column) -> Column:
    """The probability that a text is toxic; an empty or null text gets the
    bias alone, the classifier's share for a text without a known word."""
    bias = weights.get(BIAS, NOTHING[BIAS])
    known = np.array(sorted(w for w in weights if w is not BIAS), np.int64)
    values = np.array([weights[w] for w in known.tolist()], np.float64)

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [np.zeros(0)]
            for n, text, hashes in _distinct_words(batch):
                words = hashes.view(np.int64)
                at = np.searchsorted(known, words)
                hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == words) if len(known) else np.zeros(0, int)
                # a text's words are summed in the order of their hashes, wherever it stands
                out.append(bias + np.bincount(text[hit], values[at[hit]], n))
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(out), -30, 30))), pa.float64())

    return run(text)
