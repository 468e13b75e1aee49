"""Toxicity: non-negative positive-unlabelled learning over hashed subword features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.labelled import draw, held_out, short_enough, texts_of
from foliomill.llm.rows import map_texts, unpacked
from foliomill.llm.subword import SCORED_BYTES, Features, LinearText, give_back, pu_cut, sigmoid, train_nnpu

FOLDS, HELD_OUT = 5, 0
FEATURES = Features(bits=18, shortest=3, longest=4, lower=True)
POSITIVE_ROWS, UNLABELLED_ROWS = 3000, 9000
THRESHOLD = 0.5
#: Longest text, in bytes, that is drawn for fitting: about what one scored piece of a text holds.
SAMPLE_TEXT_BYTES = 4096

RESULT = T.StructType([T.StructField("score", T.DoubleType())])


@dataclass
class ToxicityModel:
    model: LinearText | None
    cut: float

    def predict(self, texts: pa.Array) -> dict[str, list]:
        if self.model is None:
            return {"score": [0.0] * len(texts)}
        return {"score": sigmoid(self.model.scores(texts)[:, 0] - self.cut).tolist()}


def fit(positive: list[str], unlabelled: list[str], prior: float, features: Features = FEATURES) -> ToxicityModel:
    """Train on three quarters of both samples; the rest places the score of one half.

    No negative label is used: the cut comes from held-out positives,
    unlabelled texts and the prior.  Without positives every score is 0.
    """
    if not positive or not unlabelled:
        return ToxicityModel(None, 0.0)
    prior = min(max(prior, 1e-4), 0.9)
    apart = lambda xs: ([x for i, x in enumerate(xs) if i % 4], xs[::4])
    (p, p_out), (u, u_out) = apart(positive), apart(unlabelled)
    model = train_nnpu(features, p or p_out, u or u_out, prior)
    score = lambda xs: model.scores(pa.array(xs, pa.string()))[:, 0]
    return ToxicityModel(model, pu_cut(score(p_out), score(u_out), prior))


def train(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE_ROWS, unlabelled: int = UNLABELLED_ROWS, most_bytes: int = SAMPLE_TEXT_BYTES) -> ToxicityModel:
    """Fit on bounded samples of confirmed toxic rows and of all rows, none of them held out.

    The class prior is the share of toxic rows among the labelled ones that
    are not held out; all of those are counted.  Null keys, null labels and
    texts of over ``most_bytes`` take no part; a repeated id counts once, as
    toxic if any of its labels is; without toxic rows every score is 0.  Only
    doc_id and toxic of ``labels`` are read.
    """
    fits = ~held_out(F.col("doc_id"), FOLDS, HELD_OUT)
    known = labels.select("doc_id", "toxic").where(fits).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, toxic = known.agg(F.count("toxic"), F.sum("toxic")).first()
    if not toxic:
        return ToxicityModel(None, 0.0)
    confirmed = {k: 1 for k in draw(short_enough(known.where("toxic = 1"), docs, most_bytes).select("doc_id"), positive)}
    texts = docs.where(fits & (F.octet_length("text") <= most_bytes))
    anyone = {k: 0 for k in draw(texts.select("doc_id"), unlabelled)}
    found = texts_of(texts, anyone | confirmed, most_bytes)
    fitted = fit([t for k, t in found if k in confirmed], [t for k, t in found if k in anyone], toxic / total)
    give_back()
    return fitted


def score_toxicity(docs: DataFrame, model: ToxicityModel, carry: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``score`` (0 to 1) for every row of ``docs``, from its whole text.

    Null and empty texts get the score of a text without words; repeated rows
    get equal scores; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda: shared.value.predict, RESULT, carry=carry, limit=SCORED_BYTES)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows that are not held out and score all documents."""
    out = score_toxicity(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return unpacked(out, held_out(F.col("row.doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
