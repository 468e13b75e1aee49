"""Quality classifier: supervised subword embeddings with a softmax over two classes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.labelled import SAMPLE_ROWS, SAMPLE_TEXT_BYTES, draw, held_out, short_enough, texts_of
from foliomill.llm.rows import map_texts, unpacked
from foliomill.llm.subword import SCORED_BYTES, Features, LinearText, give_back, softmax, train_embeddings

FOLDS, HELD_OUT = 5, 0
FEATURES = Features(bits=17, shortest=1, longest=3, repeats=True)
THRESHOLD = 0.3

RESULT = T.StructType([T.StructField("score", T.DoubleType())])


@dataclass
class QualityModel:
    model: LinearText | None
    only: float = 0.5

    def predict(self, texts: pa.Array) -> dict[str, list]:
        if self.model is None:
            return {"score": [self.only] * len(texts)}
        return {"score": softmax(self.model.scores(texts))[:, 1].tolist()}


def fit(texts: list[str], labels: list[int], features: Features = FEATURES) -> QualityModel:
    """Train on the given texts; with labels of one kind only, or none, the score is constant."""
    kinds = set(labels)
    if len(kinds) < 2:
        return QualityModel(None, float(kinds.pop()) if kinds else 0.5)
    return QualityModel(train_embeddings(features, texts, np.array(labels), 2, epochs=3))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_TEXT_BYTES) -> QualityModel:
    """Fit on at most ``rows`` texts of each label among the rows that are not held out.

    Labels other than 0 and 1, null keys and labels without a text of at most
    ``most_bytes`` take no part; a repeated id counts once, as good if any of
    its labels is; without both labels the score is constant.  Only doc_id and
    quality of ``labels`` are read.  Both labels are drawn alike; the softmax bias is then moved by the log odds
    of the labels among all labelled rows, so scores stand for the real mix.
    """
    known = labels.select("doc_id", "quality").where(~held_out(F.col("doc_id"), FOLDS, HELD_OUT) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good, bad = known.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).first()
    texts = short_enough(known, docs, most_bytes)
    wanted = {k: q for q in (0, 1) for k in draw(texts.where(F.col("quality") == q).select("doc_id"), rows)}
    found = texts_of(docs, wanted, most_bytes)
    drawn = [wanted[k] for k, _ in found]
    fitted = fit([t for _, t in found], drawn)
    give_back()
    if fitted.model is not None:
        fitted.model.bias = fitted.model.bias + np.array([0.0, np.log(good / bad) - np.log(sum(drawn) / (len(drawn) - sum(drawn)))])
    return fitted


def score_quality(docs: DataFrame, model: QualityModel, carry: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``score`` (0 to 1, higher: label 1 likelier), from the whole text.

    Null and empty texts get the score of a text without words; repeated rows
    get equal scores; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda: shared.value.predict, RESULT, carry=carry, limit=SCORED_BYTES)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows that are not held out and score all documents."""
    out = score_quality(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return unpacked(out, held_out(F.col("row.doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
