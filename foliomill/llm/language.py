"""Language ID: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is rejected for either of two reasons: the probability of its language
is low, or few of its words and n-grams were met in training, so that the
probability means nothing.  Both floors are quantiles for each language over
training texts that were scored by a model that had not seen them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.labelled import SAMPLE_TEXT_BYTES, held_out, ids_of, place, share_for, texts_of
from foliomill.llm.rows import map_texts, unpacked
from foliomill.llm.subword import SCORED_BYTES, Features, LinearText, give_back, left_out_shares, met_features, passages, softmax, temperature, train_embeddings
from foliomill.llm.text import plain

FOLDS, HELD_OUT = 4, 2
SAMPLE_ROWS = 500  # for each language
MOST_LANGUAGES = 200
FEATURES = Features(bits=20, shortest=1, longest=4, lower=True)
#: Words, and n-grams from this length on, tell whether a text is of a kind met in training.
MET_SHORTEST = 3
#: Shares of rightly named texts that the floor of the probability and that of the met features may cost.
REJECT_RATES = (0.002, 0.008)
#: Languages with fewer rightly named calibration texts share the floors of all.
FLOOR_TEXTS = 50
#: Parts that are left out in turn to set the floors of the probability and of the met features.
TRAINED_FOLDS, MET_FOLDS = 2, 5
#: Words of a text that a step trains on, texts of a step, steps of the model, and of one that leaves out a part.
PASSAGE_WORDS, BATCH, STEPS, FOLD_STEPS = 80, 32, 300, 200
#: Left-out texts that are scored at a time.
SCORED_TEXTS = 200
UNKNOWN = "und"

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


@dataclass
class LanguageModel:
    languages: list[str]
    model: LinearText | None  # one output for each language, and the share of features met in training
    heat: float
    floors: np.ndarray  # least probability and least share of met features of each language

    def predict(self, texts: pa.Array) -> dict[str, list]:
        """For each text the language, its probability, and whether that is too low to trust."""
        texts = plain(texts)
        lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        if self.model is None:
            return {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts), "rejected": [True] * len(texts)}
        out = self.model.scores(texts)
        chance, met = softmax(out[:, :-1] / self.heat), out[:, -1]
        best = chance.argmax(axis=1)
        score = np.where(lettered, chance[np.arange(len(best)), best], 0.0)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        low = ~lettered | (score < self.floors[best, 0]) | (met < self.floors[best, 1])
        return {"lang_pred": names, "score": score.tolist(), "rejected": low.tolist()}


def _fitted(features: Features, texts: list[str], y: np.ndarray, classes: int, steps: int) -> LinearText:
    return train_embeddings(features, passages(texts, PASSAGE_WORDS), y, classes, epochs=1, batch=BATCH, least_steps=steps)


def fit(texts: list[str], labels: list[str], features: Features = FEATURES) -> LanguageModel:
    """Train on all texts; models that leave out a part each set the temperature and the floors.

    A language's floors are the probability and the share of met features
    that all but ``REJECT_RATES`` of its rightly named texts reach.  Texts
    without a letter are always rejected.  Without training texts every text
    is ``und``; with one language its probability is 1 and only the share of
    met features rejects; with fewer texts than ``FLOOR_TEXTS`` in all there
    are no floors.
    """
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], None, 1.0, np.zeros((0, 2)))
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x in labels])
    model = _fitted(features, texts, y, len(languages), STEPS)
    # One table for both: a column of the model's that was met counts 1 in the last output, as do others that were met.
    met = np.zeros(1 << features.bits, bool)
    met[met_features(replace(features, shortest=MET_SHORTEST), texts)] = True
    model.add_output(met)
    if len(y) < FLOOR_TEXTS:
        return LanguageModel(languages, model, 1.0, np.zeros((len(languages), 2)))
    order = np.random.default_rng(2).permutation(len(y))
    out = np.empty((len(y), len(languages) + 1))
    for k in range(TRAINED_FOLDS):
        rows, rest = order[order % TRAINED_FOLDS != k], order[order % TRAINED_FOLDS == k]
        part = _fitted(features, [texts[i] for i in rows], y[rows], len(languages), FOLD_STEPS)
        for some in np.array_split(rest, -(-len(rest) // SCORED_TEXTS)):
            out[some, :-1] = part.scores(pa.array([texts[i] for i in some], pa.string()))
    out[:, -1] = left_out_shares(features, MET_SHORTEST, texts, order % MET_FOLDS)
    heat = temperature(out[:, :-1], y)
    chance = softmax(out[:, :-1] / heat)
    both = np.stack([chance.max(axis=1), out[:, -1]], axis=1)
    right = chance.argmax(axis=1) == y
    lettered = pc.match_substring_regex(pa.array(texts, pa.string()), r"\p{L}").to_numpy(zero_copy_only=False)
    floors = np.zeros((len(languages), 2))
    for i in range(len(languages)):
        own = right & lettered & (y == i)
        own = own if own.sum() >= FLOOR_TEXTS else right & lettered
        if own.any():
            floors[i] = [np.quantile(x, rate, method="lower") for x, rate in zip(both[own].T, REJECT_RATES, strict=True)]
    return LanguageModel(languages, model, heat, floors)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_TEXT_BYTES) -> LanguageModel:
    """Fit on at most about ``rows`` texts of each language from the rows that are not held out.

    Texts of over ``most_bytes`` take no part, and of more than
    ``MOST_LANGUAGES`` languages only the most frequent (ties by name) are
    learned.  Which rows are drawn depends on their keys alone: those whose
    hash lies under the share that the language needs, so nothing is ordered
    and no language's rows meet in one task.  A repeated key counts once, with
    the least of its languages.  Null keys, texts and languages take no part;
    without any row the model names nothing.
    """
    known = docs.where(~held_out(F.col("doc_id"), FOLDS, HELD_OUT) & F.col("lang").isNotNull() & (F.octet_length("text") <= most_bytes))
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("many"), ids_of(F.col("doc_id")).alias("ids")).orderBy(F.desc("many"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return fit([], [])
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(share_for(rows, r["ids"]))) for r in counts])
    drawn = known.select("doc_id", "lang", place(F.col("doc_id")).alias("place")).where(F.col("place") < share).distinct().collect()
    taken: dict[str, int] = {}
    wanted = {}
    for r in sorted(drawn, key=lambda r: (r["place"], str(r["doc_id"]), r["lang"])):
        if r["doc_id"] not in wanted and taken.get(r["lang"], 0) < rows:
            wanted[r["doc_id"]] = r["lang"]
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
    pairs = texts_of(known, wanted, most_bytes)
    fitted = fit([t for _, t in pairs], [wanted[k] for k, _ in pairs])
    give_back()
    return fitted


def identify_languages(docs: DataFrame, model: LanguageModel, carry: list[str] | None = None) -> DataFrame:
    """Columns ``row``, ``lang_pred``, ``score`` and ``rejected`` for every row of ``docs``.

    The prediction reads the whole text and nothing else.  A null text, or one
    without a letter, is ``und`` with score 0 and is rejected.  Repeated rows
    get equal results; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda: shared.value.predict, RESULT, carry=carry, limit=SCORED_BYTES)


def language_report(docs: DataFrame) -> DataFrame:
    """Train on the table and predict all of it."""
    out = identify_languages(docs.select("doc_id", "text"), train(docs), ["doc_id"])
    return unpacked(out, held_out(F.col("row.doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
