"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of its words in two lexicons (a fixed one, and one of words and word beginnings
learned from labelled texts), how near such words stand to a second person, and rates of capitals, marks and obfuscated
words. Labelled rows are dealt by a hash of doc_id into folds: two fifths teach the lexicon, two fifths the trees, one
fifth the calibration, so that no part sees scores that fit its own labels too well.

Learning uses a sample of at most `bound` labelled rows (drawn by hash); features and scores cover all rows.

Null and empty texts have the features of a text without words and are scored like all others. Repeated rows have
equal scores; null doc_id is never a labelled row. Without labels of both kinds all scores are the share of label 1 (0
without labels). An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, Scratch, buckets, prefix, range_hash, slices, tidied, utf8, words

#: Plain English insults, and second persons of four languages.
INSULTS = ("clown", "disgusting", "dumb", "fool", "hate", "idiot", "idiots", "imbecile", "loser", "losers", "moron", "morons", "pathetic", "scum", "stupid", "trash", "ugly", "useless", "vile", "worthless")
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros", "vuestro")

FEATURES = (
    "insult_density", "insult_count", "learned_density", "learned_count", "learned_distinct", "learned_weight_density", "learned_weight_best",
    "near_second_person", "second_person_density", "capital_rate", "capital_words", "exclamation_rate", "question_rate", "mark_rate",
    "obfuscation_rate", "stretch_rate", "digit_rate", "log_words", "mean_word",
)
NEAR = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORDY = np.zeros(256, bool)
_WORDY[ord("0") : ord("9") + 1] = True
_WORDY[ord("a") : ord("z") + 1] = True
_WORDY[ord("A") : ord("Z") + 1] = True
_WORDY[0x80:] = True
_ALPHA = _WORDY.copy()
_ALPHA[ord("0") : ord("9") + 1] = False
_HIDING = np.zeros(256, bool)
_HIDING[list(b"*@$#!0123456789")] = True
#: Lengths in bytes of the word beginnings that the lexicon may hold.
BEGINNINGS = (4, 5, 6)


def lowered(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, byte for byte."""
    low = _LOWER[raw]
    if len(raw) > 1:
        tail = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        low[tail] += 32
    return low


def _hashes(texts: tuple[str, ...]) -> np.ndarray:
    raw, at = utf8(pa.array(list(texts)))
    return range_hash(prefix(raw), at[:-1], at[1:])


def _terms(low: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """For each word the hashes of the whole and of its beginnings (the whole again where it is shorter)."""
    begin, end, row = words(low, at, _WORDY)
    sums = prefix(low)
    terms = [range_hash(sums, begin, end)] + [range_hash(sums, begin, np.minimum(end, begin + n)) for n in BEGINNINGS]
    return terms, begin, end, row


def _held(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether x is among sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x, at


def features(column: pa.Array, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text. keys: sorted hashes of the learned lexicon; weights: its log odds."""
    raw, at = utf8(column)
    n = len(at) - 1
    low = lowered(raw)
    terms, begin, end, row = _terms(low, at)
    count = lambda rows, w=None: np.bincount(rows, weights=w, minlength=n).astype(float)
    n_words = count(row)
    per = n_words + 5.0
    weight = np.zeros(len(row))
    best_term = np.zeros(len(row), U)
    for t in terms:
        hit, where = _held(keys, t)
        better = hit.copy()
        better[hit] = weights[where[hit]] > weight[hit]
        weight[better] = weights[where[better]]
        best_term[better] = t[better]
    learned = weight > 0
    insult = np.isin(terms[0], _hashes(INSULTS))
    second = np.isin(terms[0], _hashes(SECOND_PERSON))
    # words with a second person among the NEAR words on either side, in the same text
    seen = np.concatenate([[0], np.cumsum(second)])
    bounds = np.searchsorted(row, np.arange(n + 1))
    i = np.arange(len(row))
    near = seen[np.minimum(i + NEAR + 1, bounds[row + 1])] - seen[np.maximum(i - NEAR, bounds[row])] > 0 if len(row) else np.zeros(0, bool)
    bad = learned | insult
    best = np.zeros(n)
    np.maximum.at(best, row, weight)
    distinct = np.zeros(n)
    if learned.any():
        pairs = np.unique(np.stack([row[learned].astype(U), best_term[learned]]), axis=1)
        distinct = count(pairs[0].astype(np.int64))
    # characters
    of = np.repeat(np.arange(n), np.diff(at))
    chars = count(of) + 50.0
    upper = (raw >= ord("A")) & (raw <= ord("Z"))
    ups = np.concatenate([[0], np.cumsum(upper)])
    size = end - begin
    shouted = (size >= 3) & (ups[end] - ups[begin] == size)
    alpha = _ALPHA[raw]
    hidden = np.zeros(len(raw), bool)
    stretched = np.zeros(len(raw), bool)
    if len(raw) > 2:
        hidden[1:-1] = _HIDING[raw[1:-1]] & alpha[:-2] & alpha[2:]
        stretched[1:-1] = alpha[1:-1] & (low[1:-1] == low[:-2]) & (low[1:-1] == low[2:])
        filled = at[:-1] < at[1:]
        edge = np.concatenate([at[:-1][filled], at[1:][filled] - 1])  # a text's neighbours don't count
        hidden[edge] = stretched[edge] = False
    mark = (raw > 0x20) & ~_WORDY[raw]
    mean = np.divide(count(row, size.astype(float)), n_words, out=np.zeros(n), where=n_words > 0)
    return np.stack(
        [
            count(row[insult]) / per, count(row[insult]), count(row[learned]) / per, count(row[learned]), distinct, count(row, weight) / per, best,
            count(row[bad & near]), count(row[second]) / per, count(of[upper]) / chars, count(row[shouted]) / per,
            count(of[raw == ord("!")]) / chars, count(of[raw == ord("?")]) / chars, count(of[mark]) / chars,
            count(of[hidden]) / per, count(of[stretched]) / per, count(of[(raw >= ord("0")) & (raw <= ord("9"))]) / chars, np.log1p(n_words), mean,
        ],
        axis=1,
    )


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def sample(labels: DataFrame, bound: int) -> DataFrame:
    """doc_id, label, fold (0 to 4): at most about `bound` of the labelled rows that learning may use."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL").filter(remainder(F.col("doc_id")) != 2)
    one = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = one.count()
    spread = F.xxhash64("doc_id", F.lit("sample"))
    drawn = one if n <= bound else one.filter(F.pmod(spread, F.lit(1 << 20)) < int((1 << 20) * bound / n))
    return drawn.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)).cast("int"))


def lexicon(taught: DataFrame, lift: float = 6.0, support: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Terms that stand in labelled-1 texts at least `lift` times as often as in others, and in a share `support` of those of
    a language at least roughly. How many there are is bounded by the share, and the texts by the sample's bound."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                raw, at = utf8(part.column("text"))
                terms, _, _, row = _terms(lowered(raw), at)
                label = part.column("label").to_numpy(zero_copy_only=False)
                pairs = np.unique(np.stack([np.tile(row, len(terms)).astype(U), np.concatenate(terms)]), axis=1) if len(row) else np.zeros((2, 0), U)
                term, back = np.unique(pairs[1], return_inverse=True)
                of = label[pairs[0].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(np.bincount(back[of == 1], minlength=len(term)), pa.int64()), pa.array(np.bincount(back[of != 1], minlength=len(term)), pa.int64())], ["term", "pos", "neg"])

    totals = taught.agg(F.sum("label"), F.count(F.lit(1))).first()
    p, n = totals[0] or 0, totals[1] or 0
    if not p or p == n:
        return np.empty(0, U), np.empty(0)
    odds = F.log((F.col("pos") + 0.5) / F.lit(p + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n - p + 1.0))
    found = taught.select("text", "label").mapInArrow(tidied(count), "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = found.filter(F.col("pos") >= max(3, support * p / 4)).withColumn("odds", odds).filter(F.col("odds") >= float(np.log(lift)))
    rows = found.collect()  # of a bounded sample
    keys = np.array([r["term"] for r in rows], np.int64).view(U)
    order = np.argsort(keys)
    return keys[order], np.array([r["odds"] for r in rows])[order]


def measured(docs: DataFrame, keys: np.ndarray, weights: np.ndarray) -> DataFrame:
    """doc_id and the features f of each row."""
    width = len(FEATURES)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"), keys, weights)
                f = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(x).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), f], ["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, f array<double>")


def score(docs: DataFrame, labels: DataFrame, bound: int = 60_000, trees: int = 25, depth: int = 3, step: float = 0.3, seed: int = 11) -> DataFrame:
    """doc_id, f and score (0 to 1: the calibrated chance of label 1) of each row of docs."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    drawn = F.broadcast(scratch.write(sample(labels, bound), "sample"))  # at most `bound` narrow rows
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(drawn.filter("fold < 2"), "doc_id")
    keys, weights = lexicon(taught)
    rows = scratch.write(measured(docs, keys, weights), "features")
    labelled = scratch.write(rows.join(drawn, "doc_id").filter("fold >= 2").select(array_to_vector("f").alias("features"), F.col("label").cast("double").alias("label"), "fold").repartition(buckets(spark)), "labelled")
    kinds = {(r["fold"] < 4, r["label"]): r["n"] for r in labelled.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all((True, x) in kinds for x in (0.0, 1.0)):
        base = labelled.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
        return rows.withColumn("score", F.lit(float(base)))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, maxBins=64, minInstancesPerNode=5).fit(labelled.filter("fold < 4"))
    chance = vector_to_array("probability")[1]
    judged = model.transform(labelled.filter("fold = 4")).select(chance.alias("chance"), "label")
    scored = model.transform(rows.withColumn("features", array_to_vector("f"))).withColumn("chance", chance)
    if all((False, x) in kinds for x in (0.0, 1.0)):
        calibrated = IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="calibrated").fit(judged)
        scored = calibrated.transform(scored)
        # ties of the steps keep the trees' order
        scored = scored.withColumn("score", 0.98 * F.col("calibrated") + 0.02 * F.col("chance"))
    else:
        scored = scored.withColumn("score", F.col("chance"))
    return scored.select("doc_id", "f", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def digest(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """What op6 returns."""
    return score(docs, labels, **options).select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
