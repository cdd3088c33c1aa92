"""Quality rules by robust multivariate outliers.

Each text has a vector of transformed statistics. For each language and source, the minimum covariance determinant
gives a location and a scatter that outliers don't pull: from two starts (medians and deviations from them; the same with
the correlations of squashed scores), concentration steps refit to the half of the rows that are nearest, (n + p + 1) / 2
of n rows with p statistics, so that junk may make up nearly half of a group, until no determinant changes; and the fit
with the smaller determinant is refit once to all rows that it doesn't call outlying. A row is rejected if its
Mahalanobis distance from its group's fit is beyond a chi-square quantile, or by the base rules.

A step is one aggregation: rows are counted and summed up by group and by bin of their distance, which is combined
before the shuffle, so a group of any size costs its few hundred bins. The fits are a table with a row for each group,
never gathered on the driver.

Groups with fewer than `least` rows (nulls in lang or source are a value of their own) use their language's fit; if
that has too few as well, the fit to all rows. Lines and windows of words are told apart within a text by 64-bit hashes.
Null text has no words, so it fails the base rules; rows that fail
them don't count in the fits. Equal rows have equal verdicts. An empty table gives an empty result. Extra columns are
kept by keep() and ignored by digest().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, U, Scratch, mix, prefix, range_hash, shingles, slices, tidied, utf8, words

#: The statistics' names and the least scale of each, so that one that hardly varies in a group rejects nothing by itself.
STATISTICS = (
    ("word_length", 0.15),
    ("symbols", 0.45),
    ("duplicate_lines", 0.12),
    ("repeated_words", 0.10),
    ("punctuation", 0.35),
    ("capitals", 0.45),
    ("digits", 0.06),
    ("other_characters", 0.10),
)
P = len(STATISTICS)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Classes of bytes, for counts of characters.
_SPACE, _LOWER, _UPPER, _DIGIT, _SYMBOL, _MARK, _OTHER, _TAIL, _HEAD = range(9)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b"!\"'()+,-./:;=?@[\\]^_`{}~", _MARK), (b"#*$%&|<>", _SYMBOL)):
    _CLASS[list(_chars)] = _kind
_CLASS[0x80:0xC0] = _TAIL
_CLASS[0xC0:] = _HEAD


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts, and the vectors, of a column of texts."""
    raw, at = utf8(column)
    n = len(at) - 1
    begin, end, row = words(raw, at, SPACED)
    n_words = np.bincount(row, minlength=n)
    of = np.repeat(np.arange(n) * 9, np.diff(at))
    kinds = np.bincount(of + _CLASS[raw], minlength=n * 9).reshape(n, 9)
    word_chars = kinds.sum(1) - kinds[:, _SPACE] - kinds[:, _TAIL]
    sums = prefix(raw)
    # lines: each newline and each end of a text ends one
    newline = np.flatnonzero(raw == 0x0A)
    ends = np.concatenate([at[1:], newline])
    order = np.argsort(ends, kind="stable")
    ends, closes = ends[order], order < n
    begins = np.concatenate([[0], np.where(closes, ends, ends + 1)[:-1]])
    line_row = np.cumsum(closes) - closes
    worded = np.searchsorted(begin, ends) > np.searchsorted(begin, begins)
    begins, ends, line_row = begins[worded], ends[worded], line_row[worded]
    n_lines = np.bincount(line_row, minlength=n)
    _, first = np.unique(range_hash(sums, begins, ends) ^ mix(line_row.astype(U) + U(1)), return_index=True)
    n_dup = n_lines - np.bincount(line_row[first], minlength=n)
    # words in windows of three that occur more than once in their text
    window, where = shingles(range_hash(sums, begin, end), row, 3)
    _, back, times = np.unique(window ^ mix(row[where].astype(U) + U(1)), return_inverse=True, return_counts=True)
    again = where[times[back] > 1]
    covered = np.zeros(len(row), bool)
    for t in range(3):
        covered[again + t] = True
    n_repeat = np.bincount(row[covered], minlength=n)
    counts = dict(zip(COUNTS, (n_words, word_chars, kinds[:, _SYMBOL], n_dup, n_repeat), strict=True))
    chars = word_chars + 100.0
    vector = np.stack(
        [
            np.log((word_chars + 50.0) / (n_words + 10.0)),
            np.log1p(100.0 * kinds[:, _SYMBOL] / (n_words + 20.0)),
            n_dup / (n_lines + 5.0),
            n_repeat / (n_words + 20.0),
            np.log((kinds[:, _MARK] + 4.0) / chars),
            np.log((kinds[:, _UPPER] + 4.0) / chars),
            np.sqrt(kinds[:, _DIGIT] / chars),
            np.sqrt(kinds[:, _OTHER] / chars) + kinds[:, _HEAD] / chars,
        ],
        axis=1,
    )
    return counts, vector


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs as c0_, c1_ ..., lang, source, the base counts, base_failed, and the vector v."""
    kept = [f"c{i}_" for i in range(len(keep))]
    read = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    fields = [f for f in read.schema.fields if f.name != "text"]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                counts, vector = statistics(part.column("text"))
                flat = pa.array(np.ascontiguousarray(vector).reshape(-1))
                v = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * P), flat)
                columns = [part.column(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[c], pa.int64()) for c in COUNTS), v], schema.names)

    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return read.mapInArrow(tidied(run), schema).withColumn("base_failed", failed)


# --------------------------------------------------------------------------- chi-square, for an even number of degrees


def chi2_cdf(x: float, degrees: int) -> float:
    half, term, total = x / 2, 1.0, 0.0
    for k in range(degrees // 2):
        total += term
        term *= half / (k + 1)
    return 1 - math.exp(-half) * total


def chi2_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, degrees) < p else (low, mid)
    return high


# --------------------------------------------------------------------------- fits

#: level: 0 for a language and source, 1 for a language, 2 for all rows.
UNIT = ["u_lang", "u_source", "level", "start"]
FIT = "u_lang string, u_source string, level int, start int, n long, mu array<double>, w array<double>, logdet double"
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_FLOOR = np.array([s for _, s in STATISTICS])


def _whitened(cov: np.ndarray) -> tuple[list[float], float]:
    """The inverse of the Cholesky factor of the scatter (with the least scales added), row by row, and log det."""
    factor = np.linalg.cholesky(cov + np.diag(_FLOOR**2))
    inverse = np.linalg.inv(factor)
    return [float(inverse[i, j]) for i, j in _PAIRS], 2 * float(np.log(np.diag(factor)).sum())


def _distance() -> Column:
    """The squared Mahalanobis distance of v from mu, scaled by w."""
    rows = []
    for i in range(P):
        terms = [F.col("w")[_PAIRS.index((i, j))] * (F.col("v")[j] - F.col("mu")[j]) for j in range(i + 1)]
        rows.append(sum(terms[1:], terms[0]))
    return sum((r * r for r in rows[1:]), rows[0] * rows[0])


def _joined(rows: DataFrame, fits: DataFrame, on: list[str]) -> DataFrame:
    renamed = fits.select(*[F.col(c).alias(f"f_{c}") for c in on], *[c for c in fits.columns if c not in on])
    same = None
    for c in on:
        here = F.col(c).eqNullSafe(F.col(f"f_{c}"))
        same = here if same is None else same & here
    return rows.join(renamed, same).drop(*[f"f_{c}" for c in on])


def _step(rows: DataFrame, fits: DataFrame, h: float | None, within: float | None = None) -> DataFrame:
    """Fits to the nearest of each group's rows (from the half for h = 0.5 to all for 1), or to those within a squared
    distance."""
    binned = _joined(rows, fits.drop("n", "logdet"), UNIT[:3]).withColumn("bin", F.floor(16 * F.log2(1 + _distance())).cast("int"))
    sums = binned.groupBy(*UNIT, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col("v")[i]) for i in range(P)]).alias("s"),
        F.array(*[F.sum(F.col("v")[i] * F.col("v")[j]) for i, j in _PAIRS]).alias("q"),
    )
    def fit(key, group):
        import pandas as pd

        group = group.sort_values("bin")
        n = group["n"].to_numpy(float)
        s, q = np.stack(group["s"].to_numpy()), np.stack(group["q"].to_numpy())
        total = n.sum()
        if h is not None:
            half = min(total, (total + P + 1) / 2)
            nearest = half + (total - half) * (2 * h - 1)
            share = nearest / total
            take = np.clip((nearest - (np.cumsum(n) - n)) / n, 0, 1)  # the last bin counts in part
        else:
            share = 0.975
            take = (group["bin"].to_numpy() <= math.floor(16 * math.log2(1 + within))).astype(float)
            if not take.any():
                take[0] = 1
        factor = share / chi2_cdf(chi2_quantile(share, P), P + 2)  # makes the scatter of the nearest share that of all, for normal rows
        m = (n * take).sum()
        mu = (s * take[:, None]).sum(0) / m
        cov = np.zeros((P, P))
        for (i, j), x in zip(_PAIRS, (q * take[:, None]).sum(0) / m, strict=True):
            cov[i, j] = cov[j, i] = x - mu[i] * mu[j]
        values, vectors = np.linalg.eigh(cov * factor)
        w, logdet = _whitened((vectors * np.maximum(values, 0)) @ vectors.T)
        return pd.DataFrame([[*key, int(total), mu.tolist(), w, logdet]], columns=[*UNIT, "n", "mu", "w", "logdet"])

    return sums.groupBy(*UNIT).applyInPandas(fit, FIT)


def _starts(rows: DataFrame) -> DataFrame:
    """Medians with the deviations from them (start 0), and with the correlations of squashed scores (start 1)."""
    median = lambda x: F.percentile_approx(x, F.lit(0.5), F.lit(1000))
    centre = rows.groupBy(*UNIT[:3]).agg(F.array(*[median(F.col("v")[i]) for i in range(P)]).alias("mu"))
    apart = _joined(rows, centre, UNIT[:3])
    spread = apart.groupBy(*UNIT[:3], "mu").agg(F.array(*[1.4826 * median(F.abs(F.col("v")[i] - F.col("mu")[i])) for i in range(P)]).alias("mad"))
    scored = _joined(rows, spread, UNIT[:3])
    squashed = scored.withColumn("y", F.array(*[F.tanh((F.col("v")[i] - F.col("mu")[i]) / F.greatest(F.col("mad")[i], F.lit(STATISTICS[i][1]))) for i in range(P)]))
    sums = squashed.groupBy(*UNIT[:3], "mu", "mad").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("y")[i]) for i in range(P)]).alias("s"), F.array(*[F.sum(F.col("y")[i] * F.col("y")[j]) for i, j in _PAIRS]).alias("q"))

    def start(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                scale, m = np.array(r.mad), np.array(r.s) / r.n
                cov = np.zeros((P, P))
                for (i, j), x in zip(_PAIRS, np.array(r.q) / r.n, strict=True):
                    cov[i, j] = cov[j, i] = x - m[i] * m[j]
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                for k, corr in ((0, np.eye(P)), (1, 0.99 * cov / np.outer(sd, sd) * (np.diag(cov) > 1e-12) + 0.01 * np.eye(P))):
                    values, vectors = np.linalg.eigh(corr * np.outer(scale, scale))
                    w, logdet = _whitened((vectors * np.maximum(values, 0)) @ vectors.T)
                    out.append([r.u_lang, r.u_source, r.level, k, int(r.n), list(r.mu), w, logdet])
            yield pd.DataFrame(out, columns=[*UNIT, "n", "mu", "w", "logdet"])

    return sums.mapInPandas(start, FIT)


def fits(rows: DataFrame, scratch: Scratch, steps: int = 100, h: float = 0.5, within: float = 0.999, still: float = 0.01) -> DataFrame:
    """A fit for each language and source, for each language, and for all rows. Concentration steps go on until no log of a
    determinant changes by more than `still`; if `steps` of them don't come to that, it is an error, not a result."""
    own = rows.filter(~F.col("base_failed")).select("lang", "source", "v")
    none = F.lit(None).cast("string")
    unit = lambda lang, source, level: F.struct(lang.alias("u_lang"), source.alias("u_source"), F.lit(level).alias("level"))
    units = own.select(F.inline(F.array(unit(F.col("lang"), F.col("source"), 0), unit(F.col("lang"), none, 1), unit(none, none, 2))), "v")
    now = scratch.write(_starts(units), "fit0")
    for k in range(steps):
        last, now = now, scratch.write(_step(units, now, h), f"fit{k + 1}")
        before = _joined(now.select(*UNIT, "logdet"), last.select(*UNIT, F.col("logdet").alias("was")), UNIT)
        moved = before.filter(F.abs(F.col("logdet") - F.col("was")) > still).limit(1).count()
        scratch.drop(f"fit{k}")
        if not moved:
            break
    else:
        raise RuntimeError(f"the fits still move after {steps} steps")
    best = now.groupBy(*UNIT[:3]).agg(F.min_by(F.struct("start", "n", "mu", "w", "logdet"), F.struct("logdet", "start")).alias("b")).select(*UNIT[:3], "b.*")
    return scratch.write(_step(units, best, None, chi2_quantile(within, P)), "fit")


def assess(docs: DataFrame, keep: list[str], quantile: float = 1 - 1e-7, least: int = 50, **options) -> DataFrame:
    """The columns of measured(), and distance and kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.write(measured(docs, keep), "measured")
    found = fits(rows, scratch, **options).filter((F.col("n") >= least) | (F.col("level") == 2))
    fit = F.struct("mu", "w")
    own = found.filter("level = 0").select(F.col("u_lang").alias("a_lang"), F.col("u_source").alias("a_source"), fit.alias("a"))
    wide = found.filter("level = 1").select(F.col("u_lang").alias("b_lang"), fit.alias("b"))
    last = found.filter("level = 2").select(fit.alias("c"))  # one row, or none in an empty table
    both = rows.join(own, F.col("lang").eqNullSafe(F.col("a_lang")) & F.col("source").eqNullSafe(F.col("a_source")), "left").join(wide, F.col("lang").eqNullSafe(F.col("b_lang")), "left").join(F.broadcast(last), F.lit(True), "left")
    chosen = F.coalesce("a", "b", "c")
    judged = both.withColumn("mu", chosen["mu"]).withColumn("w", chosen["w"]).withColumn("distance", F.sqrt(_distance()))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= math.sqrt(chi2_quantile(quantile, P)))
    return judged.withColumn("kept", kept).drop("mu", "w", "a", "b", "c", "a_lang", "a_source", "b_lang")


def keep(docs: DataFrame, **options) -> DataFrame:
    """The documents that aren't rejected, with the columns of docs."""
    names = docs.columns
    return assess(docs, names, **options).filter("kept").select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(names)])


def digest(docs: DataFrame, **options) -> DataFrame:
    """What op3 returns."""
    judged = assess(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text"), ["doc_id"], **options)
    return judged.select(F.col("c0_").alias("doc_id"), *COUNTS, "base_failed", "kept", "distance")
