"""Text metrics: n-gram precision, longest common subsequence, TF-IDF cosine, edit distances, answer accuracy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from textloom.functions.text import col, normalized_answer, py_strip


def anls(pred: Column | str, truth: Column | str, threshold: float = 0.5) -> Column:
    """1 - normalised Levenshtein distance, 0 above the threshold; an empty truth wants an empty answer."""
    p, t = py_strip(F.lower(col(pred))), py_strip(F.lower(col(truth)))
    nl = F.levenshtein(p, t) / F.greatest(F.length(p), F.length(t))
    return F.when(t == "", F.when(p == "", 1.0).otherwise(0.0)).when(nl > threshold, 0.0).otherwise(1.0 - nl)


def best_anls(pred: Column | str, truths: Column | str) -> Column:
    return F.array_max(F.transform(col(truths), lambda t: anls(pred, t)))


def vqa_accuracy(pred: Column | str, truths: Column | str) -> Column:
    """min(1, equal normalised answers / 3)."""
    p = normalized_answer(pred)
    return F.least(F.lit(1.0), F.size(F.filter(col(truths), lambda t: normalized_answer(t) == p)) / F.lit(3.0))


def vqa_accuracies(rows: DataFrame, group: str, pred: str, truth: str) -> DataFrame:
    """rows with an accuracy: vqa_accuracy of each answer against the distinct truths of its group.

    Each text is normalised once and equal ones meet by a join, so a group of many rows costs no more than as many small
    ones. Rows without a group or an answer drop out; null truths don't count.
    """
    truths = rows.where(F.col(group).isNotNull() & F.col(truth).isNotNull()).select(group, truth).distinct()
    equal = truths.select(group, normalized_answer(truth).alias("_a")).groupBy(group, "_a").agg(F.count(F.lit(1)).alias("_n"))
    asked = rows.where(F.col(group).isNotNull() & F.col(pred).isNotNull()).withColumn("_a", normalized_answer(pred))
    return asked.join(equal, [group, "_a"], "left").withColumn("accuracy", F.least(F.lit(1.0), F.coalesce("_n", F.lit(0)) / F.lit(3.0))).drop("_a", "_n")


@F.pandas_udf(StructType([StructField("r", StringType()), StructField("h", StringType())]))
def _spelled(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Both texts with one character for each distinct word of the pair, null for null."""

    def one(r: str | None, h: str | None) -> tuple[str | None, str | None]:
        if r is None or h is None:
            return None, None
        codes: dict[str, str] = {}
        spell = lambda t: "".join([codes.setdefault(w, chr(0x20 + len(codes) + (0x800 if len(codes) + 0x20 >= 0xD800 else 0))) for w in t.split()])
        return spell(r), spell(h)

    return pd.DataFrame([one(r, h) for r, h in zip(reference, hypothesis, strict=True)], columns=["r", "h"])


def wer(reference: Column | str, hypothesis: Column | str) -> Column:
    """Word edit distance over the reference's words: each distinct word becomes one character for the built-in
    Levenshtein distance. 1.0 for an empty reference; may exceed 1; null for null."""
    both = _spelled(col(reference), col(hypothesis))
    return F.when(F.length(both["r"]) == 0, 1.0).otherwise(F.levenshtein(both["r"], both["h"]) / F.length(both["r"]))


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence of two arrays, by a fold over rows of the table; for short texts."""
    a, b = col(a), col(b)

    def row(last: Column, x: Column) -> Column:
        start = F.struct(F.array(F.lit(0)).alias("row"), F.lit(0).alias("j"))
        step = lambda acc, y: F.struct(
            F.concat(acc["row"], F.array(F.when(x == y, F.get(last, acc["j"]) + 1).otherwise(F.greatest(F.get(last, acc["j"] + 1), F.element_at(acc["row"], -1))))).alias("row"),
            (acc["j"] + 1).alias("j"),
        )
        return F.aggregate(b, start, step, lambda acc: acc["row"])

    zero = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))
    return F.element_at(F.aggregate(a, zero, row), -1)


@F.pandas_udf(IntegerType())
def lcs_long(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same for long texts, by Arrow batches."""
    from bisect import bisect_left

    def one(x, y) -> int:
        spots: dict = {}
        for j, w in enumerate(y):
            spots.setdefault(w, []).append(j)
        tops: list[int] = []
        for w in x:
            for j in reversed(spots.get(w, ())):
                k = bisect_left(tops, j)
                tops[k : k + 1] = [j]
        return len(tops)

    return pd.Series([None if x is None or y is None else one(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def rouge_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def rouge_l(reference: Column | str, hypothesis: Column | str, beta: float = 1.0) -> Column:
    """F-measure of the longest common subsequence, without stemming; 0 without words on either side."""
    r, h = rouge_tokens(reference), rouge_tokens(hypothesis)
    same = lcs_long(r, h).cast("double")
    p, q = F.try_divide(same, F.size(h)), F.try_divide(same, F.size(r))
    return F.coalesce(F.try_divide((1 + beta**2) * p * q, q + beta**2 * p), F.lit(0.0))


_MATCHES = [f"{c}{n}" for c in ("correct", "guess", "reference") for n in range(1, 5)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


class _Tokens(dict):
    """A 64-bit hash for each token."""

    def __missing__(self, token: str) -> int:
        value = self[token] = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return value


def gram_counts(ours: Iterable[str | None], theirs: Iterable[str | None], orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: (n, row, gram, uses in ours, uses in theirs) of the distinct n-grams of each row's two texts, split at
    white space; n-grams are 64-bit hashes. Null texts have none."""
    number, sides = _Tokens(), []
    for texts in (ours, theirs):
        tokens = [(t or "").split() for t in texts]
        flat = np.fromiter((number[w] for t in tokens for w in t), np.uint64)
        sides.append((flat, np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])))
    for n in orders:
        made = []
        for flat, row in sides:
            size = max(0, len(flat) - n + 1)
            gram = _mixed(flat[:size] + np.uint64(n))
            for step in range(1, n):
                gram = _mixed(gram * np.uint64(0x9E3779B97F4A7C15) + flat[step : step + size])
            whole = row[:size] == row[n - 1 : n - 1 + size]
            made.append((row[:size][whole], gram[whole]))
        row, gram = (np.concatenate([made[0][i], made[1][i]]) for i in (0, 1))
        own = np.repeat([1, 0], [len(made[0][0]), len(made[1][0])])
        order = np.lexsort((gram, row))
        row, gram, own = row[order], gram[order], own[order]
        start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])])) if len(row) else np.zeros(0, np.int64)
        first = np.add.reduceat(own, start) if len(start) else own
        yield n, row[start], gram[start], first, np.diff(np.append(start, len(row))) - first


@F.pandas_udf(StructType([StructField(c, LongType()) for c in _MATCHES]))
def _matches(hypothesis: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Per row and n: clipped matches and the n-grams of both sides; nulls have none."""
    out, size = {}, len(hypothesis)
    for n, row, _, ours, theirs in gram_counts(hypothesis, reference, (1, 2, 3, 4)):
        for name, counts in (("correct", np.minimum(ours, theirs)), ("guess", ours), ("reference", theirs)):
            out[f"{name}{n}"] = np.bincount(row, counts, size).astype(np.int64)
    return pd.DataFrame(out)[_MATCHES]


def tokenized_13a(c: Column | str) -> Column:
    """Text whose white-space tokens are those of the mteval-v13a script: punctuation apart, but within numbers."""
    # The script's replacements, in its order.
    steps = (
        (r"<skipped>", ""), (r"-\n", ""), (r"\n", " "), (r"&quot;", '"'), (r"&amp;", "&"), (r"&lt;", "<"), (r"&gt;", ">"), (r"^|$", " "),
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "),
    )
    out = col(c)
    for pattern, into in steps:
        out = F.regexp_replace(out, pattern, into)
    return out


def ngram_matches(pairs: DataFrame, hypothesis: str, reference: str, group: tuple[str, ...] = (), tokens: str = "lower") -> DataFrame:
    """Per group and n: clipped matches, n-grams of hypotheses and of references, counted within each row, so that only a
    row per group and task is shuffled. Tokens are split at white space: `lower` case, or `13a` in the text's own case."""
    made = {"lower": F.lower, "13a": tokenized_13a}[tokens]
    rows = pairs.select(*group, _matches(made(hypothesis), made(reference)).alias("m"))
    sums = rows.groupBy(*group).agg(*[F.coalesce(F.sum(f"m.{c}"), F.lit(0)).alias(c) for c in _MATCHES])
    parts = F.array(*[F.struct(F.lit(n).alias("n"), *[F.col(f"{c}{n}").alias(c) for c in ("correct", "guess", "reference")]) for n in range(1, 5)])
    return sums.select(*group, F.explode(parts).alias("p")).select(*group, "p.*")


def bleu(stats: DataFrame, group: tuple[str, ...] = (), smooth: str = "none") -> DataFrame:
    """BLEU-1 and BLEU-4 (0 to 100) of ngram_matches: geometric mean of precisions times brevity penalty.

    smooth: none, or exp (the k-th precision without a match is 1 / (2**k * guesses); nltk's method 3 is the same).
    """
    at = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    wide = stats.groupBy(*group).agg(*[at(n, c).cast("double").alias(f"{c}{n}") for n in range(1, 5) for c in ("correct", "guess")], at(1, "reference").cast("double").alias("ref"))
    zeros = F.lit(0.0)
    precision = []
    for n in range(1, 5):
        c, g = F.coalesce(F.col(f"correct{n}"), F.lit(0.0)), F.coalesce(F.col(f"guess{n}"), F.lit(0.0))
        zeros = zeros + (c == 0).cast("double")
        precision.append(F.coalesce(F.try_divide(F.when(c > 0, c).otherwise(F.pow(F.lit(2.0), -zeros) if smooth == "exp" else F.lit(0.0)), g), F.lit(0.0)))
    brevity = F.when(F.col("guess1") > F.col("ref"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("ref"), F.col("guess1"))))
    product = precision[0] * precision[1] * precision[2] * precision[3]
    return wide.select(*group, (100 * F.coalesce(brevity, F.lit(0.0)) * precision[0]).alias("bleu1"), (100 * F.coalesce(brevity, F.lit(0.0)) * F.pow(product, F.lit(0.25))).alias("bleu4"))


def _gram_rows(pairs: DataFrame, key: str, hypothesis: str, reference: str, orders: tuple[int, ...]) -> DataFrame:
    """(_k, n, gram, ours, theirs) of gram_counts."""
    kind = dict(pairs.dtypes)[key]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, row, gram, ours, theirs in gram_counts(batch.column(1).to_pylist(), batch.column(2).to_pylist(), orders):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.full(len(row), n, np.int32)), pa.array(gram.view(np.int64)), pa.array(ours.astype(np.int32)), pa.array(theirs.astype(np.int32))], ["_k", "n", "gram", "ours", "theirs"])

    return pairs.select(F.col(key).alias("_k"), F.lower(hypothesis), F.lower(reference)).mapInArrow(count, f"_k {kind}, n int, gram long, ours int, theirs int")


def tfidf_cosine(pairs: DataFrame, key: str, hypothesis: str, reference: str, n: int = 4) -> DataFrame:
    """(key, cosine): TF-IDF cosine over n-grams, idf = ln((N + 1) / (df + 1)) over references; 0 without n-grams.

    N-grams are counted within their row and compared by 64-bit hashes; keys are unique.
    """
    counted = _gram_rows(pairs, key, hypothesis, reference, (n,))
    df = counted.where("theirs > 0").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    total = pairs.agg(F.count(F.lit(1)).alias("docs"))
    weighed = counted.join(df, "gram", "left").crossJoin(F.broadcast(total)).withColumn("idf", F.ln((F.col("docs") + 1) / (F.coalesce("df", F.lit(0)) + 1)))
    sums = weighed.groupBy("_k").agg(F.sum(F.col("ours") * F.col("theirs") * F.col("idf") * F.col("idf")).alias("dot"), F.sum(F.pow(F.col("ours") * F.col("idf"), 2)).alias("hh"), F.sum(F.pow(F.col("theirs") * F.col("idf"), 2)).alias("rr"))
    value = F.coalesce(F.try_divide(F.col("dot"), F.sqrt(F.col("hh") * F.col("rr"))), F.lit(0.0))
    scored = sums.select("_k", value.alias("cosine"))
    return pairs.select(F.col(key).alias("_k")).join(scored, "_k", "left").select(F.col("_k").alias(key), F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def cider(pairs: DataFrame, key: str, hypothesis: str, reference: str, sigma: float = 6.0) -> DataFrame:
    """(key, cider): consensus score of n-grams of one to four tokens: clipped TF-IDF products over both norms, damped by the
    difference in length (in bigrams), ten times the mean over n. idf = ln(N) - ln(max(1, df)) over references."""
    counted = _gram_rows(pairs, key, hypothesis, reference, (1, 2, 3, 4))
    df = counted.where("theirs > 0").groupBy("n", "gram").agg(F.count(F.lit(1)).alias("df"))
    total = pairs.agg(F.count(F.lit(1)).alias("docs"))
    weighed = counted.join(df, ["n", "gram"], "left").crossJoin(F.broadcast(total)).withColumn("idf", F.ln("docs") - F.ln(F.coalesce(F.greatest("df", F.lit(1)), F.lit(1))))
    ours, theirs = F.col("ours") * F.col("idf"), F.col("theirs") * F.col("idf")
    per = weighed.groupBy("_k", "n").agg(F.sum(F.least(ours, theirs) * theirs).alias("dot"), F.sqrt(F.sum(ours * ours)).alias("h"), F.sqrt(F.sum(theirs * theirs)).alias("r"), F.sum(F.col("ours") - F.col("theirs")).alias("longer"))
    delta = F.max(F.when(F.col("n") == 2, F.col("longer")))
    value = F.sum(F.coalesce(F.try_divide(F.col("dot"), F.col("h") * F.col("r")), F.lit(0.0))) / 4 * F.exp(-F.pow(F.coalesce(delta, F.lit(0)), 2) / (2 * sigma**2)) * 10
    scored = per.groupBy("_k").agg(value.alias("cider"))
    return pairs.select(F.col(key).alias("_k")).join(scored, "_k", "left").select(F.col("_k").alias(key), F.coalesce("cider", F.lit(0.0)).alias("cider"))


def _common(masks: dict[str, int], bits: int, b: str) -> int:
    """The length of the longest common subsequence, by bits; masks has the places of each character of the other text."""
    full = (1 << bits) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return bits - v.bit_count()


@F.pandas_udf(BooleanType())
def repeats_itself(parts: pd.Series) -> pd.Series:
    """Whether any two sentences of an array have a Ratcliff/Obershelp ratio above 0.75.

    The matched characters are at most those that both hold, and at most their longest common subsequence: pairs that
    these bounds rule out aren't matched. Repeated arrays are judged once a batch.
    """
    from difflib import SequenceMatcher

    def one(x: tuple[str, ...]) -> bool:
        n = np.array([len(t) for t in x])
        held = np.array([np.bincount(np.frombuffer(t.encode("utf-32-le"), "<u4") & 63, minlength=64) for t in x]) if len(x) else np.zeros((0, 64), int)
        masks: dict[int, dict[str, int]] = {}
        for i in range(len(x) - 1):
            both = np.minimum(held[i], held[i + 1 :]).sum(axis=1)
            for j in np.flatnonzero(2 * both > 0.75 * (n[i] + n[i + 1 :])) + i + 1:
                if i not in masks:
                    spots: dict[str, int] = {}
                    for at, c in enumerate(x[i]):
                        spots[c] = spots.get(c, 0) | 1 << at
                    masks[i] = spots
                if 2 * _common(masks[i], len(x[i]), x[j]) > 0.75 * (n[i] + n[j]) and SequenceMatcher(None, x[i], x[j]).ratio() > 0.75:
                    return True
        return False

    known: dict[tuple[str, ...], bool] = {}
    out = []
    for x in parts:
        key = None if x is None else tuple(x)
        if key is not None and key not in known:
            known[key] = one(key)
        out.append(None if key is None else known[key])
    return pd.Series(out, dtype="object")


@F.pandas_udf(DoubleType())
def _meteor(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    def one(r: str | None, h: str | None) -> float | None:
        if r is None or h is None:
            return None
        a, b = h.split(), r.split()
        spots: dict[str, list[int]] = {}
        for j, w in enumerate(b):
            spots.setdefault(w, []).append(j)
        pairs, last = [], -2
        for i, w in enumerate(a):
            free = spots.get(w)
            if free:
                j = last + 1 if last + 1 in free else free[0]
                free.remove(j)
                pairs.append((i, j))
                last = j
        m = len(pairs)
        if not m:
            return 0.0
        p, q = m / len(a), m / len(b)
        chunks = 1 + sum(1 for (i, j), (k, n) in zip(pairs[:-1], pairs[1:], strict=True) if k != i + 1 or n != j + 1)
        return 10 * p * q / (q + 9 * p) * (1 - 0.5 * (chunks / m) ** 3)

    return pd.Series([one(r, h) for r, h in zip(reference, hypothesis, strict=True)])


def meteor(reference: Column | str, hypothesis: Column | str, lower: bool = True) -> Column:
    """Exact-match METEOR on white-space tokens, in lower or in their own case (no synonyms: their data are not public here)."""
    r, h = col(reference), col(hypothesis)
    return _meteor(F.lower(r), F.lower(h)) if lower else _meteor(r, h)
