"""Weak supervision over quality rules: rules vote or abstain, expectation maximisation weighs them.

Defined results: a null text counts as empty; a document without words fails the base rules and is not kept;
repeated rows are judged one by one and equally; an empty table gives an empty table. Ids are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailfield.llm import segments as S
from tailfield.session import small_table

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks")
FEATURE_TYPE = "struct<" + ",".join(f"{f}:bigint" for f in FEATURES) + ">"

_SYMBOL, _UPPER, _LETTER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC0:] = True  # the first byte of a longer character
_DIGIT[48:58] = True
_MARK[list(b"!?")] = True


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each document of a slice."""
    out = np.zeros((len(offsets) - 1, len(FEATURES)), np.int64)
    base, text = int(offsets[0]), data[offsets[0]: offsets[-1]]
    inside = ~S.SPACE[text]
    hashes, words, _, bounds = S.runs(data, offsets, S.SPACE)
    lines, begins, ends, line_bounds = S.runs(data, offsets, S.NEWLINE)
    worded = np.searchsorted(words, ends) > np.searchsorted(words, begins)
    owner = S.owners(line_bounds)
    for column, flags in (
        (1, inside & ((text & 0xC0) != 0x80)), (2, _SYMBOL[text]), (6, _UPPER[text]), (7, _LETTER[text]), (8, _DIGIT[text]), (9, _MARK[text]),
    ):
        out[:, column] = S.per_document(flags, base, offsets)
    out[:, 0] = np.diff(bounds)
    out[:, 5] = np.bincount(owner[worded], minlength=len(out))
    out[:, 3] = out[:, 5] - np.bincount(owner[worded][_first_seen(lines[worded], owner[worded])], minlength=len(out))
    triples, starts = S.windows(hashes, bounds, 3)
    owner = S.owners(bounds)
    twice = starts[_repeated(triples, owner[starts])]
    hit = np.zeros(len(hashes) + 3, bool)
    for i in range(3):
        hit[twice + i] = True
    out[:, 4] = np.bincount(owner[hit[: len(hashes)]], minlength=len(out))
    return out


def _keys(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return S.mix(hashes + S.mix(owner.astype(np.uint64)))


def _first_seen(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Index of one element for each distinct (hash, owner)."""
    return np.unique(_keys(hashes, owner), return_index=True)[1]


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Flags of the elements whose (hash, owner) occurs more than once."""
    keys = _keys(hashes, owner)
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def features(text: Column) -> Column:
    """Counts of a text as a struct of ``FEATURES``."""

    @F.arrow_udf(FEATURE_TYPE)
    def count(column: pa.Array) -> pa.Array:
        data, offsets = S.column_bytes(column)
        parts = [_features(data, offsets[i: j + 1]) for i, j in S.slices(offsets)]
        table = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.int64)
        S.release()
        return pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(len(FEATURES))], list(FEATURES))

    return count(text)


def _share(part: str, whole: str) -> Column:
    return F.col(f"f.{part}") / F.greatest(F.col(f"f.{whole}"), F.lit(1))


def _rule(value: Column, bad: Column, good: Column) -> Column:
    """0 for a vote against the document, 2 for a vote for it, 1 where the rule abstains."""
    return F.when(bad, 0).when(good, 2).otherwise(1)


def rules() -> dict[str, Column]:
    """Votes over the column ``f`` of features."""
    symbols, marks = _share("n_symbols", "n_words"), _share("n_marks", "n_words")
    capitals, repeats = _share("n_upper", "n_letters"), _share("n_repeat_words", "n_words")
    lines, letters = _share("n_dup_lines", "n_lines"), _share("n_letters", "word_chars")
    length = _share("word_chars", "n_words")
    return {
        "symbols": _rule(symbols, symbols >= 0.2, symbols <= 0.02),
        "marks": _rule(marks, marks >= 0.3, marks <= 0.05),
        "capitals": _rule(capitals, capitals >= 0.4, capitals <= 0.1),
        "repeats": _rule(repeats, repeats >= 0.4, repeats <= 0.1),
        "lines": _rule(lines, (lines >= 0.4) & (F.col("f.n_dup_lines") >= 3), (lines <= 0.1) & (F.col("f.n_lines") >= 3)),
        "letters": _rule(letters, letters < 0.5, letters >= 0.7),
        "length": _rule(length, (length < 2) | (length > 14), (length >= 3) & (length <= 10)),
    }


# The chance of a vote against, among the votes that a rule casts, before any document is seen, and the weight of that
# belief in multiples of the rows: the rules are written so that clean documents hardly ever break one, which is held
# firmly, while a poor document breaks one or another, which is held loosely. Without this, two rules that always agree
# would claim the second class for themselves. Whether a rule abstains says nothing about quality.
CLEAN_BREAKS, CLEAN_WEIGHT = 0.002, 10.0
POOR_BREAKS, POOR_WEIGHT = 0.2, 0.05


def fit_votes(patterns: dict[tuple[int, ...], int], rounds: int = 500, tol: float = 1e-9) -> dict[tuple[int, ...], float]:
    """The posterior probability of quality of each vote pattern, by expectation maximisation.

    Two classes and, for each rule and class, the chance of a vote against; documents weigh by their pattern's count.
    Stops when no posterior moves by more than ``tol``; without rows the result is empty.
    """
    if not patterns:
        return {}
    votes = np.array(list(patterns), np.int64)
    weight = np.array(list(patterns.values()), float)
    n, m = weight.sum(), votes.shape[1]
    good = np.where((votes == 0).any(axis=1), 0.05, 0.95)
    held = np.array([POOR_WEIGHT, CLEAN_WEIGHT]) * n
    prior = np.array([POOR_BREAKS, CLEAN_BREAKS]) * held
    for _ in range(rounds):
        both = np.stack([1 - good, good]) * weight
        share = (both.sum(axis=1) + 0.01 * n) / (1.02 * n)
        logs = np.log(share)[:, None] + np.zeros((2, len(votes)))
        for rule in range(m):
            against, cast = votes[:, rule] == 0, votes[:, rule] != 1
            chance = (both[:, against].sum(axis=1) + prior) / (both[:, cast].sum(axis=1) + held)
            logs += np.where(cast, np.where(against, np.log(chance)[:, None], np.log1p(-chance)[:, None]), 0)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        moved, good = np.abs(new - good).max(), new
        if moved < tol:
            break
    return dict(zip(patterns, good.tolist(), strict=True))


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``f`` (features), ``p_quality``, ``base_failed`` and ``kept`` added.

    One pass counts the vote patterns (at most 3 ** rules rows, whatever the input), the second applies the fit.
    """
    names = list(rules())
    code = sum((vote * F.lit(3**i) for i, vote in enumerate(rules().values())), F.lit(0))
    coded = docs.withColumn("f", features(F.col(text))).withColumn("_votes", code)
    counts = {r["_votes"]: r["n"] for r in coded.groupBy("_votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = {tuple(c // 3**i % 3 for i in range(len(names))): n for c, n in sorted(counts.items())}
    fitted = fit_votes(patterns)
    rows = [(sum(v * 3**i for i, v in enumerate(p)), q) for p, q in fitted.items()] or [(-1, 0.5)]
    table = small_table(docs.sparkSession, "_votes int, p_quality double", rows)
    failed = (F.col("f.n_words") < 50) | (100 * F.col("f.n_repeat_words") > 50 * F.col("f.n_words"))
    return (
        coded.join(F.broadcast(table), "_votes", "left").drop("_votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= threshold))
    )


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    return judge(packed).where("kept").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, the base verdict, the posterior and the verdict."""
    out = judge(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", *[F.col(f"f.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept", "p_quality",
    )
