"""Grouping of spelling variants: words one edit apart, found by an index of variable-length grams.

A word is read between two marks, ``^word$``. The dictionary holds the grams at the marks, pruned by frequency: a gram grows
from its mark only while more than ``LIST`` words share it, so that

- each word has a first gram, its shortest start that at most ``LIST`` words share, and a last gram, likewise at its end;
- an edit affects the grams that cover its place. The bounds of a word say which places are affected in both grams: from
  where the last gram starts to where the first one ends. Elsewhere one gram stays, and a near word is in that gram's list;
- at the places where both are affected, the lists of what is left of the place and right of it are long, but a near word is
  in both. Their merge is looked up as one key; it holds words with one letter between the two, or none.

Lists have at most ``LIST`` words, merged ones at most one word a letter, so pairs are compared within bounded lists, in the
join itself, and only near ones leave it. A pair is reported by its first gram, else its last gram, else one merged key.

Defined results: a null or empty text has no words; a null id counts as an empty id in the hash; repeated rows count again;
words may have any length; equal counts of near words are settled by code-point order; no words give no rows; the operator
reads the id and text columns only, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailfield.llm.store import stored
from tailfield.llm.urls import LOWER, UPPER

PATTERN = "[A-Za-zÀ-ÿ]+"
LIST = 128
SHORTEST, LEAST, DAMAGED = 5, 3, 97
BROADCAST_ROWS = 1 << 18


def _small(rows: DataFrame) -> DataFrame:
    """Marks a stored table of short rows for broadcast if it has few of them; larger ones meet by a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def damaged(ident: Column, word: Column) -> Column:
    """``word`` without one code point where the hash of id and word is a multiple of ``DAMAGED``."""
    h = F.crc32(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % DAMAGED == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` of the words that are long and frequent enough."""
    lower = F.translate("text", UPPER, LOWER)
    found = docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all(lower, F.lit(PATTERN), F.lit(0))).alias("run"))
    words = found.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def _growing(words: DataFrame) -> DataFrame:
    """All grams at the two marks: ``word``, whether it is at the start, its size and the gram with its mark."""
    size = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("size")
    each = words.select("word", size).select("word", "size", F.explode(F.array(
        F.struct(F.lit(True).alias("first"), F.concat(F.lit("^"), F.substring("word", F.lit(1), F.col("size"))).alias("gram")),
        F.struct(F.lit(False).alias("first"), F.concat(F.substring("word", F.length("word") - F.col("size") + 1, F.col("size")), F.lit("$")).alias("gram")))).alias("x"))
    return each.select("word", "size", "x.first", "x.gram")


def bounded(words: DataFrame, limit: int = LIST) -> DataFrame:
    """``words`` with ``q`` and ``r``, the sizes of first and last gram (one more than the word where none is rare enough)."""
    grams = _growing(words)
    common = stored(grams.groupBy("gram").agg(F.count("*").alias("lists")).where(F.col("lists") > limit).select("gram"))
    reach = grams.join(_small(common), "gram", "left_semi").groupBy("word").agg(
        F.max(F.when(F.col("first"), F.col("size"))).alias("a"), F.max(F.when(~F.col("first"), F.col("size"))).alias("b"))
    return words.join(reach, "word", "left").select("word", "n", (F.coalesce("a", F.lit(0)) + 1).alias("q"), (F.coalesce("b", F.lit(0)) + 1).alias("r"))


def signatures(words: DataFrame) -> DataFrame:
    """The keys of each word: its first gram, its last gram, and merged keys for the places where an edit affects both.

    ``kind`` is 0 for first, 1 for last grams, 2 for a letter's place and 3 for a place between letters. ``end`` marks the last
    of equal letters in a row, the one place by which a longer word is reported.
    """
    w, size = F.col("word"), F.length("word")
    start = size - F.col("r")  # of the last gram; -1 where it is the whole word with its mark
    first, last = F.concat(F.lit("^"), F.substring(w, F.lit(1), F.col("q")), F.when(F.col("q") > size, "$").otherwise("")), F.concat(
        F.when(start < 0, "^").otherwise(""), F.substring(w, F.greatest(start, F.lit(0)) + 1, size), F.lit("$"))
    head = lambda i: F.substring(w, F.lit(1), i)
    tail = lambda i: F.substring(w, i + 1, size)
    key = lambda text, kind, end: F.struct(text.alias("key"), F.lit(kind).alias("kind"), end.alias("end"))
    yes, none = F.lit(True), F.array().cast("array<struct<key:string,kind:int,end:boolean>>")

    def places(low: Column, high: Column, make) -> Column:
        return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), make)).otherwise(none)

    letters = places(F.greatest(start, F.lit(0)), F.least(F.col("q"), size) - 1, lambda i: key(
        F.concat(head(i), F.lit("*"), tail(i + 1)), 2, F.substring(w, i + 1, F.lit(1)) != F.substring(w, i + 2, F.lit(1))))
    between = places(start + 1, F.least(F.col("q") - 1, size), lambda j: key(F.concat(head(j), F.lit("*"), tail(j)), 3, yes))
    keys = F.concat(F.when(F.col("q") <= size, F.array(key(first, 0, yes))).otherwise(none), F.when(start >= 0, F.array(key(last, 1, yes))).otherwise(none), letters, between)
    return words.select("word", "n", first.alias("a"), last.alias("z"), F.explode(keys).alias("x")).select("word", "n", "a", "z", "x.key", "x.kind", "x.end")


def near_pairs(words: DataFrame, limit: int = LIST) -> DataFrame:
    """Pairs of words exactly one edit apart, each once: ``word`` < ``other``, with their counts ``n`` and ``m``."""
    keys = signatures(bounded(words, limit))
    one, two = keys.alias("one"), keys.alias("two")
    x, y = (lambda c: F.col(f"one.{c}")), (lambda c: F.col(f"two.{c}"))
    by_merge = F.when(F.length(x("word")) > F.length(y("word")), x("end")).when(F.length(x("word")) < F.length(y("word")), y("end")).otherwise(True)
    once = F.when(x("kind") == 0, True).when(x("a") == y("a"), False).when(x("kind") == 1, True).when(x("z") == y("z"), False).otherwise(by_merge)
    near = (x("key") == y("key")) & (x("word") < y("word")) & once & (F.levenshtein(x("word"), y("word"), 1) == 1)
    return one.join(two, near).select(x("word").alias("word"), x("n").alias("n"), y("word").alias("other"), y("n").alias("m"))


def last_forms(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of the words that have a form. Counts at least double along a path, so it has an end."""
    path = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = path.select(F.col("word").alias("root"), F.col("root").alias("then"))
        path = stored(path.join(onward, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")))
        if path.where("moved").isEmpty():
            return path.select("word", "root")
        path = path.select("word", "root")


def variants(words: DataFrame, limit: int = LIST) -> DataFrame:
    """``words`` (word, n) with the form, root, number of near words and the form's count."""
    pairs = stored(near_pairs(words, limit))
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("top"))
    fits = -F.col("top.m") >= 2 * F.col("n")
    found = stored(best.select("word", "n_near", F.when(fits, F.col("top.other")).alias("form"), F.when(fits, -F.col("top.m")).alias("form_n")))
    roots = last_forms(found.where("form IS NOT NULL"))
    whole = words.join(found, "word", "left").join(roots, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """All words of the documents with their forms and roots."""
    return variants(stored(vocabulary(docs)))
