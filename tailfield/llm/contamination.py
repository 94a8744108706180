"""Benchmark decontamination with a positional inverted index of the training texts, in DataFrame operations only.

The index holds postings (term, doc, position) of the terms that the searches start from: for each window of ten item
words, its ``SEEDS`` rarest terms by their count in all training texts. A posting less the term's offset in the item is an
alignment of item and document; a window is a candidate where all its indexed terms have postings of one alignment, and
a match where all its words are there. Proximity matches need the indexed terms only, at shifted alignments.

Words are runs of 0-9, A-Z, a-z and characters beyond ASCII; A-Z count as a-z, other letters as they are.

Defined results: null and empty texts have no words, no hits, and match nothing; items without words are not searched;
an item of fewer than ten words is one window; repeated document rows are counted once each but share their hits;
rows that share an id are each judged by their own words, and rows without an id by theirs; item ids may repeat, each
row is then an item; empty tables give no hits and one row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailfield.llm.store import stored

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, SEEDS = 10, 2
BROADCAST_ROWS = 200_000  # benchmark-side tables of at most so many rows are broadcast, larger ones are shuffled
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    """Words as written; an empty string stands first or last where a gap does."""
    return F.split(F.coalesce(text, F.lit("")), GAP)


def _lead(raw: Column) -> Column:
    return F.when(raw[0] == "", 1).otherwise(0)


def n_words(raw: Column) -> Column:
    """Words in the result of ``split_words``."""
    last = F.when((F.size(raw) > 1) & (F.element_at(raw, -1) == ""), 1).otherwise(0)
    return (F.size(raw) - _lead(raw) - last).cast("bigint")


def ascii_lower(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def exact_words(text: Column) -> Column:
    """Words with A-Z lowered."""
    return F.filter(split_words(ascii_lower(text)), lambda w: w != "")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``: the id, or a hash of the text without one. A clash costs a comparison, never a result."""
    return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")))


def _sized(table: DataFrame) -> DataFrame:
    """Marks a stored table for broadcast if it is small; sampling its rows stops at the bound."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _tokens(docs: DataFrame) -> DataFrame:
    """``_key``, ``position`` and ``term`` of every word; the term has all letters lowered, to be checked later."""
    raw = keyed(docs).select("_key", split_words(F.col("text")).alias("raw"))
    return raw.select("_key", _lead(F.col("raw")).alias("lead"), F.posexplode("raw").alias("at", "word")).where("word <> ''").select(
        "_key", (F.col("at") - F.col("lead")).alias("position"), F.lower("word").alias("term")
    )


def item_words(items: DataFrame) -> DataFrame:
    """``item`` (a number of its own for each row), ``item_id`` and ``words`` of the items that have words."""
    return items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", exact_words(F.col("text")).alias("words")).where("size(words) > 0").distinct()


def _windows(words: DataFrame, window: int) -> DataFrame:
    """``item``, ``start``, ``length``, ``offset`` and ``term`` of every word of every window."""
    span = F.least(F.size("words"), F.lit(window))
    starts = words.select("item", "words", span.alias("length"), F.explode(F.sequence(F.lit(0), F.size("words") - span)).alias("start"))
    return starts.select("item", "start", "length", F.posexplode(F.slice("words", F.col("start") + 1, F.col("length"))).alias("at", "word")).select(
        "item", "start", "length", (F.col("start") + F.col("at")).alias("offset"), F.lower("word").alias("term")
    )


def build_index(docs: DataFrame, words: DataFrame, window: int = WINDOW, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """The stored postings (``_key``, ``position``, ``term``) and the needed terms of each window.

    Terms are counted over all training words, folded before the shuffle. The vocabulary and the chosen terms belong to
    the benchmark and do not grow with the training texts.
    """
    in_window = stored(_windows(words, window))
    vocabulary = _sized(stored(in_window.select("term").distinct()))
    tokens = _tokens(docs)
    counts = tokens.select("term").join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rated = in_window.join(counts, "term", "left").select("item", "start", "length", "offset", "term", F.coalesce("n", F.lit(0)).alias("n"))
    ranked = rated.groupBy("item", "start", "length").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("all"))
    needed = stored(ranked.where(F.col("all")[0]["n"] > 0).select("item", "start", "length", F.slice("all", 1, seeds).alias("seeds")))
    chosen = _sized(stored(needed.select(F.explode("seeds.term").alias("term")).distinct()))
    return stored(tokens.join(chosen, "term", "left_semi")), needed


def alignments(index: DataFrame, needed: DataFrame) -> DataFrame:
    """``_key``, ``item``, ``shift`` and the ``found`` item offsets whose terms are at shift + offset.

    Lists are met by alignment, so a document or a term with very many postings is spread over its alignments.
    """
    seeds = _sized(needed.select("item", F.explode("seeds").alias("seed")).select("item", F.col("seed.offset").alias("offset"), F.col("seed.term").alias("term")).distinct())
    met = index.join(seeds, "term").select("_key", "item", (F.col("position") - F.col("offset")).alias("shift"), "offset").distinct()
    return met.groupBy("_key", "item", "shift").agg(F.collect_list("offset").alias("found"))


def candidates(index: DataFrame, needed: DataFrame) -> DataFrame:
    """``_key``, ``item``, ``shift`` and the windows (``start``, ``length``) all of whose indexed terms are in place."""
    lists = needed.groupBy("item").agg(F.collect_list(F.struct("start", "length", F.col("seeds.offset").alias("offsets"))).alias("windows"))
    lists = _sized(lists)
    joined = alignments(index, needed).join(lists, "item")
    whole = F.filter("windows", lambda w: F.size(F.array_except(w["offsets"], F.col("found"))) == 0)
    near = F.filter(whole, lambda w: F.col("shift") + w["start"] >= 0)
    return joined.select("_key", "item", "shift", F.transform(near, lambda w: F.struct(w["start"].alias("start"), w["length"].alias("length"))).alias("windows")).where("size(windows) > 0")


def proximity_matches(index: DataFrame, needed: DataFrame, slack: int) -> DataFrame:
    """``_key``, ``item``, ``start`` of windows whose other indexed terms lie within ``slack`` words of where the rarest one puts them."""
    seeds = needed.select("item", "start", F.size("seeds").alias("n"), F.posexplode("seeds").alias("rank", "seed"))
    met = index.join(seeds.select("item", "start", "n", "rank", F.col("seed.offset").alias("offset"), F.col("seed.term").alias("term")), "term")
    met = met.select("_key", "item", "start", "n", "rank", (F.col("position") - F.col("offset")).alias("shift"))
    met = met.withColumn("bin", F.floor(F.col("shift") / (slack + 1)))
    rarest = met.where("rank = 0").select("_key", "item", "start", "n", F.col("shift").alias("at"), F.explode(F.array(*[F.col("bin") + k for k in (-1, 0, 1)])).alias("bin"))
    others = met.where("rank > 0").select("_key", "item", "start", "rank", "shift", "bin")
    found = rarest.join(others, ["_key", "item", "start", "bin"], "left").withColumn("near", F.when(F.abs(F.col("shift") - F.col("at")) <= slack, F.col("rank")))
    counted = found.groupBy("_key", "item", "start", "at", "n").agg(F.countDistinct("near").alias("terms"))
    return counted.where("terms = n - 1").select("_key", "item", "start").distinct()


def phrase_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, seeds: int = SEEDS) -> DataFrame:
    """``docs`` with ``n_words`` and ``hits``: for each matching window its first word, length and item id."""
    words = stored(item_words(items))
    index, needed = build_index(docs, words, window, seeds)
    tried = candidates(index, needed).join(words, "item").select(
        "_key", F.struct("item_id", "shift", "windows", "words").alias("one")
    ).groupBy("_key").agg(F.collect_list("one").alias("tried"))
    held = keyed(docs).join(tried, "_key", "left").withColumn("_raw", split_words(F.col("text"))).withColumn("n_words", n_words(F.col("_raw")))
    plain = F.when(F.col("tried").isNotNull(), exact_words(F.col("text")))
    held = held.withColumn("_words", plain).drop("_raw")

    def same(one: Column) -> Column:
        def here(w: Column) -> Column:
            return F.slice(F.col("_words"), one["shift"] + w["start"] + 1, w["length"]) == F.slice(one["words"], w["start"] + 1, w["length"])

        return F.transform(
            F.filter(one["windows"], here),
            lambda w: F.struct((one["shift"] + w["start"]).alias("first"), w["length"].alias("length"), one["item_id"].alias("item_id")),
        )

    return held.withColumn("hits", F.array_sort(F.flatten(F.transform("tried", same)))).drop("_words", "tried", "_key")


def n_hit(hits: Column) -> Column:
    """Words inside any hit; hits are in order of their first word."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to"))

    def add(state: Column, hit: Column) -> Column:
        end = hit["first"] + hit["length"]
        new = F.greatest(end - F.greatest(state["to"], hit["first"]), F.lit(0))
        return F.struct((state["n"] + new).alias("n"), F.greatest(state["to"], end).alias("to"))

    return F.coalesce(F.aggregate(hits, start, add, lambda s: s["n"]), F.lit(0).cast("bigint"))


def decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: words, words inside matches, items with matches, their digest, and the verdict."""
    found = phrase_hits(docs.select("doc_id", "text"), items)
    ids = F.coalesce(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"].cast("string")))), F.array().cast("array<string>"))
    counted = found.select("doc_id", "n_words", n_hit(F.col("hits")).alias("n_hit"), ids.alias("ids"))
    return counted.select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any match."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    found = phrase_hits(packed, items).where(F.coalesce(F.size("hits"), F.lit(0)) <= 0)
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
