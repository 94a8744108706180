"""URL rules and lists behind a Bloom filter cascade that is exact over a known universe of keys.

Level 1 holds the listed keys, level 2 the keys of the universe that level 1 takes wrongly, level 3 the listed keys that
level 2 takes, and so on until nothing is taken wrongly. A key of the universe is listed if the first level that misses it
is an even one, or if it passes all of an odd number. Filters are built from distinct (word, bits) rows folded before the
shuffle; a task gets the filters whole, so their size is bounded: more keys than ``LEVEL_KEYS`` are dealt into parts by
hash, each with a cascade of its own, and the parts are asked one after another.

Defined results: a null url, or one without "://", has an empty host and path and fits no rule; the longest fitting rule
wins; repeated rows are judged one by one; very long urls are judged whole; an empty table, list or universe gives
verdicts by the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailfield.llm.store import stored
from tailfield.session import small_table

FIRST_RATE, NEXT_RATE = 0.02, 0.5  # shares taken wrongly at level 1 and at the later levels
LEVEL_KEYS = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lowered."""
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


class Cascade:
    """The levels of one part: (bits as 64-bit words, hash count)."""

    def __init__(self, levels: list[tuple[np.ndarray, int]]) -> None:
        self.levels = levels

    def listed(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether the keys with these two 64-bit hashes are listed."""
        out = np.full(len(one), len(self.levels) % 2 == 1)
        open_ = np.arange(len(one))
        for level, (words, probes) in enumerate(self.levels, 1):
            taken = np.ones(len(open_), bool)
            for k in range(probes):
                at = _places(one[open_], two[open_], level, k, len(words) * 64)
                taken &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            out[open_[~taken]] = level % 2 == 0
            open_ = open_[taken]
        return out


def _places(one: np.ndarray, two: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    """The bit of a probe; levels are independent of each other."""
    x = one + two * np.uint64(2 * (probe + 1) + 1) + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) % np.uint64(bits)


def _shape(keys: int, rate: float) -> tuple[int, int]:
    """Words of 64 bits, and probes, for so many keys."""
    probes = max(1, round(-np.log2(rate)))
    return max(1, int(np.ceil(keys * probes / np.log(2) / 64))), probes


def _build(keys: DataFrame, count: int, level: int, rate: float) -> tuple[np.ndarray, int]:
    """A filter of distinct keys (``h1``, ``h2``): each task folds its keys to words, words are joined in the shuffle."""
    size, probes = _shape(count, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(size, np.uint64)
        for batch in batches:
            one, two = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            for k in range(probes):
                at = _places(one, two, level, k, size * 64)
                np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], ["word", "bits"])

    rows = keys.select("h1", "h2").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words, probes


def _taken(keys: DataFrame, words: np.ndarray, probes: int, level: int) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            keep = np.ones(len(one), bool)
            for k in range(probes):
                at = _places(one, two, level, k, len(held.value) * 64)
                keep &= (held.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            yield batch.filter(pa.array(keep))

    return keys.mapInArrow(run, keys.schema)


def build_cascades(listed: DataFrame, universe: DataFrame, key: str = "key") -> list[Cascade]:
    """Cascades that are exact for ``universe`` and ``listed`` (distinct strings in ``key``), one for each part."""
    hashed = [_hashed(x, key).distinct() for x in (listed, universe)]
    inside = stored(hashed[0])
    outside = stored(hashed[1].join(inside, ["h1", "h2"], "left_anti"))
    parts = max(1, -(-max(inside.count(), 1) // LEVEL_KEYS))
    return [_one_cascade(_part(inside, k, parts), _part(outside, k, parts)) for k in range(parts)]


def _hashed(keys: DataFrame, key: str) -> DataFrame:
    return keys.where(F.col(key).isNotNull()).select(F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"))


def _part(keys: DataFrame, k: int, parts: int) -> DataFrame:
    return keys if parts == 1 else keys.where(F.pmod("h1", F.lit(parts)) == k)


def _one_cascade(inside: DataFrame, outside: DataFrame) -> Cascade:
    levels, left, right = [], inside, outside
    count = left.count()
    while count:
        level = len(levels) + 1
        rate = FIRST_RATE if level == 1 else NEXT_RATE
        words, probes = _build(left, count, level, rate)
        levels.append((words, probes))
        left, right = stored(_taken(right, words, probes, level)), left
        count = left.count()
    return Cascade(levels)


def listed(frame: DataFrame, keys: Column, cascades: list[Cascade]) -> Column:
    """Whether each of an array of keys is listed, as an array of booleans; all keys must be of the universe or listed."""
    held = frame.sparkSession.sparkContext.broadcast(cascades)

    @F.arrow_udf("array<boolean>")
    def ask(one: pa.Array, two: pa.Array) -> pa.Array:
        a, b = (x.flatten().to_numpy().view(np.uint64) for x in (one, two))
        out, parts = np.zeros(len(a), bool), len(held.value)
        part = (a.view(np.int64) % parts) if parts > 1 else np.zeros(len(a), np.int64)
        for k, cascade in enumerate(held.value):
            mine = part == k
            out[mine] = cascade.listed(a[mine], b[mine])
        sizes = np.concatenate([[0], np.cumsum(one.value_lengths().fill_null(0).to_numpy())])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(out))

    return ask(F.transform(keys, lambda k: F.xxhash64(F.lit(1), k)), F.transform(keys, lambda k: F.xxhash64(F.lit(2), k)))


def suffixes(host: Column) -> Column:
    """The host and what follows each of its dots: the hosts whose rules reach it."""
    parts = F.split(host, r"\.")
    all_ = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.filter(all_, lambda s: s != ""))


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every rule that could fit: suffix and path start, for the path lengths that rules have; longest first."""
    starts = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths), reverse=True)]), lambda x: x.isNotNull())
    both = F.flatten(F.transform(suffixes(host), lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    return F.sort_array(F.transform(F.array_distinct(both), lambda k: F.struct(F.char_length(k).alias("n"), k.alias("key"))), asc=False)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], blocked_hosts: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are (verdict, host, path) and decide where one fits. Elsewhere a host of the list ``blocked_hosts`` (``key``)
    is blocked, and any other gets ``default``. Both are looked up in cascades over all keys of the pages.
    """
    spark = pages.sparkSession
    named = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rules = list(dict.fromkeys(rules))
    tried = rule_keys(F.col("host"), F.col("path"), [len(p) for _, _, p in rules])
    keys = F.transform(tried, lambda x: x["key"])
    universe = named.select(F.explode(keys).alias("key")).distinct()
    own = small_table(spark, "key string", [(h + p,) for _, h, p in rules])
    hosts = named.where("host <> ''").select(F.col("host").alias("key")).distinct()
    by_rule, by_host = build_cascades(own, universe), build_cascades(blocked_hosts, hosts)
    allowed = [h + p for v, h, p in rules if v == "allow"]
    found = named.withColumn("_keys", keys).withColumn("_hit", listed(named, F.col("_keys"), by_rule)).withColumn(
        "_host", listed(named, F.array("host"), by_host)[0]
    )
    first = F.array_position("_hit", True)
    rule = F.when(first > 0, F.try_element_at("_keys", first.cast("int")))
    verdict = F.when(F.col("rule").isin(allowed), "allow").when(F.col("rule").isNotNull(), "block")
    verdict = verdict.when((F.col("host") != "") & F.col("_host"), "block").otherwise(default)
    return found.withColumn("rule", rule).withColumn("verdict", verdict).drop("_keys", "_hit", "_host")


# The rules of the query (verdict, host, path).
RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]
# Words whose presence between the dots and hyphens of a host puts it on the list of the query.
LISTED_WORDS = ("spam", "ads", "adult", "bets", "casino", "malware", "phishing", "pills", "porn", "warez", "xxx")


def listed_hosts(pages: DataFrame) -> DataFrame:
    """``key``: the hosts of the pages that hold one of ``LISTED_WORDS`` as a word."""
    hosts = pages.select(host_of(F.col("url")).alias("key")).distinct()
    return hosts.where(F.arrays_overlap(F.split("key", r"[.\-]"), F.array(*[F.lit(w) for w in LISTED_WORDS])))


def url_filters(pages: DataFrame) -> DataFrame:
    """One row per page: host, path, the rule that decides, and the verdict."""
    found = judge(pages.select("page_id", "url"), RULES, listed_hosts(pages))
    return found.select("page_id", "host", "path", "rule", "verdict")
