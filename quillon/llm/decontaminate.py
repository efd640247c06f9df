"""Operator 1: benchmark decontamination with DataFrame functions only.

Words: A-Z lower-cased, then the maximal runs outside ASCII non-alphanumerics.
A window is WINDOW consecutive words of an item; an item of fewer words, but not
none, is one window. A word of a document is hit if it lies in an occurrence of
a window.

Probing every position of a document with every window length would hash each
word many times. Instead each window length L has seeds of k words so short that
any occurrence of the window holds a whole seed at a position divisible by
L - k + 1; documents are probed at those positions alone (every 8th word for
windows of 13), the items at all of theirs. The seeds of the items are a
broadcast hash table while their number is at most MOST_BROADCAST_SEEDS, else
both sides are shuffled on the seed's hash and a salt, so that the probes of a
common phrase meet in SALTS tasks; the rows that stand for documents are dealt
evenly. Each seed hit is verified word by word: it is stretched to both sides,
and counts where it reaches a whole window.

Null and wordless texts have no words and no hits; wordless items have no
windows; items of equal words are one item with several ids. Rows with equal
doc_id are reported row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

WINDOW = 13
MOST_BROADCAST_SEEDS = 200_000
SALTS = 8  # parts of a probe's hash where both sides are shuffled
SHARE = 20  # a document is contaminated if SHARE * n_hit >= n_words

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD_PATTERN), F.lit(0))


@dataclass(frozen=True)
class Tier:
    """Windows of least to most words, their seeds' length and the distance of probes."""

    least: int
    most: int
    k: int
    stride: int

    @property
    def reach(self) -> int:
        """Words of a window beside a seed, at most."""
        return self.most - self.k


def tiers(window: int) -> list[Tier]:
    """One tier for whole windows, then short items by halves: 13, 12-7, 6-4, 3-2, 1 for a window of 13."""
    out, most, least = [], window, window
    while most >= 1:
        k = max(1, least // 2)
        out.append(Tier(least, most, k, least - k + 1))
        most = least - 1
        least = most // 2 + 1
    return out


def seed_hash(tier: Tier, seed: Column) -> Column:
    return F.xxhash64(F.lit(tier.k), seed)


def item_seeds(benchmark: DataFrame, key: str, text: str, window: int, levels: list[Tier]) -> DataFrame:
    """One row for each seed of each distinct item: hash, k, seed, and the words to both sides, nearest first."""
    items = (
        benchmark.select(F.col(key).cast("string").alias("id"), words(F.col(text)).alias("w"))
        .where(F.size("w") > 0)
        .groupBy("w")
        .agg(F.array_sort(F.collect_set("id")).alias("ids"))
        .withColumn("len", F.least(F.size("w"), F.lit(window)))
    )
    parts = []
    for t in levels:
        own = items.where(F.col("len").between(t.least, t.most))
        own = own.withColumn("q", F.explode(F.sequence(F.lit(0), F.size("w") - t.k)))
        reach = F.col("len") - t.k
        before = F.least(reach, F.col("q"))
        parts.append(
            own.select(
                F.slice("w", F.col("q") + 1, F.lit(t.k)).alias("seed"),
                F.lit(t.k).alias("k"),
                F.col("len"),
                "ids",
                F.reverse(F.slice("w", F.col("q") + 1 - before, before)).alias("left"),
                F.slice("w", F.col("q") + 1 + t.k, reach).alias("right"),
            ).withColumn("h", seed_hash(t, F.col("seed")))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def probes(levels: list[Tier]) -> Column:
    """Seeds of a document with words w: struct(p, h), and one with p = -1 that stands for the document."""
    n = F.size("w")
    out = [F.array(F.struct(F.lit(-1).alias("p"), F.lit(None).cast("long").alias("h")))]

    def of(t: Tier) -> Column:
        at = F.sequence(F.lit(0), n - t.k, F.lit(t.stride))
        return F.transform(at, lambda i: F.struct(i.alias("p"), seed_hash(t, F.slice("w", i + 1, F.lit(t.k))).alias("h")))

    out += [F.when(n >= t.k, of(t)) for t in levels]
    none = F.array().cast("array<struct<p:int,h:bigint>>")
    return F.concat(*(F.coalesce(x, none) for x in out))


def stretch(reach: int, ours, theirs) -> Column:
    """Words, at most reach, that agree one after the other."""
    out: Column = F.lit(0)
    for j in reversed(range(reach)):
        out = F.when(ours(j) == theirs(j), F.lit(1) + out).otherwise(F.lit(0))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, most_broadcast: int = MOST_BROADCAST_SEEDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (sorted strings), spans (of word positions)."""
    present = benchmark.select(F.size(words(F.col(item_text))).alias("n")).where("n > 0")
    lengths = [r[0] for r in present.select(F.least("n", F.lit(window)).alias("n")).distinct().collect()]  # at most `window` rows
    levels = [t for t in tiers(window) if any(t.least <= n <= t.most for n in lengths)]
    rows = docs.select(F.col(key).alias("doc_id"), words(F.coalesce(F.col(text), F.lit(""))).alias("w")).withColumn("rid", F.monotonically_increasing_id())
    rows = rows.withColumn("n_words", F.size("w").cast("long")).withColumn("probes", probes(levels))
    rows = rows.select("doc_id", "rid", "n_words", "w", F.explode("probes").alias("x")).select("doc_id", "rid", "n_words", "w", "x.p", "x.h")
    if levels:
        seeds = item_seeds(benchmark, item_key, item_text, window, levels)
        reach, k_most = max(t.reach for t in levels), max(t.k for t in levels)
        around = F.slice("w", F.greatest(F.col("p") + 1 - reach, F.lit(1)), F.lit(k_most + 2 * reach))
        shift = F.col("p") - F.greatest(F.col("p") - reach, F.lit(0))  # where the probe stands in `around`
        if seeds.limit(most_broadcast + 1).count() <= most_broadcast:
            met = rows.join(F.broadcast(seeds), "h", "left").where("p = -1 or k is not null")
            met = met.withColumn("c", F.when(F.col("p") >= 0, around)).drop("w")
        else:
            # documents' own rows have no hash: they get one of their own, and a condition that no seed meets
            dealt = rows.withColumn("c", F.when(F.col("p") >= 0, around)).drop("w")
            dealt = dealt.withColumns({"h": F.coalesce("h", F.xxhash64("rid")), "salt": F.pmod(F.xxhash64("rid", "p"), F.lit(SALTS)).cast("int")})
            salted = seeds.withColumnRenamed("h", "seed_h").withColumn("seed_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            same = (F.col("h") == F.col("seed_h")) & (F.col("salt") == F.col("seed_salt")) & (F.col("p") >= 0)
            met = dealt.join(salted, same, "left").where("p = -1 or k is not null")
        met = met.withColumn("at", shift)
        met = met.withColumn("l", stretch(reach, lambda j: F.get("c", F.col("at") - 1 - j), lambda j: F.get("left", F.lit(j))))
        met = met.withColumn("r", stretch(reach, lambda j: F.get("c", F.col("at") + F.col("k") + j), lambda j: F.get("right", F.lit(j))))
        true_hit = (F.slice("c", F.col("at") + 1, F.col("k")) == F.col("seed")) & (F.col("l") + F.col("k") + F.col("r") >= F.col("len"))
        met = met.where((F.col("p") == -1) | true_hit)
        span = F.when(F.col("p") >= 0, F.struct((F.col("p") - F.col("l")).alias("lo"), (F.col("p") + F.col("k") + F.col("r")).alias("hi")))
        found = F.when(F.col("p") >= 0, F.col("ids"))
    else:
        met, span = rows, F.lit(None).cast("struct<lo:int,hi:int>")
        found = F.lit(None).cast("array<string>")
    grouped = met.groupBy("rid", "doc_id", "n_words").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(found)))).alias("item_ids"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    covered = F.aggregate(
        "spans", start,
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(x["lo"], a["reach"]))).alias("n"), F.greatest(a["reach"], x["hi"]).alias("reach")),
        lambda a: a["n"],
    )
    return grouped.select("doc_id", "n_words", covered.cast("long").alias("n_hit"), "item_ids", "spans")


def is_contaminated(share: int = SHARE) -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest of hits() per document."""
    return hits(docs, benchmark, **options).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """docs without the contaminated documents (by key), all columns kept."""
    (name,) = fresh(docs, "__bad")
    bad = hits(docs, benchmark, key=key, **options).where(is_contaminated()).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad[name]), "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs whose hit words are cut out of the text, each with the separators after it. Needs distinct keys."""
    found = hits(docs, benchmark, key=key, text=text, **options).where("n_hit > 0").select("doc_id", "spans")
    return _cut(docs, found, key, text)


def without_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """keep_clean(), with the hit words of the documents that stay cut out as by without_spans(); keys may repeat."""
    own, name = fresh(docs, "__id", "__bad")
    keyed = docs.withColumn(own, F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash")))
    found = hits(keyed, benchmark, key=own, text=text, **options).where("n_hit > 0")
    found = written(found.groupBy("doc_id").agg(F.first("spans").alias("spans"), F.max(is_contaminated()).alias("bad")), "benchmark-hits")
    bad = found.where("bad").select(F.col("doc_id.key").alias(name)).distinct()
    left = keyed.join(bad, keyed[key].eqNullSafe(bad[name]), "left_anti")
    return _cut(left, found.where("not bad").drop("bad"), own, text).drop(own)


def _cut(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """docs without the words of found's spans, by key (found's doc_id)."""
    one = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    other, spans = fresh(docs, "__key", "__spans")
    parts = F.regexp_extract_all(F.col(text), F.lit(one), F.lit(0))
    head = F.regexp_extract(F.col(text), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.filter(parts, lambda _, i: ~F.exists(spans, lambda s: (i >= s["lo"]) & (i < s["hi"])))
    found = found.select(F.col("doc_id").alias(other), F.col("spans").alias(spans))
    joined = docs.join(found, docs[key].eqNullSafe(found[other]), "left")
    return joined.withColumn(text, F.when(F.col(spans).isNotNull(), F.concat(head, F.array_join(kept, ""))).otherwise(F.col(text))).select(*docs.columns)
