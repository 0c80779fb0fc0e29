"""Links that fingerprints can't show: an exact set-similarity join of documents, with DataFrame functions only.

The join is that of line dedup, with a document for a line. It begins from groups that are known already (by SimHash),
links equal sets, then holds each set against the first set of each token of its prefix, and at last makes pairs of sets
in different groups only, so that a large group of near copies is not compared with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged
from .components import connected_components
from .setjoin import DENOMINATOR, FREQUENT_RANK, NUMERATOR, SHINGLE, among, hashed_words, headed, may_match, postings, prefix, ranked, rarity_buckets, rarity_table, shingles, similar, spaced, without, words_of


def worded(texts: DataFrame) -> DataFrame:
    """(id, hw) of texts (id, text), hw the hashes of the words in lower case; null text counts as empty."""
    flat = F.replace(spaced(F.lower(F.coalesce("text", F.lit("")))), F.lit("\n"), F.lit(" "))
    return texts.select("id", hashed_words(words_of(flat)).alias("hw"))


def merged(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """labels (id, component), the groups of linked (u, v) ids made one: component becomes the least of theirs."""
    u, v = (labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "uv")
    roots = connected_components(links.join(u, "u").join(v, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    out = labels.join(roots.select(F.col("node").alias("component"), "root"), "component", "left")
    return staged(out.select("id", F.coalesce("root", "component").alias("component")), name)


def similar_groups(texts: DataFrame, labels: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, k: int = SHINGLE) -> DataFrame:
    """labels (id, component), where groups are one if texts (id, text) of theirs have sets of k-word shingles of Jaccard similarity num / den or more.

    Words are in lower case and lie between ASCII white space; a text of fewer than k words has one token, all its words,
    and all texts without a word are alike. Null text counts as empty. component is the least id of the group. Ids of
    labels are those of texts, each once. An empty table gives no rows.
    """
    words = worded(texts)
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"]
    table = rarity_table(words, k, rarity_buckets(size or 0))
    tokens = F.col("tokens")
    rows = words.select("id", F.size("hw").alias("words"), shingles(k).alias("h")).select("id", "words", ranked("h", table).alias("tokens"))
    some = F.when(F.col("words") >= k, prefix(tokens, num, den)).otherwise(F.array().cast("array<long>"))
    rows = rows.select("id", "words", F.size(tokens).alias("n"), F.xxhash64(tokens).alias("h1"), F.xxhash64(F.lit(1), tokens).alias("h2"), some.alias("prefix"))
    rows = staged(rows, "near-sets")
    firsts = rows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("h1", "h2", "first")
    firsts = staged(firsts, "near-firsts")
    copies = staged(rows.select("h1", "h2", "id").join(firsts, ["h1", "h2"]).where("id > first").select("id", "first"), "near-copies")
    drop_staged(firsts)
    labels = merged(labels, copies.select(F.col("id").alias("u"), F.col("first").alias("v")), "near-labels")
    held = headed(postings(without(rows.where(F.col("words") >= k).select("id", "n", "prefix"), copies.select("id"), ["id"])), max(table) >= FREQUENT_RANK, "near")
    drop_staged(rows)

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (u, v) of different groups that are similar: their sets are made anew from the texts."""
        u, v = (labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "uv")
        pairs = staged(pairs.distinct().join(u, "u").join(v, "v").where("cu <> cv").select("u", "v"), f"{name}-pairs")
        need = staged(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), f"{name}-need")
        sets = staged(worded(among(texts.select("id", "text"), need, ["id"])).select("id", F.array_distinct(shingles(k)).alias("s")), f"{name}-sets")
        out = staged(similar(pairs, sets, num, den), f"{name}-links")
        for x in (pairs, need, sets):
            drop_staged(x)
        return out

    first = held.where(may_match("np", "head_np", num, den)).select(F.least("id", "head").alias("u"), F.greatest("id", "head").alias("v"))
    labels = merged(labels, linked(first, "near-first"), "near-labels")
    open_ = staged(held.select("token", "id", "np").join(labels, "id"), "near-open")
    drop_staged(held)
    # of each token, the group with most of its sets: others are held against all, it is not held against itself
    groups = open_.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("groups"))
    groups = staged(groups.where("groups > 1").select("token", "main"), "near-main")
    a = open_.join(groups, "token").where("component <> main").alias("a")
    b = open_.join(groups, "token").alias("b")
    once = (F.col("b.component") == F.col("b.main")) | (F.col("a.id") < F.col("b.id"))
    pairs = a.join(b, "token").where((F.col("a.component") != F.col("b.component")) & once & may_match("a.np", "b.np", num, den))
    return merged(labels, linked(pairs.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")), "near-rest"), "near-labels")
