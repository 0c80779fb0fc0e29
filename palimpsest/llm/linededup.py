"""Removal of repeated lines by an exact set-similarity join, with DataFrame functions only.

A line's tokens are its distinct five-word shingles, ordered by rarity over the corpus; prefixes are joined under the
positional and length filters, and what is left is verified by the Jaccard similarity of the sets themselves. A line has
one number, its document's number times a bound of lines plus its place, so that numbers rise in reading order
and rows of the join are a few plain numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, numbered, staged
from .setjoin import CODE, DENOMINATOR, FREQUENT_RANK, NUMERATOR, SHINGLE, STEPS, among, coded_shingles, coded_words, counted_table, head_size, headed, may_match, parted, postings, prefix, ranked, rare_as_one, rare_prefix, rare_token, rarity_buckets, similar, spaced


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, s) of each line of docs (id, text), id of a document being that of its first line."""
    lines = docs.select("id", F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("line", "s"))
    return lines.select((F.col("id") + F.col("line")).alias("id"), "s")


def lines_among(docs: DataFrame, ids: DataFrame, stride: int) -> DataFrame:
    """Those lines of docs whose id is in ids, each once there; texts that surely have none aren't split."""
    texts = parted(docs, ids.select((F.col("id") - F.pmod("id", F.lit(stride))).alias("id")), ["id"])[0]
    return among(lines_of(texts), ids, ["id"])


def repeated_lines(docs: DataFrame, text_bytes: int, stride: int, num: int = NUMERATOR, den: int = DENOMINATOR, k: int = SHINGLE) -> DataFrame:
    """id of every line of docs (id, text; ids are multiples of stride), of so many bytes of text, that is similar to a line of smaller id, each once.

    Equal token sets are compared once, as their first line. In a first round each set is held against the first line of
    each token of its prefix: as many pairs as postings, and large groups of near copies are mostly settled there. Only
    sets without a match are then compared with all lines before them.
    """
    def hashed(lines: DataFrame) -> DataFrame:
        """(id, words, h) of lines (id, s): the number of words, and the distinct hashes of shingles in order."""
        codes = lines.select("id", coded_words(F.col("s")).alias("code"))
        return codes.select("id", F.shiftright(F.octet_length("code"), CODE.bit_length() - 1).alias("words"), F.sort_array(F.array_distinct(coded_shingles("code", k))).alias("h"))

    n = F.size("h")
    # a line under k words is only like one of the same words, so it needs no postings
    head = F.when(F.col("words") >= k, F.slice("h", F.lit(1), head_size(n, num, den))).otherwise(F.array().cast("array<long>"))
    lines = hashed(lines_of(docs)).select("id", "words", n.alias("n"), F.xxhash64("h").alias("h1"), F.xxhash64(F.lit(1), "h").alias("h2"), head.alias("head"))
    lines = staged(lines, "lines").where("words > 0")
    firsts = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("h1", "h2", "first")
    firsts = staged(firsts, "firsts")  # else the join would use the aggregate's partitions, and Spark couldn't split a hot one
    # sets that surely have no copy stay where they are
    maybe, others = parted(lines, firsts, ["h1", "h2"])
    copied = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    known = maybe.join(firsts, ["h1", "h2"], "left").select("id", "words", "n", F.when(~copied, F.col("head")).alias("head"), copied.alias("copied"))
    known = staged(known, "known")
    copies = known.where("copied").select("id")
    sets = others.select("id", "words", "n", "head").unionByName(known.where("NOT copied").drop("copied")).where(F.col("words") >= k)
    sets = staged(sets.select("id", "n", "head"), "line-sets")
    drop_staged(lines)
    drop_staged(firsts)
    # counted without copies, which have no postings: else all tokens of a line with many would be frequent
    buckets = rarity_buckets(text_bytes)
    table = rare_as_one(counted_table(sets.select(F.explode("head").alias("h")), buckets))

    def hashed_again(prefixes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """ids of the sets whose prefix isn't within the head, and all their hashes, made anew from the texts."""
        ids = staged(prefixes.where("prefix IS NULL").select("id"), f"{name}-ids")
        return ids, staged(hashed(lines_among(docs, ids, stride)), name)

    # plans with the table have no exchange: the driver would write them out, table and all, after each stage
    ids, again = hashed_again(sets.select("id", rare_prefix("head", "n", table, num, den).alias("prefix")), "again")
    # near copies share hashes past their heads too, which haven't been counted
    more = rare_as_one(counted_table(again.select(F.explode("h").alias("h")), buckets), STEPS, 5 * STEPS + 1)
    table = bytearray(map(max, table, more))
    chosen = staged(sets.select("id", "n", rare_prefix("head", "n", table, num, den).alias("prefix")), "chosen")
    for x in (sets, ids, again):
        drop_staged(x)
    ids, again = hashed_again(chosen, "full")
    whole = again.select("id", ranked("h", table).alias("tokens")).select("id", F.size("tokens").alias("n"), prefix(F.col("tokens"), num, den).alias("prefix"))
    whole = staged(whole, "whole")
    some = postings(chosen).withColumn("token", rare_token(F.col("token")))
    held = headed(some.unionByName(postings(whole)), max(table) >= FREQUENT_RANK, "lines")
    for x in (chosen, ids, again, whole):
        drop_staged(x)

    def matched(pairs: DataFrame, name: str) -> DataFrame:
        """u of the pairs (u, v) that match: their sets are made anew from the texts."""
        pairs = staged(pairs.distinct(), f"{name}-pairs")
        need = staged(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), f"{name}-need")
        sets = staged(hashed(lines_among(docs, need, stride)).select("id", F.col("h").alias("s")), f"{name}-sets")
        out = staged(similar(pairs, sets, num, den).select(F.col("u").alias("id")).distinct(), name)
        for x in (pairs, need, sets):
            drop_staged(x)
        return out

    quick = matched(held.where(may_match("np", "head_np", num, den)).select(F.col("id").alias("u"), F.col("head").alias("v")), "quick")
    a, b = held.join(quick, "id", "left_anti").select("token", "id", "np").alias("a"), held.select("token", "id", "np").alias("b")
    # heads were tried above, and are not among these rows
    pairs = a.join(b, "token").where((F.col("a.id") > F.col("b.id")) & may_match("a.np", "b.np", num, den))
    rest = matched(pairs.select(F.col("a.id").alias("u"), F.col("b.id").alias("v")), "rest")
    drop_staged(held)
    # copies aren't first of their sets, the others are: no line comes twice
    return quick.unionByName(rest).unionByName(copies)


def dedup_lines(docs: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, k: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text, other columns) without the lines that repeat an earlier line, and n_lines, n_removed for each row.

    Lines lie between \\n, words between ASCII white space. A line of k words or more goes if the set of its k-word
    shingles has a Jaccard similarity of num / den or more with that of any line before it, removed or not, in the order
    of doc_id (null first), a hash of the text, and line; a shorter one if a line before it has the same words. Lines
    without a word stay. A repeated row loses all its lines with words. Null text stays null, with 0 lines; a text may
    become empty. An empty table gives no rows. Columns named n_lines or n_removed are replaced, others are kept.
    """
    docs = docs.drop("n_lines", "n_removed")
    sizes = docs.agg(F.max(F.octet_length("text")).alias("most"), F.sum(F.octet_length("text")).alias("total")).first()
    stride = (sizes["most"] or 0) + 1  # more than any document has lines
    rows = numbered(docs, (1 << 63) // stride)
    text = F.col("row.text")
    gone = repeated_lines(rows.where(text.isNotNull()).select((F.col("no") * stride).alias("id"), text.alias("text")), sizes["total"] or 0, stride, num, den, k)
    gone = gone.select(F.expr(f"id div {stride}L").alias("no"), F.pmod("id", F.lit(stride)).cast("int").alias("line"))
    rows = rows.join(gone.groupBy("no").agg(F.collect_list("line").alias("gone")).hint("shuffle_hash"), "no", "left")
    rows = rows.withColumn("lines", F.split(text, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long")
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    out = rows.select(F.col("row").withField("text", left).alias("row"), n_lines.alias("n_lines"), removed.alias("n_removed"))
    return out.select("row.*", "n_lines", "n_removed")
