"""The parts of an exact set-similarity join, with DataFrame functions only: tokens, their order of rarity, prefixes, postings.

Two sets of Jaccard similarity num / den or more share a token in their prefixes, the rarest n - ceil(t n) + 1 tokens of
each; so only prefixes are joined, and the positional and length filters bound the overlap before sets are compared.
Tokens are 56-bit hashes under a byte of rarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, staged

#: Similarity, as a fraction of whole numbers so that bounds are exact; words of a shingle.
NUMERATOR, DENOMINATOR, SHINGLE = 8, 10, 5
#: Buckets of the table of token counts, at least and at most: its size in bytes, which every task gets. Counting takes more
#: shuffles the more there are. And the bytes of text for each, some 500 tokens: a token that is more frequent stands out.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_TEXT = 1 << 12, 1 << 21, 2048
#: Buckets that are counted side by side in a row; both are powers of two.
COUNTERS = 8
#: Bytes of a word's code: a hash in hexadecimal digits, its first bit set so that none is left out.
CODE = 16
#: Rows of 64 bits of the filters that spare lines and texts without a candidate a shuffle: at most 2 MB are broadcast.
MARK_ROWS = 1 << 16
#: Ranks for each doubling of a count.
STEPS = 4
#: Ranks from here on (counts of about 2 ** 17) may be tokens of very many sets; those below are of fewer than that.
FREQUENT_RANK = 17 * STEPS + 1


def spaced(text: Column) -> Column:
    """text with a space for any other ASCII white space but \\n; a text without any is only looked through."""
    other = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))
    return F.when(other, F.regexp_replace(text, "[\\x09\\x0B-\\x0D]", " ")).otherwise(text)


def words_of(line: Column) -> Column:
    """Words of a line without white space but spaces."""
    words = F.split(line, " ")
    empty = (line == "") | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | F.contains(line, F.lit("  "))
    return F.when(empty, F.array_remove(words, "")).otherwise(words)


def hashed_words(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def shingles(k: int) -> Column:
    """Hashes of the k-word shingles of hw, an array of hashes of words, repeats included; if it is shorter, one hash of all its words."""
    starts = F.slice("hw", F.lit(1), F.greatest(F.size("hw") - (k - 1), F.lit(0)))
    longer = F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get("hw", i + j) for j in range(1, k))))
    return F.when(F.size("hw") >= k, longer).otherwise(F.array(F.xxhash64(F.lit(2), F.col("hw"))))


def rarity_buckets(text_bytes: int) -> int:
    """A power of two that grows with the text, so that as many tokens fall into a bucket."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (text_bytes // BUCKET_TEXT).bit_length()))


def coded_words(line: Column) -> Column:
    """Words of a line without white space but spaces, as CODE bytes each."""
    return F.array_join(F.transform(words_of(line), lambda x: F.hex(F.xxhash64(x).bitwiseOR(F.lit(-(1 << 63))))), "").cast("binary")


def coded_shingles(code: str, k: int) -> Column:
    """shingles() of coded words: a shingle is a part of the code, which takes fewer steps than a hash of k hashes."""
    # the inner function takes the code from a variable: from a row it would be copied whole for each shingle
    starts = F.sequence(F.lit(1), F.octet_length(code) - (CODE * k - 1), F.lit(CODE))
    longer = F.transform(F.array(F.col(code)), lambda c: F.transform(starts, lambda i: F.xxhash64(F.substr(c, i, F.lit(CODE * k)))))
    return F.when(F.octet_length(code) >= CODE * k, F.get(longer, F.lit(0))).otherwise(F.array(F.xxhash64(F.lit(2), F.col(code))))


def rarity_table(lines: DataFrame, k: int, buckets: int) -> bytearray:
    """counted_table of the shingles of all lines (of hw)."""
    # shingles are hashed from their places here, not as an array: that keeps most of the pass in generated code; a filter
    # on the number of words would have them split twice
    places = F.when(F.size("hw") >= k, F.sequence(F.lit(0), F.size("hw") - k)).otherwise(F.array().cast("array<int>"))
    return counted_table(lines.select("hw", F.explode(places).alias("i")).select(F.xxhash64(*(F.get("hw", F.col("i") + j) for j in range(k))).alias("h")), buckets)


def counted_table(tokens: DataFrame, buckets: int) -> bytearray:
    """For each bucket of token hashes (h), a byte that rises with the logarithm of its count: 1 for a count of 0 or 1, STEPS more for each doubling, 121 at most. The driver gets these bytes alone."""
    # a group counts several buckets, so that the groups fit the map that generated code keeps for them
    bucket = F.col("h").bitwiseAND(buckets - 1).cast("int")
    within = bucket.bitwiseAND(COUNTERS - 1)
    groups = tokens.groupBy(F.shiftright(bucket, COUNTERS.bit_length() - 1).cast("long").alias("group"))
    counts = groups.agg(*(F.sum((within == j).cast("long")).alias(f"n{j}") for j in range(COUNTERS)))

    def rank(n: Column) -> Column:
        return (F.least(F.lit(120), F.floor(F.log2(F.greatest(n, F.lit(1))) * STEPS)) + 1).cast("int")

    digits = F.concat(*(F.lpad(F.hex(rank(F.col(f"n{j}"))), 2, "0") for j in range(COUNTERS)))
    every = tokens.sparkSession.range(buckets // COUNTERS).select(F.col("id").alias("group")).join(counts.select("group", digits.alias("digits")), "group", "left")
    pairs = F.sort_array(F.collect_list(F.struct("group", F.coalesce("digits", F.lit("01" * COUNTERS)).alias("digits"))))
    return bytearray(every.agg(F.unhex(F.array_join(F.transform(pairs, lambda x: x["digits"]), "")).alias("table")).first()["table"])


def rare_as_one(table: bytearray, above: int = 2, least: int = 0) -> bytearray:
    """table with 0 for buckets under least, or that hold little more than most do, by chance: nothing tells their tokens apart."""
    usual = sorted(table)[len(table) // 2]
    return table.translate(bytes(0 if r < max(usual + above, least) else r for r in range(256)))


def rank(h: Column, table: bytearray) -> Column:
    """The byte of a token hash in the table, as a binary: from the end, so that the place takes one step."""
    return F.substr(F.lit(table), h.bitwiseOR(F.lit(-len(table))).cast("int"), F.lit(1))


def rare_token(h: Column) -> Column:
    """The token of a hash of rank 0. Among those of one rank the order is that of the hashes."""
    return F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 8)


def token(h: Column, table: bytearray) -> Column:
    """A hash under its rank."""
    # no function here may give null: arrays without nulls are sorted as plain numbers
    return F.shiftleft(F.ascii(rank(h, table).cast("string")).cast("long"), 56).bitwiseOR(rare_token(h))


def ranked(hashes: str, table: bytearray) -> Column:
    """The distinct tokens in rising order of rarity rank, then hash."""
    return F.sort_array(F.array_distinct(F.transform(hashes, lambda h: token(h, table))))


def ceil_part(n: Column, num: int, den: int) -> Column:
    """ceil(num n / den), in whole numbers."""
    up = n * num + (den - 1)
    return ((up - F.pmod(up, F.lit(den))) / den).cast("int")


def prefix_size(n: Column, num: int, den: int) -> Column:
    return n - ceil_part(n, num, den) + 1


def prefix(tokens: Column, num: int, den: int) -> Column:
    return F.slice(tokens, F.lit(1), prefix_size(F.size(tokens), num, den))


def head_size(n: Column, num: int, den: int) -> Column:
    """Of n hashes in order, so many hold the prefix if no more than a third of them are frequent."""
    size = prefix_size(n, num, den)
    return size + F.shiftright(size, 1) + 2


def rare_prefix(head: str, n: str, table: bytearray, num: int, den: int) -> Column:
    """Of head, the first hashes of a set of n in order, the prefix in the order of (rank, hash); null if it isn't within."""
    size, zero = prefix_size(F.col(n), num, den), F.lit(b"\0")
    first = F.slice(head, F.lit(1), size)
    rare = F.filter(head, lambda h: rank(h, table) == zero)
    among_head = F.transform(F.array(rare), lambda r: F.when(F.size(r) >= size, F.slice(r, F.lit(1), size)))
    return F.when(F.exists(first, lambda h: rank(h, table) != zero), F.get(among_head, F.lit(0))).otherwise(first)


def slot(columns: list[str]) -> tuple[Column, Column]:
    """Of a key: the row of the table of marks, and its bit there."""
    h = F.xxhash64(F.lit(5), *columns)
    return h.bitwiseAND(MARK_ROWS - 1).cast("int"), F.shiftrightunsigned(h, 58).cast("int")


def parted(df: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose key may be in keys (all that are, and few others while keys are far fewer than bits), and rows whose key is not.

    By a Bloom filter of one hash over keys: MARK_ROWS rows at most are broadcast, however many keys there are.
    """
    row, bit = slot(columns)
    marks = keys.select(row.alias("_mark"), bit.alias("_b")).groupBy("_mark").agg(F.expr("bit_or(shiftleft(1L, _b))").alias("_bits"))
    held = df.withColumns({"_mark": row, "_bit": bit}).join(F.broadcast(marks), "_mark", "left")
    maybe = F.coalesce(F.expr("shiftrightunsigned(_bits, _bit) & 1 = 1"), F.lit(False))
    return tuple(held.where(c).drop("_mark", "_bit", "_bits") for c in (maybe, ~maybe))


def among(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of df whose key is in keys, each key once there; few others are shuffled."""
    return parted(df, keys, columns)[0].join(keys.hint("shuffle_hash"), columns, "left_semi")


def without(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of df whose key isn't in keys; those that surely aren't stay where they are."""
    maybe, others = parted(df, keys, columns)
    return others.unionByName(maybe.join(keys, columns, "left_anti"))


def postings(sets: DataFrame) -> DataFrame:
    """(token, id, np) of each token in the prefix of sets (id, n, prefix): n and the token's place p in one number, as these rows are most of what is shuffled."""
    placed = sets.select("id", "n", F.posexplode("prefix").alias("p", "token"))
    return placed.select("token", "id", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("p")).alias("np"))


def headed(rows: DataFrame, any_frequent: bool, name: str) -> DataFrame:
    """Postings but for the first of each token, with that one's head and head_np; tokens of one set drop out.

    Those of frequent tokens don't come together in one task: the first is found by partial aggregates, and Spark may
    split the join with it. any_frequent: whether there may be any.
    """
    frequent = F.shiftright("token", 56) >= FREQUENT_RANK
    first = F.first(F.struct("id", "np")).over(Window.partitionBy("token").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = (rows.where(~frequent) if any_frequent else rows).withColumn("first", first)
    if any_frequent:
        often = staged(rows.where(frequent), f"{name}-frequent")
        firsts = staged(often.groupBy("token").agg(F.min(F.struct("id", "np")).alias("first")), f"{name}-firsts")
        held = held.unionByName(often.join(firsts, "token"))
    held = held.where("id > first.id").select("token", "id", "np", F.col("first.id").alias("head"), F.col("first.np").alias("head_np"))
    out = staged(held, f"{name}-headed")
    if any_frequent:
        drop_staged(often)
        drop_staged(firsts)
    return out


def may_match(a: str, b: str, num: int, den: int) -> Column:
    """The length and positional filters on the np of two postings of one token."""
    (an, ap), (bn, bp) = ((F.shiftright(x, 32).cast("int"), F.col(x).bitwiseAND(0xFFFFFFFF).cast("int")) for x in (a, b))
    length = (an * den >= bn * num) & (bn * den >= an * num)
    return length & (F.least(an - ap, bn - bp) * (num + den) >= (an + bn) * num)


def similar(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose sets s, of sets (id, s), are similar."""
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")
    return both.where(F.size(F.array_intersect("a", "b")) * (num + den) >= (F.size("a") + F.size("b")) * num).select("u", "v")
