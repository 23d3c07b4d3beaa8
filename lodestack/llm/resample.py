"""Importance resampling towards a target distribution, in Spark SQL functions alone.

Texts become arrays of hashed n-gram buckets, which are exploded and counted by bucket over the corpus and over the
target. The log ratio of the two smoothed shares is a bucket's gain; the gains are a table of as many rows as there are
buckets, which is broadcast and joined to the exploded buckets of each document again. A document's weight is their
sum; with a Gumbel variable of its id added, the highest scores are a sample drawn without replacement in proportion to
exp(weight / 1000). Ranks come from a distributed sort whose ranges are shifted by the row counts before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running_number, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: digits, a-z and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Buckets at most, so that the gain table stays within a fixed size.
BUCKETS_LIMIT = 1 << 20


def words(text: Column) -> Column:
    """Words of a whole text, ASCII lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def ngrams(words: Column, most: int) -> Column:
    """All runs of 1 to ``most`` words, joined by one space, repeats included."""
    def runs(n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))

    return words if most == 1 else F.concat(words, *[runs(n) for n in range(2, most + 1)])


def bucketed(docs: DataFrame, keep: list[str], text_col: str, most: int, buckets: int) -> DataFrame:
    """The columns ``keep``, n_words, and bucket: a row for each feature of each row, one with null for a row without any."""
    cut = docs.select(*keep, words(F.col(text_col)).alias("_words"))
    # the size is taken below the explode, else each exploded row would carry the whole array for it
    sized = cut.select(*keep, F.size("_words").alias("n_words"), ngrams(F.col("_words"), most).alias("_grams"))
    each = sized.select(*keep, "n_words", F.explode_outer("_grams").alias("_gram"))
    return each.select(*keep, "n_words", (F.crc32(F.col("_gram").cast("binary")) % buckets).alias("bucket"))


def counts(texts: DataFrame, name: str, text_col: str, most: int, buckets: int) -> DataFrame:
    """(bucket, name): features in each bucket."""
    return bucketed(texts, [], text_col, most, buckets).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), capital letters for the sums."""
    if not 0 < buckets <= BUCKETS_LIMIT:
        raise ValueError(f"buckets must be between 1 and {BUCKETS_LIMIT}")
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    found = every.join(counts(docs, "s", text_col, most, buckets), "bucket", "left").join(counts(target, "t", target_text, most, buckets), "bucket", "left").fillna(0, ["s", "t"])
    all_of = Window.partitionBy(F.lit(0))  # over the buckets alone
    share = lambda one, total: (F.col(one) + 1).cast("double") * (F.sum(total).over(all_of) + buckets).cast("double")
    return found.select("bucket", F.floor(1000 * F.ln(share("t", "s") / share("s", "t"))).alias("gain"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 32 bits of sha256('seed:id'); a null id counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double") + 0.5) / 4294967296.0


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, most: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank, all long; rank is null where a row is not drawn.

    Of the N rows with least_words words or more, floor(percent * N / 100) are drawn: the highest scores, ties by
    smaller doc_id (a null id last), and equal rows in any order. Null and empty texts have no features and weight 0.
    Whole texts of any length; repeated rows give repeated rows, each with its own rank; empty tables give no rows, and
    an empty target is one with no features. Other columns are not read, whatever their names.
    """
    table = gains(docs, target, most, buckets, text_col, target_text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    each = bucketed(rows, ["doc_id", "row"], "text", most, buckets).join(F.broadcast(table), "bucket", "left")
    # a row's features lie in one partition, so they are summed before the shuffle
    weighed = each.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    gumbel = F.floor(-1000 * F.ln(-F.ln(uniform(F.col("doc_id"), seed))))
    scored = staged(weighed.withColumn("score", F.col("weight") + gumbel), "scored")
    fit = F.col("n_words") >= least_words
    draws = percent * scored.where(fit).count() // 100
    ranked = running_number(scored.where(fit), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "at", "ranked")
    drawn = ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("at") < draws, F.col("at") + 1).alias("rank"))
    rest = scored.where(~fit).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs with all their columns, by an inner join of their ids; ids are expected to be unique."""
    id_col = options.get("id_col", "doc_id")
    drawn = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, F.col(id_col).cast("long") == F.col("__drawn"), "left_semi")
