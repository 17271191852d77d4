"""Document fingerprints from closed syncmers, in DataFrame functions only.

The letters of a document are its words: text is lower-cased, and words are what white space separates.
A k-mer is K words in a row, an inner substring is S words in a row. A k-mer is a closed syncmer when the
smallest hash among its inner substrings is that of the first or of the last. Whether it is depends on
its own words alone, so equal passages have the same syncmers wherever they stand and whatever surrounds
them: they anchor positional matching (anchors()).

A fingerprint holds the SIZE smallest hashes of the distinct syncmers in ascending order, each as 12
hexadecimal digits. likeness() of two fingerprints is the share of common hashes among the SIZE smallest
of their union, which estimates the Jaccard similarity of the two sets of syncmers.

Cases: a null text is an empty one; a text of fewer than K words has one anchor, all its words; a text
without words has the empty fingerprint, which is like another empty one (1) and unlike all else (0).
Long texts cost in proportion to their words. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents

K, S, SIZE = 5, 2, 64
HEX = 12
SPACE = r"[\s\p{Z}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda x: x != "")


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<hash, at>>: the closed syncmers of a text and the word at which each begins."""
    w = words(text)
    inner = k - s + 1
    # one expression per array: a lambda's variable holds it, so nothing is computed twice
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)

    def grams(h: Column) -> Column:
        def chosen(g: Column) -> Column:
            def at(i: Column) -> Column:
                cells = [F.get(g, i + j) for j in range(inner)]
                least = F.least(*cells)
                return F.when((least == cells[0]) | (least == cells[-1]), F.struct(F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("hash"), i.alias("at")))

            return F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - k), at), lambda x: x.isNotNull())

        sub = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))
        short = F.array(F.struct(F.xxhash64(h).alias("hash"), F.lit(0).alias("at")))
        none = F.filter(short, lambda x: F.lit(False))
        return F.when(F.size(h) == 0, none).when(F.size(h) < k, short).otherwise(let(sub, chosen))

    return let(F.transform(w, lambda x: F.xxhash64(x)), grams)


def fingerprint(text: Column, k: int = K, s: int = S, size: int = SIZE) -> Column:
    hashes = F.transform(anchors(text, k, s), lambda x: x["hash"].bitwiseAND((1 << 4 * HEX) - 1))
    least = F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)
    return F.array_join(F.transform(least, lambda x: F.lpad(F.lower(F.hex(x)), HEX, "0")), "")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """0 to 1: the share of common hashes among the smallest of both fingerprints."""
    parts = lambda x: F.when(x == "", F.expr("array()").cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), (F.length(x) / HEX).cast("int") - 1), lambda i: x.substr(i * HEX + 1, F.lit(HEX))))
    left, right = parts(a), parts(b)
    union = F.slice(F.array_sort(F.array_union(left, right)), 1, size)
    common = F.size(F.array_intersect(F.array_intersect(left, right), union))
    return F.when(a == b, F.lit(1.0)).otherwise(common / F.size(union))


def with_next(docs: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """docs with next_<column>: the values of the document that follows by doc_id (after the last: of the first).

    Ids are dealt into ranges, and each range also gets the first document of the range after it, so one
    shuffle brings neighbours together and no task holds more than its range. Ties of ids go by text.
    """
    spark = docs.sparkSession
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    if cuts:
        below = F.array(*[F.lit(x) for x in cuts])
        bucket = F.coalesce(F.size(F.filter(below, lambda x: x <= F.col("doc_id"))), F.lit(0))
    else:
        bucket = F.lit(0)
    ranged = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    # one row per range: its first id
    heads = sorted((r["bucket"], r["head"]) for r in ranged.groupBy("bucket").agg(F.min(key).alias("head")).collect())
    if not heads:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns]).limit(0)
    # the range that each head is also sent to: the one before its own; the first range's head goes to the last
    place = F.array_position(F.array(*[F.lit(i) for _, i in heads]), key).cast("int")
    guest = F.when(place > 0, F.get(F.array(*[F.lit(heads[i - 1][0]) for i in range(len(heads))]), place - 1))
    both = F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest")), F.struct(guest.alias("b"), F.lit(1).alias("guest")))
    dealt = ranged.withColumn("to", F.explode(F.filter(both, lambda x: x["b"].isNotNull()))).select(*docs.columns, "to.*")
    near = Window.partitionBy("b").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.select("*", *[F.lead(c).over(near).alias(f"next_{c}") for c in columns]).where("guest = 0").drop("b", "guest")


def edited(text: Column, following: Column) -> Column:
    """text with its last quarter of code points replaced by as many of the following text's first."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like its own they and the next one's are."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = with_next(base.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"], parts)
    after = near.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return after.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op10_closed_syncmers(spark, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
