"""Benchmark decontamination: size-partitioned MinHash containment search, natively.

Words are runs of letters and digits, lower-cased; a shingle is five of them in a row (a text
with fewer words is one shingle of all its words). An item is found in a document that
holds at least 80 percent of the item's distinct shingles. So an item of fewer than five words is found only
in texts of exactly its words, not inside longer ones, which have shingles of five words alone.

Items are partitioned by size, in powers of two. The MinHash sketch of an item is its
smallest shingle hashes: as many as any item of its partition may lack, and ``HITS`` percent of the largest's
more. A document that holds the item lacks at most a fifth of its n shingles, so it holds all of the sketch but
floor(n / 5); that many hits make a candidate, and none that holds the item is missed. A sketch
hash that is boilerplate is one hit, which is not enough alone.

Documents are partitioned by size alike. Their sketch is the part of their shingle hashes
up to the cutoff of their partition: the largest hash in the sketch of any item that is small enough to lie in them. Hashes beyond
it are in no sketch that matters; documents smaller than all items have none. Candidates are read again and verified by the exact
shingles, as strings, which meet the items' before anything is shuffled.

Items' sketches and shingles are broadcast while their counted rows are within
``common.BROADCAST_ROWS``; beyond it the joins shuffle. All of it is DataFrame functions.

Null or empty texts have no shingles: such items are in no document, such documents hold no
item. Rows of equal doc_id and text give one row; a null doc_id is carried as null. Equal items are
found each by its own item_id. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 5
PERCENT = 80
#: Sketches are longer than what may be lacking by so many percent of the item's shingles, and at least one.
HITS = 10


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _each(found: Column, make) -> Column:
    """``make(first, width)`` for each shingle of an array of words; first counts from 0."""
    n = F.size(found)
    return (
        F.when(n == 0, F.array())
        .when(n < WIDTH, F.array(make(F.lit(0), None)))
        .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))), lambda i: make(i, WIDTH)))
    )


def _strings(found: Column) -> Column:
    return _each(found, lambda i, width: F.concat_ws(" ", found if width is None else F.slice(found, i + 1, width)))


def _hashes(found: Column) -> Column:
    """Equal to xxhash64 of the shingle's words one by one; of a short text's, of their string."""
    return _each(found, lambda i, width: F.xxhash64(F.concat_ws(" ", found)) if width is None else F.xxhash64(*[F.get(found, i + k) for k in range(width)]))


# explode_outer throughout: for explode the optimizer adds a filter on the array's size below the
# projections, which inlines the array of words into the lambda and evaluates it for every shingle.


def _items(benchmark: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Shingles (item_id, n, shingle) and sketches (hash, item_id, least, hits)."""
    found = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), words(benchmark["text"]).alias("w"))
    each = found.select("item_id", F.explode_outer(F.arrays_zip(_strings(F.col("w")).alias("shingle"), _hashes(F.col("w")).alias("hash"))).alias("s"))
    distinct = each.select("item_id", "s.shingle", "s.hash").where("shingle IS NOT NULL").distinct()
    sizes = distinct.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("hash")).alias("hashes"))
    sizes = sizes.withColumn("size_partition", _size_partition(F.col("n")))
    # Sketches of a partition are as long as its largest item's must be.
    top = sizes.groupBy("size_partition").agg(F.max("n").alias("largest"))
    lacking = lambda n: F.floor(n * (100 - percent) / 100).cast("int")
    sketched = sizes.join(top, "size_partition").withColumn("sketch", F.slice("hashes", F.lit(1), lacking(F.col("largest")) + 1 + F.floor(F.col("largest") * HITS / 100).cast("int")))
    hits = F.greatest(F.size("sketch") - lacking(F.col("n")), F.lit(1))
    sketches = common.written(sketched.select("item_id", F.ceil(F.col("n") * percent / 100).cast("int").alias("least"), hits.alias("hits"), F.explode("sketch").alias("hash")), "sketches")
    shingles = common.written(distinct.join(sizes.select("item_id", "n"), "item_id").select("item_id", "n", "shingle"), "shingles")
    return shingles, sketches


def _size_partition(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def _cutoffs(sketches: DataFrame) -> DataFrame:
    """(size_partition, cutoff): for documents of each size the largest sketch hash of the items that they may hold. A row for each of 64 sizes at most."""
    tops = sketches.groupBy(_size_partition(F.col("least")).alias("of")).agg(F.max("hash").alias("hash"))
    return tops.select("hash", F.explode(F.sequence(F.col("of"), F.lit(63))).alias("size_partition")).groupBy("size_partition").agg(F.max("hash").alias("cutoff"))


def contained(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, item_id, n_shingles, n_shared) of each item in each document that holds ``percent`` of it."""
    shingles, sketches = _items(benchmark, percent)
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), docs["text"].alias("text"))
    hashed = keyed.select("doc_id", "text_hash", words(F.col("text")).alias("w")).select("doc_id", "text_hash", F.array_distinct(_hashes(F.col("w"))).alias("hashes")).select("doc_id", "text_hash", F.size("hashes").alias("n_held"), "hashes")
    # Null-safe, or the optimizer would add a test for null below the projections, and hash every text twice for it.
    sized = hashed.join(F.broadcast(_cutoffs(sketches)), _size_partition(F.col("n_held")).eqNullSafe(F.col("size_partition")))
    sketch = sized.select("doc_id", "text_hash", "n_held", "cutoff", F.explode_outer("hashes").alias("hash")).where("hash <= cutoff")
    hit = sketch.join(common.sized(sketches), "hash").where("n_held >= least").groupBy("doc_id", "text_hash", "item_id", "hits").agg(F.count(F.lit(1)).alias("held"))
    candidates = common.written(hit.where("held >= hits").select("doc_id", "text_hash", "item_id"), "candidates")
    pairs = candidates.withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "print")
    again = keyed.join(common.sized(pairs), keyed["doc_id"].eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("print")))
    own = again.select("doc_id", "text_hash", "item_id", words(F.col("text")).alias("w")).select("doc_id", "text_hash", "item_id", F.explode_outer(_strings(F.col("w"))).alias("shingle"))
    # Shingles meet the item's first; what is left is made distinct, since texts and rows repeat.
    shared = own.join(common.sized(shingles), ["item_id", "shingle"]).distinct().groupBy("doc_id", "text_hash", "item_id", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    return shared.where(F.col("n_shared") * 100 >= F.col("n") * percent).select("doc_id", "text_hash", "item_id", F.col("n").alias("n_shingles"), "n_shared")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they came."""
    gone = common.written(contained(docs, benchmark, percent).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "contaminated")
    return docs.join(common.sized(gone), docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_shared").alias("n_shared"))


_SHINGLES = """
  SELECT {key}, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM (SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table})
"""
ORACLE = f"""
WITH i AS (SELECT DISTINCT item_id, shingle FROM ({_SHINGLES.format(key="item_id", table="benchmark")})),
d AS (SELECT DISTINCT doc_id, shingle FROM ({_SHINGLES.format(key="doc_id", table="documents")})),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
SELECT d.doc_id, i.item_id, n.n_shingles, count(*) AS n_shared
FROM d JOIN i ON d.shingle = i.shingle JOIN n ON n.item_id = i.item_id
GROUP BY d.doc_id, i.item_id, n.n_shingles HAVING count(*) * 100 >= n.n_shingles * 80
"""
