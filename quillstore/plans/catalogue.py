"""The registered queries over the document engine, with their SQL counterparts."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import listing, state
from ..shared import shared_dir
from ..sources import logfile
from ..store import Store
from . import collections as K


def _read(page: DataFrame) -> DataFrame:
    """Reads the texts of a page only."""
    return page.select("id", C.canonicalise("doc").alias("read")).select("id", "read.doc")


def list_page(spark, sf_dir):
    return _read(listing.page(K.raw_events(spark, sf_dir).withColumnRenamed("text", "doc"), limit=100))


def list_where_number(spark, sf_dir):
    return listing.page(K.events(spark, sf_dir), [("k", "69")], after="5", limit=100)


def list_where_string(spark, sf_dir):
    return listing.page(K.orders(spark, sf_dir), [("priority", "1-URGENT")], limit=500)


def list_where_and(spark, sf_dir):
    return listing.page(K.orders(spark, sf_dir), [("status", "F"), ("priority", "2-HIGH")], after="2", limit=1000)


def list_where_nested(spark, sf_dir):
    return listing.page(K.customers(spark, sf_dir), [("nation.key", "7"), ("segment", "BUILDING")], limit=1000)


def list_where_missing(spark, sf_dir):
    """How many documents match in each case: a present path, an absent one, a path through a number, an object's text."""
    docs = K.events(spark, sf_dir)
    cases = [("present", [("k", "69")]), ("absent", [("absent", "69")]), ("through", [("k.x", "69")]), ("contradiction", [("k", "69"), ("k", "70")]), ("written", [("k", "69.0")])]
    counts = docs.agg(*[F.count_if(C.all_equal(f)).cast("long").alias(name) for name, f in cases])
    return counts.unpivot([], [name for name, _ in cases], "case", "documents")


def list_after(spark, sf_dir):
    return _read(listing.page(K.raw_events(spark, sf_dir).withColumnRenamed("text", "doc"), after="77", limit=250))


def page_cursor(spark, sf_dir):
    """One row for a page in the middle and one for the last: how many documents, and the id to go on after."""
    docs = K.customers(spark, sf_dir)

    def cursor(name, filters, after, limit):
        ahead = listing.selected(docs, filters, after).select("id").orderBy("id").limit(limit + 1)
        page = ahead.agg(F.sort_array(F.collect_list("id")).alias("ids"))  # limit + 1 ids at most
        full = F.size("ids") > limit
        return page.select(F.lit(name).alias("page"), F.least(F.size("ids"), F.lit(limit)).cast("long").alias("documents"), F.when(full, F.get("ids", F.lit(limit - 1))).alias("next"))

    return cursor("middle", [("segment", "BUILDING")], "Customer#000000200", 20).unionByName(cursor("last", [("nation.key", "7")], None, 1000))


def all_pages(spark, sf_dir):
    return listing.all_pages(K.customers(spark, sf_dir), 64).select("page", "id")


def get_many(spark, sf_dir):
    keys = K.table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).cast("string").alias("id"))
    return listing.get_many(K.parts(spark, sf_dir), keys)


def current_state(spark, sf_dir):
    return state.current(K.mutations(spark, sf_dir), ("doc",))


def delete_flags(spark, sf_dir):
    return state.delete_flags(K.mutations(spark, sf_dir)).select("collection", "id", F.col("pos").alias("event_id"), "deleted")


def collection_counts(spark, sf_dir):
    log = K.mutations(spark, sf_dir)
    registry = log.select("collection").distinct().unionByName(spark.createDataFrame([("empty",)], "collection string"))
    return state.collection_counts(log, registry)


def canonical_docs(spark, sf_dir):
    return K.events(spark, sf_dir).select("id", "doc")


def valid_ids(spark, sf_dir):
    texts = K.table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("text").alias("id"))
    names = K.table(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_name").alias("id"))
    urls = K.table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("url").alias("id"))
    return texts.unionByName(names).unionByName(urls).groupBy("source", C.valid_id(F.col("id")).alias("valid")).agg(F.count(F.lit(1)).alias("ids"))


def valid_collections(spark, sf_dir):
    names = K.table(spark, sf_dir, "part").select("p_brand", "p_name").select(F.explode(F.array("p_brand", "p_name", F.regexp_replace("p_name", "[^A-Za-z0-9]", "_"))).alias("name"))
    return names.groupBy("name").agg(F.max(C.valid_collection(F.col("name"))).alias("valid"))


def crc_payload(spark, sf_dir):
    return K.table(spark, sf_dir, "documents").select("doc_id", C.crc32(F.col("text")).alias("crc"))


def stored_mutations(spark, sf_dir):
    """A store written in three batches (the last put of each user; some deletes; some of them put again), compacted, and read."""
    log = K.mutations(spark, sf_dir).where("op = 'put'").withColumnRenamed("doc", "text")
    last = log.groupBy("collection", "id").agg(F.max_by("text", F.struct("batch", "pos")).alias("text"))
    number = F.col("id").cast("long")
    with Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}") as store:
        store.put_all(last)
        store.delete_all(last.where(number % 7 == 0))
        store.put_all(last.where(number % 14 == 0).withColumn("text", F.lit('{ "k" : 1.50, "again": null }')))
        store.compact()
        return store.current(("doc",)).select("collection", "id", "doc")


def collection_names(spark, sf_dir):
    """Collections in the order of their names, with their place in it."""
    counts = collection_counts(spark, sf_dir)
    # One row for each collection: names are few beside documents.
    return counts.select((F.row_number().over(Window.orderBy("collection")) - 1).cast("long").alias("place"), "collection", "documents")


def log_round_trip(spark, sf_dir):
    """Customers written as framed logs, one for each segment, with a record cut short at each log's end, and read back."""
    folder = urlparse(shared_dir(spark))
    logs = Path(folder.path if folder.scheme in ("", "file") else tempfile.gettempdir()) / f"logs-{uuid.uuid4().hex}"
    segments = K.customers(spark, sf_dir).select(F.col("fields")["segment"].alias("collection"), "id", "doc")
    for name, _ in logfile.export(segments, str(logs)):
        with (logs / f"{name}.log").open("ab") as log:
            log.write(logfile.Record(logfile.PUT, "torn", "{}").to_bytes()[:-1])
    return logfile.read_logs(spark, str(logs))


QUERIES = {
    q.__name__: q
    for q in (list_page, list_where_number, list_where_string, list_where_and, list_where_nested, list_where_missing, list_after, page_cursor, all_pages, get_many, current_state, delete_flags, collection_counts, canonical_docs, valid_ids, valid_collections, crc_payload, stored_mutations, collection_names, log_round_trip)
}

_EVENTS = "SELECT CAST(event_id AS VARCHAR) AS id, CAST(json(props) AS VARCHAR) AS doc, json_extract_string(props, '$.k') AS k FROM events"
_ORDERS = """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus, o_orderpriority,
  '{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '","custkey":' || o_custkey || '}' AS doc FROM orders"""
_CUSTOMERS = """SELECT c_name AS id, c_mktsegment, c_nationkey, '{"segment":"' || c_mktsegment || '","nation":{"key":' || c_nationkey || '}}' AS doc FROM customer"""
_MUTATIONS = """SELECT 'users-' || (user_id % 4) AS collection, ts, event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op,
  CAST(user_id AS VARCHAR) AS id, props AS doc FROM events"""
_LATEST = f"SELECT *, row_number() OVER (PARTITION BY collection, id ORDER BY ts DESC, event_id DESC) AS n FROM ({_MUTATIONS})"

ORACLES = {
    "list_page": f"SELECT id, doc FROM ({_EVENTS}) ORDER BY id LIMIT 100",
    "list_where_number": f"SELECT id, doc FROM ({_EVENTS}) WHERE k = '69' AND id > '5' ORDER BY id LIMIT 100",
    "list_where_string": f"SELECT id, doc FROM ({_ORDERS}) WHERE o_orderpriority = '1-URGENT' ORDER BY id LIMIT 500",
    "list_where_and": f"SELECT id, doc FROM ({_ORDERS}) WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND id > '2' ORDER BY id LIMIT 1000",
    "list_where_nested": f"SELECT id, doc FROM ({_CUSTOMERS}) WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING' ORDER BY id LIMIT 1000",
    "list_where_missing": f"""SELECT 'present' AS "case", count(*) FILTER (k = '69') AS documents FROM ({_EVENTS})
        UNION ALL SELECT unnest(['absent', 'through', 'contradiction', 'written']), 0""",
    "list_after": f"SELECT id, doc FROM ({_EVENTS}) WHERE id > '77' ORDER BY id LIMIT 250",
    "page_cursor": f"""WITH m AS (SELECT id, row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS total FROM ({_CUSTOMERS}) WHERE c_mktsegment = 'BUILDING' AND id > 'Customer#000000200'),
        l AS (SELECT id, row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS total FROM ({_CUSTOMERS}) WHERE c_nationkey = 7)
        SELECT 'middle' AS page, count(*) FILTER (n <= 20) AS documents, max(id) FILTER (n = 20 AND total > 20) AS next FROM m
        UNION ALL SELECT 'last', count(*) FILTER (n <= 1000), max(id) FILTER (n = 1000 AND total > 1000) FROM l""",
    "all_pages": f"SELECT (row_number() OVER (ORDER BY id) - 1) // 64 AS page, id FROM ({_CUSTOMERS})",
    "get_many": """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS doc FROM part)
        SELECT CAST(part.p_partkey * 3 AS VARCHAR) AS id, p.doc FROM part LEFT JOIN p ON p.id = CAST(part.p_partkey * 3 AS VARCHAR)""",
    "current_state": f"SELECT collection, id, doc FROM ({_LATEST}) WHERE n = 1 AND op = 'put'",
    "delete_flags": f"""SELECT collection, id, event_id, coalesce(before = 'put', false) AS deleted FROM
        (SELECT *, lag(op) OVER (PARTITION BY collection, id ORDER BY ts, event_id) AS before FROM ({_MUTATIONS})) WHERE op = 'delete'""",
    "collection_counts": f"""WITH r AS (SELECT DISTINCT collection FROM ({_MUTATIONS}) UNION ALL SELECT 'empty'),
        n AS (SELECT collection, count(*) FILTER (op = 'put') AS documents FROM ({_LATEST}) WHERE n = 1 GROUP BY collection)
        SELECT r.collection, coalesce(n.documents, 0)::BIGINT AS documents FROM r LEFT JOIN n ON n.collection = r.collection""",
    "collection_names": f"""WITH r AS (SELECT DISTINCT collection FROM ({_MUTATIONS}) UNION ALL SELECT 'empty'),
        n AS (SELECT collection, count(*) FILTER (op = 'put') AS documents FROM ({_LATEST}) WHERE n = 1 GROUP BY collection)
        SELECT row_number() OVER (ORDER BY r.collection) - 1 AS place, r.collection, coalesce(n.documents, 0)::BIGINT AS documents FROM r LEFT JOIN n ON n.collection = r.collection""",
    "log_round_trip": f"SELECT c_mktsegment AS collection, row_number() OVER (PARTITION BY c_mktsegment ORDER BY id) - 1 AS pos, 'put' AS op, id, doc AS text FROM ({_CUSTOMERS})",
    "stored_mutations": f"""SELECT collection, id, CASE WHEN CAST(id AS BIGINT) % 14 = 0 THEN '{{"k":1.50,"again":null}}' ELSE CAST(json(doc) AS VARCHAR) END AS doc FROM
        (SELECT *, row_number() OVER (PARTITION BY collection, id ORDER BY ts DESC, event_id DESC) AS n FROM ({_MUTATIONS}) WHERE op = 'put')
        WHERE n = 1 AND (CAST(id AS BIGINT) % 7 <> 0 OR CAST(id AS BIGINT) % 14 = 0)""",
    "canonical_docs": f"SELECT id, doc FROM ({_EVENTS})",
    "crc_payload": r"""WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
        b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents)
        SELECT doc_id, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, step[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) AS crc FROM b, t""",
    "valid_ids": r"""SELECT source, coalesce(strlen(id) BETWEEN 1 AND 256 AND NOT regexp_matches(id, '\p{Cc}'), false) AS valid, count(*) AS ids FROM
        (SELECT 'documents' AS source, text AS id FROM documents UNION ALL SELECT 'customer', c_name FROM customer UNION ALL SELECT 'pages', url FROM pages) GROUP BY ALL""",
    "valid_collections": """SELECT DISTINCT name, regexp_full_match(name, '[A-Za-z0-9_-]{1,64}') AS valid FROM
        (SELECT unnest([p_brand, p_name, regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g')]) AS name FROM part)""",
}
