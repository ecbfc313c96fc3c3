"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Seeds are the matches of four base patterns: email, ip, card (12 to 19 digits, Luhn) and
phone (9 to 15 digits). Other identifier-like words (runs of letters, digits and ``_@.+-`` with
at least four digits or an ``@``) are candidates. A lexical pattern is the two words before, the words on
both sides, or the one word before together with the shape of the identifier (digits as
``9``, letters as ``a``, runs at most four long). Pattern-instance links form a graph that is scored in rounds:

* a pattern's score for a kind is the mean score of its distinct instances, shrunk by ``SHRINK`` of no
  score, so that few instances prove nothing;
* an instance's score is 1 for a seed's kind, else the best score of its patterns.

Candidates in a context whose pattern ends at ``ACCEPT`` or more, with at least ``SUPPORT``
different seeds behind it, are spans of that pattern's kind. Base spans always stay; a candidate that
overlaps one is never taken.

Texts are read once: matches are cut out, checked and hashed with their contexts (whole words, of any length) in the row.
Their places are running sums over the matches of a kind, and whether a candidate is free is a running maximum of the base
spans' ends, both in windows over one exchange by row; so time grows as n log n with the matches of a text. Sums over
patterns and instances are aggregated partially, and no group is collected but the spans of one document. Null texts are empty; rows come back as they came in, with null or repeated doc_ids;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
ACCEPT = 0.8
SHRINK = 2.0
SUPPORT = 5

# The base patterns, written so that Java's matcher takes linear time and constant stack: a
# match can only begin where its first run does or where the last match ended, and repeated groups
# are possessive, since nothing follows them. A card is a whole chain of digits of valid length.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_CANDIDATE = r"(?<![A-Za-z0-9_@.+-])(?:(?=(?:[A-Za-z_@.+-]*+[0-9]){4})|(?=[A-Za-z0-9_.+-]++@))[A-Za-z0-9_@.+-]++"


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$")
    if kind == "card":
        return _luhn(F.regexp_replace(value, r"[\x20-]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, r"[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test that spares most texts the pattern."""
    return text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9@]" if kind == "candidate" else "[0-9]")


_MATCHES = "array<struct<no:int,skip:int,size:int,valid:boolean,instance:bigint,contexts:array<bigint>>>"


def _contexts(before: Column, value: Column, after: Column) -> Column:
    """Hashes of the contexts of an identifier that stands between two pieces of text.

    The words before are read from the piece's end, backwards, so that a long piece costs no search.
    """
    plain = lambda text: F.regexp_replace(F.lower(text), r"[0-9]+", "9")
    back = F.reverse(before)
    # What stands between the word and the identifier counts: "card: 1" and "card 1" differ.
    one = plain(F.reverse(F.regexp_extract(back, r"^(\s*+\S++)", 1)))
    two = plain(F.reverse(F.regexp_extract(back, r"^(\s*+\S++\s++\S++)", 1)))
    right = plain(F.regexp_extract(after, r"^([^\s\p{L}]{0,3}\s*\S+)", 1))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), r"\p{L}", "a"), r"(9|a)\1{3,}+", "$1$1$1$1")
    return F.array_compact(F.array(
        F.when(one != "", F.xxhash64(F.lit("1"), one, shape)), F.when(two != "", F.xxhash64(F.lit("2"), two)), F.when((one != "") & (right != ""), F.xxhash64(F.lit("b"), one, right))
    ))


def _matches(df: DataFrame, kind: str, pattern: str, valid) -> DataFrame:
    """Adds a column ``kind``: the matches of ``text`` in turn, each with the length of what stands between it and the one before."""
    no = KINDS.index(kind) if kind in KINDS else len(KINDS)
    df = df.withColumn("m", F.when(_may_hold(kind, F.col("text")), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("n", F.coalesce(F.size("m"), F.lit(0)))
    df = df.withColumn("g", F.when(F.col("n") > 0, F.split("text", pattern, -1)))
    df = df.withColumn("z", F.when(F.col("n") > 0, F.arrays_zip("m", F.slice("g", F.lit(1), F.col("n")).alias("before"), F.slice("g", F.lit(2), F.col("n")).alias("after"))))
    each = F.transform("z", lambda z: F.struct(
        F.lit(no).alias("no"), F.length(z["before"]).alias("skip"), F.length(z["m"]).alias("size"), valid(z["m"]).alias("valid"),
        F.xxhash64(z["m"]).alias("instance"), _contexts(z["before"], z["m"], z["after"]).alias("contexts"),
    ))
    return df.withColumn(kind, F.coalesce(each, F.array()).cast(_MATCHES)).drop("m", "n", "g", "z")


def matched(docs: DataFrame) -> DataFrame:
    """Per row: row (a number of its own), doc_id, and the matches of all kinds, those of each in turn."""
    df = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        df = _matches(df, kind, PATTERNS[kind], lambda value, kind=kind: _valid(kind, value))
    df = _matches(df, "candidate", _CANDIDATE, lambda value: F.lit(True))
    return df.select("row", "doc_id", F.concat(*KINDS, "candidate").alias("found"))


def placed(matches: DataFrame) -> DataFrame:
    """(row, no, start, end, instance, contexts) of valid base spans, and of the candidates that overlap none. In code points."""
    each = matches.select("row", F.posexplode_outer("found").alias("at", "m")).where("at IS NOT NULL").select("row", "at", "m.*").repartition("row")
    end = F.sum(F.col("skip") + F.col("size")).over(Window.partitionBy("row", "no").orderBy("at")).cast("int")
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).where("valid")
    base = F.col("no") < len(KINDS)
    # A candidate comes where it ends, before the base spans that begin there; it is free if none so far ends past its beginning.
    reached = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("row").orderBy(F.when(base, F.col("start")).otherwise(F.col("end")), base).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return spans.withColumn("reached", reached).where(base | F.col("reached").isNull() | (F.col("reached") <= F.col("start"))).select("row", "no", "start", "end", "instance", "contexts")


def accepted_patterns(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind number, score) of the patterns that may discover; at most one kind each."""
    kinds = range(len(KINDS))
    graph = common.written(occurrences.groupBy("pattern", "instance").agg(*[F.max((F.col("no") == k).cast("double")).alias(f"seed{k}") for k in kinds]), "graph")
    seeds = [f"seed{k}" for k in kinds]
    counted = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"), *[F.sum(s).alias(f"n_{s}") for s in seeds])
    # Patterns without enough seeds of one kind can't be accepted, but they carry scores to the rest.
    hopeful = counted.where(F.greatest(*[F.col(f"n_{s}") for s in seeds]) >= SUPPORT)
    scores = None
    for _ in range(rounds):
        if scores is None:
            now = graph.select("pattern", *[F.col(s).alias(f"x{k}") for k, s in enumerate(seeds)])
        else:
            best = graph.join(scores, "pattern").groupBy("instance").agg(*[F.max(f"score{k}").alias(f"best{k}") for k in kinds])
            seeded = F.greatest(*seeds) > 0
            now = graph.join(best, "instance").select("pattern", *[F.when(seeded, F.col(s)).otherwise(F.col(f"best{k}")).alias(f"x{k}") for k, s in enumerate(seeds)])
        scores = common.written(now.groupBy("pattern").agg(*[(F.sum(f"x{k}") / (F.count(F.lit(1)) + SHRINK)).alias(f"score{k}") for k in kinds]), "scores")
    rows = scores.join(hopeful, "pattern").select("pattern", F.array_max(F.array(*[F.when(F.col(f"n_seed{k}") >= SUPPORT, F.struct(F.col(f"score{k}").alias("score"), F.lit(k).alias("kind"))) for k in kinds])).alias("top"))
    return rows.select("pattern", "top.kind", "top.score").where(F.col("score") >= ACCEPT)


def base_spans(docs: DataFrame) -> DataFrame:
    """The spans of ``placed``, in one plan."""
    return placed(matched(docs))


def discovered(spans: DataFrame) -> DataFrame:
    """(row, no, start, end) of the candidates that accepted patterns take."""
    occurrences = common.written(spans.select("row", "start", "end", "no", "instance", F.explode_outer("contexts").alias("pattern")).where("pattern IS NOT NULL"), "occurrences")
    patterns = common.written(accepted_patterns(occurrences), "accepted")
    taken = occurrences.where(F.col("no") == len(KINDS)).join(common.sized(patterns), "pattern")
    return taken.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("no")).select("row", "no", "start", "end")


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, base and spans as text."""
    rows = common.written(matched(docs), "matches")
    spans = common.written(placed(rows), "spans")
    base = spans.where(F.col("no") < len(KINDS)).select("row", "no", "start", "end", F.lit(True).alias("base"))
    every = base.unionByName(discovered(spans).withColumn("base", F.lit(False)))
    one = F.struct("start", "no", "end")
    # The spans of one row: no longer than its text.
    found = common.written(
        every.groupBy("row").agg(
            F.sort_array(F.collect_list(F.when(F.col("base"), one))).alias("base"), F.sort_array(F.collect_list(one)).alias("every"),
            *[F.count_if(F.col("base") & (F.col("no") == i)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        ).select("row", _named(F.col("base")).alias("base_spans"), _named(F.col("every")).alias("spans"), *[f"n_{k}" for k in KINDS]), "found",
    )
    joined = rows.select("row", "doc_id").join(common.sized(found), "row", "left")
    return joined.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op10's result, what SQL can say too: all but the spans that the method adds."""
    return op10_pii(spark, sf_dir).drop("spans")


BASE_ORACLE = r"""
WITH k(kind, no, p) AS (VALUES ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 1, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
  ('card', 2, '[0-9](?:[\x20-]?[0-9])+'), ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]')),
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, kind, no, regexp_extract_all(text, p) AS m, string_split_regex(text, p) AS g FROM t, k),
i AS (SELECT doc_id, kind, no, m, g, unnest(range(1, len(m) + 1)) AS i FROM m),
s AS (SELECT doc_id, kind, no, m[i] AS v, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM i),
d AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM s),
b AS (SELECT * FROM d WHERE CASE kind WHEN 'email' THEN true
  WHEN 'ip' THEN list_max(list_transform(string_split(v, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE CAST(x AS INTEGER) END)) <= 255
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  ELSE length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j:
    CASE WHEN j % 2 = 1 THEN CAST(reverse(digits)[j] AS INTEGER) WHEN reverse(digits)[j] > '4' THEN 2 * CAST(reverse(digits)[j] AS INTEGER) - 9 ELSE 2 * CAST(reverse(digits)[j] AS INTEGER) END)) % 10 = 0 END)
SELECT t.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || (start + length(v)), ',' ORDER BY start, no), '')) AS base_sha256
FROM t LEFT JOIN b ON b.doc_id = t.doc_id GROUP BY t.doc_id
"""
