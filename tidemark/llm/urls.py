"""URL rules: a blocked Bloom filter of the listed canonical URLs in front of an exact hash join.

A rule is a host and a path prefix. A url asks for every listed host suffix of its own (at label borders) with every prefix of its path that is
as long as a listed path is. These keys meet the filter (llm/bloom.py) first. Keys that pass go to an exact join with the list, which removes false positives; the longest rule
wins. The filter holds hosts as well as whole keys, so a suffix that no rule has is done with before paths are cut.

A list of up to BROADCAST_BYTES meets the keys by a broadcast. A longer one is joined with components.met, in which a frequent key is spread over
tasks, and urls without a key take no part.

Defined results: a null url or one without :// has an empty host and path and no rule; a url that no rule fits gets the default verdict;
of equal rules with both verdicts block wins; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .bloom import bloom_filter, passes
from .common import read, stored
from .components import met

#: (verdict, host, path prefix). Fixed values.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
DEFAULT = "allow"
BROADCAST_BYTES = 32 << 20


def parts(url: str) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def _may_be(rows: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key is null or may be listed. The filter is asked in the join's own condition, so it is never a part of a row."""
    return rows.join(F.broadcast(bloom), F.col(key).isNull() | passes(F.col(key), blocks)).drop("bloom")


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages. rules: verdict, host, path."""
    rules = rules.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    rules = rules.select("host", F.concat("host", "path").alias("rule"), F.concat_ws(" ", "host", "path").alias("key"), F.length("path").alias("n_path"), F.when(F.col("blocks"), "block").otherwise("allow").alias("said"))
    count, size, lengths = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("rule") + F.octet_length("key") + 32), F.lit(0)), F.collect_set("n_path")).first()
    bloom, blocks = bloom_filter(rules.select("key").unionByName(rules.select(F.col("host").alias("key"))).distinct(), 2 * count)
    rules = rules.drop("host")
    host, path = parts("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    # a null suffix keeps the row, whatever the filter says of the others
    named = rows.withColumn("suffix", F.explode(F.concat(F.array(F.lit(None).cast("string")), suffixes)))
    listed = _may_be(named, "suffix", bloom, blocks)
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.transform(fitting, lambda n: F.concat("suffix", F.lit(" "), F.substring("path", F.lit(1), n)))
    cut = listed.withColumn("key", F.explode(F.when(F.col("suffix").isNull(), F.array(F.lit(None).cast("string"))).otherwise(keys)))
    asked = _may_be(cut, "key", bloom, blocks).select("row", "page_id", "host", "path", "key")
    if size <= broadcast_bytes:
        hits = asked.join(F.broadcast(rules), "key", "left")
    else:
        asked, _ = stored(asked, "asked")
        keyed = asked.where("key is not null")
        found = met(keyed, rules.join(keyed.groupBy("key").agg(F.count("*").alias("n")), "key"), "key", keyed.count())
        hits = found.unionByName(asked, allowMissingColumns=True)
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("long"), F.col("n_path"), "rule", "said")))
    # keys of a row were made side by side: rows are told apart by their place, and grouped within their task's output first
    out = hits.groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.said", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE = f"""
WITH r(said, h, p) AS (VALUES {_VALUES}),
u AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS a FROM pages),
v AS (SELECT i, page_id, translate(regexp_extract(a, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT i, arg_max(h || p, len(h || p)) AS rule, arg_max(said, len(h || p)) AS said FROM v JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(said, '{DEFAULT}') AS verdict FROM v LEFT JOIN m USING (i)"""
