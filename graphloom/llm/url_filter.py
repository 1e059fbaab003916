"""URL filter: blocked Bloom filter of listed canonical URLs, then an exact hash join; and prefix rules.

A listed URL stands for all URLs of its canonical form: host in lower case without a default port, path without
repeated and trailing slashes, parameters without tracking ones and sorted, no scheme and no fragment.  The canonical form
of every URL probes a Bloom filter split into 512-bit blocks, so that one key touches one block; what passes is
joined exactly with the list, which removes the filter's false positives.

A rule is ``(host, path, action)``; it fits its host and all subdomains if the URL's path starts with the rule's.  Rules are
few: a URL's host suffixes and path prefixes of the rules' lengths are joined with them.  The longest rule decides, else a
listed URL is blocked, else allowed.

Defined cases: a null URL, or one without ``://``, has empty host and path, no canonical form, and fits nothing; an
empty path fits only rules with an empty path; repeated rows and ids are judged each for itself
(the verdict depends on the URL alone); without rules and list all is allowed; null entries are not read; other columns of the input
are kept out of the joins and never clash, as the result takes only the id and the URL.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the query: (action, host, path) rules, and the listed URLs: pages by number of some hosts and languages.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
LISTED_HOSTS = ["spam-farm.example.org", "www.spam-farm.example.org", "cheap-pills.example.org", "www.cheap-pills.example.org", "spam-farm.example.net", "cheap-pills.example.net"]
LISTED_LANGUAGES, LISTED_PAGES = ["en", "de", "fr", "es"], 4_000
#: Parameters that say where a visitor came from; fixed prefix of their names.
TRACKING = "utm_"

BITS_PER_KEY, PROBES, BLOCK_BITS = 16, 6, 512
#: Filter blocks (64 bytes each) up to which the filter is broadcast.
BROADCAST_BLOCKS = 250_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """The canonical form of a URL; null where it has no ``://`` or no host."""
    host, path = url_host_path(url)
    host = F.regexp_replace(host, r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"/$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith(TRACKING)))
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _bits(key: Column) -> Column:
    """The bit positions of a key within its block, nine bits of a second hash for each."""
    h = F.xxhash64(F.lit("bits"), key)
    return F.array(*[F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(PROBES)])


def build_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """``(block, words)``: the blocks of the Bloom filter of ``key`` that have any bit set, each as eight longs."""
    bit = keys.select(_block(F.col("key"), blocks).alias("block"), F.explode(_bits(F.col("key"))).alias("p"))
    word, mask = F.col("p") / 64, F.expr("shiftleft(1L, p % 64)")
    return bit.groupBy("block").agg(F.array(*[F.bit_or(F.when(F.floor(word) == i, mask).otherwise(F.lit(0).cast("long"))) for i in range(BLOCK_BITS // 64)]).alias("words"))


def possible(keys: DataFrame, listed: DataFrame, n: int) -> DataFrame:
    """The rows of ``keys`` whose ``key`` passes the filter of the ``n`` rows of ``listed``: all that are listed and few more."""
    blocks = max(1, -(-n * BITS_PER_KEY // BLOCK_BITS))
    bloom = common.broadcast_if(build_filter(listed, blocks), blocks, BROADCAST_BLOCKS)
    probed = keys.withColumns({"block": _block(F.col("key"), blocks), "bits": _bits(F.col("key"))})
    return probed.join(bloom, "block").where("forall(bits, p -> (shiftright(words[p div 64], p % 64) & 1L) = 1L)").select(*keys.columns)


def rule_keys(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """For each ``(url, host, path)`` the keys under which a rule that fits it could be listed."""
    parts = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    paths = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    return urls.where("host <> ''").select("url", F.explode(hosts).alias("host"), paths.alias("paths")).select("url", "host", F.explode("paths").alias("path"))


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, canonical, rule, listed, verdict`` of every row; ``rules``: ``host, path, action``, ``listed``: ``url``."""
    host, path = url_host_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path, "canonical": canonical_url(F.col("url"))})
    urls = rows.select("url", "host", "path", F.col("canonical").alias("key")).where("key is not null").distinct()
    rules = rules.select("host", "path", "action").where("host is not null and path is not null").distinct()
    n, lengths = rules.agg(F.count(F.lit(1)), F.collect_set(F.length("path"))).first()
    hits = rule_keys(urls, sorted(lengths)).join(common.broadcast_if(rules, n), ["host", "path"])
    best = F.max(F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), "action"))
    judged = hits.groupBy("url").agg(best.alias("r"))
    listed = listed.select(canonical_url(F.col("url")).alias("key")).where("key is not null").distinct()
    n = listed.count()
    found = possible(urls.select("key").distinct(), listed, n).join(common.broadcast_if(listed, n), "key", "left_semi")
    found = found.select(F.col("key").alias("canonical"), F.lit(True).alias("listed"))
    out = rows.join(judged, "url", "left").join(found, "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    verdict = F.coalesce("r.action", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "canonical", F.col("r.rule").alias("rule"), "listed", verdict.alias("verdict"))


def listed_urls(spark: SparkSession) -> DataFrame:
    """The query's list, from its rule: ``url``."""
    hosts, langs = (F.explode(F.array(*map(F.lit, x))) for x in (LISTED_HOSTS, LISTED_LANGUAGES))
    rows = spark.range(LISTED_PAGES).select("id", hosts.alias("h")).select("id", "h", langs.alias("l"))
    return rows.select(F.concat(F.lit("https://"), "h", F.lit("/"), "l", F.lit("/"), F.col("id").cast("string")).alias("url"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(h, p, a) for a, h, p in RULES], "host string, path string, action string")
    return filter_urls(common.table(spark, sf_dir, "pages"), rules, listed_urls(spark))


def _values(rows: list) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


SQL = f"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
r AS (SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM u),
c AS (SELECT *, regexp_replace(host, ':(80|443)$', '') AS h, regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') AS p,
      array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, '{TRACKING}'))), '&') AS q FROM r),
d AS (SELECT *, CASE WHEN h <> '' THEN h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM c),
fit AS (SELECT r.k, v.action, v.h || v.p AS rule, length(v.h || v.p) AS n FROM r, (VALUES {_values(RULES)}) v(action, h, p)
        WHERE (r.host = v.h OR ends_with(r.host, '.' || v.h)) AND starts_with(r.path, v.p)),
b AS (SELECT k, arg_max(rule, n) AS rule, arg_max(action, n) AS action FROM fit GROUP BY k),
l AS (SELECT h || '/' || lang || '/' || i AS url FROM (VALUES {_values([[h] for h in LISTED_HOSTS])}) a(h), (VALUES {_values([[x] for x in LISTED_LANGUAGES])}) g(lang), range({LISTED_PAGES}) t(i))
SELECT page_id, host, path, canonical, rule, canonical IS NOT NULL AND canonical IN (SELECT url FROM l) AS listed,
       coalesce(action, CASE WHEN canonical IN (SELECT url FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM d LEFT JOIN b USING (k)
"""
