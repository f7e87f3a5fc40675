"""Allow and block rules over hosts and paths, by hashed expressions.

A rule is a host and a path (`example.org/en/`): it fits the host itself and all of its subdomains, if a URL's path starts with the rule's. Each URL is
expanded into the suffixes of its host, cut at dots, which meet the hosts of the rules on the first `SHORT_BYTES` bytes of their SHA-256; the whole digest confirms.
Each host so found says which lengths of path its rules have, and the URL's path is expanded into prefixes of these lengths alone. Host suffix and path
prefix together are an expression, which meets the rules in the same way: an equi-join on the short hash, then the whole digest. Of the rules that fit, the longest wins.

Only expressions that a bitmap of the short hashes lets through (32 MB at most) are joined, so most URLs cost no shuffle there. The winner is found per different host
and path, pre-aggregated in each task, and joined back to the rows: a URL that a third of all rows have is one row per task on one side of the join and can be split on the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_bits, flag_in_bitmap, key_bitmap, materialize, unused

SHORT_BYTES = 4
#: Rule tables of so many rows at most are broadcast (some 100 bytes a row); larger ones are joined by a shuffle.
BROADCAST_RULES = 100_000
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a rule's rank below the length of the whole rule: length of the host, and one for `block`.
_HOST_BITS = 31


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL: what follows the first `://`, cut at `/`, `?` or `#`, and from there up to `?` or `#`. Without `://`: empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) of a list in code."""
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules]
    empty = F.array().cast("array<struct<rule:string,verdict:string>>")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else empty))


def _hashed(df: DataFrame, chars: Column, digest: str, short: str) -> DataFrame:
    """`df` with the SHA-256 of `chars` and its first bytes as a number."""
    df = df.withColumn(digest, F.unhex(F.sha2(chars.cast("binary"), 256)))
    return df.withColumn(short, F.conv(F.hex(F.substring(digest, 1, SHORT_BYTES)), 16, 10).cast("long"))


def _prepared(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: the different rules with their rank, and their hosts with the lengths of path."""
    host = F.substring_index("rule", "/", 1)
    parts = rules.filter("rule IS NOT NULL AND rule != '' AND verdict IS NOT NULL").select(
        F.translate(host, _UPPER, _LOWER).alias("_rule_host"), F.substring(F.col("rule"), F.length(host) + 1, F.length("rule")).alias("_rule_path"), "verdict"
    )
    once = parts.groupBy("_rule_host", "_rule_path").agg(F.max((F.col("verdict") == BLOCK).cast("long")).alias("_block"))
    length = F.length("_rule_host") + F.length("_rule_path")
    rank = length.cast("long") * (1 << (_HOST_BITS + 1)) + F.length("_rule_host").cast("long") * 2 + F.col("_block")
    known = _hashed(once, F.concat("_rule_host", "_rule_path"), "_rule_digest", "_rule_short").select("_rule_short", "_rule_digest", rank.alias("_rank"), "_rule_host", F.length("_rule_path").alias("_length"))
    known = materialize(known, "url-rules")
    hosts = known.groupBy("_rule_host").agg(F.collect_set("_length").alias("_lengths"))
    hosts = _hashed(hosts, F.col("_rule_host"), "_rule_digest", "_rule_short").select("_rule_short", "_rule_digest", "_lengths", F.size(F.split("_rule_host", r"\.")).alias("_labels"))
    return known.drop("_rule_host", "_length"), materialize(hosts, "url-hosts")


def _meet(expressions: DataFrame, table: DataFrame, rows: int) -> DataFrame:
    """The expressions (_digest, _short) joined with the rows of `table` of the same short hash whose digest is theirs."""
    bits = bitmap_bits(rows)
    maybe = flag_in_bitmap(expressions, "_short", key_bitmap(table.select("_rule_short"), "_rule_short", bits), "_maybe", bits).filter("_maybe")
    near = maybe.join(F.broadcast(table) if rows <= BROADCAST_RULES else table, F.col("_short") == F.col("_rule_short"))
    return near.filter(F.col("_digest") == F.col("_rule_digest")).drop("_maybe", "_digest", "_short", "_rule_digest", "_rule_short")


def winners(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(_host, _path, _rank) of each host and path of `urls` (_host, _path) that a rule fits; the rank is that of the longest rule, see `_decoded`."""
    known, hosts = _prepared(rules)
    n = known.count()
    labels = hosts.agg(F.max("_labels")).first()[0] or 0
    own = F.length("_host") - F.length(F.replace("_host", F.lit("."), F.lit(""))) + 1
    suffixes = F.expr("transform(sequence(1, _n), i -> substring_index(_host, '.', -i))")
    hosted = urls.filter("_host != ''").withColumn("_n", F.least(own, F.lit(labels))).filter("_n > 0")
    found = _meet(_hashed(hosted.select("_host", "_path", F.explode(suffixes).alias("_suffix")), F.col("_suffix"), "_digest", "_short"), hosts, n)
    found = found.select("_host", "_path", "_suffix", F.explode(F.filter("_lengths", lambda k: k <= F.length("_path"))).alias("_k"))
    found = _meet(_hashed(found, F.concat("_suffix", F.left("_path", F.col("_k"))), "_digest", "_short"), known, n)
    return found.groupBy("_host", "_path").agg(F.max("_rank").alias("_rank"))


def _decoded(rank: Column, host: Column, path: Column) -> tuple[Column, Column]:
    """The rule of a rank, as part of the host and path that it fits, and its verdict."""
    of_host = F.shiftright(rank, 1).bitwiseAND((1 << _HOST_BITS) - 1).cast("int")
    of_path = F.shiftright(rank, _HOST_BITS + 1).cast("int") - of_host
    return F.concat(F.right(host, of_host), F.left(path, of_path)), F.when(rank.bitwiseAND(1) == 1, BLOCK).otherwise(ALLOW)


def _marked(df: DataFrame, url_col: str, rules: DataFrame) -> DataFrame:
    """(_in, _host, _path, _rank) of each row of `df`."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_in"), F.coalesce(host, F.lit("")).alias("_host"), F.coalesce(path, F.lit("")).alias("_path"))
    best = winners(rows.select("_host", "_path"), rules)
    # other expressions than the grouping keys: both join sides get an exchange that AQE can split
    best = best.select(F.concat("_host", F.lit("/")).alias("_h"), F.concat("_path", F.lit("/")).alias("_p"), "_rank")
    return rows.join(best, (F.concat("_host", F.lit("/")) == F.col("_h")) & (F.concat("_path", F.lit("/")) == F.col("_p")), "left").drop("_h", "_p")


def judge_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """One row per row of `df`: id, host, path, the rule that decides (null: none fits) and its verdict, or `default`.

    `rules` has (rule, verdict); a rule is a host, A-Z counting as lower case, and all from its first `/` on is the path, which may be empty. The longest rule that fits
    wins; of two as long the one with the longer host, and of equal ones `block`. A rule that is null, empty or without a verdict is none; a verdict other than `block` allows.

    A null URL, or one without `://`, has an empty host and path, which no rule fits. A path that is empty doesn't start with `/`. A host of any number of labels
    and a path of any length are read whole. Rows that repeat stay as often as they came, with or without an id. An empty table gives an empty result, and without
    rules all rows get the default. Other columns of `df` are ignored, whatever their names.
    """
    inside = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"))
    rule, verdict = _decoded(F.col("_rank"), F.col("_host"), F.col("_path"))
    marked = _marked(inside, "_url", rules)
    return marked.select(
        F.col("_in._id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.when(F.col("_rank").isNotNull(), rule).alias("rule"), F.when(F.col("_rank").isNotNull(), verdict).otherwise(default).alias("verdict")
    )


def drop_blocked(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """The rows of `df` that `judge_urls` allows, with their columns, whatever their names."""
    name = unused(df, "_rank")
    _, verdict = _decoded(F.col("_rank"), F.col("_host"), F.col("_path"))
    marked = _marked(df, url_col, rules).select("_in", F.when(F.col("_rank").isNotNull(), verdict).otherwise(default).alias(name))
    return marked.filter(F.col(name) != BLOCK).select("_in.*")


#: The rules of the query.
RULES = [("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK)]


def op11_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


SQL = {
    "op11_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), h AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM p
), r(top, below, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), f AS (
  SELECT host, path, top || below AS rule, verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(top || below) DESC) AS n
  FROM (SELECT DISTINCT host, path FROM h) JOIN r ON (host = top OR ends_with(host, '.' || top)) AND starts_with(path, below)
)
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM h LEFT JOIN f ON f.host = h.host AND f.path = h.path AND f.n = 1
"""
}
