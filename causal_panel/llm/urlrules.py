"""URL filter: a trie over reversed host labels and path segments; the longest match decides between allow and block."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that a broadcast trie may hold (some tens of MB). Longer lists are joined on hosts and path segments.
MOST_RULES = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER_HOST, _RULES = "\0path", "\0rules"


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else the empty text."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """A trie of (verdict, host, path) rules: host labels from the right, then path segments, each with its slash.

    A node's rules are pairs of the last, unended path segment (often empty) and (verdict, rule). Of equal rules a block wins.
    """
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(_AFTER_HOST, {})
        *segments, last = path.split("/")
        for segment in segments:
            node = node.setdefault(segment + "/", {})
        held = node.setdefault(_RULES, {})
        if held.get(last, ("", ""))[0] != "block":
            held[last] = verdict, host.lower() + path
    return root


def longest(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """(verdict, rule) of the longest rule that fits: most host labels first, then the longest path; (None, None) if none fits."""
    found, node, segments = (None, None), trie, path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            return found
        at, best = node.get(_AFTER_HOST), None
        for k, segment in enumerate(segments):
            if at is None:
                break
            fits = [x for x in at.get(_RULES, {}) if segment.startswith(x)]
            if fits:
                best = at[_RULES][max(fits, key=len)]
            at = at.get(segment + "/") if k < len(segments) - 1 else None
        found = best or found
    return found


def _joined(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """`parsed` (host, path, ...) with `verdict` and `rule`, by joins: the way of the trie for lists that no task could hold.

    Distinct urls meet the rules under each suffix of their host and each run of whole path segments, as the trie's nodes would be met; the end of a
    rule's path need not be a whole segment. Both sides are shuffled, so Spark can split a frequent host.
    """
    cut = F.length("path") - F.locate("/", F.reverse("path")) + 1
    folder = F.when(F.locate("/", F.col("path")) > 0, F.substring("path", F.lit(1), cut)).otherwise(F.lit(""))
    kept = rules.select(F.lower("host").alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("block"), "verdict"))["verdict"].alias("verdict"))
    kept = kept.select(F.col("host").alias("_suffix"), folder.alias("_folder"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    folders = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda k: F.when(k > 0, F.concat(F.array_join(F.slice(segments, 1, k), "/"), F.lit("/"))).otherwise(F.lit("")))
    urls = parsed.select("host", "path").distinct()
    met = urls.select("host", "path", F.explode(suffixes).alias("_suffix"), folders.alias("_folders")).select("host", "path", "_suffix", F.explode("_folders").alias("_folder"))
    fits = met.join(kept, ["_suffix", "_folder"]).filter(F.startswith("path", "_path"))
    rank = F.struct(F.size(F.split("_suffix", r"\.")).alias("labels"), F.length("_path").alias("length"), F.col("_verdict").alias("verdict"), F.concat("_suffix", "_path").alias("rule"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("_found")).select(F.col("host").alias("_host"), F.col("path").alias("_of"), "_found")
    return parsed.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_of")), "left").drop("_host", "_of")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_rules: int = MOST_RULES) -> DataFrame:
    """(`id_col`, host, path, rule, verdict) of every row of `pages`.

    A rule (verdict, host, path) fits its host and all subdomains where the path starts with the rule's; of equal rules a block wins. `default` is the
    verdict where none fits. A null url, or one without `://`, has an empty host and path, so no rule and the default. Equal rows are judged each;
    other columns are left out; an empty table gives an empty result. Up to `most_rules` rules travel as a broadcast trie; a longer list, or a table
    of rules, is joined, with the same result.
    """
    parsed = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if isinstance(rules, DataFrame) or len(rules) > most_rules:
        listed = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
        found = _joined(parsed, listed)
    else:
        trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

        @F.pandas_udf("verdict string, rule string")
        def look_up(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([longest(trie.value, h, p) for h, p in zip(hosts, paths, strict=True)], columns=["verdict", "rule"])

        found = parsed.withColumn("_found", look_up("host", "path"))
    return found.select(F.col("_id").alias(id_col), "host", "path", F.col("_found.rule").alias("rule"), F.coalesce("_found.verdict", F.lit(default)).alias("verdict"))
