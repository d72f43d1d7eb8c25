"""URL filter: a trie over reversed host labels, then path segments, with the longest rule winning.

Rules are (host, path, verdict). A rule fits its host and all subdomains where the url's path starts
with the rule's path; a path's last segment may end inside a segment of the url. Of the rules that fit, that of most
characters (host and path) wins, of equally long ones that of more host labels; an allow entry wins over a block entry for
the same place. Urls that no rule fits are allowed.

The trie is sent to the workers only up to MAX_TRIE_RULES rules; larger lists are joined on host suffixes
instead, with the same answers; each suffix is dealt to SALTS tasks, since a top-level label may hold most urls.

Cases: null urls and urls without "://" have an empty host and path, no rule and the default verdict;
repeated rows are judged each; long urls are read whole; other columns are ignored and may have any name; an empty table,
or an empty list of rules, is no special case.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rules a broadcast trie may hold, about 100 MB in a worker.
MAX_TRIE_RULES = 200_000
DEFAULT = "allow"
SALTS = 16

Rule = tuple[str, str, str]


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested labels; under "/" the paths: whole segments as nested nodes, last segments in "*" as prefixes."""
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        *whole, last = path.split("/")
        node = node.setdefault("/", {})
        for segment in whole:
            node = node.setdefault(("seg", segment), {})
        ends = node.setdefault("*", {})
        if ends.get(last, ("", "block"))[1] != "allow":
            ends[last] = (host + path, verdict)
    return root


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    found, node = None, trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        best = match_path(node["/"], segments) if "/" in node else None
        if best and (found is None or len(best[0]) >= len(found[0])):
            found = best
    return found


def match_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
    best = None
    for segment in segments:
        ends = node.get("*")
        if ends:
            for n in range(min(len(segment), max(map(len, ends))), -1, -1):
                if segment[:n] in ends:
                    best = ends[segment[:n]]
                    break
        node = node.get(("seg", segment))
        if node is None:
            return best
    return best


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; native."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, rules: list[Rule], default: str = DEFAULT, max_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every url."""
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    if len(rules) > max_rules:
        return judge_by_join(cut, pages.sparkSession.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string"), default)
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf(T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
    def look(hosts, paths):
        import pandas as pd

        got = [match(trie.value, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(got, columns=["rule", "verdict"])

    return cut.withColumn("m", look("host", "path")).select("page_id", "host", "path", "m.rule", "m.verdict")


def judge_by_join(cut: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The same without a broadcast: each distinct (host, path) meets the rules of its host suffixes."""
    n = F.size(F.split("host", "\\."))
    places = cut.select("host", "path").distinct()
    tails = places.withColumn("k", F.explode(F.sequence(F.lit(1), n))).withColumns({"rule_host": F.expr("substring_index(host, '.', -k)"), "salt": F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")})
    dealt = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    fits = tails.join(dealt, ["rule_host", "salt"]).filter(F.startswith("path", "rule_path"))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), "k", (F.col("rule_verdict") == "allow").alias("first"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("m"))
    return cut.join(best, ["host", "path"], "left").select("page_id", "host", "path", "m.rule", F.coalesce("m.verdict", F.lit(default)).alias("verdict"))
