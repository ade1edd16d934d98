"""Crawl planning: sitemap rows, robots rules and the ordered, capped URL table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garderobe.functions.markup import decode_entities
from garderobe.operators.ranking import top_n


def sitemap_rows(documents: DataFrame) -> DataFrame:
    """(store, kind, ord, loc, lastmod_ms) from sitemap XML texts (store, xml); bare <loc> elements count when there are no entries."""
    kind = F.when(F.col("xml").rlike(r"(?i)<sitemapindex[\s>]"), "index").otherwise("urlset")
    entries = F.regexp_extract_all("xml", F.lit(r"(?is)<(url|sitemap)>([\s\S]*?)</\1>"), F.lit(2))
    bare = F.regexp_extract_all("xml", F.lit(r"(?i)(<loc>\s*[^<]+?\s*</loc>)"), F.lit(1))
    docs = documents.select("store", kind.alias("kind"), entries.alias("_e"), bare.alias("_b"))
    rows = docs.select("store", "kind", F.posexplode(F.when(F.size("_e") > 0, F.col("_e")).otherwise(F.col("_b"))).alias("ord", "block"))
    loc = decode_entities(F.regexp_extract("block", r"(?i)<loc>\s*([^<]+?)\s*</loc>", 1))
    mod = F.nullif(F.regexp_extract("block", r"(?i)<lastmod>\s*([^<]+?)\s*</lastmod>", 1), F.lit(""))
    return rows.select("store", "kind", "ord", loc.alias("loc"), F.unix_millis(mod.try_cast("timestamp")).alias("lastmod_ms")).filter(F.col("loc") != "")


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, agents, allow, path) from robots files (host, txt).

    Lines are numbered; a run of agent lines opens a group, any other field closes the run, and each rule belongs to the last group
    opened before it. A file's lines are bounded by the file, so the windows run per host.
    """
    lines = files.select("host", F.posexplode(F.split("txt", r"\r?\n")).alias("n", "raw"))
    bare = F.trim(F.regexp_replace("raw", "#.*$", ""))
    fields = lines.withColumn("line", bare).filter(F.contains("line", F.lit(":"))).select(
        "host", "n", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"),
        F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    by_line = Window.partitionBy("host").orderBy("n")
    agent = F.col("field") == "user-agent"
    opens = agent & ~F.coalesce(F.lag("field").over(by_line) == "user-agent", F.lit(False))
    groups = fields.withColumn("grp", F.sum(F.when(opens, 1).otherwise(0)).over(by_line)).filter("grp > 0")
    agents = groups.filter(agent).groupBy("host", "grp").agg(F.collect_set(F.lower("value")).alias("agents"))
    rules = groups.filter(F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    return agents.join(rules, ["host", "grp"], "left").select("host", "grp", "agents", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))


def path_pattern(path):
    """A robots path as a regular expression: * is any run, a trailing $ anchors the end."""
    escaped = F.regexp_replace(path, r"([.+?^${}()|\[\]\\])", r"\\$1")
    wild = F.replace(escaped, F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), F.regexp_replace(wild, r"\\\$$", F.lit("\\$")))


def allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Adds ``allowed`` to (host, path) rows: groups naming the agent, else the * groups; longest rule wins, allow wins ties."""
    token = agent.lower()
    named = F.exists("agents", lambda a: (a != "*") & (F.contains(F.lit(token), a) | F.contains(a, F.lit(token))))
    marked = rules.withColumn("_mine", named).withColumn("_any", F.array_contains("agents", "*"))
    chosen = marked.withColumn("_has", F.bool_or("_mine").over(Window.partitionBy("host"))).filter(
        F.col("_mine") | (~F.col("_has") & F.col("_any"))).filter(F.col("path").isNotNull())
    patterns = chosen.select("host", "allow", F.length("path").alias("len"), path_pattern(F.col("path")).alias("re"))
    distinct = urls.select("host", "path").distinct()
    verdict = distinct.join(patterns, "host").filter(F.rlike("path", F.col("re"))).groupBy("host", "path").agg(
        F.max_by("allow", F.struct("len", "allow")).alias("_allow"))
    return urls.join(verdict, ["host", "path"], "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_allow")


def crawl_order(urls: DataFrame, stores: DataFrame, cap: int) -> DataFrame:
    """Product URLs per store, dress pages first, then freshest, then sitemap order: (store, loc, rank) up to the cap.

    ``stores`` has (store, product_url_pattern, exclude_url_patterns).
    """
    rows = urls.groupBy("store", "loc").agg(F.min("ord").alias("ord"), F.max("lastmod_ms").alias("lastmod_ms")).join(stores, "store")
    keep = F.rlike("loc", F.concat(F.lit("(?i)"), "product_url_pattern")) & ~F.exists(
        F.coalesce("exclude_url_patterns", F.array().cast("array<string>")), lambda p: F.rlike(F.col("loc"), F.concat(F.lit("(?i)"), p)))
    order = [F.when(F.col("loc").rlike("(?i)dress"), 0).otherwise(1), F.desc(F.coalesce("lastmod_ms", F.lit(0))), F.asc("ord"), F.asc("loc")]
    return top_n(rows.filter(keep), ["store"], order, cap).select("store", "loc", "rank")


def crawl_plan(sitemaps: DataFrame, robots: DataFrame, stores: DataFrame, agent: str, cap: int) -> DataFrame:
    """Allowed URLs of url sets, ordered and capped per store."""
    rows = sitemap_rows(sitemaps).filter(F.col("kind") == "urlset").withColumns({
        "host": F.try_parse_url("loc", F.lit("HOST")), "path": F.coalesce(F.try_parse_url("loc", F.lit("FILE")), F.lit("/"))})
    return crawl_order(allowed(rows, robots_rules(robots), agent).filter("allowed"), stores, cap)
