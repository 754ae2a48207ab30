"""URL filters: host and path rules, then association rules over URL tokens mined from labels by pattern growth (FP-growth)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import UPPER, LOWER, stored, table

#: Fixed values: (verdict, rule); a rule is a host and the start of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Listed rules travel inside the plan; this bounds their number.
MOST_RULES = 10_000
#: A token set must be in this share of the labelled URLs, and so many of those must be labelled block.
SUPPORT, CONFIDENCE = 0.005, 0.7


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and the domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def listed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(length, rule, verdict) of the longest listed rule that fits, or null; ties go to the greater rule, then verdict.

    Rules are indexed by host; a URL looks up its host and the domains above it, so the number of rules is no factor.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} can be listed")
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        by_host.setdefault(h.lower(), []).append((slash + p, rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    entry = lambda p, r, v: F.struct(F.lit(p).alias("path"), F.struct(F.lit(len(r)).alias("length"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")).alias("of"))
    index = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*[entry(*r) for r in rs]))])
    near = F.flatten(F.filter(F.transform(host_suffixes(host), lambda s: F.try_element_at(index, s)), lambda x: x.isNotNull()))
    return F.array_max(F.transform(F.filter(near, lambda r: F.startswith(path, r["path"])), lambda r: r["of"]))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, domain of two labels, path parts (numbers as #), file ending, query keys, fragment."""
    host, path = url_host(url), url_path(url)
    labels = F.split(host, r"\.")
    said = lambda p, xs: F.transform(F.filter(xs, lambda x: x.isNotNull() & (x != "")), lambda x: F.concat(F.lit(f"{p}:"), x))
    parts = F.split(F.regexp_replace(path, "[0-9]+", "#"), "/")
    keys = F.coalesce(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]*)"), F.lit(1)), F.array())
    one = lambda pattern, x: F.array(F.regexp_extract(x, pattern, 1))
    domain = F.array(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
    every = F.concat(said("host", labels), said("path", parts), said("query", keys), said("ending", one(r"\.([A-Za-z0-9]{1,8})$", path)), said("scheme", one("^([A-Za-z]+)://", url)), said("fragment", one("#(.*)$", url)), said("domain", domain))
    return F.when(url.isNotNull(), F.array_sort(F.array_distinct(every))).otherwise(F.array().cast("array<string>"))


def _hits(sets: DataFrame, rules: DataFrame, token_counts: DataFrame) -> DataFrame:
    """The columns of sets (with tokens) joined to those of rules (with rule, alike), for each rule that fits a set.

    A rule fits where the set has, of every group in alike, a token. Inverted index: a rule is posted under the tokens
    of the one group that fewest URLs have, and the rest are verified. A set that has two of those meets the rule twice.
    """
    posted = rules.select("rule", F.posexplode("rule").alias("at", "token")).join(token_counts.select("token", "n"), "token")
    index = posted.groupBy("rule").agg(F.min(F.struct("n", "at"))["at"].alias("at")).join(rules, "rule").withColumn("token", F.explode(F.col("alike")[F.col("at")])).drop("at")
    met = sets.withColumn("token", F.explode("tokens")).join(index, "token").drop("token")
    return met.where(F.forall("alike", lambda g: F.arrays_overlap(g, F.col("tokens")))).drop("alike")


def grow_sets(bases: DataFrame, items: DataFrame, least: float, confidence: float) -> DataFrame:
    """bases (rest: item numbers, ascending; n, both) and items (item from 1, n ascending) to key, n, both: all sets that are rules.

    Pattern growth as in FP-growth, a size of sets at a time: the conditional base of a set (suffix) is the distinct
    rests of the URLs that have it, with their counts n and blocked counts both; from it come the counts of all sets with
    one item more, rarest items first, and their bases. A set grows only if it can be part of a smallest rule: it is in
    enough URLs and blocked URLs, no part of it is a rule, and each of its items leaves URLs out (an item that the
    others imply adds nothing). Nor does it grow where no choice among its rests makes a rule (best), the rest that has all
    items still to come included, as every larger set has it. None of this loses a smallest rule; larger ones may be
    among the sets.
    """
    add = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("both").alias("both"))
    step = lambda df: df.select(F.concat("suffix", F.array("item")).alias("suffix"), F.expr("slice(rest, at + 2, size(rest))").alias("rest"), "width", "n", "both").where(F.size("rest") > 0)
    known = items.select(F.array("item").alias("key"), "n", F.lit(False).alias("dead"))
    bases = bases.select(F.array().cast("array<int>").alias("suffix"), "rest", F.posexplode("rest").alias("at", "item"), "n", "both")
    bases = step(bases.withColumn("width", F.lit(items.count()) - F.col("item")))
    found = []
    while True:
        bases = stored(add(bases, "suffix", "rest", "width"), "bases")
        over = F.col("both") - confidence * F.col("n")  # its sum over the rests that have all of a set is not negative for a rule
        best = F.when((over > 0) | (F.size("rest") == F.col("width")), over).otherwise(0.0)
        sets = bases.select("suffix", F.explode("rest").alias("item"), "n", "both", best.alias("best")).groupBy("suffix", "item").agg(*[F.sum(c).alias(c) for c in ("n", "both", "best")])
        sets = sets.where((F.col("n") >= least) & (F.col("both") >= confidence * least)).withColumn("key", F.array_sort(F.concat("suffix", F.array("item"))))
        parts = sets.withColumn("less", F.explode("key")).withColumn("part", F.array_remove("key", F.col("less")))
        parts = parts.join(known.select(F.col("key").alias("part"), F.col("n").alias("part_n"), F.col("dead").alias("part_dead")), "part", "left")  # none: not grown, so no rule
        sets = parts.groupBy(*sets.columns).agg(F.coalesce(F.max("part_dead"), F.lit(False)).alias("hit"), F.coalesce(F.min("part_n") == F.col("n"), F.lit(False)).alias("implied"))
        rule = F.col("both") >= confidence * F.col("n")
        sets = sets.withColumn("dead", F.col("hit") | F.col("implied") | rule).withColumn("grows", ~F.col("dead") & (F.col("best") + 1e-6 * F.col("n") >= 0))
        sets = stored(sets, "sets")
        found.append(sets.where(~F.col("hit") & rule).select("key", "n", "both"))
        if sets.where("grows").isEmpty():
            return reduce(DataFrame.unionByName, found)
        known = sets.select("key", "n", "dead")
        after = sets.where("NOT dead").groupBy("suffix").agg(F.array_sort(F.collect_list(F.struct("n", "item", "grows"))).alias("after"))
        after = after.select("suffix", F.col("after.item").alias("order"), F.filter("after", lambda x: x["grows"])["item"].alias("starts"))
        bases = bases.join(after, "suffix").withColumn("rest", F.array_intersect("order", "rest"))
        bases = bases.select("suffix", "rest", "order", "starts", F.posexplode("rest").alias("at", "item"), "n", "both").where(F.array_contains("starts", F.col("item")))
        bases = step(bases.withColumn("width", (F.size("order") - F.array_position("order", F.col("item"))).cast("int")))


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """labelled (tokens, block 0/1) to (rules, token counts): smallest sets whose URLs are mostly labelled block.

    rules has rule (its tokens), alike (for each of them the tokens that stand in just the same URLs, itself included),
    frequency and confidence, token counts has token and n. A rule is in a share ``support`` of the labelled URLs at
    least, and so many as ``confidence`` says of those are labelled block; no part of it is a rule. Single tokens are
    counted. A larger set needs no token that is a rule by itself and none that is in too few URLs or blocked URLs;
    tokens that stand in just the same URLs grow as one, named by the smallest, and each of them fits a rule's place. So
    every smallest set is found, of any number of tokens and in URLs of any number of tokens; the work grows with the
    number of sets that ``grow_sets`` must grow, which no bound cuts.
    """
    baskets = stored(labelled.where(F.size("tokens") > 0).select("tokens", F.col("block").cast("long").alias("block"), F.monotonically_increasing_id().alias("id")), "baskets")
    n, blocked = baskets.agg(F.count("*"), F.coalesce(F.sum("block"), F.lit(0))).first()
    least = support * n
    each = baskets.select(F.explode("tokens").alias("token"), "block", F.xxhash64("id").cast("decimal(38,0)").alias("h"))
    counts = stored(each.groupBy("token").agg(F.count("*").alias("n"), F.sum("block").alias("both"), F.sum("h").alias("where")), "tokens")
    sure = (F.col("n") >= least) & (F.col("both") >= confidence * F.col("n"))
    ratio = (F.col("both") / F.col("n")).alias("confidence")
    one = counts.where(sure).select(F.array("token").alias("rule"), F.array(F.array("token")).alias("alike"), F.col("n").alias("frequency"), ratio)
    # at most (tokens of a URL) / support tokens are usable
    usable = counts.where(~sure & (F.col("n") >= least) & (F.col("both") >= confidence * least))
    usable = usable.groupBy("n", "both", "where").agg(F.array_sort(F.collect_list("token")).alias("alike")).withColumn("token", F.col("alike")[0])
    items = stored(usable.select(F.row_number().over(Window.orderBy("n", "token")).alias("item"), "token", "alike", "n"), "items")
    few = baskets.select("id", "block", F.explode("tokens").alias("token")).join(items.select("token", "item"), "token").groupBy("id", "block").agg(F.array_sort(F.collect_list("item")).alias("rest"))
    few = stored(few.where(F.size("rest") > 1).groupBy("rest").agg(F.count("*").alias("n"), F.sum("block").alias("both")), "usable")
    if not blocked or few.isEmpty():
        return one, counts.select("token", "n")
    sets = grow_sets(few, items, least, confidence).withColumn("item", F.explode("key")).join(items.select("item", "token", "alike"), "item")
    many = sets.groupBy("key", "n", "both").agg(F.array_sort(F.collect_list(F.struct("token", "alike"))).alias("x"))
    many = stored(many.select(F.col("x.token").alias("rule"), F.col("x.alike").alias("alike"), F.col("n").alias("frequency"), ratio), "combined")
    larger = _hits(many.select(F.col("rule").alias("tokens")), many.select("rule", "alike"), counts).where(F.size("tokens") > F.size("rule"))
    return one.unionByName(many.join(larger.select(F.col("tokens").alias("rule")).distinct(), "rule", "left_anti")), counts.select("token", "n")


def match_rules(urls: DataFrame, rules: DataFrame, token_counts: DataFrame) -> DataFrame:
    """urls (tokens, ...) with mined (the highest confidence of a rule that fits the URL, or null).

    Hot hosts and repeated URLs meet the index once, as their token sets are distinct first.
    """
    name = F.struct(F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), F.col("tokens")).alias("b"))
    sets = urls.select("tokens").distinct().withColumn("id", name)
    met = _hits(sets, rules, token_counts).groupBy("id").agg(F.max("confidence").alias("mined"))
    return urls.withColumn("id", name).join(met, "id", "left").drop("id")


def judge_urls(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule (of the listed rules, or null), verdict (allow or block) and mined (confidence, or null).

    labels holds ``doc_id`` (the page's id), ``quality`` and ``toxic``: a page of low quality or toxic is labelled
    block, one that is neither allow; ids labelled more than once block if any row says so; nulls do not count. The
    listed rule decides where one fits; else a page is blocked where a mined rule fits. Null URLs and such without
    ``://`` have empty host and path. Rows are judged one by one, repeated and null ids too (a null id has no label); other columns are not read. Empty
    tables give empty results; without labels nothing is mined.
    """
    own = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), url_tokens(F.col(url)).alias("tokens"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when((F.col("quality") == 1) | (F.col("toxic") == 0), 0)
    known = labels.select(F.col("doc_id").alias("page_id"), bad.alias("block")).where("block IS NOT NULL AND page_id IS NOT NULL").groupBy("page_id").agg(F.max("block").alias("block"))
    rules_, counts = mine_rules(own.join(known, "page_id").select("tokens", "block"), support, confidence)
    out = match_rules(own, stored(rules_, "rules"), counts).withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("listed.verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), "mined")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
