"""URL filters: rules first, then host word segmentation and multinomial naive Bayes.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest rule
wins. Urls that no rule fits are judged by naive Bayes over tokens, learnt from all urls that a rule decides:

* The names in a host are cut at characters other than letters and digits, and each concatenated name is split into words by a unigram
  Viterbi search. Word counts come from the text of all pages. Each distinct name meets only the words that
  may stand in it, by a join on hashes, so no vocabulary is broadcast and none is capped; a piece that is no word costs as in a
  corpus where each further letter makes it ten times rarer.
* The host's words and the path's tokens (numbers by their count of digits) are scored by multinomial naive Bayes with add-one counts.

Defined results: a null url or one without :// has an empty host and path and no tokens, and gets the likelier class (allow on
a tie or with nothing to learn from). Repeated rows are judged each; an empty table gives an empty one. Names and words may have
any length: a name of n letters makes PIECE * n hashes at most and is searched in n steps for each length of the words that stand in it.
The url column, and the page column for counts, are all that is read.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST = 200_000
PIECE = 32  # letters by which a name and a word meet


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does. rules: (host, path, verdict)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """Rows (word, n): lower-case words of the pages' text, tags left out."""
    text = F.regexp_replace(F.coalesce(F.col(html_col).cast("string"), F.lit("")), r"(?s)<[^>]*>", " ")
    return pages.select(F.explode(F.split(F.lower(text), r"[^a-z0-9]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def best_split(name: str, logs: dict[str, float], total: float) -> list[str]:
    """The likeliest words of name under a unigram model; logs has the words that may stand in it."""
    best, cut = [0.0], [0]
    lengths = sorted({len(w) for w in logs})
    letter, lead = math.log(10), (-math.inf, 0)
    for e in range(1, len(name) + 1):
        lead = max(lead, (best[e - 1] + (e - 1) * letter, e - 1))  # where the best piece that is no word starts, whatever its end
        score, at = lead[0] - math.log(max(total, 1.0)) - e * letter, lead[1]
        for n in lengths:
            if n > e:
                break
            if (log := logs.get(name[e - n : e])) is not None:
                score, at = max((score, at), (best[e - n] + log, e - n))
        best.append(score)
        cut.append(at)
    out, e = [], len(name)
    while e:
        out.append(name[cut[e] : e])
        e = cut[e]
    return out[::-1]


def _split(total: float):
    def run(batches):
        for b in batches:
            out = [best_split(r["name"], {x["word"]: math.log(x["n"] / total) for x in r["met"] or []}, total) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    return run


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """names: name. Rows (name, words) for the distinct names.

    A name meets the words that may stand in it by hashes: of its pieces at every place, in the lengths that words have up to ``PIECE``; a
    longer word is met by its first PIECE letters. Only numbers and hashes are shuffled, no substrings, and the search compares the letters."""
    head = F.least(F.length("word"), F.lit(PIECE))
    words = stored(counts.select("word", "n", head.alias("size"), F.xxhash64(F.substr("word", F.lit(1), head)).alias("h")))
    total = float(words.agg(F.sum("n")).first()[0] or 1)
    sizes = sorted(r["size"] for r in words.select("size").distinct().collect())  # at most PIECE
    cut = stored(names.select("name").distinct().select(F.monotonically_increasing_id().alias("number"), "name"))  # written once, so numbers stay
    pieces = cut.select("number", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda k: F.substr("name", k, F.lit(PIECE)))).alias("piece"))
    parts = F.filter(F.array(*[F.struct(F.lit(k).alias("size"), F.xxhash64(F.substr("piece", F.lit(1), F.lit(k))).alias("h")) for k in sizes]), lambda x: x["size"] <= F.length("piece"))
    spans = pieces.select("number", F.explode(parts).alias("part")).select("number", "part.*").distinct() if sizes else cut.select("number", F.lit(0).alias("size"), F.lit(0).cast("long").alias("h")).limit(0)
    met = spans.join(words, ["size", "h"]).groupBy("number").agg(F.collect_list(F.struct("word", "n")).alias("met"))  # words that stand in one name
    return cut.join(met, "number", "left").select("name", "met").mapInArrow(_split(total), "name string, words array<string>")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Rows (id_col, host, path, rule, verdict), one for each row of pages."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("hit", ruled(F.col("host"), F.col("path"), rules))
    urls = stored(rows.select("host", "path", F.col("hit.verdict").alias("known")).groupBy("host", "path").agg(F.first("known").alias("known"), F.count("*").alias("n")))
    named = urls.select("host").distinct().select("host", F.explode(F.split("host", r"[^\p{L}\p{N}]+")).alias("name")).where("name <> ''")
    split = segmented(named.select("name"), stored(word_counts(pages, html_col)))
    host_words = stored(named.join(split, "name").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words")))  # a host has few names
    tokens = F.transform(F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda t: t != ""), lambda t: F.when(t.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(t).cast("string"))).otherwise(F.concat(F.lit("/"), t)))
    bag = stored(urls.join(host_words, "host", "left").select("host", "path", "known", "n", F.concat(F.coalesce("words", F.array().cast("array<string>")), tokens).alias("tokens")))

    told = bag.where("known IS NOT NULL").select((F.col("known") == "block").alias("block"), "n", F.explode("tokens").alias("token"))
    seen = stored(told.groupBy("token").agg(*[F.sum(F.when(F.col("block") == b, F.col("n")).otherwise(0)).alias(c) for b, c in ((True, "nb"), (False, "na"))]))
    sums = seen.agg(F.sum("nb").alias("nb"), F.sum("na").alias("na"), F.count("*").alias("v")).first()
    prior = {r["known"]: r["n"] for r in bag.where("known IS NOT NULL").groupBy("known").agg(F.sum("n").alias("n")).collect()}
    lean = math.log((prior.get("block", 0) + 1) / (prior.get("allow", 0) + 1)) if prior else 0.0
    nb, na, v = (sums["nb"] or 0), (sums["na"] or 0), sums["v"]
    weight = F.log((F.col("nb") + 1) / F.lit(float(nb + v + 1))) - F.log((F.col("na") + 1) / F.lit(float(na + v + 1)))
    weights = seen.select("token", weight.alias("w"))
    if v <= BROADCAST:
        weights = F.broadcast(weights)
    open_ = bag.where("known IS NULL").select("host", "path", F.explode_outer("tokens").alias("token"))
    scored = open_.join(weights, "token", "left").groupBy("host", "path").agg((F.sum(F.coalesce("w", F.lit(0.0))) + lean).alias("score"))
    verdict = F.when(F.col("hit").isNotNull(), F.col("hit.verdict")).when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(scored, ["host", "path"], "left").select(id_col, "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))
