"""Benchmark decontamination over a distributed positional inverted index, with DataFrame functions only.

A word is a run of ASCII letters or digits or of characters beyond ASCII, A-Z lower-cased. Every item gives windows of
``size`` consecutive words (an item with fewer words, but not none, is one window). The corpus's count of each benchmark
term picks each window's three rarest terms that the corpus has; the index stores the postings (term, document, position) of those terms.
A window's posting lists are shifted by the terms' offsets and intersected within a document. Where all agree the window may
stand, and these places alone are verified against the text's words, which gives exact phrases.

A proximity match is a window of at least three distinct terms that stands with one word put in, left out or changed. One such edit spoils
one list at most and moves later words by one, so two lists still agree to within a word: where two do, the words before and after the
edit are verified. No match is lost: if the window has a term that the corpus lacks, that is the edited one, and all its lists are sound.

A hot passage costs one posting for each copy and no pair of documents is ever formed. The benchmark's vocabulary is
broadcast only if it is counted to be at most ``BROADCAST`` terms; beyond that the same joins shuffle postings, never texts.
What is gathered for a document is bounded by its own words.

Defined results: null and empty texts have no words; documents without a hit appear with zeros and no items; repeated rows
get equal results each, null ids included; items with a null id or no words have no windows; with no window nothing is contaminated;
empty tables give empty ones. Texts are processed whole, whatever their length. Only the named columns are read, so others may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellweave.llm.common import stored

SIZE = 13
LISTS = 3  # of which one edit leaves two
SHARE = 20  # contaminated if SHARE * hit words >= words
BROADCAST = 300_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(low, GAP), lambda w: w != "")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key tells rows apart even where ids repeat; rows that share it are equal."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("key"), text.alias("text"))


def windows(items: DataFrame, size: int = SIZE, id_col="item_id", text_col="text") -> DataFrame:
    """Rows (window, terms, item_ids), one for each distinct window, numbered; item_ids are strings in string order."""
    w = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.greatest(F.size("w") - F.lit(size - 1), F.lit(1))
    rows = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.slice("w", i, F.lit(size)))).alias("terms"))
    rows = rows.groupBy("terms").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    return stored(rows.select(F.monotonically_increasing_id().alias("window"), "terms", "item_ids"))  # written once, so numbers stay


def sized(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST else small


def anchored(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """Rows (window, rank, term, off, lists, lacks, distinct): each window's LISTS rarest corpus terms, how many it has of them, whether the
    corpus lacks another of its terms, and how many distinct terms it has."""
    at = wins.select("window", F.posexplode("terms").alias("off", "term"))
    vocabulary = stored(at.select("term").distinct())
    seen = docs.select(F.explode_outer(words(F.col("text"))).alias("term")).join(sized(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))
    one = at.join(stored(seen), "term", "left").groupBy("window", "term").agg(F.min("off").alias("off"), F.max("n").alias("n"))
    of = W.partitionBy("window")
    ranked = one.select("*", F.row_number().over(of.orderBy(F.col("n").asc_nulls_last(), "term")).alias("rank"), F.max(F.col("n").isNull()).over(of).alias("lacks"), F.least(F.count("n").over(of), F.lit(LISTS)).alias("lists"), F.count("*").over(of).alias("distinct"))
    return ranked.where(F.col("n").isNotNull() & (F.col("rank") <= LISTS)).select("window", "rank", "term", "off", "lists", "lacks", "distinct")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: rows (term, key, pos)."""
    at = docs.select("key", F.posexplode_outer(words(F.col("text"))).alias("pos", "term"))
    return at.join(sized(terms), "term").select("term", "key", "pos")


def matched(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows (key, window, starts, near): the places where all of a window's shifted lists agree, and those where it may stand with an edit
    since two lists agree to within a word."""
    lists = index.join(sized(stored(chosen)), "term").select("key", "window", "lists", "lacks", "distinct", "rank", (F.col("pos") - F.col("off")).alias("start"))
    of = lambda k: F.collect_set(F.when(F.col("rank") == k, F.col("start"))).alias(f"s{k}")  # noqa: E731  a document's postings at most
    met = lists.groupBy("key", "window").agg(F.first("lists").alias("lists"), F.first("lacks").alias("lacks"), F.first("distinct").alias("distinct"), *[of(k) for k in range(1, LISTS + 1)])
    met = met.where((F.col("lists") == 1) | ((F.size("s1") > 0).cast("int") + (F.size("s2") > 0).cast("int") + (F.size("s3") > 0).cast("int") > 1))
    none, around = F.array().cast("array<int>"), lambda c: F.flatten(F.transform(c, lambda s: F.array(s - 1, s, s + 1)))
    starts = F.when(F.col("lacks"), none).when(F.col("lists") == 1, F.col("s1")).when(F.col("lists") == 2, F.array_intersect("s1", "s2")).otherwise(F.array_intersect(F.array_intersect("s1", "s2"), "s3"))
    pairs = F.flatten(F.array(*[F.array_intersect(f"s{i}", around(f"s{j}")) for i, j in ((1, 2), (1, 3), (2, 3))]))
    near = F.when(F.col("distinct") >= LISTS, F.array_distinct(around(pairs))).otherwise(none)
    return met.select("key", "window", starts.alias("starts"), near.alias("near")).where((F.size("starts") > 0) | (F.size("near") > 0))


def one_edit(w: Column, terms: Column, start: Column) -> Column:
    """Whether the terms stand in the words w from start with at most one word put in, left out or changed: what agrees from the start on and
    what agrees back from an end that is one word later, the same or one earlier make up the window, but for the edited word."""
    n = F.size(terms)
    same = lambda t, place: F.transform(t, lambda x, i: F.coalesce(F.get(w, place(i)) == x, F.lit(False)))
    agree = lambda equal: F.when(F.array_position(equal, False) == 0, n).otherwise(F.array_position(equal, False).cast("int") - 1)
    ahead = agree(same(terms, lambda i: start + i))
    back = lambda more: agree(same(F.reverse(terms), lambda i: start + n - 1 + more - i))
    return (ahead + back(0) >= n - 1) | (ahead + back(1) >= n) | (ahead + back(-1) >= n - 1)


def covered(spans: Column) -> Column:
    """How many positions the spans (start, end), in order of start, cover."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        more = F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["end"], s["end"]).alias("end"))

    return F.aggregate(spans, zero, step)["n"]


def judge(docs: DataFrame, items: DataFrame, size: int = SIZE, share: int = SHARE, id_col="doc_id", text_col="text", item_id="item_id", item_text="text") -> DataFrame:
    """One row for each row of docs: id_col, text_col, n_words, n_hit, item_ids (strings in order), n_close (windows of at least LISTS distinct
    terms that stand with one edit or none), contaminated."""
    rows = keyed(docs, id_col, text_col)
    wins = windows(items, size, item_id, item_text)
    chosen = stored(anchored(rows, wins))
    index = stored(postings(rows, stored(chosen.select("term").distinct())))
    met = stored(matched(index, chosen)).join(wins, "window")
    by_doc = stored(met.groupBy(F.col("key").alias("met_key")).agg(F.collect_list(F.struct("starts", "near", "terms", "item_ids")).alias("places")))

    out = rows.join(by_doc, F.col("key").eqNullSafe(F.col("met_key")), "left").select("key", "text", "places", words(F.col("text")).alias("w"))
    stands = lambda p: F.filter(p["starts"], lambda s: (s >= 0) & (F.slice("w", F.greatest(s, F.lit(0)) + 1, F.size(p["terms"])) == p["terms"]))
    close = lambda p: F.exists(p["near"], lambda s: one_edit(F.col("w"), p["terms"], s)).cast("long")
    found = F.transform("places", lambda p: F.struct(stands(p).alias("starts"), F.size(p["terms"]).alias("n"), p["item_ids"].alias("item_ids")))
    n_close = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + close(p))
    out = out.select("key", "text", n_close.alias("n_close"), F.size("w").cast("long").alias("n_words"), F.filter(found, lambda p: F.size(p["starts"]) > 0).alias("found"))
    spans = F.sort_array(F.flatten(F.transform("found", lambda p: F.transform(p["starts"], lambda s: F.struct(s.alias("start"), (s + p["n"]).alias("end"))))))
    ids = F.sort_array(F.array_distinct(F.flatten(F.transform("found", lambda p: p["item_ids"]))))
    out = out.select(F.col("key.id").alias(id_col), F.col("text").alias(text_col), "n_words", F.coalesce(covered(spans), F.lit(0)).cast("long").alias("n_hit"), F.coalesce(ids, F.array().cast("array<string>")).alias("item_ids"), F.coalesce("n_close", F.lit(0)).cast("long").alias("n_close"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
