"""The opN_ queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.llm import byte_bpe, decontaminate, embedding_dedup, hard_negatives, lang_id, lattice_lm, ngram_jaccard, periodic_runs, secret_scan, sentencepiece_codec, suffix_dedup, toxicity, url_filter
from cellweave.llm.common import documents, remainder


def op3_sentencepiece(spark, sf_dir):
    out = sentencepiece_codec.encode(documents(spark, sf_dir))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op6_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard.link(documents(spark, sf_dir), n_words=4, percent=85)


def op7_lang_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = lang_id.fit(docs, remainder("doc_id", 3) != 1)
    out = lang_id.predict(docs, model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op8_decontaminate(spark, sf_dir):
    out = decontaminate.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated", "n_close")


def op9_secret_scan(spark, sf_dir):
    out = secret_scan.scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op10_embedding_dedup(spark, sf_dir):
    return embedding_dedup.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_lattice_lm(spark, sf_dir):
    out = lattice_lm.score(documents(spark, sf_dir), remainder("doc_id", 10) != 0)
    return out.withColumn("held_out", remainder("doc_id", 10) == 0)


#: The contract's rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op4_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir), least=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_url_filter(spark, sf_dir):
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op1_toxicity(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, remainder("doc_id", 5) != 0)
    out = toxicity.predict(docs, model)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op11_byte_bpe(spark, sf_dir):
    from public_tokenizers import path

    ranks = path("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.encode(documents(spark, sf_dir), ranks)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    row = F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"))
    back = byte_bpe.decode(out.select(row.alias("row"), "ids"), ranks, id_col="row")
    return back.select("row.*", F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(moved, F.col("id") % 100 == 0)


def repeated(docs):
    """The contract's texts: where crc32 of the id is divisible by 10, words from number a on repeat the p words from there."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")).alias("w"))
    n = F.size("w").cast("long")
    rows = rows.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    moved = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir):
    out = periodic_runs.detect(repeated(documents(spark, sf_dir)))
    zero = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda b, r: b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"])  # noqa: E731  runs come by start, then period
    top = F.aggregate("runs", zero, lambda b, r: F.when(better(b, r), r).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "top.start", "top.length", "top.period", F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op11_byte_bpe": op11_byte_bpe, "op12_hard_negatives": op12_hard_negatives, "op13_periodic_runs": op13_periodic_runs, "op4_suffix_dedup": op4_suffix_dedup, "op1_toxicity": op1_toxicity, "op2_lattice_lm": op2_lattice_lm, "op5_url_filter": op5_url_filter, "op10_embedding_dedup": op10_embedding_dedup, "op3_sentencepiece": op3_sentencepiece, "op6_ngram_jaccard": op6_ngram_jaccard, "op7_lang_id": op7_lang_id, "op8_decontaminate": op8_decontaminate, "op9_secret_scan": op9_secret_scan}
