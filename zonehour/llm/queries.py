"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonehour.llm.common import WORD, fold, staged, word_count


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonehour.llm.lm_scoring import score_held_out

    held = fold("doc_id", 7) == 2
    x = score_held_out(_docs(spark, sf_dir), ~held)
    return x.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonehour.llm.language_id import identify, learn

    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    model = learn(docs, fold("doc_id", 3) != 1)
    held = fold("doc_id", 3) == 1
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from zonehour.llm.token_counts import count_tokens

    return count_tokens(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonehour.llm.pii import pseudonymise

    return pseudonymise(_docs(spark, sf_dir).select("doc_id", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonehour.llm.simhash import simhash_components

    return simhash_components(_docs(spark, sf_dir))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonehour.llm.media import media_column

    return media_column(_docs(spark, sf_dir))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonehour.llm.substring import remove_repeats

    x = remove_repeats(_docs(spark, sf_dir))
    return x.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonehour.llm.decontaminate import find_overlaps

    return find_overlaps(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonehour.llm.quality import learn, score_quality

    docs = _docs(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels, fold("doc_id", 5) != 0)
    return score_quality(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonehour.llm.mixing import mix_sources

    docs = staged(_docs(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("n")), "mix-docs")
    return mix_sources(docs, F.col("n")).select("doc_id", "size", "source_size", "target", "taken")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonehour.llm.toxicity import learn, score_toxicity

    docs = _docs(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels, fold("doc_id", 4) != 2)
    return score_toxicity(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def with_cycles(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by crc32 of doc_id, the words from one on repeat a cycle."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    x = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"), word_count(F.col("text")).alias("n"))
    x = x.withColumn("a", F.col("g") % F.greatest("n", F.lit(1))).withColumn("rest", F.col("n") - F.col("a"))
    x = x.withColumn("p", 1 + F.expr("rest div (3 + g % 8)"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    i = lambda c: F.col(c).cast("int")
    times = F.expr("cast((rest + p - 1) div p as int)")
    cycled = F.slice(F.flatten(F.array_repeat(F.slice(words, i("a") + 1, i("p")), times)), F.lit(1), i("rest"))
    return x.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(F.concat(F.slice(words, F.lit(1), i("a")), cycled), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonehour.llm.runs import periodic_runs

    x = periodic_runs(with_cycles(_docs(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    x = x.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs", "kept")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    x = x.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"), digest(listed).alias("runs_sha256"), digest(F.col("kept")).alias("collapsed_sha256"))
    return x.withColumn("exponent_milli", F.expr("1000 * length div period"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonehour.llm.turns import damaged, repair_conversations, turn_digests

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair_conversations(damaged(rows))
    x = rows.select("conv_id").distinct()
    for part in (found.conversations, turn_digests(found.turns)):
        part = part.withColumnRenamed("conv_id", "c")
        x = x.join(part, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return x.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_surrogates": op4_surrogates,
    "op5_simhash": op5_simhash,
    "op6_media": op6_media,
    "op7_substring": op7_substring,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_fair_mix": op10_fair_mix,
    "op11_toxicity": op11_toxicity,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_turn_repair": op13_turn_repair,
}

ORACLE_SQL: dict[str, str] = {
    # A window goes if the same words start in a document of a smaller id; its words go with it.
    "op7_substring": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE doc_id > least), range(50) r(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    # Sources in the order of cap / weight are full while their cap is within what is left for their weight.
    "op10_fair_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat_ws(':', 'mix', CAST(doc_id AS STRING))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST(k % 3 + 1 AS DOUBLE) AS w, source_size * 3 AS cap FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN cap / w <= level THEN CAST(cap AS DOUBLE) ELSE w * (SELECT min_by(level, cap / w) FROM l WHERE cap / w > level) END AS target FROM l),
c AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT doc_id, size, source, CAST(source_size * k + cum AS DOUBLE) / target AS finish FROM c, range(3) r(k) WHERE size > 0),
m AS (SELECT doc_id, sum(size) AS taken FROM (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM p) WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM c LEFT JOIN m USING (doc_id)""",
}
