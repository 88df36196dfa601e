"""Target-distribution importance resampling: documents that look like the target, by Gumbel top-k.

A document's features (runs of words) are hashed into buckets; a bucket's gain is the logarithm
of how much more often the target has it than the corpus.  The gains are one array of fixed
length, and a document's weight is the sum of its buckets' entries.  With a hashed Gumbel noise
the highest scores are a draw without replacement.  The draw needs no sort of the corpus: a
histogram of the integer scores, summed from the top, tells how many rows are ahead of each
score, and so the cut-off and each survivor's rank.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routelake.llm.common import documents, table
from routelake.session import discard, staged

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: What ends a word: ASCII but letters and digits, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Scores of a range, and ids of a block, are numbered together: at least so many, or the square root of their span.
SPAN = 4096


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none of a null."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, BETWEEN), lambda w: w != "")


def buckets(found: Column, grams: int = 1) -> Column:
    """The bucket of each run of 1 to ``grams`` consecutive words, repeats and all."""
    at = lambda w: (F.crc32(w.cast("binary")) % BUCKETS).cast("int")

    def runs(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: at(F.array_join(F.slice(found, i, n), " ")))

    return F.concat(F.transform(found, at), *[runs(n) for n in range(2, grams + 1)])


def _counts(features: DataFrame) -> dict[int, int]:
    """How often each bucket occurs: at most BUCKETS numbers."""
    return dict(features.select(F.explode("_buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect())


def gains(corpus: dict[int, int], target: dict[int, int]) -> list[int]:
    """floor(1000 * log odds) of each bucket, each count smoothed by one."""
    s_all, t_all = float(sum(corpus.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all))) for b in range(BUCKETS)]


def weight(found: Column, gained: list[int]) -> Column:
    """The sum of the buckets' gains; the array is one literal of BUCKETS numbers."""
    held = F.split(F.lit(",".join(map(str, gained))), ",").cast("array<bigint>")
    return F.aggregate(found, F.lit(0).cast("long"), lambda total, b: total + F.get(held, b))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, of a hash of the seed and the id (null: empty)."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, grams: int = 1, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, eligible (enough words) of every document, as a staged table.

    Texts are read once: their buckets are staged, counted, and scored from there.
    """
    own = words(F.col("text"))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("_words"))
    features = staged(held.select("doc_id", F.size("_words").alias("_n"), buckets(F.col("_words"), grams).alias("_buckets")), "resampling-features")
    goal = target.select(buckets(words(F.col("text")), grams).alias("_buckets"))
    gained = gains(_counts(features), _counts(goal))
    weighed = features.select("doc_id", F.size("_buckets").cast("long").alias("n_features"), weight(F.col("_buckets"), gained).alias("weight"), (F.col("_n") >= least_words).alias("eligible"))
    out = staged(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resampling-scores")
    discard(features)
    return out


def _span(rows: DataFrame, column: str) -> int:
    """How wide a range of the column's numbers is, so that neither a range nor the table of ranges grows over the root of their span."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    return max(SPAN, math.isqrt(0 if low is None else high - low))


def ranked(rows: DataFrame, wanted: int) -> DataFrame:
    """``rows`` (doc_id, score, eligible, n_features and more, staged) with ``rank``: 1 to ``wanted`` by falling score, then id; null beyond and for rows not eligible.

    Counts by score and block of ids are run up in two steps, by ranges of scores, then inside
    each; a score with very many rows is numbered block by block of ids.  Rows below the
    cut-off score take no part in any shuffle.
    """
    none = rows.withColumn("rank", F.lit(None).cast("long"))
    fit = rows.where("eligible")
    if wanted <= 0:
        return none
    ids, wide = _span(fit, "doc_id"), _span(fit, "score")
    block = F.floor(F.coalesce(F.col("doc_id"), F.lit(-(2**62))) / F.lit(ids)).cast("long")
    parts = staged(fit.groupBy("score", block.alias("_block")).agg(F.count("*").alias("_n")), "resampling-histogram")
    counts = parts.groupBy("score").agg(F.sum("_n").alias("_all")).withColumn("_range", F.floor(F.col("score") / F.lit(wide)).cast("long"))
    above = counts.groupBy("_range").agg(F.sum("_all").alias("_sum"))
    above = above.select("_range", (F.sum("_sum").over(Window.orderBy(F.desc("_range"))) - F.col("_sum")).alias("_higher"))
    inside = F.sum("_all").over(Window.partitionBy("_range").orderBy(F.desc("score"))) - F.col("_all")
    ahead = counts.withColumn("_inside", inside).join(above, "_range").select("score", (F.col("_higher") + F.col("_inside")).alias("_ahead"))
    surviving = staged(ahead.where(F.col("_ahead") < wanted), "resampling-offsets")
    cut = surviving.agg(F.min("score")).first()[0]
    before = F.sum("_n").over(Window.partitionBy("score").orderBy("_block")) - F.col("_n")
    offsets = parts.where(F.col("score") >= cut).withColumn("_before", before).join(surviving, "score").select("score", "_block", (F.col("_ahead") + F.col("_before")).alias("_offset"))
    top = F.col("eligible") & (F.col("score") >= cut)
    place = F.row_number().over(Window.partitionBy("score", "_block").orderBy("doc_id", "n_features"))
    survivors = rows.where(top).withColumn("_block", block).join(offsets, ["score", "_block"]).withColumn("rank", F.col("_offset") + place)
    drawn = survivors.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*rows.columns, "rank")
    return drawn.unionByName(none.where(~top))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **how) -> DataFrame:
    """doc_id, n_features, weight, score, eligible, rank of every document.

    Null texts have no words and so weight 0; null ids hash as empty ones and come first among
    equal scores; rows that repeat an id and a text are drawn each on their own, with ranks in
    any order among themselves.  Empty documents give an empty table, an empty target counts
    0 in each bucket.  Further columns of either table are not read.
    """
    rows = scored(docs, target, **how)
    return ranked(rows, percent * rows.where("eligible").count() // 100)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its rank in a draw of a tenth towards the benchmark's texts."""
    found = resampled(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def _sql_words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


#: CRC-32 from its polynomial, over each different word once.
ORACLE = f"""WITH crcs AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
    told AS (SELECT doc_id, {_sql_words('text')} AS ws FROM documents), goal AS (SELECT {_sql_words('text')} AS ws FROM benchmark),
    used AS (SELECT doc_id, unnest(ws) AS w FROM told), wanted AS (SELECT unnest(ws) AS w FROM goal), known AS (SELECT w FROM used UNION SELECT w FROM wanted),
    dealt AS MATERIALIZED (SELECT w, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(hex(w)) // 2 + 1), lambda k: ('0x' || substr(hex(w), 2 * k - 1, 2))::BIGINT),
      lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) % {BUCKETS} AS b FROM known, crcs),
    s AS (SELECT b, count(*) AS n FROM used JOIN dealt USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM wanted JOIN dealt USING (w) GROUP BY b),
    gains AS (SELECT dealt.b, CAST(floor(1000 * ln((coalesce(any_value(t.n), 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE / ((coalesce(any_value(s.n), 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
      FROM (SELECT DISTINCT b FROM dealt) dealt LEFT JOIN s ON s.b = dealt.b LEFT JOIN t ON t.b = dealt.b GROUP BY dealt.b),
    weighed AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM used JOIN dealt USING (w) JOIN gains USING (b) GROUP BY doc_id),
    scored AS (SELECT told.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || told.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM told LEFT JOIN weighed USING (doc_id)),
    placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= {LEAST_WORDS})
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT {PERCENT} * count(*) // 100 FROM placed) THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""
