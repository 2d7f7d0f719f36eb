"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Targets. Each source has a weight and may give at most ``cap`` times its words. The mix takes
``share`` of all words; shares above a source's cap are dealt again by weight, which ends at
one level for all: a source gets the lesser of its cap and level x weight.

Curriculum. Source s is drawn at time t in [0, 1] with weight 1 + a (2t - 1), its slope a
between -1 and 1. The integral, t + a (t^2 - t), times the target is the cumulative demand for
words of s; its inverse gives the position at which a document that lies at a given cumulative
word count is trained on.

Cumulative counts need no ordering of the documents. A hash of the id deals each source into
``BUCKETS`` ranges whose words are summed before any shuffle; a document's count is its range's
plus its place within. One row for each source, holding the sums of its ranges, is all that
documents are joined with, so neither a large source nor a large table gives a large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm._common import cut

BUCKETS = 1024
_BITS = 52
#: Sources up to which their rows (about 9 KB each) are broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 4096

WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words between ASCII white space; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def place_of(doc_id: Column) -> Column:
    """A number below 2^52 that the id alone decides; null ids count as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, _BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], slopes: Sequence[float], share: float, cap: float) -> DataFrame:
    """A row for each source: source, source_size, target, slope and before, the words before each range."""
    bucket = F.shiftright("place", _BITS - BUCKETS.bit_length() + 1)
    ranges = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    sources = ranges.groupBy("source").agg(F.sum("words").alias("source_size"), F.map_from_entries(F.collect_list(F.struct("bucket", "words"))).alias("words"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.col("words")[b.cast("long")], F.lit(0)).cast("long"))
    ahead = F.aggregate("filled", F.array(F.lit(0).cast("long")), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
    before = sources.withColumn("filled", filled).select("source", ahead.alias("before"))
    # the windows over all sources see three numbers of each, not its ranges
    slim = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = lambda xs: F.element_at(F.array(*(F.lit(float(x)) for x in xs)), (rank % len(xs) + 1).cast("int"))
    slim = slim.select("source", "source_size", cycle(weights).alias("weight"), cycle(slopes).alias("slope"), (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    # water level: sources in the order in which they reach their caps
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    spent = F.coalesce(F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    waiting = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    leveled = slim.withColumn("level", (F.lit(float(share)) * everything - spent) / waiting)
    level = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "level"))).over(Window.partitionBy())
    target = F.least("most", F.coalesce(level["level"] * F.col("weight"), F.col("most")))
    leveled = leveled.select(F.col("source").alias("of"), "source_size", target.alias("target"), "slope")
    return before.join(leveled, F.col("source").eqNullSafe(F.col("of"))).select("source", "source_size", "target", "slope", "before")


def _placed(docs, weights, slopes, share, cap, whole_documents, text, doc_id, source, keep) -> DataFrame:
    """size, source_size, target, slope, taken, copies, and met, the source's words before the row."""
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        size_of(F.col(text)).alias("size"),
        place_of(F.col(doc_id)).alias("place"),
        *([F.struct(*keep).alias("kept")] if keep else []),
    )
    if not keep:  # else the rows hold texts, and reading the documents again is cheaper than a copy
        slim = cut(slim, "mix-sizes")
    targets = source_targets(slim.select("source", "size", "place"), weights, slopes, share, cap)
    targets = cut(targets, "mix-targets").withColumnRenamed("source", "of")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rows = slim.join(targets, F.col("source").eqNullSafe(F.col("of")), "left")

    shift = _BITS - BUCKETS.bit_length() + 1
    bucket = F.shiftright("place", shift).cast("int")
    within = F.pmod("place", F.lit(1 << shift)).cast("double") / float(1 << shift)
    rows = rows.withColumns({"ahead": F.element_at("before", bucket + 1), "upto": F.element_at("before", bucket + 2), "within": within}).drop("before")
    rows = rows.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    words = F.col("upto") - F.col("ahead")
    rest = F.col("target") - F.col("times") * F.col("source_size")
    rows = rows.withColumn("part", F.when(words > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rest - F.col("ahead")) / words))).otherwise(0.0))
    more = F.when(F.col("within") < F.col("part"), F.col("size")).otherwise(0) if whole_documents else F.floor(F.col("part") * F.col("size") + 0.5)
    rows = rows.withColumn("more", more.cast("long"))
    return rows.withColumns(
        {
            "taken": F.col("times") * F.col("size") + F.col("more"),
            "copies": F.when(F.col("size") > 0, F.col("times") + (F.col("more") > 0).cast("long")).otherwise(F.lit(0).cast("long")),
            "met": F.col("ahead") + F.col("within") * words,
        }
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    slopes: Sequence[float] = (0.5, 0.0, -0.5),
    share: float = 1.5,
    cap: float = 2.0,
    whole_documents: bool = False,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """A row for each row of ``docs``, in order of position, documents that are not taken last.

    doc_id, size, source_size, target, taken, copies and position. Sources in code-point order
    take ``weights`` and ``slopes`` in turn, null last. taken is the words the mix takes,
    repeats counted, at most ``cap`` (a whole number) times the size. copies is how often the
    document appears; where a source's last range is taken in part, each of its documents gives
    the same part of its words, or with ``whole_documents`` some give all. position is that of
    the first copy.

    Null texts have size 0. Repeated rows and null ids count like any other; other columns are
    ignored. An empty table gives an empty result; sources without a word have target 0.
    """
    rows = _placed(docs, weights, slopes, share, cap, whole_documents, text, doc_id, source, ())
    position = F.when(F.col("taken") > 0, position_at(F.least(F.col("met") / F.col("target"), F.lit(1.0)), F.col("slope")))
    out = rows.select("doc_id", "size", "source_size", "target", "taken", "copies", position.alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    slopes: Sequence[float] = (0.5, 0.0, -0.5),
    share: float = 1.5,
    cap: float = 2.0,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """The columns of ``docs``, a row for each copy that the mix takes, in order of position.

    As ``mix`` with whole documents. Documents without a word are not taken.
    """
    rows = _placed(docs, weights, slopes, share, cap, True, text, doc_id, source, docs.columns)
    at = F.least((F.col("copy") * F.col("source_size") + F.col("met")) / F.col("target"), F.lit(1.0))
    rows = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.select("kept", position_at(at, F.col("slope")).alias("position")).orderBy("position").select("kept.*")


def position_at(demand: Column, slope: Column) -> Column:
    """The time t at which t + slope (t^2 - t) reaches ``demand``, both from 0 to 1."""
    root = F.sqrt((1.0 - slope) * (1.0 - slope) + 4.0 * slope * demand)
    return F.when(slope == 0.0, demand).otherwise((root - (1.0 - slope)) / (2.0 * slope))


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS place
  FROM documents),
ranges AS (SELECT source, place >> 42 AS bucket, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY ALL),
before AS (SELECT *, CAST(sum(words) OVER (PARTITION BY source ORDER BY bucket) AS BIGINT) AS upto FROM ranges),
sources AS (
  SELECT source, CAST(sum(words) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
         [0.5::DOUBLE, 0.0, -0.5][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS slope
  FROM ranges GROUP BY source),
caps AS (SELECT *, 2.0::DOUBLE * source_size AS most FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
             - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps),
targets AS (
  SELECT *, least(most, coalesce((SELECT arg_min(level, most / weight) FROM levels WHERE level <= most / weight) * weight, most)) AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, slope, upto - words AS ahead, words,
         CAST(place % {1 << 42} AS DOUBLE) / {1 << 42}::DOUBLE AS within,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
       JOIN before b ON s.source IS NOT DISTINCT FROM b.source AND s.place >> 42 = b.bucket),
parts AS (
  SELECT *, CASE WHEN words > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (target - times * source_size - ahead) / words)) ELSE 0 END AS part FROM placed),
counted AS (
  SELECT *, CAST(floor(part * size + 0.5) AS BIGINT) AS more, least((ahead + within * words) / nullif(target, 0), 1.0::DOUBLE) AS met FROM parts)
SELECT doc_id, size, source_size, target, times * size + more AS taken,
       CASE WHEN size > 0 THEN times + CASE WHEN more > 0 THEN 1 ELSE 0 END ELSE 0 END AS copies,
       CASE WHEN times * size + more > 0 THEN CASE WHEN slope = 0 THEN met ELSE (sqrt((1.0 - slope) * (1.0 - slope) + 4.0 * slope * met) - (1.0 - slope)) / (2.0 * slope) END END AS position
FROM counted
"""
