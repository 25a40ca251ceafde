"""Semantic domains from values: natural language, time formats, images; and statistics of token sequences."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .slicing import SLICE

LEAST_VALUES, LEAST_RATIO = 100, 0.8

# The date and time formats that are recognised, in strptime's letters.
DATES = ["%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%y-%m-%d", "%y/%m/%d", "%m-%d-%Y", "%m/%d/%Y", "%m%d%Y", "%m-%d-%y", "%m/%d/%y", "%d-%m-%Y", "%d/%m/%Y", "%d%m%Y", "%d-%B-%Y", "%d-%m-%y", "%d/%m/%y", "%d-%B-%y"]
TIMES = ["%H:%M", "%H:%M:%S", "%H:%M:%S.%f"]
COMBINED = ["%a %b %d %H:%M:%S %Y"]
GAPS = ["T", " "]
# What each letter matches.
LETTERS = {
    "%a": "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)",
    "%b": "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)",
    "%B": "(?:January|February|March|April|May|June|July|August|September|October|November|December)",
    "%f": "(?:[0-9]{1,6})",
    "%d": r"(?:3[0-1]|[1-2]\d|0[1-9]|[1-9]| [1-9])",
    "%H": r"(?:2[0-3]|[0-1]\d|\d)",
    "%y": r"(?:\d\d)",
    "%Y": r"(?:\d\d\d\d)",
    "%m": "(?:1[0-2]|0[1-9]|[1-9])",
    "%M": r"(?:[0-5]\d|\d)",
    "%S": r"(?:60[0-1]|[0-5]\d|\d)",
}
# First bytes of image formats, in hexadecimal.
MAGIC = {"bmp": "424D", "gif": "474946", "jpeg": "FFD8FF", "png": "89504E470D0A1A0A"}
#: Units of whole-number times, with how many make a second.
UNITS = {"UNIX_DAYS": 1 / 86400, "UNIX_SECONDS": 1, "UNIX_MILLISECONDS": 10**3, "UNIX_MICROSECONDS": 10**6, "UNIX_NANOSECONDS": 10**9}
FROM_1990, TO_2030 = 631152000, 1893456000


def formats() -> list[str]:
    """Dates, times, the combined form, and each date with each time after a space or a T."""
    return [*DATES, *TIMES, *COMBINED, *[f"{d}{gap}{t}" for d in DATES for t in TIMES for gap in GAPS]]


def pattern(fmt: str) -> str:
    out, at = "", 0
    while at < len(fmt):
        if fmt[at] == "%":
            out += LETTERS[fmt[at : at + 2]]
            at += 2
        else:
            out += "\\" + fmt[at] if not fmt[at].isalnum() and fmt[at] != " " else fmt[at]
            at += 1
    return f"^{out}$"


def prose(text: Column, least_words: int = 3, shortest: float = 2.5, longest: float = 8.0) -> Column:
    """Whether a value has enough words of a usual mean length; a blank value has none."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    size = F.try_divide(F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)), F.size(words))  # also computed where words are too few
    return (F.size(words) >= least_words) & (size >= shortest) & (size <= longest)


def natural_language(df: DataFrame, column: str, classifier: Callable[[Column], Column] = prose, crop: int | None = 100) -> DataFrame:
    """(slice, considered, matched, is_natural_language): values cropped to ``crop`` characters (None: whole) that ``classifier``, a boolean of the value, takes for prose."""
    text = F.col(column) if crop is None else F.substring(F.col(column), 1, crop)
    got = df.groupBy(SLICE).agg(F.count(column).alias("considered"), F.count_if(classifier(text)).alias("matched"), F.count_if(~F.is_valid_utf8(column)).alias("bad"))
    return got.select(SLICE, "considered", "matched", ((F.col("considered") >= LEAST_VALUES) & (F.col("matched") >= LEAST_RATIO * F.col("considered")) & (F.col("bad") == 0)).alias("is_natural_language"))


def time_strings(df: DataFrame, column: str, least: int = LEAST_VALUES, ratio: float = LEAST_RATIO) -> DataFrame:
    """(slice, considered, format, matched): the format that most values have, null below the ratio; all formats in one pass.

    A value is cut at its last gap where a time follows it, so dates and times are matched once each, not once for each of their combinations.
    """
    fs = formats()
    value = F.col(column)
    cut = df.select(SLICE, value.alias("s"), F.regexp_extract(value, r"^([^\n]*)([T ])([^T \n]*)$", 1).alias("head"), F.regexp_extract(value, r"^[^\n]*([T ])[^T \n]*$", 1).alias("gap"), F.regexp_extract(value, r"^[^\n]*[T ]([^T \n]*)$", 1).alias("tail"))
    timed = cut.select("*", *[F.col("tail").rlike(pattern(t)).alias(f"t{j}") for j, t in enumerate(TIMES)])
    both = reduce(Column.__or__, [F.col(f"t{j}") for j in range(len(TIMES))])
    timed = timed.select("*", both.alias("both"), F.when(both, F.col("head")).otherwise(F.col("s")).alias("date"))
    flags = timed.select(SLICE, "s", "gap", "both", *[f"t{j}" for j in range(len(TIMES))], *[F.col("date").rlike(pattern(d)).alias(f"d{i}") for i, d in enumerate(DATES)], *[F.when(~F.col("both"), F.col("s").rlike(pattern(t))).alias(f"o{j}") for j, t in enumerate([*TIMES, *COMBINED])])
    hits = {d: ~F.col("both") & F.col(f"d{i}") for i, d in enumerate(DATES)} | {t: F.col(f"o{j}") for j, t in enumerate([*TIMES, *COMBINED])}
    hits |= {f"{d}{gap}{t}": F.col("both") & F.col(f"d{i}") & F.col(f"t{j}") & (F.col("gap") == gap) for i, d in enumerate(DATES) for j, t in enumerate(TIMES) for gap in GAPS}
    got = flags.groupBy(SLICE).agg(F.count("s").alias("considered"), *[F.count_if(hits[f]).alias(f"m{i}") for i, f in enumerate(fs)])
    best = F.array_max(F.array(*[F.struct(F.col(f"m{i}").alias("matched"), F.lit(-i).alias("at")) for i in range(len(fs))]))
    name = F.element_at(F.array(*[F.lit(f) for f in fs]), 1 - best["at"])
    ok = (F.col("considered") >= least) & (best["matched"] >= ratio * F.col("considered"))
    return got.select(SLICE, "considered", F.when(ok, name).alias("format"), F.when(ok, best["matched"]).alias("matched"))


def time_integers(df: DataFrame, column: str, least: int = LEAST_VALUES, ratio: float = LEAST_RATIO) -> DataFrame:
    """(slice, considered, format, matched): the unit in which values lie in [1990, 2030)."""
    v = F.col(column)
    got = df.groupBy(SLICE).agg(F.count(v).alias("considered"), *[F.count_if((v >= int(FROM_1990 * u)) & (v < int(TO_2030 * u))).alias(n) for n, u in UNITS.items()])
    best = F.array_max(F.array(*[F.struct(F.col(n).alias("matched"), F.lit(n).alias("name")) for n in UNITS]))
    ok = (F.col("considered") >= least) & (best["matched"] >= ratio * F.col("considered"))
    return got.select(SLICE, "considered", F.when(ok, best["name"]).alias("format"), F.when(ok, best["matched"]).alias("matched"))


def image_format(value: Column) -> Column:
    """Format of binary values by their first bytes, else UNKNOWN."""
    head = F.hex(F.substring(value.cast("binary"), 1, 8))
    out = F.lit("UNKNOWN")
    for name, magic in MAGIC.items():
        out = F.when(head.startswith(magic), F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def image_size(value: Column) -> Column:
    """struct<width, height> from the header of PNG, GIF and BMP values; null for others."""
    raw = F.hex(F.substring(value.cast("binary"), 1, 32))

    def big(at: int, n: int) -> Column:
        return F.conv(F.substring(raw, 2 * at + 1, 2 * n), 16, 10).cast("long")

    def little(at: int, n: int) -> Column:
        return F.conv(F.concat(*[F.substring(raw, 2 * (at + k) + 1, 2) for k in reversed(range(n))]), 16, 10).cast("long")

    kind = image_format(value)
    return F.when(kind == "png", F.struct(big(16, 4).alias("width"), big(20, 4).alias("height"))).when(kind == "gif", F.struct(little(6, 2).alias("width"), little(8, 2).alias("height"))).when(kind == "bmp", F.struct(little(18, 4).alias("width"), little(22, 4).alias("height")))


def _jpeg_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height from the first frame header."""
    at = 2
    while at + 9 < len(raw) and raw[at] == 0xFF:
        kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big")
        at += 1 if kind == 0xFF else 2 + size
    return None


def jpeg_size(value: Column) -> Column:
    """struct<width, height> of JPEG values, null for others."""

    def sizes(values: pd.Series) -> pd.DataFrame:
        got = [(_jpeg_size(bytes(v)) if v is not None else None) or (None, None) for v in values]
        return pd.DataFrame(got, columns=["width", "height"]).astype("Int64")

    found = F.pandas_udf(sizes, "struct<width: bigint, height: bigint>")(F.when(image_format(value) == "jpeg", value.cast("binary")))  # type: ignore[call-overload]
    return F.when(found["width"].isNotNull(), found)


def header_size(value: Column) -> Column:
    """struct<width, height> of PNG, GIF and BMP values from their first bytes, of JPEG values from their frame header."""
    return F.coalesce(image_size(value), jpeg_size(value))


def images(df: DataFrame, column: str, least: int = LEAST_VALUES, ratio: float = LEAST_RATIO, decoder: Callable[[Column], Column] = image_size) -> DataFrame:
    """(slice, considered, matched, is_image, formats map, max_width, max_height, max_bytes); ``decoder`` gives struct<width, height> of a value."""
    rows = df.where(F.col(column).isNotNull()).select(SLICE, image_format(F.col(column)).alias("f"), decoder(F.col(column)).alias("s"), F.octet_length(column).alias("b"))
    counts = rows.groupBy(SLICE, "f").agg(F.count("*").alias("c"), F.max("s.width").alias("w"), F.max("s.height").alias("h"), F.max("b").alias("b"))
    return counts.groupBy(SLICE).agg(F.sum("c").alias("considered"), F.coalesce(F.sum(F.when(F.col("f") != "UNKNOWN", F.col("c"))), F.lit(0)).alias("matched"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("f", "c")))).alias("formats"), F.max("w").alias("max_width"), F.max("h").alias("max_height"), F.max("b").alias("max_bytes")).withColumn("is_image", (F.col("considered") >= least) & (F.col("matched") >= ratio * F.col("considered")))


def tokens(df: DataFrame, column: str, sequence_id: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(slice, sequence, position, token) of white-space separated text, or of lists of integers, which are the ids of tokens in ``vocabulary`` (token, id); an id that isn't there stands for itself as text."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType):
        words = F.filter(F.split(F.col(column), r"\s+"), lambda w: w != "")
        return df.select(SLICE, F.col(sequence_id).alias("sequence"), F.posexplode(words).alias("position", "token"))
    long = df.select(SLICE, F.col(sequence_id).alias("sequence"), F.posexplode(column).alias("position", "value")).where("value IS NOT NULL")
    if isinstance(kind.elementType, T.StringType) or vocabulary is None or "id" not in vocabulary.columns:
        return long.select(SLICE, "sequence", "position", F.col("value").cast("string").alias("token"))
    names = vocabulary.select(F.col("id").alias("value"), F.col("token").alias("__token"))
    return long.join(names, "value", "left").select(SLICE, "sequence", "position", F.coalesce("__token", F.col("value").cast("string")).alias("token"))


def token_coverage(rows: DataFrame, vocabulary: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(slice, num_tokens, in_vocabulary, feature_coverage, avg_token_length, num_sequences, min/max/avg_sequence_length) against a table of ``token``."""
    kept = rows if not excluded else rows.where(~F.col("token").isin(excluded))
    known = vocabulary.select("token").distinct().withColumn("known", F.lit(1))
    marked = kept.join(known, "token", "left")
    per = marked.groupBy(SLICE, "sequence").agg(F.count("*").alias("n"), F.count("known").alias("k"), F.sum(F.length("token")).alias("chars"))
    return per.groupBy(SLICE).agg(F.sum("n").alias("num_tokens"), F.sum("k").alias("in_vocabulary"), (F.sum("k") / F.sum("n")).alias("feature_coverage"), (F.sum("chars") / F.sum("n")).alias("avg_token_length"), F.count("*").alias("num_sequences"), F.min("n").alias("min_sequence_length"), F.max("n").alias("max_sequence_length"), F.avg("n").alias("avg_sequence_length"))


def token_stats(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """(slice, token, frequency, fraction_of_sequences, per_sequence_min/max/avg, avg_position) of chosen tokens; sequences without the token count as 0 in the minimum and average."""
    n = rows.groupBy(SLICE).agg(F.countDistinct("sequence").alias("sequences"))
    size = rows.groupBy(SLICE, "sequence").agg(F.max("position").alias("last"))
    hits = rows.where(F.col("token").isin(wanted)).join(size, [SLICE, "sequence"])
    per = hits.groupBy(SLICE, "token", "sequence").agg(F.count("*").alias("c"), F.sum(F.col("position") / F.greatest("last", F.lit(1))).alias("p"))
    got = per.groupBy(SLICE, "token").agg(F.sum("c").alias("frequency"), F.count("*").alias("having"), F.min("c").alias("least"), F.max("c").alias("per_sequence_max"), F.sum("p").alias("p"))
    return got.join(n, SLICE).select(SLICE, "token", "frequency", (F.col("having") / F.col("sequences")).alias("fraction_of_sequences"), F.when(F.col("having") < F.col("sequences"), F.lit(0)).otherwise(F.col("least")).cast("long").alias("per_sequence_min"), "per_sequence_max", (F.col("frequency") / F.col("sequences")).alias("per_sequence_avg"), (F.col("p") / F.col("frequency")).alias("avg_position"))


def worst_sequences(rows: DataFrame, vocabulary: DataFrame, k: int = 5) -> DataFrame:
    """(slice, kind, rank, sequence, score): the k sequences of lowest coverage and of shortest mean token."""
    known = vocabulary.select("token").distinct().withColumn("known", F.lit(1))
    per = rows.join(known, "token", "left").groupBy(SLICE, "sequence").agg((F.count("known") / F.count("*")).alias("coverage"), F.avg(F.length("token")).alias("token_length"))
    long = per.select(SLICE, "sequence", F.inline(F.array(F.struct(F.lit("coverage").alias("kind"), F.col("coverage").alias("score")), F.struct(F.lit("token_length").alias("kind"), F.col("token_length").alias("score")))))
    w = Window.partitionBy(SLICE, "kind").orderBy("score", "sequence")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sequence_histograms(rows: DataFrame, buckets: int = 10) -> dict[str, DataFrame]:
    """{"token_length", "sequence_length"}: QUANTILES and STANDARD histograms (slice, path, kind, bucket, low, high, count); {"rank"}: (slice, path, low_rank, high_rank, label, sample_count) of tokens."""
    from . import quantiles, values

    lengths = rows.groupBy(SLICE, F.lit("token_length").alias("path"), F.length("token").cast("double").alias("value")).agg(F.count("*").cast("double").alias("w"))
    per = rows.groupBy(SLICE, "sequence").agg(F.count("*").cast("double").alias("value"))
    sizes = per.groupBy(SLICE, F.lit("sequence_length").alias("path"), "value").agg(F.count("*").cast("double").alias("w"))
    counts = rows.groupBy(SLICE, F.lit("token").alias("path"), F.col("token").alias("value")).agg(F.count("*").alias("cnt"), F.count("*").cast("double").alias("wcnt"))
    return {"token_length": quantiles.histograms(lengths, buckets, buckets), "sequence_length": quantiles.histograms(sizes, buckets, buckets), "rank": values.rank_histogram(counts)}


def position_histograms(rows: DataFrame, wanted: list[str], buckets: int = 10) -> DataFrame:
    """(slice, path, kind, bucket, low, high, count): histograms of where in their sequences, from 0 to 1, the chosen tokens (``path``) stand."""
    from . import quantiles

    size = rows.groupBy(SLICE, "sequence").agg(F.max("position").alias("last"))
    places = rows.where(F.col("token").isin(wanted)).join(size, [SLICE, "sequence"])
    place = (F.col("position") / F.greatest("last", F.lit(1))).alias("value")
    return quantiles.histograms(places.groupBy(SLICE, F.col("token").alias("path"), place).agg(F.count("*").cast("double").alias("w")), buckets, buckets)
