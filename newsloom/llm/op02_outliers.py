"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Base statistics of a text are counted in its row. Four transformed statistics of the texts
that pass the base rules (word length, log rate of symbols, log count of repeated lines and
share of repeated words) get a minimum-covariance-determinant estimate for each language and source: start
from medians and absolute deviations, then ``STEPS`` concentration steps, each the mean and
covariance of the ``KEEP`` share of rows nearest to the last estimate. A text is rejected if
its squared Mahalanobis distance, scaled so that the group's median fits the chi-square law,
is above ``CUTOFF``. A ridge of ``FLOOR`` squared keeps statistics that are constant in clean
text from making every deviation infinite.

Sources with fewer than ``LEAST`` such texts are held against all texts of their language; a
language that is still smaller rejects nothing. Null lang and source are values of their own. Null and empty
texts have no words and fail the base rules. Repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import stored

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
KEEP, STEPS, LEAST, SALTS = 0.75, 3, 30, 16
FLOOR = (0.15, 0.25, 0.5, 0.08)
#: Chi-square quantiles of four degrees of freedom: the median, and 0.99999.
MEDIAN, CUTOFF = 3.3567, 28.47
X = ("x0", "x1", "x2", "x3")


def repeated_words(words: str, n: str) -> Column:
    """Words in 3-word windows that occur twice or more, in one row: window hashes are sorted with
    their places, and only texts with an equal pair of hashes take the second part."""
    return F.expr(f"""
        CASE WHEN {n} < 4 OR size(array_distinct(windows)) = size(windows) THEN 0L
        ELSE aggregate(
            array_append(sort_array(transform(
                filter(zipped, (e, i) -> (i > 0 AND e.h = zipped[i - 1].h) OR (i < size(zipped) - 1 AND e.h = zipped[i + 1].h)),
                e -> e.at)), 2147483640),
            named_struct('last', -3, 'sum', 0L),
            (s, at) -> named_struct('last', at, 'sum', s.sum + least(3, at - s.last)),
            s -> s.sum - 3)
        END""")


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of each whole text."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", "lang", "source", F.array_remove(F.split(text, BLANK), "").alias("words"),
                        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"), text.alias("text"))
    counted = split.select(
        "doc_id", "lang", "source", F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.regexp_replace("text", BLANK, "")).cast("bigint").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr("CASE WHEN size(words) < 3 THEN array() ELSE transform(sequence(0, size(words) - 3), "
               "i -> xxhash64(words[i], words[i + 1], words[i + 2])) END").alias("windows"),
    )
    zipped = counted.withColumn("zipped", F.expr(
        "CASE WHEN size(array_distinct(windows)) = size(windows) THEN NULL "
        "ELSE sort_array(transform(windows, (h, i) -> named_struct('h', h, 'at', i))) END"))
    return zipped.withColumn("n_repeat_words", repeated_words("windows", "n_words")).drop("windows", "zipped")


def with_base_rules(stats: DataFrame) -> DataFrame:
    return stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def transformed(stats: DataFrame) -> DataFrame:
    n = F.greatest("n_words", F.lit(1))
    return stats.withColumns({
        "x0": F.col("word_chars") / n,
        "x1": F.log1p(100 * F.col("n_symbols") / n),
        "x2": F.log1p(F.col("n_dup_lines").cast("double")),
        "x3": F.col("n_repeat_words") / n,
    })


def _cholesky(c: dict[tuple[int, int], Column]) -> dict[tuple[int, int], Column]:
    low: dict[tuple[int, int], Column] = {}
    for i in range(4):
        for j in range(i + 1):
            rest = c[i, j]
            for k in range(j):
                rest = rest - low[i, k] * low[j, k]
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / low[j, j]
    return low


def _distance() -> Column:
    """Squared Mahalanobis distance from columns m0-m3 and the Cholesky factor l00-l33."""
    y: list[Column] = []
    for i in range(4):
        rest = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * y[k]
        y.append(rest / F.col(f"l{i}{i}"))
    return y[0] ** 2 + y[1] ** 2 + y[2] ** 2 + y[3] ** 2


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Group columns on each row; a hot group is met in SALTS parts."""
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, ["grp", "salt"])


def estimates(rows: DataFrame) -> DataFrame:
    """grp, m0-m3, the Cholesky factor and the scale of distances, from rows (grp, salt, x0-x3)."""
    centre = stored(rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(X)]))
    spread = _joined(rows, centre).groupBy("grp").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(4)],
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i, x in enumerate(X)],
    )
    now = spread.select(
        "grp", *[f"m{i}" for i in range(4)],
        *[(F.sqrt((1.4826 * F.col(f"s{i}")) ** 2 + FLOOR[i] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(4) for j in range(i + 1)],
    )
    for _ in range(STEPS):
        now = stored(now)
        far = _joined(rows, now).withColumn("d", _distance())
        near = stored(far.groupBy("grp").agg(F.percentile_approx("d", KEEP, 1000).alias("bound")))
        kept = _joined(far.select("grp", "salt", "d", *X), near).where("d <= bound")
        moments = kept.groupBy("grp").agg(
            *[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)],
            *[F.covar_pop(X[i], X[j]).alias(f"c{i}{j}") for i in range(4) for j in range(i + 1)],
        )
        low = _cholesky({(i, j): F.col(f"c{i}{j}") + (FLOOR[i] ** 2 if i == j else 0) for i in range(4) for j in range(i + 1)})
        now = moments.select("grp", *[f"m{i}" for i in range(4)], *[c.alias(f"l{i}{j}") for (i, j), c in low.items()])
    now = stored(now)
    scale = _joined(rows, now).withColumn("d", _distance()).groupBy("grp").agg(F.percentile_approx("d", 0.5, 1000).alias("d50"))
    # Never below 1: the ridge alone sets the distances of a group without spread.
    return stored(now.join(scale.select("grp", F.greatest(F.col("d50") / MEDIAN, F.lit(1.0)).alias("scale")), "grp"))


def judged(docs: DataFrame) -> DataFrame:
    """The base statistics with base_failed, distance and kept."""
    stats = stored(with_base_rules(base_statistics(docs)))
    passing = stats.where("not base_failed")
    big = stored(passing.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).select("lang", "source"))
    salt = F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)).cast("int").alias("salt")
    named = big.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t"))
    x = transformed(stats.select("*", salt))
    same = x["lang"].eqNullSafe(named["l"]) & x["source"].eqNullSafe(named["s"]) & (x["salt"] == named["t"])
    own = F.to_json(F.struct("lang", F.when(F.col("t").isNotNull(), F.struct("source")).alias("own")))
    rows = stored(x.join(named, same, "left").withColumn("grp", own).drop("l", "s", "t"))
    language = F.to_json(F.struct("lang"))
    sound = rows.where("not base_failed").select(F.explode(F.array_distinct(F.array("grp", language))).alias("grp"), "salt", *X)
    enough = stored(sound.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).select("grp"))
    found = estimates(_joined(sound, enough))
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.join(spread, ["grp", "salt"], "left").withColumn("distance", _distance() / F.col("scale"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"),
    )
