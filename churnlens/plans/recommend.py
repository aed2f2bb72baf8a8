"""Feature recommender: adoption gap between healthy and at-risk accounts, and the top unused
features per account with an action (E6-E8, M2).

Priority list and usage meet once, as one row per account with the features it used; one grouped
aggregate over those rows gives the catalogue: users of every feature by risk group, the groups' sizes
and the widest account.  Breadth, threshold, gaps and the eligible list follow from the catalogue, which
has a row a feature.

Accounts x features is never formed.  Eligible features are ordered globally (gap DESC, name); an account
that used u features finds its top k among the first k + u of them, so the first k + (most used by any
account) entries serve everyone: a list no longer than the longest row of features plus k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ACTION_LABELS, RISK_LABELS, ChurnConfig
from ..functions.expr import ratio

LOW = RISK_LABELS[2]
NO_ACTION = ACTION_LABELS[3]


def used_features(usage: DataFrame) -> DataFrame:
    """Distinct features ever used, one row per account (folded map side; an array no longer than the catalogue)."""
    return usage.groupBy("account_id").agg(F.collect_set("feature_name").alias("features"))


def with_features(priority: DataFrame, used: DataFrame) -> DataFrame:
    """One row per account of the portfolio or with usage: risk_level (NULL: not of the portfolio), arr, action, features.

    ``used``: :func:`used_features`, or its distinct (account_id, feature_name) pairs.
    """
    sets = used if "features" in used.columns else used_features(used)
    both = priority.select("account_id", "risk_level", "arr", "action").join(sets, "account_id", "full")
    return both.withColumn("features", F.coalesce("features", F.array().cast("array<string>")))


def feature_counts(portfolio: DataFrame) -> DataFrame:
    """The catalogue: per feature, healthy and at-risk accounts that used it (also 0 and 0).  The row without a
    feature holds the sizes of both groups and the most features that an account used."""
    marker = F.when(F.col("risk_level").isNotNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    rows = portfolio.select("risk_level", F.size("features").alias("_u"), F.explode(F.concat(marker, "features")).alias("feature_name"))
    healthy = F.col("risk_level") == LOW
    return rows.groupBy("feature_name").agg(
        F.count(F.when(healthy, 1)).alias("n_healthy"), F.count(F.when(~healthy, 1)).alias("n_risk"), F.max("_u").alias("most_used")
    )


def pct_hundredths(num, den):
    """round(num * 100 / den, 2) as an integer number of hundredths, HALF_UP.

    Integer numerator and denominator: floor((20000 n + d) / 2d) is exact
    (the quotient of two integers below 2^53 is correctly rounded, and a
    non-integral quotient stays at least 1/2d away from the next integer).
    NULL when the denominator is 0.
    """
    n = (F.col(num) if isinstance(num, str) else num).cast("long")
    d = (F.col(den) if isinstance(den, str) else den).cast("long")
    return F.floor(F.try_divide(n * 20000 + d, d * 2)).cast("long")


def gaps_of(catalogue: DataFrame, cfg: ChurnConfig, all_features: bool = False) -> DataFrame:
    """E6 from :func:`feature_counts`."""
    sizes = catalogue.where(F.col("feature_name").isNull())
    used = catalogue.where(F.col("feature_name").isNotNull() & (F.col("n_healthy") + F.col("n_risk") > 0))
    per = used.select(
        "feature_name",
        pct_hundredths("n_healthy", sizes.select("n_healthy").scalar()).alias("_h100"),
        pct_hundredths("n_risk", sizes.select("n_risk").scalar()).alias("_r100"),
    )
    if not all_features:
        thr = int(round(cfg.gap_threshold * 100)) if cfg.gap_threshold is not None else threshold_of(catalogue).select("threshold").scalar() * 100
        per = per.where(F.col("_h100") - F.col("_r100") > thr)
    return per.select(
        "feature_name",
        (F.col("_h100") / 100).alias("adoption_healthy"),
        (F.col("_r100") / 100).alias("adoption_risk"),
        ((F.col("_h100") - F.col("_r100")) / 100).alias("gap"),
        (F.col("_h100") - F.col("_r100")).alias("_gap100"),
    )


def adoption_gap(priority: DataFrame, used: DataFrame, cfg: ChurnConfig, all_features: bool = False) -> DataFrame:
    """E6 - per feature: % of healthy (Low risk) and of at-risk accounts of the portfolio that ever used it.

    Percentages are rounded to 2 decimals before the gap is tested against
    ``cfg.gap_threshold`` (strictly greater), as in the source.  Denominators
    are the portfolio's own group sizes.
    """
    return gaps_of(feature_counts(with_features(priority, used)), cfg, all_features)


def recommend(portfolio: DataFrame, catalogue: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """E7 from :func:`with_features` and :func:`feature_counts`."""
    entry = F.struct((-F.col("_gap100")).alias("minus_gap"), F.col("feature_name").alias("name"), F.col("adoption_healthy").alias("adoption"))
    depth = F.coalesce(catalogue.agg(F.max("most_used")).scalar(), F.lit(0)) + cfg.top_k
    # the catalogue has a row a feature, so its ordered list is cut where no account reads on
    eligible = F.slice(gaps_of(catalogue, cfg).agg(F.sort_array(F.collect_list(entry))).scalar(), F.lit(1), depth.cast("int"))
    targets = portfolio.where(F.col("action") != NO_ACTION)
    unused = F.slice(F.array_except(eligible["name"], F.col("features")), 1, cfg.top_k)
    top = targets.select("account_id", "risk_level", "arr", "action", F.posexplode(unused).alias("_r", "feature_name"), eligible.alias("_list"))
    adoption = F.element_at(F.col("_list.adoption"), F.array_position(F.col("_list.name"), F.col("feature_name")).cast("int"))
    return top.select("account_id", "risk_level", "arr", "action", "feature_name", adoption.alias("adoption_healthy"),
                      (F.col("_r") + 1).cast("long").alias("rank"))


def recommend_features(priority: DataFrame, used: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """E7 - for accounts with an action: up to ``top_k`` eligible features they never used,
    ordered by gap DESC then name; rank 1..k.  ``used`` as in :func:`with_features`."""
    portfolio = with_features(priority, used)
    return recommend(portfolio, feature_counts(portfolio), cfg)


def recommend_counts(recs: DataFrame) -> DataFrame:
    """E8 - accounts each feature is recommended to."""
    return recs.groupBy("feature_name").agg(F.countDistinct("account_id").alias("accounts"))


def threshold_of(catalogue: DataFrame) -> DataFrame:
    """M2 from :func:`feature_counts`: an account's breadth counts it once for every feature it used."""
    feature = F.col("feature_name").isNotNull()
    total = catalogue.agg(
        *[F.coalesce(F.sum(F.when(feature, F.col(c))), F.lit(0)).alias(f"_b_{c}") for c in ("n_healthy", "n_risk")],
        *[F.max(F.when(~feature, F.col(c))).alias(c) for c in ("n_healthy", "n_risk")],
        F.count(F.when(feature, 1)).alias("n_features"),
    )
    means = total.select(
        ratio("_b_n_healthy", "n_healthy").alias("mean_breadth_healthy"), ratio("_b_n_risk", "n_risk").alias("mean_breadth_risk"), "n_features"
    )
    return means.withColumn("threshold", (F.col("mean_breadth_healthy") - F.col("mean_breadth_risk")) / F.col("n_features") * 100)


def breadth_gap_threshold(priority: DataFrame, used: DataFrame) -> DataFrame:
    """M2 - the gap threshold explained: (mean breadth healthy - mean breadth at risk) / features * 100.

    ``used`` as in :func:`with_features`."""
    return threshold_of(feature_counts(with_features(priority, used)))
