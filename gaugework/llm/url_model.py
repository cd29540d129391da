"""URL filter: host rules first, then the ratio of two character language models.

Two variable-order Markov models, of the URLs that rules allow and of those that they block, give
every character the probability that its context suggests.  Contexts have 0 to ``order``
characters; Witten-Bell smoothing mixes each order with the shorter ones, weighing a context by
how often it was seen against how many different characters followed it.  The difference of
the log-likelihoods per character is calibrated on a fold of rule-decided URLs that the
counts leave out (two normal densities with one variance), and URLs without a rule are judged by it.

Counts are taken over all rule-decided URLs and grow with them; nothing is hashed, cut or
sampled.  Every step is a DataFrame operation: n-grams are counted with map-side combining,
and a URL looks its n-grams up by a join with the counts, which are written out first so that
the join can split a hot n-gram ("http") over tasks.

Defined cases: a NULL URL or one without ``://`` has empty host and path and is judged as it stands; a NULL
or empty URL has the score 0.5; without URLs of both kinds, or if the models do not tell them
apart, every score is 0.5; a URL without a rule is allowed from 0.5; repeated rows and NULL ids are kept;
an empty table gives no rows; columns other than the id and ``url`` are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.shared import saved

ORDER = 4
#: One of so many URLs, by hash, calibrates and does not count.
CALIBRATION = 5
#: Characters that the smallest context spreads its remaining weight over.
ALPHABET = 256
_START = "\x02"


@dataclass(frozen=True)
class Rule:
    """``site`` is a host and the beginning of a path, as ``example.net/en/``."""

    verdict: str
    site: str

    @property
    def host(self) -> str:
        return self.site.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.site.partition("/")[2]


def ascii_lower(text: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def host_of(url: str = "url") -> Column:
    after = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(after, F.lit("")))


def path_of(url: str = "url") -> Column:
    after = F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(after, F.lit(""))


def rule_of(rules: Sequence[Rule], host: str = "host", path: str = "path") -> Column:
    """The longest rule that fits, as its site; NULL if none does."""
    result = F.lit(None).cast("string")
    # Later conditions win, so the longest comes last.
    for rule in sorted(rules, key=lambda r: (len(r.site), r.site)):
        fits = (F.col(host) == rule.host) | F.endswith(F.col(host), F.lit("." + rule.host))
        result = F.when(fits & F.startswith(F.col(path), F.lit(rule.path)), rule.site).otherwise(result)
    return result


def _verdict(rules: Sequence[Rule], site: Column) -> Column:
    result = F.lit(None).cast("string")
    for rule in rules:
        result = F.when(site == rule.site, rule.verdict).otherwise(result)
    return result


def _places(urls: DataFrame, order: int) -> DataFrame:
    """One row per character: ``gram`` is the character after the ``order`` characters before it."""
    padded = urls.withColumn("_text", F.concat(F.lit(_START * order), "url"))
    at = padded.withColumn("_at", F.explode(F.sequence(F.lit(1), F.char_length("url"))))
    return at.withColumn("gram", F.substr("_text", F.col("_at"), F.lit(order + 1))).drop("_text", "_at", "url")


def _shorter(grams: DataFrame, order: int) -> DataFrame:
    """Every gram with each of its contexts: ``k`` characters long, and the character after it."""
    by_length = grams.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(order + 1)))))
    return by_length.select(
        "*",
        F.substr("gram", F.lit(order + 1) - F.col("k"), F.col("k")).alias("context"),
        F.substr("gram", F.lit(order + 1), F.lit(1)).alias("last"),
    )


def counts(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """``context, last, a, b`` of allowed and blocked URLs, for contexts of 0 to ``order`` characters.

    ``urls`` has ``url`` (not empty) and ``allowed``.  Equal URLs are combined first, then
    equal grams of the longest kind; the shorter kinds are sums of those.
    """
    distinct = urls.groupBy("url").agg(
        F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("b")
    )
    longest = _places(distinct, order).groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return saved(
        _shorter(longest, order).groupBy("context", "last").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )


def _gram_differences(grams: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """``gram, d``: difference of the log-probabilities of the last character given those before."""
    contexts = saved(
        model.groupBy("context").agg(
            F.sum("a").alias("a_all"),
            F.sum("b").alias("b_all"),
            F.count_if(F.col("a") > 0).alias("a_kinds"),
            F.count_if(F.col("b") > 0).alias("b_kinds"),
        )
    )
    known = (
        _shorter(grams, order)
        .join(model, ["context", "last"], "left")
        .join(contexts, "context", "left")
        .na.fill(0)
    )

    def mixed(own: str) -> list[Column]:
        total = F.col(f"{own}_all") + F.col(f"{own}_kinds")
        return [
            F.when(total > 0, F.col(own) / total).otherwise(F.lit(0.0)).alias(f"{own}_own"),
            F.when(total > 0, F.col(f"{own}_kinds") / total).otherwise(F.lit(1.0)).alias(f"{own}_rest"),
        ]

    steps = known.select("gram", F.struct("k", *mixed("a"), *mixed("b")).alias("step"))
    ordered = steps.groupBy("gram").agg(F.sort_array(F.collect_list("step")).alias("steps"))

    def probability(own: str) -> Column:
        return F.aggregate(
            "steps", F.lit(1.0 / ALPHABET), lambda p, s: s[f"{own}_own"] + s[f"{own}_rest"] * p
        )

    return ordered.select("gram", (F.log(probability("a")) - F.log(probability("b"))).alias("d"))


def differences(urls: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``url, difference`` of every different URL: log-likelihood per character, allowed less blocked.

    Each different gram is looked up once, whatever number of URLs holds it.
    """
    texts = saved(
        urls.select("url").where(F.char_length("url") > 0).distinct().withColumn("_id", F.monotonically_increasing_id())
    )
    places = _places(texts, order)
    known = saved(_gram_differences(places.select("gram").distinct(), model, order))
    # Decimal sums do not depend on the order of the rows.
    sums = (
        places.join(known, "gram")
        .groupBy("_id")
        .agg((F.sum(F.col("d").cast("decimal(30,12)")).cast("double") / F.count("d")).alias("difference"))
    )
    return texts.join(sums, "_id").select("url", "difference")


def calibrated(decided: DataFrame) -> Column:
    """The score for ``difference``, by the rows of ``decided`` (``difference, allowed``): one aggregate row."""
    x, a = F.col("difference"), F.col("allowed")
    fit = decided.agg(
        F.avg(F.when(a, x)).alias("high"),
        F.avg(F.when(~a, x)).alias("low"),
        F.var_pop(F.when(a, x)).alias("high_var"),
        F.var_pop(F.when(~a, x)).alias("low_var"),
    ).first()
    if fit is None or None in tuple(fit) or fit["high"] <= fit["low"]:
        return F.lit(0.5)
    spread = max((fit["high_var"] + fit["low_var"]) / 2, 1e-9)
    slope, middle = (fit["high"] - fit["low"]) / spread, (fit["high"] + fit["low"]) / 2
    return 1 / (1 + F.exp(-F.greatest(F.least(slope * (x - middle), F.lit(700.0)), F.lit(-700.0))))


def judged(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", order: int = ORDER) -> DataFrame:
    """``id, host, path, rule, verdict, score``; the score is the model's, also where a rule decides."""
    rows = pages.select(F.col(id_col), F.col("url")).withColumns({"host": host_of(), "path": path_of()})
    rows = rows.withColumn("rule", rule_of(rules))
    rows = rows.withColumn("_ruled", _verdict(rules, F.col("rule")))
    decided = rows.where(F.col("_ruled").isNotNull()).select("url", (F.col("_ruled") == "allow").alias("allowed"))
    # Equal URLs share a fold, so none is both counted and used for calibration.
    apart = F.conv(F.substring(F.md5("url"), 1, 4), 16, 10).cast("int") % CALIBRATION == 0
    model = counts(decided.where(~apart), order)
    found = saved(differences(rows.where(F.col("url").isNotNull()), model, order))
    score = calibrated(decided.where(apart).join(found, "url"))
    joined = rows.join(found.withColumn("_score", score).select("url", "_score"), "url", "left")
    verdict = F.coalesce("_ruled", F.when(F.coalesce("_score", F.lit(0.5)) >= 0.5, "allow").otherwise("block"))
    return joined.select(
        id_col, "host", "path", "rule", verdict.alias("verdict"), F.coalesce("_score", F.lit(0.5)).alias("score")
    )
