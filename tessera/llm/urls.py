"""URL filters: rules, and gradient-boosted trees for what no rule decides.

The trees see lexical features only: lengths, depth, digit ratio, entropy,
parameter counts and statistics of the host's suffixes. They are trained from
labelled URLs; the URLs that rules decide serve as such.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

#: Host and path of a URL.
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Bound of the training sample: labelled URLs.
SAMPLE = 20_000
#: Trees, their depth and seed.
TREES, DEPTH, SEED = 12, 4, 11
#: Weight of the overall share in a suffix's share of blocked URLs, and the folds of the training URLs: a fold sees what
#: the others say about a suffix.
PRIOR, FOLDS = 5.0, 5
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "value_length", "marks", "secure", "suffix1", "suffix2", "suffix_urls"]


@dataclass(frozen=True)
class Rule:
    """Fits a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        on_host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return on_host & F.col("path").startswith(self.path)


# The rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def parts(df: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path`` of ``url``; both are empty for null and for URLs without ``://``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return df.withColumns({"host": F.translate(F.regexp_extract(url, SPLIT, 1), upper, upper.lower()), "path": F.regexp_extract(url, SPLIT, 2)})


def decide(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``rule`` and ``ruled``, the text and verdict of the longest rule that fits; null if none does."""
    which, what = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        which = F.when(rule.fits(), F.lit(rule.text)).otherwise(which)
        what = F.when(rule.fits(), F.lit(rule.verdict)).otherwise(what)
    return df.withColumns({"rule": which, "ruled": what})


def lexical(df: DataFrame) -> DataFrame:
    """Adds what the trees see of ``url``, ``host`` and ``path``, and the suffixes ``s1`` and ``s2``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    n = F.length(url).cast("double")
    some = F.greatest(n, F.lit(1.0))
    shares = F.transform(F.array_distinct(F.split(url, "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / some)
    labels = F.split("host", r"\.")
    return df.withColumns(
        {
            "length": n,
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.size(F.array_remove(F.split("path", "/"), "")).cast("double"),
            "labels": F.when(F.col("host") == "", 0.0).otherwise(F.size(labels).cast("double")),
            "digits": F.when(n == 0, 0.0).otherwise(F.length(F.regexp_replace(url, "[^0-9]", "")) / some),
            "entropy": F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0)),
            "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "[&;]")).cast("double")),
            "value_length": F.length(query).cast("double"),
            "marks": F.length(F.regexp_replace(url, "[A-Za-z0-9]", "")).cast("double"),
            "secure": F.startswith(url, F.lit("https")).cast("double"),
            "s1": F.element_at(labels, -1),
            "s2": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2))),
        }
    )


def counts(labelled: DataFrame, name: str) -> DataFrame:
    """``(name, fold, bad, n)``: blocked and all URLs of each suffix in each fold."""
    return labelled.groupBy(name, "fold").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"))


def suffixes(counted: DataFrame, name: str, share: float, without_fold: bool = False) -> DataFrame:
    """``(name, <name>_share, <name>_urls)``: the smoothed share of blocked URLs of each suffix, and how many there are.

    ``without_fold``: for each fold what all the others have.
    """
    total = counted.groupBy(name).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    if without_fold:
        own = counted.select(name, "fold", F.col("bad").alias("own_bad"), F.col("n").alias("own"))
        total = own.join(total, name).select(name, "fold", (F.col("bad") - F.col("own_bad")).alias("bad"), (F.col("n") - F.col("own")).alias("n"))
    told = [((F.col("bad") + PRIOR * share) / (F.col("n") + PRIOR)).alias(f"{name}_share"), F.log1p("n").alias(f"{name}_urls")]
    return total.select(name, *(["fold"] if without_fold else []), *told)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for every row of ``pages(page_id, url)``.

    The verdict is the rule's, else the trees': ``block`` from a score of 0.5.
    ``labels(url, label)``, label 1 for block, trains the trees; by default
    the pages that rules decide do, of which ``sample`` are taken, those whose
    URLs hash lowest. Without labelled URLs the score is 0. Null URLs and
    those without ``://`` have an empty host and path; repeated rows give one
    row each; a null page_id stays null; other columns are ignored; a very
    long URL is judged as a whole; an empty table gives an empty result. What
    the trees see of a suffix in training comes from other folds of the URLs.
    """
    ruled = lexical(decide(parts(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))), rules))
    if labels is None:
        labelled = ruled.where("ruled IS NOT NULL").withColumn("label", (F.col("ruled") == "block").cast("double"))
    else:
        labelled = lexical(parts(labels.select(F.col("url").cast("string"), F.col("label").cast("double")))).where("label IS NOT NULL")
    known = labelled.agg(F.avg("label").alias("share")).head()["share"]
    out = ["page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score"]
    if known is None:
        return ruled.withColumn("score", F.lit(0.0)).select(*out)
    labelled = labelled.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))
    counted = {s: cut(counts(labelled, s)) for s in ("s1", "s2")}

    def described(df: DataFrame, without_fold: bool = False) -> DataFrame:
        for s in counted:
            df = df.join(suffixes(counted[s], s, known, without_fold), [s, "fold"] if without_fold else s, "left")
        filled = df.withColumns({"suffix1": F.coalesce("s1_share", F.lit(known)), "suffix2": F.coalesce("s2_share", F.lit(known)), "suffix_urls": F.coalesce("s2_urls", F.lit(0.0))})
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(filled)

    few = labelled.orderBy(F.xxhash64("url"), "url").limit(sample)
    training = cut(described(few, without_fold=True).select("features", "label"))
    if training.select("label").distinct().count() < 2:
        return ruled.withColumn("score", F.lit(known)).select(*out)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.2).fit(training)
    scored = model.transform(described(ruled)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*out)


def op7(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
