"""URL filters: rules on hosts and paths, and gradient-boosted trees on lexical features for what no rule covers.

The urls that a rule covers are the labelled ones that the trees are trained from.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.session import broadcast_if_small, stage

# The rules as host and path, with their verdicts.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# No more than so many different urls of each verdict, those of smallest hash, train the trees.
SAMPLE = 10_000
TREES, DEPTH, SEED = 20, 4, 7
FEATURES = (
    "url_length", "host_length", "host_labels", "hyphens", "depth", "digit_ratio", "entropy", "parameters", "fragment",
    "secure", "suffix_blocked", "ending_blocked",
)


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``; both are empty for a url that is null or has no ``://``."""
    rest = F.substring(F.col(url), F.instr(F.col(url), F.lit("://")) + 3, F.length(url))
    known = F.coalesce(F.instr(F.col(url), F.lit("://")) > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.when(known, host).otherwise(""), "path": F.when(known, path).otherwise("")})


def judge_by_rules(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``pages (host, path)`` with ``rule`` and ``verdict`` of the longest rule that fits, or nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))

    def fits(host: str, path: str) -> Column:
        own = (F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))
        return own & F.startswith("path", F.lit(path))

    rule = F.coalesce(*[F.when(fits(h, p), h + p) for h, p, _ in ordered])
    verdict = F.coalesce(*[F.when(fits(h, p), v) for h, p, v in ordered])
    return pages.withColumns({"rule": rule, "verdict": verdict})


def _endings(pages: DataFrame) -> DataFrame:
    """With the last label of the host and the ending of the path."""
    return pages.withColumns(
        {"_suffix": F.substring_index("host", ".", -1), "_ending": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$|(/)$", 0)}
    )


def features(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages (url, host, path)`` with the lexical features; a null url has the features of an empty one."""
    text = F.coalesce(F.col(url), F.lit(""))
    size = F.length(text)
    count = lambda value, chars: F.length(value) - F.length(F.translate(value, chars, ""))
    letters = F.array_distinct(F.split(text, ""))
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    entropy = F.aggregate(
        F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))
    )
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    columns = {
        "url_length": size,
        "host_length": F.length("host"),
        "host_labels": count(F.col("host"), ".") + 1,
        "hyphens": count(F.col("host"), "-"),
        "depth": count(F.col("path"), "/"),
        "digit_ratio": F.when(size > 0, count(text, "0123456789") / size).otherwise(0),
        "entropy": F.when(size > 0, entropy).otherwise(0),
        "parameters": F.when(query != "", count(query, "&") + 1).otherwise(0),
        "fragment": F.contains(text, F.lit("#")),
        "secure": F.startswith(text, F.lit("https:")),
    }
    return pages.withColumns({name: value.cast("double") for name, value in columns.items()})


class UrlModel:
    """Boosted trees with the blocked shares of host suffixes and path endings. Both tables come from the sample."""

    def __init__(self, trees: PipelineModel, shares: dict[str, DataFrame], usual: float):
        self.trees, self.shares, self.usual = trees, shares, usual

    def rows(self, pages: DataFrame) -> DataFrame:
        """All features of ``pages (host, path)``; a suffix that the sample lacks has the usual share."""
        return _with_shares(features(_endings(pages)), self.shares, self.usual)

    def blocked(self, pages: DataFrame) -> DataFrame:
        """``pages`` with ``block_probability``."""
        scored = self.trees.transform(self.rows(pages))
        return scored.select(*pages.columns, vector_to_array("probability")[1].alias("block_probability"))


def _with_shares(pages: DataFrame, shares: dict[str, DataFrame], usual: float) -> DataFrame:
    for name, table in shares.items():
        pages = pages.join(broadcast_if_small(table), name, "left").fillna({f"{name[1:]}_blocked": usual})
    return pages


def drawn_urls(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``url, host, path, verdict``: the ``sample`` different urls of smallest hash of each verdict, all if it has fewer.

    Copies of a url count once. Their number is estimated first, so that little more than the sample is shuffled.
    """
    labelled = pages.where("verdict IS NOT NULL").withColumn("_hash", F.xxhash64("url", F.lit(3)))
    counts = labelled.groupBy("verdict").agg(F.approx_count_distinct("url", 0.02).alias("n")).collect()
    # Room for the error of the estimate: so many times the sample pass the hash before they are cut to it.
    share = {row["verdict"]: min(1.0, 1.5 * sample / max(1, row["n"])) for row in counts}
    passes = F.coalesce(*[F.when(F.col("verdict") == v, F.pmod("_hash", F.lit(1 << 40)) < int(x * (1 << 40))) for v, x in share.items()], F.lit(False))
    urls = labelled.where(passes).select("url", "host", "path", "verdict", "_hash").distinct()
    place = F.row_number().over(Window.partitionBy("verdict").orderBy(F.pmod("_hash", F.lit(1 << 40)), "url"))
    return urls.withColumn("_place", place).where(F.col("_place") <= sample).select("url", "host", "path", "verdict")


def train(pages: DataFrame, sample: int = SAMPLE) -> UrlModel | None:
    """Learn from at most ``sample`` different urls of each verdict; None unless both verdicts occur."""
    drawn = drawn_urls(pages, sample)
    drawn = _endings(drawn.select("url", "host", "path", (F.col("verdict") == "block").cast("double").alias("label")))
    drawn = stage(drawn, "labelled")
    seen = drawn.agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
    if not seen["n"] or seen["share"] in (0.0, 1.0):
        return None
    usual = seen["share"]
    shares = {}
    for name in ("_suffix", "_ending"):
        smoothed = (F.sum("label") + 5 * usual) / (F.count("*") + 5)
        shares[name] = stage(drawn.groupBy(name).agg(smoothed.alias(f"{name[1:]}_blocked")), "shares")
    rows = _with_shares(features(drawn), shares, usual)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("url", "features", "label")
    # The sample has a bounded size, so a few partitions hold it; in order, so that a rerun adds up the same way.
    rows = stage(rows.repartitionByRange(4, "url").sortWithinPartitions("url"), "sample")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, checkpointInterval=-1).fit(rows)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    return UrlModel(PipelineModel([assembler, trees]), shares, usual)


def filter_urls(pages: DataFrame, url: str = "url", rules: tuple = RULES, sample: int = SAMPLE) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, block_probability``.

    The longest rule that fits decides; for the others the trees do, and block from a probability of one half. Without
    labelled urls of both verdicts all others are allowed. A null url has an empty host and path. Columns of
    ``pages`` with one of these names are replaced.
    """
    made = ("host", "path", "rule", "verdict", "block_probability")
    plain = pages.drop(*made)
    hidden = plain.withColumnsRenamed({c: f"_in_{c}" for c in plain.columns}).withColumn("url", F.col(f"_in_{url}").cast("string"))
    known = judge_by_rules(parts(hidden), rules)
    model = train(known, sample)
    judged = model.blocked(known) if model else known.withColumn("block_probability", F.lit(0.0))
    verdict = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    judged = judged.withColumn("verdict", F.coalesce("verdict", verdict))
    return judged.select(*[F.col(f"_in_{c}").alias(c) for c in plain.columns], *made)
