"""URL filters: allow and block rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host and a path, ``net/``. It fits a URL on its host or any subdomain whose path starts with
the rule's; the longest fitting rule decides. Everything else is scored by trees trained from labelled
URLs: length, depth, digit ratio, entropy, parameter counts, and how often URLs under the same one, two
or three last host labels were blocked among all labelled ones (out of fold while training).

Columns other than id and URL are not carried along.

A null URL, or one without ``://``, has an empty host and path and is judged by the trees. Without
labels of both kinds every URL gets the only kind there is (allow if there is none). Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDS = 5
#: Words in a host that mark a URL as blocked where no other labels are at hand.
SPAM_WORDS = ("casino", "pills", "bets", "spam", "viagra", "poker", "loan", "porn", "xxx", "cheap", "jackpot", "replica")
FEATURES = ["url_len", "host_len", "path_len", "query_len", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "params", "param_len", "has_fragment", "rate_1", "seen_1", "rate_2", "seen_2", "rate_3", "seen_3"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL."""
    known = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(known, pattern, 1), UPPER, LOWER), F.regexp_extract(known, pattern, 2)


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; nulls where none fits. The rules are few and become one CASE."""
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for verdict_of, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(verdict_of))
    return rule, verdict


def _entropy(text: Column) -> Column:
    letters = F.split(text, "")
    share = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters))
    return F.when(F.length(text) > 0, -F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)


def _suffixes(host: Column) -> list[Column]:
    return [F.when(F.size(F.split(host, r"\.")) >= k, F.substring_index(host, ".", -k)) for k in (1, 2, 3)]


def lexical(df: DataFrame, url_col: str) -> DataFrame:
    """``df`` with host, path and the lexical features of the URL, suffix statistics left out."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = url_parts(F.col(url_col))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    digits = lambda c: F.length(F.regexp_replace(c, r"[^0-9]", ""))
    return df.withColumns({"host": host, "path": path}).withColumns({
        "url_len": F.length(url), "host_len": F.length("host"), "path_len": F.length("path"), "query_len": F.length(query),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")), "labels": F.size(F.split("host", r"\.")),
        "digit_ratio": digits(url) / F.greatest(F.length(url), F.lit(1)), "host_digit_ratio": digits(F.col("host")) / F.greatest(F.length("host"), F.lit(1)),
        "hyphens": F.length("host") - F.length(F.translate("host", "-", "")), "entropy": _entropy(F.col("host")),
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "param_len": F.length(query) / F.when(query == "", 1).otherwise(F.size(F.split(query, "&"))),
        "has_fragment": url.contains("#").cast("int"), **{f"suffix_{k}": c for k, c in enumerate(_suffixes(F.col("host")), 1)},
    })


def weak_labels(pages: DataFrame, url_col: str = "url", words: Sequence[str] = SPAM_WORDS) -> DataFrame:
    """Labelled URLs by the words in their hosts, where no hand-made labels exist: (url, blocked)."""
    host, _ = url_parts(F.col(url_col))
    return pages.select(F.col(url_col).alias("url"), host.rlike("|".join(words)).cast("int").alias("blocked")).filter("url is not null")


def suffix_statistics(known: DataFrame) -> DataFrame:
    """(k, suffix, fold, n_all, b_all, n_out, b_out): how many of all labelled distinct URLs (url, blocked) stand under each suffix and how many of them are blocked, in all folds and in all but one."""
    host, _ = url_parts(F.col("url"))
    suffix = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c.alias("suffix")) for k, c in enumerate(_suffixes(F.col("host")), 1)]))
    by_fold = known.select("blocked", _fold().alias("fold"), host.alias("host")).select("blocked", "fold", suffix.alias("s")).select("blocked", "fold", "s.*").filter("suffix is not null").groupBy("k", "suffix", "fold").agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
    # at most FOLDS rows a suffix
    folds = by_fold.groupBy("k", "suffix").agg(F.sum("n").alias("n_all"), F.sum("b").alias("b_all"), F.collect_list(F.struct("fold", "n", "b")).alias("f"))
    return folds.select("k", "suffix", "n_all", "b_all", F.explode("f").alias("f")).select("k", "suffix", "f.fold", "n_all", "b_all", (F.col("n_all") - F.col("f.n")).alias("n_out"), (F.col("b_all") - F.col("f.b")).alias("b_out"))


def _fold() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS))


def _with_rates(df: DataFrame, stats: DataFrame, fold: bool) -> DataFrame:
    """Joins the suffix statistics, which grow with the labelled URLs, so by shuffles (or as Spark finds them small) and with common suffixes split by the skew join. In training, a row's own fold is taken out."""
    for k in (1, 2, 3):
        s = stats.filter(F.col("k") == k)
        if fold:
            s = s.select(F.col("suffix").alias(f"suffix_{k}"), "fold", F.col("n_out").alias("n"), F.col("b_out").alias("b"))
            df = df.join(s, [f"suffix_{k}", "fold"], "left")
        else:
            s = s.groupBy(F.col("suffix").alias(f"suffix_{k}")).agg(F.first("n_all").alias("n"), F.first("b_all").alias("b"))
            df = df.join(s, f"suffix_{k}", "left")
        n, b = F.coalesce("n", F.lit(0)), F.coalesce("b", F.lit(0))
        df = df.withColumns({f"rate_{k}": (b + 0.5) / (n + 1.0), f"seen_{k}": F.log1p(n)}).drop("n", "b")
    return df


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", max_labelled: int = 20_000, max_iter: int = 12, max_depth: int = 4, block_at: float = 0.5) -> DataFrame:
    """Every page's host, path, rule, verdict (``allow`` or ``block``) and the trees' score.

    ``labelled`` has (url, blocked 0/1). The trees learn from at most ``max_labelled`` of its distinct URLs,
    those with the smallest hashes; suffix statistics count all of them, and all pages are judged."""
    spark = pages.sparkSession
    known = labelled.groupBy("url").agg(F.max("blocked").alias("blocked"))
    sample = known.orderBy(F.xxhash64("url"), "url").limit(max_labelled)
    rows = [(r["url"], int(r["blocked"])) for r in sample.collect()]  # bounded by max_labelled
    learned = lexical(spark.createDataFrame(rows, "url string, blocked int"), "url").withColumn("fold", _fold()).persist()
    base = lexical(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "url")
    kinds = {b for _, b in rows}
    if len(kinds) < 2:
        scored = base.withColumn("score", F.lit(float(kinds.pop() if kinds else 0)))
    else:
        stats = materialize(suffix_statistics(known), "suffixes")
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
        train = vectors.transform(_with_rates(learned, stats, fold=True).withColumn("label", F.col("blocked").cast("double"))).select("features", "label")
        model = GBTClassifier(maxIter=max_iter, maxDepth=max_depth, maxBins=64, seed=7, cacheNodeIds=False, checkpointInterval=-1).fit(train)
        scored = model.transform(vectors.transform(_with_rates(base, stats, fold=False))).withColumn("score", vector_to_array("probability")[1])
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("score") >= block_at, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), F.col("score"))
