"""URL filter: rules by host and path first, then boosted trees on lexical features of the URL.

Only DataFrame expressions and Spark's own learners are used. URLs under a rule are labelled by it, others are blocked by
a word in the host and else weakly allowed. The trees are fitted on a bounded sample of them; statistics of suffixes are
counted over all URLs. Rates of suffixes leave the rules out: what a rule says of its own hosts is no evidence of others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaforge.session import cut_lineage

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Words in a host that label its URLs for training where no rule does.
BLOCKED_WORDS = "adult|ads|adserver|bet|casino|cheap|escort|loan|pill|pills|porn|sex|spam|track|tracker|viagra|warez|xxx"
FIT_ROWS = 20_000  # labelled URLs that the trees are fitted on, about; and so many weakly allowed ones
WEAK = 0.5  # weight of a URL that is allowed only because nothing speaks against it
SMOOTH = 20.0  # a suffix's rate counts as if so many URLs of the mean rate had been seen too
FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_hyphens", "f_entropy",
    "f_host_entropy", "f_parameters", "f_query_length", "f_longest_label", "f_extension", "f_fragment", "f_secure", "f_ip",
    "f_suffix_rate", "f_site_rate",
]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; both empty for null and without `://`."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as `hostpath`, and its verdict; null where none fits. Rules are a short list."""
    fits = []
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1]), len(r[2])), reverse=True):
        here = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        fits.append((here, F.lit(own + start), F.lit(verdict)))
    none = F.lit(None).cast("string")
    return tuple(reduce(lambda rest, f: F.when(f[0], f[k]).otherwise(rest), reversed(fits), none) for k in (1, 2))


def entropy(text: Column) -> Column:
    """Bits a character."""
    size = F.length(text)
    each = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    # split("") gives every character
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s - F.when(c != "", each(c) * F.log2(each(c))).otherwise(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """`urls` (with `_url`, `_host`, `_path`) and its lexical features, and the suffixes `_suffix` and `_site`.

    Features are of the URL without its suffix: rules go by suffixes, and theirs is no evidence of other URLs.
    """
    path = F.col("_path")
    suffix = F.substring_index("_host", ".", -1)
    host = F.regexp_replace("_host", r"\.[^.]*$", "")
    url = F.concat(F.regexp_extract("_url", r"^[^:]*://", 0), host, F.regexp_extract("_url", r"(?s)^.*?://[^/?#]*(.*)$", 1))
    share = lambda text, pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    real = {
        "f_length": F.length(url), "f_host_length": F.length(host), "f_path_length": F.length(path),
        "f_depth": F.regexp_count(path, F.lit("/[^/]")), "f_labels": F.size(labels), "f_digits": share(url, "[0-9]"),
        "f_host_digits": share(host, "[0-9]"), "f_hyphens": F.regexp_count(host, F.lit("-")), "f_entropy": entropy(url),
        "f_host_entropy": entropy(host), "f_parameters": F.when(query == "", 0).otherwise(1 + F.regexp_count(query, F.lit("&"))),
        "f_query_length": F.length(query), "f_longest_label": F.array_max(F.transform(labels, F.length)),
        "f_extension": F.rlike(path, F.lit(r"\.[A-Za-z0-9]{1,5}$")).cast("int"), "f_fragment": F.contains(url, F.lit("#")).cast("int"),
        "f_secure": F.startswith(url, F.lit("https:")).cast("int"), "f_ip": F.rlike(F.col("_host"), F.lit(r"^[0-9.]+$")).cast("int"),
    }
    out = urls.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in real.items()})
    return out.withColumns({"_suffix": suffix, "_site": F.substring_index("_host", ".", -2)})


def with_statistics(urls: DataFrame) -> DataFrame:
    """For each suffix and site, the share blocked among the URLs that no rule labels.

    A URL does not count in its own rate. Suffixes are many, so their table is written and joined; the
    planner broadcasts it only where it is small.
    """
    free = F.when(F.col("_rule").isNull(), F.col("_label"))
    urls = urls.withColumn("_free", free)
    mean = urls.agg(F.avg("_free")).first()[0]
    mean = 0.5 if mean is None else mean
    for key, name in (("_suffix", "f_suffix"), ("_site", "f_site")):
        sums = urls.groupBy(key).agg(F.coalesce(F.sum("_free"), F.lit(0.0)).alias("_s"), F.count("_free").alias("_m"))
        urls = urls.join(cut_lineage(sums), key)
        own, seen = F.coalesce("_free", F.lit(0.0)), F.col("_free").isNotNull().cast("int")
        rate = (F.col("_s") - own + SMOOTH * mean) / (F.col("_m") - seen + SMOOTH)
        urls = urls.withColumn(f"{name}_rate", rate).drop("_s", "_m")
    return urls


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per page: `page_id`, `host`, `path`, `rule`, `verdict` and `block_chance` (null where a rule decides).

    URLs are labelled by the rules, else blocked by a word in the host, else weakly allowed. Where the sample lacks one
    of the two labels, URLs without a rule are allowed. Null URLs and such without `://` have no host and are judged by
    their features. Repeated rows each get their row. Only `page_id` and `url` are read.
    """
    url = F.coalesce("url", F.lit(""))
    host, path = split_url(url)
    urls = pages.select("page_id", url.alias("_url"), host.alias("_host"), path.alias("_path"))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    urls = urls.withColumns({"_rule": rule, "_verdict": verdict})
    marked = F.rlike(F.col("_host"), F.lit(rf"(^|[.-])({BLOCKED_WORDS})([.-]|$)"))
    strong = F.col("_verdict").isNotNull() | marked
    label = F.when(F.col("_verdict").isNotNull(), (F.col("_verdict") == "block").cast("double")).otherwise(marked.cast("double"))
    urls = urls.withColumns({"_label": label, "_weight": F.when(strong, 1.0).otherwise(WEAK)})
    known = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(with_statistics(lexical(urls)))
    known = cut_lineage(known.select("page_id", "_host", "_path", "_rule", "_verdict", "_label", "_weight", "_url", "_features"))
    counts = known.agg(F.count_if(F.col("_weight") == 1).alias("strong"), F.count_if(F.col("_weight") < 1).alias("weak")).first()
    most = F.when(F.col("_weight") == 1, counts.strong or 1).otherwise(counts.weak or 1)
    drawn = known.where((most <= fit_rows) | (F.pmod(F.xxhash64("_url", "page_id"), most) < fit_rows))
    sample = cut_lineage(drawn.select("_label", "_weight", "_features"))
    if sample.select("_label").distinct().count() < 2:
        scored = known.withColumn("_chance", F.lit(0.0))
    else:
        model = GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=20, maxDepth=4, stepSize=0.2, seed=3).fit(sample)
        scored = model.transform(known).withColumn("_chance", vector_to_array("probability")[1])
    own = F.when(F.col("_chance") >= 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
        F.coalesce("_verdict", own).alias("verdict"), F.when(F.col("_rule").isNull(), F.col("_chance")).alias("block_chance"),
    )
