"""Splits, samplers and leakage checks (survey K). Order comes from md5, so a split is the same on every run and engine."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import exact_quantile


def digest(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in columns)))


def part(n: Column, share: float) -> Column:
    """floor(n share), the share taken as the decimal number it is written as: 0.7 of 90,000 is 63,000."""
    return F.floor(n * F.lit(Decimal(str(share)))).cast("long")


def placed(df: DataFrame, keys: list[str], by: Column, tie: str) -> DataFrame:
    """df with __place (from 0) in the order of the digest `by` within keys, and __n, the rows of the keys.

    No key is sorted in one task: rows are counted by the digest's first three hex digits (4096 buckets), and ranked within theirs.
    """
    d = df.withColumn("__h", by).withColumn("__b", F.substring("__h", 1, 3))
    n = d.groupBy(*keys, "__b").agg(F.count("*").alias("__m"))
    w = Window.partitionBy(*keys)
    before = n.select(*keys, "__b", (F.sum("__m").over(w.orderBy("__b")) - F.col("__m")).alias("__before"), F.sum("__m").over(w).alias("__n"))  # at most 4096 rows a key
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__h", tie)))
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("d.__b") == F.col("b.__b")]
    out = d.alias("d").join(before.alias("b"), on)
    return out.select("d.*", (F.col("b.__before") + F.col("d.__r") - 1).alias("__place"), F.col("b.__n").alias("__n")).drop("__h", "__b", "__r")


def random_split(df: DataFrame, key: str = "sample", seed: int = 42, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """K1: exact sizes floor(n train), floor(n validation), rest test.

    The place in digest order is found without a global sort in one task: rows are counted by the digest's first three hex
    digits (4096 buckets), and ranked within theirs.
    """
    d = df.withColumn("__h", digest(seed, key)).withColumn("__b", F.substring("__h", 1, 3))
    n = d.groupBy("__b").agg(F.count("*").alias("__n"))
    before = n.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))  # 4096 rows
    total = n.agg(F.sum("__n").alias("__total"))
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))).join(F.broadcast(before), "__b").crossJoin(F.broadcast(total))
    place = F.col("__before") + F.col("__r") - 1
    a, b = part(F.col("__total"), train), part(F.col("__total"), validation)
    return d.withColumn("split", F.when(place < a, "train").when(place < a + b, "validation").otherwise("test")).select(*df.columns, "split")


def group_split(df: DataFrame, group: str, seed: int = 42, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """K2: whole groups are held out, by the number of groups; a null group is `unknown`."""
    g = df.select(F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("__g")).distinct()
    g = random_split(g, "__g", seed, train, validation)
    return df.withColumn("__g", F.coalesce(F.col(group).cast("string"), F.lit("unknown"))).join(g, "__g").drop("__g")


def leave_one_out(df: DataFrame, domain: str = "domain", seed: int = 42, share: float = 0.8) -> DataFrame:
    """K3: a fold for each domain, which is its test; of the rest max(1, floor(k share)) rows by digest train, the others validate."""
    folds = df.select(F.col(domain).alias("fold")).distinct()
    x = df.crossJoin(F.broadcast(folds))  # a row for each domain on the right
    x = placed(x.withColumn("__test", F.coalesce(F.col(domain) == F.col("fold"), F.lit(False))), ["fold", "__test"], digest(seed, "sample"), "sample")
    split = F.when(F.col("__test"), "test").when(F.col("__place") < F.greatest(F.lit(1), part(F.col("__n"), share)), "train").otherwise("validation")
    return x.withColumn("split", split).drop("__test", "__place", "__n")


def leakage(df: DataFrame, group: str = "subject") -> DataFrame:
    """K4: groups that are in more than one split."""
    return df.groupBy(group).agg(F.array_sort(F.collect_set("split")).alias("splits")).where("size(splits) > 1")  # three splits at most


def balanced_order(df: DataFrame, domain: str = "domain", batch: int = 32, seed: int = 42) -> DataFrame:
    """K5: the round of each sample in its domain; a batch takes the domains' samples round by round."""
    return placed(df, [domain], digest(seed, "sample"), "sample").withColumn("round", F.col("__place") + 1).drop("__place", "__n")


def domain_weights(df: DataFrame, domain: str = "domain", root: bool = False) -> DataFrame:
    """K6: total / (domains * count) or sqrt(total / count) by domain."""
    n = df.groupBy(domain).agg(F.count("*").alias("n"))
    t = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    x = n.crossJoin(F.broadcast(t))  # one row on the right
    return x.select(domain, (F.sqrt(F.col("total") / F.col("n")) if root else F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def group_dro(df: DataFrame, domain: str = "domain", loss: str = "loss", eta: float = 0.01) -> DataFrame:
    """K7: weights exp(eta loss) / sum by domain after one step from even weights, and the weighted loss."""
    g = df.groupBy(domain).agg(F.avg(loss).alias("loss"))
    w = Window.partitionBy(F.lit(1))  # a row for each domain
    e = F.exp(eta * F.col("loss"))
    return g.withColumn("weight", e / F.sum(e).over(w)).withColumn("weighted", F.sum(F.col("weight") * F.col("loss")).over(w))


def chance(*text: Column | str) -> Column:
    """A number in (0, 1) from md5 of the texts joined by /."""
    return (F.conv(F.substring(F.md5(F.concat_ws("/", *(F.lit(t) if isinstance(t, str) else t.cast("string") for t in text))), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def weighted_sample(df: DataFrame, weights: DataFrame, n: int, domain: str = "domain", seed: int = 42) -> DataFrame:
    """K6: n rows of df (sample, domain, ...) drawn without replacement, each with its domain's weight (domain, weight > 0): the n
    smallest of the exponential keys -ln(u) / weight, u from md5(seed/sample).

    The n-th key is found by narrowing bounds (metrics.exact_quantile), so neither a sort nor the draw is in one task. Rows
    of one sample have one key: they are drawn together or not at all, and may make it some more or fewer than n.
    """
    keyed = df.join(weights, domain).withColumn("key", -F.log(chance(str(seed), F.col("sample"))) / F.col("weight"))
    rows = keyed.count()
    if n >= rows:
        return keyed
    last = exact_quantile(keyed, [], "key", max(0.0, (n - 0.5) / (rows - 1))).first()
    return keyed.where(F.col("key") <= last["quantile"]) if n > 0 else keyed.limit(0)


def weighted_draws(df: DataFrame, weights: DataFrame, n: int, domain: str = "domain", seed: int = 42) -> DataFrame:
    """K6: (draw, domain, sample) of n draws with replacement, a sample's chance in proportion to its domain's weight (domain, weight).

    A draw's first hash falls into a domain's share (its weight times its rows), its second one picks the place in the
    domain's order of digests. weights has a row for each domain.
    """
    counted = df.groupBy(domain).agg(F.count("*").alias("m")).join(weights, domain)
    w = Window.orderBy(domain)  # a row for each domain
    shares = counted.withColumn("share", F.col("weight") * F.col("m")).withColumn("upto", F.sum("share").over(w)).withColumn("all", F.sum("share").over(Window.partitionBy(F.lit(1))))
    table = shares.agg(F.array_sort(F.collect_list(F.struct("upto", domain, "m", "all"))).alias("table"))  # a row for each domain
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"))
    draws = draws.crossJoin(F.broadcast(table))  # one row on the right
    at = chance(str(seed), F.col("draw"), "d")
    picked = F.filter("table", lambda t: t["upto"] > at * t["all"])[0]
    draws = draws.select("draw", picked.alias("t")).select("draw", F.col(f"t.{domain}").alias(domain), F.floor(chance(str(seed), F.col("draw"), "s") * F.col("t.m")).alias("__place"))
    there = placed(df.select(domain, "sample"), [domain], digest(seed, "sample"), "sample")
    return draws.join(there, [domain, "__place"]).select("draw", domain, "sample")


def dro_rounds(losses: DataFrame, domain: str = "domain", eta: float = 0.01) -> DataFrame:
    """K7: (round, domain, loss, weight, weighted): weights after each round of losses (round, domain, loss), from even ones.

    A round multiplies weights by exp(eta loss) and scales them to 1, so weights after a round come from the sum of all
    losses until it; a domain without a loss in a round has 0 there. weighted is the round's loss under the weights before it.
    """
    rounds, names = losses.select("round").distinct(), losses.select(domain).distinct()
    grid = rounds.join(F.broadcast(names), F.lit(True)).join(losses, ["round", domain], "left").withColumn("loss", F.coalesce("loss", F.lit(0.0)))  # rounds times domains
    until = Window.partitionBy(domain).orderBy("round")
    x = grid.withColumn("sum", F.sum("loss").over(until))
    w = Window.partitionBy("round")
    for name, total in (("weight", F.col("sum")), ("was", F.col("sum") - F.col("loss"))):
        x = x.withColumn("__t", eta * total).withColumn("__e", F.exp(F.col("__t") - F.max("__t").over(w))).withColumn(name, F.col("__e") / F.sum("__e").over(w))
    return x.withColumn("weighted", F.sum(F.col("was") * F.col("loss")).over(w)).select("round", domain, "loss", "weight", "weighted")


def validated(df: DataFrame, known: DataFrame, key: str = "sample", group: str = "subject") -> DataFrame:
    """K4: one row of counts for a split df (sample, subject, split) of known (sample): samples in several splits, samples of known
    that have no split, samples that known doesn't have, and subjects of train that are in validation or test, or of both of these."""
    where = df.groupBy(key).agg(F.count_distinct("split").alias("n"))
    groups = df.groupBy(group).agg(*(F.max(F.when(F.col("split") == s, 1).otherwise(0)).alias(s) for s in ("train", "validation", "test")))
    a = where.agg(F.count_if(F.col("n") > 1).alias("overlapping"))
    b = known.select(key).distinct().join(df.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("missing"))
    c = df.select(key).distinct().join(known.select(key), key, "left_anti").agg(F.count("*").alias("unknown"))
    both = lambda x, y: F.count_if((F.col(x) == 1) & (F.col(y) == 1))
    d = groups.agg(both("train", "validation").alias("train_validation"), both("train", "test").alias("train_test"), both("validation", "test").alias("validation_test"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each


def split_hash(df: DataFrame, kind: str, domain: str, seed: int, key: str = "sample") -> DataFrame:
    """K4: (hash): 16 hex digits of md5 over the kind, the domain's name, the seed, the splits' sizes and the ten smallest samples of train and test."""
    size = lambda s: F.count_if(F.col("split") == s)
    sizes = df.agg(*(size(s).alias(s) for s in ("train", "validation", "test")))
    least = {s: df.where(F.col("split") == s).select(key).orderBy(key).limit(10).agg(F.sort_array(F.collect_list(key)).alias(f"{s}_least")) for s in ("train", "test")}
    one = sizes.crossJoin(least["train"]).crossJoin(least["test"])  # one row each
    shown = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: v.cast("string")), ", "), F.lit("]"))
    return one.select(F.substring(F.md5(F.concat_ws("|", F.lit(kind), F.lit(domain), F.lit(str(seed)), *(F.col(s).cast("string") for s in ("train", "validation", "test")), shown("train_least"), shown("test_least"))), 1, 16).alias("hash"))


def sliding(df: DataFrame, values: str, length: int, stride: int) -> DataFrame:
    """K9: windows of an array column, by their start; arrays shorter than the length give none."""
    n = F.size(values)
    return df.where(n >= length).withColumn("start", F.explode(F.sequence(F.lit(0), n - length, F.lit(stride)))).withColumn("window", F.slice(values, F.col("start") + 1, length))


#: K8: splits by name.
METHODS = {
    "random": random_split,
    "subject_held_out": lambda df, **more: group_split(df, "subject", **more),
    "domain_held_out": lambda df, **more: group_split(df, "domain", **more),
    "leave_one_domain_out": leave_one_out,
}


def split(df: DataFrame, method: str = "random", **more) -> DataFrame:
    """K8: df with a column `split`, by the method's name; unknown names raise KeyError."""
    return METHODS[method.lower()](df, **more)
