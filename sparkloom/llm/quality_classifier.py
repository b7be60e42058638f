"""Quality classifier by hierarchical empirical Bayes over sites and paths.

A document's evidence is the calibrated log odds of the n-gram model (see textmodel). Probabilities are summed by
path and by host. The spread of the hosts' means about the global mean, and of the paths' means about their
hosts', give the strengths of two Beta priors; each host is shrunk toward the global rate and each path toward
its host, the more the fewer documents it has. A document's own probability is left out of its path's sum. Its
final log odds are its evidence plus the path's log odds minus the global ones.

Null hosts and paths count as a site without name. Null and empty texts have the evidence of a text without
n-grams. Texts of any length are scored whole. Repeated rows count each time; no order is involved, so there are no
ties but that a document at the threshold itself is kept. Empty tables give empty results. Other columns are carried
along, unless they are named as a new one is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common, textmodel

MIN_PROBABILITY = 0.5
#: A prior is worth at least and at most so many documents.
STRENGTH = (4.0, 1e6)
#: Beyond so many paths the posteriors are joined by a salted shuffle instead of being sent to every task.
BROADCAST_PATHS = 100_000
SALTS = 32


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(mean: Column, total: Column, squares: Column, n: Column, groups: Column, between: Column, sizes: Column) -> Column:
    """Beta prior strength by the method of moments, from group sums over all groups."""
    within = F.greatest(F.lit(0.0), squares - total * total / n) / n
    spread = (between - (groups - 1) * within) / F.greatest(n - sizes / n, F.lit(1e-9))
    strength = mean * (1 - mean) / F.greatest(spread, F.lit(1e-12)) - 1
    return F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), strength))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """(host, path, n, total, host_rate, strength, global_rate) of each path, from rows (host, path, p)."""
    paths = evidence.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares"))
    paths = common.materialize(paths, "site-sums")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("total").alias("ht"), F.sum("squares").alias("hs"))
    world = hosts.agg(F.sum("hn").alias("n"), F.sum("ht").alias("t"), F.sum("hs").alias("s"), F.count("*").cast("double").alias("g"), F.sum(F.col("ht") * F.col("ht") / F.col("hn")).alias("tt"), F.sum(F.col("hn") * F.col("hn")).alias("nn")).first()
    if not world["n"]:
        world = {"n": 1.0, "t": 0.5, "s": 0.25, "g": 1.0, "tt": 0.25, "nn": 1.0}
    mean = min(max(world["t"] / world["n"], 1e-6), 1 - 1e-6)
    w = {k: F.lit(float(world[k])) for k in ("n", "t", "s", "g", "tt", "nn")}
    rate = F.lit(mean)
    hosts_strength = _strength(rate, w["t"], w["s"], w["n"], w["g"], w["tt"] - w["t"] * w["t"] / w["n"], w["nn"])
    hosts = hosts.select("host", ((F.col("ht") + hosts_strength * rate) / (F.col("hn") + hosts_strength)).alias("host_rate"), "hn", "ht", "hs")
    joined = paths.join(hosts, "host")
    # Paths about their own hosts' means, over all hosts.
    inner = joined.agg(F.sum(F.col("total") * F.col("total") / F.col("n")).alias("pp"), F.sum(F.col("n") * F.col("n") / F.col("hn")).alias("nn"), F.count("*").cast("double").alias("g"), F.sum(F.col("total") * F.col("ht") / F.col("hn")).alias("hh")).first()
    if inner["g"]:
        within = max(0.0, world["s"] - inner["pp"]) / world["n"]
        spread = (inner["pp"] - inner["hh"] - max(inner["g"] - world["g"], 0.0) * within) / max(world["n"] - inner["nn"], 1e-9)
        strength = min(max(mean * (1 - mean) / max(spread, 1e-12) - 1, STRENGTH[0]), STRENGTH[1])
    else:
        strength = STRENGTH[1]
    return joined.select("host", "path", "n", "total", "host_rate", F.lit(strength).alias("strength"), F.lit(mean).alias("global_rate"))


def classified(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: str = "text", prefix: str = "", carry_text: bool = True) -> DataFrame:
    """Add evidence (log odds of the text), site (log odds of the path against the global rate), p_good and kept.

    Texts that are carried along are scored twice, where they lie, rather than shuffled or stored with their scores;
    without them (carry_text=False) they are scored once, and the other columns are stored beside the scores.
    """
    model = textmodel.train(docs, labels)
    odds = textmodel.log_odds_udf(model)
    new = [prefix + x for x in ("evidence", "site", "p_good", "kept")]
    names = [c for c in docs.columns if c not in new and (carry_text or c != text)]
    taken = {c.lower() for c in (*docs.columns, *new)}
    mine = {x: common.unused(x, taken) for x in ("host", "path", "n", "total", "host_rate", "strength", "global_rate", "evidence_of", "salt")}
    site = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(mine[x]) for x, c in (("host", host), ("path", path))]
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    e = F.col(mine["evidence_of"])
    rows = docs.select(*names, *site, odds(F.col(text).cast("string")).alias(mine["evidence_of"]))
    if not carry_text:
        rows = common.materialize(rows, "evidence")
    posteriors = common.materialize(site_posteriors(rows.select(F.col(mine["host"]).alias("host"), F.col(mine["path"]).alias("path"), sigmoid(e).alias("p"))), "site-posteriors")
    posteriors = posteriors.select(*(F.col(c).alias(mine[c]) for c in posteriors.columns))
    by = [mine["host"], mine["path"]]
    if posteriors.count() <= BROADCAST_PATHS:
        rows = rows.join(F.broadcast(posteriors), by, "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        rows = rows.withColumn(mine["salt"], F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        rows = rows.join(posteriors.withColumn(mine["salt"], salts), [*by, mine["salt"]], "left")
    own = sigmoid(e)
    of = {k: F.col(v) for k, v in mine.items()}
    rate = (F.greatest(of["total"] - own, F.lit(0.0)) + of["strength"] * of["host_rate"]) / (of["n"] - 1 + of["strength"])
    rate = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), rate))
    lift = _logit(rate) - _logit(of["global_rate"])
    p = sigmoid(e + lift)
    return rows.select(*names, e.alias(new[0]), lift.alias(new[1]), p.alias(new[2]), (p >= MIN_PROBABILITY).alias(new[3]))


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only."""
    taken = {c.lower() for c in docs.columns}
    prefix = "new_"
    while any((prefix + c).lower() in taken for c in ("evidence", "site", "p_good", "kept")):
        prefix = "_" + prefix
    return classified(docs, labels, prefix=prefix).where(F.col(prefix + "kept")).select(*docs.columns)


def op5(spark, sf_dir):
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    out = classified(docs.select("doc_id", "source", "lang", "text"), labels, carry_text=False)
    return out.select("doc_id", "source", "lang", F.round("evidence", 6).alias("evidence"), F.round("site", 6).alias("site_log_odds"), F.round("p_good", 6).alias("p_good"), "kept")
