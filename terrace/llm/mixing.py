"""Mixing sources to target weights through a domain - language - source tree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm._common import cut, discard

LEVELS = ("domain", "lang", "source")
#: Leaves up to which the plan is sent to every executor; beyond, it is joined.
BROADCAST_LEAVES = 20_000
#: Documents that a bucket of a leaf's order holds, about.
BUCKET_ROWS = 1_000
_WIDE = "decimal(38,0)"


def n_words(text: Column) -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _one_of(column: Column, values: Mapping[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, value in values.items():
        out = F.when(column == name, value).otherwise(out)
    return out.cast("long")


def domain_of(source: Column, domains: Mapping[str, tuple[str, ...]]) -> Column:
    out = F.lit("other")
    for name, sources in domains.items():
        out = F.when(source.isin(*sources), name).otherwise(out)
    return out


def _fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divide each parent's `given` among its children by weight, none beyond its `cap`: what a full child can't take goes to its siblings.

    children: parent's columns, `given`, name, `weight`, `cap`. Full are those first in the order of cap per weight for which
    cap * (weights from here on) <= weight * (what is left); the others share what the full ones leave. Integers, rounded down.
    """
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(0.0)
    order = Window.partitionBy(*parent).orderBy(ratio, name)
    ahead, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    so_far, all_of = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*parent)
    left = F.col("given") - F.coalesce(F.sum("cap").over(ahead), F.lit(0))
    full = (F.col("cap").cast(_WIDE) * F.sum("weight").over(behind) <= F.col("weight").cast(_WIDE) * left).cast("int")
    out = children.withColumn("full", full).withColumn("full", F.min("full").over(so_far))
    out = out.withColumn("left", F.col("given") - F.sum(F.when(F.col("full") == 1, F.col("cap")).otherwise(0)).over(all_of))
    out = out.withColumn("open", F.sum(F.when(F.col("full") == 0, F.col("weight")).otherwise(0)).over(all_of))
    share = F.expr(f"cast(weight as {_WIDE}) * left div nullif(open, 0)").cast("long")
    return out.withColumn("given", F.when(F.col("full") == 1, F.col("cap")).otherwise(F.coalesce(share, F.lit(0)))).drop("full", "left", "open")


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], share_percent: int, max_epochs: int) -> DataFrame:
    """Each leaf (domain, lang, source, tokens, docs) with `given`: its tokens of the budget.

    The budget, share_percent of all tokens, goes down the tree by weights. A subtree takes at most what its leaves hold, each
    counted max_epochs times; so a shortage goes to siblings first, and to the parent's siblings only once those are full.
    """
    w = lambda level: _one_of(F.col(level), weights.get(level, {}), 1)
    # a leaf under a weight of zero holds nothing to give
    live = F.least(*(F.least(w(level), F.lit(1)) for level in LEVELS))
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs * live)
    total = leaves.agg((F.floor(F.sum("tokens") * share_percent / 100)).cast("long").alias("t"), F.sum("cap").alias("c"))
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(total.select(F.least("t", "c").alias("given")))).withColumn("weight", w("domain"))
    top = _fill(top.withColumn("root", F.lit(0)), ["root"], "domain").select("domain", "given")
    mid = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(top, "domain").withColumn("weight", w("lang"))
    mid = _fill(mid, ["domain"], "lang").select("domain", "lang", "given")
    return _fill(leaves.join(mid, ["domain", "lang"]).withColumn("weight", w("source")), ["domain", "lang"], "source")


def mix(docs: DataFrame, domains: Mapping[str, tuple[str, ...]], weights: Mapping[str, Mapping[str, int]], share_percent: int = 60, max_epochs: int = 4, seed: int = 7) -> DataFrame:
    """docs' rows, each as often as the mixture takes it, with _domain, _tokens and _epoch (from 0) after its own columns.

    Tokens are words. A leaf with `given` tokens of the budget is taken whole given // tokens times; of its next epoch, ordered by
    md5 of 'seed:epoch:doc_id', the prefix of documents that begin before the rest is used up. Every document's place follows from
    its leaf's totals and one cut-off value, found by buckets of about BUCKET_ROWS documents, so a leaf with most of the rows is
    never sorted whole, and texts are not shuffled. A null lang or source counts as 'und' or 'unknown'; null texts have no tokens.
    Rows that repeat a doc_id share its place, as do rows with a null one. Texts may be long; their words are counted in place. An own column named _domain, _tokens or
    _epoch gives way to the new one. Leaves without tokens, or under a weight of 0, give no rows; nor does an empty table.
    Weights not named are 1.
    """
    spark = docs.sparkSession
    docs = docs.drop("_domain", "_tokens", "_epoch")
    lang, source = F.coalesce(F.col("lang"), F.lit("und")), F.coalesce(F.col("source"), F.lit("unknown"))
    leaf_columns = {"_domain": domain_of(source, domains), "_lang": lang, "_source": source}
    light = docs.select("doc_id", leaf_columns["_domain"].alias("domain"), lang.alias("lang"), source.alias("source"), n_words(F.col("text")).alias("tokens"))
    light, at = cut(light, "light")
    leaves = light.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = budgets(leaves, weights, share_percent, max_epochs).where("given > 0").select(*LEVELS, "tokens", F.expr("given div tokens").alias("epochs"), F.expr("given % tokens").alias("rest"), F.greatest(F.lit(1), F.least(F.lit(65536), F.expr(f"docs div {BUCKET_ROWS}"))).alias("buckets"))
    plan, plan_at = cut(plan.withColumnRenamed("tokens", "held"), "plan")
    few = plan.count() <= BROADCAST_LEAVES
    sent = F.broadcast if few else (lambda x: x)
    key = lambda: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("doc_id").cast("string")).cast("binary"))
    placed = light.join(sent(plan), list(LEVELS)).withColumn("key", key())
    placed = placed.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * F.col("buckets") / 65536).cast("int"))
    sums = placed.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    up = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("before", F.sum("tokens").over(up) - F.col("tokens"))
    edge, edge_at = cut(sums.where("rest > before").groupBy(*LEVELS).agg(F.max(F.struct("bucket", "before")).alias("e")).select(*LEVELS, "e.bucket", "e.before"), "edge")
    inside = placed.join(sent(edge), [*LEVELS, "bucket"]).groupBy(*LEVELS, "key").agg(F.sum("tokens").alias("tokens"), F.first(F.col("rest") - F.col("before")).alias("rest"))
    up = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("before", F.sum("tokens").over(up) - F.col("tokens")).where("before < rest").groupBy(*LEVELS).agg(F.max("key").alias("cutoff"))
    full, full_at = cut(plan.join(last, list(LEVELS), "left").select(F.col("domain").alias("_domain"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), "epochs", "cutoff"), "plan")
    discard(spark, at, plan_at, edge_at)
    # the rows' own columns travel in one, so that none clashes with the plan's
    own = docs.select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), *(v.alias(k) for k, v in leaf_columns.items()))
    taken = own.join(sent(full), ["_domain", "_lang", "_source"])
    copies = (F.col("epochs") + F.when(key() <= F.col("cutoff"), 1).otherwise(0)).cast("int")
    taken = taken.withColumn("copies", copies).where("copies > 0")
    field = F.col("own").getField
    return taken.select(*(field(c).alias(c) for c in docs.columns), "_domain", n_words(field("text")).alias("_tokens"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("_epoch"))


#: What the registered query and the pipeline use.
DOMAINS = {
    "web": tuple(f"src{k}" for k in range(8)),
    "books": tuple(f"src{k}" for k in range(8, 12)),
    "code": tuple(f"src{k}" for k in range(12, 15)),
    "wiki": tuple(f"src{k}" for k in range(15, 18)),
}
WEIGHTS = {"domain": {"web": 4, "books": 3, "code": 1, "wiki": 2}, "lang": {"en": 6, "de": 2, "fr": 2}}
SHARE_PERCENT, MAX_EPOCHS, SEED = 60, 4, 7


def oracle() -> str:
    """DuckDB SQL of the registered query: the same tree in plain windows over every document."""
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    domain = "CASE " + " ".join(f"WHEN coalesce(source, 'unknown') IN ({quoted(s)}) THEN '{d}'" for d, s in DOMAINS.items()) + " ELSE 'other' END"
    weight = lambda level: (f"CAST(CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END AS HUGEINT)") if level in WEIGHTS else "CAST(1 AS HUGEINT)"

    def fill(new: str, rows: str, parent: str, name: str) -> str:
        part = f"PARTITION BY {parent}"
        order = f"{part} ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {name}"
        return f"""
{new}1 AS (SELECT *, CASE WHEN cap * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (given - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) THEN 1 ELSE 0 END AS f FROM {rows}),
{new}2 AS (SELECT *, min(f) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sat FROM {new}1),
{new}3 AS (SELECT *, CAST(given AS HUGEINT) - CAST(sum(CASE WHEN sat = 1 THEN cap ELSE 0 END) OVER ({part}) AS HUGEINT) AS rem, CAST(sum(CASE WHEN sat = 0 THEN weight ELSE 0 END) OVER ({part}) AS HUGEINT) AS op FROM {new}2),
{new} AS (SELECT * EXCLUDE (given), CASE WHEN sat = 1 THEN cap ELSE coalesce((weight * rem) // nullif(op, 0), 0) END AS given FROM {new}3)"""

    return f"""WITH each AS (SELECT doc_id, {domain} AS domain, coalesce(lang, 'und') AS lang, coalesce(source, 'unknown') AS source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens, CAST(sum(tokens) * {MAX_EPOCHS} AS HUGEINT) AS cap FROM each GROUP BY ALL),
total AS (SELECT least(CAST(floor(sum(tokens) * {SHARE_PERCENT} / 100) AS HUGEINT), CAST(sum(cap) AS HUGEINT)) AS given FROM leaves),
a0 AS (SELECT domain, CAST(sum(cap) AS HUGEINT) AS cap, {weight("domain")} AS weight, 0 AS root, any_value(t.given) AS given FROM leaves, total t GROUP BY domain),
{fill("a", "a0", "root", "domain")},
b0 AS (SELECT l.domain, l.lang, CAST(sum(l.cap) AS HUGEINT) AS cap, {weight("lang").replace("CASE lang", "CASE l.lang")} AS weight, any_value(a.given) AS given FROM leaves l JOIN a USING (domain) GROUP BY l.domain, l.lang),
{fill("b", "b0", "domain", "lang")},
c0 AS (SELECT l.*, {weight("source")} AS weight, b.given FROM leaves l JOIN b USING (domain, lang)),
{fill("c", "c0", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, CAST(given // tokens AS BIGINT) AS epochs, CAST(given % tokens AS BIGINT) AS rest FROM c WHERE given > 0),
keyed AS (SELECT e.*, p.epochs, p.rest, md5('{SEED}:' || p.epochs || ':' || e.doc_id) AS k FROM each e JOIN plan p USING (domain, lang, source)),
placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed),
copies AS (SELECT *, epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS n FROM placed)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS n_tokens, CAST(unnest(range(n)) AS INTEGER) AS epoch FROM copies WHERE n > 0"""
