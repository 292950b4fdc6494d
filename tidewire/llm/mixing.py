"""Mixing sources to target weights by hierarchical budgets (operator 6). DataFrame functions only.

Leaves are (domain, lang, source). A budget of tokens goes down the tree: at each node it is split among the
children by their weights, but no child gets more than its subtree can supply (its documents' tokens, `max_epochs`
times); what a child can't take goes to its siblings by their weights, and only what all of them can't
take is missing at the node above, where the node's own siblings have had it offered before. A leaf's budget is
that many whole epochs of its documents and a prefix of the next: documents in the order of a hash of seed, epoch and
doc_id, as long as their tokens fit.

The order is never sorted for a whole leaf: tokens are summed by leaf and by 256 ranges of the hash, then by 256 ranges within
the one range of each leaf in which its budget ends, and so on, until such ranges hold few enough rows to be looked at one by
one. A leaf comes down to one bound on the hash, and every document decides by it alone, so a source with a third of all rows
is no special case, and no task gets more of it for its being larger.

Tokens are the runs of anything but white space, or what the caller gives; a column n_tokens of the input is taken where `tokens` names it.

Defined results: a null lang or source is a leaf of its own (an empty name); a null or empty text has 0 tokens and
comes with its leaf's prefix if its place in the order is within it; a null doc_id is ordered as an empty one; rows that share a doc_id in a
leaf have one place in the order and are taken together or not; nodes of weight 0 or less get nothing; an empty
table gives no rows. Columns of the input are passed on; domain, n_tokens and epoch replace ones of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEVELS = ("domain", "lang", "source")
#: Leaves up to which the table of budgets is broadcast; beyond it, it is joined like any table.
FEW_LEAVES = 20_000


def domain_of(source: str = "source") -> Column:
    """The domain that a source belongs to in this corpus: by its last character, one of four."""
    return F.concat(F.lit("d"), (F.ascii(F.substring(F.coalesce(F.col(source), F.lit("")), -1, 1)) % 4).cast("string"))


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds given to (parent columns, name, w, cap, budget): min(cap, w * level) with the level at which a parent's children use its budget up."""
    among = Window.partitionBy(*parent)
    order = among.orderBy("ratio", name)
    nodes = nodes.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(0.0)))
    nodes = nodes.withColumn("pos", F.row_number().over(order))
    nodes = nodes.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nodes = nodes.withColumn("left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    nodes = nodes.withColumn("at", F.when(F.col("left") > 0, (F.col("budget") - F.col("before")) / F.col("left")))
    nodes = nodes.withColumn("open", F.min(F.when(F.col("at") < F.col("ratio"), F.col("pos"))).over(among))
    nodes = nodes.withColumn("height", F.max(F.when(F.col("pos") == F.col("open"), F.col("at"))).over(among))
    given = F.when(F.col("open").isNull() | (F.col("pos") < F.col("open")), F.col("cap")).otherwise(F.floor(F.col("height") * F.col("w")))
    return nodes.withColumn("given", F.greatest(F.lit(0), given).cast("long")).drop("ratio", "pos", "before", "left", "at", "open", "height")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], total: int | None, share: float, max_epochs: int) -> DataFrame:
    """(domain, lang, source, supply) to (domain, lang, source, supply, budget)."""
    tree = leaves
    for level in LEVELS:
        tree = tree.withColumn(f"w_{level}", _weight(level, weights))
    alive = (F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0)
    tree = tree.withColumn("cap", F.when(alive, F.col("supply") * max_epochs).otherwise(0).cast("long"))
    whole = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("s")).first().s  # one number
    budget = total if total is not None else int(whole * share)
    given = F.lit(budget).cast("long")
    found = None
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        nodes = tree.groupBy(*parent, level).agg(F.max(f"w_{level}").alias("w"), F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("root", F.lit(0)).withColumn("budget", given) if found is None else nodes.join(found.select(*parent, F.col("given").alias("budget")), parent)
        found = fill(nodes, parent or ["root"], level)
    return leaves.join(found.select(*LEVELS, F.col("given").alias("budget")), list(LEVELS))


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document stands in its leaf's order for an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _small(of_leaf: DataFrame) -> DataFrame:
    return F.broadcast(of_leaf) if of_leaf.count() <= FEW_LEAVES else of_leaf


def plan(slim: DataFrame, weights: dict[str, dict[str, float]], total: int | None = None, share: float = 0.8, max_epochs: int = 3, seed: int = 1, few: int = 1024) -> DataFrame:
    """For (domain, lang, source, doc_id, n_tokens): a row for each leaf with budget, whole (epochs) and bound (the last place taken in the next).

    few: a range of so many rows at most is looked at row by row.
    """
    keys = list(LEVELS)
    leaves = common.written(slim.groupBy(*keys).agg(F.sum("n_tokens").alias("supply")), "leaves")
    of_leaf = budgets(leaves, weights, total, share, max_epochs)
    of_leaf = of_leaf.withColumn("whole", F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(0).cast("int"))
    of_leaf = common.written(of_leaf.withColumn("left", F.col("budget") - F.col("whole") * F.col("supply")), "budgets")
    placed = slim.join(_small(of_leaf.select(*keys, "whole")), keys).select(*keys, "n_tokens", place(seed, F.col("whole") + 1, F.col("doc_id")).alias("place"))
    # of each leaf: the range in which its budget ends, and what is left of it there
    ends, taken = of_leaf.select(*keys, F.lit("").alias("range"), "left"), []
    for digits in range(2, 33, 2):
        inner = placed.join(_small(ends), keys).where(F.startswith("place", "range")).withColumn("range", F.substring("place", 1, digits))
        sums = inner.groupBy(*keys, "range").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"), F.max("place").alias("last"), F.max("left").alias("left"))
        until = F.sum("n").over(Window.partitionBy(*keys).orderBy("range"))  # 256 ranges of a leaf
        sums = common.written(sums.withColumn("until", until), "ranges")
        taken.append(sums.where("until <= left").groupBy(*keys).agg(F.max("last").alias("bound")))
        # rows of one place are taken together or, as here, not
        ends = sums.where("until > left and until - n <= left and first < last").select(*keys, "range", (F.col("left") - F.col("until") + F.col("n")).alias("left"), "rows")
        if ends.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0] <= few:  # one number
            break
    inner = placed.join(_small(ends), keys).where(F.startswith("place", "range"))
    so_far = F.sum("n_tokens").over(Window.partitionBy(*keys).orderBy("place"))  # equal places are one step
    taken.append(inner.withColumn("so_far", so_far).where("so_far <= left").groupBy(*keys).agg(F.max("place").alias("bound")))
    bounds = taken[0]
    for t in taken[1:]:
        bounds = bounds.unionByName(t)
    bounds = bounds.groupBy(*keys).agg(F.max("bound").alias("bound"))
    return of_leaf.join(bounds, keys, "left").select(*keys, "supply", "budget", "whole", "bound")


def mix(docs: DataFrame, weights: dict[str, dict[str, float]] | None = None, *, domain: Column | None = None, tokens: Column | None = None, total: int | None = None, share: float = 0.8, max_epochs: int = 3, seed: int = 1) -> DataFrame:
    """Documents in the mixture, a row for each epoch that takes them: epoch counts from 1. tokens: the tokens of a document (null: 0), by default its words."""
    marked = docs.withColumn("_n", F.coalesce(tokens.cast("long"), F.lit(0).cast("long")) if tokens is not None else words()).withColumn("_domain", domain if domain is not None else domain_of())
    marked = marked.withColumn("_lang", F.coalesce("lang", F.lit(""))).withColumn("_source", F.coalesce("source", F.lit("")))
    marked = common.extra_columns(marked, "domain", "n_tokens", "epoch").withColumnsRenamed({"_domain": "domain", "_n": "n_tokens"})
    slim = common.written(marked.select("doc_id", "domain", F.col("_lang").alias("lang"), F.col("_source").alias("source"), "n_tokens"), "slim")
    leaf = common.written(plan(slim, weights or {}, total, share, max_epochs, seed), "plan").select("domain", F.col("lang").alias("_lang"), F.col("source").alias("_source"), "whole", "bound").withColumnRenamed("whole", "_whole").withColumnRenamed("bound", "_bound")
    met = marked.join(_small(leaf), ["domain", "_lang", "_source"])
    times = F.col("_whole") + F.coalesce((place(seed, F.col("_whole") + 1, F.col("doc_id")) <= F.col("_bound")).cast("int"), F.lit(0))
    taken = met.withColumn("_times", times).where("_times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return taken.select(*[c for c in docs.columns if c not in ("domain", "n_tokens", "epoch")], "domain", "n_tokens", "epoch")


WEIGHTS = {"domain": {"d0": 3, "d1": 2}, "lang": {"en": 4, "es": 2}}


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    # texts are read once: what the mixture needs of them is their length
    docs = common.written(common.documents(spark, sf_dir).select("doc_id", "lang", "source", words().alias("n_tokens")), "lengths")
    return mix(docs, WEIGHTS, tokens=F.col("n_tokens")).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _fill_sql(name: str, src: str, parent: str, level: str) -> str:
    return f"""
{name}_a AS (SELECT *, CASE WHEN w > 0 THEN cap / w ELSE 0.0 END AS ratio FROM {src}),
{name}_b AS (SELECT *, row_number() OVER o AS pos, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
  sum(w) OVER (PARTITION BY {parent} ORDER BY ratio, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft FROM {name}_a WINDOW o AS (PARTITION BY {parent} ORDER BY ratio, {level})),
{name}_c AS (SELECT *, CASE WHEN lft > 0 THEN CAST(budget - bef AS DOUBLE) / lft END AS att FROM {name}_b),
{name}_d AS (SELECT *, min(CASE WHEN att < ratio THEN pos END) OVER (PARTITION BY {parent}) AS opn FROM {name}_c),
{name}_e AS (SELECT *, max(CASE WHEN pos = opn THEN att END) OVER (PARTITION BY {parent}) AS height FROM {name}_d),
{name} AS (SELECT *, CAST(greatest(0, CASE WHEN opn IS NULL OR pos < opn THEN cap ELSE floor(height * w) END) AS BIGINT) AS given FROM {name}_e)"""


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, lang AS lang0, source AS source0,
  'd' || CAST(CASE WHEN coalesce(source, '') = '' THEN 0 ELSE ascii(right(source, 1)) % 4 END AS VARCHAR) AS domain,
  CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f]+')), 0) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM d GROUP BY ALL),
tree AS (SELECT *, CASE domain WHEN 'd0' THEN 3.0 WHEN 'd1' THEN 2.0 ELSE 1.0 END::DOUBLE AS w1, CASE lang WHEN 'en' THEN 4.0 WHEN 'es' THEN 2.0 ELSE 1.0 END::DOUBLE AS w2, 1.0::DOUBLE AS w3, supply * 3 AS cap0 FROM leaves),
n1 AS (SELECT 0 AS root, domain, max(w1) AS w, CAST(sum(cap0) AS BIGINT) AS cap, (SELECT CAST(floor(sum(supply) * 0.8::DOUBLE) AS BIGINT) FROM leaves) AS budget FROM tree GROUP BY domain),
{_fill_sql("f1", "n1", "root", "domain")},
n2 AS (SELECT domain, lang, max(w2) AS w, CAST(sum(cap0) AS BIGINT) AS cap, max(f1.given) AS budget FROM tree JOIN f1 USING (domain) GROUP BY domain, lang),
{_fill_sql("f2", "n2", "domain", "lang")},
n3 AS (SELECT tree.domain, tree.lang, source, max(w3) AS w, CAST(sum(cap0) AS BIGINT) AS cap, max(f2.given) AS budget FROM tree JOIN f2 USING (domain, lang) GROUP BY tree.domain, tree.lang, source),
{_fill_sql("f3", "n3", "domain, lang", "source")},
leaf AS (SELECT domain, lang, source, supply, given AS budget, CASE WHEN supply > 0 THEN CAST(floor(given / supply) AS BIGINT) ELSE 0 END AS whole FROM leaves JOIN f3 USING (domain, lang, source)),
p AS (SELECT d.*, whole, budget - whole * supply AS rest, md5('1:' || CAST(whole + 1 AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM d JOIN leaf USING (domain, lang, source)),
q AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS so_far FROM p),
t AS (SELECT *, whole + CASE WHEN so_far <= rest THEN 1 ELSE 0 END AS times FROM q)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, n_tokens, CAST(unnest(generate_series(1, times)) AS INTEGER) AS epoch FROM t WHERE times > 0
"""
