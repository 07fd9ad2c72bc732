"""Mixing sources to target weights by hierarchical budgeting. DataFrame operations only.

The tree's levels are columns, say domain, language, source. A token budget goes down from the root: the children of a
node share its budget by weight, none beyond what it can give (its tokens times the epochs allowed). What a child
cannot give is shared by its siblings, by weight again, before anything of the shortage reaches the node's own
siblings, as a node is asked for no more than its children together can give. At the leaves, a budget is spent on
whole epochs and then on a prefix of one more, each epoch being the leaf's documents in an order drawn by a seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name, materialise, table

SEED = 11
#: Ranges that the order of an epoch is cut into. A task sorts only the range in which a leaf's prefix ends.
RANGES = 4096
LEVELS = ("domain", "lang", "source")


def tokens(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def domain_of(source: Column) -> Column:
    """Of the synthetic tables, which have no domain: one of four, by the number in the source's name."""
    return F.coalesce(F.concat(F.lit("domain"), (F.regexp_extract(source, r"(\d+)", 1).try_cast("bigint") % 4).cast("string")), F.lit("domain-"))


def node_of(*values: Column) -> Column:
    """The name of a node of the tree: the values down to it joined with '/', a null as the empty-set sign.

    A value's own '/', '%' and empty-set sign are written %2F, %25 and %E2%88%85, so no two nodes have one name.
    """
    plain = lambda v: F.replace(F.replace(F.replace(v.cast("string"), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")), F.lit("∅"), F.lit("%E2%88%85"))
    return F.concat_ws("/", *(F.coalesce(plain(v), F.lit("∅")) for v in values))


def leaves(docs: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """(levels, supply) of each leaf; nulls are a value of their own."""
    return docs.groupBy(*levels).agg(F.sum("_tokens").alias("supply"), F.count("*").alias("rows"))


def budgets(supply: DataFrame, levels: tuple[str, ...], weights: DataFrame, share: float, epochs: float) -> DataFrame:
    """(levels, supply, rows, budget) of each leaf. supply: a row a leaf, so few; weights: (node, weight), see mix()."""
    path = [node_of(*map(F.col, levels[: i + 1])) for i in range(len(levels))]
    tree = supply.select("*", F.lit("").alias("_p0"), *(p.alias(f"_p{i + 1}") for i, p in enumerate(path)))
    tree = tree.withColumn("_give", F.col("supply") * epochs)
    # Budgets of the level above, from the root down. The root's is one number.
    total = supply.agg(F.coalesce(F.sum("supply"), F.lit(0))).first()[0]
    above = None
    for i in range(1, len(levels) + 1):
        nodes = tree.groupBy(F.col(f"_p{i - 1}").alias("_up"), F.col(f"_p{i}").alias("_node")).agg(F.sum("_give").alias("_cap"))
        nodes = nodes.join(weights.groupBy(F.col("node").alias("_node")).agg(F.max("weight").alias("_w")), "_node", "left")
        # A node without a weight counts by what it can give.
        nodes = nodes.withColumn("_w", F.greatest(F.coalesce(F.col("_w").cast("double"), F.col("_cap").cast("double")), F.lit(0.0)))
        nodes = nodes.withColumn("_budget", F.lit(float(total) * min(share, epochs))) if above is None else nodes.join(above, "_up")
        above = _shared(nodes)
    return tree.join(above.select(F.col("_up").alias(f"_p{len(levels)}"), "_budget"), f"_p{len(levels)}").select(*levels, "supply", "rows", F.col("_budget").alias("budget"))


def _shared(nodes: DataFrame) -> DataFrame:
    """(_up, _budget) of nodes (_up their parent, _node, _cap, _w, _budget the parent's).

    The share is min(cap, level * weight), with the level at which a parent's shares add up to its budget. In order of
    cap over weight the first so many are exhausted; at each place the level follows from what is left for the rest.
    Nodes of weight 0 get what the others cannot give, in a second helping by cap.
    """
    order = Window.partitionBy("_up").orderBy(F.col("_ratio").asc(), F.col("_node"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    n = nodes.withColumn("_ratio", F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")))
    n = n.withColumn("_ratio", F.coalesce("_ratio", F.lit(float("inf"))))
    n = n.withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_rest", F.sum("_w").over(after))
    n = n.withColumn("_level", F.when(F.col("_rest") > 0, F.col("_left") / F.col("_rest")))
    n = n.withColumn("_at", F.row_number().over(order))
    n = n.withColumn("_stop", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_at", "_level"))).over(Window.partitionBy("_up"))["_level"])
    n = n.withColumn("_first", F.when(F.col("_w") > 0, F.when(F.col("_stop").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_stop") * F.col("_w")))).otherwise(0.0))
    all_of = Window.partitionBy("_up")
    spare = F.greatest(F.lit(0.0), F.col("_budget") - F.sum("_first").over(all_of))
    idle = F.sum(F.when(F.col("_w") > 0, 0.0).otherwise(F.col("_cap"))).over(all_of)
    second = F.when((F.col("_w") <= 0) & (idle > 0), F.col("_cap") * F.least(F.lit(1.0), spare / idle)).otherwise(0.0)
    return n.select(F.col("_node").alias("_up"), (F.col("_first") + second).alias("_budget"))


def placed(rows: DataFrame, seed: int) -> DataFrame:
    """rows (_whole, doc_id, _text) with _place in the order of their epoch, and the _range of it. Rows without an id go by their text."""
    place = F.xxhash64(F.lit(seed), F.col("_whole"), F.col("doc_id").cast("string"), F.col("_text"))
    return rows.withColumn("_place", place).withColumn("_range", F.shiftrightunsigned("_place", 64 - (RANGES - 1).bit_length()).cast("int"))


def mix(docs: DataFrame, weights: DataFrame, levels: tuple[str, ...] = LEVELS, share: float = 0.5, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """(doc_id, levels, _tokens, epoch): a row for each time that a document is selected, epochs from 0.

    docs: doc_id, text and the levels. weights: (node, weight), the node named as node_of() does; of a node named more than
    once the largest weight counts; siblings' weights are relative, a node without one weighs what it can give. share: the whole
    budget as a part of all tokens; epochs: how often a document may be used at most.

    A leaf's prefix is the longest with at most the budget, up to rounding half a token up; documents without words
    cost nothing and come with the range they fall in. Rows that repeat a doc_id with the same text stand next to
    each other in the order, ties broken by tokens. A null doc_id has a place in the order like any other. An empty
    table gives an empty one. Columns other than these are not read.

    The order of an epoch is that of a hash of seed, epoch, doc_id and text, cut into RANGES, so rows without an id or with
    one id spread over them; sums over (leaf, range) are
    pre-aggregated, so that a leaf with a third of all rows is added up by all tasks, and only the range in which its
    prefix ends is sorted.
    """
    sized = materialise(docs.select("doc_id", *levels, tokens(F.col("text")).alias("_tokens"), F.xxhash64("text").alias("_text")), "mix-tokens")
    plan = materialise(budgets(materialise(leaves(sized, levels), "mix-leaves"), levels, weights, share, epochs), "mix-budgets")
    plan = plan.withColumn("_budget", F.floor(F.col("budget") + 0.5)).withColumn("_whole", F.when(F.col("supply") > 0, F.floor(F.col("_budget") / F.col("supply"))).otherwise(1))
    plan = plan.withColumn("_rest", F.col("_budget") - F.col("_whole") * F.col("supply"))
    small = plan.select(*levels, "_whole", "_rest", F.xxhash64(node_of(*map(F.col, levels))).alias("_leaf"))
    rows = sized.alias("s").join(small.alias("p"), [F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}")) for c in levels]).select("s.*", "_whole", "_rest", "_leaf")
    whole = rows.where("_whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("_whole") - 1).cast("int")))).select("doc_id", *levels, "_tokens", "epoch")
    part = placed(rows.where("_rest > 0"), seed)
    sums = part.groupBy("_leaf", "_range").agg(F.sum("_tokens").alias("_sum"), F.first("_rest").alias("_rest"))
    up_to = F.sum("_sum").over(Window.partitionBy("_leaf").orderBy("_range"))
    sums = sums.withColumn("_end", up_to).withColumn("_start", F.col("_end") - F.col("_sum")).where("_start <= _rest").select("_leaf", "_range", "_start", "_end")
    part = part.join(sums, ["_leaf", "_range"])
    inside = part.where("_end <= _rest").select("doc_id", *levels, "_tokens", F.col("_whole").cast("int").alias("epoch"))
    run = F.sum("_tokens").over(Window.partitionBy("_leaf", "_range").orderBy("_place", "doc_id", "_text", "_tokens").rowsBetween(Window.unboundedPreceding, 0))
    edge = part.where("_end > _rest").withColumn("_upto", F.col("_start") + run).where("_upto <= _rest").select("doc_id", *levels, "_tokens", F.col("_whole").cast("int").alias("epoch"))
    return whole.unionByName(inside).unionByName(edge)


#: Target weights of the synthetic tables' languages, in each domain; domains and sources weigh what they have.
LANG_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}


def default_weights(spark: SparkSession) -> DataFrame:
    rows = [(f"domain{d}/{lang}", w) for d in range(4) for lang, w in LANG_WEIGHTS.items()]
    return spark.sql("select * from values " + ", ".join(f"('{n}', {w}D)" for n, w in rows) + " as t(node, weight)")


def with_domain(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", domain_of(F.col("source")).alias("domain"), "lang", "source")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the documents that a mix of 60 % of all tokens, two epochs at most, selects. See mix()."""
    docs = with_domain(table(spark, sf_dir, "documents"))
    return mix(docs, default_weights(spark), share=0.6, epochs=2.0).withColumnRenamed("_tokens", "n_tokens")


def keep_mixed(docs: DataFrame, share: float, weights: DataFrame | None = None) -> DataFrame:
    """The rows of docs that a mix of one epoch at most selects, all columns as they were.

    A row is told by its doc_id and text together, so rows with a null or repeated doc_id are drawn like any other;
    rows that repeat both go together if any of them is selected.
    """
    weights = default_weights(docs.sparkSession) if weights is None else weights
    key = free_name(docs.columns, "_key")
    marked = docs.withColumn(key, F.sha1(F.concat(F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.lit("no id")), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary")))
    keyed = with_domain(marked.select(F.col(key).alias("doc_id"), "text", "source", "lang"))
    chosen = mix(keyed, weights, share=share, epochs=1.0).select(F.col("doc_id").alias("_chosen")).distinct()
    return marked.join(chosen.hint("merge"), marked[key] == chosen["_chosen"], "left_semi").select(*docs.columns)
