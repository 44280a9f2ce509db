"""Fitted forests as rows: they can be stored, joined to series, served and rescored.

A forest is a table (tree, node, feature, threshold, left, right, value), for
many models with their keys in front. Node 0 of a tree is its root; a leaf has
no feature. Rows walk the trees of their own model inside one expression, so a
table is neither copied for each tree nor sent to Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.cadence import SERIES
from tidewatch.operators.features import LABEL
from tidewatch.operators.ordering import shared_folder
from tidewatch.operators.scoring import error_aggregates

NODE = ("tree", "node", "feature", "threshold", "left", "right", "value")


def forest_rows(model, features: Sequence[str], spark) -> DataFrame:
    """The nodes of a fitted MLlib ensemble, read from what it saves; `value` carries the tree's weight."""
    path = f"{shared_folder(spark)}/forest"
    model.write().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "_about", "_weight").drop("_about")
    nodes = spark.read.parquet(f"{path}/data").toDF("tree", "_node").select("tree", "_node.*")
    names = F.array(*[F.lit(f) for f in features])
    leaf = F.col("leftChild") < 0
    return nodes.join(weights, "tree").select(
        F.col("tree").cast("int").alias("tree"),
        F.col("id").alias("node"),
        F.when(~leaf, F.get(names, F.col("split.featureIndex"))).alias("feature"),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(~leaf, F.col("leftChild")).alias("left"),
        F.when(~leaf, F.col("rightChild")).alias("right"),
        F.when(leaf, F.col("prediction") * F.col("_weight")).alias("value"),
    )


def packed(forest: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each key: `trees` (arrays of nodes, children as places in them) and `needs`, the features asked for.

    A group is one model, whose size its training parameters bound.
    """
    keys = list(keys)
    nodes = F.array_sort(F.collect_list(F.struct(*NODE[1:])))
    trees = forest.groupBy(*keys, "tree").agg(nodes.alias("_nodes"))
    place = lambda child: (F.array_position("_nodes.node", child) - 1).cast("int")
    placed = F.transform("_nodes", lambda n: F.struct(n["feature"].alias("feature"), n["threshold"].alias("threshold"), place(n["left"]).alias("left"), place(n["right"]).alias("right"), n["value"].alias("value")))
    whole = trees.withColumn("_placed", placed).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tree", F.col("_placed").alias("nodes")))).alias("_trees"))
    listed = F.array_distinct(F.flatten(F.transform("_trees", lambda t: F.filter(t["nodes"]["feature"], lambda f: f.isNotNull()))))
    return whole.select(*keys, F.transform("_trees", lambda t: t["nodes"]).alias("trees"), F.array_sort(listed).alias("needs"))


def known_values(columns: Sequence[str]) -> Column:
    """A row's numeric columns by name."""
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("double"))])


def forest_value(trees: Column, known: Column) -> Column:
    """Sum of the leaves a row falls into; `known` maps names to values. At or below a threshold goes left."""

    def leaf_of(nodes: Column) -> Column:
        def down(at: Column, _: Column) -> Column:
            node = F.get(nodes, at)
            lower = F.try_element_at(known, node["feature"]) <= node["threshold"]
            return F.when(node["feature"].isNull(), at).when(lower, node["left"]).otherwise(node["right"])

        # a tree of n nodes has at most (n - 1) / 2 levels below its root
        levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((F.size(nodes) - 1) / 2).cast("int")))
        return F.get(nodes, F.aggregate(levels, F.lit(0), down))["value"]

    return F.aggregate(trees, F.lit(0.0), lambda total, nodes: total + leaf_of(nodes))


def missing_needs(needs: Column, known: Column) -> Column:
    """Whether a row lacks a feature its forest asks for."""
    return F.exists(needs, lambda f: F.try_element_at(known, f).isNull())


def predict_forest(rows: DataFrame, champions: DataFrame, keys: Sequence[str] = (SERIES,), name: str = "predicted") -> DataFrame:
    """Add the prediction of each row's own champion (`packed`); null where a feature is missing or the key has none."""
    numeric = [f.name for f in rows.schema.fields if f.dataType.simpleString() in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    held = known_values(numeric)
    joined = rows.join(champions.select(*keys, "trees", "needs"), list(keys), "left").withColumn("_known", held)
    value = F.when(F.col("trees").isNotNull() & ~missing_needs(F.col("needs"), F.col("_known")), forest_value(F.col("trees"), F.col("_known")))
    return joined.withColumn(name, value).drop("trees", "needs", "_known")


def rescore_champions(rows: DataFrame, champions: DataFrame, keys: Sequence[str] = (SERIES,), label: str = LABEL) -> DataFrame:
    """Error of each key's stored champion on a given test window; null when a feature it needs no longer exists."""
    scored = predict_forest(rows, champions, keys)
    return scored.groupBy(*keys).agg(F.round(error_aggregates(F.col(label), F.col("predicted"))[0], 4).alias("champion_mae_same_window"), F.count("predicted").alias("rows_scored"))
