"""A property graph in two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.storage import written


@dataclass(frozen=True)
class PropertyGraph:
    """nodes: id, label, name, path. edges: id, source, target, kind; parallel edges count."""

    nodes: DataFrame
    edges: DataFrame

    def kinds(self, *names: str) -> PropertyGraph:
        """The graph with the edges of these kinds only."""
        return PropertyGraph(self.nodes, self.edges.where(F.col("kind").isin(*names)))

    def pruned(self) -> PropertyGraph:
        """Without Unresolved nodes that no edge names."""
        named = self.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        lonely = self.nodes.where(F.col("label") == schema.UNRESOLVED).join(named, "id", "left_anti").select("id")
        return PropertyGraph(self.nodes.join(lonely, "id", "left_anti"), self.edges)

    def resolved(self) -> PropertyGraph:
        """Without Unresolved nodes and the edges that touch one."""
        gone = self.nodes.where(F.col("label") == schema.UNRESOLVED).select("id")
        edges = self.edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti")
        edges = edges.join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
        return PropertyGraph(self.nodes.where(F.col("label") != schema.UNRESOLVED), edges.select(*self.edges.columns))

    def issues(self) -> DataFrame:
        """Broken rules: edge_id, issue (dangling_source, dangling_target, target_label).

        What edges name is looked up once each; the edges themselves only meet what is broken, which goes to all tasks where it is small.
        """
        sources = self.edges.select(F.col("source").alias("id"), F.lit(None).cast("string").alias("kind"), F.lit(True).alias("is_source"))
        targets = self.edges.select(F.col("target").alias("id"), "kind", F.lit(False).alias("is_source"))
        named = sources.unionByName(targets).distinct()
        looked = named.join(self.nodes.select("id", "label", F.lit(True).alias("there")), "id", "left")
        wrong = F.lit(False)
        for kind, labels in schema.ALLOWED_TARGETS.items():
            wrong |= (F.col("kind") == kind) & ~F.col("label").isin(*labels, schema.UNRESOLVED)
        issue = F.when(F.col("there").isNull(), F.when(F.col("is_source"), "dangling_source").otherwise("dangling_target")).when(~F.col("is_source") & wrong, "target_label")
        broken = written(looked.select("id", "kind", issue.alias("issue")).where("issue IS NOT NULL"), "broken")
        edges = self.edges.select(F.col("id").alias("edge_id"), "source", "target", F.col("kind").alias("of_kind"))
        of = lambda name: broken.where(F.col("issue") == name)
        same = F.col("target").eqNullSafe(F.col("id")) & F.col("of_kind").eqNullSafe(F.col("kind"))
        found = [edges.join(of("dangling_source"), F.col("source").eqNullSafe(F.col("id"))), edges.join(of("dangling_target"), same), edges.join(of("target_label"), same)]
        return reduce(DataFrame.unionByName, [df.select("edge_id", "issue") for df in found])
