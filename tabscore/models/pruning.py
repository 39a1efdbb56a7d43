"""Cost-complexity pruning of decision trees.

The weakest link of a tree is the split that saves the least risk for each leaf it
adds. Cutting weakest links one after the other gives a sequence of ever smaller
trees, each the best one for a range of the price ``alpha`` of a leaf. Risk is the number of
training rows whose class is not the leaf's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Node:
    counts: tuple[float, ...]
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    @property
    def risk(self) -> float:
        """Rows of other classes than the commonest."""
        return sum(self.counts) - max(self.counts)

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def splits(self) -> list[Node]:
        return [] if self.left is None else [self, *self.left.splits(), *self.right.splits()]

    def link(self) -> float:
        """Risk that the branch saves for each leaf more than one."""
        leaves = self.leaves()
        return (self.risk - sum(leaf.risk for leaf in leaves)) / (len(leaves) - 1)

    def cut(self) -> None:
        self.feature, self.left, self.right = -1, None, None


def read_tree(model: DecisionTreeClassificationModel) -> Node:
    """The nodes of a fitted tree of continuous features, with the training rows of each class."""

    def read(node) -> Node:
        own = Node(tuple(node.impurityStats().stats()))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            own.feature, own.threshold = split.featureIndex(), split.threshold()
            own.left, own.right = read(node.leftChild()), read(node.rightChild())
        return own

    return read(model._call_java("rootNode"))


def _weakest(root: Node) -> float:
    return min(n.link() for n in root.splits())


def cut_links(root: Node, alpha: float) -> None:
    """Cut every branch whose link is ``alpha`` or weaker, again after each cut, from the top."""
    while True:
        weak = [n for n in root.splits() if n.link() <= alpha + 1e-9 * max(1.0, abs(alpha))]
        if not weak:
            return
        min(weak, key=lambda n: (n.link(), -len(n.leaves()))).cut()


def pruning_sequence(model: DecisionTreeClassificationModel) -> DataFrame:
    """``step, alpha, cp, leaves, risk``: the whole tree (alpha 0 after cutting what saves nothing), and each smaller one.

    ``alpha`` is the price from which the step's tree is the best, ``cp`` the same as a part of the root's risk.
    """
    root = read_tree(model)
    whole = root.risk or 1.0
    cut_links(root, 0.0)
    rows = [(0, 0.0, 0.0, len(root.leaves()), sum(n.risk for n in root.leaves()))]
    while root.left is not None:
        alpha = _weakest(root)
        cut_links(root, alpha)
        rows.append((len(rows), alpha, alpha / whole, len(root.leaves()), sum(n.risk for n in root.leaves())))
    spark = SparkSession.active()
    return spark.createDataFrame(rows, "step int, alpha double, cp double, leaves int, risk double")


def prune_tree(model: DecisionTreeClassificationModel, names: list[str], cp: float, out: str = "p1") -> PipelineModel:
    """The tree that is best when a leaf costs ``cp`` of the root's risk: probability of class 1 from the named columns.

    It scores as one expression, without the fitted model.
    """
    root = read_tree(model)
    cut_links(root, cp * (root.risk or 1.0))

    def text(node: Node) -> str:
        if node.left is None:
            n = sum(node.counts)
            return f"{float(node.counts[1] / n) if n and len(node.counts) > 1 else 0.0!r}D"
        return f"CASE WHEN `{names[node.feature]}` <= {node.threshold!r}D THEN {text(node.left)} ELSE {text(node.right)} END"

    return PipelineModel([SQLTransformer(statement=f"SELECT *, {text(root)} AS `{out}` FROM __THIS__")])
