"""Feed-forward nets."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from tabscore.models.score import score
from tabscore.operators.metrics import auc, stop_round


def mlp(
    df: DataFrame,
    cols: list[str],
    hidden: list[int],
    max_iter: int = 100,
    seed: int = 2016,
    label: str = "target",
    initial_weights=None,
) -> PipelineModel:
    """Net with sigmoid hidden layers and a two-class softmax output.

    ``initial_weights`` continues an earlier fit of the same layers. Features
    should be scaled.
    """
    assembler = VectorAssembler(inputCols=list(cols), outputCol="features")
    learner = MultilayerPerceptronClassifier(
        labelCol=label, layers=[len(cols), *hidden, 2], maxIter=max_iter, seed=seed
    )
    if initial_weights is not None:
        learner = learner.setInitialWeights(initial_weights)
    fitted = learner.fit(assembler.transform(df.select(label, *cols)).select(label, "features"))
    return PipelineModel([assembler, fitted])


def mlp_early_stop(
    train: DataFrame,
    valid: DataFrame,
    cols: list[str],
    hidden: list[int],
    chunk: int = 10,
    max_iter: int = 100,
    rounds: int = 5,
    tol: float = 1e-3,
    seed: int = 2016,
    label: str = "target",
    key: str = "id",
) -> tuple[PipelineModel, list[float]]:
    """Train in chunks of iterations until the validation AUC stalls.

    Returns the chunk with the best validation AUC and the AUC history. The last
    chunk is cut so that no more than ``max_iter`` iterations run. ``valid`` must hold both classes.
    """
    if valid.select(label).distinct().count() < 2:
        raise ValueError("the validation rows hold one class only, so they have no AUC")
    weights, history, best = None, [], None
    for done in range(0, max_iter, chunk):
        model = mlp(train, cols, hidden, min(chunk, max_iter - done), seed, label, initial_weights=weights)
        weights = model.stages[-1].weights
        area = auc(score(model, valid, key, "p1", [label]), label, "p1").first()["auc"]
        history.append(area)
        if best is None or area > max(history[:-1]):
            best = model
        if stop_round(history, rounds, tol) is not None:
            break
    return best, history
