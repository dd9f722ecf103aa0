"""Models, a registry by name and version, batched inference, online learning and its checkpoints."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass
class LinearModel:
    """Logistic or linear scores over named features; trained by SGD in numpy."""

    features: list[str]
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0
    logistic: bool = True
    seen: int = 0

    def __post_init__(self):
        self.weights = list(self.weights) or [0.0] * len(self.features)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = x @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60))) if self.logistic else z

    def partial_fit(self, x: np.ndarray, y: np.ndarray, rate: float = 0.1) -> None:
        if not len(y):
            return
        err = y - self.predict(x)
        self.weights = (np.array(self.weights) + rate * x.T @ err / len(y)).tolist()
        self.bias += float(rate * err.mean())
        self.seen += len(y)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> LinearModel:
        return cls(**json.loads(text))


class OnnxModel:
    """A model file run by onnxruntime; the session is opened once a worker."""

    def __init__(self, path: str, features: list[str]):
        self.path, self.features, self._session = path, features, None

    def __getstate__(self):
        return {"path": self.path, "features": self.features, "_session": None}

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self._session is None:
            import onnxruntime

            self._session = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
        name = self._session.get_inputs()[0].name
        return np.asarray(self._session.run(None, {name: x.astype(np.float32)})[0]).reshape(len(x), -1)[:, -1].astype(float)


class ModelRegistry:
    """name -> version -> model. The latest version is the greatest as text, as fixed by the behaviour to match: "v9" comes after "v10"."""

    def __init__(self):
        self.models: dict[str, dict[str, object]] = {}

    def register(self, name: str, version: str, model) -> None:
        versions = self.models.setdefault(name, {})
        if version in versions:
            raise ValueError(f"{name} {version} is registered already")
        versions[version] = model

    def get(self, name: str, version: str | None = None):
        versions = self.models[name]
        return versions[version or max(versions)]

    def versions(self, name: str) -> list[str]:
        return sorted(self.models[name])

    def unregister(self, name: str, version: str) -> None:
        del self.models[name][version]
        if not self.models[name]:
            del self.models[name]

    def list(self) -> list[str]:
        return sorted(self.models)


def infer(df: DataFrame, model, name: str = "prediction", batch_rows: int | None = None) -> DataFrame:
    """Adds the prediction and the batch's latency a row, in Arrow batches; the model goes out once as a broadcast."""
    spark = df.sparkSession
    if batch_rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    shared = spark.sparkContext.broadcast(model)

    def run(frames):
        m = shared.value
        for f in frames:
            t = time.perf_counter()
            p = m.predict(f[m.features].fillna(0).to_numpy(float)) if len(f) else np.zeros(0)
            yield f.assign(**{name: p, "latency_ms": (time.perf_counter() - t) * 1000 / max(len(f), 1)})

    ddl = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    return df.mapInPandas(run, f"{ddl}, {name} double, latency_ms double")


class OnlineLearner:
    """Learns from micro-batches: 80 % to fit, the rest to score, by a stable hash of the key.

    ``step`` is a foreachBatch body. A batch is reduced on the executors to at most ``batch`` rows a partition's
    gradient sums; only sums reach the driver, so a batch's size doesn't matter to it.
    """

    def __init__(self, model: LinearModel, label: str, key: str, rate: float = 0.5, checkpoint: Callable[[str], None] | None = None):
        self.model, self.label, self.key, self.rate, self.checkpoint = model, label, key, rate, checkpoint
        self.history: list[dict] = []

    def step(self, batch: DataFrame, batch_id: int = 0) -> None:
        feats, label, key, model = self.model.features, self.label, self.key, self.model
        n = len(feats)

        def sums(frames):
            g, b, fit, right, test = np.zeros(n), 0.0, 0, 0, 0
            for f in frames:
                x, y = f[feats].fillna(0).to_numpy(float), f[label].to_numpy(float)
                p = model.predict(x)
                train = (pd.util.hash_pandas_object(f[key], index=False).to_numpy() % 10) < 8
                g += x[train].T @ (y[train] - p[train])
                b += float((y[train] - p[train]).sum())
                fit += int(train.sum())
                right += int(((p[~train] > 0.5) == (y[~train] > 0.5)).sum())
                test += int((~train).sum())
            yield pd.DataFrame({"g": [[*g.tolist(), b]], "fit": [fit], "right": [right], "test": [test]})

        from pyspark.sql import functions as F

        out = batch.select(key, label, *feats).mapInPandas(sums, "g array<double>, fit long, right long, test long")
        total = out.agg(*[F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(n + 1)], F.sum("fit").alias("fit"), F.sum("right").alias("right"), F.sum("test").alias("test")).first()
        if not total or not total["fit"]:
            return
        self.model.weights = [w + self.rate * total[f"g{i}"] / total["fit"] for i, w in enumerate(self.model.weights)]
        self.model.bias += self.rate * total[f"g{n}"] / total["fit"]
        self.model.seen += total["fit"]
        self.history.append({"batch": batch_id, "fit": total["fit"], "accuracy": total["right"] / total["test"] if total["test"] else None})
        if self.checkpoint:
            self.checkpoint(self.model.to_json())


def save_model(spark: SparkSession, model: LinearModel, path: str) -> str:
    """A file a save, named by time, in any store Spark can write."""
    name = f"{path}/model-{time.time_ns()}.json"
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.text(name)
    return name


def load_model(spark: SparkSession, name: str) -> LinearModel:
    return LinearModel.from_json(spark.read.text(name, wholetext=True).first()[0])
