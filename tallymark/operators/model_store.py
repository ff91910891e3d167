"""Fitted models as folders: arrays in one file, and a manifest with its digest, written last, so that a model is whole or not there.

A model's folder is named by family and seed and is never written over. Loading checks the digest, the labels and how many repeats each family has.
"""

from __future__ import annotations

import hashlib
import io
import json
import threading
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..sources import files
from .boosting import Boosted, Tree
from .models import AUDIT, TREES, Fitted, Linear
from .text_features import TextFeatures, Tfidf

_NODE = ("feature", "cut", "left", "right", "value", "gain")


def _arrays(m: Fitted) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    if m.features is not None:
        for i, p in enumerate(m.features.parts):
            out |= {f"grams{i}": p.grams, f"idf{i}": p.idf, f"sizes{i}": np.array(p.sizes), f"sublinear{i}": np.array(p.sublinear)}
        if m.features.axes is not None:
            out["axes"] = m.features.axes
    if isinstance(m.model, Linear):
        out |= {"weights": m.model.weights, "intercepts": m.model.intercepts, "soft": np.array(m.model.soft)}
    elif m.model is not None:
        trees = [t for r in m.model.rounds for t in r]
        out |= {"prior": m.model.prior, "cuts": np.concatenate([*m.model.cuts, np.zeros(0)]), "cut_sizes": np.array([len(c) for c in m.model.cuts]), "round_sizes": np.array([len(r) for r in m.model.rounds])}
        out |= {"tree_sizes": np.array([len(t.feature) for t in trees])} | {f"tree_{c}": np.concatenate([np.array(getattr(t, c)) for t in trees]) for c in _NODE}
    return out


def _split(x: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(x, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _model(a: dict[str, np.ndarray], about: dict) -> Fitted:
    out = Fitted(about["family"], about["seed"], about["labels"], majority=about["majority"], params=about["params"])
    if about["columns"]:
        parts = [Tfidf(a[f"grams{i}"], a[f"idf{i}"], tuple(a[f"sizes{i}"].tolist()), bool(a[f"sublinear{i}"])) for i in range(len(about["columns"]))]
        out.features = TextFeatures(about["columns"], parts, a.get("axes"))
    if "weights" in a:
        out.model = Linear(a["weights"], a["intercepts"], bool(a["soft"]))
    elif "prior" in a:
        nodes = zip(*(_split(a[f"tree_{c}"], a["tree_sizes"]) for c in _NODE), strict=True)
        trees = iter([Tree(**{c: x.tolist() for c, x in zip(_NODE, n, strict=True)}) for n in nodes])
        out.model = Boosted(_split(a["cuts"], a["cut_sizes"]), a["prior"], [[next(trees) for _ in range(n)] for n in a["round_sizes"]])
    return out


def save(spark: SparkSession, model: Fitted, folder: str) -> str:
    """Write a model below the folder; returns the digest of its arrays. A model of that family and seed that is there already is an error."""
    at, data = f"{folder}/{model.family}-{model.seed}", io.BytesIO()
    np.savez(data, **_arrays(model))
    digest = hashlib.sha256(data.getvalue()).hexdigest()
    about = {"family": model.family, "seed": model.seed, "labels": model.labels, "columns": model.features.columns if model.features else [], "majority": model.majority, "params": model.params, "sha256": digest}
    # A broken-off save leaves arrays that no manifest names, so their file has a name of its own.
    about["arrays"] = f"arrays-{uuid.uuid4().hex}.npz"
    files.create(spark, f"{at}/{about['arrays']}", data.getvalue())
    if not files.create(spark, f"{at}/manifest.json", json.dumps(about, sort_keys=True).encode()):
        files.delete(spark, f"{at}/{about['arrays']}")
        raise ValueError(f"there is a model at {at}")
    return digest


def load(spark: SparkSession, folder: str, family: str, seed: int) -> Fitted:
    about = json.loads(files.read(spark, f"{folder}/{family}-{seed}/manifest.json"))
    data = files.read(spark, f"{folder}/{family}-{seed}/{about['arrays']}")
    if hashlib.sha256(data).hexdigest() != about["sha256"] or (about["family"], about["seed"]) != (family, seed):
        raise ValueError(f"the model {family}-{seed} is not what its manifest says")
    with np.load(io.BytesIO(data)) as a:
        return _model({k: a[k] for k in a.files}, about)


def load_all(spark: SparkSession, folder: str, families: list[str], labels: list[str], seeds: list[int]) -> dict[str, list[Fitted]]:
    """Every planned model: trees once a seed, other families under the first seed. A model too many or too few, or other labels, are refused."""
    planned = {f"{f}-{s}" for f in families for s in (seeds if f in TREES else seeds[:1])}
    there = {n for n in files.names(spark, folder) if files.exists(spark, f"{folder}/{n}/manifest.json")}
    if planned != there:
        raise ValueError(f"the plan's repeats are {sorted(planned)}, there are {sorted(there)}")
    out = {f: [load(spark, folder, f, s) for s in (seeds if f in TREES else seeds[:1])] for f in families}
    if any(m.labels != labels for models in out.values() for m in models):
        raise ValueError("a model was fitted for other labels")
    return out


class AuditLog:
    """Rows of an audit as files, one each, written whole as soon as they are given: a `record` for models.train_grid."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._lock, self._n = spark, folder, threading.Lock(), len(files.names(spark, folder))

    def __call__(self, row: tuple) -> None:
        with self._lock:
            n, self._n = self._n, self._n + 1
        if not files.create(self.spark, f"{self.folder}/{n:06d}.json", json.dumps(row).encode()):
            raise ValueError("another run writes this audit")

    def rows(self) -> list[list]:
        return [json.loads(files.read(self.spark, f"{self.folder}/{n}")) for n in files.names(self.spark, self.folder)]

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r) for r in self.rows()], AUDIT)
