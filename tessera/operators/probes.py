"""An ensemble of small networks, one for each layer of a stack of vectors (inventory E14)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import h60
from tessera.operators import metrics as M
from tessera.operators.text import written

ROWS = 4000  # of each of the two sets that a network is fitted on, at most, by least hash


def forward(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden activations and probabilities of standardised rows."""
    h = np.maximum((x - p["mean"]) / p["scale"] @ p["w1"] + p["b1"], 0)
    return h, 1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30)))


def loss(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> float:
    q = np.clip(forward(p, x)[1], 1e-12, 1 - 1e-12)
    return float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())


def train(x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray, hidden: int, seed: int, epochs: int, patience: int, rate: float, batch: int) -> tuple[dict[str, np.ndarray], int]:
    """The weights of the epoch with the least loss on the second set, and that epoch; `patience` worse ones end the training."""
    rng = np.random.default_rng(seed)
    scale = x.std(0)
    p = {
        "mean": x.mean(0),
        "scale": np.where(scale > 1e-12, scale, 1.0),
        "w1": rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)),
        "b1": np.zeros(hidden),
        "w2": rng.normal(0, np.sqrt(1 / hidden), hidden),
        "b2": np.zeros(1),
    }
    names = ("w1", "b1", "w2", "b2")
    m, v = ({k: np.zeros_like(p[k]) for k in names} for _ in range(2))
    best, at, step = (loss(p, x2, y2), dict(p)), 0, 0
    for epoch in range(1, epochs + 1):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            part = order[i : i + batch]
            h, q = forward(p, x[part])
            d = (q - y[part]) / len(part)
            dh = np.outer(d, p["w2"]) * (h > 0)
            z = (x[part] - p["mean"]) / p["scale"]
            grad = {"w1": z.T @ dh, "b1": dh.sum(0), "w2": h.T @ d, "b2": d.sum(keepdims=True)}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        now = loss(p, x2, y2)
        if now < best[0]:
            best, at = (now, dict(p)), epoch
        elif epoch - at >= patience:
            break
    return best[1], at


def layer_probes(df: DataFrame, vector: str, label: str, role: str, layers: int, hidden: int = 16, seed: int = 5, epochs: int = 60, patience: int = 6, rate: float = 0.01, batch: int = 64, most: int = ROWS) -> DataFrame:
    """layer, epoch, weights: one network for each of the `layers` equal parts of a vector.

    Each is fitted apart, in a task of its own, on rows of role `train`, and stops early by those of role
    `early`; of each set the `most` rows with the least hash of the vector are used.
    """
    r = df.where(F.col(role).isin("train", "early") & F.col(vector).isNotNull() & F.col(label).isNotNull())
    r = r.select(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("double").alias("y"), F.col(role).alias("role"))
    r = r.withColumn("h", F.xxhash64("v", "y"))
    sample = r.where("role = 'train'").orderBy("h").limit(most).unionByName(r.where("role = 'early'").orderBy("h").limit(most))
    size = (F.size("v") / layers).cast("int")
    each = written(sample).withColumn("layer", F.explode(F.array(*[F.lit(i) for i in range(layers)])))
    each = each.select("layer", F.slice("v", F.col("layer") * size + 1, size).alias("v"), "y", "role", "h")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        x, y, role_ = np.stack(pdf["v"].to_list()), pdf["y"].to_numpy(), pdf["role"].to_numpy()
        a, b = role_ == "train", role_ == "early"
        p, epoch = train(x[a], y[a], x[b], y[b], hidden, seed + int(key[0]), epochs, patience, rate, batch)
        flat = {k: v.ravel().tolist() for k, v in p.items()}
        return pd.DataFrame([{"layer": key[0], "epoch": epoch} | flat])

    names = ("mean", "scale", "w1", "b1", "w2", "b2")
    return each.groupBy("layer").applyInPandas(fit, "layer int, epoch int, " + ", ".join(f"{n} array<double>" for n in names))


def probe_ensemble(df: DataFrame, key: str, vector: str, label: str, role: str, layers: int, top: int = 5, **how: int) -> tuple[DataFrame, DataFrame]:
    """Scores (key, score: the mean probability of the `top` layers' networks) and the layers (layer, epoch, auc, place).

    Layers are ranked by their AUC on all rows of role `select`, equal ones by number.  Every row with a
    vector is scored, null vectors get a null.
    """
    nets = written(layer_probes(df, vector, label, role, layers, **how))
    held = {r["layer"]: {k: np.array(r[k]) for k in ("mean", "scale", "w1", "b1", "w2", "b2")} for r in nets.collect()}  # `layers` networks
    for p in held.values():
        p["w1"] = p["w1"].reshape(len(p["mean"]), -1)
    kind = df.schema[key].dataType.simpleString()
    d = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("y"), F.col(role).alias("role"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = pdf["v"].notna().to_numpy()
            out = np.full((len(pdf), layers), np.nan)
            if known.any():
                x = np.stack(pdf["v"][known].to_list())
                width = x.shape[1] // layers
                for layer, p in held.items():
                    out[known, layer] = forward(p, x[:, layer * width : (layer + 1) * width])[1]
            yield pd.DataFrame({"key": pdf["key"], "y": pdf["y"], "role": pdf["role"], "p": [r if k else None for r, k in zip(out, known, strict=True)]})

    s = written(d.mapInPandas(score, f"key {kind}, y {df.schema[label].dataType.simpleString()}, role string, p array<double>"))
    chosen = s.where("role = 'select' and y is not null and p is not null").select("y", F.posexplode("p").alias("layer", "p"))
    auc = M.auc(chosen.withColumn("y", F.col("y").cast("int")), "p", "y", "layer").select("layer", "auc")
    ranked = sorted(((r["layer"], r["auc"]) for r in auc.collect()), key=lambda r: (-(r[1] if r[1] is not None else -1.0), r[0]))
    place = df.sparkSession.createDataFrame([(layer, i + 1) for i, (layer, _) in enumerate(ranked)], "layer int, place int")
    best = [layer for layer, _ in ranked[:top]]
    mean = sum((F.get("p", layer) for layer in best), F.lit(0.0)) / max(1, len(best))
    return s.select(F.col("key").alias(key), mean.alias("score")), nets.select("layer", "epoch").join(auc, "layer").join(place, "layer")


def split_roles(df: DataFrame, key: str, seed: str) -> DataFrame:
    """df with role: a fifth by hash is held, and of the others three fifths train, a fifth stops early, a fifth selects."""
    outer, inner = F.pmod(h60(seed, F.col(key)), F.lit(5)), F.pmod(h60(seed, "inner", F.col(key)), F.lit(5))
    return df.withColumn("role", F.when(outer == 0, "hold").when(inner < 3, "train").when(inner == 3, "early").otherwise("select"))
