"""Language identification with a bidirectional gated recurrent network over bytes.

Every byte of a text gets a distribution over the languages from the states of a forward and a
backward network; the mean over all positions is the document's distribution.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import nn
from tessera.llm.common import annotate, crc_mod, fresh, hash_sample

UNKNOWN = "und"
SPAN = 128  # bytes that the network reads in one go; longer texts are read as several spans
TYPES = {"_lang": T.StringType(), "_lang_score": T.DoubleType()}


def sample(docs: DataFrame, rows_each: int, spans: int) -> pd.DataFrame:
    """At most rows_each rows of each language, `spans` pieces of each: lang, pieces, place.

    Rows are taken in the order of a hash of the id (place: from 1 on), pieces at places that the hash
    fixes.  A null id is hashed like any other value; rows of one id tie and come in any order of their texts.
    """
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).where(crc_mod(F.col("doc_id"), 4) != 2)
    n, h = F.length("text"), F.xxhash64("doc_id")
    starts = [F.pmod(F.xxhash64(h, F.lit(k)), F.greatest(n - SPAN, F.lit(1))) for k in range(spans)]
    pieces = F.array(*[F.substring(F.col("text"), (s + 1).cast("int"), F.lit(SPAN)) for s in starts])
    rows = rows.select("doc_id", F.col("lang").alias("lang"), pieces.alias("pieces"))
    out = hash_sample(rows, "lang", F.col("doc_id"), rows_each).select("lang", "pieces", "_h", F.col("_k").alias("place")).toPandas()
    out = out.assign(_p=out["pieces"].map(lambda x: "".join(x))).sort_values(["lang", "_h", "_p"])
    return out.assign(place=out.groupby("lang").cumcount() + 1)


def spans_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as columns of SPAN positions (zero: none), and the first column of each text."""
    n = np.array([max(1, -(-len(t) // SPAN)) for t in texts], np.int64)
    flat = b"".join(t.ljust(int(k) * SPAN, b"\0") for t, k in zip(texts, n, strict=True))
    return np.frombuffer(flat, np.uint8).reshape(-1, SPAN).T, np.cumsum(n) - n


def fit(rows: pd.DataFrame, hidden: int = 12, steps: int = 160, batch: int = 128, rate: float = 0.02, seed: int = 7) -> dict:
    """Train by backpropagation through time on the loss of every position."""
    langs = sorted(rows["lang"].unique())
    rng = np.random.default_rng(seed)
    if not langs:
        return {"langs": []}
    k = len(langs)
    p = {
        "tf": nn.init(rng, 3 * hidden, 256, scale=0.3),
        "tb": nn.init(rng, 3 * hidden, 256, scale=0.3),
        "uf": nn.init(rng, 3 * hidden, hidden),
        "ub": nn.init(rng, 3 * hidden, hidden),
        "wf": nn.init(rng, k, hidden),
        "wb": nn.init(rng, k, hidden),
        "b": np.zeros((k, 1), nn.F4),
    }
    texts, ys = [], []
    for lang, pieces in zip(rows["lang"], rows["pieces"], strict=True):
        for piece in pieces:
            texts.append(piece.encode("utf-8", "replace")[:SPAN])
            ys.append(langs.index(lang))
    y = np.array(ys)
    by = [np.flatnonzero(y == i) for i in range(k)]
    every, _ = spans_of(texts)
    opt = nn.Adam(p, rate)
    for step in range(steps):
        pick = np.concatenate([rng.choice(i, max(1, batch // k)) for i in by])
        idx = every[:, pick].astype(np.intp)
        mask = (idx > 0).astype(nn.F4)
        xf, xb = p["tf"].T[idx].transpose(0, 2, 1), p["tb"].T[idx].transpose(0, 2, 1)
        hf, cf = nn.run(xf, p["uf"])
        hb, cb = nn.run(xb, p["ub"], reverse=True)
        logit = p["wf"] @ hf + p["wb"] @ hb + p["b"]
        e = np.exp(logit - logit.max(1, keepdims=True))
        d = e / e.sum(1, keepdims=True)
        d[:, y[pick], np.arange(len(pick))] -= 1
        d *= (mask / max(1.0, float(mask.sum())))[:, None, :]
        d = d.astype(nn.F4)
        dxf, duf = nn.back(p["wf"].T @ d, cf, p["uf"])
        dxb, dub = nn.back(p["wb"].T @ d, cb, p["ub"], reverse=True)
        flat = idx.ravel()
        opt.step(
            {
                "tf": nn.scatter(flat, dxf.transpose(1, 0, 2).reshape(3 * hidden, -1), 256),
                "tb": nn.scatter(flat, dxb.transpose(1, 0, 2).reshape(3 * hidden, -1), 256),
                "uf": duf,
                "ub": dub,
                "wf": np.einsum("tkb,thb->kh", d, hf),
                "wb": np.einsum("tkb,thb->kh", d, hb),
                "b": d.sum((0, 2))[:, None],
            },
            share=1.0 if step < steps * 0.6 else 0.3,
        )
    tf, uf = nn.halved(p["tf"], p["uf"])
    tb, ub = nn.halved(p["tb"], p["ub"])
    return {"langs": langs, "tf": tf, "uf": uf, "tb": tb, "ub": ub, "wf": p["wf"], "wb": p["wb"], "b": p["b"]}


def position_sums(model: dict, columns: np.ndarray, width: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the positions of each column of spans: (languages, columns) and the positions' count."""
    k, n = len(model["langs"]), columns.shape[1]
    total, count = np.zeros((k, n), nn.F4), np.zeros(n, np.int64)
    for at in range(0, n, width):
        part = np.ascontiguousarray(columns[:, at : at + width])
        idx, mask = part.astype(np.intp), (part > 0).astype(nn.F4)
        hf = nn.states(model["tf"], model["uf"], idx)
        hb = nn.states(model["tb"], model["ub"], idx, reverse=True)
        acc = total[:, at : at + width]
        for t in range(len(idx)):
            e = model["wf"] @ hf[t]
            e += model["wb"] @ hb[t]
            e += model["b"]
            e -= e.max(0)
            np.exp(e, out=e)
            e *= mask[t] / e.sum(0)
            acc += e
        count[at : at + width] = mask.sum(0, dtype=np.int64)
    return total, count


def pooled(model: dict, texts: list[bytes]) -> np.ndarray:
    """Document distributions (documents, languages): the mean over all positions."""
    columns, first = spans_of(texts)
    total, count = position_sums(model, columns)
    return (np.add.reduceat(total.astype(np.float64), first, axis=1) / np.maximum(1, np.add.reduceat(count, first))).T


def predictor(model):  # noqa: ANN001, ANN201
    """For annotate(): languages and scores of a list of texts; model: a broadcast of fit()'s result."""

    def make():  # noqa: ANN202
        import regex

        letter = regex.compile(r"\p{L}")
        m = model.value

        def predict(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
            lang, score = [UNKNOWN] * len(texts), np.ones(len(texts))
            known = [i for i, t in enumerate(texts) if m["langs"] and t and letter.search(t)]
            at = 0
            while at < len(known):  # about 2 MB of text at a time
                part, size = [], 0
                while at < len(known) and (not part or size < 2_000_000):
                    part.append(known[at])
                    size += len(texts[known[at]])
                    at += 1
                p = pooled(m, [texts[i].encode("utf-8", "replace") for i in part])
                for i, row in zip(part, p, strict=True):
                    best = int(row.argmax())
                    lang[i], score[i] = m["langs"][best], min(1.0, float(row[best]))
            return lang, score

        return predict

    return make


def least_score(model: dict, rows: pd.DataFrame, often: float = 2 / 3) -> float:
    """The highest score below which that share of the predictions is wrong, on rows not trained on; 0 if there is none.

    A row's pieces are pooled like a document.
    """
    if not model["langs"] or not len(rows):
        return 0.0
    p = pooled(model, ["".join(x).encode("utf-8", "replace") for x in rows["pieces"]])
    right = np.array(model["langs"])[p.argmax(1)] == rows["lang"].to_numpy()
    score = p.max(1)
    order = np.argsort(score, kind="stable")
    wrong = np.cumsum(~right[order])
    bad = np.flatnonzero(wrong >= often * np.arange(1, len(order) + 1))
    return float(np.nextafter(score[order][bad[-1]], 2.0)) if len(bad) else 0.0


def train(docs: DataFrame, per_language: int = 400, spans: int = 4, checked: int = 400, **kw) -> dict:  # noqa: ANN003
    """Fit on a bounded sample of rows with a known language: per_language rows of each.

    As many as `checked` more of each, never trained on, give the score below which a text is not told (`least`).
    """
    rows = sample(docs, per_language + checked, spans)
    model = fit(rows[rows["place"] <= per_language], **kw)
    return model | {"least": least_score(model, rows[rows["place"] > per_language])}


def identify(docs: DataFrame, train_on: DataFrame | None = None, **kw) -> DataFrame:  # noqa: ANN003
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang).

    lang_pred is `und` (score 1) for a null text or one without a letter, and for all rows if no
    row has a known language.  Ties go to the first language by name.  Repeated rows are scored
    each.  A null doc_id counts as empty text when rows are held out.  Extra columns are ignored.
    Held out are the rows whose crc32(doc_id as text) mod 4 is 2; they are never trained on.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out, lang, score, _ = with_language(rows, train_on if train_on is not None else docs, keep_text=False, **kw)
    held = (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out")
    return out.select("doc_id", held, F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def with_language(docs: DataFrame, train_on: DataFrame, keep_text: bool = True, **kw) -> tuple[DataFrame, str, str, float]:  # noqa: ANN003
    """docs with two more columns, their names (language and score), and the least score that tells a language."""
    model = train(train_on, **kw)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [fresh(docs, n) for n in TYPES]
    fields = [T.StructField(n, t) for n, t in zip(names, TYPES.values(), strict=True)]
    return annotate(docs, "text", predictor(shared), fields, keep_text), *names, model["least"]


def accepted(docs: DataFrame, least: float | None = None, **kw) -> DataFrame:  # noqa: ANN003
    """The rows of docs, unchanged, whose language is known with a score of `least` or more.

    By default least is the score below which, on labelled rows that were not trained on, two predictions
    in three are wrong (0 if there is none).  Null texts and those without a letter go, and so does every row if
    none has a known language.  Equal texts fare alike, repeated rows stay repeated; an empty table
    stays empty; extra columns pass, whatever their names.
    """
    out, lang, score, found = with_language(docs, docs, **kw)
    return out.where((F.col(lang) != UNKNOWN) & (F.col(score) >= (found if least is None else least))).select(*docs.columns)
