"""Toxicity scoring: a bidirectional gated recurrent network with attention pooling.

Each word enters with two inputs: a learned vector if it is frequent in the training sample, and
the last states of a character network that reads it in both directions.  The word network reads
overlapping windows of the text, attention pools a window's states, and a text's score is that of
its highest window.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import nn
from tessera.llm.common import annotate, batch_rows, crc_mod, fresh, hash_sample

WINDOW, STRIDE = 48, 24  # words
CHARS = 16  # longer runs of word characters are read as several words
PIECES = 5  # of a long training text
CODES = 384  # character inputs: 0 pads, ASCII as is, the rest folded into 256 classes
WORD = re.compile(r"\w{1,16}")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def char_codes(words: list[str]) -> np.ndarray:
    """(CHARS, words): character classes, right-aligned."""
    out = np.zeros((CHARS, len(words)), np.int64)
    if words:
        n = np.fromiter(map(len, words), np.int64, len(words))
        cp = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        col = np.repeat(np.arange(len(words)), n)
        row = np.arange(len(cp)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(CHARS - n, n)
        out[row, col] = np.where(cp < 128, cp, 128 + cp % 256)
    return out


def mirrored(codes: np.ndarray) -> np.ndarray:
    """The same words read from their ends: characters reversed, still right-aligned."""
    n = (codes > 0).sum(0)
    row = CHARS - 1 - (np.arange(CHARS)[:, None] - (CHARS - n)[None, :])
    return np.where(np.arange(CHARS)[:, None] >= (CHARS - n)[None, :], np.take_along_axis(codes, np.clip(row, 0, CHARS - 1), 0), 0)


def windows(ids: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows over every text: (WINDOW, windows) of word ids, and each text's first window."""
    n = np.array([max(1, -(-(len(a) - WINDOW) // STRIDE) + 1) for a in ids], np.int64)
    room = (n - 1) * STRIDE + WINDOW
    base = np.cumsum(room) - room
    flat = np.full(int(room.sum()), pad, np.int64)
    for a, b in zip(ids, base, strict=True):
        flat[b : b + len(a)] = a
    first = np.cumsum(n) - n
    starts = np.repeat(base, n) + STRIDE * (np.arange(int(n.sum())) - np.repeat(first, n))
    return flat[starts[None, :] + np.arange(WINDOW)[:, None]], first


def drawn(docs: DataFrame, labels: DataFrame, per_label: int, longest: int) -> DataFrame:
    """Training rows: of each label per_label texts at most, of each text `longest` characters at most.

    Only documents that have a label and a text are drawn, in the order of a hash of the id.  Of a longer
    text, PIECES pieces are taken at evenly spaced places.  Rows whose crc32(doc_id as text) mod 5 is 0
    are held out.  Labels other than 0 and 1 are ignored; a doc_id with several labels counts as 1 if
    any is.  These are 2 * per_label * longest characters at most.
    """
    y = labels.where(F.col("toxic").isin(0, 1)).where(crc_mod(F.col("doc_id"), 5) != 0)
    y = y.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where(crc_mod(F.col("doc_id"), 5) != 0).where(F.length("text") > 0).select("doc_id", "text")
    # Ids of two columns of numbers meet before any text is read.
    both = texts.select("doc_id").join(y, "doc_id")
    chosen = hash_sample(both.distinct(), "toxic", F.col("doc_id"), per_label).select("doc_id", "toxic", "_k")
    n, part = F.length("text"), longest // PIECES
    cut = F.concat_ws(" ", *[F.substring(F.col("text"), (F.floor((n - part) * i / (PIECES - 1)) + 1).cast("int"), F.lit(part)) for i in range(PIECES)])
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "_k", F.when(n > longest, cut).otherwise(F.col("text")).alias("text"))
    return rows.groupBy("toxic", "_k", "doc_id").agg(F.min("text").alias("text"))  # of repeated ids, one text


def ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["toxic", "_k"]).reset_index(drop=True)


def sample(docs: DataFrame, labels: DataFrame, per_label: int, longest: int) -> pd.DataFrame:
    """drawn(), in order."""
    return ordered(drawn(docs, labels, per_label, longest).toPandas())


def fit(
    rows: pd.DataFrame,
    hidden: int = 8,
    char_hidden: int = 12,
    steps: int = 540,
    docs_each: int = 12,
    windows_each: int = 8,
    vocabulary: int = 2000,
    least_share: float = 0.05,
    rate: float = 0.02,
    seed: int = 11,
) -> dict:
    """Train on texts with a 0/1 label each; a text's logit is the soft maximum over its windows.

    Words in least_share of the texts or more have a vector of their own (vocabulary of them at most);
    rarer ones, which would be learned by heart, enter by their characters alone.
    """
    rng = np.random.default_rng(seed)
    own: dict[str, str] = {}  # one object a word
    texts = [[own.setdefault(w, w) for w in words_of(t)] for t in rows["text"]]
    y = rows["toxic"].to_numpy(int) if len(rows) else np.zeros(0, int)
    by = [np.flatnonzero((y == v) & np.array([len(t) > 0 for t in texts], bool)) for v in (0, 1)]
    if not all(map(len, by)):
        return {"prior": float(y.mean()) if len(y) else 0.0}
    seen = Counter(w for t in texts for w in set(t))
    known = {w: i + 1 for i, (w, c) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:vocabulary]) if c >= max(5, least_share * len(texts))}
    h, ch = hidden, char_hidden
    p = {
        "cf": nn.init(rng, 3 * ch, CODES, scale=0.3),
        "cb": nn.init(rng, 3 * ch, CODES, scale=0.3),
        "vf": nn.init(rng, 3 * ch, ch),
        "vb": nn.init(rng, 3 * ch, ch),
        "ew": nn.init(rng, 6 * h, len(known) + 1, scale=0.1),
        "wc": nn.init(rng, 6 * h, 2 * ch),
        "bx": np.zeros((6 * h, 1), nn.F4),
        "uf": nn.init(rng, 3 * h, h),
        "ub": nn.init(rng, 3 * h, h),
        "wa": nn.init(rng, h, 2 * h),
        "va": nn.init(rng, 1, h),
        "wo": nn.init(rng, 1, 2 * h),
        "bo": np.full((1, 1), -1.0, nn.F4),
    }
    opt, last = nn.Adam(p, rate), np.full(len(y), 0.5)
    for step in range(steps):
        hard = 0.04 + last[by[0]]  # clean texts come as often as they last scored
        pick = np.concatenate([rng.choice(by[0], 2 * docs_each, p=hard / hard.sum()), rng.choice(by[1], docs_each)])
        cut: list[list[str]] = []
        owner: list[int] = []
        for k, i in enumerate(pick):
            t = texts[i]
            n = max(1, -(-(len(t) - WINDOW) // STRIDE) + 1)
            for j in rng.permutation(n)[:windows_each]:
                cut.append(t[j * STRIDE : j * STRIDE + WINDOW])
                owner.append(k)
        vocab = sorted({w for c in cut for w in c})
        place = {w: i for i, w in enumerate(vocab)}
        own = np.array(owner)
        grid = np.full((WINDOW, len(cut)), len(vocab), np.int64)
        for b, c in enumerate(cut):
            grid[: len(c), b] = [place[w] for w in c]
        mask = (grid < len(vocab)).astype(nn.F4)
        codes = char_codes(vocab)
        rev = mirrored(codes)
        sf, c1 = nn.run(p["cf"].T[codes].transpose(0, 2, 1), p["vf"])
        sb, c2 = nn.run(p["cb"].T[rev].transpose(0, 2, 1), p["vb"])
        chars = np.concatenate([sf[-1], sb[-1]])
        word = np.array([known.get(w, 0) for w in vocab], np.int64)
        gates = np.concatenate([p["wc"] @ chars + p["ew"][:, word] + p["bx"], p["bx"]], 1)
        x = gates.T[grid].transpose(0, 2, 1)
        hf, c3 = nn.run(np.ascontiguousarray(x[:, : 3 * h]), p["uf"])
        hb, c4 = nn.run(np.ascontiguousarray(x[:, 3 * h :]), p["ub"], reverse=True)
        both = np.concatenate([hf, hb], 1)
        a = np.tanh(p["wa"] @ both)
        e = (p["va"] @ a)[:, 0]
        e = np.where(mask > 0, e, -1e9)
        alpha = np.exp(e - e.max(0))
        alpha /= alpha.sum(0)
        v = (p["wo"] @ both)[:, 0]
        logit = (alpha * v).sum(0) + p["bo"][0, 0]
        top = np.full(len(pick), -np.inf)
        np.maximum.at(top, own, logit)
        w = np.exp(logit - top[own])
        mass = np.zeros(len(pick))
        np.add.at(mass, own, w)
        prob = 1 / (1 + np.exp(-(top + np.log(mass / np.bincount(own)))))
        last[pick] = prob
        dl = ((prob - y[pick])[own] * w / mass[own] / len(pick)).astype(nn.F4)
        dv = (alpha * dl).astype(nn.F4)
        de = (dv * (v - (alpha * v).sum(0))).astype(nn.F4)
        da = p["va"].T[None] * de[:, None, :] * (1 - a * a)
        dboth = p["wo"].T[None] * dv[:, None, :] + p["wa"].T @ da
        dxf, duf = nn.back(np.ascontiguousarray(dboth[:, :h]), c3, p["uf"])
        dxb, dub = nn.back(np.ascontiguousarray(dboth[:, h:]), c4, p["ub"], reverse=True)
        dx = np.concatenate([dxf, dxb], 1).transpose(1, 0, 2).reshape(6 * h, -1)
        dg = nn.scatter(grid.ravel(), dx, len(vocab) + 1)
        dword = dg[:, :-1]
        dchars = p["wc"].T @ dword
        d1, d2 = np.zeros_like(sf), np.zeros_like(sb)
        d1[-1], d2[-1] = dchars[:ch], dchars[ch:]
        dc1, dv1 = nn.back(d1, c1, p["vf"])
        dc2, dv2 = nn.back(d2, c2, p["vb"])
        opt.step(
            {
                "cf": nn.scatter(codes.ravel(), dc1.transpose(1, 0, 2).reshape(3 * ch, -1), CODES),
                "cb": nn.scatter(rev.ravel(), dc2.transpose(1, 0, 2).reshape(3 * ch, -1), CODES),
                "vf": dv1,
                "vb": dv2,
                "ew": nn.scatter(word, dword, len(known) + 1),
                "wc": dword @ chars.T,
                "bx": dg.sum(1, keepdims=True),
                "uf": duf,
                "ub": dub,
                "wa": np.einsum("thb,tkb->hk", da, both),
                "va": np.einsum("tb,thb->h", de, a)[None],
                "wo": np.einsum("tb,tkb->k", dv, both)[None],
                "bo": dl.sum()[None, None],
            },
            share=1.0 if step < steps * 0.5 else 0.4 if step < steps * 0.8 else 0.12,
        )
    m = {k: p[k] for k in ("ew", "wc", "bx", "wa", "va", "wo", "bo")} | {"known": known, "h": h}
    m["cf"], m["vf"] = nn.halved(p["cf"], p["vf"])
    m["cb"], m["vb"] = nn.halved(p["cb"], p["vb"])
    _, m["uf"] = nn.halved(p["cf"][:1].repeat(3 * h, 0), p["uf"])
    _, m["ub"] = nn.halved(p["cb"][:1].repeat(3 * h, 0), p["ub"])
    return centred(m, texts, y)


def centred(m: dict, texts: list[list[str]], y: np.ndarray) -> dict:
    """Shift the last bias so that 0.5 is the cut with the fewest errors on the training texts.

    Training sees hard clean texts more often than they occur, which alone would raise all scores.
    Among equally good cuts the middle of the widest gap counts.
    """
    lex = Lexicon(m)
    ids = [np.fromiter(map(lex.__getitem__, t), np.int64, len(t)) for t in texts]
    lex.settle()
    top = []
    for at in range(0, len(ids), 256):
        grid, first = windows(ids[at : at + 256], 0)
        top.append(np.maximum.reduceat(window_logits(m, lex.gates, grid), first))
    top = np.concatenate(top).astype(np.float64)
    order = np.argsort(top, kind="stable")
    top, y = top[order], y[order]
    errors = np.cumsum(y)[:-1] + (y == 0).sum() - np.cumsum(y == 0)[:-1]  # cut after each place
    gap = np.where(errors == errors.min(), np.diff(top), -1.0)
    k = int(gap.argmax())
    return m | {"bo": (m["bo"] - (top[k] + top[k + 1]) / 2).astype(nn.F4)}


class Lexicon(dict):
    """Word to column of the word network's inputs; columns of new words are computed in bulk."""

    def __init__(self, model: dict):
        super().__init__()
        self.m, self.h, self.fresh = model, model["h"], []
        self.gates = np.empty((2, 3 * self.h, 1024), nn.F4)  # of the forward and the backward network
        self.gates[:, :, 0] = self._halve(model["bx"])[:, 0].reshape(2, -1)  # the pad
        self.n = 1

    def _halve(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[: 2 * self.h] *= 0.5
        x[3 * self.h : 5 * self.h] *= 0.5
        return x

    def __missing__(self, word: str) -> int:
        k = self[word] = self.n + len(self.fresh)
        self.fresh.append(word)
        return k

    def settle(self) -> None:
        m = self.m
        for at in range(0, len(self.fresh), 4096):
            part = self.fresh[at : at + 4096]
            codes = char_codes(part)
            last = [nn.states(m[t], m[u], c, every=False) for t, u, c in (("cf", "vf", codes), ("cb", "vb", mirrored(codes)))]
            word = np.array([m["known"].get(w, 0) for w in part], np.int64)
            x = self._halve(m["wc"] @ np.concatenate(last) + m["ew"][:, word] + m["bx"])
            while self.n + len(part) > self.gates.shape[2]:
                self.gates = np.concatenate([self.gates, np.empty_like(self.gates)], 2)
            self.gates[:, :, self.n : self.n + len(part)] = x.reshape(2, 3 * self.h, -1)
            self.n += len(part)
        self.fresh = []


def window_logits(m: dict, gates: np.ndarray, grid: np.ndarray, width: int = 1024) -> np.ndarray:
    out, h = np.empty(grid.shape[1], nn.F4), m["h"]
    gf, gb = gates
    for at in range(0, grid.shape[1], width):
        idx = np.ascontiguousarray(grid[:, at : at + width]).astype(np.intp)
        hf = nn.states(gf, m["uf"], idx)
        hb = nn.states(gb, m["ub"], idx, reverse=True)
        b = idx.shape[1]
        e, v = np.empty((WINDOW, b), nn.F4), np.empty((WINDOW, b), nn.F4)
        for t in range(WINDOW):
            a = m["wa"][:, :h] @ hf[t]
            a += m["wa"][:, h:] @ hb[t]
            np.tanh(a, out=a)
            e[t] = (m["va"] @ a)[0]
            v[t] = (m["wo"][:, :h] @ hf[t])[0]
            v[t] += (m["wo"][:, h:] @ hb[t])[0]
        e[idx == 0] = -1e9
        e -= e.max(0)
        np.exp(e, out=e)
        out[at : at + width] = (e * v).sum(0) / e.sum(0) + m["bo"][0, 0]
    return out


def scorer(model, cached: int = 60_000):  # noqa: ANN001, ANN201
    """For annotate(): the scores of a list of texts; model: a broadcast of fit()'s result."""

    def make():  # noqa: ANN202
        m = model.value
        lex = Lexicon(m) if "prior" not in m else None

        def score(texts: list[str | None]) -> tuple[np.ndarray]:
            nonlocal lex
            out = np.zeros(len(texts))
            at = 0
            while at < len(texts) and lex is not None:  # about 1 MB of text at a time
                ids, size, rows = [], 0, []
                while at < len(texts) and (not rows or size < 1_000_000):
                    w = words_of(texts[at])
                    if w:
                        ids.append(np.fromiter(map(lex.__getitem__, w), np.int64, len(w)))
                        rows.append(at)
                        size += len(texts[at])
                    at += 1
                if rows:
                    lex.settle()
                    grid, first = windows(ids, 0)
                    top = np.maximum.reduceat(window_logits(m, lex.gates, grid), first)
                    out[rows] = 1 / (1 + np.exp(-top.astype(np.float64)))
                if lex.n > cached:
                    lex = Lexicon(m)
            if lex is None:
                out[:] = [m["prior"] if words_of(t) else 0.0 for t in texts]
            return (np.clip(out, 0.0, 1.0),)

        return score

    return make


class Given:
    """A model in the place of a broadcast of one."""

    def __init__(self, value: dict):
        self.value = value


def error(model: dict, rows: pd.DataFrame) -> float:
    """Mean over the two labels of the share of wrong predictions."""
    wrong = (scorer(Given(model))()(rows["text"].tolist())[0] >= 0.5) != (rows["toxic"].to_numpy() == 1)
    return float(np.mean([wrong[rows["toxic"].to_numpy() == v].mean() for v in (0, 1)]))


def train(
    docs: DataFrame, labels: DataFrame, per_label: int = 1500, longest: int = 20_000, checked: int = 150, tries: int = 3, enough: float = 0.005, seed: int = 11, **kw
) -> dict:  # noqa: ANN003
    """Fit on a bounded sample: per_label texts of each label, `longest` characters of each (see drawn() and best_of())."""
    return best_of(sample(docs, labels, per_label + checked, longest), per_label, tries, enough, seed, **kw)


def trained(docs: DataFrame, labels: DataFrame, per_label: int = 1500, longest: int = 20_000, checked: int = 150, tries: int = 3, enough: float = 0.005, seed: int = 11, **kw) -> dict:  # noqa: ANN003
    """train() in a task, so that the driver gets the model and neither holds the texts nor the network's arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"toxic": [], "_k": [], "text": []}), *batches]).astype({"toxic": "int64", "_k": "int64"})
        yield pd.DataFrame({"model": [pickle.dumps(best_of(ordered(rows), per_label, tries, enough, seed, **kw))]})

    batch_rows(docs.sparkSession)
    rows = drawn(docs, labels, per_label + checked, longest).select("toxic", "_k", "text")
    found = rows.repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else next(run(iter(())))["model"].map(pickle.loads).iat[0]  # noqa: S301


def best_of(rows: pd.DataFrame, per_label: int, tries: int, enough: float, seed: int, **kw) -> dict:  # noqa: ANN003
    """The model of the start that does best on texts set apart.

    Now and then a training ends badly, which only other texts show.  So the texts of each label beyond per_label are
    set apart, and with over `enough` errors on them the network is trained again from
    another start, `tries` times at most; the best one stays.  Without texts of both labels to check, the first does.
    """
    place = rows.groupby("toxic").cumcount()
    apart, rows = rows[place >= per_label], rows[place < per_label].reset_index(drop=True)
    best = None
    for k in range(tries if apart["toxic"].nunique() == 2 else 1):
        model = fit(rows, seed=seed + 12 * k, **kw)
        if not len(apart) or apart["toxic"].nunique() < 2 or "prior" in model:
            return model
        wrong = error(model, apart)
        if best is None or wrong < best[0]:
            best = (wrong, model)
        if wrong <= enough:
            break
    return best[1]


def toxicity(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None, **kw) -> DataFrame:  # noqa: ANN003
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels (doc_id, toxic).

    A null or empty text, or one without a word character, scores 0.  If the training sample lacks a
    label, every other text scores the sample's share of label 1.  Repeated rows are scored each.  A
    null doc_id counts as empty text when rows are held out.  Extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out, name = with_score(rows, train_on if train_on is not None else docs, labels, keep_text=False, **kw)
    held = (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out")
    score = F.col(name)
    return out.select("doc_id", held, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def with_score(docs: DataFrame, train_on: DataFrame, labels: DataFrame, keep_text: bool = True, **kw) -> tuple[DataFrame, str]:  # noqa: ANN003
    """docs with a column more, and its name."""
    model = docs.sparkSession.sparkContext.broadcast(trained(train_on, labels, **kw))
    name = fresh(docs, "_toxicity")
    return annotate(docs, "text", scorer(model), [T.StructField(name, T.DoubleType())], keep_text), name


def accepted(docs: DataFrame, labels: DataFrame, below: float = 0.5, **kw) -> DataFrame:  # noqa: ANN003
    """The rows of docs, unchanged, that score less than `below`.

    Null and empty texts score 0 and stay.  Equal texts fare alike, repeated rows stay repeated; an empty
    table stays empty; extra columns pass, whatever their names.
    """
    out, name = with_score(docs, docs, labels, **kw)
    return out.where(F.col(name) < below).select(*docs.columns)
