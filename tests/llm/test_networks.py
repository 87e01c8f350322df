"""The trained networks' scores against loops over single numbers, and the page rules against a plain rescan."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from tessera.llm import html_extract, langid, nn, toxicity


def gate(x):
    return 1 / (1 + math.exp(-x))


def plain_states(inputs, u, reverse=False):
    """States of a recurrent network by its equations; inputs: for each step the three parts of its gates."""
    h = u.shape[1]
    s, out = [0.0] * h, [None] * len(inputs)
    steps = range(len(inputs) - 1, -1, -1) if reverse else range(len(inputs))
    for t in steps:
        g = [sum(float(u[i, j]) * s[j] for j in range(h)) for i in range(3 * h)]
        x = inputs[t]
        z = [gate(x[i] + g[i]) for i in range(h)]
        r = [gate(x[h + i] + g[h + i]) for i in range(h)]
        c = [math.tanh(x[2 * h + i] + r[i] * g[2 * h + i]) for i in range(h)]
        s = [z[i] * s[i] + (1 - z[i]) * c[i] for i in range(h)]
        out[t] = s
    return out


def whole(table, u):
    """The weights before halved()."""
    t = np.array(table, dtype=float)
    t[: 2 * u.shape[1]] *= 2
    return t, np.array(u, dtype=float) * 2


def test_language_scores_equal_plain_loops():
    rng = np.random.default_rng(3)
    hidden, langs = 3, ["a", "b", "c"]
    p = {"tf": nn.init(rng, 9, 256, scale=0.6), "tb": nn.init(rng, 9, 256, scale=0.6), "uf": nn.init(rng, 9, hidden), "ub": nn.init(rng, 9, hidden)}
    model = {"langs": langs, "wf": nn.init(rng, 3, hidden), "wb": nn.init(rng, 3, hidden), "b": nn.init(rng, 3, 1)}
    (model["tf"], model["uf"]), (model["tb"], model["ub"]) = nn.halved(p["tf"], p["uf"]), nn.halved(p["tb"], p["ub"])
    texts = [b"abc", bytes(range(1, 256)) + b"tail", "naïve".encode()]
    got = langid.pooled(model, texts)
    for text, row in zip(texts, got):
        total, n = [0.0] * 3, 0
        for at in range(0, len(text), langid.SPAN):
            part = text[at : at + langid.SPAN].ljust(langid.SPAN, b"\0")
            hf = plain_states([p["tf"][:, c].astype(float) for c in part], p["uf"].astype(float))
            hb = plain_states([p["tb"][:, c].astype(float) for c in part], p["ub"].astype(float), reverse=True)
            for t, c in enumerate(part):
                if c:
                    e = [sum(float(model["wf"][k, j]) * hf[t][j] + float(model["wb"][k, j]) * hb[t][j] for j in range(hidden)) + float(model["b"][k, 0]) for k in range(3)]
                    w = [math.exp(v) for v in e]
                    total = [a + b / sum(w) for a, b in zip(total, w)]
                    n += 1
        assert np.allclose(row, [v / n for v in total], atol=2e-5)


def plain_toxicity(m, text):
    words = toxicity.words_of(text)
    if not words:
        return 0.0
    h = m["h"]
    (cf, vf), (cb, vb) = whole(m["cf"], m["vf"]), whole(m["cb"], m["vb"])
    uf, ub = np.array(m["uf"], dtype=float) * 2, np.array(m["ub"], dtype=float) * 2

    def inputs(word):
        code = [ord(c) if ord(c) < 128 else 128 + ord(c) % 256 for c in word]
        ahead = [0] * (toxicity.CHARS - len(code))
        f = plain_states([cf[:, c] for c in ahead + code], vf)[-1]
        b = plain_states([cb[:, c] for c in ahead + code[::-1]], vb)[-1]
        return np.array(m["wc"], dtype=float) @ np.array(f + b) + np.array(m["ew"], dtype=float)[:, m["known"].get(word, 0)] + np.array(m["bx"], dtype=float)[:, 0]

    known = {w: inputs(w) for w in set(words)}
    pad = np.array(m["bx"], dtype=float)[:, 0]
    top, start = -math.inf, 0
    while True:
        part = words[start : start + toxicity.WINDOW]
        x = [known[w] for w in part] + [pad] * (toxicity.WINDOW - len(part))
        hf = plain_states([v[: 3 * h] for v in x], uf)
        hb = plain_states([v[3 * h :] for v in x], ub, reverse=True)
        e, v = [], []
        for t in range(len(part)):
            both = np.array(hf[t] + hb[t])
            e.append(float((np.array(m["va"], dtype=float) @ np.tanh(np.array(m["wa"], dtype=float) @ both))[0]))
            v.append(float((np.array(m["wo"], dtype=float) @ both)[0]))
        w = [math.exp(a - max(e)) for a in e]
        top = max(top, sum(a * b for a, b in zip(w, v)) / sum(w) + float(m["bo"][0, 0]))
        if start + toxicity.WINDOW >= len(words):
            return gate(top)
        start += toxicity.STRIDE


def test_toxicity_scores_equal_plain_loops():
    rng = random.Random(5)
    good, bad = "the river runs past old stone houses and quiet fields".split(), "vile stupid hateful idiot naïve".split()
    texts = [" ".join(rng.choice(good) for _ in range(rng.randint(3, 60))) for _ in range(60)]
    texts += [" ".join(rng.choice(good + bad * 2) for _ in range(rng.randint(3, 60))) for _ in range(60)]
    rows = pd.DataFrame({"text": texts, "toxic": [0] * 60 + [1] * 60})
    m = toxicity.fit(rows, steps=6)

    class Sent:
        value = m

    tried = ["", "idiot", texts[0], texts[70], " ".join(texts[60:64]), None]
    got = toxicity.scorer(Sent())()(tried)[0]
    for t, s in zip(tried, got):
        assert abs(s - plain_toxicity(m, t or "")) < 2e-4


PIECES = ["<p>", "</p>", '<div class="sidebar">', "<div id=comments>", "</div>", "<article>", "</article>", "<b>", "</b>", "<a href=1>", "</a>", "<h1>", "</h1>", "<ul><li>", "</ul>", "<main>"]
PIECES += ["<nav>", "</nav>", "The cat and the dog are in the house with all of their friends, as it was said to be by them at night. ", "short one ", "foo &amp; bar ", "<section class=related>"]
PIECES += ["</section>", "<i>", "<header>", "</header>", "<br>", "<!-- no -->", "<script>if (a<b) x</script>", "<img src=x>", "<footer>", "</footer>"]


def plain_blocks(page):
    """Blocks with their surroundings by a list of open elements that is searched from its end for every tag."""
    out, stack, parts, linked, at, end, hinted = [], [], [], 0, 0, 0, 0
    holds = set()

    def close():
        nonlocal parts, linked
        text = " ".join(html_extract.entities.unescape("".join(parts)).split())
        if text:
            inner = stack[-1] if stack else ("", False, (), False)
            out.append((text, linked, inner[1], inner[2], inner[3], any(re.fullmatch(r"h\d+", e[0]) for e in stack[-3:])))
        parts, linked = [], 0

    def add(piece):
        nonlocal linked
        parts.append(piece)
        linked += len(piece) * any(e[0] == "a" for e in stack)

    for m in html_extract.TAG.finditer(page):
        if m.start() < end:
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at, sign, name = m.end(), m[1], (m[2] or "").lower()
        if not name or sign in ("!", "?"):
            continue
        if name == "br":
            parts.append(" ")
            continue
        block = name in html_extract.BLOCK
        if block:
            close()
        if sign:
            places = [k for k, e in enumerate(stack) if e[0] == name]
            del stack[places[-1] if places else len(stack) :]
            continue
        if name in html_extract.VOID:
            continue
        if name in html_extract.RAW:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end = stop.end() if stop else len(page)
            continue
        if block or name == "a":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == ("a" if name == "a" else "p"):
                    del stack[k:]
                    break
                if stack[k][0] in html_extract.BLOCK:
                    break
        _, never, hints, inside = stack[-1] if stack else ("", False, (), False)
        if name in ("article", "main", "h1"):
            holds.update(hints)
        if name in ("article", "main") and not never and not hints:
            inside = True
        elif name in html_extract.NEVER or (name == "header" and not inside):
            never = True
        if not never and name not in ("html", "body", "article", "main") and any(html_extract.HINTS.search(v.strip("\"'")) for v in html_extract.NAMED.findall(m[3])):
            hinted += 1
            hints = (*hints, hinted)
        stack.append((name, never, hints, inside))
    if at < len(page):
        add(page[at:])
    close()
    return out, holds


@pytest.mark.parametrize("seed", range(4))
def test_blocks_equal_a_rescan_of_all_open_elements(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        page = "".join(rng.choice(PIECES) for _ in range(rng.randint(2, 30)))
        blocks, hints = html_extract.blocks_of(page)
        want, holds = plain_blocks(page)

        def chain(h):
            return () if not h else (*chain(hints.outer[h]), h)

        assert [(b.text, b.linked, b.never, chain(b.hint), b.inside, b.heading) for b in blocks] == want
        assert {h for h in range(1, len(hints.outer)) if hints.holds[h]} == holds


def test_a_bad_training_is_repeated(monkeypatch):
    """Other starts are tried until the texts set apart are told apart; the best one stays, and rows set apart aren't fitted on."""
    rows = pd.DataFrame({"text": [f"t{i}" for i in range(40)], "toxic": [0] * 20 + [1] * 20})
    seen = []
    monkeypatch.setattr(toxicity, "sample", lambda docs, labels, n, longest: rows.groupby("toxic").head(n).reset_index(drop=True))
    monkeypatch.setattr(toxicity, "fit", lambda r, seed: seen.append((seed, len(r))) or {"seed": seed})
    wrong = {11: 0.3, 23: 0.1, 35: 0.2}
    monkeypatch.setattr(toxicity, "error", lambda m, r: wrong[m["seed"]] if len(r) == 10 else 1.0)
    assert toxicity.train(None, None, per_label=15, checked=5) == {"seed": 23} and seen == [(11, 30), (23, 30), (35, 30)]
    wrong[23] = 0.0
    seen.clear()
    assert toxicity.train(None, None, per_label=15, checked=5) == {"seed": 23} and len(seen) == 2
    seen.clear()
    assert toxicity.train(None, None, per_label=20, checked=5) == {"seed": 11} and seen == [(11, 40)]
