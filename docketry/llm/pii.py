"""Personal data by rules and a skip-chain conditional random field.

Rules find e-mail addresses, IP addresses, card and phone numbers; their spans always stand. The field then
reads each text as a sequence of units (runs of non-space characters; numbers that follow each other are one unit) with a label
each: none, or one of the four kinds. The labels of units that a rule's span covers are observed; every other unit has a
potential from its own features (shape, punctuation, digits, the word before it); neighbouring units share a transition potential; and distant units
that are the same, or alike, share a skip potential for equal labels. So evidence found at one mention reaches
the others ("mail jo@x.org" ... "jo@x" with its end cut off). Alike are units that are equal but for case and the
punctuation around them, numbers of equal digits or groups of digits however they are written, and units that begin
another one or whose digits begin or end another one's. All members of such a group are linked to one shared node of the text,
so any two mentions are as near as any others and the graph grows with the text alone; the own potentials of its members are
shared out, as they say the same. Labels are the best of the beliefs
after damped loopy max-sum message passing, run until it stands still; units that come out as personal data
beyond the rules' spans add spans of their kind.

All weights are fitted, by pseudo-likelihood, on a bounded sample of documents (``SAMPLE`` rows of at most ``SAMPLE_CHARS``
characters, those with a low hash): the rules' spans are the labels, and mentions that the rules miss are made from theirs:
whole mentions are cut, or written in another way, and put elsewhere in the text, beside numbers of the same shape that no mention
supports. So a unit's own features, the transitions and each kind of link get the strength that they deserve. ``MARGIN``
is the belief that a label beyond the rules' needs over none; it is fitted too, for a precision of ``PRECISION`` on the sample.

A unit without digit, ``@`` or ``(at)`` cannot be labelled, so texts without any such unit skip the passing; it would change nothing.

Null text counts as empty. Rows with null or repeated ids, and repeated rows, each keep their row; equal texts have equal spans.
Offsets are code points, ends exclusive. Texts of any length are read whole. With an empty table the result is empty, and
without a sample the weights are zero. Other columns are not read, whatever their names; ``masked`` hands them on.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm._shared import sampled, texts
from docketry.llm._words import sliced

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match never begins inside a run of digits, as none that does could be the leftmost
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
NUMBER = re.compile(r"[(\['\"]*\+?\(?[0-9][0-9().+/-]*[)\]'\".,;:!?]*")
SAMPLE, SAMPLE_CHARS = 4000, 16_000
PRECISION = 0.98
#: Passing ends when no message changes by more than ``STILL``, or after so many rounds besides one for each node.
ROUNDS, STILL = 64, 1e-6
#: Log-potential of an observed label.
SURE = 40.0
#: Characters of a token that can be the beginning of another one cut short, and digits of a number that can be another's.
PREFIX, DIGITS = 4, 7
#: Kinds of links: equal text; equal but for case and edges; equal digits; one cut short.
LINKS = ("same", "alike", "digits", "cut")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def ruled(text: str) -> list[tuple[int, int, int]]:
    """Spans ``(kind, start, end)`` of the rules, by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, *m.span()) for m in _emails(text)]
    if not any(c in text for c in "0123456789"):
        return out
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def _emails(text: str):
    """Leftmost matches of EMAIL. The search starts at the first of the characters before an @ that can begin one,
    so long runs without an @ are not tried at each of their characters."""
    local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in local:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


FEATURES = ("one", "at", "at_inside", "dots3", "digits_only", "digit_share", "digits_4", "digits_7", "digits_13", "plus", "dash", "brackets", "letters", "long", "after_mail", "after_ip", "after_card", "after_phone")
CUES = (frozenset("mail email e-mail contact write".split()), frozenset("ip host server address".split()), frozenset("card visa credit iban account".split()), frozenset("phone call tel fax mobile".split()))
EDGE = "\"'`,;:!?()[]{}<>.*#$%&|"
DIGIT = re.compile(r"[0-9]")
AT = re.compile(r"[(\[]at[)\]]", re.I)


def units(text: str, spans: list) -> tuple[list, np.ndarray, np.ndarray]:
    """Units that can carry a label: ``(places, features, rule labels)``; a place is its number in the text, start and end."""
    found: list[tuple[int, int]] = []
    number = False
    for m in TOKEN.finditer(text):
        was, number = number, NUMBER.fullmatch(m[0]) is not None
        if was and number and m.start() - found[-1][1] == 1 and text[found[-1][1] - 1] not in ".,;:!?":
            found[-1] = (found[-1][0], m.end())
        else:
            found.append(m.span())
    able = [i for i, (a, b) in enumerate(found) if "@" in text[a:b] or DIGIT.search(text, a, b) or AT.search(text, a, b)]
    if not able:
        return [], np.zeros((0, len(FEATURES))), np.zeros(0, np.int64)
    rule = {}
    starts = np.array([a for a, _ in found])
    for kind, a, b in spans:
        for i in range(max(0, int(np.searchsorted(starts, a, "right")) - 1), len(found)):
            if found[i][0] >= b:
                break
            if 2 * (min(found[i][1], b) - max(found[i][0], a)) > found[i][1] - found[i][0]:
                rule.setdefault(i, kind)
    rows = np.zeros((len(able), len(FEATURES)))
    for r, i in enumerate(able):
        whole = text[found[i][0] : found[i][1]]
        w = whole.strip(EDGE)
        n = len(DIGIT.findall(w))
        x = rows[r]
        x[0], x[1], x[2] = 1, "@" in w or AT.search(w) is not None, "@" in w[1:-1]
        x[3], x[4], x[5], x[6], x[7], x[8] = w.count(".") == 3, n == len(w) > 0, n / max(1, len(w)), n == 4, n >= 7, n >= 13
        x[9], x[10], x[11] = w[:1] == "+", "-" in w, "(" in whole and n > 0
        x[12], x[13] = any(c.isalpha() for c in w), len(w) > 12
        before = text[found[i - 1][0] : found[i - 1][1]].strip(EDGE).lower() if i else ""
        for k, cue in enumerate(CUES):
            x[14 + k] = before in cue
    return [(i, *found[i]) for i in able], rows, np.array([rule.get(i, -1) + 1 for i in able], np.int64)


def linked(words: list) -> tuple[list, int]:
    """``(edges, nodes)``: skip edges ``(node, node, kind of link)`` among the units and the shared nodes after them."""
    edges, nodes = [], len(words)

    def shared(members, kind):
        nonlocal nodes
        if len(members) == 1:
            return members[0]
        edges.extend((m, nodes, kind) for m in members)
        nodes += 1
        return nodes - 1

    def grouped(pairs):
        out: dict = {}
        for key, node in pairs:
            out.setdefault(key, []).append(node)
        return out

    same = {w: shared(m, 0) for w, m in grouped((w, i) for i, w in enumerate(words)).items()}
    core = {c: shared(m, 1) for c, m in grouped((AT.sub("@", w).strip(EDGE).lower(), node) for w, node in same.items()).items() if c}
    numbers: dict = {}
    for c, node in core.items():
        if not any(x.isalpha() or x == "@" for x in c):
            groups = re.findall("[0-9]+", c)
            digits = "".join(groups)
            if len(digits) >= DIGITS or len(groups) == 4:
                numbers.setdefault(digits if len(digits) >= DIGITS else ".".join(groups), []).append(node)
    numbers = {d: shared(m, 2) for d, m in numbers.items()}

    def cut(texts_: dict, able):
        # each text and the longest other one that begins it: of those in order, it is among the ones still open
        open_: list = []
        for c in sorted(texts_):
            while open_ and not c.startswith(open_[-1]):
                open_.pop()
            if open_:
                edges.append((texts_[open_[-1]], texts_[c], 3))
            if able(c):
                open_.append(c)

    cut(core, lambda c: len(c) >= PREFIX and "@" in c[1:-1])
    long_ = {d: node for d, node in numbers.items() if "." not in d}
    cut(long_, lambda d: True)
    cut({d[::-1]: node for d, node in long_.items()}, lambda d: True)
    return edges, nodes


def learned_from(text: str, rng: random.Random) -> tuple[str, list]:
    """A text with mentions that the rules miss, made from theirs, and numbers that nothing supports: ``(text, labels)``;
    a label is ``(kind, start, end)``, and all else that is labelled comes from the rules."""
    spans = ruled(text)
    if not spans:
        return text, []
    fill = re.findall(r"[^\W\d_]+", text)[:200] or ["and"]
    added = []
    for kind, a, b in rng.sample(spans, min(len(spans), 3)):
        said = text[a:b]
        digits = DIGIT.findall(said)
        said, other = {
            0: lambda: (rng.choice([said[: rng.randint(said.index("@") + 3, len(said) - 1)], said.replace("@", "(at)"), said.upper()]), f"{rng.choice(fill)}@{rng.choice(fill)}"),
            1: lambda: (rng.choice([said.replace(".", "-"), said.replace(".", " . ").replace(" . ", "/")]), f"{rng.randint(256, 999)}.{rng.randint(0, 999)}.{rng.randint(0, 99)}"),
            2: lambda: (rng.choice([".".join("".join(digits[i : i + 4]) for i in range(0, len(digits), 4)), "".join(digits[: rng.randint(9, 12)])]), "".join(rng.choice("0123456789") for _ in digits)),
            3: lambda: (rng.choice(["".join(digits[-rng.randint(7, max(7, len(digits) - 1)) :]), f"({''.join(digits[:3])}) {''.join(digits[3:6])}-{''.join(digits[6:])}", re.sub(r"[^0-9]+", " ", said).strip()]), " ".join("".join(rng.choice("0123456789") for _ in range(n)) for n in (3, 3, 4))),
        }[kind]()
        added += [(kind + 1, said), (0, other), (0, str(rng.randint(1, 2030)))]
    rng.shuffle(added)
    labels = []
    for kind, said in added:
        text += "".join(f" {rng.choice(fill)}" for _ in range(rng.randint(1, 9))) + " "
        if kind:
            labels.append((kind - 1, len(text), len(text) + len(said)))
        text += said
    return f"{text} {rng.choice(fill)}", labels


def context(places: list, y: np.ndarray, words: list) -> np.ndarray:
    """For every unit, link kind and label: the share of the units it is linked with by that kind that have the label."""
    edges, nodes = linked(words)
    held = np.zeros((nodes, 5))
    held[np.arange(len(y)), y] = 1
    total = held.copy()
    inner = [e for e in edges if e[2] < 3]
    for m, node, _ in inner:
        total[node] += total[m]
    seen = np.zeros((len(y), len(LINKS), 5))
    below = {m: (node, kind) for m, node, kind in inner}
    cuts: dict = {}
    for a, b, _ in edges[len(inner) :]:
        cuts.setdefault(a, []).append(b)
        cuts.setdefault(b, []).append(a)
    for i in range(len(y)):
        at = i
        while True:
            for other in cuts.get(at, ()):
                seen[i, 3] += total[other]
            if at not in below:
                break
            node, kind = below[at]
            seen[i, kind] += total[node] - total[at]
            at = node
    return seen / np.maximum(1, seen.sum(axis=2, keepdims=True))


def fitted(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Weights, by pseudo-likelihood, from about ``sample`` documents, those with a low hash."""
    rng = random.Random(5)
    fine = docs.where((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text")
    texts_ = [r.text for r in sampled(fine, sample, fine.count(), "doc_id", "text").orderBy("doc_id", "text").collect()]
    made = []
    for text in texts_:
        new, labels = learned_from(text, rng)
        places, x, given = units(new, ruled(new))
        if not places:
            continue
        y = given.copy()
        for kind, a, b in labels:
            for i, (_, s, e) in enumerate(places):
                if s < b and a < e:
                    y[i] = kind + 1
        made.append((new, places, x, y, given))
    if not made:
        return {"token": np.zeros((len(FEATURES), 5)), "transition": np.zeros((5, 5)), "skip": np.zeros(len(LINKS)), "margin": np.inf}
    x, y = np.concatenate([m[2] for m in made]), np.concatenate([m[3] for m in made])
    links = np.concatenate([context(places, labels, [text[s:e] for _, s, e in places]) for text, places, _, labels, _ in made])
    before, after = np.zeros((len(y), 5)), np.zeros((len(y), 5))
    at = 0
    for _, places, _, labels, _ in made:
        for i in range(1, len(places)):
            if places[i][0] == places[i - 1][0] + 1:
                before[at + i, labels[i - 1]] = after[at + i - 1, labels[i]] = 1
        at += len(places)
    # what the rules cover is given; the others' labels are to be explained, those of each kind alike, however often it comes
    open_ = np.concatenate([m[4] for m in made]) == 0
    x, y, links, before, after = x[open_], y[open_], links[open_], before[open_], after[open_]
    target = np.eye(5)[y]
    weight = (1 / np.sqrt(np.maximum(1, np.bincount(y, minlength=5))[y]))[:, None]
    weight /= weight.sum()
    w = [np.zeros((x.shape[1], 5)), np.zeros((5, 5)), np.zeros(len(LINKS))]
    first, second = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    for step in range(1, 601):
        z = x @ w[0] + before @ w[1] + after @ w[1].T + np.einsum("ikl,k->il", links, w[2])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        off = (target - p / p.sum(axis=1, keepdims=True)) * weight
        up = (x.T @ off - 1e-4 * w[0], before.T @ off + off.T @ after - 1e-3 * w[1], np.einsum("ikl,il->k", links, off) - 1e-4 * w[2])
        first = [0.9 * m + 0.1 * g for m, g in zip(first, up)]
        second = [0.999 * v + 0.001 * g * g for v, g in zip(second, up)]
        w = [v + 0.05 * m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) for v, m, s in zip(w, first, second)]
        w[2] = np.maximum(w[2], 0)
    # a closer likeness is no weaker link, also where the sample has none
    w[2][:3] = np.maximum.accumulate(w[2][2::-1])[::-1]
    weights = {"token": w[0], "transition": w[1], "skip": w[2], "margin": 0.0}
    # the least margin at which what comes beyond the rules is right often enough
    sure, right = [], []
    for text, places, x, y, given in made:
        best, margin = labelled(places, x, given, [text[a:b] for _, a, b in places], weights)
        new = (best > 0) & (given == 0)
        sure += margin[new].tolist()
        right += (best == y)[new].tolist()
    order = np.argsort(sure)[::-1]
    share = np.cumsum(np.array(right, float)[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= PRECISION)
    weights["margin"] = float(np.array(sure)[order][good[-1]]) if len(good) else np.inf
    return weights


def labelled(places: list, x: np.ndarray, given: np.ndarray, words: list, weights: dict) -> tuple[np.ndarray, np.ndarray]:
    """``(labels, margin over none)`` of the units by damped loopy max-sum passing over chain and skip edges."""
    n = len(words)
    skips, nodes = linked(words)
    # mentions of one text, or of one number, say the same: together they have the voice of one
    up = {m: node for m, node, kind in skips if kind < 3}
    top = np.arange(n)
    for i in range(n):
        while int(top[i]) in up:
            top[i] = up[int(top[i])]
    many = np.bincount(top, minlength=nodes)[top]
    node = np.concatenate([x @ weights["token"] / many[:, None], np.zeros((nodes - n, 5))])
    node[:n][given > 0] = 0
    node[np.flatnonzero(given > 0), given[given > 0]] = SURE
    chain = [i for i in range(1, n) if places[i][0] == places[i - 1][0] + 1]
    a = [i - 1 for i in chain] + [e[0] for e in skips]
    b = chain + [e[1] for e in skips]
    tables = [weights["transition"]] * len(chain) + [np.eye(5) * weights["skip"][e[2]] for e in skips]
    belief = node
    if a:
        a, b, table = np.array(a), np.array(b), np.stack(tables)
        to_b, to_a = np.zeros((len(a), 5)), np.zeros((len(a), 5))
        for _ in range(ROUNDS + nodes):
            belief = node.copy()
            np.add.at(belief, b, to_b)
            np.add.at(belief, a, to_a)
            new_b = ((belief[a] - to_a)[:, :, None] + table).max(axis=1)
            new_a = ((belief[b] - to_b)[:, None, :] + table).max(axis=2)
            new_b, new_a = new_b - new_b.max(axis=1, keepdims=True), new_a - new_a.max(axis=1, keepdims=True)
            still = max(np.abs(new_b - to_b).max(), np.abs(new_a - to_a).max()) <= STILL
            to_b, to_a = (new_b, new_a) if still else (0.5 * to_b + 0.5 * new_b, 0.5 * to_a + 0.5 * new_a)
            if still:
                break
        belief = node.copy()
        np.add.at(belief, b, to_b)
        np.add.at(belief, a, to_a)
    belief = belief[:n]
    best = belief.argmax(axis=1)
    return best, belief[np.arange(n), best] - belief[:, 0]


def spans_of(text: str, weights: dict) -> tuple[list, list]:
    """``(rules' spans, all spans)`` of a text, each ``(kind, start, end)``, by kind, then start."""
    base = ruled(text)
    places, x, given = units(text, base)
    if not places:
        return base, base
    best, margin = labelled(places, x, given, [text[a:b] for _, a, b in places], weights)
    added = []
    for (_, start, end), kind, sure in zip(places, best, margin):
        # beliefs are exact to what the passing stops at
        if kind == 0 or sure < weights["margin"] - 1e-4:
            continue
        inner = text[start:end].strip(EDGE)
        if not inner:
            continue
        s = start + text[start:end].index(inner)
        e = s + len(inner)
        if not any(s < q and p < e for _, p, q in base):
            added.append((int(kind) - 1, s, e))
    return base, sorted(base + added)


def written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detected(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """The contract's row for each text."""
    docs = texts(docs)
    sent = docs.sparkSession.sparkContext.broadcast(weights or fitted(docs))
    out = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        for part in sliced(batches):
            rows = [spans_of(t or "", sent.value) for t in part.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in range(4)]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, digests, pa.array([written(s) for _, s in rows], pa.string())], schema=out)

    return docs.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redacted(text: str, spans: list) -> str:
    """The text with each span replaced by its kind; of overlapping spans, the first and longest."""
    out, done = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start < done:
            if end > done:
                done = end
            continue
        out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def masked(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """``docs`` with all found spans replaced in ``text``; null texts stay null. Other columns are kept."""
    columns = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(weights or fitted(texts(docs)))

    def run(batches):
        for part in sliced(batches):
            new = [None if t is None else redacted(t, spans_of(t, sent.value)[1]) for t in part.column("text").to_pylist()]
            yield part.set_column(columns.index("text"), "text", pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)
