"""Small tables with nulls, empty and long texts, ties, repeated rows, clashing columns, or nothing at all."""

import collections
import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from docketry.llm import chat, decontaminate, jaccard, licenses, mixing, passages, pii, quality, tokens, topk

FOLD = {i: i + 32 for i in range(65, 91)}
ALNUM, SPACED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, source string, words string, row string, bucket int, hash long, n int"


def docs(spark, rows):
    """Rows of (id, text) with a source and columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None if k % 4 == 0 else f"s{k % 3}", "w", "r", 1, 2, 3) for k, (i, t) in enumerate(rows)], DOCS)


def prose(rng, n, v=400):
    return " ".join(f"w{rng.randrange(v)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(5, 200)) for _ in range(30)]
    out = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:12]):
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        out += [(100 + i, " ".join(w)), (200 + i, t)]
    shared = prose(rng, 60)
    out += [(300 + i, f"{prose(rng, 20)} {shared} {prose(rng, 30)}") for i in range(4)]
    out += [(400, None), (401, ""), (402, "  \n "), (403, "one two"), (404, "One TWO"), (None, base[0]), (None, "x"), (0, base[0]), (405, "long " * 20000)]
    return out


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(SPACED, (t or "").translate(FOLD))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            k = len(sets[i] & sets[j])
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return collections.Counter((d, len(sets[i]), None if d is None else least[top(i)]) for i, (d, _) in enumerate(rows))


def test_jaccard(spark, rows):
    got = collections.Counter(tuple(r) for r in jaccard.near_duplicates(docs(spark, rows)).collect())
    assert got == brute_components(rows)
    kept = jaccard.deduplicated(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and ids.count(None) == 2 and 100 not in [i for i in ids if i is not None and len(rows[0][1].split()) > 60]


def test_jaccard_of_many_alike_sets(spark):
    """Copies of one text with edits, near the threshold and on both sides of it."""
    rng = random.Random(9)
    base = prose(rng, 120).split()
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = collections.Counter(tuple(r) for r in jaccard.near_duplicates(docs(spark, rows)).collect())
    assert got == brute_components(rows)


def test_passages(spark, rows):
    got = {r.doc_id: r for r in passages.repeats(docs(spark, rows)).collect()}
    assert {300, 301, 302, 303} <= set(got) and got[303].class_id == 300 and got[300].first_doc_id == 300
    spans = [tuple(map(int, s.split(":"))) for s in got[302].spans.split(",")]
    assert any(a <= 20 and b >= 80 for a, b in spans)
    grams = collections.defaultdict(set)
    for d, t in rows:
        w = re.findall(SPACED, (t or "").translate(FOLD))
        for i in range(len(w) - 49):
            if d is not None:
                grams[tuple(w[i : i + 50])].add(d)
    exact = {d for v in grams.values() if len(v) > 1 for d in v}
    assert exact <= set(got)
    assert not {403, 404, 405} & set(got)


def test_passage_that_stands_twice(spark):
    rng = random.Random(8)
    shared, other = prose(rng, 60, 5000), [prose(rng, 80, 5000) for _ in range(4)]
    rows = [(1, f"{other[0]} {shared} {other[1]}"), (2, f"{shared} {other[2]} {shared} {other[3]}"), (3, "same " * 900), (4, "same " * 700)]
    got = {r.doc_id: r for r in passages.repeats(docs(spark, rows)).collect()}
    spans = {d: [tuple(map(int, s.split(":"))) for s in got[d].spans.split(",")] for d in (1, 2)}
    # near windows reach a few words beyond the passage
    assert [(71 <= a <= 80, 140 <= b <= 149) for a, b in spans[1]] == [(True, True)]
    assert [(max(0, p - 9) <= a <= p, p + 60 <= b <= p + 69) for (a, b), p in zip(spans[2], (0, 140))] == [(True, True)] * 2 and got[2].n_passages == 2
    assert got[3].spans == "0:900" and got[4].spans == "0:700"


def test_passages_that_the_smallest_document_holds_in_part(spark):
    """Document 1 of each group has a line of the passage that the other two share; its keys can lie in that line."""
    rng = random.Random(12)
    rows = []
    for k in range(0, 400, 10):
        shared = prose(rng, 50, 5000)
        line = " ".join(shared.split()[4:44])
        rows += [(k + 1, f"{prose(rng, 30, 5000)} {line} {prose(rng, 30, 5000)}"), (k + 2, f"{prose(rng, 20, 5000)} {shared} {prose(rng, 9, 5000)}"), (k + 3, f"{prose(rng, 9, 5000)} {shared} {prose(rng, 20, 5000)}")]
    got = {r.doc_id: r for r in passages.repeats(docs(spark, rows)).collect()}
    assert {k + i for k in range(0, 400, 10) for i in (2, 3)} <= set(got)
    assert all(got[k + 3].class_id in (k + 1, k + 2) for k in range(0, 400, 10))


def test_near_passages_against_brute_force(spark):
    """Passages of 60 to 90 words that stand in two documents with words exchanged, put in and left out: of the pairs with near windows
    at least nine in ten are found, and of the others none."""
    rng = random.Random(17)
    said, near = [], set()
    shingles = lambda w, i: {tuple(w[k : k + 5]) for k in range(i, i + 46)}
    for k in range(0, 600, 2):
        passage = prose(rng, rng.randrange(60, 90), 9000).split()
        other = list(passage)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(other))
            other[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(2)
        x, y = prose(rng, 15, 9000).split() + passage + prose(rng, 15, 9000).split(), prose(rng, 9, 9000).split() + other + prose(rng, 20, 9000).split()
        said += [(k, " ".join(x)), (k + 1, " ".join(y))]
        ours, theirs = ([shingles(w, i) for i in range(len(w) - 49)] for w in (x, y))
        if any(4 * len(a & b) >= 3 * len(a | b) for a in ours for b in theirs):
            near.add(k)
    got = {r.doc_id - r.doc_id % 2 for r in passages.repeats(docs(spark, said)).collect()}
    assert got <= near and len(got) >= 0.9 * len(near) and len(near) > 150, (len(got), len(near))


def test_decontamination(spark, rows):
    moved = rows[5][1].split()[:14]
    moved[3:5] = [moved[4], moved[3]]
    bench = [(1, " ".join(rows[3][1].split()[2:14])), (6, " ".join(moved)), (2, "one two"), (3, None), (None, "one"), (4, "..."), (2, "one two"), (5, " ".join(rows[3][1].split()[:30]))]
    items = spark.createDataFrame(bench, "item_id long, text string")
    words = lambda t: re.findall(ALNUM, (t or "").translate(FOLD))
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(str(i))
    want = collections.Counter()
    for d, t in rows:
        w, hit, names = words(t), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    names |= ids
        near = {i for win, ids in windows.items() if any(all(x in w[max(0, s + j - 2) : max(0, s + j + 3)] for j, x in enumerate(win)) for s in range(-2, len(w) + 2)) for i in ids}
        assert names <= near
        want[(d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit), len(near))] += 1
    assert collections.Counter(tuple(r) for r in decontaminate.report(docs(spark, rows), items).collect()) == want
    blocks = decontaminate.find(docs(spark, rows), items, block_windows=5).selectExpr("doc_id", "n_words", "n_hit", "cast(size(items) as bigint)", "sha2(array_join(items, ','), 256)", "n_hit > 0", "cast(size(near_items) as bigint)")
    assert collections.Counter(tuple(r) for r in blocks.collect()) == want
    clean = collections.Counter(r.doc_id for r in decontaminate.clean(docs(spark, rows), items, block_windows=5).collect())
    assert clean == collections.Counter({d: n for d, n in sum((collections.Counter({k[0]: v}) for k, v in want.items() if not k[5]), collections.Counter()).items()})


def test_proximity(spark):
    text = "a b c d e x f g h i j"
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    index = decontaminate.indexed(docs(spark, [(1, text), (2, "a b c")]))
    got = decontaminate.found_in(index, items).orderBy("doc_id").collect()
    assert [(r["items"], r.near_items, r.spans) for r in got] == [([], ["1"], []), ([], [], [])]
    # the same index serves another benchmark
    other = spark.createDataFrame([("x", "b c")], "item_id string, text string")
    assert [(r["items"], r.n_hit) for r in decontaminate.found_in(index, other).orderBy("doc_id").collect()] == [(["x"], 2), (["x"], 2)]


def test_tokens(spark, rows):
    first, more = [b"w", b"w1", b"one", b"long"], [b"0", b"1", b"2", b"3", b"12", b"4"]

    def brute(word):
        word, n, voc = word.encode(), 0, first
        while word:
            size = max((len(p) for p in voc if word.startswith(p)), default=0)
            if not size:
                return 1, 1
            word, n, voc = word[size:], n + 1, more
        return n, 0

    want = collections.Counter()
    for d, t in rows:
        w = re.findall(SPACED, t or "")
        c = [brute(x) for x in w]
        want[(d, len(w), sum(x for x, _ in c), sum(u for _, u in c))] += 1
    assert collections.Counter(tuple(r) for r in tokens.counted(docs(spark, rows), pieces=(first, more)).collect()) == want


def test_tokens_of_words_that_only_the_bare_mark_begins():
    import numpy as np

    first, more = tokens.pieces_of()
    assert b"" in first and not any(p[:1].isdigit() for p in first)
    begins, goes = set(first), set(more)

    def brute(word):
        n, voc = 0, begins
        while word or voc is begins:
            size = next((k for k in range(min(len(word), 64), -1, -1) if word[:k] in voc and (k or voc is begins)), None)
            if size is None:
                return 1, True
            word, n, voc = word[size:], n + 1, goes
        return n, False

    rng = random.Random(4)
    said = ["2024", "10km", "3.14", "0", "9780306406157", "x1", "the", "漢字", "日本語テキスト", "Привет", "1\u2603", "5é"]
    said += ["".join(rng.choice("0123456789.-kmaé") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    data = [w.encode() for w in said]
    ends = np.cumsum([len(w) for w in data])
    got = tokens.Automaton(first, more).counts(np.frombuffer(b"".join(data), np.uint8), ends - [len(w) for w in data], ends)
    assert list(zip(got[0].tolist(), got[1].tolist())) == [brute(w) for w in data]
    assert got[0][0] > 1 and not got[1][0]
    # words of all lengths around the one from which they are run on their own, and one of 400 KB in no time
    long_ = ["".join(rng.choice("abcdefghij0123日本") for _ in range(n)) for n in (80, 200, 255, 256, 257, 300, 5000)] + ["a" * 256, "a" * 257, "a" * 400 + "\u2603"]
    data = [w.encode() for w in long_]
    ends = np.cumsum([len(w) for w in data])
    machine = tokens.Automaton(first, more)
    got = machine.counts(np.frombuffer(b"".join(data), np.uint8), ends - [len(w) for w in data], ends)
    assert list(zip(got[0].tolist(), got[1].tolist())) == [brute(w) for w in data]
    import time

    began = time.time()
    machine.counts(np.frombuffer(b"QmFzZTY0" * 50000, np.uint8), np.array([0]), np.array([400000]))
    assert time.time() - began < 5


def test_tokens_of_prose_with_the_whole_vocabulary(spark, rows):
    first, more = map(set, tokens.pieces_of())

    def brute(word):
        n, voc = 0, first
        while word or voc is first:
            size = next((k for k in range(min(len(word), 64), -1, -1) if word[:k] in voc and (k or voc is first)), None)
            if size is None:
                return 1, 1
            word, n, voc = word[size:], n + 1, more
        return n, 0

    said = rows + [(900, "The quick brown fox, naïve déjà-vu; 3.14159 Straße 漢字かな x\u2603y " * 3)]
    want = collections.Counter()
    for d, t in said:
        c = [brute(w.encode()) for w in re.findall(SPACED, t or "")]
        want[(d, len(c), sum(n for n, _ in c), sum(u for _, u in c))] += 1
    assert collections.Counter(tuple(r) for r in tokens.counted(docs(spark, said)).collect()) == want


def test_licenses(spark):
    rows = [(1, "Under the MIT License. under the mit license cc by-nc"), (2, None), (3, ""), (4, "GNU General Public License version 3, licensed under the GPL v3"), (5, "the mit of license"), (6, "released under the Apache License, Version 2.0"), (6, "x " * 30000 + "CC BY NC")]
    got = {(r.doc_id, r.n_words): r for r in licenses.scanned(docs(spark, rows)).collect()}
    one = got[1, 11]
    assert (one.n_base, one.first_word, one.last_word, one.base_labels) == (3, 0, 8, "cc-by-nc,mit")
    assert got[2, 0].labels == got[3, 0].labels == "" and got[2, 0].first_word is None
    assert "gpl-3" in got[4, 11].labels.split(",") and got[4, 11].base_labels == ""
    assert got[5, 4].labels == ""
    assert got[6, 8].labels == "apache-2" and got[6, 30003].first_word == 30000
    assert len(licenses.rules()) > 200


def said_by(pattern, rng):
    """A random text that a rule's pattern matches."""
    import re._parser as parser

    def of(items):
        out = ""
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "ANY":
                out += rng.choice("ab")
            elif op == "IN":
                kind, first = arg[0]
                out += chr(first if str(kind) == "LITERAL" else rng.randint(*first))
            elif op == "BRANCH":
                out += of(rng.choice(arg[1]))
            elif op == "SUBPATTERN":
                out += of(arg[3])
            else:
                low, high, inner = arg
                out += "".join(of(inner) for _ in range(rng.randint(low, min(int(high), low + 2))))
        return out

    return of(parser.parse(pattern))


def brute_licenses(text):
    words = re.findall(ALNUM, (text or "").translate(FOLD))
    line = f" {' '.join(words)} "
    found = [(*m.span(1), p, i, label) for i, (label, p, _, pattern) in enumerate(licenses.rules()) for m in re.finditer(f"(?<= )({pattern})(?= )", line)]

    def stronger(y, x):
        longer = y[1] - y[0] > x[1] - x[0]
        return y[0] <= x[0] and y[1] >= x[1] and (y[2] > x[2] or y[2] == x[2] and (longer or y[:2] == x[:2] and y[3] < x[3]))

    return sorted(x for x in found if not any(stronger(y, x) for y in found))


def test_license_rules_against_brute_force(spark):
    """Every rule, with gates and without, alone and in mixes where matches touch, overlap and contain each other."""
    rng = random.Random(7)
    table = licenses.rules()
    rows = []
    for i, (_, _, keyword, pattern) in enumerate(table):
        for _ in range(3):
            text = " ".join(said_by(pattern, rng).split())
            assert re.search(f"(?<= )({pattern})(?= )", f" {text} ") and f" {keyword}" in f" {text}", (text, keyword)
            rows.append((i, f"Code, {text.upper()}; now"))
    for k in range(300):
        bits = [said_by(rng.choice(table)[3], rng) if rng.random() < 0.6 else rng.choice("the license of gpl version 2 or later mit bsd clause and under".split()) for _ in range(rng.randrange(1, 9))]
        rows.append((1000 + k, " ".join(bits)))
    got = collections.Counter((r.doc_id, tuple(tuple(d) for d in r.detections)) for r in licenses.scanned(docs(spark, rows)).collect())
    assert got == collections.Counter((i, tuple(brute_licenses(t))) for i, t in rows)
    assert {label for label, *_ in table} <= {d[4] for _, v in got for d in v}


def test_license_labels(spark):
    said = {
        "distributed with the GPL v3": "gpl-3", "This code is under the GPL version 3": "gpl-3", "Affero General Public License version 1": "agpl-1", "GNU LGPL 2.0": "lgpl-2.0",
        "in the heart of the MIT; subject to rain": "", "LGPL-2.1-or-later": "lgpl-2.1-or-later", "GPLv2+ or GPLv2 or later": "gpl-2,gpl-2-or-later", "Er kam mit dem Lizenzgeber": "", "Released under the 3-clause BSD license.": "bsd-3",
    }
    got = {r.doc_id: r.labels for r in licenses.scanned(docs(spark, list(enumerate(said)))).collect()}
    assert [got[i] for i in range(len(said))] == list(said.values())


def test_license_scan_of_a_long_repeating_text(spark):
    import time

    began = time.time()
    (row,) = licenses.scanned(docs(spark, [(1, "licensed under the mit license and so on. " * 25000)])).collect()
    assert (row.n_base, row.labels, len(row.detections)) == (25000, "mit", 25000) and time.time() - began < 60


def brute_chat(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check_budget(windows):
    """No window passes the budget but for a single turn that does so alone, beside which nothing is repeated."""
    size = lambda text: max(1, -(-len(text.encode()) // 4) + 4)
    for w in windows:
        every = w.text.split(chat.START)[1:]
        repeated = sum(size(chat_text(p)) for p in every[: w.n_repeated])
        assert w.n_tokens == repeated + sum(size(t.text) for t in w.turns)
        assert w.n_tokens <= chat.BUDGET or (len(w.turns) == 1 and size(w.turns[0].text) > chat.BUDGET and w.n_repeated == 0)


def chat_text(piece):
    return piece[: -len(chat.END) - 1].split("\n", 1)[1].replace("<\\p", "<|").replace("\\b", "\\")


def test_chat_budget_counts_what_is_repeated(spark):
    rng = random.Random(14)
    turns = lambda c, system, sizes: [(c, 0, "system", "s" * 4 * system)] * (system > 0) + [(c, i + 1, rng.choice(["user", "assistant"]), "w" * 4 * n) for i, n in enumerate(sizes)]
    rows = turns(1, 2000, [50] * 60) + turns(2, 300, [rng.randrange(900) for _ in range(40)]) + turns(3, 500, [100, 700, 3000, 5, 5]) + turns(4, 0, [rng.randrange(400) for _ in range(60)]) + turns(5, 508, [200] * 9)
    windows = chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    check_budget(windows)
    by = collections.defaultdict(list)
    for w in sorted(windows, key=lambda w: (w.conv_id, w.window)):
        by[w.conv_id].append(w)
    # a system turn that fits comes first in every later window; one that is too large stands in its own alone
    starts = lambda w: w.text.startswith(chat.START + "system")
    assert all(starts(w) for w in by[2][1:] if len(w.turns) > 1) and all(starts(w) for w in by[5])
    assert sum(starts(w) for w in by[1]) == 1 and all(w.n_repeated for w in by[1][2:])
    assert any(w.n_repeated == 0 and w.n_tokens > chat.BUDGET for w in by[3])


def test_chat(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>assistant ok", "\\b", "\\", "<", "|", "<|", "<\\p", "é漢", "\n", "\\n", "word " * 40]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb", None, "<|im_end|>"]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9))) or None) for c in range(30) for t in [*range(rng.randrange(1, 12)), 3]]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (77, 1, "assistant", "z" * 60000), (77, 2, "assistant", "q")]
    convs = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, tokens string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(convs).collect()}
    assert got == brute_chat(rows)
    windows = chat.formatted(convs).collect()
    own = collections.Counter(w.conv_id for w in windows)
    assert own[77] == 2 and any(w.n_repeated for w in windows)
    check_budget(chat.read_back(chat.formatted(convs)).collect())


def test_passages_of_rows_that_share_an_id(spark):
    rng = random.Random(31)
    one, two = prose(rng, 80), prose(rng, 80)
    found = {r.doc_id: r.class_id for r in passages.repeats(docs(spark, [(1, one), (1, two), (2, one), (3, two), (4, prose(rng, 80))])).collect()}
    assert found == {1: 1, 2: 1, 3: 1}


def exact_shares(blocks, weights, times):
    """How many blocks each source is due after each number of slots: shares by weight, phase by phase, until sources run dry."""
    left, due, out, t = dict(blocks), dict.fromkeys(blocks, Fraction(0)), [], Fraction(0)
    times = sorted(times)
    while times:
        active = {s: Fraction(weights[s]) for s, n in left.items() if due[s] < n}
        if not active:
            return out + [dict(due) for _ in times]
        total = sum(active.values())
        ends = t + min((left[s] - due[s]) * total / w for s, w in active.items())
        while times and times[0] <= ends:
            out.append({s: d + (active[s] / total * (times[0] - t) if s in active else 0) for s, d in due.items()})
            times.pop(0)
        for s, w in active.items():
            due[s] += w / total * (ends - t)
        t = ends
    return out


def brute_mix(blocks, weights):
    """Slots by the definition: at each slot, of the blocks that have begun to be due the one that is due whole first."""
    total = sum(blocks.values())
    shares = exact_shares(blocks, weights, range(total + 1))
    release = {(s, j): next(t for t in range(total) if shares[t + 1][s] > j) for s, n in blocks.items() for j in range(n)}
    due = {(s, j): next(t for t in range(total + 1) if shares[t][s] >= j + 1) for s, n in blocks.items() for j in range(n)}
    given, slots = dict.fromkeys(blocks, 0), {}
    for t in range(total):
        s, j = min(((s, j) for s, j in given.items() if j < blocks[s] and release[s, j] <= t), key=lambda x: (due[x], release[x], *x))
        slots[s, j] = t
        given[s] += 1
    return slots


def lag(slots, blocks, weights, every=1):
    """The largest distance of a source from its exact share, after any number of slots."""
    order = [s for s, _ in sorted(slots, key=slots.get)]
    assert sorted(slots.values()) == list(range(len(order)))
    times = range(0, len(order) + 1, every)
    given, worst, at = dict.fromkeys(blocks, 0), 0, 0
    for t, shares in zip(times, exact_shares(blocks, weights, times)):
        for s in order[at:t]:
            given[s] += 1
        at = t
        worst = max(worst, max(abs(given[s] - shares[s]) for s in blocks))
    return worst


def test_mixing(spark, rows):
    d = docs(spark, rows)
    name = lambda s: mixing.NO_SOURCE if s is None else s
    sizes = collections.Counter(name(r.source) for r in d.collect())
    blocks = {s: -(-n // 4) for s, n in sizes.items()}
    weights = {s: {"s0": 5.0}.get(s, 1.0) for s in sizes}
    slots = brute_mix(blocks, weights)
    assert lag(slots, blocks, weights) < 1
    for period in (3, 8, 64):
        got = mixing.mixed(d, {"s0": 5.0, "s1": 1.0}, block=4, period=period).collect()
        assert sorted(r.mix_position for r in got) == list(range(len(rows)))
        assert set(d.columns) < set(got[0].asDict())
        assert all(r.mix_slot == slots[name(r.source), r.mix_block] for r in got)
        by_place = sorted(got, key=lambda r: r.mix_position)
        assert [r.mix_slot for r in by_place] == sorted(r.mix_slot for r in got)
        assert collections.Counter((name(r.source), r.mix_block) for r in got) == collections.Counter({(s, j): min(4, n - 4 * j) for s, n in sizes.items() for j in range(-(-n // 4))})
    again = mixing.mixed(d.repartition(7), {"s0": 5.0, "s1": 1.0}, block=4, period=64).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "", r.mix_position)
    assert sorted(map(key, got)) == sorted(map(key, again))
    with pytest.raises(Exception, match="positive"):
        mixing.mixed(d, {"s0": 0.0}).collect()


@pytest.mark.parametrize(("blocks", "period", "weights"), [(10, 1 << 17, {"a": 1.0, "b": 1.0, "c": 1.0}), (690, 1 << 17, {"a": 7.3, "b": 2.1}), (690, 64, {"a": 7.3, "b": 2.1}), (690, 16, {"a": 0.01}), (100_000, 1 << 17, {"a": 7.3, "b": 2.1}), (100_000, 1 << 13, {"a": 1000.0, "b": 3.0})])
def test_a_mix_stays_within_one_block_of_the_target_weights(spark, blocks, period, weights):
    """Not a rule of the operator's own but the exact shares: also after sources run dry, with many sources of little weight."""
    names = ["a", "b", *(f"s{i}" for i in range(min(30, blocks // 20)))] if blocks > 10 else ["a", "b", "c"]
    held = {s: blocks // len(names) + (blocks % len(names) if s == "a" else 0) for s in names}
    every = {s: weights.get(s, 1.0 / (1 + n % 7)) for n, s in enumerate(names)}
    rows = spark.createDataFrame([(s, n) for s, n in held.items()], "source string, n long").select("source", F.explode(F.sequence(F.lit(1), "n")).alias("hash"))
    got = mixing.placed(rows, spark.createDataFrame(list(every.items()), "source string, weight double"), block=1, period=period)
    slots = {(s, j): t for s, j, t in got.select("source", "mix_block", "mix_slot").toPandas().itertuples(index=False)}
    assert len(slots) == blocks and lag(slots, held, every, max(1, blocks // 5000)) < 1


def test_other_weights_give_another_mix(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), F.col("id").alias("hash"))
    first = lambda w: mixing.placed(rows, spark.createDataFrame([("a", w), ("b", 1.0)], "source string, weight double")).where("mix_slot < 40 AND source = 'a'").select("mix_slot").distinct().count()
    assert all(abs(first(w) - 40 * w / (1 + w)) < 1 for w in (0.1, 1.0, 3.0))


def test_mixing_of_very_many_sources_and_of_rows_without_ids(spark):
    many = spark.range(30000).selectExpr("cast(null as long) doc_id", "concat('t', id) text", "concat('s', if(id % 3 = 0, 0, id % 12000)) source")
    got = mixing.mixed(many, mixing.tempered(many)).toPandas()
    assert sorted(got.mix_position) == list(range(30000)) and got.source.nunique() > 7000
    hot = got[got.source == "s0"]
    assert len(hot) == 10000 and hot.mix_slot.nunique() == 625
    # by its weight of 631 it is due less than a tenth of the first slots, in which the small sources stand as well
    early = (hot.drop_duplicates("mix_slot").mix_slot < 4096).sum()
    assert 0 < early < 625


def brute_topk(vec, k=20, every=20):
    held = [(i, [int(64 * float(x) // 1) for x in v]) for i, v in vec if i is not None and v is not None and not any(x is None or x != x or abs(x) == float("inf") for x in v)]
    want = []
    for a, (i, q) in enumerate(held):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(held) if a != b and len(v) == len(q))
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(want)


def test_topk(spark):
    rng = random.Random(4)
    vec = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(150)] + [(i, [0.5] * 6) for i in range(150, 190)]
    vec += [(500, None), (501, [1.0, None, 0, 0, 0, 0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6), (40, [9.0] * 6), (41, [0.25] * 6), (41, [0.25] * 6), (600, [1.0, 2.0]), (620, [1e9, 1.0, 0, 0, 0, 0]), (-20, [0.0] * 6)]
    frame = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 1) for i, v in vec], "vec_id long, embedding array<double>, rank int")
    want = brute_topk(vec)
    for options in ({"chunk": 32}, {}, {"chunk": 8, "block_bytes": 200}):
        assert sorted(tuple(r)[:4] for r in topk.search(frame, **options).collect()) == want
    few = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [5.0, 5.0])]
    assert sorted(tuple(r)[:4] for r in topk.search(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect()) == [(0, 1, 1, 64 * 64 * 15), (0, 2, 1, 64 * 64 * 5)]
    huge = spark.createDataFrame([(0, [1e300]), (1, [-1e300]), (2, [1e12]), (3, [1e-3])], "vec_id long, embedding array<double>")
    assert [tuple(r)[1:4] for r in topk.search(huge).orderBy("rank").collect()] == [(1, 2, topk.LARGEST), (2, 3, 0), (3, 1, -topk.LARGEST)]


def test_topk_prunes_what_cannot_win():
    import numpy as np

    rng = np.random.default_rng(6)
    centres = rng.integers(-60, 60, (40, 16))
    rows = (np.repeat(centres, 100, axis=0) + rng.integers(-3, 4, (4000, 16))).astype(np.int64)
    best = topk.Best(rows[::97], np.arange(4000)[::97], 20)
    for a in range(0, 4000, 1000):
        best.add(np.arange(a, a + 1000), np.arange(a, a + 1000), rows[a : a + 1000], block=50)
    assert best.scored < 0.3 * best.seen
    for q, row in enumerate(range(0, 4000, 97)):
        score = rows @ rows[row]
        score[row] = topk.NONE
        assert best.row[q].tolist() == np.lexsort((np.arange(4000), -score))[:20].tolist()


def test_pii(spark):
    rows = [(1, "mail a.b@x.org, ip 10.0.0.256 and 10.0.0.25 card 4111 1111 1111 1111 call +90 (312) 555-1234."), (2, None), (3, ""), (4, "clean text, nothing here"), (1, "é漢 z@q.de z@q.de"), (None, "a@b.c@d.e 1.2.3.4.5.6.7.8")]
    frame = docs(spark, rows)
    got = collections.defaultdict(list)
    for r in pii.detected(frame).collect():
        got[r.doc_id].append(r)

    def base(t):
        spans = [(k, *m.span()) for k, p in ((0, pii.EMAIL), (3, pii.PHONE)) for m in p.finditer(t)]
        spans += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        spans += [(2, *m.span()) for m in pii.CARD.finditer(t) if 13 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
        return sorted(spans)

    for d, t in rows:
        spans = base(t or "")
        digest = hashlib.sha256(pii.written(spans).encode()).hexdigest()
        row = next(r for r in got[d] if r.base_sha256 == digest)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k in range(4)]
        assert set(filter(None, pii.written(spans).split(","))) <= set(filter(None, row.spans.split(",")))
    assert got[4][0].spans == ""
    masked = {(r.doc_id, r.text is None): r.text for r in pii.masked(frame).where("doc_id <> 1").collect()}
    assert masked[2, True] is None and masked[4, False] == rows[3][1]


def personal(rng):
    """A text with mentions of all kinds and numbers that are none."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    card = next(c for c in iter(lambda: "4" + digits(15), None) if pii.luhn(c))
    made = [f"{name()}.{name()}@{name()}.org", ".".join(str(rng.randrange(256)) for _ in range(4)), " ".join(card[i : i + 4] for i in range(0, 16, 4)), f"+{rng.randrange(1, 99)} {digits(3)} {digits(3)} {digits(4)}"]
    made += [digits(4), digits(10), f"{digits(3)}-{digits(2)}", f"{digits(2)}.{digits(2)}"]
    return " ".join(f"{prose(rng, rng.randrange(3, 9)).replace('w', 'wo').translate(str.maketrans('0123456789', 'abcdefghij'))} {m}" for m in rng.sample(made, rng.randrange(2, 7)))


@pytest.fixture(scope="module")
def pii_weights(spark):
    rng = random.Random(21)
    return pii.fitted(spark.createDataFrame([(i, personal(rng)) for i in range(500)], "doc_id long, text string"))


def test_pii_field_finds_what_the_rules_miss(pii_weights):
    """Mentions cut, or written in another way, that the fit has not seen: most are found, and little else is."""
    rng, right, missed, wrong = random.Random(22), 0, 0, 0
    for _ in range(400):
        text, planted = pii.learned_from(personal(rng), rng)
        base, every = pii.spans_of(text, pii_weights)
        new = [s for s in every if s not in base]
        hit = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
        hard = [p for p in planted if not any(p[1] < e and s < p[2] for _, s, e in base)]
        found = [any(hit(p, s) for s in new) for p in hard]
        right, missed = right + sum(found), missed + found.count(False)
        wrong += sum(not any(hit(p, s) for p in hard) for s in new)
    assert right / (right + missed) > 0.85 and right / (right + wrong) > 0.95, (right, missed, wrong)
    # without links the same mentions are nothing
    alone = dict(pii_weights, skip=pii_weights["skip"] * 0)
    assert pii.spans_of("write jo.smith@example.org now, as jo.smith@example is cut", alone)[1] == [(0, 6, 26)]


def test_pii_field_on_single_texts(pii_weights):
    new = lambda text: [(pii.KINDS[k], text[a:b]) for k, a, b in pii.spans_of(text, pii_weights)[1] if (k, a, b) not in pii.ruled(text)]
    assert new("mail jo.smith@example.org today, since jo.smith@example is cut") == [("email", "jo.smith@example")]
    assert new("call +90 312 555 1234 or 312 555 1234 before 2024") == [("phone", "312 555 1234")]
    assert new("no mention of 312 555 1234 elsewhere, or of 42") == [] and new("only jo.smith@example stands here") == []
    # every mention has it, however far from the evidence
    text = "pay by 4111 1111 1111 1111 " + "and then some words and 4111.1111.1111.1111 again " * 30
    assert new(text) == [("card", "4111.1111.1111.1111")] * 30


def test_links_grow_with_the_text(spark):
    words = ["12345678"] * 500 + ["1234567"] * 500 + ["jo@x.org", "jo@x"] * 300
    edges, nodes = pii.linked(words)
    assert len(edges) <= 2 * len(words) and nodes <= 2 * len(words)


def test_quality(spark):
    rng = random.Random(3)
    good = [(i, ". ".join(prose(rng, 9, 3000) for _ in range(8)) + ".") for i in range(200)]
    bad = [(i, " ".join(f"{w}###" for w in prose(rng, 60).split())) for i in range(200, 300)]
    rows = [*good, *bad, (900, None), (901, ""), (None, "x"), (0, good[0][1])]
    labels = spark.createDataFrame([(i, 1 if i < 200 else 0, 0) for i in range(300)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, words int")
    got = quality.scored(docs(spark, rows), labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == int(r.doc_id < 200) for r in held if r.doc_id < 300)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    kept = quality.accepted(docs(spark, rows), labels)
    assert kept.columns == docs(spark, rows).columns and not any(200 <= (r.doc_id or 0) < 300 for r in kept.collect())
    none = quality.scored(docs(spark, rows[:3]), labels.limit(0)).collect()
    assert len(none) == 3 and {r.score for r in none} == {0.5}


def test_empty_tables(spark):
    none = docs(spark, [(1, "x")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    some = docs(spark, [(1, "a b c d e f")])
    assert jaccard.near_duplicates(none).count() == jaccard.deduplicated(none).count() == 0
    assert passages.repeats(none).count() == passages.repeats(some).count() == 0
    assert decontaminate.report(none, items).count() == 0 and [r.contaminated for r in decontaminate.report(some, items).collect()] == [False]
    assert tokens.counted(none, pieces=([b"a"], [b"b"])).count() == licenses.scanned(none).count() == pii.detected(none).count() == mixing.mixed(none, {}).count() == mixing.mixed(none, mixing.tempered(none)).count() == 0
    assert quality.scored(none, labels).count() == quality.accepted(none, labels).count() == pii.masked(none).count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert F.lit(1) is not None
