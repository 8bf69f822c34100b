"""Spelling variants, toxicity and conversation repair against brute force and held-out labels."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from wireflow.llm import conversations as cv
from wireflow.llm import spelling, toxicity


# spelling
def spelled(rows):
    """{word: (form, root, n, n_near, form_n)} by comparing every word with every other."""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(around[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(around[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def variants(df, **how):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df, **how).collect()}


def some_texts(seed, n_docs=60):
    r = random.Random(seed)
    base = ["".join(r.choice("etaoxé") for _ in range(r.randint(4, 7))) for _ in range(80)] + ["Straße", "ÀÉÈ×÷ÿ", "ab", "aaaaab", "aaaaba"]
    return [(i, " ".join(r.choice(base) if r.random() < 0.9 else r.choice(base)[:-1] + r.choice("eta") for _ in range(120))) for i in range(n_docs)]


@pytest.mark.parametrize("shard", [1 << 17, 20])
def test_variants_against_brute_force(spark, shard):
    rows = some_texts(3)
    got = variants(spark.createDataFrame(rows, "doc_id long, text string"), shard=shard, searched=shard)
    want = spelled(rows)
    assert got == want and sum(v[0] is not None for v in want.values()) > 20


def test_roots_follow_all_forms(spark):
    words = ["abcdefgh"] * 120 + ["abcdefgi"] * 50 + ["abcdefji"] * 22 + ["abcdekji"] * 9 + ["abcdlkji"] * 4
    rows = [(i, w) for i, w in enumerate(words)]
    want = spelled(rows)
    assert variants(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert {v[1] for v in want.values()} == {"abcdefgh"}


def test_variants_of_odd_tables(spark):
    long = "wörter " * 200_000 + "x" * 300_000 + " " + ("y" * 300_000 + " ") * 3
    rows = [(None, None, "n"), (1, "", "n"), (2, "!? 12 ..", "n"), (None, "alpha beta gamma alpha", "n"), (3, "alpha alpha alphas Alphas ALPHAS", "n"), (3, "alpha alpha alphas Alphas ALPHAS", "n"), (4, long, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string").withColumnRenamed("word", "node")
    got = {w: v for w, v in variants(df).items() if len(w) < 100}
    want = {w: v for w, v in spelled([r[:2] for r in rows if r[0] != 4]).items()}
    assert {w: got[w] for w in want} == want and set(got) == {*want, "wörter"}
    assert variants(df.where("false")) == {}
    assert variants(spark.createDataFrame([(1, None)], "doc_id long, text string")) == {}


# toxicity
def toxic_rows(seed, n=600):
    r = random.Random(seed)
    plain = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = r.choices(plain, k=r.randint(5, 80))
        bad = r.random() < 0.2
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["Zounds", "knave!", "varlet" + r.choice(["s", "y", "ish", "ing"]), "(churl)"]))
        docs.append((i, " ".join(words), "src", 1))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_of_held_out_rows(spark):
    docs, labels = toxic_rows(5)
    extra = [(1000, None, "s", 1), (1001, "", "s", 1), (None, "Zounds knave varlets churl", "s", 1), (1002, " ".join(["abc"] * 100_000), "s", 1), (1003, docs[0][1], "s", 1), (1003, docs[0][1], "s", 1)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, score string, label int")
    y = spark.createDataFrame(labels + [(5, 0, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(d, y).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    assert len(out) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    for held in (False, True):
        own = [r for r in out if r.doc_id in truth and r.held_out == held]
        assert sum(r.predicted == truth[r.doc_id] for r in own) >= 0.97 * len(own) and len(own) > 100
    assert got[1000][0].score == got[1001][0].score and got[1000][0].predicted == 0
    assert got[None][0].predicted == 1 and got[1003][0].score == got[1003][1].score == got[0][0].score


def test_toxicity_learns_nothing_held_out(spark):
    """Turning the held-out labels round changes no score; without labels or documents nothing fails."""
    docs, labels = toxic_rows(6, 200)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string, label int")
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(d, spark.createDataFrame(x, schema)).collect()} for x in (labels, turned))
    assert a == b
    none = toxicity.toxicity(d, spark.createDataFrame([], schema)).collect()
    assert len(none) == 200 and not any(r.predicted for r in none)
    assert toxicity.toxicity(d.where("false"), spark.createDataFrame(labels, schema)).count() == 0


# conversations
def fixed(rows):
    """All edits of a conversation's rows (role, text) tried: (blank, duplicate, truncated, illegal, cost, audit, lines)."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    own = []
    for (role, text), fault in zip(rows, faults, strict=True):
        edits = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            edits += [("K", more, (role, text))] + [("R", 1 + more, (x, text)) for x in ("user", "assistant")]
        own.append(edits)
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for picks in itertools.product(*own):
        for before in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(c for _, c, _ in picks) + 5 * sum(map(len, before))
            if best and cost > best[0]:
                continue
            audit, lines = "", []
            for k in range(len(rows) + 1):
                audit += "I" * len(before[k])
                lines += [(x, "") for x in before[k]]
                if k < len(rows):
                    audit += picks[k][0]
                    lines += [picks[k][2]] if picks[k][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(x[:1] or "?" for x, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, *best


def after_damage(conv, rows):
    """The rows (turn, role, text) of a conversation after damage, in order."""
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out += [(turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def model(table):
    want = {}
    for conv in {r[0] for r in table}:
        rows = after_damage(conv, [r[1:] for r in table if r[0] == conv])
        turns = {t for t, *_ in rows} - {None}
        *counts, cost, audit, lines = fixed([r[1:] for r in rows])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        want[conv] = (gaps, *counts, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest())
    return want


def conversations(seed, n=35, most=4):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "system", None, "", "tool", "User"], ["Yes.", "No!", "well", None, "", " \t", "a. b", "Why?\n", "so?"]
    weights = [6, 6, 2, 0.3, 0.3, 0.5, 0.3]
    table = []
    for c in range(n):
        for t in range(r.randint(1, most)):
            table.append((c if c else None, r.choice([t, t, t, t, t + 3, None]), r.choices(roles, weights)[0], r.choice(texts)))
    return table


SCHEMA = "conv_id long, turn long, role string, text string"


def repairs(df, **how):
    return {r.conv_id: tuple(r)[1:] for r in cv.repair(df, **how).collect()}


def test_repair_against_all_edits(spark):
    table = conversations(1)
    df = spark.createDataFrame(table, SCHEMA).selectExpr("*", "1 as pos", "2 as cost")
    want = model(table)
    assert repairs(df) == want
    assert {x for v in want.values() for x in v[6]} == set('DKR'), 'a row that could be inserted for 5 is always dearer than one deleted for 2'
    assert repairs(df, most_rows=1) == want, "conversations that are cut into chunks"
    assert repairs(df.where("false")) == {}


def test_least_weights_are_least_words():
    """The integer minimum over random rows against all edits, and chunks joined against the whole."""
    r = random.Random(4)
    for _ in range(200):
        rows = [(r.choice(["user", "assistant", "system", "x"]), r.choice(["A.", "b", "", "C!"])) for _ in range(r.randint(0, 3))]
        seen, own = set(), []
        for role, text in rows:
            own.append((role[:1], "blank" if not text else "duplicate" if (role, text) in seen else "" if text[-1] in ".!" else "truncated"))
            seen.add((role, text))
        assert cv.cheapest(own) == tuple(fixed(rows)[4:6])


def test_long_conversations(spark):
    """A conversation that is cut into many chunks, joined in several rounds, is repaired like a whole one."""
    r = random.Random(9)
    table = [(7, t // 2 if t % 50 else None, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "no", "", f"t{t}.", f"u{t}!"])) for t in range(3000)]
    table += [(8, t, "user" if t % 2 else "assistant", f"x{t}.") for t in range(40)] + [(9, 1, "user", "Same.")] * 500
    df = spark.createDataFrame(table, SCHEMA)
    whole = repairs(df)
    before, cv.FAN = cv.FAN, 3
    try:
        rows = cv.damaged(df.withColumn("conv_id", df.conv_id)).withColumnRenamed("conv_id", "place")
        cut = {x.place: tuple(x)[1:] for x in cv.repaired_long(rows, most=16).collect()}
    finally:
        cv.FAN = before
    assert cut == whole
    assert len(whole[7][6]) > 2500 and whole[7][1] > 100
