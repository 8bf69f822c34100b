import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wireflow.llm.common import table, weighted_cuts
from wireflow.llm.exact_dedup import exact_dedup, keep_one
from wireflow.llm.host_rules import host_rules, keep_good
from wireflow.llm.mixing import mix, mixed_documents, op9_mix_sources, targets
from wireflow.llm.packing import Encoder, differenced, pack_documents, windows
from wireflow.llm.pii import personal_data
from wireflow.llm.sharding import kd_shards
from wireflow.llm.url_filter import suffix_and_domain, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid int, t int, kept string"
ODD = [(1, None, "en", "a", 0, 1, 1, "x"), (2, "", "en", "a", 0, 1, 1, "x"), (3, "a b c d e f g h i j k", None, None, 9, 1, 1, "x"), (3, "a b c d e f g h i j k", None, None, 9, 1, 1, "x"),
       (None, "a b c d e f g h i j k", "fr", "b", 9, 1, 1, "x"), (7, "w " * 30000, "fr", "b", 9, 1, 1, "x"), (8, "é\n\x00\n é \n x" * 3, "fr", "b", 9, 1, 1, "x"), (9, "\n", "fr", "", 1, 1, 1, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    for f in (exact_dedup, host_rules, mix, pack_documents, personal_data, kd_shards):
        assert f(empty).count() == 0
    for f in (keep_one, keep_good, mixed_documents):
        assert f(empty).columns == empty.columns and f(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter(pages, spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_exact(odd):
    rows = exact_dedup(odd).collect()
    assert len(rows) == len(ODD) and sum(r.kept for r in rows) == len({d[1] or "" for d in ODD})
    group = [r for r in rows if r.group_size == 3]
    assert len(group) == 3 and {r.keep_id for r in group} == {3} and sum(r.kept for r in group) == 1
    assert {r.keep_id for r in rows if r.doc_id in (1, 2)} == {2}
    assert sorted(r.text or "" for r in keep_one(odd).collect()) == sorted({d[1] or "" for d in ODD})


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    gone = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            gone |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(gone)


def test_rules_brute(spark, sf, odd):
    for docs in (odd, table(spark, sf, "documents")):
        want = Counter((r.doc_id, *base(r.text)) for r in docs.collect())
        rows = host_rules(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in rows)


def test_host_rejected(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(20)), f"s{i % 5}") for i in range(500)]
    bad = [(1000 + i, "too short", "spam") for i in range(95)] + [(2000 + i, " ".join(f"v{i}x{j}" for j in range(20)), "spam") for i in range(5)]
    rows = host_rules(spark.createDataFrame(good + bad, "doc_id long, text string, source string")).collect()
    assert all(r.kept for r in rows if r.doc_id < 1000) and not any(r.kept for r in rows if r.doc_id >= 1000)


def test_targets(spark):
    sources = [("a", 10), ("b", 1000), ("c", 500), ("d", 100), ("é", 5), (None, 3), ("z", 0)]
    rows = {r.source: r for r in targets(spark.createDataFrame(sources, "source string, source_size long")).collect()}
    order = ["a", "b", "c", "d", "z", "é", None]
    size, weight = dict(sources), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, total = {}, sum(size.values())
    while True:
        left, shares = total - sum(want.values()), sum(weight[s] for s in order if s not in want)
        over = [s for s in order if s not in want and left * weight[s] / shares > 3 * size[s]]
        if not over:
            break
        want |= {s: 3.0 * size[s] for s in over}
    want |= {s: left * weight[s] / shares for s in order if s not in want}
    assert all(abs(rows[s].target - want[s]) < 1e-6 for s in order)


def test_mix(spark, sf, odd):
    docs = table(spark, sf, "documents")
    rows = op9_mix_sources(spark, sf).collect()
    text = {r.doc_id: r for r in docs.collect()}
    taken, most = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(WORD.findall(text[r.doc_id].text or "")) and r.taken in [k * r["size"] for k in range(4)]
        taken[text[r.doc_id].source] += r.taken
        most[text[r.doc_id].source] = max(most[text[r.doc_id].source], r["size"])
    goal = {text[r.doc_id].source: r.target for r in rows}
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in goal)
    assert sorted(map(tuple, op9_mix_sources(spark, sf).collect())) == sorted(map(tuple, rows))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(taken.values())
    assert mix(odd).count() == len(ODD)


def test_cuts_are_exact(spark):
    r = np.random.default_rng(2)
    rows = [(g, int(k), int(w)) for g in ("a", None) for k, w in zip(r.integers(0, 2**60, 300), r.integers(0, 50, 300))]
    rows += [("a", 5, 10**6), ("b", 2**60 - 1, 7), ("c", 0, 0)]
    goals = [("a", 1_001_000.5), (None, 3000.0), ("b", 3.0), ("c", 0.0), ("none", 1.0)]
    got = {x.g: x.cut for x in weighted_cuts(spark.createDataFrame(rows, "g string, key long, w long"), spark.createDataFrame(goals, "g string, budget double"), "t").collect()}
    for g, goal in goals[:4]:
        own = sorted((k, w) for h, k, w in rows if h == g)
        sums = np.cumsum([0] + [w for _, w in own])
        below = sum(w for k, w in own if k < got[g])
        assert abs(below - goal) == min(abs(s - goal) for s in sums)


def test_shards(spark, sf, odd):
    for docs, n in ((table(spark, sf, "documents"), 16), (odd, 16)):
        rows = kd_shards(docs, n_shards=n).collect()
        assert len(rows) == docs.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = sorted((r["size"], r.text_crc32) for r in rows)
        assert sizes == sorted((len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs.collect())
        assert all(len({x.shard for x in rows if x.text_crc32 == c}) == 1 for c in {r.text_crc32 for r in rows})
    rows = kd_shards(table(spark, sf, "documents")).collect()
    sums = Counter()
    for r in rows:
        sums[r.shard] += r["size"]
    assert len(sums) == 16 and max(sums.values()) - sum(sums.values()) / 16 <= 2 * max(r["size"] for r in rows)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans(text):
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if fine(k, m.group())]
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(found))


def test_personal_data_brute(spark, sf):
    texts = [None, "", "a@b.c_d@e.f", "x@y._z@q.r 1.2.3.4.5.6.7.8 256.1.1.1 00255.0.0.01", "😀 4465758382889437 4465-7583-8288-9437 +1 (743) 555-3824. +12", "%%a@b..c a@b.c@d.e", "+1+2345678901 +1234567890", "9" * 3000 + "@" + "a." * 2000, "1." * 20000, "q@" * 10000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(table(spark, sf, "documents").selectExpr("doc_id + 1000", "text"))
    for r, d in zip(sorted(personal_data(docs).collect(), key=lambda r: r.doc_id), sorted(docs.collect(), key=lambda r: r.doc_id)):
        want = spans(d.text)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in PATTERNS]


def learned_by_hand(texts):
    """The bootstrapping of contexts in plain Python: {(document, kind, start, end)} of the learned spans."""
    from math import exp, log

    from wireflow.llm.pii import LENGTHS, MIN_SCORE, MIN_SUPPORT, SHAPE_WEIGHT

    edge = "\"'.,;:!?()[]{}<>"
    seen = []
    for doc, t in enumerate(texts):
        runs, last = [], None
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t or ""):
            has = bool(re.search("[0-9@]", m.group()))
            if has and last and m.start() == last[1] + 1 and t[last[1]] == " ":
                last[1] = m.end()
            elif has:
                last = [m.start(), m.end()]
                runs.append(last)
            else:
                last = None
        for n, (a, b) in enumerate(runs):
            core = t[a:b].strip(edge)
            if not LENGTHS[0] <= len(core) <= LENGTHS[1]:
                continue
            start = a + len(t[a:b]) - len(t[a:b].lstrip(edge))
            left = [w for w in re.split(r"[\x20\x09-\x0D]+", t[runs[n - 1][1] if n else 0 : a].lower()) if w][-2:]
            right = [w for w in re.split(r"[\x20\x09-\x0D]+", t[b : runs[n + 1][0] if n + 1 < len(runs) else len(t)].lower()) if w]
            kinds = [x.split(":")[0] for x in spans(core).split(",")]
            kind = next((k for k in PATTERNS if k in kinds), None)
            shape = re.sub("[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", core))
            patterns = [f"2 {' '.join(left)}"] * (len(left) == 2) + [f"1 {left[-1]}" for _ in left[:1]] + [f"> {right[0]}" for _ in right[:1]] + [f"# {shape}"]
            seen.append((doc, start, core, kind, patterns))
    edges = defaultdict(set)
    for _, _, core, _, patterns in seen:
        for p in patterns:
            edges[p].add(core)
    known = {core: kind for _, _, core, kind, _ in seen if kind}
    fresh = {core for _, _, core, kind, _ in seen if not kind}
    while True:
        doubt = defaultdict(float)
        for p, cores in edges.items():
            for kind, k in Counter(known[c] for c in cores if c in known).items():
                if k >= MIN_SUPPORT:
                    conf = (SHAPE_WEIGHT if p[0] == "#" else 1.0) * k / (len(cores) + 1)
                    for c in cores & fresh:
                        doubt[c, kind] += log(1 - conf)
        best = {}
        for (c, kind), x in doubt.items():
            if round(1 - exp(x), 9) >= MIN_SCORE:
                best[c] = max(best.get(c, (0, "")), (round(1 - exp(x), 9), kind))
        new = {c: b[1] for c, b in best.items() if c not in known}
        if not new:
            break
        known |= new
    return {(doc, known[core], start, start + len(core)) for doc, start, core, kind, _ in seen if not kind and core in known}


def learned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = set()
    for r in personal_data(docs).collect():
        every = Counter(r.spans.split(",")) - Counter(spans(texts[r.doc_id]).split(","))
        out |= {(r.doc_id, k, int(a), int(b)) for k, a, b in (x.split(":") for x in every if x)}
    return out


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"please write to user{i}@host{i}.example today" for i in range(20)] + [f"call me at +49 171 23456{i:02d} or later" for i in range(20)]
    good = [c for c in (str(4465758382889400 + i) for i in range(100)) if spans(c) == "card:0:16"]
    texts += [f"my card number {c} is here" for c in good]
    unseen = {"please write to user90@localhost today": "email", "please write to user91@localhost today": "email", "call me at 0171-2345678 or later": "phone",
              "my card number 4111111111111112 is here": "card", "my card number 4465 7583 8288 9438 is here": "card"}
    clean = ["please write to nobody today", "the order 20240817-A arrived late", "call me at eight or later", "room 12345678 was empty", "see page 1234-5678 there"]
    # found in the second turn: the context is of strings that the first turn accepts
    chain = [f"please write to box{i}@localhost now" for i in range(4)] + [f"ping box{i}@localhost again" for i in range(4)] + ["ping box9@elsewhere again"]
    base = len(texts)
    got = learned(spark, texts + [*unseen] + clean + chain)
    at = {d: k for d, k, _, _ in got}
    assert [at.get(base + i) for i in range(len(unseen))] == list(unseen.values())
    assert not any(d in at for d in range(base)) and not any(base + len(unseen) + i in at for i in range(len(clean)))
    assert (base, "email", 16, 32) in got
    assert all(at.get(base + len(unseen) + len(clean) + i) == "email" for i in range(len(chain)))
    assert got == learned_by_hand(texts + [*unseen] + clean + chain)


def test_precision_and_recall_of_learned_spans(spark):
    """Identifiers that no base pattern matches, planted in 6 contexts among words and numbers that are no identifiers."""
    import random

    r = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    contexts = [("email", "write to", "today"), ("email", "contact address", "please"), ("phone", "call us", "anytime"), ("phone", "mobile no", "thanks"), ("ip", "login from", "refused"), ("card", "card number", "expired")]
    new = {"email": lambda: f"u{r.randrange(10**4)}@intranet", "phone": lambda: f"0{r.randrange(100, 999)}-{r.randrange(10**6, 10**7)}", "ip": lambda: f"fe80::{r.randrange(16**4):x}:{r.randrange(16**4):x}:1", "card": lambda: f"{r.randrange(10**3, 10**4)}-xxxx-xxxx-{r.randrange(10**3, 10**4)}"}
    seed = {"email": lambda: f"u{r.randrange(10**4)}@mail{r.randrange(9)}.example", "phone": lambda: f"+49 {r.randrange(100, 999)} {r.randrange(10**6, 10**7)}", "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)), "card": lambda: next(c for c in iter(lambda: str(r.randrange(10**15, 10**16)), None) if spans(c) == "card:0:16")}
    noise = [lambda: f"{r.randrange(10**8, 10**10)}", lambda: f"2024-{r.randrange(10, 13)}-{r.randrange(10, 29)}", lambda: f"item{r.randrange(10**5)}x{r.randrange(10**4)}"]
    texts, planted = [], set()
    for i in range(900):
        part = [r.choice(words) for _ in range(r.randrange(4, 30))]
        at = r.randrange(len(part))
        kind, before, after = r.choice(contexts)
        what = r.choice([seed, seed, new, None])
        put = [*before.split(), what[kind](), after] if what else [r.choice(noise)()]
        text = " ".join([*part[:at], *put, *part[at:]])
        if what is new:
            start = text.index(put[-2])
            planted.add((i, kind, start, start + len(put[-2])))
        texts.append(text)
    got = learned(spark, texts)
    assert got == learned_by_hand(texts)
    assert len(got & planted) / len(planted) >= 0.95 and len(got & planted) / len(got) >= 0.95


def test_learned_spans_of_the_table(spark, sf):
    texts = [r.text for r in table(spark, sf, "documents").collect()]
    assert learned(spark, texts) == learned_by_hand(texts)


def test_packing(spark, sf, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (table(spark, sf, "documents"), odd):
        pieces = pack_documents(docs).toPandas()
        own = defaultdict(list)
        for d in docs.collect():
            own[-1 if d.doc_id is None else d.doc_id].append(np.array(tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
        for doc, part in pieces.fillna(-1).groupby("doc_id"):
            copies = own[doc]
            assert part.length.sum() == sum(len(c) // 4 for c in copies)
            for p in part.itertuples():
                assert any(zlib.crc32(c[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 and len(c) // 4 == p.doc_tokens for c in copies)
        for _, s in pieces.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
        if docs is not odd:
            used = pieces.groupby("sequence_id").length.sum()
            padding = sum(1024 - n for n in used if n & (n - 1))
            assert padding <= 0.02 * used.sum()


def test_differencing():
    # by hand: 8 - 7 = 1, 6 - 5 = 1, 4 - 1 = 3, 3 - 1 = 2
    assert sorted(sum((8, 7, 6, 5, 4)[i] for i in s) for s in differenced([8, 7, 6, 5, 4], 2)) == [14, 16]
    r = np.random.default_rng(3)
    sizes = r.integers(1, 257, 600).tolist()
    sets = differenced(sizes, 75)
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert sorted(i for s in sets for i in s) == list(range(600)) and max(sums) - min(sums) <= 12
    assert all(sum(sizes[i] for i in s) <= 1024 for s in windows(sizes, 1024)) and len(windows(sizes, 1024)) <= -(-sum(sizes) // 1024) * 1.03 + 1
    assert windows([1024], 1024) == [[0]]


def test_chunks_are_words():
    import public_tokenizers

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ["  a  b \n c  ", " x\u00a0y", " ", "a\x1c b", "\n\n a", "x  y z  ", "don't  's 12 3%% \t\tq", "<|endoftext|> a", "", "é" * 5000]:
        assert e([t])[0] == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_urls(spark):
    rows = [(1, "http://A.Example.ORG/es/x?q"), (2, "https://x.example.org/en/17"), (3, "https://org/"), (4, "https://a.com/fr/"), (5, "https://a.com/de/1#x"), (6, None), (7, "no scheme"), (8, "https://myorg/x"), (9, "a://b://c/d"), (10, "http://x.org")]
    rows += [(100 + i, f"https://bad.net/{i}") for i in range(40)] + [(200 + i, f"https://fine.net/{i}") for i in range(40)]
    bad = [(100 + i, 1) for i in range(40)] + [(200 + i, int(i == 0)) for i in range(40)]
    got = {r.page_id: r for r in url_filter(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(1, 11)] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("x.example.org", "/en/17", "example.org/en/1"), ("org", "/", "org/"), ("a.com", "/fr/", "com/fr/"), ("a.com", "/de/1", "com/de/"),
        ("", "", None), ("", "", None), ("myorg", "/x", None), ("b:", "//c/d", None), ("x.org", "", None)]
    assert [got[i].verdict for i in range(1, 6)] == ["block", "block", "allow", "allow", "block"]
    assert got[100].verdict == "block" and got[205].verdict == "allow"
    s, d = suffix_and_domain("h")
    assert [tuple(r) for r in spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.y.com",), ("com",), ("",)], "h string").select(s, d).collect()] == [("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("com", "y.com"), ("com", "com"), ("", "")]


def test_urls_odd(spark):
    """Repeated rows are judged each; of tied outcomes the bad one counts; a long url is read whole; other columns do not matter."""
    long = "http://long.test/" + "x" * 200_000 + "?q"
    pages = [(1, "http://bad.example/1", "a", "b")] * 2 + [(i, f"http://bad.example/{i}", "a", "b") for i in range(2, 40)] + [(90, long, None, ""), (None, "http://bad.example/n", "", "")]
    pages += [(100 + i, f"http://long.test/{i}", "a", "b") for i in range(40)]
    outcomes = [(i, b) for i in range(1, 40) for b in (0, 1, 1)] + [(100 + i, 0) for i in range(40)]
    rows = url_filter(spark.createDataFrame(pages, "page_id long, url string, host string, rate string"), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()
    assert len(rows) == len(pages) and sum(r.page_id == 1 for r in rows) == 2
    assert all(r.verdict == ("block" if r.host == "bad.example" else "allow") for r in rows)
    assert next(r for r in rows if r.page_id == 90).path == "/" + "x" * 200_000


def test_very_long_texts(spark):
    """Whole texts count: they differ in their last word alone."""
    long = "word " * 400_000
    docs = spark.createDataFrame([(1, long + "a", "s"), (2, long + "b", "s"), (3, long + "a", "s"), (4, "x", "t")], "doc_id long, text string, source string")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(docs).collect()} == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}
    assert {r.doc_id: r["size"] for r in mix(docs).collect()} == {1: 400_001, 2: 400_001, 3: 400_001, 4: 1}
    assert {r.doc_id: r["size"] for r in kd_shards(docs.withColumn("lang", docs.source)).collect()} == {1: 2_000_002, 2: 2_000_002, 3: 2_000_002, 4: 2}
    rules = {r.doc_id: r for r in host_rules(docs).collect()}
    assert rules[1].n_words == 400_001 and rules[1].n_repeat_words == 400_000 and rules[1].base_failed
    mail = "write to " + "me " * 300_000 + "a@b.example now"
    (row,) = personal_data(spark.createDataFrame([(1, mail)], "doc_id long, text string")).collect()
    assert row.spans == f"email:{len(mail) - 15}:{len(mail) - 4}"


def test_kept_rows_keep_their_columns(spark, odd):
    """Clashing names, repeats and ties: what is kept are rows of the table, whole."""
    rows = Counter(map(str, odd.collect()))
    for f in (keep_one, keep_good):
        out = f(odd)
        assert out.columns == odd.columns and not Counter(map(str, out.collect())) - rows
    out = mixed_documents(odd)
    assert out.columns == odd.columns and set(map(str, out.collect())) <= set(rows)
    clash = odd.withColumnRenamed("t", "__rid").withColumnRenamed("kept", "start")
    assert keep_one(clash).count() == keep_one(odd).count()
    assert {r.doc_id: r.spans for r in personal_data(clash.withColumn("found", clash.text)).collect()}[8] == ""


def test_shards_brute(spark, sf):
    """The k-d tree by hand: the same weighted medians, the same shards."""
    from math import floor, log

    docs = table(spark, sf, "documents").collect()
    groups = defaultdict(list)
    for d in docs:
        groups[hashlib.sha256((d.text or "").encode()).hexdigest()].append(d)
    unit = lambda x: 0.0 if x is None else zlib.crc32(x.encode()) / 2.0**32
    least = lambda v: min((x for x in v if x is not None), default=None)
    rows = []
    for digest, own in groups.items():
        sizes = [len((d.text or "").encode()) + 1 for d in own]
        rows.append((digest, int(digest[:10], 16), sum(sizes), (log(max(sizes)) / log(2) / 40, unit(least(d.source for d in own)), unit(least(d.lang for d in own)))))
    want = {}

    def split(rows, lo, n):
        if n == 1:
            want.update({r[0]: lo for r in rows})
            return
        spread = [max(r[3][i] for r in rows) - min(r[3][i] for r in rows) for i in range(3)]
        axis = spread.index(max(spread))
        key = lambda r: (min(floor(r[3][axis] * 2**20), 2**20 - 1) << 40) + r[1]
        budget, run, cut = sum(r[2] for r in rows) * (n // 2) / n, 0, None
        by_key = Counter()
        for r in rows:
            by_key[key(r)] += r[2]
        for k in sorted(by_key):
            if run <= budget < run + by_key[k]:
                cut = k + 1 if run * 2 + by_key[k] <= budget * 2 else k
            run += by_key[k]
        split([r for r in rows if key(r) < cut], lo, n // 2)
        split([r for r in rows if key(r) >= cut], lo + n // 2, n - n // 2)

    split(rows, 0, 16)
    got = {r.doc_id: r.shard for r in kd_shards(table(spark, sf, "documents")).collect()}
    assert got == {d.doc_id: want[hashlib.sha256((d.text or "").encode()).hexdigest()] for d in docs}
