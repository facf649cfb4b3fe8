"""Line dedup, near duplicates, quality rules, secrets and the pipeline against plain code."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from verdure.llm import line_dedup, near_dup, packing, quality, queries, secrets, textnum

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLS = "doc_id long, text string, lang string, source string, n_chars long, id long, own long, label string, size int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "x", 3) for i, t in rows], COLS)


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in queries.documents(spark, SF).collect()]


# ---- words -----------------------------------------------------------------


def test_words_and_shingles():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("aAbBÉé \t\n\x0b\x0c\r\x1c\xa0🙂", k=rng.randint(0, 40)))
        data = text.encode()
        starts, ends, h = textnum.words(data)
        found = [data[a:b].decode() for a, b in zip(starts, ends, strict=True)]
        assert found == WORDS.findall(text) and len(set(h.tolist())) == len(set(found))
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found]
        for k in (2, 5):
            want = {tuple(low[i : i + k]) for i in range(len(low) - k + 1)} or ({tuple(low)} if low else set())
            assert len(textnum.shingles(data, k)) == len(want)
    big = ("x" * 1_500_000 + " " + "word " * 300_000).encode()
    assert len(textnum.words(big)[0]) == 300_001 and len(textnum.shingles(big, 2)) == 2


# ---- line dedup ------------------------------------------------------------


def lines_by_hand(rows, min_tokens=5, similar=0.8):
    """{row number: text} by the documented rules."""
    where = []  # (id, text, pos, template)
    loose = set()
    for i, text in set(rows):
        for pos, line in enumerate([] if text is None else text.split("\n")):
            plain = re.sub("[ \t\x0b\x0c\r]+", " ", line).strip(" ")
            if not plain:
                continue
            tokens = plain.split(" ")
            variable = [bool(re.search("[0-9]", w)) for w in tokens]
            t = tuple(tokens)
            if len(tokens) >= min_tokens and 2 * sum(variable) <= len(tokens):
                t = tuple("<*>" if v else w for w, v in zip(tokens, variable, strict=True))
                loose.add(t)
            where.append(((i is not None, i or 0), text, pos, t))
    docs = defaultdict(set)
    for i, text, _, t in where:
        docs[t].add((i, text))
    nodes = defaultdict(list)

    def segments(t):
        n = len(t)
        parts = n - math.ceil(round(n * similar, 9)) + 1
        if parts > 1:
            cuts = [3 + i * (n - 3) // parts for i in range(parts + 1)]
            yield from ((n, t[:3], i, t[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))

    rank = lambda t: (-len(docs[t]), " ".join(t))
    for t in loose:
        for s in segments(t):
            nodes[s].append(t)
    tops = {s: min(own, key=rank) for s, own in nodes.items()}
    model = {}
    for t in loose:
        alike = [m for m in (tops[s] for s in segments(t)) if m != t and sum(a == b for a, b in zip(t, m, strict=True)) >= similar * len(t)]
        if alike:
            model[t] = min(alike, key=rank)
    groups = defaultdict(list)
    extra = defaultdict(list)
    for i, text, pos, t in where:
        groups[model.get(t, t)].append((i, text, pos))
        if t in model and t in model.values():
            extra[t].append((i, text, pos))
    drop = defaultdict(set)
    for t, own in groups.items():
        whole = own + extra[t]
        if len({(i, x) for i, x, _ in whole}) > 1:
            first = min(whole, key=lambda x: (x[0], x[2]))
            for i, text, pos in own:
                if (i, text, pos) != first:
                    drop[i, text].add(pos)
    out = []
    for i, text in rows:
        gone = drop[(i is not None, i or 0), text]
        out.append(None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone))
    return out


def test_line_dedup_against_plain_code_and_sql(spark):
    rows = documents(spark)
    got = {r["doc_id"]: r["text"] for r in queries.op1_line_dedup(spark, SF).collect()}
    assert got == dict(zip((i for i, _ in rows), lines_by_hand(rows), strict=True))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    assert sorted(c.sql(queries.SQL["op1_line_dedup"]).fetchall()) == sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in queries.op1_line_dedup(spark, SF).collect())


LONG = "passage of more than fifty words that stands in two documents " * 6
LINES = [(1, f"own first line of one\n{LONG}\nuser 17 logged in at 10:33 from home"), (2, f"{LONG}\nuser 99 logged in at 11:20 from home\nquite another line of text"), (3, None), (4, ""), (5, "short\nshort"), (6, "short"), (7, "1 2 3 4 5 6\n"), (8, "1 2 3 4 5 6"), (9, "again this very line here\nagain this very line here")]


def test_line_dedup_edges(spark):
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(table(spark, LINES), counts=True).collect()}
    assert {i: r["text"] for i, r in got.items()} == dict(zip((i for i, _ in LINES), lines_by_hand(LINES), strict=True))
    assert got[2]["text"] == "quite another line of text" and got[2]["n_chars"] == 26 and got[2]["n_dropped"] == 2 and got[9]["n_dropped"] == 0
    assert (got[3]["text"], got[3]["n_lines"], got[4]["text"]) == (None, 0, "")
    assert [got[i]["text"] for i in (5, 6, 7, 8)] == ["short", "", "1 2 3 4 5 6\n", ""]  # word for word
    assert got[1]["own"] == 2 and got[1]["label"] == "x"
    ties = [(None, "one line of five words"), (4, "one line of five words"), (4, "one line of five words"), (5, "one line of five words\n" + "z " * 50_000)]
    rows = line_dedup.drop_lines(table(spark, ties)).collect()
    assert sorted(len(r["text"]) for r in rows) == [0, 0, 22, 100_000]
    assert line_dedup.drop_lines(table(spark, LINES).where("doc_id = 77")).count() == 0


def test_several_families_in_a_leaf(spark):
    """Two families whose variable field holds words, below one opening, beside a more frequent line; chains of models; any least number of tokens."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    lines = ["the user logged in and went on his way home"] * 6
    lines += [f"the user logged out of {word()} after a very long day" for _ in range(5)] + [f"the user logged errors in {word()} while some job ran" for _ in range(5)]
    lines += [f"the user logged in and went {word()} his {word()} home" for _ in range(8)]
    lines += ["x y z a b c d e f g"] * 3 + ["x y z a b c d e Q R"] * 2 + ["x y z a b c S T Q R"] + ["one", "two 2", "two 3", "one"]
    rows = [(i, f"{x}\nown line {word()} {word()} {word()} {word()} of {i}") for i, x in enumerate(lines)]
    drop = lambda **how: {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(table(spark, rows), **how).collect()}
    got = drop()
    assert list(got.values()) and [got[i] for i, _ in rows] == lines_by_hand(rows)
    stay = Counter(got[i].split("\n")[0].split(" ")[3] for i, x in enumerate(lines) if x.startswith("the user") and "\n" in got[i])
    assert stay["out"] == stay["errors"] == 1 and stay["in"] == 1
    for min_tokens, similar in ((1, 0.8), (1, 0.5), (7, 0.9)):
        got = drop(min_tokens=min_tokens, similar=similar)
        assert [got[i] for i, _ in rows] == lines_by_hand(rows, min_tokens, similar)


def test_partners_that_a_model_hides(spark, tmp_path):
    """Lines that agree with each other but not with their node's model; whole, no template that has a partner stays alone."""
    lines = ["a b c d e f g h i j"] * 3 + ["a b c d e p q r s v", "a b c d e p w r s x"]
    drop = lambda **how: [r["text"] for r in line_dedup.drop_lines(table(spark, list(enumerate(lines))), **how).orderBy("doc_id").collect()]
    assert drop() == lines_by_hand(list(enumerate(lines))) == [lines[0], "", "", lines[3], lines[4]]
    assert drop(whole=True) == [lines[0], "", "", lines[3], ""]
    rng = random.Random(5)
    found = sorted({"a b c " + " ".join(rng.choices(["d", "e"], [3, 1], k=12)) for _ in range(60)} | {"a b c " + " ".join(rng.choices("defgh", k=12)) for _ in range(60)})
    texts = spark.createDataFrame([(1, i, i, 15, x, rng.randint(1, 3)) for i, x in enumerate(found)], "leaf long, k1 long, k2 long, size int, template string, n_docs long")
    agree = lambda x, y: sum(a == b for a, b in zip(found[x].split(" "), found[y].split(" "), strict=True)) >= 12
    near = {x for x in range(len(found)) for y in range(len(found)) if x != y and agree(x, y)}
    alone = {}
    for whole in (False, True):
        got = [(r["k1"], r["m1"]) for r in line_dedup._joined(texts, 0.8, str(tmp_path / str(whole)), whole).collect()]
        assert len(got) == len(dict(got)) and all(agree(*x) for x in got)
        model = dict(got)
        for x in model:  # chains end
            for _ in range(len(found)):
                x = model.get(x, x)
            assert x not in model
        alone[whole] = near - {x for pair in got for x in pair}
    assert alone[False] and not alone[True]


def test_line_dedup_has_one_plan_for_any_size(spark, monkeypatch):
    """Small lists of leaves are merged like large ones: a plan that changes with the input can't be carried on to a larger one."""
    frame, plans = type(spark.range(1)), []
    write = frame.write.fget
    monkeypatch.setattr(frame, "write", property(lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df)))
    line_dedup.drop_lines(table(spark, LINES))
    joins = [x for plan in plans for x in plan.splitlines() if "Join [leaf#" in x and "LeftSemi" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


# ---- near duplicates ---------------------------------------------------------


def shingle_set(text, k):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components_by_hand(rows, k, percent=80):
    sets = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def families(seed=0):
    """Copies, chains of drifting copies, near misses around the threshold, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, n = [], 0
    for _ in range(12):
        own = [word() for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(rng.randint(1, 14)):
            rows.append((n, " ".join(own)))
            n += 1
            own = [word() if rng.random() < rng.choice([0, 0.02, 0.05, 0.08]) else w for w in own]
    extra = ["", None, " \n", "one", "ONE", "one", "two words", "Two  Words", rows[0][1].upper(), rows[3][1] + " tail"]
    return rows + [(n + i, t) for i, t in enumerate(extra)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_all_pairs(spark, k):
    rows = families(k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(table(spark, rows), k=k).collect()}
    want = components_by_hand(rows, k)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert len({c for _, c in want.values()}) < len(rows)


def test_op4_whole_table(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op4_minhash_near_dedup(spark, SF).collect()}
    assert got == components_by_hand(documents(spark), 2)


def test_near_duplicate_edges(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (1, "A B C D E F"), (9, "w " * 30_000), (8, "w " * 40_000)]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == sorted([(3, 1, False), (3, 1, False), (None, None, True), (1, 1, True), (9, 8, False), (8, 8, True)], key=str)
    left = near_dup.drop_near_duplicates(table(spark, [*rows, (1, "A B C D E F")]))
    assert left.columns == table(spark, rows).columns and sorted((str(r["doc_id"]) for r in left.collect())) == ["1", "8", "None"]
    assert near_dup.near_duplicates(table(spark, rows).where("doc_id = 77")).count() == 0


def test_an_id_with_two_texts(spark):
    p, q = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    rows = [(5, p), (5, q), (6, p + " tail"), (7, q + " tail"), (8, "alone here"), (8, ""), (9, None)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(table(spark, rows)).collect())
    assert got == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True), (8, 8, True), (9, 9, True)]
    left = near_dup.drop_near_duplicates(table(spark, [*rows, (5, p), (9, "")]))
    assert sorted((r["doc_id"], r["text"] or "") for r in left.collect()) == sorted([(5, p), (5, q), (8, ""), (8, "alone here"), (9, "")])


def hot_group(n, seed=4):
    """Copies of one text with so many changes that about half of all pairs are linked, and texts further off."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    changed = lambda share: " ".join(f"c{rng.randrange(10**6)}" if rng.random() < share else w for w in base)
    return [(i, changed(rng.choice([0.02, 0.03, 0.045, 0.06]))) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_hot_group_against_all_pairs(spark, monkeypatch, small):
    if small:  # many blocks, and no hub rounds beyond the second
        monkeypatch.setattr(near_dup, "BLOCK", 40)
        monkeypatch.setattr(near_dup, "WEIGHT", 4000)
    rows = hot_group(400)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(table(spark, rows), k=2).collect()}
    assert got == {i: c for i, (_, c) in components_by_hand(rows, 2).items()}
    assert 1 < len(set(got.values())) < 400


def test_blocks_lose_no_pair(spark):
    """Exact links and forests alone, dealt to many blocks, give all components of a group whose classes are all apart."""
    from pyspark.sql import functions as F

    rows = hot_group(200, seed=8)
    data = [(i, 1, textnum.shingles(t.encode(), 2)) for i, t in rows]
    t = spark.createDataFrame([(i, g, i, bytes(x.tobytes()), len(x), near_dup.odd_sketch(x).tolist(), i != 3) for i, g, x in data], "id long, g long, label long, set binary, n long, sketch array<long>, odd boolean")
    dealt = near_dup._places(t, "g", F.lit(7), F.lit(2))
    links = near_dup._dealt(dealt, near_dup.exact_links(80)).collect()
    forest = near_dup._dealt(dealt, near_dup.candidate_forest(near_dup.largest_difference(80), 80)).collect()
    want = components_by_hand(rows, 2)

    def merged(edges):
        root = {i: i for i, _ in rows}
        for a, b in edges:
            x, y = root[a], root[b]
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
        return root

    assert merged(links) == {i: c for i, (_, c) in want.items()}
    tree = merged(forest)
    assert all(tree[i] == tree[c] for i, (_, c) in want.items())


def test_components_of_long_chains(spark, tmp_path):
    n = 1000
    ends = [*range(0, n, 2), *reversed(range(1, n, 2))]  # ids grow from both ends to the middle
    mixed = random.Random(3).sample(range(n, 2 * n), n)
    edges = [x for chain in (ends, mixed) for x in zip(chain, chain[1:], strict=False)]
    got = near_dup.components(spark, spark.createDataFrame(edges, "a long, b long"), str(tmp_path / "cc")).collect()
    assert {r["id"]: r["label"] for r in got} == {i: i // n * n for i in range(2 * n)}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    most = near_dup.largest_difference(80)
    for j, linked in ((0.8, True), (0.9, True), (0.6, False)):
        both = rng.integers(0, 2**63, int(1000 * j / (1 - (1 - j) / 2) / (1 + (1 - j) / (1 + j))), dtype=np.uint64)
        own = int(len(both) * (1 - j) / j / 2)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, own, dtype=np.uint64)])) for _ in range(2))
        bits = int(np.bitwise_count((near_dup.odd_sketch(a) ^ near_dup.odd_sketch(b)).view(np.uint64)).sum())
        assert (bits <= most) == linked


# ---- quality -----------------------------------------------------------------


def counts_by_hand(text):
    w = WORDS.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall("[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


def test_quality_counts_against_plain_code(spark):
    for text in [t for _, t in documents(spark)] + ["", "a", "a a a a", "é é é\né é é\n \n \n", "x\x1cy\xa0z #*$%&|<>", "🙂 🙂 🙂 🙂"]:
        assert quality.counts(text) == counts_by_hand(text)


def test_op5_and_held_out_accuracy(spark):
    small = "/root/testdata/sf0.01"
    rows = queries.op5_quality_rules(spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in queries.documents(spark, small).collect()}
    for r in rows:
        c = counts_by_hand(texts[r["doc_id"]])
        assert {k: r[k] for k in c} == c
        assert r["base_failed"] == (c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"])
        assert not (r["kept"] and r["base_failed"])
    docs, labels = queries.documents(spark, small), spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit(docs.where("doc_id % 2 = 0"), labels)
    held = [(r["text"], r["quality"]) for r in docs.where("doc_id % 2 = 1").join(labels, "doc_id").collect()]
    held = [(t, q) for t, q in held if not quality.breaks_rules(quality.counts(t))]
    assert len(held) > 100
    assert sum((model.probability(t) >= quality.THRESHOLD) == bool(q) for t, q in held) / len(held) > 0.95


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (None, "word " * 60), (3, " ".join(f"w{i}" for i in range(60))), (3, " ".join(f"w{i}" for i in range(60))), (4, " ".join(f"v{i}" for i in range(100_000)))]
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    model = quality.fit(table(spark, rows), none)
    got = sorted(((r["doc_id"], r["base_failed"], r["kept"]) for r in quality.rules(table(spark, rows), model).collect()), key=str)
    assert got == sorted([(1, True, False), (2, True, False), (None, True, False), (3, False, True), (3, False, True), (4, False, True)], key=str)
    left = quality.keep_quality(table(spark, rows), model)
    assert left.columns == table(spark, rows).columns and left.count() == 3
    odd = spark.createDataFrame([(3, None), (None, 1), (4, 1), (4, 0), (99, 0)], "doc_id long, quality int")
    assert quality.fit(table(spark, rows), odd).probability("x") > 0.5
    assert quality.rules(table(spark, rows).where("doc_id = 77"), model).count() == 0


def test_quality_model_is_fitted_by_an_executor(spark, monkeypatch):
    """The driver holds neither the labelled sample's features nor the matrix made of them."""
    docs, labels = queries.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    own = sorted((r["doc_id"], int(r["quality"] > 0)) for r in labels.where("quality is not null").collect() if r["doc_id"] in texts)
    rows = [(*(x.tobytes() for x in quality.features(texts[i])), y) for i, y in own]
    by_hand, model = quality.train([rows[i] for i in np.random.default_rng(11).permutation(len(rows))]), quality.fit(docs, labels)
    assert np.abs(model.weights).max() > 0.1
    assert np.allclose(model.weights, by_hand.weights, atol=1e-3) and np.allclose([model.bias, model.slope, model.shift], [by_hand.bias, by_hand.slope, by_hand.shift], atol=1e-3)
    monkeypatch.setattr(quality, "train", lambda rows: quality.Model(np.zeros(1, np.float32), os.getpid()))
    assert quality.fit(docs, labels).bias != os.getpid()


# ---- secrets -----------------------------------------------------------------


@pytest.fixture(scope="module")
def field():
    return secrets.model()


def base_by_hand(text):
    word = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    found = [("assign", *m.span()) for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


TRICKY = ["token: token=abcdefghijklmnop", "é🙂 PassWord = 'abc/def+ghi_123=='", "ſecret=aaaaaaaaaaaaaaaa", "AKIA0123456789ABCD AKIAAKIA", "deadbeefdeadbeef" * 3, "api_key:apikey=0123456789ab", "", "no secrets here", "secret = short", "x" * 5000 + " token='0123456789abcdef01234567'"]


def test_base_spans_against_plain_code(spark, field):
    for text in TRICKY + [t for _, t in documents(spark)]:
        data = text.encode()
        got = secrets.in_characters(data, secrets.spans(text, field))
        assert [s for s in got if s[0] != "crf"] == base_by_hand(text)
        assert got == sorted(got, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        for kind, a, b in got:
            assert kind != "crf" or not any(x < b and y > a for _, x, y in base_by_hand(text))


def test_field_adds_what_base_spans_leave(spark, field, monkeypatch):
    tag_all = lambda self, scores: np.array([secrets.BEGIN] + [secrets.INSIDE] * (len(scores) - 1), np.int8)
    monkeypatch.setattr(secrets.Field, "decode", tag_all)
    cut = lambda t: [(k, t.encode()[a:b].decode()) for k, a, b in secrets.spans(t, field)]
    assert cut("password=Abcdefghijkl!mn$opqr") == [("assign", "password=Abcdefghijkl"), ("crf", "!mn$opqr")]
    assert cut("postgres://u:PASS@host/db?token=abcdefghijkl") == [("crf", "postgres://u:PASS@host/db?"), ("assign", "token=abcdefghijkl")]
    assert cut("KEY aa 0123456789abcdef é🙂 END") == [("crf", "KEY aa"), ("hex", "0123456789abcdef"), ("crf", "é🙂 END")]
    assert cut("token='abcdefghijkl', token='abcdefghijkl'") == [("assign", "token='abcdefghijkl")] * 2
    assert [secrets.uncovered(0, 9, x) and list(secrets.uncovered(0, 9, x)) for x in ([], [(0, 9)], [(2, 5), (3, 4), (4, 6)])] == [[(0, 9)], [], [(0, 2), (6, 9)]]


def test_op6_digests(spark):
    texts = dict(documents(spark))
    for r in queries.op6_secret_scans(spark, SF).collect():
        base = base_by_hand(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[0] == k for x in base) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("crf")] == [f"{k}:{a}:{b}" for k, a, b in base]


def test_field_on_held_out_texts(field):
    hit = false = missed = 0
    for text, gold in secrets.synthetic(250, seed=404):
        data = text.encode()
        starts, ends, cat = secrets.word_features(data)
        scores = field.scores(cat)
        tags = field.decode(scores)
        assert (tags == field.viterbi(scores)).all()  # skipping sure words changes nothing
        want = np.zeros(len(starts), bool)
        for a, b in gold:
            want |= (starts < b) & (ends > a)
        hit, false, missed = hit + int((want & (tags > 0)).sum()), false + int((~want & (tags > 0)).sum()), missed + int((want & (tags == 0)).sum())
    assert hit / (hit + false) > 0.95 and hit / (hit + missed) > 0.92


def test_viterbi_against_all_paths(field):
    from itertools import product

    rng = np.random.default_rng(0)
    for _ in range(20):
        s = rng.normal(0, 4, (6, 3))
        total = lambda p: sum(s[i, t] for i, t in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        assert tuple(field.decode(s)) == max(product(range(3), repeat=6), key=total)


def test_words_of_any_length_are_read(field):
    """A cue or a value far into a long word counts, whatever lies before it."""
    kinds = lambda w: secrets._cue_kinds(w.encode(), np.array([0]), np.array([len(w.encode())]), np.array([0]))[0]
    assert kinds("secret_" * 40 + "token") == 1 and kinds("k" * 300 + "=" + "v" * 300) == 5 and kinds("secret_" * 40 + "token=" + "v" * 300) == 4
    long_ = "p" + "a" * 3_000_000
    assert [s[0] for s in secrets.spans(f"{long_} token = 0123456789abcdefXY", field)].count("assign") == 1


def test_quality_grams_are_of_code_points():
    """Bins do not depend on how many bytes a character takes: one character more gives as many grams more in any script."""
    for text in ("abcdefgh", "äöüßéèçà", "日本語日本文字列", "🙂🙃😀😁😂🤣😃😄"):
        total = lambda t: round(float(np.expm1(quality.features(t)[1] / quality.features(t)[1].min() * np.log1p(1)).sum()))
        assert total(text) == 1 + 6 + 5
    assert quality.features("日本")[0].tolist() != quality.features("本日")[0].tolist()


def test_secret_edges(spark, field):
    rows = [(1, None), (2, ""), (None, "token = 0123456789abcdef0"), (3, "é token = 'abcdefghijklmnopq' end"), (3, "é token = 'abcdefghijklmnopq' end"), (4, "w " * 100_000)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(table(spark, rows), field).collect()}
    assert got[1] == got[2] == got[4] == [] and [tuple(s) for s in got[3]] == [("assign", 2, 28)]
    clean = {r["doc_id"]: r for r in secrets.redacted(table(spark, rows), field).collect()}
    assert clean[1]["text"] is None and clean[3]["text"] == "é [SECRET]' end" and clean[3]["n_chars"] == 15 and "[SECRET]" in clean[None]["text"]
    assert clean[3]["label"] == "x" and secrets.scan(table(spark, rows).where("doc_id = 77"), field).count() == 0


# ---- pipeline ----------------------------------------------------------------


def test_pipeline_against_plain_code(spark, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 400")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = quality.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    rows = [(i, t) for i, t in rows if not quality.breaks_rules(counts_by_hand(t)) and model.probability(t) >= quality.THRESHOLD]
    rows = [(i, t) for (i, _), t in zip(rows, lines_by_hand(rows), strict=True) if WORDS.search(t)]
    keep = components_by_hand(rows, 5)
    rows = [(i, t) for i, t in rows if keep[i][1] == i]
    field = secrets.model()
    clean = {}
    for i, t in rows:
        data, out, at = t.encode(), b"", 0
        for _, a, b in secrets.spans(t, field):
            if a >= at:
                out += data[at:a] + b"[SECRET]"
            at = max(at, b)
        clean[i] = (out + data[at:]).decode()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(clean) and 100 < len(clean) < 400
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = Counter()
    for r in got:
        sizes[r["doc_id"]] += r["length"]
        assert r["offset"] + r["length"] <= packing.CAPACITY
    assert sizes == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}


def test_pipeline_stage_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "clean words " * 30), (3, " ".join(f"w{i}" for i in range(80))), (3, " ".join(f"w{i}" for i in range(80)))]
    rows += [(6, "x" * 1_500_000), (7, " ".join(f"v{i}" for i in range(79)) + " " + "y" * 1_200_000), (8, "z " * 60 + " " * 600_000)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows_ in (rows, []):
        docs = table(spark, rows).where("false") if not rows_ else table(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("piece = 0").count() == len(rows_)
