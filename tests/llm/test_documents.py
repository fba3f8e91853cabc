"""Similarity join, quality, line dedup, decontamination, licences: brute force and odd rows."""

import random
import re
import textwrap
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, license_scan, line_dedup, quality, registry

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.integers(0, 60)}" for _ in range(n))


def edited(text, seed, n):
    words, rng = text.split(), np.random.default_rng(seed)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"edit{rng.integers(0, 10_000)}"
    return " ".join(words)


def grams(t, n=5):
    w = re.findall(r"\w+", (t or "").lower())
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_classes(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    links, parent = Counter(), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and shared >= threshold * (len(sets[i]) + len(sets[j]) - shared):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted((rows[i][0] is None, rows[i][0] or 0, least.get(root(i)), links[i]) for i in range(len(rows)))


@pytest.mark.parametrize("limit,block", [(4, 7), (512, 2048)])
def test_join_is_brute_force(spark, limit, block):
    rows = [(i, prose(i)) for i in range(30)]
    rows += [(100 + i, edited(prose(3), i, 2)) for i in range(25)] + [(200 + i, edited(prose(4), i, 4)) for i in range(10)] + [(300 + i, prose(5)) for i in range(12)]
    rows += [(400, None), (401, ""), (402, "?!"), (403, "one two"), (404, "One, two."), (405, "one two three"), (300, prose(5)), (406, prose(6).upper())]
    passage = prose(99, 60)
    rows += [(500 + i, f"{prose(500 + i, 40)} {passage}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit("clash")).withColumn("k", F.lit(0)).repartition(5)
    got = jaccard_join.join(df, limit=limit, block=block).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in got) == brute_classes(rows)


def test_join_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.op2_jaccard_join(spark, sf).collect()
    assert sorted((False, r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_classes(rows)


def test_join_of_nothing(spark):
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = jaccard_join.join(spark.createDataFrame([(7, "just one text here now")], "doc_id long, text string")).collect()
    assert [(r["class_id"], r["class_size"], r["n_links"]) for r in one] == [(7, 1, 0)]


def test_components_join_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["rid"]: r["root"] for r in jaccard_join.components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == got[100] == 100


def test_survival_and_runs():
    assert jaccard_join.survival(0.8, 0) == 1 and 0.8 < jaccard_join.survival(0.8, 1) < 0.9 and jaccard_join.survival(1.0, 5) == 1


def test_links_are_set_similarity():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 32, 400).astype(np.uint32))
    sets = [np.unique(np.concatenate([base[: len(base) - d], rng.integers(0, 1 << 32, d).astype(np.uint32)])) for d in (0, 10, 40, 44, 45, 60, 200)]
    sets += [np.unique(rng.integers(0, 900, n).astype(np.uint32)) for n in (3, 200, 700, 2000, 2500, 2600) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for b in sets] for a in sets]
    assert jaccard_join.links(sets, sets, 0.8).tolist() == want
    assert jaccard_join.links(sets[:9], sets[5:], 0.8).tolist() == [w[5:] for w in want[:9]]


# quality


def brute_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = list(zip(w, w[1:], w[2:]))
    c, covered, seen, dup = Counter(tri), set(), set(), 0
    for i, x in enumerate(tri):
        if c[x] > 1:
            covered |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


ODD = [(1, None), (2, ""), (3, "\n\n \t"), (4, "a a a a a a"), (5, "x y z\nx y z\n\nx y z"), (6, "é ü b #*$%&|<>"), (7, prose(1)), (7, prose(1)), (None, prose(2)), (8, "a b c a b c a b c " * 40), (9, "w\x0bx\x0cy\rz")]


def test_base_rules_are_brute_force(spark):
    labels = spark.createDataFrame([(7, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(-1))
    got = Counter((r["text"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.assess(df, labels).collect())
    want = Counter((t, *(b := brute_base(t)), b[0] < 50 or 100 * b[4] > 50 * b[0]) for _, t in ODD)
    assert got == want


def test_scores_are_the_ratio(spark):
    rows = [(i, prose(i)) for i in range(20)] + [(100 + i, "$$$ ### " * 80) for i in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in range(10)] + [(100 + i, 0) for i in range(5)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights, cut = quality.fit(docs, labels, buckets=997)
    counts = {}
    for name, chosen in (("raw", rows), ("target", rows[:10])):
        c = np.zeros(997)
        for _, t in chosen:
            b = [x + 32 if 65 <= x <= 90 else 48 if 48 <= x <= 57 else x for x in t.encode()]
            for i in range(len(b) - 2):
                gram = int.from_bytes(bytes(b[i : i + 3]), "little")
                c[((gram * 2654435761 & 0xFFFFFFFF) >> 7) % 997] += 1
        counts[name] = c
    raw, target = counts["raw"] + 1, counts["target"] * round(counts["raw"].sum() / counts["target"].sum() * 65536) / 65536
    target += target.sum() / counts["raw"].sum()
    assert np.allclose(weights, np.log(target / target.sum()) - np.log(raw / raw.sum()), atol=1e-9)
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(docs, labels, buckets=997).collect()}
    assert all(kept[i] for i in range(20)) and not any(kept[100 + i] for i in range(10))
    assert cut < quality.scores(pa.array([rows[0][1]]), weights)[0]


def test_letter_soup_goes_and_rare_languages_stay(spark):
    rng = np.random.default_rng(2)
    other = lambda i: prose(i).translate(str.maketrans("aeioutnsrl", "øåæéüþðßñç"))
    soup = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 10))) for _ in range(120)) for _ in range(10)]
    rows = [(i, prose(i), "a") for i in range(60)] + [(100 + i, other(i), "b") for i in range(40)] + [(200 + i, t, "a") for i, t in enumerate(soup)] + [(300, prose(99), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100, 1), (101, 1), (200, 0), (201, 0)], "doc_id long, quality int")
    found = quality.assess(docs, labels, group="lang")
    kept = {r["doc_id"]: r["kept"] for r in found.collect()}
    assert [i for i, k in kept.items() if k != (not 200 <= i < 300)] == []
    again = quality.assess(docs.repartition(7, "text"), labels, group="lang")
    assert {r["doc_id"]: r["llr"] for r in again.collect()} == {r["doc_id"]: r["llr"] for r in found.collect()}


def test_quality_holds_out(spark):
    """Threshold set on half of the labels, judged on the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.assess(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in found)
    assert right / len(found) > 0.97 and all(r["kept"] for r in found if r["quality"] == 1)


def test_quality_of_string_keys_and_long_texts(spark):
    rows = [(f"k{i}", prose(i)) for i in range(20)] + [("bad", "$$$ ### " * 80), (None, prose(3)), ("long", prose(4, 100_000))]
    labels = spark.createDataFrame([(f"k{i}", 1) for i in range(10)] + [("k0", 0), ("bad", 0), ("bad", 0), (None, 0)], "doc_id string, quality int")
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("k", F.lit(1)).withColumn("label", F.lit(7))
    got = quality.assess(docs, labels).collect()
    assert len(got) == len(rows) and all(r["kept"] == (r["doc_id"] != "bad") and r["k"] == 1 and r["label"] == 7 for r in got)


def test_quality_without_labels(spark):
    docs, none = spark.createDataFrame(ODD, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["llr"] is None and r["kept"] == (not r["base_failed"]) for r in quality.assess(docs, none).collect())
    assert quality.assess(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


# line dedup


def test_recurring_lines_go_and_copies_stay(spark):
    plain = "Subscribe to our weekly newsletter for more news"
    variable = "Page {} of the archive was printed by user {} on the old printer"
    named = "Thank you dear reader {} for visiting this small site about trains and planes"
    names = ["Anna", "Bert", "Cleo", "Dora", "Emil", "Finn", "Gina", "Hugo"]
    rows = [(i, f"{prose(i, 150)}\n{plain}\n{variable.format(i, 7 * i)}\n{named.format(names[i])}\n{prose(50 + i, 90)}") for i in range(8)]
    rows += [(100 + i, f"{prose(77, 30)}\n{prose(78, 25)}") for i in range(20)]  # exact copies
    rows += [(200 + i, "\n".join(edited(prose(80 + j, 30), 31 * i + j, 1) if (i + j) % 4 == 0 else prose(80 + j, 30) for j in range(6))) for i in range(12)]  # near copies
    rows += [(300, None), (301, ""), (302, "short line"), (None, prose(9, 30)), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("leaf", F.lit(1)).repartition(4)
    got = line_dedup.dedup(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 8:
            assert r["text"].split("\n") == [prose(r["doc_id"], 150), prose(50 + r["doc_id"], 90)] and (r["n_lines"], r["n_dropped"]) == (5, 3)
        else:
            assert r["text"] == dict(rows)[r["doc_id"]] and r["n_dropped"] == 0


def test_a_line_recurs_however_often_it_repeats(spark):
    often, mixed = "This line is found in a thousand documents or more", "This one stands in five documents and many copies of another"
    rows = [(i, f"{prose(i, 60)}\n{often}") for i in range(1500)]
    rows += [(5000 + i, f"{prose(5000 + i, 60)}\n{mixed}") for i in range(5)]
    rows += [(6000 + i, f"{edited(prose(6000, 60), i, 2)}\n{mixed}") for i in range(300)]  # copies of one text
    rows += [(7000 + i, f"{edited(prose(7000, 60), i, 2)}\nThis line has been seen nowhere but in copies") for i in range(300)]
    for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        lines = dict(rows)[r["doc_id"]].split("\n")
        assert r["text"].split("\n") == lines[: 1 if r["doc_id"] < 7000 else 2]


def test_long_lines_recur_from_two_documents(spark):
    long, short, copied = prose(900, 50), prose(901, 49), prose(902, 50)
    rows = [(i, f"{prose(i, 70)}\n{long}") for i in range(2)] + [(5 + i, f"{prose(5 + i, 70)}\n{short}") for i in range(2)]
    rows += [(10 + i, f"{edited(prose(10, 70), i, 2)}\n{copied}") for i in range(4)]  # near copies
    for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        lines = dict(rows)[r["doc_id"]].split("\n")
        assert r["text"].split("\n") == lines[: 1 if r["doc_id"] < 2 else 2]


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def different_enough(sketches, need, min_docs):
    """The rule for different content on all sketches of a template, salt by salt as the operator deals them."""
    def taken(found):
        out = []
        for x in sorted(found):
            same = [line_dedup.agreement(x, y) for y in out]
            if len(out) < min_docs and 16 * max(same, default=0) < 3 * line_dedup.COORDINATES:
                out.append(x)
        return out

    dealt = {}
    for x in set(sketches) - {None}:
        dealt.setdefault((xxhash.xxh64_intdigest(x, 42) - (1 << 64) * (xxhash.xxh64_intdigest(x, 42) >> 63)) % line_dedup.SALTS, []).append(x)
    some = taken([x for part in dealt.values() for x in taken(part)])
    far = any(16 * min(line_dedup.agreement(x, y) for y in some[:i]) < line_dedup.COORDINATES for i, x in enumerate(some) if i)
    return len(some) >= min_docs or len(some) >= need and far


def brute_dedup(texts, min_docs=5, depth=3):
    """text -> the text without recurring lines and their number: the tree with dictionaries, all of it in memory."""
    lines, leaf = {}, {}
    for t in {t for t in texts if t}:
        found = [x for x in dict.fromkeys(t.encode().split(b"\n")) if x.split()]
        for x, sketch in zip(found, line_dedup.sketches(found) if found else []):
            words = tuple(w.decode("utf-8") for w in x.split())
            masked = tuple("<*>" if re.search("[0-9]", w) else w for w in words)
            own = ("own", masked if masked == words or len(masked) - masked.count("<*>") >= 2 else ("=", *words))
            sketch = sketch if 3 * len(words) <= 2 * sum(len(y.split()) for y in found) else None
            lines.setdefault(own, {"masked": masked, "in": set()})["in"].add((t, sketch))
            if len(words) >= 4:
                deep = depth if len(words) < 50 else 3 * depth
                for k in ((len(words), masked[:deep]), (len(words), "*", masked[-deep:])):
                    leaf.setdefault(k, set()).add((own, t, sketch))
    need = lambda n: min(min_docs, line_dedup.LONG_DOCS) if n >= line_dedup.LONG else min_docs
    bad = {k for k, v in lines.items() if different_enough([s for _, s in v["in"]], need(len(v["masked"])), min_docs)}
    generalised = set()
    busy = {k for k, rows in leaf.items() if different_enough([s for _, _, s in rows], need(k[0]), min_docs)}
    led = {own for k in busy if len(k) == 2 for own, _, _ in leaf[k]}
    for k in busy:
        n, rows = k[0], leaf[k]
        if len(k) == 3:  # the wildcard branch: lines whose leading leaf does not recur
            rows = {(own, t, s) for own, t, s in rows if own not in led}
        rows = [(own, t, s) for own, t, s in rows if own not in bad]
        made = {}
        at = [Counter(lines[own]["masked"][i] for own, _ in {(own, t) for own, t, _ in rows}) for i in range(n)]
        for own, _, sketch in rows:
            masked = lines[own]["masked"]
            key = tuple(w if w == "<*>" or at[i][w] >= need(n) else None for i, w in enumerate(masked))
            fixed = n - key.count("<*>") - key.count(None)
            if 0 < 4 * key.count(None) <= n and fixed >= 2 and 2 * fixed >= n:
                made.setdefault(key, []).append((own, sketch))
        for key, held in made.items():
            if different_enough([s for _, s in held], need(n), min_docs):
                generalised.update(own for own, _ in held)
    bad |= generalised
    kept = {}
    for t in {t for t in texts if t}:
        out = []
        for x in t.split("\n"):
            words = tuple(w.decode("utf-8") for w in x.encode().split())
            masked = tuple("<*>" if re.search("[0-9]", w) else w for w in words)
            own = ("own", masked if masked == words or len(masked) - masked.count("<*>") >= 2 else ("=", *words))
            if not words or own not in bad:
                out.append(x)
        kept[t] = "\n".join(out), len(t.split("\n")) - len(out)
    return kept


def test_line_dedup_is_brute_force(spark):
    """Whole table, and templates with several variable fields, at the front, in the middle and of digits."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rng = np.random.default_rng(1)
    made = ["All rights reserved.", "{a} wrote on {n} that the old {b} was late again today", "{a} {b} has left the room of the house by the lake", "{n} {n} GET {n} OK {n}", "{n} {n} {n}"]
    texts += ["\n".join([prose(10_000 + i, 200), *(x.format(a=f"Name{chr(65 + i)}x", b=f"thing{chr(97 + i)}y".replace("1", ""), n=rng.integers(0, 9999)) for x in made)]) for i in range(8)]
    texts += [None, "", "\n \n", texts[0], texts[0]]
    want = brute_dedup(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("drop_keys", F.lit("kept")).withColumn("_salt", F.lit(1)).repartition(6)
    got = line_dedup.dedup(df).collect()
    assert len(got) == len(texts) and all(r["drop_keys"] == "kept" and r["_salt"] == 1 for r in got)
    for r in got:
        before = texts[r["doc_id"]]
        assert r["text"] == (want[before][0] if before else before)
        assert (r["n_lines"], r["n_dropped"]) == ((len(before.split("\n")), want[before][1]) if before else (0, 0))
    last = [r["text"] for r in got if 0 <= r["doc_id"] - len(texts) + 13 < 8]
    assert last and all("All rights" not in x and "wrote on" not in x and "has left" not in x and "GET" not in x and len(x.split("\n")) == 2 for x in last)


def test_copies_that_are_mostly_one_line_are_no_witnesses(spark):
    short = [f"This small line number {w} stands in many documents" for w in ("alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma")]
    rows = [(i, edited(prose(7, 87), i, 2) + f"\n{short[i % 7]}") for i in range(60)] + [(100 + i, edited(prose(7, 87), 100 + i, 2)) for i in range(20)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].split("\n")[0] == t.split("\n")[0] for k, t in rows)


def test_sketches_are_those_of_the_other_lines():
    lines = [b" a b\tc d ", b"e", b"f  g h\x0b", b"a b c"]
    for i, sketch in enumerate(line_dedup.sketches(lines)):
        others = line_dedup.sketches([*lines[:i], *lines[i + 1 :], b"x"])
        assert sketch == others[-1]
    assert line_dedup.sketches(lines, cells=1) == line_dedup.sketches(lines)


def test_short_lines_and_long_texts(spark):
    big = "\n".join(prose(i, 30) for i in range(4000))
    rows = [(i, f"{prose(i, 60)}\nAll rights reserved.\nOK") for i in range(6)] + [(10, big), (11, big), (12, "OK")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == prose(i, 60) for i in range(6)) and got[10] == got[11] == big and got[12] == ""


# decontamination


def brute_hits(t, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda x: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    w, hit, own = words(t), set(), set()
    for k, x in items:
        p = words(x)
        m = min(window, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            for a in range(len(w) - m + 1):
                if w[a : a + m] == p[i : i + m]:
                    hit |= set(range(a, a + m))
                    own.add(str(k))
    return len(w), len(hit), sorted(own)


def hits(df, items, **more):
    found = decontaminate.find(df, items, **more).withColumn("n_hit", decontaminate.n_hit()).collect()
    return Counter((r["text"], r["n_words"], r["n_hit"], tuple(r["hit_items"])) for r in found)


@pytest.mark.parametrize("block", [32 << 20, 200])
def test_search_is_brute_force(spark, block):
    items = [(1, prose(1, 25)), (2, prose(2, 10)), (3, "Four Short WORDS here"), (4, "one"), (5, ""), (6, None), (7, "!!!"), (10, prose(1, 25)), (11, "a a a a a a a a a a a a"), (12, "Été über")]
    rows = [(1, None), (2, ""), (3, prose(1, 25)), (4, f"x {prose(2, 10).upper()}. y"), (5, "four-short words, HERE four short words here"), (6, "one two one"), (7, " ".join(prose(1, 25).split()[3:16])), (8, "a " * 30), (9, prose(44)), (9, prose(44)), (None, "ÉTÉ ÜBER été über Été über"), (10, prose(1, 25) * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit(0)).withColumn("n_words", F.lit("clash")).withColumn("_row", F.lit("kept"))
    assert {r["_row"] for r in decontaminate.find(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()} == {"kept"}
    got = hits(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert got == Counter((t, n, h, tuple(own)) for _, t in rows for n, h, own in [brute_hits(t, items)])


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert hits(df, none) == Counter({("a b", 2, 0, ()): 1}) and decontaminate.find(df.limit(0), none).count() == 0


def test_contamination_query(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.op5_decontaminate(spark, sf).collect():
        if r["contaminated"] or r["doc_id"] % 10 == 0:
            n, h, own = brute_hits(docs[r["doc_id"]], items)
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, h, len(own), decontaminate.items_digest(own))


# licences


@pytest.mark.parametrize(
    "text,want",
    [
        ("Released under the MIT License.", ["MIT"]),
        ("Prose first. Licensed under the Apache License, Version 2.0.\nMore.", ["Apache-2.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at https://x", ["Apache-2.0"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nNeither the name of X may be used to endorse or promote products derived from this software without specific prior written permission.", ["BSD-3-Clause"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ["BSD-2-Clause"]),
        ("Released under the MIT License.\nReleased under the MIT License.\nAll rights reserved.", ["MIT", "All-Rights-Reserved"]),
        ("We discuss the license question and the MIT campus.", []),
        ("", []),
        (None, []),
    ],
)
def test_licenses(spark, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("licenses", F.lit(3))
    assert license_scan.scan(df).collect()[0]["licenses"] == want


MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy and modify, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


@pytest.mark.parametrize("width", [30, 60, 72, 78])
@pytest.mark.parametrize("prefix,head", [("", ""), ("# ", "A heading\n"), (" * ", "Copyright (c) 2020 X\n")])
@pytest.mark.parametrize("text,ids,want", [(MIT, ["MIT-GRANT", "MIT-COND", "ASIS-SOFTWARE"], "MIT"), (BSD, ["BSD-REDIST", "BSD-NAMES"], "BSD-3-Clause"), (GPL, ["GPL-FREE"], "GPL")])
def test_wrapped_licenses(spark, text, ids, want, prefix, head, width):
    lines = [line for part in text.split("\n\n") for line in (*textwrap.wrap(part, width), "")]
    wrapped = "\n".join(prefix + line for line in (head + "\n".join(lines)).split("\n"))
    row = license_scan.scan(spark.createDataFrame([(1, wrapped)], "doc_id long, text string")).collect()[0]
    assert (row["sentence_ids"], row["licenses"]) == (ids, [want])


NOTICES = {
    "BSD-2-Clause": 'Copyright (c) 2020, X\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and limitations under the License.',
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.',
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)",
    "GPL-3.0-only": "SPDX-License-Identifier: GPL-3.0-only",
    "GPL-2.0": "This software is released under the GPL v2.",
}


def plain_scan(text):
    """Sentence identifiers by another way: every run of a sentence's lines is tried, the longest first, as one string."""
    ids = []
    for sentence in re.split(r"(?:\n[^\w\n]*){2,}|(?<=[.!?;])\s+", text):
        lines = [" ".join(re.sub(r"(?<![0-9])\.|\.(?![0-9])|[^\w.]|_", " ", x.lower()).split()) for x in sentence.split("\n")]
        i = 0
        while i < len(lines):
            for j in range(len(lines), i, -1):
                known = [n for n, p in license_scan.SENTENCES if re.fullmatch(p, " ".join(lines[i:j]))]
                if known and lines[i]:
                    ids.append(known[0])
                    i = j - 1
                    break
            i += 1
    return ids


@pytest.mark.parametrize("width", [50, 80, 1000])
def test_notices_as_published(spark, width):
    rows = [(n, "\n".join(line for part in t.split("\n") for line in textwrap.wrap(part, width) or [""])) for n, t in NOTICES.items()]
    df = spark.createDataFrame([*rows, rows[0], ("none", prose(1)), ("none", None)], "name string, text string").withColumn("sentence_ids", F.lit(1)).withColumn("rest", F.lit(2))
    got = license_scan.scan(df).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        assert [x for x in r["licenses"] if x != "All-Rights-Reserved"] == ([r["name"]] if r["name"] != "none" else []), r
        assert width < 1000 or r["sentence_ids"] == plain_scan(r["text"] or ""), r
    assert license_scan.scan(df.limit(0)).count() == 0
    long = spark.createDataFrame([(f"{prose(3, 200_000)}\n{NOTICES['ISC']}",)], "text string")
    assert license_scan.scan(long).collect()[0]["licenses"] == ["ISC"]


def test_notices_of_a_line_stay_apart(spark):
    text = "Released under CC0 1.0\nReleased under the MIT License\nprose between\nAll rights reserved\nLicensed under the Apache License,\nVersion 2.0"
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row["sentence_ids"] == ["CC0-NOTICE", "MIT-NOTICE", "RESERVED", "APACHE-NOTICE"]


def test_license_query_is_native_and_whole(spark, sf):
    df = registry.op10_license_scan(spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rules = {"MIT": r"^Released under the MIT License\.$", "Apache-2.0": r"^Licensed under the Apache License, Version 2\.0\.$", "CC-BY-NC": r"^Licensed under CC BY-NC \d\.0\.$", "GPL-3.0": r"^This work is licensed under the GNU General Public License, version 3\.$"}
    for r in df.collect():
        want = {n for n, p in rules.items() if re.search(p, docs[r["doc_id"]] or "", re.M)}
        assert want <= set(r["licenses"].split(",")) | {""} and len(want) <= r["n_sentences"]


def test_license_scan_survives_hostile_texts(spark):
    granted = "This work is released under the MIT license"
    texts = ["\n" * 100_000 + granted, "\n \t*" * 50_000 + "\n\n" + granted, "word " * 1_000_000 + ".\n" + granted, "neither the name of\n" * 3_000 + "\n" + granted, "license " * 100_000, ("x. " + "\n" * 500) * 200 + granted]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(df).collect()}
    assert time.perf_counter() - began < 60
    assert [i for i, found in got.items() if found != ["MIT"]] == [4] and license_scan.scan(df.limit(0)).count() == 0


def test_large_benchmarks_fit_and_null_items_hit(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=40)).encode()) for i in range(3000)]
    tables = decontaminate.build(items, 10)
    for number, data in rng.sample(items, 200):
        found = decontaminate.words(data)
        text = [b"w1", *found[3:20], b"other", *found[-9:]]
        ranges, own = decontaminate.scan(text, tables)
        assert ranges == [(1, 18)] and own == {number}
    held = sum(t.keys.nbytes + t.item.nbytes + t.place.nbytes + len(t.shift) for t in tables)
    assert held < 8 * sum(len(t) for _, t in items)
    words = "one two three four five six seven eight nine ten"
    row = decontaminate.find(spark.createDataFrame([(1, f"a {words} b")], "doc_id long, text string"), spark.createDataFrame([(None, words), (7, words)], "item_id long, text string")).withColumn("n_hit", decontaminate.n_hit()).first()
    assert (row["n_hit"], row["hit_items"]) == (10, ["7"])


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(8)
    texts = [prose(i, int(rng.integers(1, 300))) for i in range(100)]
    weights = rng.normal(size=997)
    together = quality.scores(pa.array(texts), weights)
    assert all(quality.scores(pa.array([t]), weights)[0] == s for t, s in zip(texts, together))
