"""Near duplicates, fingerprints, mixing and the pipeline against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from kgloom.llm import language_unigrams, ngram_jaccard, queries, secret_forest, source_mixing, weighted_sampling
from kgloom.llm.ngram_jaccard import Join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_components(rows, join):
    sets = [grams(t, join.words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if join.den * both >= join.num * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids, default=None)))
    return out


def brute_roots(rows, join):
    """A number for each row's component; of rows that are equal the first stands for all."""
    sets = [grams(t, join.words) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i] == rows[j] or sets[i] and sets[j] and join.den * both >= join.num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return root


def near_corpus(seed=1):
    """Copies, chains of edits around the threshold, short and long texts, shared passages."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    passage = [word() for _ in range(60)]
    texts = [None, "", "  \t", "one", "one", "One two", "one two three", "a b c d", "a b c d e"]
    for size in (5, 8, 12, 30, 60, 150, 400):
        for _ in range(3):
            base = [word() for _ in range(size)]
            if rng.random() < 0.4:
                base[:0] = passage
            for _ in range(8):
                edited = list(base)
                for _ in range(rng.randrange(0, max(2, size // 12))):
                    edited[rng.randrange(len(edited))] = word()
                if rng.random() < 0.3:
                    edited = edited[: rng.randint(len(edited) * 8 // 10, len(edited))]
                texts.append((" " if rng.random() < 0.8 else "\n ").join(edited))
                if rng.random() < 0.2:
                    base = edited
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("join", [Join(), Join(5, 80, 100), Join(3, 90, 100)])
def test_jaccard_against_brute_force(spark, join):
    rows = near_corpus() + [(None, "a b c d e"), (None, "quite alone here now"), (3, "a b c d")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(3)
    got = ngram_jaccard.similar_groups(df, join).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows, join), key=key)
    kept = ngram_jaccard.one_of_each(df, join).collect()
    roots = brute_roots(rows, join)
    assert sorted(roots[rows.index((r["doc_id"], r["text"]))] for r in kept) == sorted(set(roots))
    assert ngram_jaccard.similar_groups(df.limit(0), join).count() == 0 and ngram_jaccard.one_of_each(df.limit(0), join).count() == 0


def test_jaccard_null_and_repeated_ids_are_no_bridges(spark):
    """Unrelated documents that each have a near copy without id, or under one id, stay apart; null rows do link what they are like."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    one, two, three = words(60), words(60), words(80)
    middle, far = [*three[:40], "y1", *three[41:]], [*three[:40], "y1", *three[41:79], "y2"]
    rows = [(5, one), (None, [*one[:-1], "x"]), (9, two), (None, [*two[:-1], "x"]), (7, [*one[:-2], "q"]), (7, [*two[:-2], "q"]), (20, three), (None, middle), (30, far)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["text_hash"]): r["component_id"] for r in ngram_jaccard.similar_groups(df).collect()}
    hashes = [r[0] for r in spark.createDataFrame([(n, " ".join(t)) for n, (_, t) in enumerate(rows)], "n int, text string").orderBy("n").selectExpr("xxhash64(text)").collect()]
    assert [got[(i, h)] for (i, _), h in zip(rows, hashes)] == [5, 5, 7, 7, 5, 7, 20, 20, 20]
    assert sorted(r["doc_id"] for r in ngram_jaccard.one_of_each(df).collect()) == [5, 7, 20]


def test_short_texts_share_no_key():
    join = Join()
    keys = [k for i in range(500) for n in (1, 2, 4, 6, 8) for k in set(ngram_jaccard.file_keys(ngram_jaccard.shingles(" ".join(f"t{i}-{j}" for j in range(n)), join.words), join))]
    keys += [k for i in range(500) for k in set(ngram_jaccard.file_keys(ngram_jaccard.shingles(" ".join(f"t{i}-{j}" for j in range(9 + i % 9)), join.words), join))]
    assert len(keys) > 500 and max(Counter(keys).values()) <= 3
    for join in (Join(), Join(5, 80, 100), Join(3, 90, 100)):
        i = join.least()
        assert join.den * i >= join.num * (i + 1) and join.den * (i - 1) < join.num * i


def test_units_of_a_large_group_are_linear(spark):
    n = 100_000
    members = spark.range(n).selectExpr("1L AS key", "id AS node", f"{n}L AS m", f"cast(ceil({n} / {ngram_jaccard.BLOCK}) AS long) AS blocks")
    own = ngram_jaccard.own_blocks(members)
    assert n < own.count() < 1.1 * n and own.groupBy("key", "i", "j").count().agg(F.max("count")).first()[0] < 1.5 * ngram_jaccard.BLOCK
    one = spark.range(n).selectExpr("id AS node", "0L AS component")
    assert ngram_jaccard.cross_blocks(members, one).count() == 0
    few = spark.range(n).selectExpr("id AS node", "CASE WHEN id % 1000 = 7 THEN id ELSE 0L END AS component")
    crossed = ngram_jaccard.cross_blocks(members, few)
    assert crossed.where("second").count() == n and crossed.where("NOT second").groupBy("node").count().select("count").distinct().first()[0] == members.first()["blocks"]


@pytest.mark.parametrize("pivots", [0, 2])
def test_jaccard_blocks(spark, monkeypatch, pivots):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 4)
    monkeypatch.setattr(ngram_jaccard, "PIVOTS", pivots)
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        edited = list(base)
        for _ in range(rng.randrange(0, 9)):
            edited[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(edited)))
    got = ngram_jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows, Join()))


def test_rtree_finds_all_that_the_bound_leaves():
    rng = np.random.default_rng(3)
    join = Join()
    points = rng.poisson(2.0, (300, 64)).astype(np.int32)
    points[100:200] = points[:100] + rng.integers(0, 2, (100, 64)) * (rng.random((100, 64)) < 0.1)
    sizes = points.sum(axis=1)
    tree = ngram_jaccard.RTree(points, sizes, join)
    for u in range(0, 300, 11):
        want = np.flatnonzero(np.minimum(points, points[u]).sum(axis=1) >= join.need(sizes + sizes[u]))
        assert sorted(tree.search(points[u], int(sizes[u]))) == want.tolist()


def test_linked_sets_share_a_bucket():
    rng = np.random.default_rng(4)
    join = Join()
    for _ in range(400):
        n = int(rng.integers(1, 700))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        cut = int(rng.integers(0, max(1, len(a) // 5)))
        b = np.unique(np.r_[rng.permutation(a)[cut:], rng.integers(0, 2**63, int(rng.integers(0, max(1, len(a) // 8)))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if join.den * both >= join.num * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
            assert len(np.intersect1d(ngram_jaccard.file_keys(a, join), ngram_jaccard.file_keys(b, join))) > 0


def true_likeness(a, b):
    """Generalised Jaccard similarity: terms weigh their count times their length."""
    terms = lambda t: Counter({w: n * len(w) for w, n in Counter(re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower())).items()})
    x, y = terms(a), terms(b)
    most = sum((x | y).values())
    return sum((x & y).values()) / most if most else 1.0


def test_fingerprints(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in queries.op7_fingerprint(spark, sf).collect()}
    off = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        off += [r["near_edited"] - true_likeness(text, edited), r["near_next"] - true_likeness(text, after)]
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.09
    by_text = {}
    for i, text in rows:
        assert by_text.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_fingerprint_is_consistent_weighted_sampling(spark):
    """One sample of one term, from the formula in plain Python, with Spark's hashes."""
    row = spark.sql("select xxhash64('word') h, xxhash64(xxhash64('word'), 6) a, xxhash64(xxhash64('word'), 7) b").first()
    u = lambda bits, at: (((bits % 2**64) >> at & 0x1FFFFF) + 0.5) / 2**21
    r = -math.log(u(row["a"], 0) * u(row["a"], 21))
    c = -math.log(u(row["b"], 0) * u(row["b"], 21))
    t = math.floor(math.log(4) / r + u(row["a"], 42))
    y = math.exp(r * (t - u(row["a"], 42)))
    got = spark.range(1).select(weighted_sampling.sample_value(F.lit(row["h"]), F.lit(math.log(4)), 3).alias("x")).first()["x"]
    assert abs(got - math.log(c / (y * math.exp(r)))) < 1e-9


def test_fingerprint_weighs_terms_by_how_often_they_occur(spark):
    texts = ["spam " * 6 + "egg", "egg " * 3 + "spam", "Dd a dd, é a\u00e9 DD", "", "!!", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r["k"]: r["t"] for r in df.select("k", weighted_sampling.terms(F.col("text")).alias("t")).collect()}
    assert {t["term"]: t["n"] for t in got[0]} == {"spam": 6, "egg": 1}
    assert {t["term"]: t["n"] for t in got[2]} == {"dd": 3, "a": 1, "é": 1, "aé": 1} and len(got[2]) == 4 and got[5] is None
    prints = {r["k"]: r["fingerprint"] for r in weighted_sampling.fingerprints(df, ["k"], "text").collect()}
    # By distinct terms the two are equal, by their weights 7 of 33 agree.
    assert abs(true_likeness(texts[0], texts[1]) - 7 / 33) < 1e-9
    assert 1 <= sum(prints[0][i : i + 8] == prints[1][i : i + 8] for i in range(0, 256, 8)) <= 14
    assert prints[3] is None and prints[4] is None


def test_fingerprint_edges(spark):
    rows = [(5, "one text here"), (5, "one text here"), (None, "x"), (3, None), (2, ""), (9, "é" * 5), (2, "!!")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fingerprint int")
    got = weighted_sampling.compared(df).collect()
    assert len(got) == len(rows)
    own = {(r["doc_id"], r["n_chars"]): r for r in got}
    assert own[(3, 0)]["fingerprint"] == "0" * 256 and own[(3, 0)]["near_edited"] == 1.0
    assert own[(9, 5)]["edited_sha256"] == hashlib.sha256(("é" * 3 + "on").encode()).hexdigest()
    assert own[(None, 1)]["near_edited"] == 1.0
    one = weighted_sampling.compared(df.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0 and weighted_sampling.compared(df.limit(0)).count() == 0


def fill(budget, children):
    """``name: (weight, cap)`` to shares, by filling and fixing one full child after the other."""
    given, left = {}, {k: v for k, v in children.items() if v[0] > 0}
    while left:
        total = sum(w for w, _ in left.values())
        k, (w, cap) = min(left.items(), key=lambda x: (x[1][1] / x[1][0], x[0]))
        if cap * total <= w * budget:
            given[k] = cap
            budget -= cap
            del left[k]
        else:
            return given | {k: budget * w // total for k, (w, _) in left.items()}
    return given


def brute_mix(rows, plan):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaves = {}
    for i, d, lang, s, t in rows:
        leaves.setdefault((d, lang or "", s or ""), []).append((i, count(t)))
    size = {k: sum(n for _, n in v) for k, v in leaves.items()}
    weight = lambda level, key: plan.weights.get(level, {}).get(key, plan.default_weight)
    cap = lambda prefix: sum(n for k, n in size.items() if k[: len(prefix)] == prefix) * plan.max_epochs
    nodes = {(): sum(size.values()) * plan.budget_percent // 100}
    for depth, level in enumerate(source_mixing.LEVELS):
        nodes = {p + (k,): b for p, budget in nodes.items() for k, b in fill(budget, {k: (weight(level, k), cap(p + (k,))) for k in {x[depth] for x in size if x[:depth] == p}}).items()}
    out = []
    for leaf, budget in nodes.items():
        if size[leaf]:
            full, rest = divmod(budget, size[leaf])
            upto = 0
            for i, n in sorted(leaves[leaf], key=lambda x: (hashlib.md5(f"{plan.seed}:{full}:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] or 0)):
                upto += n
                copies = full + (upto <= rest)
                if copies:
                    out.append((i, leaf[0], n, copies))
    return sorted(out, key=str)


@pytest.mark.parametrize("percent", [10, 60, 150])
def test_mixing_against_brute_force(spark, percent):
    rng = random.Random(percent)
    plan = source_mixing.MixPlan({"domain": {"d0": 5, "d1": 2, "d3": 0}, "lang": {"en": 3}}, percent, 2, 5)
    rows = [(i, f"d{rng.choice([0, 0, 0, 1, 2, 3])}", rng.choice(["en", "de", None]), f"s{min(rng.randrange(9), 3)}", rng.choice([None, "", "w " * rng.randint(1, 60)])) for i in range(300)]
    df = spark.createDataFrame([(i, d, a, s, t, 1) for i, d, a, s, t in rows], "doc_id long, dom string, lang string, source string, text string, copies int")
    got = source_mixing.mixed(df, plan, F.col("dom"))
    assert sorted(((r["doc_id"], r["domain_key"], r["n_tokens"], r["copies"]) for r in got.collect()), key=str) == brute_mix(rows, plan)
    assert source_mixing.mixed(df.limit(0), plan, F.col("dom")).count() == 0
    narrow = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        source_mixing.BROADCAST_LEAVES = 0
        assert source_mixing.mixed(df, plan, F.col("dom")).count() == len(brute_mix(rows, plan))
    finally:
        source_mixing.BROADCAST_LEAVES = 20_000
        spark.conf.set("spark.sql.shuffle.partitions", narrow)


def test_pipeline_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    extra = spark.createDataFrame([(900, None, "en", "src1", 0), (901, "12 34", "en", "src1", 5), (902, 'the and token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" of the', "en", "src2", 60)], docs.schema)
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    path = public_tokenizers.path("piece_bpe_32k.model")
    start = spark.read.parquet(str(tmp_path / "documents.parquet"))
    scorer = language_unigrams.Scorer(language_unigrams.fit(start, path))
    rows = [r for r in start.collect() if (s := scorer.score([r["text"]])[0])["lang"] != "und" and s["score"] >= corpus_pipeline.MIN_LANGUAGE]
    comps = brute_components([(r["doc_id"], r["text"]) for r in rows], corpus_pipeline.NEAR)
    rows = [r for r, (i, _, c) in zip(rows, comps) if i == c]
    forest = secret_forest.fit(spark)
    found = {}
    for r in secret_forest.findings(spark.createDataFrame(rows, docs.schema), forest).where("is_secret").collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    texts = {}
    for r in rows:
        text = r["text"]
        for a, b in sorted(found.get(r["doc_id"], []), reverse=True):
            text = text[:a] + secret_forest.MASK + text[b:]
        texts[r["doc_id"]] = (text, r)
    domain = lambda s: ["web", "forum", "reference"][int(s[3:]) % 3]
    mix = brute_mix([(i, domain(r["source"]), r["lang"], r["source"], t) for i, (t, r) in texts.items()], queries.MIX)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((i, sp.encode(texts[i][0], add_eos=True)) for i, _, _, copies in mix for _ in range(copies))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == want
    assert all(r["round_trip"] for r in got) and 902 in texts and secret_forest.MASK in texts[902][0]
    assert not {900, 901} & set(texts)


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
