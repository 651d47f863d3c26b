"""Merkle manifest, whitening and rule ensemble against brute force on small tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from meterwise.llm import catalog, merkle, rule_ensemble, whitening  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp string, leaf string, pos string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


# --- 11 Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    def leaf(i, text, lang, source, n):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][k:k + 3]) for k in range(0, len(out[-1]), 3)])
        return out

    def path(levels, k):
        out = []
        for level in levels[:-1]:
            s = k - k % 3
            out.append(("".join(level[s:k]), "".join(level[k + 1:s + 3])))
            k //= 3
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(((r[0] is not None, r[0] or 0, leaf(*r)), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[0][2] for x in sorted(groups[g], key=lambda x: x[0])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for j, (key, r) in enumerate(sorted(groups[g], key=lambda x: x[0])):
            p, h = path(trees[g], j) + path(top, k), key[2]
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0 and r[1] is not None:
                h = leaf(r[0], r[1].replace("\n", ""), *r[2:])
            for a, b in p:
                h = sha(a, h, b)
            out.append((-1 if r[0] is None else r[0], key[2], trees[g][-1][0], top[-1][0], sha(*[a + b for a, b in p]), h, h == top[-1][0]))
    return sorted(out)


def proved(spark, rows, tmp_path, name):
    folder = f"{tmp_path}/{name}"
    documents(spark, rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = catalog.op11_merkle_manifest(spark, folder).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got)


def manifest_rows():
    rng = random.Random(2)
    rows = []
    for i in range(1900):  # one source of two blocks, small ones, ids far apart and negative
        source = "hot" if i % 2 else rng.choice(["a", "é", "B", "", None, "hot2"])
        rows.append((rng.choice([i, i * 70_000, -i, i << 40]), rng.choice(["x\ny", "z", "", None, "w" * 500 + "\n"]), rng.choice(["en", None]), source, rng.choice([None, 5])))
    rows += [(7, "same\n", "en", "copies", 1)] * 1500          # one row more often than a block holds
    rows += [(8, f"t{k}", "en", "copies", 1) for k in range(40)]  # one id, many texts
    rows += [(None, f"n{k % 3}\n", "en", "copies", 1) for k in range(9)] + [(None, None, None, None, None), (1 << 62, "q", None, "one", None)]
    return rows


def test_manifest_matches_brute_force(spark, tmp_path):
    rows = manifest_rows()
    assert proved(spark, rows, tmp_path, "all") == brute_manifest(rows)


@pytest.mark.parametrize("count", [0, 1, 3])
def test_small_manifests(spark, tmp_path, count):
    rows = [(i, "a\nb", "en", "s", 3) for i in range(count)]
    assert proved(spark, rows, tmp_path, "few") == brute_manifest(rows)


def test_proofs_verify_and_find_changes(spark):
    rows = [(i, f"text {i}\n", "en", f"s{i % 3}", i) for i in range(50)]
    build = merkle.build(documents(spark, rows), "doc_id", "source", ["doc_id", "text"], {"text": F.when(F.col("doc_id") == 9, F.lit("other")).otherwise(F.col("text"))})
    got = {r.id: r for r in merkle.prove(build).collect()}
    assert build.root and {i for i, r in got.items() if not r.verified} == {9}
    for r in got.values():
        assert merkle.fold(r.leaf, [(p.left, p.right) for p in r.proof]) == build.root and r.grp == f"s{r.id % 3}"
    assert {r.grp: r.rows for r in build.subroots.collect()} == {"=s0": 17, "=s1": 17, "=s2": 16}


# --- 12 whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, n int")


def brute_whitening(rows, most=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s).astype(float) / n
    e, v = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-e)
    order = [i for i in order if e[i] > 1e-9 * max(e.max(), 1e-300)][:most]
    return n, [int(((n * r - s) ** 2).sum()) for r in x], z @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def check_whitening(spark, rows, simple=True):
    got = whitening.whiten(vectors(spark, rows).repartition(2), "vec_id", "embedding").toPandas()
    n, deviation, white, explained = brute_whitening(rows)
    k = white.shape[1]
    assert len(got) == len(rows) * k and set(got.n) <= {n} and (got.identity_error <= 1e-4).all()
    table = got.pivot(index="id", columns="component", values="whitened")
    for at, (i, _) in enumerate(rows):
        assert set(got[got.id == i].deviation) == {deviation[at]}
    if simple:
        ours, theirs = table.loc[[i for i, _ in rows]].to_numpy(), white
        assert np.allclose(np.abs(ours), np.abs(theirs), atol=1e-6) and np.allclose(np.abs((ours * theirs).mean(axis=0)), 1, atol=1e-6)
    shares = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(shares, explained, rtol=1e-6) and (np.diff(shares) <= 1e-12).all()


def test_whitening_matches_eigenvectors(spark):
    rng = np.random.default_rng(1)
    check_whitening(spark, [(i, [float(c) for c in rng.normal(0, 1, 6) * [9, 7, 5, 3, 2, 1]]) for i in range(200)])
    check_whitening(spark, [(i, [float(c)]) for i, c in enumerate(rng.normal(0, 3, 20))])
    # rank below the dimension: eigenvalue 0 has no component
    base = rng.normal(0, 2, (60, 2))
    check_whitening(spark, [(i, [math.floor(64 * a) / 64, math.floor(64 * b) / 64, math.floor(64 * a) / 64, 5.0]) for i, (a, b) in enumerate(base)])


def test_whitening_with_equal_eigenvalues_and_large_entries(spark):
    rows = [(i, [float(s * (k == j)) for j in range(5)]) for i, (k, s) in enumerate([(k, s) for k in range(5) for s in (-8, 8)])]
    check_whitening(spark, rows, simple=False)  # all eigenvalues are equal
    huge = [(i, [c * 1e30, -c]) for i, c in enumerate([1.0, 2.0, 4.0])]  # ends of a long's range: equal values, no variance
    got = whitening.whiten(vectors(spark, huge), "vec_id", "embedding").collect()
    assert {r.component for r in got} == {1} and len(got) == 3
    wide = [(i, [c * 1e12, float(k)]) for i, (c, k) in enumerate([(1.0, 3), (2.0, -5), (4.0, 1)])]
    assert {r.deviation for r in whitening.whiten(vectors(spark, wide), "vec_id", "embedding").collect()} == {None}  # beyond a long


def test_whitening_leaves_out_unusable_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(c) for c in rng.normal(0, 1, 3)]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, good + bad + [(3, good[3][1]), (None, good[5][1])]), "vec_id", "embedding").toPandas()
    assert set(got.n) == {42} and sorted(got.id.dropna().unique()) == list(range(40)) and len(got) == 42 * 3
    assert whitening.whiten(vectors(spark, bad), "vec_id", "embedding").count() == 2 * 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), "vec_id", "embedding").count() == 0
    assert whitening.whiten(vectors(spark, good).limit(0), "vec_id", "embedding").count() == 0


def test_polynomial_and_roots():
    rng = np.random.default_rng(5)
    a = rng.integers(-3, 4, (5, 5))
    m = [[int(x) for x in r] for r in a @ a.T]
    p = 2147483647
    want = [int(round(x)) for x in np.poly(np.array(m))[::-1]]
    assert [int(x) if x < p // 2 else int(x) - p for x in whitening.polynomial_mod(np.array(m), p)] == want
    roots = whitening.largest_roots(want, 3)
    exact = np.sort(np.linalg.eigvalsh(np.array(m)))[::-1][:3]
    assert np.allclose([float(Decimal(n) / Decimal(2) ** e) for n, e, _ in roots], exact)
    # (t - 3)^2 (t - 1) t: a double root and a zero
    assert [(round(n / 2 ** e, 9), k) for n, e, k in whitening.largest_roots([0, -9, 15, -7, 1], 5)] == [(3.0, 2), (1.0, 1)]
    assert whitening.above([-9, 15, -7, 1], 2) == 2 and whitening.largest_roots([0, 0, 1], 4) == []


# --- 13 rules


def quality_rows(n=300):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        bad = i % 6 == 0
        text = " ".join(w + "###" for w in words) if bad and i % 4 else " ".join(words[:2] * 30) if bad else " ".join(words) + "."
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_rules_learn_and_agree_with_a_plain_loop(spark):
    rows, labels = quality_rows()
    odd = [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "word " * 30_000, "en", "s", 0), (None, rows[1][1], "en", "s", 0), (5, rows[6][1], "en", "s", 0)]
    docs = documents(spark, rows + odd)
    lab = spark.createDataFrame(labels[:200] + [(None, 1, 0), (901, None, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    seen = rule_ensemble.described(docs, "text")
    model = rule_ensemble.fit(seen, lab)
    assert model.rules and len(model.rules) < rule_ensemble.TREES * 2 ** (rule_ensemble.DEPTH + 1)
    got = rule_ensemble.score(seen, model).collect()
    assert len(got) == len(rows) + len(odd) and set(rule_ensemble.score(seen, model).columns) == {*docs.columns, "score", "rules"} - {"text"}
    by = {r.doc_id: r.score for r in got if r.doc_id != 5}
    assert sum((by[i] >= 0.3) == (i % 6 != 0) for i in range(200, 300)) >= 98 and all(0 <= r.score <= 1 for r in got)
    for r in seen.collect():  # every rule by hand
        total = model.intercept
        for rule, weight in model.rules:
            total += weight * all((low is None or r["_stat_" + n] > low) and (high is None or r["_stat_" + n] <= high) for n, low, high in rule.bounds)
        assert any(abs(1 / (1 + math.exp(-total)) - g.score) < 1e-9 for g in got if g.doc_id == r.doc_id)


def test_rules_without_labels_or_rows(spark):
    rows, labels = quality_rows(12)
    seen = rule_ensemble.described(documents(spark, rows), "text")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r.score for r in rule_ensemble.score(seen, rule_ensemble.fit(seen, lab.limit(0))).collect()} == {0.5}
    assert {r.score for r in rule_ensemble.score(seen, rule_ensemble.fit(seen, lab.filter("quality = 1"))).collect()} == {1.0}
    empty = rule_ensemble.described(documents(spark, rows).limit(0), "text")
    assert rule_ensemble.score(empty, rule_ensemble.fit(empty, lab)).count() == 0


def test_tree_paths_become_rules():
    text = "DecisionTree\n  If (feature 0 <= 0.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 0.5)\n   Predict: 1.0\n"
    assert [str(r) for r in rule_ensemble.tree_rules(text, ["a", "b"])] == ["a <= 0.5", "a <= 0.5 and b <= 2.0", "a <= 0.5 and 2.0 < b", "0.5 < a"]
    assert rule_ensemble.conjunction([("a", "<=", 3.0), ("a", "<=", 2.0), ("a", ">", 1.0)]).bounds == (("a", 1.0, 2.0),)


def test_statistics_by_hand(spark):
    r = rule_ensemble.described(documents(spark, [(1, "Ab cd! 12\n\nab Ab", "en", "s", 1), (2, None, "en", "s", 1)]), "text").orderBy("doc_id").collect()
    x = {k: r[0]["_stat_" + k] for k in rule_ensemble.NAMES}
    assert x["word_length"] == 11 / 5 and x["upper_share"] == 2 / 8 and x["digit_share"] == 2 / 16 and x["kind_share"] == 3 / 5 and x["line_share"] == 1.0
    assert x["end_share"] == 1 / 5 and x["pure_share"] == 4 / 5 and x["mark_share"] == 1 / 16
    assert all(r[1]["_stat_" + k] == 0 for k in rule_ensemble.NAMES)
