"""Personal data, the filter audit and hard negatives, against brute force and hard cases."""

import collections
import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergeloom.llm import decontam, filter_audit, hard_negatives, kneser_ney, line_runs, nbsvm, near_copies, pii, topk, vectors


# --- personal data


def plain_spans(t):
    """The patterns as the plainest regular expressions find them."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = digits(m[0])
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_patterns_against_plain_expressions():
    rng = random.Random(0)
    for _ in range(20000):
        s = "".join(rng.choice("a1@.+-9 %(2)5 .4ü") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(s) == plain_spans(s), s
    assert pii.base_spans("x 4539578763621486 y") == [(2, 2, 18)]


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000, "a@" * 100_000, "1." * 20_000, "+1" + "(" * 200_000, "1 " * 5_000, "@." * 100_000])
def test_patterns_in_linear_time(text):
    assert isinstance(pii.all_spans(text, {"phone any": -1.0}), list)


def made_rows(n, rng):
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8)))
    prose = lambda: " ".join(word() for _ in range(8))
    rows = []
    for i in range(n):
        card = [rng.randint(0, 9) for _ in range(15)]
        total = sum(2 * d - 9 * (d > 4) if j % 2 == 0 else d for j, d in enumerate(card))
        span = [f"{word()}.{rng.randint(1, 99)}@{word()}.example.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)), "".join(map(str, card)) + str(-total % 10), f"+1 ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"]
        rows += [(k, prose() + " ", s, " " + prose()) for k, s in enumerate(span)]
    return rows


def test_random_field():
    rng = random.Random(4)
    rows = made_rows(60, rng)
    weights = pii.train(rows[:160])
    found = wanted = false = 0
    for kind, before, s, after in rows[160:]:
        for x, good in pii._spellings(kind, s):
            spans = pii.all_spans(before + x + after, weights)
            assert [v[:3] for v in spans if v[3]] == pii.base_spans(before + x + after)
            own = [v for v in spans if not v[3]]
            if good:
                wanted += 1
                found += any((k, a, b) == (kind, len(before), len(before) + len(x)) for k, a, b, _ in spans)
            else:
                false += bool(own)
    assert found >= 0.95 * wanted and false <= 0.03 * wanted
    for clean in ("", "no such thing here at all. Dot and more", "in 1999 and 12.5 %, at 10:30, v1.2.3, 100,000", "he is at home. Then dot"):
        assert pii.all_spans(clean, weights) == []


def test_sums_and_paths_against_enumeration():
    """Probabilities and the best segmentation of small lattices against all segmentations."""
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 6)
        found = []
        for c in range(rng.randint(1, 6)):
            i = rng.randrange(n)
            found.append((i, rng.randint(i + 1, n), rng.randrange(4), [f"f{c}"]))
        weights = {f"f{c}": rng.uniform(-2, 2) for c in range(len(found))} | {pii.ADJACENT: rng.uniform(-1, 1)}
        ways = []
        for mask in range(1 << len(found)):
            chosen = sorted((c for c in range(len(found)) if mask >> c & 1), key=lambda c: found[c][:2])
            if all(found[a][1] <= found[b][0] for a, b in zip(chosen, chosen[1:])):
                met = sum(found[a][1] == found[b][0] for a, b in zip(chosen, chosen[1:]))
                ways.append((sum(weights[f"f{c}"] for c in chosen) + met * weights[pii.ADJACENT], chosen, met))
        total = sum(np.exp(w) for w, _, _ in ways)
        shares, adjacent = pii.expected(n, found, weights)
        for c in range(len(found)):
            assert shares[c] == pytest.approx(sum(np.exp(w) for w, x, _ in ways if c in x) / total)
        assert adjacent == pytest.approx(sum(np.exp(w) * m for w, _, m in ways) / total)
        best = max(w for w, _, _ in ways)
        path = pii.decode(n, found, weights)
        assert any(x == path and w == pytest.approx(best) for w, x, _ in ways)


def test_pii_rows(spark):
    rng = random.Random(9)
    rows = [(i, b + s + a) for i, (_, b, s, a) in enumerate(made_rows(40, rng))]
    rows += [(500, None), (501, ""), (502, "write to jo (at) example (dot) com"), (502, "again 8.8.8.8"), (None, "1.1.1.1 ü 日本 +1 (555) 123-4567"), (503, "word " * 30000 + "a@b.co")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, spans string, kind int, base int")
    model = pii.fitted(docs)
    got = pii.digests(pii.find_pii(docs, model)).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t in rows:
        base = plain_spans(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        want[i, hashlib.sha256(text.encode()).hexdigest(), *(sum(s[0] == k for s in base) for k in range(4))] += 1
    assert collections.Counter((r["doc_id"], r["base_sha256"], *(r[f"n_{k}"] for k in pii.KINDS)) for r in got) == want
    assert {r["spans"] for r in got if r["doc_id"] in (500, 501)} == {""}
    assert any("email:9:" in r["spans"] and r["n_added"] == 1 for r in got if r["doc_id"] == 502)
    assert model == pii.fitted(docs.repartition(5)), "the sample does not depend on the layout"
    none = docs.where("doc_id = 501")
    assert pii.fitted(none) is None and pii.digests(pii.find_pii(none, None)).first()["spans"] == ""
    assert pii.find_pii(docs.limit(0), None).count() == 0


# --- filter audit


def test_filter_audit(spark):
    rng = random.Random(2)
    words = ["Alpha", "beta", "GAMMA", "x$", "delta", "a\tb", "c\nd"]
    texts = [None, "", "same text", "UPPER", *(" ".join(rng.choice(words[: rng.randint(1, 7)]) for _ in range(rng.choice([3, 150, 250]))) for _ in range(40)), " ".join(f"w{i}" for i in range(60000))]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(300)] + [(5, "same text", "en"), (5, "same text", "en"), (None, "same text", "en"), (None, texts[6], "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, lang string, part int, words string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    judged = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        judged.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    want = {}
    for part in {p for p, *_ in judged}:
        own = [x for x in judged if x[0] == part]
        total = collections.Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone, kept = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                total[f] += len(gone)
                want[part, "".join(order), k + 1] = [len(kept), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                left = kept
        for (p, order, k), row in want.items():
            if p == part:
                row.append(total[order[k - 1]])
    got = {tuple(r[:3]): list(r[3:]) for r in filter_audit.audit(filter_audit.flagged(docs, said)).collect()}
    assert got == want
    assert filter_audit.audit(filter_audit.flagged(docs.limit(0), said)).count() == 0
    assert filter_audit.audit(filter_audit.flagged(docs.limit(3), said.limit(0))).where("good_lost + toxic_lost > 0").count() == 0


# --- hard negatives


def mined(rows):
    """Plain search: rows (id, label, vector)."""
    live = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        live.append((i, label, [int(np.floor(256 * np.float64(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = collections.Counter()
    for n, (i, label, v) in enumerate(live):
        if i % 50:
            continue
        scored = [(-dot(v, x), j, lab == label) for m, (j, lab, x) in enumerate(live) if m != n]
        for s, j, _ in sorted(x for x in scored if x[2])[:5]:
            inside = sorted((t, k) for t, k, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            for r, (t, k) in enumerate(inside):
                out[i, j, r + 1, k, str(-s), str(-t)] += 1
    return out


def test_hard_negatives(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(size=6) * rng.choice([0.1, 1, 4])]) for i in range(400)]
    same = [0.5, 0.25, 0.0, 0.0, 0.0, 0.5]
    rows += [(1000 + i, i % 2, same) for i in range(150)]  # one vector many times: ties
    rows += [(50, 1, rows[50][2]), (50, 1, rows[51][2]), (50, 2, rows[52][2])]  # several rows of one id
    rows += [(2000, None, same), (2050, 1, None), (2100, 1, [0.1, None]), (2150, 1, [float("nan")]), (2200, 1, [float("inf")]), (None, 1, same), (2250, 1, []), (2300, 0, [1.0]), (2301, 0, [0.9, 0.1] * 5)]
    rows += [(3000, 1, [1e17, 1.0]), (3001, 1, [1e17, 2.0]), (3002, 0, [7e16, 0.0]), (3003, 0, [1e9, 1e9]), (3050, 0, [-1e17, 0.0])]  # beyond doubles and longs
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, label int, embedding array<double>, v string, norm double")
    for bucket, block in ((hard_negatives.BUCKET, vectors.BLOCK_BYTES), (16, 2000)):
        monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
        monkeypatch.setattr(vectors, "BLOCK_BYTES", block)
        got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect()
        assert collections.Counter((r[0], r[1], r[2], r[3], r["positive_score_text"], r["negative_score_text"]) for r in got) == mined(rows)
        for r in got:
            for c in ("positive_score", "negative_score"):
                exact = int(r[c + "_text"])
                assert r[c] == (exact if abs(exact) < 1 << 63 else None)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(df.where("vec_id = 50").limit(1), F.col("vec_id") % 50 == 0).count() == 0


def test_wide_scores_sort_as_numbers(spark):
    scores = [0, 5, -5, 1 << 62, -(1 << 63), 1 << 63, -(1 << 63) - 1, 10**30, -(10**30), 10**31, -(10**31), 10**30 + 1]
    df = spark.createDataFrame([(vectors.as_long(s), vectors.wide_key(s)) for s in scores], "score long, wide string")
    got = [int(r[0]) for r in df.orderBy(*vectors.by_score()).select(vectors.score_text()).collect()]
    assert got == sorted(scores, reverse=True)


# --- exact top-k


def test_top_k_of_shared_ids_and_wide_vectors(spark):
    """Queries that share an id have their own rows; components up to the end of a double's range take part, exactly."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(i, [i / 16, 1 - i / 16]) for i in range(1, 17)]
    rows += [(100, [1e17, 0.0]), (101, [1e17, 1.0]), (102, [-1e17, 0.0]), (103, [1e300, -1e300]), (104, [1e307, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, key int")
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id IN (0, 50, 100, 103)")).collect()]
    live = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if np.isfinite(256 * np.float64(v)).all()]
    want = collections.Counter()
    for n, (i, v) in enumerate(live):
        if i in (0, 100, 103):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(live) if m != n)[:5]
            for r, (s, j) in enumerate(scored):
                want[i, r + 1, j, -s if -(1 << 63) <= -s < 1 << 63 else None, str(-s)] += 1
    assert collections.Counter(got) == want and sum(r[0] == 0 for r in got) == 10


# --- stages: names, layouts, long texts


def test_short_items_and_long_texts(spark):
    """A word of the benchmark empties no corpus; a passage in the middle of a very long text is found."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    item = [rng.choice(vocab) for _ in range(25)]
    bench = spark.createDataFrame([(0, "a"), (1, " ".join(item)), (2, "w1 w2")], "item_id long, text string")
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = [(0, "a house and a tree"), (1, " ".join([*words(150_000), *item, *words(150_000)])), (2, " ".join(words(50))), (3, None)]
    docs = spark.createDataFrame([(*r, "mine", "too") for r in rows], "doc_id long, text string, __row string, _ml_text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert {(0, 0), (1, 1)} <= found and (2, 1) not in found
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(tuple(r)[0::2] for r in kept.collect()) == [(0, "mine"), (2, "mine"), (3, "mine")]


def test_stages_keep_columns_of_their_own_names(spark):
    rng = random.Random(1)
    line = "one long line that stands in all of these documents"
    rows = [(i, f"{line}\n" + " ".join(rng.choice("abcdefgh") * 3 for _ in range(30)), "en", "r", "t", "d") for i in range(8)] + [(7, "x", "en", "r", "t", "d"), (None, None, None, "r", "t", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __row string, _ml_text string, _ml_drops string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    for out in (line_runs.dedup_lines(docs), near_copies.keep_one_per_group(docs), kneser_ney.keep_good(docs, labels)):
        assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {("r", "t", "d")}
    assert line_runs.dedup_lines(docs).where(F.col("text").contains(line)).count() == 1


def test_quality_does_not_depend_on_the_layout(spark):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    rows = [(i, " ".join(word("aeinrst" if i % 5 else "qxzjkvw") for _ in range(40)), rng.choice(["en", None])) for i in range(200)]
    rows += [(i, rows[i][1], rows[i][2]) for i in (1, 2, 3)] + [(900, rows[6][1], "en"), (901, "word " * 40000, "en")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, nats int, unseen int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200) if i % 5], "doc_id long, quality int, toxic int")
    kept = [sorted((r["doc_id"], r["text"]) for r in kneser_ney.keep_good(docs.repartition(n), labels).collect()) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and len({i for i, _ in kept[0]} & set(range(0, 200, 5))) < 5
    assert sum(i % 5 > 0 for i, _ in kept[0]) > 140


def test_toxicity_ratios(spark):
    """Weights are log-count ratios times what the regression learns: with one character n-gram that tells, its sign and the scores follow; clashing names and long texts."""
    a, b = "zyx", "abc"
    docs = [np.unique(nbsvm.ngram_cells(f"{a if i % 2 else b} word{i % 7}")) for i in range(60)]
    labels = np.array([i % 2 for i in range(60)])
    weights, intercept = nbsvm.fit(docs, labels)
    own = lambda t: set(nbsvm.ngram_cells(t).tolist())
    for cell in own("zyx") - own("abc"):
        df1, df0 = (sum(cell in d for d, y in zip(docs, labels) if y == k) for k in (1, 0))
        if weights[cell]:
            p, q = (df1 + 1) / 32, (df0 + 1) / 32
            assert np.sign(weights[cell]) == np.sign(np.log(p / q))
    assert nbsvm.score(a, weights, intercept) > 0.5 > nbsvm.score(b, weights, intercept)
    table = spark.createDataFrame([(1, "zyx " * 50000, 5), (1, "abc", 5), (None, None, 5)], "doc_id long, text string, score int")
    got = nbsvm.classify(table, (weights, intercept)).collect()
    assert sorted(r["predicted"] for r in got if r["doc_id"] == 1) == [0, 1] and len(got) == 3


# --- line runs


def test_runs_are_merged_as_they_lie(spark):
    """The join of a batch with the runs deals and sorts the batch alone."""
    rows = [(b, f"line{i}".encode(), 10 * b + d) for b in range(3) for i in range(40) for d in range(2)]
    df = spark.createDataFrame(rows, "b int, h binary, doc_id long")
    store = line_runs.RunStore(spark, fanout=9)
    for b in range(2):
        store.add(df.where(F.col("b") == b).select("doc_id", "h"))
    batch = df.where("b = 2").groupBy("h").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
    with line_runs.ordered_scans(spark):
        plan = store.merged(batch)._jdf.queryExecution().executedPlan().toString()
        # the two exchanges and the sort are those of the batch's own counts
        assert plan.count("Bucketed: true") == 2 and plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 1
        merged = store.merged(batch)
        assert merged.where("fresh").count() == 0 and merged.count() == 40
    store.close()
    assert store.levels == [] and not store.tables
