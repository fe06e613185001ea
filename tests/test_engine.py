"""The merge engine on small tables, against literal results and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from mergeloom.functions import standardize as st
from mergeloom.__main__ import main
from mergeloom.functions import models
from mergeloom.functions.embed import HashingNgramEmbedder, ModelEmbedder, PrecomputedEmbedder
from mergeloom.functions.similarity import levenshtein_similarity
from mergeloom.operators import assign as asg
from mergeloom.operators import bertscore, classify, match, merge, profile
from mergeloom.operators import pairs as pairs_module
from mergeloom.plans.integrate import Config, integrate, stack_tables
from mergeloom.plans.queries import ORACLE_SQL, QUERIES
from mergeloom.sources import tables


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_clean(spark):
    assert column(spark, ["''", " ", "x", None], st.null_clean) == [None, None, "x", None]
    assert column(spark, ["'a b'", "chefs'", "'", "x"], st.strip_quotes) == ["a b", "hefs", "", "x"]


def test_standardisers(spark):
    assert column(spark, ["Bob H. Goldberg", "smith, john a.", None], st.person_name) == ["Bob Goldberg", "John Smith", None]
    times = ["3pm", "15:51:43am", "19:31", "12:52 AM", "11:35 PM", "12:03 AM", "15:30pm", "0pm", "24", "abc", None]
    assert column(spark, times, st.clock_time) == ["15:00:00", "15:51:43", "19:31:00", "00:52:00", "23:35:00", "00:03:00", "27:30:00", "12:00:00", "24:00:00", "00:00:00", None]
    assert column(spark, ["$1,234.5"], st.number_text) == ["$1234.5"]
    assert column(spark, ["9/4/2024", "14/12/2023", "NULL"], st.date_text) == ["2024-09-04", "2023-12-14", "Invalid Date"]


def test_temperature(spark):
    df = spark.createDataFrame([(0, "39.8C"), (1, None), (2, "100F")], "r int, t string")
    plan = st.plan_temperature(df, "t", "r")
    assert [r[0] for r in df.orderBy("r").select(st.temperature(F.col("t"), plan)).collect()] == ["39.8", None, "37.8"]
    bare = spark.createDataFrame([(0, "95")], "r int, t string")
    assert bare.select(st.temperature(F.col("t"), st.plan_temperature(bare, "t", "r"))).first()[0] == "203.0"
    assert bare.select(st.temperature(F.col("t"), st.plan_temperature(bare, "t", "r", assume_column_unit=True))).first()[0] == "95.0"


def test_stack_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,Temperature,Age (years)\nAnn Lee,39.8\nBo,,24\n")
    (tmp_path / "b.csv").write_text("Temp,Status,Full Name\n95,High,David Roe\n")
    (tmp_path / "c.csv").write_text("Category,Similar,,\nname,name,full name,\ntemperature,temperature,temp,\nage,age,years,\nstatus,status,state,\n")
    out = stack_tables(tables.read_table(spark, str(tmp_path / "a.csv")), tables.read_table(spark, str(tmp_path / "b.csv")), tables.read_aliases(spark, str(tmp_path / "c.csv")))
    assert out.columns == ["name", "temperature", "age", "status"]
    assert sorted(map(tuple, out.na.fill("NULL").collect())) == [("Ann", "39.8", "NULL", "NULL"), ("Bo", "NULL", "24", "NULL"), ("David Roe", "95", "NULL", "High")]
    tables.write_table(out, str(tmp_path / "out"), single_file=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).where("age = 'NULL'").count() == 2


def test_profile(spark):
    df = spark.createDataFrame([(str(i), f"n{i}", "x") for i in range(10)], "a string, b string, c string")
    assert profile.kinds(df, ["a", "b", "c"]) == {"a": "numerical", "b": "unique", "c": "categorical"}


def brute(scores, t):
    best = 0.0
    for choice in itertools.product(*[[-1, *range(len(scores[0]))] for _ in scores]):
        used = [c for c in choice if c >= 0]
        if len(used) == len(set(used)) and all(scores[i][c] > t for i, c in enumerate(choice) if c >= 0):
            best = max(best, sum(scores[i][c] - t for i, c in enumerate(choice) if c >= 0))
    return best


def test_assignment(spark):
    rng = random.Random(1)
    for _ in range(200):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        scores = [[rng.choice([0.2, 0.5, 0.7, 0.9]) for _ in range(m)] for _ in range(n)]
        gain = asg.np.array([[max(0.0, s - 0.4) for s in r] for r in scores])
        chosen = asg.optimal(gain)
        used = [c for c in chosen if c >= 0]
        assert len(used) == len(set(used))
        assert sum(gain[i, c] for i, c in enumerate(chosen) if c >= 0) == pytest.approx(brute(scores, 0.4))
        cut = [[s if s > 0.4 else 0 for s in r] for r in scores]
        assert asg.beam_paths(cut, 0.4)[0] - 0.4 * n == pytest.approx(brute(scores, 0.4))
    edges = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.8), (5, 5, 0.7), (6, 6, 0.1), (7, 7, float("nan"))], "left_id long, right_id long, score double")
    assert sorted((r[0], r[1]) for r in asg.assign(edges, 0.5).collect()) == [(0, 1), (1, 0), (5, 5)]
    assert asg.assign(edges.limit(0), 0.5).count() == 0


def test_merge(spark):
    left = spark.createDataFrame([(0, "a", None), (1, "b", "x")], "id long, name string, city string")
    right = spark.createDataFrame([(7, "A", "paris", "1"), (8, "C", "rome", "2")], "id2 long, title string, city string, extra string")
    matches = spark.createDataFrame([(0, 7)], "left_id long, right_id long")
    out = merge.merge_tables(left, right, {"name": "title", "city": "city"}, matches, "id", "id2")
    assert out.columns == ["name", "city", "extra"]
    assert sorted(out.na.fill("-").collect()) == [("C", "rome", "2"), ("a", "-", "1"), ("b", "x", "-")]
    assert merge.match_audit(left, right, matches, "id", "id2").count() == 3


def test_integrate_finds_pairs(spark):
    names = [("golden dragon", "1 main st"), ("blue parrot", "22 oak ave"), ("chez marie", "9 rue x"), ("noodle house", "77 pine rd")]
    left = spark.createDataFrame(names, "name string, addr string")
    right = spark.createDataFrame([(n.upper().lower() + "s", a) for n, a in reversed(names[:3])], "name string, addr string")
    out = integrate(left, right, Config(schema_threshold=0.5, standardize=False))
    assert out.schema_map == {"name": "name", "addr": "addr"}
    assert out.merged.count() == 4 and out.entity_map.count() == 3 and out.matches.count() == 4


def test_classification(spark):
    df = spark.createDataFrame([("10:30 AM", "$10 and $13.23"), ("11:15 PM", "$6.23")], "time string, `the salary is` string")
    found = {r["column"]: r["category"] for r in classify.classify(df, HashingNgramEmbedder()).collect()}
    assert found["time"] == "time" and found["the salary is"] == "money"


def test_scores(spark):
    same = spark.createDataFrame([(0, "big red house", ["small cat", "big red house"]), (1, "", ["x"])], "pair_id int, candidate string, references array<string>")
    out = {r["pair_id"]: r for r in bertscore.score(same).collect()}
    assert out[0]["F"] == pytest.approx(1.0) and out[1]["F"] == 0
    words = lambda *w: spark.createDataFrame([(list(w),)], "words array<string>")
    matrix = {(r["i"], r["j"]): r["score"] for r in bertscore.word_similarity(words("name", "phone"), words("phone", "names"), HashingNgramEmbedder()).collect()}
    assert matrix[1, 0] == pytest.approx(1.0) and matrix[0, 1] > matrix[0, 0]
    one = spark.createDataFrame([("", "")], "a string, b string")
    assert one.select(levenshtein_similarity(F.col("a"), F.col("b"))).first()[0] == 1.0


def test_assignment_of_any_ids(spark):
    """Ids near the ends of a long, and texts; both sides may use the same ids."""
    top = (1 << 63) - 1
    rows = [(top, top, 0.9), (top, top - 1, 0.8), (top - 1, top, 0.8), (-top, top - 1, 0.55), (1 << 62, (1 << 62) + 1, 0.7), (None, 3, 0.9)]
    got = asg.assign(spark.createDataFrame(rows, "left_id long, right_id long, score double"), 0.5).collect()
    assert sorted((r[0], r[1]) for r in got) == sorted([(top, top - 1), (top - 1, top), (1 << 62, (1 << 62) + 1)])
    got = asg.assign(spark.createDataFrame([("a", "a", 0.9), ("a", "b", 0.8), ("b", "a", 0.8)], "left_id string, right_id string, score double"), 0.5).collect()
    assert sorted((r[0], r[1]) for r in got) == [("a", "b"), ("b", "a")]


def test_large_component(spark):
    """One component of thousands of nodes, whose best total is known: a long chain, where every second edge is best."""
    n = 1500
    rows = [(i, i, 0.6) for i in range(n)] + [(i, i + 1, 0.9) for i in range(n)]
    got = asg.assign(spark.createDataFrame(rows, "left_id long, right_id long, score double"), 0.5).collect()
    assert len(got) == n and sum(r["score"] for r in got) == pytest.approx(0.9 * n)


def test_categories(spark):
    """Equal values of two columns stand for each other, and pairs are scored by that."""
    cities = ["springfield", "shelbyville", "ogdenville", "north haverbrook"]
    left = spark.createDataFrame([(i, cities[i % 4]) for i in range(20)] + [(20, None)], "id long, city string")
    right = spark.createDataFrame([(i, ["Springfield", "Shelbyville", "capital city", "brockway"][i % 4]) for i in range(20)], "id2 long, town string")
    found = {(r["value1"], r["value2"]) for r in match.match_categories(left, "city", right, "town", HashingNgramEmbedder()).collect()}
    assert {("springfield", "Springfield"), ("shelbyville", "Shelbyville")} <= found and len(found) <= 4
    pairs = match.score_pairs(left, right, {"city": "town"}, "id", "id2", embedder=HashingNgramEmbedder()).collect()
    assert {(r[0], r[1]) for r in pairs if r[0] % 4 < 2} == {(i, j) for i in range(20) for j in range(20) if i % 4 == j % 4 < 2}


def test_pairs_against_all(spark, monkeypatch):
    """Scored pairs against every pair, for thresholds that prune and that do not, in one cell of the grid and in many."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
    a = [(i, f"{word()}{i}", rng.choice([None, rng.random() * 100]), rng.choice("xyz"), f"{i}-{word()}") for i in range(40)]
    b = [(i, f"{word()}{i}", rng.random() * 100, rng.choice("xyz"), rng.choice([None, f"{i}-{word()}"])) for i in range(50)]
    left = spark.createDataFrame([(i, n, None if v is None else str(v), c, t) for i, n, v, c, t in a], "id long, n string, v string, c string, t string")
    right = spark.createDataFrame([(i, n, str(v), c, t) for i, n, v, c, t in b], "id2 long, n2 string, v2 string, c2 string, t2 string")

    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, q in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
        return row[-1]

    text = lambda x, y: 1.0 if not x and not y else 1 - lev(x, y) / max(len(x), len(y))
    full = {"n": "n2", "v": "v2", "c": "c2", "t": "t2"}
    kinds = profile.kinds(left, ["n", "v", "c", "t"]), profile.kinds(right, ["n2", "v2", "c2", "t2"])
    values = [x for *_, x, _, _ in a if x is not None] + [x for *_, x, _, _ in b]
    sigma = float(asg.np.std(values))
    for cell in (1024, 16):
        monkeypatch.setattr(pairs_module, "CELL", cell)
        for names in (["n", "v"], ["n", "v", "c", "t"], ["v"], ["c", "n"]):
            for threshold in (0.3, 0.6, 0.9):
                got = {(r[0], r[1]): r[2] for r in match.score_pairs(left, right, {k: full[k] for k in names}, "id", "id2", threshold, exact_categories=True).collect()}
                want = {}
                for x in a:
                    for y in b:
                        s = 0.0
                        for k in names:
                            at = "_nvct".index(k)
                            p, q = x[at], y[at]
                            kind = kinds[0][k] if kinds[0][k] == kinds[1][full[k]] else "mixed"
                            if kind == "unique":
                                s += text("NULL" if p is None else str(p), "NULL" if q is None else str(q))
                            elif kind == "numerical":
                                s += 0.0 if p is None or q is None else 1 / (abs(p - q) / sigma + 1)
                            elif kind == "categorical":
                                s += float(p == q)
                        if s / len(names) > threshold:
                            want[x[0], y[0]] = s / len(names)
                assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_nulls_at_the_source(spark, tmp_path):
    """What the sinks write as NULL comes back as null, and is no time and no name."""
    df = spark.createDataFrame([("Ann", None), (None, "3pm"), ("Bo", "NULL x")], "name string, time string")
    tables.write_table(df, str(tmp_path / "t"), single_file=True)
    back = tables.read_table(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert sorted(str(r[0]) for r in back.select(st.clock_time(F.col("time"))).collect() if r[0] is None) == ["None"]
    (tmp_path / "short.csv").write_text("a,b,c\n1\n2,3,4,5\n\n,,6\n")
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "short.csv")).collect()), key=str) == sorted([("1", None, None), ("2", "3", "4"), (None, None, "6")], key=str)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_table(spark, str(tmp_path / "missing.csv"))


def test_embedders(spark):
    """Vectors from a table and from a model go through classification, schema matching and whole runs."""
    texts = ["name", "title", "city", "town", "price"]
    kinds = {"name": 0, "title": 0, "city": 1, "town": 1, "price": 2}
    table = spark.createDataFrame([(t, [float(kinds[t] == i) for i in range(3)]) for t in texts], "text string, vector array<double>")
    given = PrecomputedEmbedder(table)
    assert match.match_schemas(["name", "city", "price"], ["town", "title"], given, 0.5) == {"name": "title", "city": "town", "price": None}
    with pytest.raises(ValueError):
        given.vector("unknown")
    df = spark.createDataFrame([("10:30 AM",)], "time string")
    known = spark.createDataFrame([("time 10:30am", [1.0, 0.0]), ("time 10:30 AM", [0.9, 0.1]), ("John A. Smith", [0.0, 1.0])], "text string, vector array<double>")
    samples = classify.sample_texts(df).select("text").first()["text"]
    known = known.union(spark.createDataFrame([(samples, [1.0, 0.0])], known.schema)).dropDuplicates(["text"])
    assert classify.classify(df, PrecomputedEmbedder(known)).first()["category"] == "time"
    model = ModelEmbedder(lambda: lambda batch: asg.np.array([[len(t), t.count("a")] for t in batch], float))
    got = spark.createDataFrame([("aba",), ("b",), (None,)], "t string").select("t", model.column(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == {"aba": [3.0, 2.0], "b": [1.0, 0.0], None: None}
    left = spark.createDataFrame([("golden dragon", "paris"), ("blue parrot", "rome")], "name string, city string")
    right = spark.createDataFrame([("rome", "blue parrots"), ("paris", "golden dragons")], "town string, title string")
    out = integrate(left, right, Config(embedder=given, schema_threshold=0.5, standardize=False))
    assert out.schema_map == {"name": "title", "city": "town"} and out.merged.count() == 2
    assert models.layer_of("distilbert-base-uncased") == 5 and models.model_of("fr") == models.OTHER_MODEL and models.layer_of("x", 3) == 3
    with pytest.raises(ValueError):
        models.layer_of("x")


def test_stack_golden(spark, tmp_path):
    """Two tables with other headers, stacked by an alias file: literal rows."""
    (tmp_path / "a.csv").write_text("Name,Temperature,Time,Date,Age (years)\nCharlie Day,39.8,21:47:43,9/4/2024\nBob Lee,36.5,18:35:43,9/28/2024,52\nEva May,,19:31:43,7/28/2024,64\n")
    (tmp_path / "b.csv").write_text("Temp,Status,Full Name\n95,High,David Roe\n")
    (tmp_path / "c.csv").write_text("Name of Category,,,\nname,name,full name,\ntemperature,temperature,temp,\ntime,time,clock,\ndate,date,day,\nage,age,years,\nstatus,status,state,\n")
    main([str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), str(tmp_path / "out"), "--aliases", str(tmp_path / "c.csv"), "--log", str(tmp_path / "log.txt")])
    out = spark.read.csv(str(tmp_path / "out"), header=True)
    assert out.columns == ["name", "temperature", "time", "date", "age", "status"]
    want = [("Charlie", "39.8", "21:47:43", "9/4/2024", "NULL", "NULL"), ("Bob", "36.5", "18:35:43", "9/28/2024", "52", "NULL"), ("Eva", "NULL", "19:31:43", "7/28/2024", "64", "NULL"), ("David Roe", "95", "NULL", "NULL", "NULL", "High")]
    assert sorted(map(tuple, out.collect())) == sorted(want) and "stacked" in (tmp_path / "log.txt").read_text()
    assert st.field_standardizer("phone number") is st.identity and len(st.FIELDS) == 15
    with pytest.raises(ValueError):
        st.field_standardizer("colour")


def test_best(spark):
    df = spark.createDataFrame([(1, 5.0, 3), (1, 5.0, 2), (1, 4.0, 1), (2, None, 9), (1, 5.0, 7), (1, 3.0, 8)], "k int, s double, o int")
    assert sorted(map(tuple, pairs_module.first_best(df, ["k"], "s", ["o"]).where("k = 1").collect())) == [(1, 2)]
    assert sorted(r["o"] for r in pairs_module.best_with_ties(df.where("k = 1"), ["k"], "s", 2).collect()) == [2, 3, 7]
    scores = [[0.9, 0.8], [0.8, 0.7]] * 3
    wide = asg.beam_paths(scores, 0.5, beam=None)
    assert asg.beam_paths(scores, 0.5, beam=10**6) == wide and asg.beam_paths(scores, 0.5, beam=1)[0] <= wide[0]


def test_registry():
    assert set(ORACLE_SQL) <= set(QUERIES) and st.standardizer("name") is st.person_name
    with pytest.raises(ValueError):
        st.standardizer("no such")


def test_whole_assignment(spark):
    """The exact solver against brute force, over the whole tables of the query and on random components."""
    import numpy as np

    from mergeloom.operators import assign
    from mergeloom.plans import queries

    def best(gain):
        """Largest total gain, by the sets of columns in use."""
        totals = {0: 0.0}
        for row in gain:
            grown = dict(totals)
            for used, total in totals.items():
                for j in np.flatnonzero(row > 0):
                    if not used >> int(j) & 1:
                        key = used | 1 << int(j)
                        grown[key] = max(grown.get(key, 0.0), total + row[j])
            totals = grown
        return max(totals.values())

    rng = np.random.default_rng(3)
    for shape in ((7, 8), (8, 7), (9, 9), (3, 10), (10, 3)):
        gain = np.where(rng.random(shape) < 0.6, rng.integers(1, 6, shape) / 8, 0.0)
        chosen = assign.optimal(gain)
        used = [j for j in chosen if j >= 0]
        assert len(set(used)) == len(used) and sum(gain[i, j] for i, j in enumerate(chosen) if j >= 0) == best(gain)
    sf = "/root/testdata/sf0.001"
    r = [x[0] for x in queries.load(spark, sf, "region").select("r_regionkey").collect()]
    n = [x[0] for x in queries.load(spark, sf, "nation").select("n_nationkey").collect()]
    gain = np.array([[max(((i * 7 + j * 13) % 11 + 1) / 11 - 0.5, 0.0) for j in n] for i in r])
    assert queries.QUERIES["entity_assignment"](spark, sf).first()[0] == round(best(gain), 6)
