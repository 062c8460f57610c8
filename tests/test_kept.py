"""What follows the changes of a store: files that need not be opened, counts, the import graph."""

import random

from pyspark.sql import functions as F

from larkspur.operators import graph, importgraph
from larkspur.operators.counts import KeptCounts
from larkspur.sources import store

ROW = "id string, repository string, type string, created_at string, n long"


def opened(df):
    return {f.split("/data/")[1] for f in df.inputFiles() if "/data/" in f}


def test_only_files_that_may_hold_an_id_or_a_time_are_opened(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "t"))
    rows = [(f"id{i}", f"r {i % 8}/x", "note", f"2024-{i // 100 + 1:02}-{i % 28 + 1:02}" if i % 9 else None, i) for i in range(800)]
    for month in range(8):
        s.add(spark.createDataFrame(rows[month * 100 : month * 100 + 100], ROW))
    every = opened(s.read())
    assert len(every) == 64 and opened(s.find(["id5"])) == every
    assert len(s.summarise()) == 8 and s.summarise() == []
    asked = ["id5", "id555", "id799", "none", None]
    found = s.find(asked)
    assert sorted(r["n"] for r in found.collect()) == [5, 555, 799]
    # three files hold them; a filter of ten ids is wrong for few of the others
    assert 3 <= len(opened(found)) <= 12
    assert s.find([]).count() == 0 and not opened(s.find(["none such id"])) and s.find(["none such id"]).count() == 0
    part = s.between("2024-03-10", "2024-05-02")
    assert sorted(r["n"] for r in part.collect()) == [n for _, _, _, at, n in rows if at and "2024-03-10" <= at < "2024-05-02"]
    assert len(opened(part)) <= 24
    assert s.between(None, None).count() == sum(1 for r in rows if r[3]) and s.between("2025", None).count() == 0
    # later changes: files without a summary are read, and deletes apply
    s.upsert(spark.createDataFrame([("id5", "r 5/x", "note", "2024-03-11", -5), (None, "r", "note", "2024-03-12", -1)], ROW))
    s.delete(spark.createDataFrame([("id555",)], "id string"))
    assert sorted(r["n"] for r in s.find(asked).collect()) == [-5, 799]
    assert sorted(r["n"] for r in s.between("2024-03-11", "2024-03-13").collect()) == sorted([-5, -1] + [n for i, _, _, at, n in rows if at and "2024-03-11" <= at < "2024-03-13"])
    want = sorted(map(str, s.read().select("id", "n").collect()))
    s.compact()
    # the files that a compaction writes are summarised by it
    assert sorted(map(str, s.read().select("id", "n").collect())) == want
    assert sorted(r["n"] for r in s.find(asked).collect()) == [-5, 799]
    s.prune(1)
    assert sorted(r["n"] for r in s.find(asked).collect()) == [-5, 799]


def test_a_deletion_touches_the_leaves_of_its_filters(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path / "t"))
    s.replace(spark.createDataFrame([(f"id{i}", f"r{i % 5}", "note", None, i) for i in range(500)], ROW))
    s.summarise()
    s.delete(spark.createDataFrame([("id7",), ("id12",), ("zz",)], "id string"))
    m = s._manifest(s.current())
    asked = []
    holding = store.Store._holding
    monkeypatch.setattr(store.Store, "_holding", lambda self, leaves, ids: asked.append(holding(self, leaves, ids)) or asked[-1])
    assert {x.split("/")[0] for x in s._touched(m)} == {"p_repository=r2"}
    assert all("p_repository=r2/" in f for files in asked[0].values() for f in files) or sum(map(len, asked[0].values())) < 5
    # more ids than are looked up: all are read, with the same result
    monkeypatch.setattr(store, "LOOKED_UP", 1)
    assert {x.split("/")[0] for x in s._touched(m)} == {"p_repository=r2"} and asked[-1] is None


def test_counts_equal_a_recount_after_random_changes(spark, tmp_path):
    rng = random.Random(4)
    s = store.Store(spark, str(tmp_path / "t"))
    kept = KeptCounts(s, str(tmp_path / "counts"), ("repository", "type"), ("n",))
    new = lambda ids: spark.createDataFrame([(f"i{i}", rng.choice(["a", "b", None]), rng.choice(["note", "insight"]), None, rng.choice([None, rng.randrange(100)])) for i in ids], ROW)
    plain = lambda df: sorted(map(str, df.select("repository", "type", "count", "n").collect()))
    recount = lambda: s.read().groupBy("repository", "type").agg(F.count("*").alias("count"), F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    assert kept.refresh().count() == 0
    s.replace(new(range(60)))
    assert plain(kept.refresh()) == plain(recount()) and kept.how == "all"
    s.summarise()
    for step in range(6):
        for change in rng.sample(["add", "upsert", "delete", "compact"], 2):
            if change == "add":
                s.add(new(range(100 + 10 * step, 105 + 10 * step)))
            elif change == "upsert":
                s.upsert(new(rng.sample(range(80), 8)))
            elif change == "delete":
                s.delete(spark.createDataFrame([(f"i{i}",) for i in rng.sample(range(120), 9)], "id string"))
            else:
                s.compact()
        assert plain(kept.refresh()) == plain(recount()) and kept.how in ("changes", "kept"), step
    assert plain(kept.refresh()) == plain(recount()) and kept.how == "kept"
    s.replace(new(range(5)))
    assert plain(kept.refresh()) == plain(recount()) and kept.how == "all"


def test_only_changed_rows_are_counted(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "t"))
    s.replace(spark.createDataFrame([(f"i{i}", f"r{i % 10}", "note", None, i) for i in range(1000)], ROW))
    s.summarise()
    first = s.current()
    s.upsert(spark.createDataFrame([("i3", "r3", "insight", None, 1)], ROW))
    signed = s.signed(first)
    assert sorted((r["id"], r["type"], r[store.SIGN]) for r in signed.collect()) == [("i3", "insight", 1), ("i3", "note", -1)]
    old = {f for f in opened(signed) if "p_type=note" in f}
    assert 1 <= len(old) <= 4 and len(opened(s.read(first))) >= 10
    assert s.signed("0" * 20) is None and s.signed(s.current()).count() == 0


def test_the_import_graph_follows_its_files(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    names = [f"m{i}" for i in range(25)]
    path = lambda n, package: f"p/{n}/__init__.py" if package else f"p/{n}.py"
    frame = lambda paths: spark.createDataFrame([(p,) for p in sorted(paths)], "path string")
    pairs = lambda d: spark.createDataFrame(sorted((s, m) for s, ms in d.items() for m in ms), "src string, module string")
    modules = lambda: {rng.choice(["p.{}", ".{}", "..p.{}", "q.{}"]).format(rng.choice(names)) for _ in range(4)}
    g = importgraph.ImportGraph(spark, str(tmp_path / "g"))
    assert g.edges().count() == 0 and g.degrees().count() == 0
    held = {path(n, False): modules() for n in names[:18]}

    def check():
        want = graph.resolve_imports(pairs(held), frame(held))
        assert sorted(map(tuple, g.edges().select("src", "module", "dst").collect())) == sorted(map(tuple, want.select("src", "module", "dst").collect()))
        assert sorted(map(tuple, g.degrees().collect())) == sorted(map(tuple, graph.degrees(want).select("path", "import_count", "imported_by_count", "impact_tier").collect()))

    g.apply(frame(held), pairs(held))
    check()
    total = g.resolved
    # one file comes: its own imports, and those that may mean it
    held["p/m20.py"] = {"p.m1", ".m2"}
    g.apply(frame(["p/m20.py"]), pairs({"p/m20.py": held["p/m20.py"]}))
    mean = sum(m.endswith("m20") for ms in held.values() for m in ms)
    assert g.resolved <= 2 + mean < total / 3
    check()
    for step in range(3):
        gone = set(rng.sample(sorted(held), 3))
        for p in gone:
            del held[p]
        came = {path(rng.choice(names), rng.random() < 0.5): modules() for _ in range(4)}
        came |= {p: modules() for p in rng.sample(sorted(held), 2)}
        held |= came
        if step == 1:
            # broken off between the files and the imports, then applied again
            with monkeypatch.context() as broken:
                broken.setattr(g.imports, "merge", lambda *_: (_ for _ in ()).throw(OSError("lost")))
                try:
                    g.apply(frame(came), pairs(came), frame(gone - set(came)))
                except OSError:
                    pass
        g.apply(frame(came), pairs(came), frame(gone - set(came)))
        check()
    # a file that loses all its imports, repeated rows, null and empty modules
    some = sorted(held)[0]
    held[some] = set()
    odd = spark.createDataFrame([(some, None), (some, ""), (some, None), ("p/other.py", "p.m1")], "src string, module string")
    g.apply(frame([some]).unionAll(frame([some])), odd)
    check()
