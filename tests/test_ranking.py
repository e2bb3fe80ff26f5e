"""Rankers, meta-blocking, saved matchers, policies, the vector index, feature groups and the SQL entry."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import sql
from quillon.config import LinkageConfig
from quillon.functions.fuzzy import ngram_cosine
from quillon.operators import blocking as B, collective as C, decode as D, feature_groups as G, features as X, models as M, pilot, ranking as R, vectors
from quillon.plans import linkage
from quillon.scratch import Scratch
from quillon.sources import files
from tests_support import businesses


@pytest.fixture(scope="module")
def known(spark):
    frames, truth = businesses(spark, seed=8, n=100)
    return linkage.normalized(frames).coalesce(2).cache(), truth.coalesce(1).cache()


@pytest.fixture(scope="module")
def rec(spark, known):
    """The records with what pair features read, written once."""
    return Scratch(spark, "test").keep(linkage.enriched(known[0]).coalesce(2), "records")


@pytest.fixture(scope="module")
def found(spark, rec):
    """Candidates by evidence, with their context."""
    return Scratch(spark, "test").keep(X.context(R.candidates(rec, LinkageConfig())).coalesce(2), "pairs")


def test_linear_ranker_is_a_logistic(spark):
    df = spark.createDataFrame([(1.0, 2), (None, 3)], "a double, b int")
    got = [r.s for r in R.Linear({"a": 0.5, "b": -1.0}, 0.25).score(df, "s").collect()]
    assert got == pytest.approx([1 / (1 + np.exp(1.25)), 1 / (1 + np.exp(2.75))])


def test_stages_rank_and_report(spark, known, rec):
    truth = known[1]
    cfg = LinkageConfig(keep=1, shortlist=5, with_ca=True)
    made = R.train_stages(rec, truth, cfg)
    report = {r.score: r for r in made.report.collect()}
    assert set(report) == {"pre", "s0", "s1"} and report["s1"].recall >= report["pre"].recall - 0.02 and report["s1"].recall > 0.85
    pairs = R.candidates(rec, cfg, made.first, made.second).cache()
    assert pairs.groupBy("e", "src").count().agg(F.max("count")).first()[0] == 1
    hits = pairs.join(truth, ["e", "src", "r"]).count()
    assert hits > 0.9 * truth.count()
    by_evidence = R.candidates(rec, cfg)
    assert sorted(map(tuple, by_evidence.select("e", "src", "r").collect())) == sorted(map(tuple, B.candidates(rec, cfg).select("e", "src", "r").collect()))
    parts = {(r.country, r.part) for r in R.recall_report(pairs, truth.join(rec.where("src = 1").select(F.col("id").alias("e"), "country"), "e"), rec).collect()}
    assert {("US", "source 2"), ("India", "has number")} <= parts


def test_recall_at_by_hand(spark):
    pairs = spark.createDataFrame([(1, 2, 5, 0.9, 0.1, 1), (1, 2, 6, 0.8, 0.9, 0), (2, 2, 5, 0.5, 0.5, 0), (2, 2, 7, 0.5, 0.6, 1)], "e long, src int, r long, a double, b double, y int")
    truth = spark.createDataFrame([(1, 2, 5), (2, 2, 7), (3, 2, 9)], "e long, src int, r long")
    got = {r.score: (r.pairs, r.found) for r in R.recall_at(pairs, truth, ["a", "b"], 1).collect()}
    assert got == {"a": (3, 1), "b": (3, 1)}


def test_matcher_scores_another_split(spark, known, tmp_path):
    records, truth = known
    cfg = LinkageConfig(with_ca=True)
    matcher, linked = linkage.fit(records, truth, cfg, rank=True, meta=True, second_round=True)
    assert linked.losses.first().f05 > 0.85
    matcher.save(str(tmp_path / "matcher"))
    again = linkage.Matcher.load(spark, str(tmp_path / "matcher"))
    frames, other = businesses(spark, seed=77, n=60)
    scored, decoded = linkage.score_split(again, linkage.normalized(frames), cfg)
    labelled = M.label(scored, other)
    n = other.groupBy("e").agg(F.count("*").alias("n_true"))
    entities = frames[1].select(F.col("entity_id").alias("e")).join(n, "e", "left").fillna(0, ["n_true"])
    assert D.outcomes(decoded, labelled, entities).agg(F.avg("f")).first()[0] > 0.8
    assert decoded.groupBy("src", "r").count().where("count > 1").count() == 0


def test_metablock_keeps_the_best_of_each(spark, rec, found):
    pairs = found
    kept = R.metablock(pairs, rec, R.Linear({"c_tset": 0.05}, -4.0), 0.5).collect()
    rows = R.cheap(pairs, rec).collect()
    meta = {(r.e, r.src, r.r): 1 / (1 + np.exp(4 - 0.05 * r.c_tset)) for r in rows}
    best = {}
    for (e, src, r), v in sorted(meta.items()):
        if e not in best or v > best[e][0] + 1e-12:
            best[e] = (v, (e, src, r))
    want = {k for k, v in meta.items() if v >= 0.5} | {k for _, k in best.values()}
    assert {(r.e, r.src, r.r) for r in kept} == want and len(kept) == len(want)


def test_country_is_no_feature(spark):
    df = spark.createDataFrame([(1, "x")], "y int, country string")
    with pytest.raises(ValueError):
        M.Learned.fit(df, ["country"])
    with pytest.raises(ValueError):
        G.register("bad", ["country"])


def _scored(spark, n=240, seed=4):
    rng = random.Random(seed)
    rows = []
    for e in range(n):
        for j in range(3):
            p = round(rng.random(), 3)
            rows.append((e, 2, 1000 * e + j, p, round(min(1.0, max(0.0, p + rng.uniform(-0.2, 0.2))), 3), int(p + rng.random() > 1.1), ("x", "y", "z")[e % 3]))
    df = spark.createDataFrame(rows, "e long, src int, r long, p_seen double, p_loco double, y int, country string").cache()
    return df, df.groupBy("e", "country").agg(F.sum("y").alias("n_true")).select("e", "n_true", "country").cache()


def test_unseen_policies_against_decoding(spark):
    df, truth = _scored(spark)
    grid = {"t_single": (0.4, 0.6), "t_match": (0.2, 0.5), "miss_mass": (0.0, 0.2)}
    tuned = files.thresholds(spark, {"x": {"t_single": 0.5, "t_match": 0.2, "miss_mass": 0.1}, "y": {"t_single": 0.6, "t_match": 0.3, "miss_mass": 0.0}, "z": {"t_single": 0.4, "t_match": 0.4, "miss_mass": 0.3}, "_default": {"t_single": 0.9, "t_match": 0.9, "miss_mass": 0.9}})
    got = M.unseen_policies(df, truth, tuned, (0.65, 0.3, 0.34), ["p_seen", "p_loco"], grid, biases=(-0.5,)).collect()
    assert len(got) == 2 * 3 * 5

    def f05(score, country, ts, tm, mm, bias=0.0):
        rows = df.where(F.col("country") == country).select("e", "src", "r", "y", F.col(score).alias("p"))
        rows = rows.withColumn("p", D.shift(F.col("p"), bias)) if bias else rows
        return D.outcomes(D.decode(rows, ts, tm, mm), rows, truth.where(F.col("country") == country)).agg(F.avg("f")).first()[0]

    rows = {(r.country, r.score, r.policy): r for r in got}
    for (country, score, policy), r in rows.items():
        if score == "p_loco":
            assert r.f05 == pytest.approx(f05(score, country, r.t_single, r.t_match, r.miss_mass, -0.5 if policy.startswith("bias") else 0.0), abs=1e-9)
    assert (rows["x", "p_seen", "borrowed"].t_single, rows["x", "p_seen", "borrowed"].t_match, rows["x", "p_seen", "borrowed"].miss_mass) == (0.6, 0.4, 0.3)
    assert len({(r.t_single, r.t_match, r.miss_mass) for (_, s, p), r in rows.items() if s == "p_loco" and p == "policy"}) == 1
    assert all(rows[c, s, "best"].f05 >= rows[c, s, "policy"].f05 for c in "xyz" for s in ("p_seen", "p_loco"))


def test_full_data_gate(spark):
    df, truth = _scored(spark)
    thresholds = D.tune(D.threshold_grid(df.withColumnRenamed("p_seen", "p").drop("country"), truth, by="country"), "country")
    rows = df.select("e", "src", "r", "y", "country", F.col("p_seen").alias("x"))
    hold = F.col("e") % 4 == 0
    _, worse = M.full_data(rows, ["x"], truth, thresholds, hold, df.withColumn("p", F.col("y").cast("double")), 0.001)
    _, better = M.full_data(rows, ["x"], truth, thresholds, hold, df.withColumn("p", F.lit(0.0)), 0.001)
    assert not worse and better
    model = M.fit_watched(rows, ["x"], share=0.2, maxIter=5, maxDepth=2)
    assert model.score(rows, "p").where("p between 0 and 1").count() == rows.count()


def test_mean_of_fold_models(spark):
    df, _ = _scored(spark)
    rows = df.withColumnRenamed("p_seen", "x").select("e", "src", "r", "y", "x")
    scored, models = M.fit_folds(rows, ["x"])
    assert scored.count() == rows.count() and scored.columns == [*rows.columns, "p"]
    got = M.mean_score(models, rows.limit(50), "p").collect()
    each = [{(r.e, r.r): r.q for r in m.score(rows, "q").collect()} for m in models]
    assert all(r.p == pytest.approx((each[0][r.e, r.r] + each[1][r.e, r.r]) / 2) for r in got)


@pytest.mark.parametrize("block", [32, 2048])
def test_projection_index_finds_what_is_near(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    x = np.concatenate([centres[rng.integers(0, 60, 2400)] + 0.5 * rng.normal(size=(2400, 32)), np.repeat(centres[:1], 600, axis=0)])  # and one large group of copies
    df = spark.createDataFrame([(i, [float(v) for v in row], "ab"[i % 2]) for i, row in enumerate(x)] + [(9999, None, "a")], "vec_id long, embedding array<double>, g string").cache()
    asked = df.where("vec_id % 50 = 0")
    exact = reduce_union([vectors.cosine_topk(asked.where(F.col("g") == g), df.where(F.col("g") == g), 5, 0.5) for g in "ab"]).cache()
    found = vectors.projection_topk(asked, df, 5, 0.5, "g", cfg=vectors.ProjectionConfig(target=64, block=block)).cache()
    assert vectors.recall_of(found, exact).first().recall > 0.9
    assert found.join(exact.select("q", "v", F.col("cosine").alias("c")), ["q", "v"]).where("abs(c - cosine) > 1e-9").count() == 0
    parity = {r.vec_id: r.g for r in df.collect()}
    assert all(parity[r.q] == parity[r.v] for r in found.collect())


def test_index_shape_keeps_recall():
    cfg = vectors.ProjectionConfig()
    assert vectors._shape(100, 0.5, cfg) == (0, 1)
    for rows in (10**4, 10**7, 10**10):
        for least in (0.3, 0.5, 0.9):
            bits, tables = vectors._shape(rows, least, cfg)
            turn = np.arccos(least) / np.pi
            met = (1 - turn) ** bits + bits * turn * (1 - turn) ** max(0, bits - 1)
            assert 1 <= tables <= cfg.tables and (1 - met) ** tables <= cfg.miss + 1e-9
    assert vectors._shape(10**7, 0.9, cfg)[0] > vectors._shape(10**7, 0.5, cfg)[0]


def test_index_is_used_only_where_it_spares_work():
    cfg = vectors.ProjectionConfig()
    for rows in (10**3, 10**4, 10**5, 10**7):
        for least in (0.2, 0.5, 0.9):
            bits, tables = vectors._shape(rows, least, cfg)
            assert (bits, tables) == (0, 1) or tables * (bits + 1) / 2**bits <= 0.5
    assert vectors._shape(10**5, 0.9, cfg)[0] > 0


def test_index_of_several_buckets(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(100, 24))
    x = np.concatenate([centres[rng.integers(0, 100, 2000)] + 0.15 * rng.normal(size=(2000, 24)), np.repeat(centres[:1], 500, axis=0)])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>").cache()
    asked, cfg = df.where("vec_id % 50 = 0"), vectors.ProjectionConfig(target=16)
    assert vectors._shape(2500, 0.9, cfg)[0] > 0
    exact = vectors.cosine_topk(asked, df, 5, 0.9)
    assert vectors.recall_of(vectors.projection_topk(asked, df, 5, 0.9, cfg=cfg), exact).first().recall > 0.9


def test_projection_neighbours_misses_nothing_of_a_larger_table(spark, tmp_path):
    import duckdb

    from quillon.plans import catalog

    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    x[2000:2400] = x[1]  # copies, and near copies whose cosines differ only after the sixth digit
    x[2400:2700] = x[50] + 1e-4 * rng.normal(size=(300, 16))
    rows = [(i, [float(v) for v in row], i % 2) for i, row in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.q, r.v, r.cosine) for r in catalog.queries()["projection_neighbours"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == set(con.execute(catalog.oracle_sql()["projection_neighbours"]).fetchall())


@pytest.mark.parametrize("least", [-1.0, 0.5])
def test_products_keep_the_best_of_copies_by_id(spark, least):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8))
    x[200:] = x[0]
    x[7] = 0
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=x != 0)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    for block in (64, 4096):
        got = {}
        for r in vectors.cosine_topk(df.where("vec_id % 10 = 0"), df, 4, least, block=block).orderBy("q", "place").collect():
            got.setdefault(r.q, []).append(r.v)
        for q in range(0, 300, 10):
            sims = np.round(unit @ unit[q], 12)
            assert got.get(q, []) == [v for v in sorted(range(300), key=lambda v: (-sims[v], v)) if v != q and sims[v] >= least][:4]


def test_top_either_has_a_pair_once_whatever_the_order_of_sums(spark):
    """Sums of doubles may come out in another order each time they are taken; here their last digits are drawn anew."""
    shaken = F.udf(lambda x: x + random.random() * 1e-13, "double").asNondeterministic()
    rows = [(e, 2 + r % 2, r, round((e * 7 + r * 13) % 11 / 10, 1)) for e in range(12) for r in range(15)]
    pairs = spark.createDataFrame(rows, "e long, src int, r long, pre double").withColumn("w_nt", shaken("pre"))
    got = B.top_either(pairs, "pre", 2, 1).select("e", "src", "r").collect()
    forward = {x[:3] for xs in _grouped(rows, lambda x: (x[0], x[1])) for x in sorted(xs, key=lambda x: (-x[3], x[2]))[:2]}
    reverse = {x[:3] for xs in _grouped(rows, lambda x: (x[1], x[2])) for x in sorted(xs, key=lambda x: (-x[3], x[0]))[:1]}
    assert sorted(map(tuple, got)) == sorted(forward | reverse)


def _grouped(rows, key):
    return [list(xs) for _, xs in itertools.groupby(sorted(rows, key=key), key)]


def reduce_union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def test_retrieval_keeps_countries_and_sources(spark):
    names = [(1, 1, "US", "red stone works", ""), (2, 1, "IN", "red stone works", ""), (1, 2, "US", "red stone work", ""), (2, 2, "IN", "red stone works", "12"), (1, 3, "IN", "red stones works", ""), (3, 3, "US", "", "")]
    rec = vectors.hashed_vectors(spark.createDataFrame(names, "id long, src int, country string, core string, nums string"), "core")
    got = {(r.country, r.e, r.src, r.r) for r in vectors.retrieve(rec).collect()}
    assert got == {("US", 1, 2, 1), ("IN", 2, 3, 1)}


def test_feature_groups(spark, rec, found):
    pairs = found
    rows = G.with_groups(pairs, rec, ["kinds", "equality", "consistency"])
    assert rows.count() == pairs.count() and {"k_nw", "core_eq", "r_hn_eq"} <= set(rows.columns)

    @G.register("lengths", ["l1"])
    def lengths(pairs, records):
        return X.attach(pairs.select(*X.KEYS), records, ["core"]).select(*X.KEYS, F.length("core_1").alias("l1"))

    assert "l1" in G.with_groups(pairs, rec, ["lengths"]).columns
    del G.GROUPS["lengths"]


def test_pilot_picks_the_better_scorer(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(8))
    rows = [(1, w := word(), w[:7] + rng.choice("abc")) for _ in range(80)] + [(0, word(), word()) for _ in range(80)]
    report = pilot.pilot(spark.createDataFrame(rows, "y int, t1 string, t2 string"), {"grams": "ngram_cosine", "same length": lambda a, b: float(len(a) == len(b))})
    assert pilot.best(report) == "grams" and report.where("scorer = 'grams'").first().auc > 0.95
    assert ngram_cosine("abc", "abc") == pytest.approx(1.0) and ngram_cosine("", "") == 1.0 and ngram_cosine("abc", "") == 0.0


def test_band_of_a_second_scorer(spark, known, rec, found):
    pairs = M.label(found.select("e", "src", "r").withColumn("p", F.lit(0.5)), known[1]).cache()
    out = C.band_export(pairs, rec, 0.2, M.fold_of(F.col("e")))
    assert set(out.columns) == {"e", "src", "r", "p", "fold", "y", "t1", "t2"} and out.count() == pairs.count()
    rows = C.stack_features(pairs, rec, pilot.band_scores(out))
    assert set(C.STACK) | set(C.BAND) <= set(rows.columns) and rows.where("ce is null").count() == 0


def test_dictionary_job(spark, tmp_path):
    ddl = "entity_id string, business_name string, business_address string, country string"
    names = [("आम दुकान", "mango shop"), ("आम घर", "mango house"), ("लाल दुकान", "red shop"), ("लाल घर", "red house")]
    known = {1: spark.createDataFrame([(f"a{i}", en, f"{i} main road, delhi", "India") for i, (_, en) in enumerate(names * 2)], ddl), 2: spark.createDataFrame([(f"b{i}", hi, f"{i} main road, दिल्ली", "India") for i, (hi, _) in enumerate(names * 2)], ddl)}
    truth = spark.createDataFrame([(f"a{i}", 2, f"b{i}") for i in range(8)], "e string, src int, r string")
    out = linkage.build(known, known, truth, str(tmp_path / "norm"))
    by = {r.id: r for r in out.collect()}
    assert by["b0"].core == by["a0"].core == "mango shop" and by["b0"].adf == by["a0"].adf == "0 main rd dl"
    assert linkage.build(known, known, truth.limit(0), str(tmp_path / "norm")).count() == 16  # what is complete is not made again


def test_thresholds_precedence(spark, tmp_path):
    one = lambda t: {"x": {"t_single": t, "t_match": 0.3, "miss_mass": 0.1}, "_default": {"t_single": t, "t_match": 0.3, "miss_mass": 0.1}}
    with pytest.raises(FileNotFoundError):
        linkage.chosen_thresholds(spark, str(tmp_path))
    for name, t in (("thresholds", 0.4), ("thresholds_oof", 0.5), ("thresholds_final", 0.6)):
        files.write_json(spark, one(t) | {"_tau": 0.01}, str(tmp_path / name))
        assert {(r.country, r.t_single) for r in linkage.chosen_thresholds(spark, str(tmp_path)).collect()} == {("x", t), ("_default", t)}


def test_npy_files(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(25, 4)).astype(np.float32)
    (tmp_path / "v").mkdir()
    np.save(tmp_path / "v" / "a.npy", x[:10])
    np.save(tmp_path / "v" / "b.npy", x[10:])
    df = files.read_npy(spark, str(tmp_path / "v" / "*.npy"))
    got = {r.vec_id: r.embedding for r in df.collect()}
    assert len(got) == 25 and all(np.allclose(got[i], x[i]) for i in range(25))
    files.write_npy(df, str(tmp_path / "out"), rows=10)
    blocks = spark.read.parquet(str(tmp_path / "out")).orderBy("part").collect()
    import io

    assert np.allclose(np.concatenate([np.load(io.BytesIO(b.npy)) for b in blocks]), x) and len(blocks) == 3


def test_scan_of_a_pattern_reads_the_named_columns(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, "x" * i, 0.5)], "a int, b string, c double").write.parquet(str(tmp_path / f"part-{i}"))
    df = files.scan(spark, str(tmp_path / "part-*"), ["a", "c"])
    assert sorted(r.a for r in df.collect()) == [0, 1, 2] and "b:string" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_list_parts_stand_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"e{i}", "a,b" if i % 2 else "") for i in range(100)], "place int, entity_id string, matched_entity_ids string").repartition(5)
    files.write_id_list_parts(rows, str(tmp_path / "lists"))
    got = list(itertools.chain.from_iterable(p.read_text().splitlines()[1:] for p in sorted((tmp_path / "lists").glob("part-*"))))
    assert [x.split("\t")[0] for x in got] == [f"e{i}" for i in range(100)]


def test_sql_views_and_functions(spark, sf):
    assert sql.register_views(spark, sf, ["one_owner", "decode_prefix"]) == ["q_one_owner", "q_decode_prefix"]
    assert spark.sql("SELECT count(*) FROM q_decode_prefix JOIN q_one_owner USING (e, src, r)").first()[0] > 0
    assert "token_set_ratio" in sql.register_functions(spark)
    assert spark.sql("SELECT token_set_ratio('a b', 'b a') AS s").first().s == 100.0
