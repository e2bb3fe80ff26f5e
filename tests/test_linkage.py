import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillon.config import LinkageConfig
from quillon.operators import blocking as B, collective as C, decode as D, dictionary, evaluate as E, features as X, models as M, vectors
from quillon.operators.graph import connected_components
from quillon.scratch import Scratch
from quillon.sources import files

PAIRS = "e long, src int, r long, p double"


@pytest.mark.parametrize("tp,k,n,want", [(3, 3, 3, 1.0), (2, 2, 3, 0.909), (3, 4, 3, 0.789), (1, 1, 3, 0.714), (2, 3, 3, 0.667), (3, 5, 3, 0.652), (0, 0, 3, 0.0), (0, 0, 0, 1.0), (0, 1, 0, 0.0)])
def test_f05(spark, tp, k, n, want):
    got = spark.range(1).select(D.f05(F.lit(float(tp)), F.lit(float(k)), F.lit(float(n)))).first()[0]
    assert got == pytest.approx(want, abs=5e-4)


def test_prefix_choice(spark):
    rows = spark.createDataFrame([(1, 2, 10, 0.95), (1, 2, 11, 0.80), (1, 3, 12, 0.45), (2, 2, 20, 0.4), (3, 2, 30, 0.9), (4, 2, 30, 0.9)], PAIRS)
    got = {(r.e, r.r) for r in D.decode(rows, 0.5, 0.3, 0.05).collect()}
    assert got == {(1, 10), (1, 11), (3, 30)}  # entity 2 is below the gate; the record with two owners goes to the smaller of equals


def _best_prefix(ps, ts, tm, mm):
    if ps[0] < ts:
        return 0
    best, at, run = -1.0, 0, 0.0
    for k, p in enumerate(ps, 1):
        if p < tm:
            break
        run += p
        f = 1.25 * run / (0.25 * (sum(ps) + mm) + k)
        if f > best:
            best, at = f, k
    return at


def test_decode_against_loop(spark):
    rng = random.Random(1)
    rows = [(e, 2, 100 * e + j, round(rng.random(), 3)) for e in range(300) for j in range(rng.randrange(1, 7))]
    got = {r.e: r.n for r in D.decode(spark.createDataFrame(rows, PAIRS), 0.5, 0.3, 0.34).groupBy("e").agg(F.count("*").alias("n")).collect()}
    for e, group in itertools.groupby(rows, key=lambda r: r[0]):
        assert got.get(e, 0) == _best_prefix(sorted((r[3] for r in group), reverse=True), 0.5, 0.3, 0.34)


def test_loss_parts_sum(spark):
    rng = random.Random(2)
    rows = [(e, 2, 100 * e + j, round(rng.random(), 3), rng.randrange(2)) for e in range(200) for j in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, PAIRS + ", y int")
    truth = df.groupBy("e").agg(F.sum("y").alias("n_true")).unionByName(spark.createDataFrame([(999, 2), (1000, 0)], "e long, n_true long"))
    d = D.decompose(D.outcomes(D.decode(df), df, truth)).first()
    parts = d.singleton_merged + d.emptied_findable + d.emptied_lost + d.false_pairs + d.missed_candidates + d.lost_candidates
    assert parts == pytest.approx(1 - d.f05, abs=1e-12)
    c = D.ceiling(df, truth).first()
    assert c.decoded == pytest.approx(c.direct, abs=1e-12)
    point = D.threshold_grid(df, truth).where("t_single = 0.5 and t_match = 0.3 and miss_mass = 0.05").first()
    assert point.f05 == pytest.approx(d.f05, abs=1e-12)


def test_caps_skip_blocks(spark):
    rows = [(i, 1, "c", "cc", "a") for i in range(3)] + [(i, 2, "c", "cc", "a") for i in range(50)] + [(i, 1, "c", "cc", "b") for i in range(2)] + [(i, 2, "c", "cc", "b") for i in range(51)]
    left, right = B.capped(spark.createDataFrame(rows, "id long, src int, country string, kind string, key string"))
    assert {r.key for r in right.collect()} == {"a"} and {r.key for r in left.collect()} == {"a", "b"}
    left, _ = B.capped(spark.createDataFrame([(i, 1, "c", "cc", "a") for i in range(201)], "id long, src int, country string, kind string, key string"))
    assert left.count() == 0


def test_ranks_break_ties(spark):
    rows = spark.createDataFrame([(1, 2, 5, 1.0), (1, 2, 3, 1.0), (1, 2, 4, 1.0), (2, 2, 3, 1.0)], "e long, src int, r long, pre double")
    assert [r.r for r in B.top_forward(rows, "pre", 2).where("e = 1").orderBy("r").collect()] == [3, 4]
    assert [r.e for r in B.top_reverse(rows, "pre", 1).where("r = 3").collect()] == [1]


def test_candidates_end_to_end(spark):
    rec = [(i, 1 + i % 2, "c", f"name{i // 2} word{i // 2}", f"street{i // 2} place{i // 2}", str(i // 2), "", f"name{i // 2}word{i // 2}") for i in range(20)]
    df = spark.createDataFrame(rec, "id long, src int, country string, core string, ad string, nums string, hn string, cc string")
    got = {(r.e, r.r) for r in B.candidates(df, LinkageConfig(with_ca=True, reverse=1)).collect()}
    assert got == {(i, i + 1) for i in range(0, 20, 2)}


def test_views(spark):
    rows = spark.createDataFrame([(1, 2, 10, 0.9), (1, 2, 11, 0.6), (1, 3, 12, 0.3), (2, 2, 10, 0.5), (3, 2, 13, 0.7)], PAIRS)
    got = {(r.e, r.r): r for r in C.views(rows).collect()}
    assert (got[1, 10].p_other, got[1, 11].p_other, got[3, 13].p_other) == (0.6, 0.9, -1.0)
    assert (got[1, 10].p_rival, got[2, 10].p_rival, got[1, 11].p_rival) == (0.5, 0.9, -1.0)
    rec = spark.createDataFrame([(2, 10, "a b", "x", "1"), (2, 11, "a b", "y", "1"), (3, 12, "c", "x", "2"), (2, 13, "d", "", "")], "src int, id long, core string, adf string, hmain string")
    t = {(r.e, r.r): r for r in C.transitivity(C.views(rows), rec).collect()}
    assert (t[1, 10].a_c, t[1, 10].a_h, t[1, 10].a_p) == (100.0, 1.0, 0.6)
    assert t[3, 13].a_c is None and t[2, 10].b_p is None


def test_siblings(spark):
    p = spark.createDataFrame(
        [(1, 2, 1, ["g4"], ["g6"], "", "", "", "", ["a"], ["a"]), (2, 2, 2, [], [], "b", "", "17", "17", ["a"], ["b"]), (3, 2, 3, [], [], "", "", "272", "27", [], [])],
        "e long, src int, r long, units_1 array<string>, units_2 array<string>, hsuf_1 string, hsuf_2 string, hmain_1 string, hmain_2 string, ct_1 array<string>, ct_2 array<string>",
    )
    p = p.withColumns({"at_1": F.array(F.lit("b")), "at_2": F.array(F.lit("a")), "ctdf_1": F.create_map(F.lit("a"), F.lit(1.0)), "ctdf_2": F.create_map(F.lit("b"), F.lit(2.0))})
    got = {r.e: r for r in X.lookalike_features(p).collect()}
    assert got[1].u_conf == 1 and got[2].hs_one == 1 and got[3].h_pre == 1 and got[3].h_lev == 1.0
    assert (got[2].x1_df, got[2].x2_df, got[2].x1_in_a2) == (1.0, 2.0, 1) and got[1].x1_df is None


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(1, 300)] + [(i, i + 1) for i in range(2000, 2060)] + [(7000, 7000)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.id: r.component for r in connected_components(df, Scratch(spark, "t")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for x in root}
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_clusters_fall_back(spark):
    rows = spark.createDataFrame([(1, 2, 1, 0.5), (2, 2, 1, 0.5), (3, 2, 9, 0.5)], PAIRS)
    groups = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "e long, cluster long")
    assert E.entity_clusters(rows, groups)[1] == "groups"
    found, kind, _ = E.entity_clusters(rows, groups, giant=1.0)
    assert kind == "components" and {(r.e, r.cluster) for r in found.collect()} == {(1, 1), (2, 1), (3, 3)}


def test_bootstrap(spark):
    rows = spark.range(400).select(F.col("id").alias("e"), (F.col("id") % 2).cast("double").alias("f"))
    zero, groups = rows.select("e", F.lit(0.0).alias("f")), rows.select("e", (F.col("e") % 100).alias("cluster"))
    got = E.bootstrap(rows, zero, groups, 300).first()
    assert got.low < got.delta == 0.5 < got.high and got.draws == 300
    same = E.bootstrap(rows, rows, groups, 50).first()
    assert (same.delta, same.low, same.high) == (0.0, 0.0, 0.0)


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "p double, y int")
    assert E.auc(rows).first().auc == pytest.approx((0.5 + 1 + 1 + 1) / 4)
    assert E.auc(rows.where("y = 1")).first().auc is None


def test_models(spark):
    rng = random.Random(4)
    rows = [(e, 2, e * 10 + j, x := rng.random(), None if j == 2 else x, int(x + rng.random() * 0.2 > 0.6), "ab"[e % 2]) for e in range(150) for j in range(3)]
    df = spark.createDataFrame(rows, "e long, src int, r long, f1 double, f2 double, y int, country string")
    scored = M.out_of_fold(df, ["f1", "f2"])
    assert scored.count() == df.count() and E.auc(scored).first().auc > 0.9
    with pytest.raises(ValueError):
        M.out_of_fold(df, ["country"])
    cal = M.isotonic(scored, "country")
    assert cal.where("p_cal is null or p_cal < 0 or p_cal > 1").count() == 0
    kept = M.prune(scored, "p", 2.0)
    assert kept.count() == kept.select("e").distinct().count() == 150
    assert M.accept(0.97, 0.9711) and not M.accept(0.97, 0.9705)


def test_band_and_blend(spark):
    rows = spark.createDataFrame([(1, 2, 1, 0.5), (1, 2, 2, 0.99)], PAIRS)
    assert C.band(rows, 0.1).count() == 1
    second = spark.createDataFrame([(1, 2, 1, 0.7)], PAIRS)
    got = {r.r: r.p for r in C.blend(rows, second).collect()}
    assert got == {1: pytest.approx(0.6), 2: 0.99}
    ce = {r.r: r.ce for r in C.band_features(rows, second.withColumnRenamed("p", "ce")).collect()}
    assert ce == {1: 0.7, 2: None}


def test_cosine_matches_brute_force(spark):
    rng = random.Random(6)
    data = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {(r.q, r.place): r.v for r in vectors.cosine_topk(df, df, 3, block=32).collect()}
    norm = lambda x: sum(v * v for v in x) ** 0.5
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / norm(x) / norm(y)
    for i, x in data:
        best = sorted(((-round(cos(x, y), 12), j) for j, y in data if j != i))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in best]


def test_dictionary(spark):
    rows = spark.createDataFrame([(["x", "y"], ["A", "B"]), (["x"], ["a"]), (["x", "z"], ["c"]), (["y"], ["d"])], "l array<string>, r array<string>")
    got = {r.token: r.meaning for r in dictionary.mine_tokens(rows, F.col("l"), F.col("r")).collect()}
    assert got == {"x": "a", "y": "b"}
    with pytest.raises(ValueError):
        dictionary.as_map(dictionary.mine_tokens(rows, F.col("l"), F.col("r")).select("token", "meaning"), 1)


def test_text_sources(spark, tmp_path):
    src = tmp_path / "s.tsv"
    src.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\n001\t"The" Bakery\t\tNA\n002\tx"y, \\n\t12 Rd\tUS\n')
    rows = [tuple(r) for r in files.read_source(spark, str(src)).collect()]
    assert rows == [("001", '"The" Bakery', "", "NA"), ("002", 'x"y, \\n', "12 Rd", "US")]
    assert files.count_rows(spark, str(src)) == 2
    truth = tmp_path / "t.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    t = files.read_truth(spark, str(truth))
    assert {r.entity_id: r.ids for r in t.collect()} == {"S1-1": ["S2-1", "S3-2"], "S1-2": []}
    assert files.truth_pairs(t).count() == 2
    ents = spark.createDataFrame([(1, "b"), (2, "a")], "place int, entity_id string")
    pairs = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("a", "x", 3)], "entity_id string, id string, rank int")
    out = tmp_path / "out"
    files.write_id_lists(files.id_lists(ents, pairs), str(out))
    text = next(out.glob("part-*")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nb\t\na\ty,x\n"
    files.write_json(spark, {"a": 1}, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j")) == {"a": 1}
    made = []
    for _ in range(2):
        files.cached(spark, str(tmp_path / "c"), lambda: made.append(1) or ents)
    assert len(made) == 1


def test_streaming(spark, tmp_path):
    from quillon.streaming import incremental

    schema = "id long, src int, country string, kind string, key string"
    entities = spark.createDataFrame([(1, 1, "c", "cc", "k1"), (2, 1, "c", "cc", "k2")], schema)
    spark.createDataFrame([(10, 2, "c", "cc", "k1"), (11, 3, "c", "cc", "zz")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(entities.schema).parquet(str(tmp_path / "in"))
    got = []
    q = incremental.link_stream(stream, entities, lambda df, i: got.extend((r.e, r.src, r.r) for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert got == [(1, 2, 10)]
