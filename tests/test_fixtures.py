"""Golden mini fixtures (FIXTURES.md §C) written as tiny literals."""

import os

import numpy as np
from pyspark.sql import functions as F

from annospark.functions import keys
from annospark.operators import ensemble, knn, metrics as M, ontology as G, submit as U
from annospark.sources import obo, sequences, tables


def _write(path, name, text):
    p = os.path.join(path, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_accession_truth_table(spark):
    rows = [("P1",), ("sp|P1|N",), ("tr|P1",), ("gnl|A|B",), ("x|y",), (" P1 ",)]
    df = spark.createDataFrame(rows, "raw string")
    out = df.select("raw", *[keys.accession(F.col("raw"), p).alias(p)
                             for p in ("strict", "lenient", "regex", "split")]).collect()
    got = {r["raw"]: (r["strict"], r["lenient"], r["regex"], r["split"]) for r in out}
    assert got["P1"] == ("P1", "P1", "P1", "P1")
    assert got["sp|P1|N"] == ("P1", "P1", "P1", "P1")
    assert got["tr|P1"] == ("tr|P1", "P1", "tr|P1", "P1")
    assert got["gnl|A|B"] == ("gnl|A|B", "A", "A", "A")
    assert got["x|y"] == ("x|y", "x|y", "x|y", "y")
    assert got[" P1 "] == ("P1", "P1", " P1 ", " P1 ")


def test_fasta(spark, tmpdir_path):
    p = _write(tmpdir_path, "a.fasta",
               ">sp|P1|N1 9606 desc with > inside\nMKV\nLLA\n>P2 notanumber\nUZOB\n>P3\nAC\n")
    f = {r["raw_id"]: r for r in sequences.read_fasta(spark, p).collect()}
    assert f["sp|P1|N1"]["sequence"] == "MKVLLA" and f["sp|P1|N1"]["taxon_id"] == 9606
    assert f["P2"]["taxon_id"] == 0 and f["P3"]["taxon_id"] == 0
    assert sorted(r["row_idx"] for r in f.values()) == [0, 1, 2]
    assert f["sp|P1|N1"]["row_idx"] == 0
    s = spark.createDataFrame([("UZOBA",)], "s string").select(
        keys.sanitise_residues(F.col("s")).alias("a"), keys.sanitise_residues(F.col("s"), True).alias("b")).first()
    assert s["a"] == "XXXXA" and s["b"] == "X X X X A"


OBO = """format-version: 1.2

[Term]
id: GO:A
name: a
namespace: biological_process

[Term]
id: GO:B
name: b
namespace: biological_process
is_a: GO:A ! a

[Term]
id: GO:C
name: c
namespace: biological_process
alt_id: GO:C2
is_a: GO:A ! a

[Term]
id: GO:D
name: d
namespace: biological_process
is_a: GO:B ! b
is_a: GO:C ! c

[Term]
id: GO:O
name: old
namespace: molecular_function
is_obsolete: true

[Typedef]
id: part_of
namespace: external
is_a: GO:X ! leak
"""


def test_obo_strict(spark, tmpdir_path):
    p = _write(tmpdir_path, "go.obo", OBO)
    terms, edges, alt = obo.read_obo(spark, p)
    t = {r["term_id"]: r for r in terms.collect()}
    assert set(t) == {"GO:A", "GO:B", "GO:C", "GO:D", "GO:O"}
    assert t["GO:O"]["is_obsolete"] and not t["GO:A"]["is_obsolete"]
    assert t["GO:D"]["aspect"] == "BP" and t["GO:O"]["aspect"] == "MF"
    assert {(r["child"], r["parent"]) for r in edges.collect()} == {
        ("GO:B", "GO:A"), ("GO:C", "GO:A"), ("GO:D", "GO:B"), ("GO:D", "GO:C")}
    assert [(r["alt_id"], r["term_id"]) for r in alt.collect()] == [("GO:C2", "GO:C")]
    assert t["GO:D"]["namespace"] == "biological_process"  # typedef namespace did not leak


def test_gaf(spark, tmpdir_path):
    lines = ["!gaf-version: 2.2",
             "DB\tE1\ts\t\tGO:1\tR\tIEA\t",
             "DB\tE1\ts\t\tGO:2\tR\tIDA\t",
             "DB\tE2\ts\t\tGO:1\tR\tEXP\t",
             "DB\tE1\ts\t\tGO:1\tR\tIEA\t",
             "DB\tE9\ts\t\tGO:3\tR\tIEA\t",
             "DB\tE1\ts\t\tGO:4\tR"]
    p = _write(tmpdir_path, "x.gaf", "\n".join(lines) + "\n")
    g = tables.read_gaf(spark, p)
    assert g.count() == 5
    iea = keys.evidence_filter(g, only_iea=True)
    ents = spark.createDataFrame([("E1",), ("E2",)], "entity_id string")
    kept = iea.join(ents, "entity_id", "left_semi").dropDuplicates()
    assert [(r["entity_id"], r["term_id"]) for r in kept.collect()] == [("E1", "GO:1")]
    noexp = keys.evidence_filter(g, exclude_experimental=True)
    assert set(r["evidence"] for r in noexp.collect()) == {"IEA"}


def _diamond(spark):
    edges = spark.createDataFrame([("B", "A"), ("C", "A"), ("D", "B"), ("D", "C")], "child string, parent string")
    return edges


def test_propagation_gap(spark):
    edges = _diamond(spark)
    contract = spark.createDataFrame([("A",), ("D",)], "term_id string")
    scores = spark.createDataFrame([(1, "D", 0.9), (1, "A", 0.2)], "entity_id int, term_id string, score double")
    mx = {r["term_id"]: r["score"] for r in G.max_propagate(scores, G.contract_closure(edges, contract)).collect()}
    assert mx == {"A": 0.2, "D": 0.9}  # the gap (B, C not in contract) blocks propagation
    cl = G.ancestor_closure(edges)
    ext = spark.createDataFrame([(1, "D")], "entity_id int, term_id string")
    up = {r["term_id"] for r in G.propagate_annotations(ext, cl, contract).collect()}
    assert up == {"A", "D"}  # full-graph closure reaches A


def test_closure_diamond(spark):
    cl = {(r["term_id"], r["ancestor"]) for r in G.ancestor_closure(_diamond(spark)).collect()}
    assert cl == {("A", "A"), ("B", "B"), ("C", "C"), ("D", "D"), ("B", "A"), ("C", "A"), ("D", "B"),
                  ("D", "C"), ("D", "A")}


def test_max_then_min_is_identity(spark):
    edges = _diamond(spark)
    contract = spark.createDataFrame([(t,) for t in "ABCD"], "term_id string")
    scores = spark.createDataFrame([(1, "D", 0.9), (1, "B", 0.3), (2, "C", 0.5)],
                                   "entity_id int, term_id string, score double")
    closure = G.contract_closure(edges, contract)
    mx = G.max_propagate(scores, closure)
    mx2 = G.max_propagate(mx, closure)
    a = sorted(mx.collect())
    assert a == sorted(mx2.collect())  # idempotent
    assert sorted(G.min_propagate(mx, closure).collect()) == a
    assert G.hierarchy_violations(mx, edges, contract).count() == 0
    assert G.hierarchy_violations(scores, edges, contract).count() > 0
    raw_min = {(r["entity_id"], r["term_id"]) for r in G.min_propagate(scores, closure).collect()}
    assert raw_min == set()  # every scored term misses an ancestor score -> 0


def _dense_e1(scores, truth, ia, terms, thr):
    tp = pred = true = 0.0
    for e in set(k[0] for k in list(scores) + list(truth)):
        for t in terms:
            s = scores.get((e, t), 0.0)
            y = (e, t) in truth
            p = s >= thr
            tp += ia[t] * (p and y)
            pred += ia[t] * p
            true += ia[t] * y
    P = tp / pred if pred else 0.0
    R = tp / true if true else 0.0
    return 2 * P * R / (P + R) if P + R else 0.0


def test_metrics_sparse_equals_dense(spark):
    terms = ["t1", "t2", "t3", "t4"]
    ia = {"t1": 1.0, "t2": 0.5, "t3": 2.0, "t4": 0.0}
    scores = {("e1", "t1"): 0.9, ("e1", "t2"): 0.4, ("e2", "t3"): 0.6, ("e2", "t1"): 0.2}
    truth = {("e1", "t1"), ("e1", "t3"), ("e3", "t2")}
    s = spark.createDataFrame([(e, t, v) for (e, t), v in scores.items()], "entity_id string, term_id string, score double")
    tr = spark.createDataFrame(list(truth), "entity_id string, term_id string")
    tm = spark.createDataFrame([(t, "BP") for t in terms], "term_id string, aspect string")
    iadf = spark.createDataFrame(list(ia.items()), "term_id string, ia double")
    c = M.cells(s, tr, tm, iadf, 0.0)
    for thr in (0.3, 0.5):
        got = {r["aspect"]: r["f1"] for r in M.ia_f1_pooled(c, thr).collect()}
        assert abs(got["ALL"] - _dense_e1(scores, truth, ia, terms, thr)) < 1e-12
        assert abs(got["ALL"] - got["BP"]) < 1e-12
    cur = {r["thr"]: r["f1"] for r in M.threshold_curve(c, [0.3, 0.5]).filter("aspect = 'ALL'").collect()}
    assert abs(cur[0.3] - _dense_e1(scores, truth, ia, terms, 0.3)) < 1e-12


def test_threshold_tie_lowest_wins(spark):
    curve = spark.createDataFrame([("ALL", 0.2, 0.5), ("ALL", 0.3, 0.7), ("ALL", 0.4, 0.7)],
                                  "aspect string, thr double, f1 double")
    b = M.best_threshold(curve).first()
    assert b["best_thr"] == 0.3 and b["best_f1"] == 0.7


def test_knn_fixture(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(6, 4)).astype(np.float32)
    v = spark.createDataFrame([(i, X[i].tolist()) for i in range(6)], "vec_id long, embedding array<float>")
    n = knn.knn_join(v, v, 2, block_rows=2)  # several blocks on each side
    X64 = X.astype(np.float64)
    U_ = X64 / np.linalg.norm(X64, axis=1, keepdims=True)
    S_ = U_ @ U_.T
    np.fill_diagonal(S_, -np.inf)
    got = {(r["query_id"], r["rank"]): r["base_id"] for r in n.collect()}
    for q in range(6):
        order = sorted(range(6), key=lambda b: (-S_[q, b], b))[:2]
        assert [got[(q, 1)], got[(q, 2)]] == order
    labels = spark.createDataFrame([(order_b, "T") for order_b in range(3)], "entity_id long, term_id string")
    tr = {(r["query_id"]): r["score"] for r in knn.neighbour_label_transfer(n, labels).collect()}
    for q, sc in tr.items():
        nb = sorted(range(6), key=lambda b: (-S_[q, b], b))[:2]
        num = sum(S_[q, b] for b in nb if b < 3)
        assert abs(sc - num / sum(S_[q, b] for b in nb)) < 1e-9
    z = spark.createDataFrame([(1, "a", 0.0), (2, "a", 0.5), (2, "b", 0.25)],
                              "entity_id int, term_id string, score double")
    rm = {(r["entity_id"], r["term_id"]): r["score"] for r in ensemble.row_max_normalise(z).collect()}
    assert rm == {(1, "a"): 0.0, (2, "a"): 1.0, (2, "b"): 0.5}


def test_formatter(spark):
    df = spark.createDataFrame([(0.5,), (0.12345,), (1.0,), (0.0004567,), (0.0004,)], "x double")
    got = [(r["a"], r["b"]) for r in df.select(U.fmt_sig3(F.col("x")).alias("a"),
                                               U.fmt_fixed3(F.col("x")).alias("b")).collect()]
    assert got == [("0.5", "0.500"), ("0.123", "0.123"), ("1", "1.000"), ("0.000457", "0.001"), ("0.0004", "0.001")]


def test_submission_rules(spark):
    rows = [(1, f"GO:{i:07d}", 0.5) for i in range(1501)]
    df = spark.createDataFrame(rows, "entity_id int, term_id string, score double")
    top = U.top_n_per_entity(df, 1500)
    assert top.count() == 1500
    assert top.agg(F.max("term_id")).first()[0] == "GO:0001499"  # ties broken by term id
    names = spark.createDataFrame([("GO:0000000", "a\tb é" + "x" * 3000)], "term_id string, name string")
    d = U.top3_description(df, names).first()
    assert "\t" not in d["description"] and "?" in d["description"]
    assert len(d["description"]) == 2900 and d["description"].endswith("...")
    bad = U.validate_submission(df, max_terms=1500).collect()
    assert [r["rule"] for r in bad] == ["too_many_terms"]
