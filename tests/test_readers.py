"""Reader edge cases."""

import os

import pytest
from pyspark.sql import functions as F

from annospark.operators import audit as A
from annospark.sources import sequences, tables


def _write(path, name, text):
    p = os.path.join(path, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_header_stats(spark, tmpdir_path):
    p = _write(tmpdir_path, "s.fa", ">a\nAA\n>b x\nC\n>c\n\n>d\nG\n")
    r = sequences.fasta_header_stats(sequences.read_fasta(spark, p), 2).first()
    assert r["records"] == 4 and r["first_ids"] == ["a", "b"]


def test_annotation_header_is_checked(spark, tmpdir_path):
    good = _write(tmpdir_path, "good.tsv", "EntryID\tterm\taspect\nP1\tGO:0000001\tP\n")
    assert tables.read_annotations(spark, good).collect()[0]["term_id"] == "GO:0000001"
    bad = _write(tmpdir_path, "bad.tsv", "id\tterm\taspect\nP1\tGO:0000001\tP\n")
    with pytest.raises(ValueError):
        tables.read_annotations(spark, bad)


def test_taxonomy_two_columns(spark, tmpdir_path):
    ok = _write(tmpdir_path, "t.tsv", "P1\t9606\nP2\t10090\n")
    assert tables.read_taxonomy(spark, ok).count() == 2
    bad = _write(tmpdir_path, "t2.tsv", "P1\t9606\textra\n")
    with pytest.raises(Exception):
        tables.read_taxonomy(spark, bad).collect()


def test_ia_headerless_keeps_first_term(spark, tmpdir_path):
    headerless = _write(tmpdir_path, "ia1.tsv", "GO:1\t0.5\nGO:2\tx\nGO:3\t2\n")
    got = {r["term_id"]: r["ia"] for r in tables.read_ia(spark, headerless).collect()}
    assert got == {"GO:1": 0.5, "GO:3": 2.0}
    with_header = _write(tmpdir_path, "ia2.tsv", "term\tia\nGO:1\t0.5\n")
    assert [r["term_id"] for r in tables.read_ia(spark, with_header).collect()] == ["GO:1"]


def test_term_count_sniffing(spark):
    a = spark.createDataFrame([("GO:1", 3)], "TERM string, N long")
    b = spark.createDataFrame([("GO:1", 3)], "whatever string, second long")
    assert tables.select_term_counts(a).first() == tables.select_term_counts(b).first()


def test_stage_skip(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "stage")
    first = tables.write_stage(spark.range(5), path)
    again = tables.write_stage(spark.range(0), path)
    assert first.count() == again.count() == 5


def test_choose_best_source(spark):
    listing = spark.createDataFrame(
        [("k", "/x/other.tsv"), ("k", "/x/goa_iea.tsv.gz"), ("k", "/x/goa_filtered_iea.tsv"),
         ("k", "/x/goa_filtered_all.gaf"), ("j", "/y/b.tsv"), ("j", "/y/a.tsv.gz")], "kind string, path string")
    got = {r["kind"]: r["path"] for r in A.choose_best_source(listing).collect()}
    assert got == {"k": "/x/goa_filtered_all.gaf", "j": "/y/a.tsv.gz"}


def test_record_tsv(spark, tmpdir_path):
    p = _write(tmpdir_path, "u.tsv", "Entry\tProtein names\tOrganism\tPubMed ID\n"
               " P1 \tKinase\tHuman\t12; 7;12 x9\n\tEmpty\tMouse\t\n")
    r = tables.read_uniprot_tsv(spark, p).collect()
    assert len(r) == 1 and r[0]["accession"] == "P1" and r[0]["pubmed_ids"] == ["12", "7"]
    assert r[0]["keywords"] == ""


def test_stage_manifest_and_inventory(spark, tmpdir_path):
    _write(tmpdir_path, "a.parquet", "x")
    listing = spark.read.format("binaryFile").load(tmpdir_path).select("path", "length", "modificationTime")
    m = A.stage_manifest(listing, "parsed", "note").first()
    assert m["stage"] == "parsed" and m["bytes"] == 1 and m["ts_utc"].endswith("Z")
    present = listing.select(F.regexp_extract("path", "([^/]+)\\.parquet$", 1).alias("name"), "length")
    req = spark.createDataFrame([("a",), ("b",)], "name string")
    got = {r["name"]: r["exists"] for r in A.artefact_inventory(req, present).collect()}
    assert got == {"a": True, "b": False}


def test_resolve_alt_ids(spark):
    from annospark.functions import keys
    terms = spark.createDataFrame([("GO:1",), ("GO:9",), ("GO:7",)], "term_id string")
    alt = spark.createDataFrame([("GO:9", "GO:2")], "alt_id string, term_id string")
    got = {r["term_id"]: (r["resolved"], r["was_alt"]) for r in keys.resolve_alt_ids(terms, alt).collect()}
    assert got == {"GO:1": ("GO:1", False), "GO:9": ("GO:2", True), "GO:7": ("GO:7", False)}
    known = spark.createDataFrame([("GO:9",), ("GO:1",)], "term_id string")  # a term of the ontology stays
    assert not any(r["was_alt"] for r in keys.resolve_alt_ids(terms, alt, known).collect())


def test_text_row_limit(spark):
    from annospark.operators import submit as U
    rows = spark.createDataFrame([(1, "GO:0000001", 0.5)], "entity_id int, term_id string, score double")
    desc = spark.createDataFrame([(1, "ok", 0.5)] * 6, "entity_id int, description string, score double")
    rules = [r["rule"] for r in U.validate_submission(rows, desc).collect()]
    assert rules == ["too_many_text_rows"]
