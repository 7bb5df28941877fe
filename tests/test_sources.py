"""File readers on small files."""

import json

import pytest

from dyadlake.sources import tables as T


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_pairs_and_sidecar(spark, tmp_path):
    path = put(tmp_path, "p.txt", "2 1\n1\t2 x\nlonely\n\n3 3\n")
    assert T.read_pairs(spark, path).count() == 3
    assert [r["key"] for r in T.read_pair_keys(spark, path).collect()] == ["1|2"]
    path = put(tmp_path, "s.tsv", "entrez1\tentrez2\tsources\tcell_lines\tpubmed_ids\n2\t1\tA;B\tx\t1\n1\t2\tB;C\t\t2; 1\n")
    r = T.read_sidecar(spark, path).first()
    assert (r["a"], r["b"], r["sources"], r["lines"], r["refs"]) == ("1", "2", ["A", "B", "C"], ["x"], ["1", "2"])


def test_ordered_ids_refuse_repeats(spark, tmp_path):
    assert [r["id"] for r in T.read_ordered_ids(spark, put(tmp_path, "g.txt", "7\n3\n5\n")).orderBy("idx").collect()] == ["7", "3", "5"]
    with pytest.raises(Exception, match="repeated id"):
        T.read_ordered_ids(spark, put(tmp_path, "h.txt", "7\n3\n7\n")).collect()


def test_flagged_pairs_and_folds(spark, tmp_path):
    path = put(tmp_path, "z.csv", "gene1_entrez,gene2_entrez,target,sldb_overlap,logit_fold0,logit_fold1\n010,9,1.5,True,0.1,bad\n")
    d = T.read_flagged_pairs(spark, path, ["target", "logit_fold0", "logit_fold1"], ["sldb_overlap"])
    r = T.fold_columns(d, "logit_fold").orderBy("fold").collect()
    assert (r[0]["key"], r[0]["sldb_overlap"], r[0]["value"], r[1]["value"]) == ("010|9", True, 0.1, None)
    with pytest.raises(ValueError, match="missing"):
        T.read_flagged_pairs(spark, path, ["absent"], [])


def test_screens(spark, tmp_path):
    got = T.read_screen(spark, put(tmp_path, "a.tsv", "FirstGene\tSecondGene\tGamma\na\tB\t1\nc\tC\t2\nd\te\tx\n"), "columns", "Gamma").collect()
    assert got == [("A", "B", 1.0)]
    got = T.read_screen(spark, put(tmp_path, "b.csv", "gene_combination,sens\na_mis;b,1\nc,2\n"), "semicolon", "sens").collect()
    assert got == [("A", "B", 1.0)]
    got = T.read_screen(spark, put(tmp_path, "c.csv", "GeneCombinationName,GI\nA:B,1\nctrl1:B,2\nA:B:C,3\n"), "colon", "GI", ("ctrl",)).collect()
    assert got == [("A", "B", 1.0)]


def test_biology_formats(spark, tmp_path):
    gaf = "!c\nDB\t1\tG1\t\tGO:1\nDB\t1\tG1\tNOT|x\tGO:2\nDB\t1\tG1\t\tGO:0\n"
    assert T.read_annotations(spark, put(tmp_path, "x.gaf", gaf)).collect() == [("G1", ["GO:0", "GO:1"])]
    assert T.read_sequences(spark, put(tmp_path, "x.fa", ">sp|P1|N GN=ABC PE=1\nMK\nLV\n")).collect() == [("P1", "ABC", "MKLV")]
    assert T.read_links(spark, put(tmp_path, "l.txt", "protein1 protein2 combined_score\na b 700\na b 699\nc c 999\n")).count() == 1
    assert [round(x, 3) for x in T.read_word_vectors(spark, put(tmp_path, "w.txt", "1 2\na 0.5 1\n")).first()["vec"]] == [0.5, 1.0]
    tiers = T.read_symbol_tiers(spark, put(tmp_path, "h.tsv", "symbol\tprev_symbol\talias_symbol\tentrez_id\nA\tB|C\t\t1\nD\t\tE\t\n"))
    assert [t.count() for t in tiers] == [1, 2, 0]


def test_results_and_sinks(spark, tmp_path):
    put(tmp_path, "r.json", json.dumps({"summary": {"model": "m", "cv_type": "cv1", "folds": [{"auroc": 0.5}, {"auroc": 0.75}]}}))
    d = T.read_results(spark, str(tmp_path / "r.json"))
    assert sorted((r["fold"], r["value"]) for r in d.collect()) == [(0, 0.5), (1, 0.75)]
    T.write_partitioned(d, str(tmp_path / "out"), "cv", "fold")
    assert spark.read.parquet(str(tmp_path / "out")).filter("fold = 1").first()["value"] == 0.75
    T.write_csv(d, str(tmp_path / "csv"), ["model", "value"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["model", "value"]
