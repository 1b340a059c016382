import json

import pytest

from plumbline.sources import readers, sinks


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿id,text\n01,"a ""b""\nc"\n2,\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(p)).collect()] == [("01", 'a "b"\nc'), ("2", "")]
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    assert readers.read_rows(spark, str(tmp_path / "a.tsv")).columns == ["x", "y"]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"sample_id":"1","rationale":" a "}\n\n{"sample_id":"1","rationale":"b"}\n')
    assert readers.read_jsonl(spark, str(p)).count() == 2
    assert [tuple(r) for r in readers.rationale_cache(spark, str(p)).collect()] == [("1", "b")]
    assert readers.done_ids(spark, str(p)).count() == 1
    assert readers.rationale_cache(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(readers.BadRecord):
        readers.read_jsonl(spark, str(p), blank_is_error=True)
    p.write_text('{"sample_id":"1"}\nbroken\n')
    with pytest.raises(readers.BadRecord):
        readers.read_jsonl(spark, str(p))
    assert readers.read_jsonl(spark, str(p), skip_invalid=True).count() == 1


def test_splits(spark, tmp_path):
    (tmp_path / "train.json").write_text(json.dumps({"data": [{"a": 1}, {"a": 2}]}))
    (tmp_path / "p_dev.jsonl").write_text('{"a": 3}\n')
    got = readers.read_splits(spark, str(tmp_path), "p")
    assert sorted((r._split, r.a) for r in got.collect()) == [("train", 1), ("train", 2), ("val", 3)]
    with pytest.raises(FileNotFoundError):
        readers.read_splits(spark, str(tmp_path / "no"))
    with pytest.raises(ValueError, match="suffix"):
        readers.read_rows(spark, "a.xyz")


def test_row_index_and_sinks(spark, tmp_path):
    df = readers.with_row_index(spark.range(100).repartition(5))
    assert sorted(r.row_idx for r in df.collect()) == list(range(100))
    sinks.export_single(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "o.jsonl"))
    assert json.loads((tmp_path / "o.jsonl").read_text()) == {"a": 1, "b": None}
    sinks.write_csv(spark.createDataFrame([(0.5,)], "x double"), str(tmp_path / "c"), digits=6)
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().x == "0.500000"
    assert len(sinks.dataset_manifest()) == 6
    assert sinks.markdown_table([{"a": "x|y"}]).endswith("| x\\|y |")
