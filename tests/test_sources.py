import json

import pytest

from sievework.sources.datasets import ROW, detect_format, read_dataset
from sievework.sources.references import Gsm8kAdapter, BenchmarkAdapter, TableAdapter, get_adapter, list_adapters, register
from sievework.sources.sinks import write_json_report


def test_formats(tmp_path):
    assert [detect_format(f"a{s}") for s in (".jsonl", ".JSON", ".parquet", ".pq")] == ["jsonl", "jsonl", "parquet", "parquet"]
    with pytest.raises(ValueError, match="Unsupported format"):
        detect_format("a.csv")


def test_missing_folder_and_csv(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_dataset(spark, tmp_path / "none.jsonl")
    with pytest.raises(ValueError, match="Expected a file"):
        read_dataset(spark, tmp_path)
    (tmp_path / "a.csv").write_text("a,b\n")
    odd = tmp_path / "a.csv"
    with pytest.raises(ValueError) as failure:
        read_dataset(spark, odd)
    assert "Unsupported" in str(failure.value)


def test_jsonl_order_blank_lines_and_missing_keys(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"z": 1, "a": "x"}\n\n{"a": "y", "m": null, "q": "later"}\n{"z": 3}\n')
    d = read_dataset(spark, p)
    assert d.columns[:2] == ["z", "a"] and d.columns[-1] == "q"
    rows = d.frame.orderBy(ROW).collect()
    assert [(r[ROW], r["z"], r["a"]) for r in rows] == [(0, 1, "x"), (1, None, "y"), (2, 3, None)]


def test_row_numbers_over_many_splits(spark, tmp_path):
    p = tmp_path / "big.jsonl"
    p.write_text("".join(json.dumps({"i": i, "pad": "x" * 50}) + "\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        d = read_dataset(spark, p)
        assert d.frame.rdd.getNumPartitions() > 3
        assert d.frame.where(f"i <> {ROW}").count() == 0 and d.rows() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parquet_file_and_folder(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "all.parquet"
    folder.mkdir()
    for k in range(3):
        pq.write_table(pa.table({"i": list(range(k * 10, k * 10 + 10))}), folder / f"p{k}.parquet")
    d = read_dataset(spark, folder / "p1.parquet")
    assert sorted((r[ROW], r["i"]) for r in d.frame.collect()) == [(k, 10 + k) for k in range(10)]
    d = read_dataset(spark, folder, allow_directory=True)
    assert sorted((r[ROW], r["i"]) for r in d.frame.collect()) == [(k, k) for k in range(30)]


def test_adapters(spark, tmp_path):
    assert isinstance(get_adapter("  GSM8K "), BenchmarkAdapter) and [a.id for a in list_adapters()] == ["gsm8k"]
    with pytest.raises(ValueError, match="Unknown benchmark"):
        get_adapter("other")
    with pytest.raises(FileNotFoundError):
        Gsm8kAdapter().load_reference(spark, tmp_path / "none.jsonl")
    assert Gsm8kAdapter().load_reference(spark).dataset.rows() == 5
    (tmp_path / "r.jsonl").write_text('{"question": "q"}\n')
    register(TableAdapter("mine", ["question"], tmp_path / "r.jsonl"))
    try:
        assert get_adapter("mine").load_reference(spark).source == "registered_table"
    finally:
        from sievework.sources import references

        references._BY_ID.pop("mine")


def test_json_sink(tmp_path):
    written = write_json_report({"a": "é"}, tmp_path / "x" / "r.json")
    assert written.read_text(encoding="utf-8") == '{\n  "a": "é"\n}\n' and written.is_absolute()
