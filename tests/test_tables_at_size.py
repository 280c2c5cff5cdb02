"""Queries over tables as they come at size: folders of files, and rows without texts."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def changed(tmp_path, documents):
    for name in os.listdir(SF):
        if name != "documents.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    half = len(documents) // 2
    for k, part in enumerate((documents[:half], documents[half:])):
        pq.write_table(part, folder / f"part-{k}.parquet")
    return str(tmp_path)


def test_command_line_over_a_folder_of_documents(spark, tmp_path):
    documents = pq.read_table(f"{SF}/documents.parquet")
    runs = {r["run"]: (r["code"], r["said"], r["rows"]) for r in entry.queries()["cli_runs"](spark, changed(tmp_path, documents)).collect()}
    assert runs["scan"] == (0, "", len(documents))


def test_extraction_says_what_its_sql_says_of_blank_texts(spark, tmp_path):
    documents = pq.read_table(f"{SF}/documents.parquet")
    texts = documents["text"].to_pylist()
    texts[:6] = ["", None, " \t", "\u3000", "", None]
    d = changed(tmp_path, documents.set_column(documents.column_names.index("text"), "text", pa.array(texts, pa.string())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{d}/benchmark.parquet'")
    want = con.execute(f"SELECT row, field, digest FROM ({entry.oracle_sql()['benchmark_extract']})").fetchall()
    got = [(r["row"], r["field"], r["digest"]) for r in entry.queries()["benchmark_extract"](spark, d).collect()]
    assert sorted(got) == sorted(want) and len(got) == len({r for r, _, _ in got})
