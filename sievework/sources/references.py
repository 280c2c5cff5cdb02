"""Benchmark references and the adapters that load them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import SparkSession

from .datasets import ROW, Dataset, read_dataset, resolve

FilePath = str | Path


class ReferenceLoad(NamedTuple):
    """A reference and where it comes from."""

    dataset: Dataset
    source: str

    @property
    def path(self) -> str:
        return self.dataset.path


class BenchmarkAdapter(ABC):
    """A benchmark by name: which fields hold a record's text (the first non-blank one counts) and how its reference is loaded.

    Anything with these names will do; ``register`` asks for no inheritance.
    """

    id: str
    name: str
    description = ""
    fields: tuple[str, ...] = ("text",)

    def candidate_fields(self):
        return list(self.fields)

    @abstractmethod
    def load_reference(self, spark: SparkSession, reference: FilePath | None = None) -> ReferenceLoad:
        """The user's file if there is one, else what comes with the adapter."""

    def notes_for_reference(self, source):
        """What a report says about the reference used."""
        return ("input.reference_source states which reference was used.",)


def _users_file(spark: SparkSession, reference: FilePath) -> ReferenceLoad:
    found = resolve(reference)
    if found.is_file():
        return ReferenceLoad(read_dataset(spark, found), "user_reference")
    raise FileNotFoundError(f"Reference dataset not found: {found}")


class Gsm8kAdapter(BenchmarkAdapter):
    id, name = "gsm8k", "GSM8K"
    description = "Grade-school mathematics questions; a handful of made-up ones are packaged for trying things out."
    fields = ("question", "problem", "prompt", "text")
    #: Questions in the benchmark's manner, written for this package; real audits name a reference file.
    sample = (
        ("A baker fills 6 trays with 14 rolls each and sells 59 rolls. How many rolls are left?", "6 * 14 = 84 rolls were baked. 84 - 59 = 25 are left. #### 25"),
        ("Ines reads 18 pages a day. How many days does she need for a book of 270 pages?", "270 / 18 = 15. #### 15"),
        ("A tank holds 480 litres and loses 12 litres an hour. How much is left after 9 hours?", "9 * 12 = 108. 480 - 108 = 372. #### 372"),
        ("Tickets cost 7 dollars, and 3 of 25 visitors enter free. What do the visitors pay together?", "22 * 7 = 154. #### 154"),
        ("A gardener plants 5 rows of 16 bulbs; a quarter do not sprout. How many sprout?", "5 * 16 = 80. 80 * 3 / 4 = 60. #### 60"),
    )

    def load_reference(self, spark, reference=None):
        if reference is not None:
            return _users_file(spark, reference)
        rows = [(*pair, i) for i, pair in enumerate(self.sample)]
        frame = spark.createDataFrame(rows, f"question string, answer string, {ROW} long")
        return ReferenceLoad(Dataset(frame, "jsonl", "packaged:gsm8k_sample", ["question", "answer"], 0), "packaged_sample")

    def notes_for_reference(self, source):
        which = {"user_reference": "The reference is the user's own file."}
        used = which.get(source, "The reference is a tiny packaged sample, not the benchmark itself; name a reference file for a real audit.")
        return (*super().notes_for_reference(source), used, "Equal texts are evidence of overlap; whether that is contamination is not decided here.")


class TableAdapter(BenchmarkAdapter):
    """An adapter for any reference table: its fields and its file (or Parquet folder) are given."""

    def __init__(self, id: str, fields: list[str], path: FilePath, name: str | None = None, description: str = "") -> None:
        self.id, self.name, self.description, self.fields, self.table = id.strip().lower(), name or id, description, tuple(fields), path

    def load_reference(self, spark, reference=None):
        if reference is not None:
            return _users_file(spark, reference)
        return ReferenceLoad(read_dataset(spark, self.table, allow_directory=True), "registered_table")


_BY_ID: dict[str, BenchmarkAdapter] = {}


def register(adapter: BenchmarkAdapter) -> None:
    _BY_ID[adapter.id.strip().lower()] = adapter


def get_adapter(name: str) -> BenchmarkAdapter:
    found = _BY_ID.get(name.strip().lower())
    if found is None:
        known = ", ".join(sorted(_BY_ID))
        raise ValueError(f"Unknown benchmark '{name}'. Known: {known}")
    return found


def list_adapters() -> list[BenchmarkAdapter]:
    return [_BY_ID[k] for k in sorted(_BY_ID)]


register(Gsm8kAdapter())
list_benchmarks, get_benchmark = list_adapters, get_adapter
