"""Rulesets (vocabularies and thresholds of a project) and the discovery of trace files; small, read on the driver through Spark."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ruleset:
    """A project's words; sections that a file leaves out keep their defaults."""

    name: str
    analog: tuple[str, ...] = ("analog",)
    discrete: tuple[str, ...] = ("discrete",)
    bus: tuple[str, ...] = ("bus",)
    strong_send: tuple[str, ...] = ("transmit",)
    strong_receive: tuple[str, ...] = ("acquire",)
    send: tuple[str, ...] = ("send",)
    receive: tuple[str, ...] = ("receive",)
    noise: tuple[str, ...] = ()
    generic: tuple[str, ...] = ()
    protocol: tuple[str, ...] = ("SDI", "SSM", "LABEL", "PARITY")
    excluded_attributes: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict, hash=False)

    def words(self) -> dict[str, list[str]]:
        return {f.name: list(getattr(self, f.name)) for f in fields(self) if f.name not in ("name", "extra")}


def parse(name: str, text: str) -> Ruleset:
    """A ruleset from JSON, or from YAML where a reader for it is installed; unknown sections go to `extra`."""
    try:
        data = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{name} is no JSON, and no YAML reader is installed") from e
        data = yaml.safe_load(text)
    known = {f.name for f in fields(Ruleset)} - {"name", "extra"}
    return Ruleset(name, **{k: tuple(v) for k, v in data.items() if k in known}, extra={k: v for k, v in data.items() if k not in known})


def load(spark: SparkSession, path: str) -> dict[str, Ruleset]:
    """Rulesets by name, in the order of their names, from the files of a folder."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name()).collect()
    out = [parse(r["file"].rpartition("/")[2].rpartition(".")[0], r["value"]) for r in files]
    return {r.name: r for r in sorted(out, key=lambda r: r.name)}


def chosen(found: dict[str, Ruleset], cells: DataFrame) -> Ruleset:
    """The first ruleset by id whose `auto_detect` section a table of the requirement files fits; a ValueError if none does."""
    from ..operators import sheets

    rules = sheets.rules_of(cells.sparkSession, [(name, r.extra.get("auto_detect")) for name, r in sorted(found.items())])
    first = sheets.ruleset_of_tables(cells.where("sheet is not null"), rules).agg(F.min("ruleset")).first()[0]
    if first is None:
        raise ValueError("the requirements fit no ruleset's tables")
    return found[first]


def trace_files(cells: DataFrame, names_word: str, requirements_word: str, bridge_word: str = "bridge") -> DataFrame:
    """(file, role) of trace workbooks by words in their file names: names, requirements, and as the bridge a named one or else the first that is left."""
    base = F.lower(F.element_at(F.split("file", "/"), -1))
    role = F.when(base.contains(bridge_word), "bridge").when(base.contains(names_word), "names").when(base.contains(requirements_word), "requirements")
    files = cells.select("file").distinct().withColumn("role", role)
    spare = files.where("role is null").agg(F.min("file").alias("file")).where("file is not null").withColumn("role", F.lit("bridge"))
    has = files.where("role = 'bridge'").agg(F.count("*").alias("n"))
    return files.where("role is not null").union(spare.crossJoin(has).where("n = 0").select("file", "role"))
