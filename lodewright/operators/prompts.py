"""Prompt templates: fields, rendering of probes, and the data sets they test."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A name between double braces.
FIELD = r"\{\{([a-zA-Z0-9_-]*)\}\}"
PIPE, PIPE_CODE = "|||", "\1"
MOST_CHARS = 2048


def read_templates(spark: SparkSession, *paths: str) -> DataFrame:
    """(dataset, subset, id, name, jinja, answer_choices) of template files in YAML."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_multi_constructor("!", lambda loader, _, node: loader.construct_mapping(node, deep=True))
    rows = []
    for p in paths:
        found = yaml.load(Path(p).read_text(), Loader) or {}
        for key, t in (found.get("templates") or {}).items():
            rows.append((found.get("dataset"), found.get("subset"), t.get("id", key), t.get("name"), t.get("jinja"), t.get("answer_choices")))
    return spark.createDataFrame(rows, "dataset string, subset string, id string, name string, jinja string, answer_choices string")


def fields(templates: DataFrame) -> DataFrame:
    """(dataset, subset, fields): the names between double braces in the first template (by name and id) of each data set."""
    first = templates.groupBy("dataset", "subset").agg(F.min_by("jinja", F.struct("name", "id")).alias("jinja"))
    plain = F.replace("jinja", F.lit(" "))
    return first.select("dataset", "subset", F.array_distinct(F.regexp_extract_all(plain, F.lit(FIELD), F.lit(1))).alias("fields"))


def render(examples: DataFrame, jinja: str, most: int = MOST_CHARS) -> DataFrame:
    """examples with ``parts``: the template with each {{ name }} replaced by that column, cut at |||.

    Substitution only: control statements and filters need a template engine. A value is cut to ``most`` code points, and
    ||| inside it stays text. Null is empty.
    """
    out = F.lit(jinja)
    for name in examples.columns:
        value = F.replace(F.substring(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")), 1, most), F.lit(PIPE), F.lit(PIPE_CODE))
        # braces of a value must not be read as names of other columns
        value = F.replace(value, F.lit("{{"), F.lit("{\0{"))
        out = F.replace(F.regexp_replace(out, rf"\{{\{{\s*{name}\s*\}}\}}", "{{" + name + "}}"), F.lit("{{" + name + "}}"), value)
    parts = F.transform(F.split(F.replace(out, F.lit("{\0{"), F.lit("{{")), r"\|\|\|"), lambda p: F.replace(F.regexp_replace(p, r"^\s+|\s+$", ""), F.lit(PIPE_CODE), F.lit(PIPE)))
    return examples.withColumn("parts", parts)


def probes(examples: DataFrame, names: list[str], probe: str) -> DataFrame:
    """(probe, part, text): the fields of each example as the parts of a probe, all of which a document must hold."""
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("part"), F.col(f"`{n}`").cast("string").alias("text")) for i, n in enumerate(names)])
    return examples.select(F.col(probe).alias("probe"), F.inline(each))
