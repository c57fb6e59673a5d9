"""Enrichment configurations compiled to one lazy DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.nested import prompt
from ..operators.records import constraint_errors, extract

Enrichment = Callable[[DataFrame], DataFrame]


@dataclass
class Step:
    """An enrichment: a column `id` made of input fields or of earlier ids.

    make takes the inputs as Columns.  For what no Column expresses, table takes
    the DataFrame and the inputs' names and returns it with the column `id`.
    """

    id: str
    inputs: tuple[str, ...]
    make: Callable[..., Column] | None = None
    table: Callable[[DataFrame, tuple[str, ...]], DataFrame] | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        return self.table(df, self.inputs) if self.table else df.withColumn(self.id, self.make(*map(F.col, self.inputs)))


@dataclass
class Group:
    """Steps whose results only the group's merges see: later steps and prompts see those of the merges."""

    steps: list[Step]
    merges: list[Step]

    def apply(self, df: DataFrame) -> DataFrame:
        for step in (*self.steps, *self.merges):
            df = step.apply(df)
        return df.drop(*(s.id for s in self.steps if s.id not in {m.id for m in self.merges}))


@dataclass
class Plan:
    """What a media type's configuration declares.

    constraints and required split rows off with reasons; computed fields come
    from arrays of structs; enrichments are steps and groups of steps, in order;
    prompts name fields as {Field} and results as {@id}, {@id.key} or {@id.0};
    overrides put the result of an id in the place of a field.
    """

    constraints: dict[str, dict] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    computed: dict[str, dict] = field(default_factory=dict)
    enrichments: list[Step | Group] = field(default_factory=list)
    prompts: dict[str, str] = field(default_factory=dict)
    overrides: dict[str, str] = field(default_factory=dict)

    def steps(self) -> list[Enrichment]:
        out: list[Enrichment] = [lambda df: df.withColumn("errors", constraint_errors(self.constraints, self.required))]
        if self.computed:
            out.append(lambda df: df.withColumns({k: extract(v["array"], v.get("where", {}), v["value"], v.get("multiple", False)) for k, v in self.computed.items()}))
        out += [e.apply for e in self.enrichments]
        for name, template in self.prompts.items():  # one after another: a prompt may name an earlier one
            out.append(lambda df, name=name, template=template: df.withColumn(name, prompt(template, {f.name: f.dataType for f in df.schema})))
        if self.overrides:
            out.append(lambda df: df.withColumns({k: F.coalesce(F.col(v), F.col(k)) for k, v in self.overrides.items()}))
        return out

    def apply(self, records: DataFrame) -> DataFrame:
        """All steps over valid and invalid records alike; those with errors keep their reasons."""
        for step in self.steps():
            records = records.transform(step)
        return records


def answered(requests: DataFrame, model: Callable, schema: str, cache: DataFrame | None = None) -> DataFrame:
    """Distinct requests (cache_key, prompt) answered by a user's function over Arrow batches, those in the cache left out."""
    todo = requests.select("cache_key", "prompt").dropDuplicates(["cache_key"])
    if cache is not None:
        todo = todo.join(cache.select("cache_key"), "cache_key", "left_anti")
    return todo.mapInArrow(model, schema)


def analysed(rows: DataFrame, kind: str, analyses: dict[str, dict[str, Column]]) -> DataFrame:
    """rows with what the analysis of their media type (column kind) takes from them; types without one have nulls."""
    names = list(dict.fromkeys(n for a in analyses.values() for n in a))
    of = lambda n: F.coalesce(*(F.when(F.col(kind) == t, a[n]) for t, a in analyses.items() if n in a))
    return rows.withColumns({n: of(n) for n in names})
