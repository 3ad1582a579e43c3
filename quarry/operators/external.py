"""Calls to models behind injected clients, and what checks their answers.

A client is any picklable object with the methods of Client; the default is a deterministic stub, whose output says so, and
nothing here opens a connection by itself. Calls are made in tasks, a batch of rows at a time.
"""

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Client(Protocol):
    def chat(self, prompts: Sequence[str]) -> list[str]: ...

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Offline:
    """Answers that depend on the prompt alone: a label, and vectors of hashed words."""

    dimension = 64

    def chat(self, prompts: Sequence[str]) -> list[str]:
        return [f"offline:{hashlib.sha256(p.encode()).hexdigest()[:12]}" for p in prompts]

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in t.lower().split():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


def chatted(rows: DataFrame, prompt: str, name: str, client: Client | None = None, batch: int = 32) -> DataFrame:
    """rows with the client's answer to each prompt; null prompts get none."""
    client = client or Offline()

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            asked = s.dropna()
            answers: list[str] = []
            for i in range(0, len(asked), batch):
                answers += client.chat(asked.iloc[i : i + batch].tolist())
            yield pd.Series(answers, index=asked.index, dtype=object).reindex(s.index)

    return rows.withColumn(name, F.pandas_udf("string")(run)(F.col(prompt)))


def embedded(rows: DataFrame, text: str, name: str, client: Client | None = None, batch: int = 10) -> DataFrame:
    """rows with the client's vector of each text, asked for `batch` at a time; null texts get none."""
    client = client or Offline()

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            asked = s.dropna()
            vectors: list[list[float]] = []
            for i in range(0, len(asked), batch):
                vectors += client.embed(asked.iloc[i : i + batch].tolist())
            yield pd.Series(vectors, index=asked.index, dtype=object).reindex(s.index).map(lambda v: v if isinstance(v, list) else None)

    return rows.withColumn(name, F.pandas_udf("array<double>")(run)(F.col(text)))


def trials(questions: DataFrame, solvers: DataFrame, prompt: str, name: str = "answer", client: Client | None = None) -> DataFrame:
    """Each question put to each solver; solvers are a short list."""
    return chatted(questions.crossJoin(F.broadcast(solvers)), prompt, name, client)


def violations(rows: DataFrame, keys: Sequence[str], checks: dict[str, Column]) -> DataFrame:
    """(keys, violation) for each check that a row fails; a null check fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(failed).alias("violation"))


def edge_checks(kind: str) -> dict[str, Column]:
    """What an edge candidate of a kind must satisfy; columns: both ends' units and macros, evidence_unit, context's macros."""
    both = {"known_ends": F.col("source_known") & F.col("target_known"), "no_loop": F.col("source") != F.col("target")}
    own = {
        "unit": {"one_unit": F.col("source_unit") == F.col("target_unit")},
        "macro": {"two_units": F.col("source_unit") != F.col("target_unit"), "evidence_at_an_end": F.col("evidence_unit").isin(F.col("source_unit"), F.col("target_unit"))},
        "adjacent": {"along_the_spine": (F.col("source_macro") == F.col("from_macro")) & (F.col("target_macro") == F.col("to_macro"))},
        "thread": {"two_macros": F.col("source_macro") != F.col("target_macro")},
    }
    return both | own[kind]


def strict(found: DataFrame, what: str) -> None:
    """Raise if there are violations, naming the first."""
    if first := found.head():
        raise ValueError(f"{what}: {first.asDict()}")
