"""Rows that a query and its SQL twin share: small configuration, and plan-like rows for every row of a shipped table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SQL_TYPES = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def _spark_literal(v) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else _literal(v)


class Fixture:
    """Rows with a schema such as ``id long, text string``."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.columns = [p.split() for p in schema.split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        """A parenthesised SELECT with the same rows."""
        types = [_SQL_TYPES[t] for _, t in self.columns]
        rows = ", ".join("(" + ", ".join(f"CAST({_literal(v)} AS {t})" for v, t in zip(r, types, strict=True)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {rows}) AS v({', '.join(n for n, _ in self.columns)}))"


#: What tells one row of a shipped table from another, and where its words are.
SOURCES = {"documents": ("doc_id", "text"), "pages": ("page_id", "url"), "conversations": ("conv_id * 16 + turn", "text"), "events": ("event_id", "event_type"), "customer": ("c_custkey", "c_name"), "orders": ("o_orderkey", "o_orderpriority"), "embeddings": ("vec_id", "CAST(label AS VARCHAR(9))")}
#: Numbers that one row of a shipped table makes of the rows' own keys, and signs in texts that stand for its word and its number.
SPAN, WORD, NUMBER = 64, "◇", "◆"
_A_WORD = "[A-Za-z]{3,12}"


class Pattern(Fixture):
    """Rows that every row of a shipped table makes anew: keys become its own, its first word and its number fill the signs in texts,
    and of each row of the table another fifth of the rows stays out, so plans differ in what they lack."""

    def __init__(self, schema: str, rows: list[tuple], of: str = "documents", keys: tuple[str, ...] | None = None, thin: bool = True):
        super().__init__(schema, rows)
        self.of, self.keys, self.thin = of, (self.columns[0][0],) if keys is None else keys, thin

    def _kept(self, i: int) -> str:
        return f"(k + 3 * {i}) % 5 <> 0" if self.thin else "TRUE"

    def _values(self, row: tuple, sql: bool) -> list[str]:
        out = []
        for v, (name, kind) in zip(row, self.columns, strict=True):
            shown = f"CAST({_literal(v) if sql else _spark_literal(v)} AS {_SQL_TYPES[kind] if sql else kind})"
            if name in self.keys and v is not None:
                shown = f"CAST(k * {SPAN} + {v} AS {'BIGINT' if sql else kind})" if kind in ("long", "int") else f"concat({shown}, '-', CAST(k AS {'VARCHAR' if sql else 'STRING'}))"
            elif isinstance(v, str) and (WORD in v or NUMBER in v):
                shown = f"replace(replace({shown}, '{WORD}', w), '{NUMBER}', CAST(k % 250 AS {'VARCHAR' if sql else 'STRING'}))"
            out.append(shown)
        return out

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        key, words = SOURCES[self.of]
        base = spark.read.parquet(f"{sf_dir}/{self.of}.parquet").selectExpr(f"CAST({key} AS BIGINT) AS k", f"coalesce(nullif(regexp_extract({words.replace('VARCHAR(9)', 'STRING')}, '{_A_WORD}', 0), ''), 'word') AS w")
        rows = [F.struct(F.expr(f"CASE WHEN {self._kept(i)} THEN {i} ELSE -1 END").alias("r"), *[F.expr(v).alias(n) for v, (n, _) in zip(self._values(r, False), self.columns, strict=True)]) for i, r in enumerate(self.rows)]
        kept = F.filter(F.array(*rows), lambda r: r["r"] >= 0)
        return base.select(F.explode(kept).alias("row")).select(*[f"row.{n}" for n, _ in self.columns])

    def sql(self) -> str:
        key, words = SOURCES[self.of]
        names = ", ".join(f'"{n}"' for n, _ in self.columns)
        parts = [f"SELECT {', '.join(f'{v} AS {chr(34)}{n}{chr(34)}' for v, (n, _) in zip(self._values(r, True), self.columns, strict=True))} FROM base WHERE {self._kept(i)}" for i, r in enumerate(self.rows)]
        return f"(WITH base AS MATERIALIZED (SELECT CAST({key} AS BIGINT) AS k, coalesce(nullif(regexp_extract({words}, '{_A_WORD}'), ''), 'word') AS w FROM {self.of}) SELECT {names} FROM (" + " UNION ALL ".join(parts) + "))"
