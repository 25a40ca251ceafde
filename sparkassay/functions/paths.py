"""Features of a table: leaves of its schema as paths, with the column expressions that read them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, FLOAT, STRING, BYTES, STRUCT = "INT", "FLOAT", "STRING", "BYTES", "STRUCT"
_PLAIN = re.compile(r"(\([^()]*\))|([^().']+)")


def serialize(steps: tuple[str, ...]) -> str:
    """Steps joined by dots; a step with dots, quotes or parentheses is quoted, quotes inside doubled."""
    return ".".join(s if _PLAIN.fullmatch(s) else "'" + s.replace("'", "''") + "'" for s in steps)


def parse(path: str) -> tuple[str, ...]:
    """The inverse of :func:`serialize`."""
    steps, at = [], 0
    while at <= len(path):
        if path[at : at + 1] == "'":
            end = at + 1
            while path[end : end + 1] != "'" or path[end + 1 : end + 2] == "'":
                end += 2 if path[end : end + 2] == "''" else 1
                if end > len(path):
                    raise ValueError(f"unbalanced quote in {path!r}")
            steps.append(path[at + 1 : end].replace("''", "'"))
            at = end + 2
        else:
            end = path.find(".", at)
            end = len(path) if end < 0 else end
            steps.append(path[at:end])
            at = end + 1
    return tuple(steps)


def stat_type(kind: T.DataType) -> str | None:
    """The statistics type of a leaf; None for types without one."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return INT  # booleans count as 0 and 1; dates and times, an extension, as days and microseconds
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(kind, (T.StringType, T.BinaryType, T.NullType)):
        return STRING
    return None


def numeric(value: Column, kind: T.DataType) -> Column:
    """A leaf value as long or double."""
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp"))
    return value.cast("double" if stat_type(kind) == FLOAT else "long")


@dataclass(frozen=True)
class Feature:
    """One leaf or struct. ``read`` gives its cell; under an array of structs, ``cells`` is the array of its cells in a row."""

    steps: tuple[str, ...]
    type: str
    leaf: T.DataType
    nest: int  # list levels of a cell
    boolean: bool
    read: Column
    repeated: bool  # read gives an array of cells

    @property
    def path(self) -> str:
        return serialize(self.steps)

    @property
    def scalar(self) -> bool:
        return self.nest == 0 and not self.repeated

    def values(self) -> Column:
        """All leaf values of a row in one array; null if there is no cell."""
        if self.scalar:
            return F.when(self.read.isNotNull(), F.array(self.read))
        out = self.read
        for _ in range(self.nest - 1 + self.repeated):
            out = F.flatten(F.filter(out, lambda x: x.isNotNull()))
        return out

    def sizes(self) -> Column:
        """The number of values of a row's cell: null if missing, for nested lists the innermost number."""
        if self.scalar:
            return F.when(self.read.isNotNull(), F.lit(1)).cast("long")
        if self.repeated:
            raise ValueError("a row has several cells")
        if self.nest == 1:
            return F.when(self.read.isNotNull(), F.size(self.read)).cast("long")
        inner = self.read
        for _ in range(self.nest - 2):
            inner = F.flatten(F.filter(inner, lambda x: x.isNotNull()))
        # an inner null list has no values
        return F.when(self.read.isNotNull(), F.aggregate(inner, F.lit(0), lambda a, x: a + F.when(x.isNull(), 0).otherwise(F.size(x)))).cast("long")


def _each(structs: Column, name: str) -> Column:
    return F.transform(structs, lambda x: x.getField(name))


def features(schema: T.StructType, prefix: tuple[str, ...] = (), read: Column | None = None, repeated: bool = False) -> list[Feature]:
    """Structs before their children, in the schema's order. Types without statistics raise TypeError."""
    out: list[Feature] = []
    for field in schema.fields:
        steps = (*prefix, field.name)
        name = field.name.replace("`", "``")
        if read is None:
            col = F.col(f"`{name}`")
        elif repeated:
            col = _each(read, field.name)
        else:
            col = read.getField(field.name)
        kind, nest = field.dataType, 0
        while isinstance(kind, T.ArrayType):
            kind, nest = kind.elementType, nest + 1
        if isinstance(kind, T.MapType):
            raise TypeError(f"{serialize(steps)}: maps have no statistics; turn them into entries first")
        if isinstance(kind, T.StructType):
            out.append(Feature(steps, STRUCT, kind, nest, False, col, repeated))
            inner = col
            for _ in range(nest + repeated - 1):
                inner = F.flatten(F.filter(inner, lambda x: x.isNotNull()))
            out += features(kind, steps, inner, repeated or nest > 0)
            continue
        if stat_type(kind) is None:
            raise TypeError(f"{serialize(steps)}: {kind.simpleString()} has no statistics")
        out.append(Feature(steps, stat_type(kind), kind, nest, isinstance(kind, T.BooleanType), col, repeated))
    return out
