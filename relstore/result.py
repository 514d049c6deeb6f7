"""Results of statements, what they cost, and their text form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame

NONE, HEAP_SCAN, KEY_LOOKUP = "None", "HeapScan", "PrimaryKeyLookup"


@dataclass(frozen=True)
class Stats:
    access_path: str = NONE
    rows_examined: int = 0
    rows_returned: int = 0
    index_lookups: int = 0


@dataclass(frozen=True)
class CommandResult:
    command: str  # CREATE TABLE, INSERT, UPDATE, DELETE, BEGIN, COMMIT or ROLLBACK
    affected_rows: int = 0
    stats: Stats = field(default_factory=Stats)
    rid: int | None = None


class SelectResult:
    """columns and a lazy DataFrame (df). rows and stats run it, or `near` where its rows can be read without a job; its files stay whatever is changed later."""

    def __init__(
        self,
        columns: list[str],
        types: list[str],
        plan: Callable[[], DataFrame],
        examined: Callable[[], tuple[str, int, int]],
        near: Callable[[], list[tuple]] | None = None,
    ):
        self.columns, self.types, self._plan, self._examined, self._near = columns, types, plan, examined, near
        self._rows: list[tuple] | None = None
        self._stats: Stats | None = None

    @cached_property
    def df(self) -> DataFrame:
        return self._plan()

    def rows(self) -> list[tuple]:
        if self._rows is None:
            self._rows = self._near() if self._near else [tuple(r) for r in self.df.collect()]
        return self._rows

    def first_rows(self, n: int) -> list[tuple]:
        return self.rows()[:n] if self._near or self._rows is not None else [tuple(r) for r in self.df.limit(n).collect()]

    @property
    def stats(self) -> Stats:
        if self._stats is None:
            path, examined, lookups = self._examined()
            if self._near:
                self.rows()
            self._stats = Stats(path, examined, len(self._rows) if self._rows is not None else self.df.count(), lookups)
        return self._stats


def cell(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def table_text(columns: list[str], rows: list[tuple]) -> str:
    cells = []
    for r in rows:
        if len(r) != len(columns):
            raise ValueError("a row's width disagrees with its columns")
        cells.append([cell(v) for v in r])
    # Widths count bytes, as lengths do elsewhere in the dialect.
    size = lambda x: len(x.encode("utf-8", "surrogatepass"))
    widths = [max([size(c), *(size(r[i]) for r in cells)]) for i, c in enumerate(columns)]
    line = lambda r: " | ".join(x + " " * (w - size(x)) for x, w in zip(r, widths, strict=True))
    out = [line(columns), "-+-".join("-" * w for w in widths), *map(line, cells)]
    return "\n".join(out) + f"\n{plural(len(rows))}\n"


def plural(n: int) -> str:
    return f"{n} row" + ("" if n == 1 else "s")


def format_result(result: CommandResult | SelectResult, with_stats: bool = False) -> str:
    if isinstance(result, CommandResult):
        done = f"{plural(result.affected_rows)} affected" if result.command in ("INSERT", "UPDATE", "DELETE") else "OK"
        out = f"{result.command}\n{done}\n"
    else:
        out = table_text(result.columns, result.rows())
    if with_stats:
        s = result.stats
        out += f"access: {s.access_path}\nrows examined: {s.rows_examined}\nrows returned: {s.rows_returned}\nindex lookups: {s.index_lookups}\n"
    return out
