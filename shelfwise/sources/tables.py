"""A lazy, named set of tables: each one is defined when a query first asks for it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import DataFrame


class Tables(Mapping[str, DataFrame]):
    """``unique`` names the tables whose primary key is known to hold: every id is there, and only once.

    Questions that count distinct ids of such a table count its rows.
    """

    def __init__(self, makers: Mapping[str, Callable[["Tables"], DataFrame]], unique: Iterable[str] = ()):
        self._makers = dict(makers)
        self._made: dict[str, DataFrame] = {}
        self.unique = frozenset(unique)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name](self)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def replaced(self, **frames: DataFrame) -> "Tables":
        """The same tables with some swapped for other frames, of whose keys nothing is known; the others stay as they are."""
        makers = {name: lambda _tables, name=name: self[name] for name in self}
        makers.update({name: lambda _tables, frame=frame: frame for name, frame in frames.items()})
        return Tables(makers, self.unique - set(frames))

    def with_unique(self, names: Iterable[str]) -> "Tables":
        """The same tables, with the keys of some more known to hold."""
        return Tables({name: lambda _tables, name=name: self[name] for name in self}, self.unique | set(names))

    @classmethod
    def of(cls, **frames: DataFrame) -> "Tables":
        return cls({}).replaced(**frames)
