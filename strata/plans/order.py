"""The order of a sequence, carried beside a DataFrame instead of sorting it.

Keys are hidden columns with a direction. The explicit keys are what order_by and then_by gave, the tie-breakers the
order from before; together they are total if the source's key is unique. A sort only happens where an operator
consumes the order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = "__o"


@dataclass(frozen=True)
class Key:
    name: str
    ascending: bool = True

    def flipped(self) -> Key:
        return Key(self.name, not self.ascending)

    def column(self) -> Column:
        """Ascending with nulls first or descending with nulls last."""
        return F.col(self.name).asc_nulls_first() if self.ascending else F.col(self.name).desc_nulls_last()


@dataclass(frozen=True)
class Order:
    explicit: tuple[Key, ...] = ()
    ties: tuple[Key, ...] = ()

    @property
    def keys(self) -> tuple[Key, ...]:
        return self.explicit + self.ties

    def sorted_by(self, key: Key) -> Order:
        """A stable sort: the whole order so far breaks ties."""
        return Order((key,), self.keys)

    def then(self, key: Key) -> Order:
        return Order((*self.explicit, key), self.ties)

    def reversed(self) -> Order:
        """All keys flip, ties too: the sequence read backwards."""
        return Order((), tuple(k.flipped() for k in self.keys))

    def settled(self) -> Order:
        """The same order without keys that then_by could go on from."""
        return Order((), self.keys)

    def columns(self) -> list[Column]:
        return [k.column() for k in self.keys]

    def names(self) -> list[str]:
        return list(dict.fromkeys(k.name for k in self.keys))
