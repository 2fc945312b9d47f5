"""The Puppy and Host fixture: 20 and 3 rows, generated with a fixed seed."""

from __future__ import annotations

import random

from millrace import Catalog, FieldDef, TableDef
from millrace.functions.types import FieldType as T
from millrace.sources.catalog import IndexDef

PUPPY = TableDef(
    "Puppy",
    (
        FieldDef("name", T.STRING, min="", max="zzz"),
        FieldDef("age", T.INT, min=0, max=9, enforced=True),
        FieldDef("id", T.LONGINT, min=0, max=19),
        FieldDef("weight", T.DOUBLE, min=0.5, max=2.0),
        FieldDef("adult", T.BOOL),
        FieldDef("signature", T.CHARARRAY, size=3),
        FieldDef("host_id", T.LONGINT),
        FieldDef("grade", T.CHAR),
    ),
    IndexDef(("id",)),
    (IndexDef(("name",)), IndexDef(("age",))),
)
HOST = TableDef("Host", (FieldDef("id", T.LONGINT), FieldDef("name", T.STRING)), IndexDef(("id",)))


def catalog() -> Catalog:
    own = Catalog("pets")
    own.add(PUPPY)
    own.add(HOST)
    return own


def rows() -> tuple[list[tuple], list[tuple]]:
    r = random.Random(7)
    word = lambda low, high: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(low, high)))
    puppies = [(word(0, 3), r.randrange(10), i, 0.5 + 1.5 * r.random(), r.random() < 0.5, word(1, 3), r.randrange(3), r.choice("abc")) for i in range(20)]
    hosts = [(0, word(1, 4)), (1, "hy"), (2, word(1, 4))]
    return puppies, hosts
