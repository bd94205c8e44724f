"""Types: those of Spark for the types that a relational database declares."""

from __future__ import annotations

import re

# Names of declared types by kind.
TIMES = "datetime time date timestamp".split()
NUMBERS = "tinyint smallint mediumint int number integer bigint float double decimal".split()


def spark_type(declared: str) -> str:
    """``varchar(20)`` -> string, ``datetime`` -> timestamp, ``int(10)`` -> int, ``bigint(20)``, ``int`` -> bigint,
    ``decimal(12,2)`` -> decimal(12,2).

    Whole numbers of at most ten digits are int; numbers without a stated size, floats too, are bigint, as are those of
    scale 0.  Decimals are kept to the 38 digits that Spark has.  What isn't known is a string.
    """
    name, _, inside = declared.strip().lower().partition("(")
    sizes = [int(x) for x in re.findall(r"\d+", inside.partition(")")[0])]
    if name in TIMES:
        return "timestamp"
    if name not in NUMBERS:
        return "string"
    if len(sizes) == 2 and sizes[1] > 0:
        return f"decimal({min(sizes[0], 38)},{min(sizes[1], 38)})"
    return "int" if len(sizes) == 1 and sizes[0] <= 10 else "bigint"
