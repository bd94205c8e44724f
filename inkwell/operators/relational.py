"""Predicates, data scope, paging, upserts, bulk import and trees of the admin back office."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import checkpointed

MAX_PAGE, MAX_ORDER = 100, 500
# What a free-form condition may not hold.
SQL_KEYWORDS = (
    "\u000B", "%0A", "and ", "extractvalue", "updatexml", "sleep", "information_schema", "exec ", "insert ", "select ",
    "delete ", "update ", "drop ", "count ", "chr ", "mid ", "master ", "truncate ", "char ", "declare ", "or ", "union ",
    "like ", "+", "/*", "user()",
)


# -- predicates


def all_of(*conditions: Column | None) -> Column:
    """The conditions that are given, joined by AND; true if none is."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def given(value: object, condition) -> Column | None:
    """``condition(value)`` if a value is given; blank strings and empty lists count as not given."""
    if value is None or (isinstance(value, str) and not value.strip()) or (isinstance(value, (list, tuple)) and not value):
        return None
    return condition(value)


def like(column: Column, part: str) -> Column:
    """Substring match in which ``%`` and ``_`` of the part stay wildcards."""
    return column.like(f"%{part}%")


def on_days(column: Column, first: str | None, last: str | None) -> Column:
    """From the start of the first day to the end of the last, as a range that scans can prune by."""
    return all_of(
        given(first, lambda d: column >= F.to_date(F.lit(d))), given(last, lambda d: column < F.date_add(F.to_date(F.lit(d)), 1))
    )


def below(ancestors: Column, node: Column | int) -> Column:
    """Whether a node is among a comma-separated list of ancestors."""
    node = F.lit(node) if isinstance(node, int) else node
    return F.find_in_set(node.cast("string"), ancestors) > 0


def data_scope(
    rows: DataFrame, dept: str, user: str, roles: list[dict], me: int, my_dept: int, depts: DataFrame, admin: bool = False
) -> DataFrame:
    """Rows that the roles of a user may see.

    Role scopes: 1 all, 2 the role's own list of departments, 3 the user's department, 4 that and its
    descendants, 5 the user's own rows.  Disabled roles don't count; scopes are joined by OR; without
    any the result is empty.  depts: dept_id, ancestors.
    """
    if admin or any(r["scope"] == 1 for r in roles if r.get("enabled", True)):
        return rows
    allowed: list[Column] = []
    for role in roles:
        if not role.get("enabled", True):
            continue
        if role["scope"] == 2 and role.get("depts"):
            allowed.append(F.col(dept).isin(role["depts"]))
        elif role["scope"] == 3:
            allowed.append(F.col(dept) == my_dept)
        elif role["scope"] == 4:
            allowed.append(F.col("__sub").isNotNull())
        elif role["scope"] == 5:
            allowed.append(F.col(user) == me)
    if not allowed:
        return rows.where(F.lit(False))
    subtree = depts.where((F.col("dept_id") == my_dept) | below(F.col("ancestors"), my_dept)).select(F.col("dept_id").alias("__sub"))
    seen = rows.join(subtree.distinct(), F.col(dept) == F.col("__sub"), "left")
    return seen.where(reduce(lambda a, b: a | b, allowed)).drop("__sub")


def check_order(clause: str, columns: list[str]) -> list[Column]:
    """An ORDER BY clause of known columns as sort columns; anything else is refused."""
    if len(clause) > MAX_ORDER or not re.fullmatch(r"[a-zA-Z0-9_ ,.]+", clause):
        raise ValueError("not an order clause")
    out = []
    for part in clause.split(","):
        name, _, way = part.strip().partition(" ")
        name = re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower() if name not in columns else name
        if name not in columns or way.strip().lower() not in ("", "asc", "desc"):
            raise ValueError(f"can't order by {part.strip()!r}")
        out.append(F.desc(name) if way.strip().lower() == "desc" else F.asc(name))
    return out


def check_condition(text: str) -> str:
    """The text, unless it holds a keyword in any case: one that ends in a space as a word before white space, any other
    one wherever it stands once white space is left out."""
    plain = re.sub(r"\s", "", text).lower()
    for word in SQL_KEYWORDS:
        if re.search(rf"(?i)(^|\W){word.strip()}\s", text) if word.endswith(" ") else word.lower() in plain:
            raise ValueError(f"{word!r} isn't allowed here")
    return text


def holds_keyword(text: Column) -> Column:
    """Whether ``check_condition`` refuses a text."""
    plain = F.lower(F.regexp_replace(text, r"[\p{Z}\s]", ""))
    words = "|".join(w.strip() for w in SQL_KEYWORDS if w.endswith(" "))
    marks = [plain.contains(w.lower()) for w in SQL_KEYWORDS if not w.endswith(" ")]
    return reduce(lambda a, b: a | b, marks, text.rlike(rf"(?i)(^|\W)({words})\s"))


#: Characters of the longest gram that words are found by, and words of one gram that a copy of its texts meets.
GRAM, GRAM_WORDS = 3, 1024


def _grams(text: str, sizes: list[int]) -> Column:
    """The distinct runs of characters of these sizes."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n)))
    return F.array_distinct(F.concat(*[F.when(F.length(text) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in sizes]))


def gram_candidates(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """Rows of texts and words that share the word's rarest gram among the texts; all columns of both.

    A word's grams are its runs of ``GRAM`` characters (all of it, if it is shorter).  They are counted over the texts;
    texts are listed only under grams that some word is keyed by, and where many words share one these are
    dealt out and meet copies of its texts, so that no gram is one task's work.
    """
    texts, words = texts.where(F.length(text) > 0), words.where(F.length(word) > 0)
    asked = words.select(F.col(word).alias("__w")).distinct()
    size = F.least(F.lit(GRAM), F.length("__w"))
    asked = asked.select("__w", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("__w") - size + 1), lambda i: F.substring(F.col("__w"), i, size)))).alias("__gram"))
    asked = checkpointed(asked)
    listed = texts.withColumn("__gram", F.explode(_grams(text, list(range(1, GRAM + 1)))))
    known = asked.select("__gram").distinct()
    counts = listed.select("__gram").join(known, "__gram", "left_semi").groupBy("__gram").agg(F.count("*").alias("__df"))
    keyed = asked.join(counts, "__gram").groupBy("__w").agg(F.min(F.struct("__df", "__gram")).alias("k"), F.count("*").alias("met"))
    # A word of which some gram is in no text is in none.
    many = asked.groupBy("__w").agg(F.count("*").alias("grams"))
    keyed = checkpointed(keyed.join(many, "__w").where("met = grams").select("__w", F.col("k.__gram").alias("__gram")))
    shares = keyed.groupBy("__gram").agg((F.floor((F.count("*") - 1) / GRAM_WORDS) + 1).cast("int").alias("__shares"))
    shares = checkpointed(shares)
    dealt = listed.join(shares, "__gram").withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))).drop("__shares")
    share = F.pmod(F.hash("__w"), F.col("__shares"))
    found = words.join(keyed, F.col(word) == F.col("__w")).join(shares, "__gram").withColumn("__share", share).drop("__shares", "__w")
    return dealt.join(found, ["__gram", "__share"]).drop("__gram", "__share")


def containing(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """Pairs of rows whose text holds the word (none empty), found by the word's rarest gram (see ``gram_candidates``)."""
    return gram_candidates(texts, text, words, word).where(F.col(text).contains(F.col(word)))


# -- paging


def page(df: DataFrame, order: list[Column], number: int, size: int, reasonable: bool = False) -> tuple[DataFrame, int]:
    """Rows of one page under a total order, and the count of all rows.

    The size is held within 1 to 100, the number at 1 at least and, if ``reasonable``, at the last
    page at most.
    """
    size, total = max(1, min(size, MAX_PAGE)), df.count()
    number = max(1, number)
    if reasonable:
        number = min(number, max(1, -(-total // size)))
    return df.orderBy(*order).offset((number - 1) * size).limit(size), total


# -- mutations: each returns the new state of a table


def upsert(old: DataFrame, new: DataFrame, key: list[str], update: list[str] | None = None, insert: bool = True) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; only the columns of ``update`` (else all) replace old values.

    A key may occur once in ``new``.  ``insert=False`` leaves rows out whose key is new.
    """
    update = [c for c in old.columns if c not in key] if update is None else update
    right = new.select(*[F.col(c).alias(f"__new_{c}") for c in old.columns], F.lit(True).alias("__is_new"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__new_{k}")) for k in key])
    there = F.lit(True).alias("__is_old")
    both = old.select("*", there).join(right, same, "full_outer" if insert else "left")
    isnew, isold = F.col("__is_new").isNotNull(), F.col("__is_old").isNotNull()
    out = []
    for c in old.columns:
        replaces = ~isold | (isnew & F.lit(c in update))
        out.append(F.when(replaces, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old, key, "left_anti"))


def patch(old: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the non-null values of ``changes`` in the columns that it has."""
    named = [c for c in changes.columns if c not in key]
    right = changes.select(*key, *[F.col(c).alias(f"__new_{c}") for c in named])
    joined = old.join(right, key, "left")
    return joined.select(*[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in named else F.col(c) for c in old.columns])


def remove(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return old.join(keys, key, "left_anti")


def stale(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only ``old`` has; new children count as well as new parents."""
    return old.select(*key).distinct().join(new.select(*key).distinct(), key, "left_anti")


def classify_import(rows: DataFrame, known: DataFrame, key: str, update_allowed: bool) -> DataFrame:
    """rows with their action: insert (new key), update (known key, if allowed) or reject."""
    marked = known.select(F.col(key).alias("__known")).distinct()
    joined = rows.join(marked, F.col(key) == F.col("__known"), "left")
    action = F.when(F.col("__known").isNull(), "insert").when(F.lit(update_allowed), "update").otherwise("reject")
    return joined.withColumn("action", action).drop("__known")


def three_way_sync(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """All keys of both tables with action insert, update or delete; updates keep the old values of ``keep``."""
    left, right = old.withColumn("__o", F.lit(1)).alias("o"), new.withColumn("__n", F.lit(1)).alias("n")
    both = left.join(right, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    action = F.when(F.col("n.__n").isNull(), "delete").when(F.col("o.__o").isNull(), "insert").otherwise("update")
    columns = [
        (F.coalesce(f"o.{c}", f"n.{c}") if c in keep or c == key else F.coalesce(f"n.{c}", f"o.{c}")).alias(c) for c in old.columns
    ]
    return both.select(*columns, action.alias("action"))


# -- trees


def levels(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, root, depth, path of a forest of any depth; roots are nodes whose parent isn't a node.

    One join for each level of the tree, and none of them gathers a level.  Nodes of a cycle that no root reaches have
    no root and no row; a cycle that one does reach (a node with several parents) is an error.
    """
    plain = checkpointed(nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent")))
    most = plain.select("node").distinct().count()
    roots = plain.join(plain.select(F.col("node").alias("parent")), "parent", "left_anti")
    level = roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.col("node").cast("string").alias("path"))
    found, depth = level, 0
    while not level.isEmpty():
        depth += 1
        if depth > most:
            raise ValueError("the tree has a cycle")
        level = checkpointed(
            plain.join(level.select(F.col("node").alias("parent"), "root", "path"), "parent").select(
                "node", "root", F.lit(depth).alias("depth"), F.concat_ws("/", "path", F.col("node").cast("string")).alias("path")
            )
        )
        found = found.union(level)
    return found


def move_subtree(nodes: DataFrame, moved: int, new_ancestors: str, old_ancestors: str) -> DataFrame:
    """nodes (id, ancestors) after a node went elsewhere: the prefix of its own and its descendants' paths changes."""
    under = (F.col("id") == moved) | below(F.col("ancestors"), moved)
    rest = F.expr(f"substring(ancestors, {len(old_ancestors) + 1})")
    return nodes.withColumn("ancestors", F.when(under, F.concat(F.lit(new_ancestors), rest)).otherwise(F.col("ancestors")))


def to_list(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row for each group with the ordered list of its values, joined by commas."""
    items = F.array_sort(F.collect_list(F.struct(*order, *[F.col(v).alias(f"v_{v}") for v in values])))

    def listed(v: str) -> Column:
        return F.array_join(F.transform(items, lambda x: x[f"v_{v}"].cast("string")), ",").alias(v)

    return rows.groupBy(*by).agg(*map(listed, values))


# -- logs and sessions


def sessions(rows: DataFrame, key: str, prefix: str, ip: str | None = None, user: str | None = None) -> DataFrame:
    """Rows whose key has the prefix, of an address and of a user if these are given, last key first."""
    fits = all_of(given(ip, lambda v: F.col("ip") == v), given(user, lambda v: F.col("user_name") == v))
    return rows.where(F.col(key).startswith(prefix) & fits).orderBy(F.desc(key))


def job_log(runs: DataFrame, most: int = 2000) -> DataFrame:
    """job, started, ended, millis, status ('0' fine, '1' failed), message and error, cut to ``most`` characters, of runs
    (job, started, ended, error)."""
    millis = F.unix_millis(F.col("ended").cast("timestamp")) - F.unix_millis(F.col("started").cast("timestamp"))
    return runs.select(
        "job", "started", "ended", millis.alias("millis"), F.when(F.col("error").isNull(), "0").otherwise("1").alias("status"),
        F.concat("job", F.lit(": "), millis.cast("string"), F.lit(" ms")).alias("message"), F.substring("error", 1, most).alias("error"),
    )
