"""Financial-statement trees: flattened nodes, and account values picked by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from balanza.operators.ordered import position
from balanza.operators.ratios import ACCOUNTS

#: Levels that one pass reads.
PASS_DEPTH = 12


def flatten_tree(df: DataFrame, keys, tree: str = "tree", max_depth: int | None = None) -> DataFrame:
    """One row per node and year of VARIANT statement trees.

    Adds ``path`` (category names), ``place`` (child positions, which sort in document order),
    ``depth``, ``category``, ``year`` and ``amount``; a node without years keeps a row with NULL
    year. A pass reads PASS_DEPTH levels without a shuffle, and passes go on from the nodes with
    children until there are none. With ``max_depth`` there is one pass to that depth, and nodes that
    still have children are marked in ``has_more``.
    """
    def children(node: Column) -> Column:
        kids = F.try_variant_get(node, "$.children", "array<variant>")
        return F.coalesce(kids, F.array().cast("array<variant>"))

    def nodes(node: Column, level: int, last_level: int, depth: Column, path: Column, place: Column) -> Column:
        category = F.coalesce(F.try_variant_get(node, "$.category", "string"), F.lit(""))
        here = F.concat(path, F.array(category))
        last = level == last_level
        own = F.array(F.struct(
            here.alias("path"), place.alias("place"), (depth + level).alias("depth"), category.alias("category"), node.alias("node"),
            (F.size(children(node)) > 0 if last else F.lit(False)).alias("has_more"),
        ))
        if last:
            return own
        below = F.flatten(F.transform(children(node), lambda kid, i: nodes(kid, level + 1, last_level, depth, here, F.concat(place, F.array(i)))))
        return F.concat(own, below)

    def one_pass(rows: DataFrame, roots: Column, levels: int, depth: Column, path: Column, place: Column) -> DataFrame:
        found = F.flatten(F.transform(roots, lambda root, i: nodes(root, 0, levels, depth, path, F.concat(place, F.array(i)))))
        return rows.select(*keys, F.explode(found).alias("n"))

    roots = F.coalesce(
        F.try_variant_get(F.col(tree), "$.data", "array<variant>"), F.try_variant_get(F.col(tree), "$", "array<variant>"), F.array(F.col(tree))
    )
    keys = list(keys)
    levels = PASS_DEPTH if max_depth is None else max_depth
    flat = one_pass(df, roots, levels, F.lit(0), F.array().cast("array<string>"), F.array().cast("array<int>"))
    part = flat
    while max_depth is None and not (more := part.filter("n.has_more")).isEmpty():
        flat = flat.withColumn("n", F.col("n").withField("has_more", F.lit(False)))
        part = one_pass(more, children(F.col("n.node")), PASS_DEPTH, F.col("n.depth") + 1, F.col("n.path"), F.col("n.place"))
        flat = flat.unionByName(part)
    fields = F.coalesce(F.try_variant_get("n.node", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    years = F.map_filter(fields, lambda k, v: k.rlike(r"^\d{4}$"))
    return flat.select(
        *keys, "n.path", "n.place", "n.depth", "n.category", "n.has_more", F.explode_outer(years).alias("year", "_v")
    ).select(
        *keys, "path", "place", "depth", "category", "has_more", F.col("year").cast("int").alias("year"),
        F.when(F.col("year").isNotNull(), F.coalesce(
            F.try_variant_get("_v", "$", "double"), F.try_variant_get("_v", "$.Total", "double"), F.try_variant_get("_v", "$.total", "double"), F.lit(0.0)
        )).alias("amount"),
    )


def tree_matrix(trees: dict[str, DataFrame], years, keys=("taxpayer",)) -> DataFrame:
    """Statements side by side: (keys, row_no) and for each name of ``trees`` its label and an amount for each year.

    The frames are what ``flatten_tree`` gives. Each statement is listed in document order from row 1, a node's label
    is indented by four blanks for each named node above it, and nodes without a name have no row. Years that a node
    lacks are 0; where one statement is shorter its cells are NULL. ``years`` are the columns, in their order.
    """
    keys = list(keys)
    rows = None
    for name, flat in trees.items():
        depth = F.size(F.filter("path", lambda c: c != "")) - 1
        amounts = [F.coalesce(F.max(F.when(F.col("year") == y, F.col("amount"))), F.lit(0.0)).alias(f"y{y}") for y in years]
        nodes = flat.filter("category <> ''").groupBy(*keys, "place", F.concat(F.repeat(F.lit("    "), depth), "category").alias("label")).agg(*amounts)
        placed = position(nodes, keys, ["place"], F.slice("place", 1, 2), "row_no").withColumn("_tree", F.lit(name))
        rows = placed if rows is None else rows.unionByName(placed)
    cells = [
        F.max(F.when(F.col("_tree") == name, F.col(c))).alias(f"{name}_{c}") for name in trees for c in ("label", *(f"y{y}" for y in years))
    ]
    return rows.groupBy(*keys, "row_no").agg(*cells)


def name_matches(category: Column, names) -> Column:
    """Exact account name, or a name inside a category shorter than 2.5 times the name."""
    text = F.lower(F.trim(category))
    wanted = [n.lower().strip() for n in names]
    hit = text.isin(*wanted)
    for n in wanted:
        hit = hit | (text.contains(n) & (F.length(text) < len(n) * 2.5))
    return hit


def account_values(flat: DataFrame, keys=("taxpayer",), accounts=ACCOUNTS) -> DataFrame:
    """Amount per account and year: the first value that is not 0, in document order, over the
    nodes whose name matches; 0 when all are 0."""
    keys = list(keys)
    names = F.array_compact(F.array(*[
        F.when((F.col("statement") == statement) & name_matches(F.col("category"), wanted), F.lit(account))
        for account, (statement, wanted) in accounts.items()
    ]))
    hits = flat.filter(F.col("year").isNotNull()).select(*keys, "year", "amount", "place", F.explode(names).alias("account"))
    order = F.struct((F.col("amount") == 0).alias("zero"), F.col("place"))
    return hits.groupBy(*keys, "year", "account").agg(F.min_by("amount", order).alias("amount"))
