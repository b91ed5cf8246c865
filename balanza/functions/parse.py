"""Parsers for semi-structured text: marked blocks, fenced JSON, pay histories, captured parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from balanza.functions.dates import lookup
from balanza.rules.catalog import MOP_CODES

# Markers and separators of a key-value block.
BLOCK_START, BLOCK_END = "<<<TOON_START>>>", "<<<TOON_END>>>"
FIELD_MARK, ROW_MARK = "::", "|||"


def _after(text: Column, mark: str) -> Column:
    return F.substr(text, F.instr(text, F.lit(mark)) + len(mark))


def marked_block(text: Column) -> Column:
    """Text between the block markers, NULL without both."""
    inside = F.substring_index(_after(text, BLOCK_START), BLOCK_END, 1)
    return F.when(text.contains(BLOCK_START) & text.contains(BLOCK_END), F.trim(inside))


def _value(text: Column) -> Column:
    return F.when(~text.isin("NULL", ""), text)


def _last_wins(items: Column) -> Column:
    last = F.filter(items, lambda p, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def _block_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(marked_block(text), "\n"), lambda v: F.trim(v)), lambda v: v != "")


def _table_row(names: Column, row: Column) -> Column:
    cells = F.split(row, r"\|\|\|")
    width = F.least(F.size(names), F.size(cells))
    return F.transform(
        F.arrays_zip(F.slice(names, 1, width).alias("k"), F.slice(cells, 1, width).alias("v")),
        lambda p: F.struct(F.trim(p["k"]).alias("k"), _value(F.trim(p["v"])).alias("v")),
    )


def parse_blocks(text: Column) -> Column:
    """A marked block as array of maps: one of its ``key::value`` lines, or one for each row of a ``|||`` table."""
    lines = _block_lines(text)
    names = F.split(F.get(lines, F.lit(0)), r"\|\|\|")
    rows = F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda row: _last_wins(_table_row(names, row)))
    return F.when(F.get(lines, F.lit(0)).contains(ROW_MARK), rows).otherwise(F.array(parse_block(text)))


def parse_block(text: Column) -> Column:
    """A marked block as map: ``key::value`` lines, or the first row of a ``|||`` table (``parse_blocks`` has all).

    The last value of a repeated key wins; ``NULL`` and blank values are NULL.
    """
    lines = _block_lines(text)
    head, row = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    pairs = F.transform(
        F.filter(lines, lambda v: v.contains(FIELD_MARK)),
        lambda v: F.struct(
            F.trim(F.substring_index(v, FIELD_MARK, 1)).alias("k"), _value(F.trim(_after(v, FIELD_MARK))).alias("v")
        ),
    )
    table = _table_row(F.split(head, r"\|\|\|"), row)
    items = F.when(head.contains(FIELD_MARK) & ~head.contains(ROW_MARK), pairs).when(row.isNotNull(), table).otherwise(
        F.slice(pairs, 1, 0)
    )
    return _last_wins(items)


def fenced_object(text: Column) -> Column:
    """JSON object text inside a fence, or the text itself; NULL when it is not JSON."""
    inside = F.regexp_extract(text, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    body = F.when(inside != "", inside).otherwise(text)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def fenced_rows(text: Column) -> Column:
    """Movement rows in a model's answer, as array of structs with default category and upper kind."""
    answer = F.trim(F.substring_index(text, "</scratchpad>", -1))
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    bare = F.regexp_extract(answer, r"(?s)(\[.*\])", 1)
    body = F.when(fenced != "", fenced).when(bare != "", bare).otherwise(answer)
    schema = "array<struct<fecha:string,descripcion:string,monto:string,tipo:string,categoria:string>>"
    return F.transform(
        F.from_json(body, schema),
        lambda r: F.struct(
            r["fecha"].alias("posted"), r["descripcion"].alias("description"), r["monto"].alias("amount"),
            F.upper(F.coalesce(r["tipo"], F.lit("INDEFINIDO"))).alias("kind"),
            F.coalesce(r["categoria"], F.lit("GENERAL")).alias("category"),
        ),
    )


def mop_counts(history: Column) -> Column:
    """Counts per pay-history code; the two-letter code LC is counted first and taken out."""
    text = F.coalesce(history, F.lit(""))
    rest = F.replace(text, F.lit("LC"), F.lit(""))
    names = {"-": "mop_nd", "U": "mop_u"}
    return F.struct(
        *[
            (F.length(rest) - F.length(F.replace(rest, F.lit(code), F.lit("")))).alias(names.get(code, f"mop_{code}"))
            for code in MOP_CODES
        ],
        F.floor((F.length(text) - F.length(rest)) / 2).cast("int").alias("mop_lc"),
    )


# Which captured parts, from the front (0) or the back (-1), make up the description
# and the amount at each bank. ``...`` is the run of parts between the first and the last.
PART_ORDER = {
    "banorte": (..., -1), "afirme": (..., -1), "hsbc": (..., -1), "santander": (..., -1),
    "bbva": ((1, -1), -2), "multiva": ((1, 2, -1), -2), "intercam": ((1, 2, -1), -2),
    "banregio": ((1,), -1), "banamex": ((1,), -1), "citibanamex": ((1,), -1), "scotiabank": ((1,), -1),
    "mifel": ((2, -1, 1), -2), "banbajío": ((2, 1), -1),
    "azteca": ((1, -1), -2), "inbursa": ((1, -1), -2),
}


def assemble_parts(parts: Column, bank: Column) -> Column:
    """Description and amount of a movement from its captured parts, as struct."""
    def at(i):
        return F.try_element_at(parts, F.lit(i + 1 if i >= 0 else i))

    def text(order):
        if order is ...:
            return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), " ")
        return F.concat_ws(" ", *[at(i) for i in order])

    key = F.lower(bank)
    desc = amount = None
    for name, (order, where) in PART_ORDER.items():
        desc = F.when(key == name, text(order)) if desc is None else desc.when(key == name, text(order))
        amount = F.when(key == name, at(where)) if amount is None else amount.when(key == name, at(where))
    return F.struct(desc.otherwise(F.lit("")).alias("description"), amount.otherwise(F.lit("0.0")).alias("amount"))


def label_of(code: Column, table: dict[str, str]) -> Column:
    """Catalogue text of a code, or the code itself."""
    return F.coalesce(lookup(code, table), code)
