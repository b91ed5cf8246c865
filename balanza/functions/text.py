"""Text columns: folding, masking, name cleanup, small parsers."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from balanza.functions.plan import let


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition to ASCII, split by the length of the result.

    Characters that fold to one ASCII character go through ``translate``; the few that fold to
    several (ligatures, fractions, ellipsis) go through a second table.
    """
    src, dst, wide = [], [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7B0 or 0x3400 <= code < 0xA000 or code >= 0x20000:
            continue  # surrogates, syllables and ideographs have no ASCII form
        char = chr(code)
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            src.append(char)
            dst.append(folded)
        elif len(folded) > 1:
            wide[char] = folded
    return "".join(src), "".join(dst), wide


# Letters and signs that make up nearly all non-ASCII text in statements. They are replaced one by
# one, which is far cheaper per character than a translate table.
_COMMON = "áàâäãåéèêëíìîïóòôöõúùûüñçýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝºªß¿¡–—‘’“”€°"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def to_ascii(text: Column, lowered: bool = False) -> Column:
    """ASCII form of a text; what has no ASCII form is dropped.

    ASCII text passes as it is, then the common letters are replaced, and only what still is not
    ASCII goes through the full tables.
    """
    common = text
    for char in _COMMON:
        if not lowered or char == char.lower():
            common = F.replace(common, F.lit(char), F.lit(fold_literal(char)))
    return F.when(is_ascii(text), text).otherwise(
        once(common, lambda t: F.when(is_ascii(t), t).otherwise(_full_ascii(t)))
    )


def _full_ascii(text: Column) -> Column:
    src, dst, wide = _fold_tables()
    single = F.translate(text, src, dst)
    table = F.map_from_arrays(F.array(*[F.lit(k) for k in wide]), F.array(*[F.lit(v) for v in wide.values()]))
    spread = F.array_join(F.transform(F.split(single, ""), lambda c: F.coalesce(table[c], c)), "")
    widened = F.when(single.rlike("[" + "".join(wide) + "]"), spread).otherwise(single)
    return F.regexp_replace(widened, r"[^\x00-\x7F]", "")


def fold_text(text: Column) -> Column:
    """Lower case, ASCII, blanks collapsed."""
    return F.trim(F.regexp_replace(to_ascii(F.lower(F.coalesce(text, F.lit(""))), lowered=True), r"\s+", " "))


def fold_literal(word: str) -> str:
    """ASCII form of a rule's own text."""
    return unicodedata.normalize("NFKD", word).encode("ascii", "ignore").decode()


def fold_plain(text: Column) -> Column:
    """As :func:`fold_text` with punctuation removed as well."""
    return F.trim(F.regexp_replace(F.regexp_replace(to_ascii(F.lower(text), lowered=True), r"[^\w\s]", ""), r"\s+", " "))


def squeeze_blanks(text: Column) -> Column:
    """Runs of blanks and tabs become one blank; line breaks stay."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t]{2,}", " "))


def mask_digits(text: Column) -> Column:
    """Runs of four or more digits become ``****``."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\d{4,}", "****")


# Legal suffixes removed from company names, in order.
COMPANY_SUFFIXES = (
    r"\bs\.a\. de c\.v\.\b", r"\bsa de cv\b", r"\bs\.a\.\b", r"\bs a\b",
    r"\bs\.a\.p\.i\. de c\.v\.\b", r"\bsapi de cv\b", r"\bsapi\b",
    r"\bs\. de r\.l\. de c\.v\.\b", r"\bs de rl de cv\b", r"\bs de rl\b", r"\bs\. de r\.l\.\b",
    r"\bc\.v\.\b", r"\bcv\b", r"\bde c\.v\.\b", r"\bde cv\b",
)
UNKNOWN_NAMES = ("n/a", "desc.", "desconocido", "")


def clean_company(name: Column, strip_dotted: bool = False) -> Column:
    """Company name without legal suffix, accents or punctuation; '' for unknown markers.

    The dotted suffix patterns need a word character after their last dot, so ``S.A. DE C.V.``
    survives them; ``strip_dotted`` removes dotted forms too.
    """
    low = F.lower(F.coalesce(name, F.lit("")))
    out = to_ascii(low, lowered=True)
    if strip_dotted:
        out = F.regexp_replace(out, r"(?<=\b\w)\.", "")
    for suffix in COMPANY_SUFFIXES:
        out = F.regexp_replace(out, suffix, "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\w\s]", ""), r"\s+", " "))
    return F.when(low.isin(*UNKNOWN_NAMES), F.lit("")).otherwise(out)


# Texts that stand for a missing value.
SENTINELS = ("null", "none", "n/a", "")


def null_if_sentinel(text: Column) -> Column:
    clean = F.trim(text)
    return F.when(~F.lower(clean).isin(*SENTINELS), clean)


def keyword_hit(text: Column, keywords, plain: bool = True) -> Column:
    """True when any keyword occurs in the text.

    Keywords that contain another keyword of the list add nothing to an any-match and are left
    out, as are (for ASCII-folded text) those with accents, which cannot occur in it.
    """
    words = [k for k in dict.fromkeys(keywords) if not plain or k.isascii()]
    words = [k for k in words if not any(o != k and o in k for o in words)]
    if not words:
        return F.lit(False)
    hit = text.contains(words[0])
    for word in words[1:]:
        hit = hit | text.contains(word)
    return hit


def any_of(words) -> str:
    """A literal alternation for ``rlike``."""
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def first_captured(text: Column, patterns) -> Column:
    """First non-empty group 1 over patterns tried in order."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def clean_for_export(text: Column) -> Column:
    """Control characters out, then blanks and line breaks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), r"\s+", " "))


def parse_kv_lines(text: Column) -> Column:
    """``key::value`` lines as a map; keys lower-cased, the last value of a key wins."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.contains("::"))
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            F.lower(F.trim(F.substring_index(line, "::", 1))).alias("key"),
            F.trim(F.substr(line, F.instr(line, F.lit("::")) + 2)).alias("value"),
        ),
    )
    last = F.filter(
        pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])
    )
    return F.map_from_entries(last)


def matching_ratio(a: Column, b: Column) -> Column:
    """Similarity of two short texts by matching blocks: twice the characters in blocks over those of both texts.

    The longest common block is taken first, the earliest in ``a`` and then in ``b`` among equals, then the same to the left
    and to the right of it. Two empty texts are equal. Work grows with the product of the lengths.
    """
    region = "array<struct<a0:int,a1:int,b0:int,b1:int>>"

    def span(*ends) -> Column:
        return F.struct(*[e.cast("int").alias(n) for n, e in zip(("a0", "a1", "b0", "b1"), ends, strict=True)])

    def longest(x: Column, y: Column, r: Column) -> Column:
        """(n, i, j) of the longest block in a region, from runs of matches that end in each row."""
        none = F.struct(F.lit(0).alias("n"), r["a0"].alias("i"), r["b0"].alias("j"))
        start = F.struct(F.array_repeat(F.lit(0), r["b1"] - r["b0"]).alias("row"), none.alias("best"))

        def row(s: Column, i: Column) -> Column:
            runs = F.transform(F.sequence(r["b0"], r["b1"] - 1), lambda j, k: F.when(F.get(x, i) == F.get(y, j), F.coalesce(F.get(s["row"], k - 1), F.lit(0)) + 1).otherwise(0))
            return let(runs, lambda now: let(F.array_max(now), lambda top: F.struct(
                now.alias("row"),
                F.when(top > s["best"]["n"], F.struct(top.alias("n"), (i - top + 1).alias("i"), (r["b0"] + F.array_position(now, top).cast("int") - top).alias("j"))).otherwise(s["best"]).alias("best"),
            )))

        return F.aggregate(F.sequence(r["a0"], r["a1"] - 1), start, row)["best"]

    def matched(x: Column, y: Column) -> Column:
        whole = span(F.lit(0), F.size(x), F.lit(0), F.size(y))
        start = F.struct(F.lit(0).alias("sum"), F.array(whole).cast(region).alias("open"))

        def step(s: Column, _: Column) -> Column:
            def split(r: Column) -> Column:
                return let(longest(x, y, r), lambda m: let(F.array(
                    span(r["a0"], m["i"], r["b0"], m["j"]), span(m["i"] + m["n"], r["a1"], m["j"] + m["n"], r["b1"])
                ), lambda two: F.struct(
                    (s["sum"] + m["n"]).alias("sum"),
                    F.concat(F.slice(s["open"], 2, F.size(s["open"])), F.when(m["n"] > 0, F.filter(two, lambda t: (t["a1"] > t["a0"]) & (t["b1"] > t["b0"]))).otherwise(F.array().cast(region))).alias("open"),
                )))

            return F.when(F.size(s["open"]) == 0, s).otherwise(let(F.get(s["open"], 0), split))

        # each turn closes a region: at most one for each block and one on either side of it
        return F.aggregate(F.sequence(F.lit(0), 2 * F.least(F.size(x), F.size(y))), start, step)["sum"]

    total = F.length(a) + F.length(b)
    ready = (F.length(a) > 0) & (F.length(b) > 0)
    sums = let(F.split(a, ""), lambda x: let(F.split(b, ""), lambda y: matched(x, y)))
    return F.when(total == 0, F.lit(1.0)).when(ready, 2.0 * sums / total).when(total > 0, F.lit(0.0))
