"""Date columns. The clock is always an argument (``as_of``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from balanza.functions.plan import let

# Month abbreviations in the two languages that occur.
SPANISH_MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")
ENGLISH_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SPANISH_MONTH_NAMES = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Literal lookup table as one CASE; NULL when the key is absent."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def as_date(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def in_lookback(day: Column, as_of, days: int) -> Column:
    """Within the last ``days`` days; a plain range, so it reaches the scan."""
    end = as_date(as_of)
    return (day >= F.date_sub(end, days)) & (day <= end)


def in_full_months(day: Column, as_of, months: int = 12) -> Column:
    """The last ``months`` full months plus the running one."""
    end = as_date(as_of)
    return (day >= F.add_months(month_start(end), -months)) & (day <= end)


def closed_months(day: Column, as_of) -> Column:
    return month_start(day) != month_start(as_date(as_of))


_DATE_NOISE = (
    r"^(\d{1,2}\s*[-/]\s*[a-zA-Z]{3}\s*[-/]\s*\d{2,4})(.*)",
    r"^(\d{1,2}\s*[-/]\s*\d{1,2}\s*[-/]\s*\d{2,4})(.*)",
    r"^(\d{1,2}\s*[-/]\s*[a-zA-Z]{3})(.*)",
)


def split_date_noise(raw: Column) -> Column:
    """``01-DIC-25 COMISION`` as struct(day_text, noise); text without a date is all ``day_text``."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    day = F.when(F.lit(False), F.lit(""))
    noise = F.when(F.lit(False), F.lit(""))
    for pattern in _DATE_NOISE:
        day = day.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1)))
        noise = noise.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 2)))
    return F.struct(day.otherwise(text).alias("day_text"), noise.otherwise(F.lit("")).alias("noise"))


def parse_period_date(text: Column) -> Column:
    """Statement period dates: d/m/Y, Y-m-d or d-m-Y."""
    clean = F.trim(text)
    return F.coalesce(
        F.when(clean.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(clean, "d/M/yyyy")),
        F.when(clean.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(clean, "yyyy-M-d")),
        F.when(clean.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(clean, "d-M-yyyy")),
    )


def _day_in(month: Column, day: Column) -> Column:
    """Date of a day in the month that starts at ``month``; NULL when the month has no such day."""
    return F.when((day >= 1) & (day <= F.dayofmonth(F.last_day(month))), F.date_add(month, day - 1))


def _two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def complete_date(df: DataFrame, raw: str, start: str, end: str, name: str = "shown") -> DataFrame:
    """Adds the display date ``dd/mm/yyyy`` of a partial date, completed from the statement period.

    ``raw`` is a text column, ``start`` and ``end`` are dates. In order: ``dd/mmm`` with the year
    from the period, a full numeric date, then a bare day placed in the start month, the end month
    or the month after the start, whichever falls inside the period. A form is looked for only where
    those before it do not apply, each part is computed once per row (``let``), and only digits are cast: a failed
    ``try_cast`` costs an exception.
    """
    named_rx, full_rx, day_rx = r"^(\d{1,2})/([a-zA-Z]{3})", r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b", r"\b(\d{1,3})\b"

    def named(text: Column, begin: Column, finish: Column) -> Column:
        month = F.array_position(F.array(*[F.lit(m) for m in SPANISH_MONTHS]), F.lower(F.regexp_extract(text, named_rx, 2))).cast("int")
        year = (
            F.when((F.year(finish) != F.year(begin)) & (month == F.month(finish)), F.year(finish))
            .when((F.month(begin) >= 11) & (month == 1), F.year(begin) + 1)
            .otherwise(F.year(begin))
        )
        whole = F.concat_ws("/", _two(F.regexp_extract(text, named_rx, 1)), _two(month), year.cast("string"))
        return F.when((month > 0) & begin.isNotNull(), whole).otherwise(text)

    def full(text: Column) -> Column:
        """``dd/mm/yyyy`` of a numeric date that the calendar has, else NULL."""
        def of(p: Column) -> Column:
            d, m, y = (F.get(p, F.lit(i)).cast("int") for i in range(3))
            year = F.when(y < 100, y + 2000).otherwise(y)
            leap = F.when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 1).otherwise(0)
            last = F.when(m == 2, leap + 28).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
            return F.when(m.between(1, 12) & (y >= 0) & d.between(1, last), F.concat_ws("/", _two(d), _two(m), F.lpad(year.cast("string"), 4, "0")))

        return F.when(text.rlike(full_rx), let(F.split(F.translate(F.regexp_extract(text, full_rx, 0), "-", "/"), "/"), of))

    def shown_on(day: Column) -> Column:
        return F.concat_ws("/", _two(F.dayofmonth(day)), _two(F.month(day)), F.lpad(F.year(day).cast("string"), 4, "0"))

    def bare(number: Column, text: Column, begin: Column, finish: Column) -> Column:
        tail = F.right(number.cast("string"), F.lit(2)).cast("int")
        day = F.when(number == 0, F.lit(1)).when(number <= 31, number.cast("int")).when(tail.between(1, 31), tail)
        return F.when(number.isNull(), text).otherwise(let(day, lambda d: (
            F.when(d.isNull(), F.concat(number.cast("string"), F.lit("/??/???? (Inválido)")))
            .when(begin.isNull(), F.concat(_two(d), F.lit("/??/????")))
            .otherwise(let(placed(d, begin, finish), lambda pick: F.coalesce(
                shown_on(pick), F.concat_ws("/", _two(d), _two(F.month(begin)), F.year(begin).cast("string"))
            )))
        )))

    def placed(day: Column, begin: Column, finish: Column) -> Column:
        other_month = (F.month(finish) != F.month(begin)) | (F.year(finish) != F.year(begin))
        found = F.array_compact(F.array(
            _day_in(month_start(begin), day),
            F.when(other_month, _day_in(month_start(finish), day)),
            _day_in(F.add_months(month_start(begin), 1), day),
        ))

        def choose(cand: Column) -> Column:
            later = finish.isNotNull() & (F.month(begin) != F.month(finish)) & (day < F.dayofmonth(begin)) & (F.size(cand) > 1)
            return F.coalesce(
                F.get(F.filter(cand, lambda c: c.between(begin, finish)), F.lit(0)),
                F.get(cand, F.when(later, F.lit(1)).otherwise(F.lit(0))),
            )

        return let(found, choose)

    def of_number(text: Column, begin: Column, finish: Column) -> Column:
        number = F.coalesce(
            F.nullif(F.regexp_extract(text, day_rx, 1), F.lit("")),
            F.nullif(F.regexp_replace(text, r"\D", ""), F.lit("")),
        )
        return let(F.when(number.isNotNull(), number.try_cast("decimal(38,0)")), lambda n: bare(n, text, begin, finish))

    def complete(text: Column) -> Column:
        begin, finish = F.col(start), F.col(end)
        return (
            F.when(text == "", F.lit(""))
            .when(text.rlike(named_rx), named(text, begin, finish))
            .otherwise(let(full(text), lambda whole: F.coalesce(whole, of_number(text, begin, finish))))
        )

    return df.withColumn(name, let(F.trim(F.coalesce(F.col(raw), F.lit(""))), complete))


def movement_period(display: Column, start: Column) -> Column:
    """``01-mm-yyyy`` of a display date, else of the period start, else 01-01-1900."""
    parts = F.split(display, "/")
    own = F.when(
        (F.coalesce(display, F.lit("")) != "") & ~display.contains("??") & (F.size(parts) == 3),
        F.concat(F.lit("01-"), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lit("-"), F.get(parts, F.lit(2))),
    )
    return F.coalesce(own, F.date_format(start, "'01'-MM-yyyy"), F.lit("01-01-1900"))


def api_month(text: Column) -> Column:
    """``2025/Sep``, ``2025-9`` and Spanish forms as ``YYYY-MM``; other text comes back as it is."""
    clean = F.translate(text, "/", "-")
    parts = F.split(clean, "-")
    name = F.get(parts, F.lit(1))
    names = {m.capitalize(): f"{i + 1:02d}" for months in (ENGLISH_MONTHS, SPANISH_MONTHS) for i, m in enumerate(months)}
    number = F.when(name.rlike(r"^\d+$"), F.format_string("%02d", name.try_cast("int")))
    month = F.coalesce(lookup(name, names), number)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(""))
        .when((F.size(parts) == 2) & month.isNotNull(), F.concat(F.get(parts, F.lit(0)), F.lit("-"), month))
        .otherwise(clean)
    )


def bureau_date(text: Column) -> Column:
    """``DDMMYYYY`` as ``YYYY-MM-DD``; text of another length comes back as it is."""
    return F.when(
        F.length(text) == 8,
        F.concat_ws("-", F.substring(text, 5, 4), F.substring(text, 3, 2), F.substring(text, 1, 2)),
    ).otherwise(text)


def bureau_update_date(text: Column) -> Column:
    """As :func:`bureau_date`, with ``YYYYMM`` as the first of that month."""
    clean = F.trim(text)
    return F.when(
        clean.rlike(r"^\d{6}$"), F.concat_ws("-", F.substring(clean, 1, 4), F.substring(clean, 5, 2), F.lit("01"))
    ).otherwise(bureau_date(clean))


def consult_date(text: Column, as_of) -> Column:
    """Report date ``YYYY-MM-DD…`` or ``DDMMYYYY``; else ``as_of``."""
    clean = F.trim(text)
    return F.coalesce(
        F.when(clean.contains("-"), F.try_to_date(F.left(clean, F.lit(10)), "yyyy-MM-dd")),
        F.when(clean.rlike(r"^\d{8}$"), F.try_to_date(clean, "ddMMyyyy")),
        as_date(as_of),
    )


def recent_proof(text: Column, as_of, months: int = 3) -> Column:
    """Whether an end date ``YYYY-MM-DD`` is within the last months; NULL when it is no date."""
    return F.try_to_date(text, "yyyy-MM-dd") >= F.add_months(as_date(as_of), -months)


def rfc_age(rfc: Column, as_of) -> Column:
    """Years since the date inside a taxpayer id, NULL for an id of another shape."""
    clean = F.trim(rfc)
    two = F.when(F.length(clean) == 12, F.substring(clean, 4, 2)).when(F.length(clean) == 13, F.substring(clean, 5, 2))
    short = two.try_cast("int")
    this_year = F.year(as_date(as_of))
    born = F.when(short > this_year % 100, short + 1900).otherwise(short + 2000)
    return this_year - born


def seniority_years(start: Column, as_of) -> Column:
    """Exact years since a start date, 0 when unknown."""
    end = as_date(as_of)
    before = (F.month(end) * 100 + F.dayofmonth(end)) < (F.month(start) * 100 + F.dayofmonth(start))
    return F.coalesce(F.year(end) - F.year(start) - F.when(before, 1).otherwise(0), F.lit(0))


def seniority_days(start: Column, as_of) -> Column:
    """Whole years as days // 365."""
    return F.floor(F.datediff(as_date(as_of), start) / 365)


def short_us_date(day: Column) -> Column:
    return F.date_format(day, "M/d/yyyy")


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM-yy")
