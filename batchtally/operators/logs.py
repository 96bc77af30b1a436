"""Log mining. One row holds one whole log; parsing stays inside that row.

Lines, sections and telemetry rows are array expressions over the text, so no
shuffle is needed until results of different logs meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchtally.functions.values import is_clock_text, try_number

# Markers in the logs.
SECTIONS = ("header", "dstat")
SECTION_WORD = " output"
SECTION_BEGIN = "begin {} output"
SECTION_END = "end {} output"
TELEMETRY_HEAD = '"usr"'
FATAL_BEGIN = "----- Begin Fatal Exception"
FATAL_END = "----- End Fatal Exception"
FATAL_CATEGORY = "An exception of category"
MESSAGE_LENGTH = 300
SUBMIT_MARK = "Success"
NAME_LINE = "Task name"
NAME_MARK = "Task name:"
BLANKS = " \t\n\x0b\f\r"
HOST_MARK = "Host:"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column) -> Column:
    """Drop white space of any ASCII kind at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def lines_of(body: Column | str) -> Column:
    return F.split(_c(body), "\n")


def _once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add computed columns behind a generator.

    A filter on them is then not pushed below, which would run the parse twice.
    """
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))


def section_lines(logs: DataFrame, section: str, keep: Sequence[str], body: str = "body") -> DataFrame:
    """``keep`` and ``_lines``: the lines inside ``section``.

    The begin line is inside, the end line is not. A section may occur several times.
    """
    order = [(s, b) for s in SECTIONS for b in (True, False)]

    def mark(line: Column) -> Column:
        kind = F.when(~line.contains(SECTION_WORD), F.lit(None).cast("boolean"))  # most lines stop here
        for s, begins in order:
            hit = line.contains((SECTION_BEGIN if begins else SECTION_END).format(s))
            value = F.lit(begins) if s == section else F.lit(None).cast("boolean")
            kind = kind.when(hit, value)
        return kind

    whole = _once(logs.select(*keep, body), _all=lines_of(body)).drop(body)
    marked = F.transform("_all", lambda line, i: F.struct(i.alias("at"), mark(line).alias("begins")))
    found = _once(whole, _marks=F.filter(marked, lambda m: m["begins"].isNotNull()))
    spans = F.transform(
        "_marks",
        lambda m, j: F.when(
            m["begins"],
            F.slice("_all", m["at"] + 1, F.coalesce(F.try_element_at("_marks", j + 2)["at"], F.size("_all")) - m["at"]),
        ).otherwise(F.slice("_all", 1, 0)),
    )
    return _once(found, _lines=F.flatten(spans)).select(*keep, "_lines")


def header_args(logs: DataFrame, *, log: str = "log", body: str = "body") -> DataFrame:
    """``key: value`` lines of the header section; a later line of the same key wins."""
    found = section_lines(logs, "header", [log], body).select(log, F.posexplode("_lines").alias("line_no", "line"))
    head = F.substring_index("line", ":", 1)
    tail = F.expr("substring(line, locate(':', line) + 1)")
    pairs = found.filter(F.col("line").contains(":")).select(log, "line_no", strip(head).alias("key"), strip(tail).alias("val"))
    return pairs.groupBy(log, "key").agg(F.max_by("val", "line_no").alias("val"))


def _table(logs: DataFrame, keep: Sequence[str], body: str) -> DataFrame:
    """``keep``, header names ``_cols``, split data lines ``_rows``, and ``_keep``.

    ``_keep`` holds the 1-based positions of the columns that count: repeated
    names keep their first column, columns beyond the shortest row go.
    """
    heads = F.transform("_lines", lambda x: x.startswith(TELEMETRY_HEAD))
    lines = section_lines(logs, "dstat", keep, body)
    placed = _once(lines, _head=F.array_position(heads, F.lit(True)).cast("int")).filter("_head > 0")
    names = F.transform(
        F.split(strip(F.try_element_at("_lines", F.col("_head"))), ","), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit("")))
    )
    after = F.slice("_lines", F.col("_head") + 1, F.size("_lines"))
    rows = F.transform(F.filter(after, lambda x: x.contains(",")), lambda x: F.split(strip(x), ","))
    parsed = _once(placed, _cols=names, _rows=rows).filter(F.size("_rows") > 0)
    width = F.least(F.size("_cols"), F.array_min(F.transform("_rows", lambda r: F.size(r))))
    first_of_name = lambda p: F.array_position("_cols", F.element_at("_cols", p)) == p
    return _once(parsed, _keep=F.filter(F.sequence(F.lit(1), width), first_of_name)).drop("_lines", "_head")


def telemetry(logs: DataFrame, *, log: str = "log", body: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """Long telemetry: one row per (log, row, metric), with the columns of ``keep``.

    ``value`` is the number, ``raw`` the text of clock-like cells, ``bad`` marks
    text that is neither. ``epoch`` and ``since_start`` repeat the row's time, so
    that time pairs need no join; the start is the first readable time.
    """
    ids = [log, *keep]
    at = F.array_position("_cols", F.lit("epoch")).cast("int")
    timed = _once(_table(logs, ids, body), _at=F.when(F.array_contains("_keep", at), at))
    times = F.transform("_rows", lambda cells: try_number(F.try_element_at(cells, F.col("_at"))))
    first = F.try_element_at(F.filter(times, lambda x: x.isNotNull()), F.lit(1))
    rows = _once(timed, _first=first).select(
        *ids, "_cols", "_keep", "_at", "_first", F.posexplode("_rows").alias("row_no", "_cells")
    )
    epoch = try_number(F.try_element_at("_cells", F.col("_at")))
    pairs = F.transform(
        "_keep", lambda p: F.struct(F.element_at("_cols", p).alias("metric"), F.element_at("_cells", p).alias("cell"))
    )
    cells = rows.select(*ids, "row_no", "_first", epoch.alias("epoch"), F.inline(pairs))
    value, clock = try_number("cell"), is_clock_text("cell")
    return cells.select(
        *ids,
        "row_no",
        "epoch",
        (F.col("epoch") - F.col("_first")).alias("since_start"),
        "metric",
        value.alias("value"),
        F.when(clock, F.col("cell")).alias("raw"),
        (value.isNull() & ~clock).alias("bad"),
    )


def telemetry_columns(logs: DataFrame, *, log: str = "log", body: str = "body") -> DataFrame:
    """Telemetry transposed inside each log: one row per (log, metric) with the cells in row order."""
    columns = F.transform(
        "_keep",
        lambda p: F.struct(
            F.element_at("_cols", p).alias("metric"), F.transform("_rows", lambda r: F.element_at(r, p)).alias("cells")
        ),
    )
    return _table(logs, [log], body).select(log, F.inline(columns))


def _is_legacy_head(line: Column) -> Column:
    return F.substring_index(line, ",", 1).contains("usr") & ~line.contains(HOST_MARK)


def telemetry_legacy(logs: DataFrame, *, log: str = "log", body: str = "body") -> DataFrame:
    """The older reading of an ``.out`` log, over all of its lines.

    Both ``used`` columns are kept as ``used_mem`` and ``used_swp``; other repeated
    names share one list in cell order; rows are lines without lowercase letters;
    cells with a blank are skipped.
    """
    outs = logs.filter(F.col(log).endswith(".out")).select(log, legacy_host(body).alias("host"), lines_of(body).alias("_lines"))
    heads = F.transform("_lines", _is_legacy_head)
    placed = _once(outs, _head=F.array_position(heads, F.lit(True)).cast("int")).filter("_head > 0")
    quoted = lambda x: F.try_element_at(F.split(x, '"'), F.lit(2))
    names = F.transform(F.split(F.try_element_at("_lines", F.col("_head")), ","), quoted)
    after = F.slice("_lines", F.col("_head") + 1, F.size("_lines"))
    rows = F.filter(after, lambda x: (x != "") & ~x.contains(HOST_MARK) & ~x.rlike("[a-z]"))
    used = F.lit("used")
    renamed = lambda x, i: F.when(
        x == used, F.when(F.array_position("_names", used) == i + 1, F.lit("used_mem")).otherwise(F.lit("used_swp"))
    ).otherwise(x)
    table = _once(_once(placed, _names=names, _rows=rows), _cols=F.transform("_names", renamed))
    exploded = table.select(log, "host", "_cols", F.posexplode("_rows").alias("row_no", "_line"))
    cells = exploded.select(log, "host", "row_no", "_cols", F.posexplode(F.split("_line", ",")).alias("col_no", "cell"))
    return cells.filter(~F.col("cell").contains(" ")).select(
        log, "host", "row_no", "col_no", F.try_element_at("_cols", F.col("col_no") + 1).alias("metric"), try_number("cell").alias("value")
    )


def legacy_host(body: Column | str) -> Column:
    """Host of the last ``Host:`` line: the quoted text of its second cell."""
    hosts = F.filter(lines_of(body), lambda x: x.contains(HOST_MARK))
    cell = F.try_element_at(F.split(F.try_element_at(hosts, F.lit(-1)), ","), F.lit(2))
    return F.try_element_at(F.split(cell, '"'), F.lit(2))


def log_validity(logs: DataFrame, *, log: str = "log", body: str = "body") -> DataFrame:
    """Valid logs name their host and hold a ``usr`` table."""
    host = legacy_host(body)
    return logs.select(log, host.alias("host"), (host.isNotNull() & F.exists(lines_of(body), _is_legacy_head)).alias("valid"))


def _after_first(text: Column, mark: str) -> Column:
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + F.lit(len(mark)), F.length(text))).otherwise(text)


def error_parts(body: Column | str) -> tuple[Column, Column, Column]:
    """Found flag, category and message of the first fatal exception block."""
    b = _c(body)
    found = F.coalesce(b.contains(FATAL_BEGIN), F.lit(False))
    block = F.substring_index(_after_first(b, FATAL_BEGIN), FATAL_END, 1)
    token = F.regexp_extract(_after_first(block, FATAL_CATEGORY), r"[^ \t\n\x0B\f\r]+", 0)
    category = F.replace(token, F.lit("'"), F.lit(""))
    newline = F.lit("\n")
    lines = F.replace(F.replace(strip(block), F.lit("\r\n"), newline), F.lit("\r"), newline)
    tail = F.split(F.substring_index(lines, "\n", -2), "\n")
    message = F.left(F.array_join(F.transform(tail, strip), ", "), F.lit(MESSAGE_LENGTH))
    return found, category, message


def error_signature(body: Column | str) -> Column:
    """``[category] message``, or empty text without a fatal exception or a log."""
    found, category, message = error_parts(body)
    return F.when(found, F.concat(F.lit("["), category, F.lit("] "), message)).otherwise(F.lit(""))


def error_counts(logs: DataFrame, *, body: str = "body") -> DataFrame:
    """Logs per error category; logs without one count under empty text."""
    found, category, _ = error_parts(body)
    kind = F.when(found, category).otherwise(F.lit(""))
    return logs.groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def out_name_of(name: Column | str) -> Column:
    """The ``.out`` log next to an ``.err`` log; other names stay."""
    n = _c(name)
    return F.when(n.endswith(".err"), F.replace(n, F.lit(".err"), F.lit(".out"))).otherwise(n)


def err_name_of(name: Column | str) -> Column:
    return F.replace(_c(name), F.lit(".out"), F.lit(".err"))


def request_name(body: Column | str) -> Column:
    """Task name in the first line with ``Success`` or the line after it; NULL when absent."""
    lines = lines_of(body)
    at = F.array_position(F.transform(lines, lambda x: x.contains(SUBMIT_MARK)), F.lit(True)).cast("int")
    pair = F.slice(lines, F.greatest(at, F.lit(1)), 2)
    text = F.array_join(F.filter(pair, lambda x: x.contains(NAME_LINE)), "\n")
    return F.when((at > 0) & text.contains(NAME_MARK), strip(F.try_element_at(F.split(text, NAME_MARK), F.lit(2))))
