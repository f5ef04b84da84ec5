"""Column expressions that take SQL script text apart.

All repeated groups are possessive: they run as loops in the regex engine, so
the length of a script never grows its stack.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# An identifier as [x], "x", `x` or a bare word, and a dotted name of up to three
# parts whose groups are (schema, table).
NAME = r'(?:\[[^\]]+\]|"[^"]+"|`[^`]+`|\w+)'
DOTTED = rf"(?:(?:{NAME}\s*\.\s*)?({NAME})\s*\.\s*)?({NAME})"

_PIECE = r"[^(),]++|[(),]"
# The same with groups of one or two levels left in the text around them.
_BODY_PIECE = r"(?:[^(),]++|\((?:[^()]++|\([^()]*+\))*+\))++|[(),]"
# Text up to the parenthesis that closes it, with groups of one or two levels in it.
_FLAT_BODY = r"^(?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+"
_TOKEN = r"'[^']*+(?:'|\z)|/\*[\s\S]*?(?:\*/|\z)|--[^\n]*+(?:\n|\z)|[^'/\-]++|[/\-]"

# Inside literals the characters that steer later steps are swapped for private
# ones of the same length, and swapped back in the statements handed out.
_STEERING = ";,()\n"
_PRIVATE = "\ue000\ue001\ue002\ue003\ue004"
_CUT = "\ue005"

# All of Unicode's white space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Patterns of the statements and keys that are read (fixed values).
CREATE_TABLE = rf"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{DOTTED}\s*\("
ALTER_TABLE = rf"(?i)^ALTER\s+TABLE\s+{DOTTED}"
_CLUSTER = r"(?:CLUSTERED|NONCLUSTERED)?"
_ADD = rf"ADD\s+(?:CONSTRAINT\s+{NAME}\s+)?"
_LIST = r"\(([^)]+)\)"
PRIMARY_KEY = rf"PRIMARY\s+KEY\s*{_CLUSTER}\s*{_LIST}"
UNIQUE_KEY = rf"UNIQUE\s*{_CLUSTER}\s*{_LIST}"
FOREIGN_KEY = rf"FOREIGN\s+KEY\s*{_LIST}\s*REFERENCES\s+{DOTTED}\s*{_LIST}"
REFERENCES = rf"\bREFERENCES\s+{DOTTED}\s*{_LIST}"
# Types written with several words (fixed values).
_LONG_TYPES = (
    r"CHARACTER\s+VARYING|DOUBLE\s+PRECISION|TIMESTAMP\s+WITH(?:OUT)?\s+TIME\s+ZONE"
)


def decode_script(content: Column) -> Column:
    """Script bytes to text by byte-order mark, zero bytes, UTF-8, then Latin-1.

    Malformed UTF-16 only becomes U+FFFD where the session replaces coding
    errors, see ``sources.scripts.replacing_bad_bytes``.
    """
    mark = F.hex(F.substring(content, 1, 3))
    bytes_from = lambda n: F.substring(content, n, 2**31 - 1)
    raw_text = content.cast("string")
    return (
        F.when(F.length(content) == 0, F.lit(""))
        .when(mark.startswith("FFFE"), F.ltrim(F.decode(bytes_from(3), "UTF-16LE"), F.lit("\ufeff")))
        .when(mark.startswith("FEFF"), F.ltrim(F.decode(bytes_from(3), "UTF-16BE"), F.lit("\ufeff")))
        .when(mark == "EFBBBF", F.make_valid_utf8(bytes_from(4).cast("string")))
        .when(
            (F.length(content) > 2) & (F.substring(mark, 3, 2) == "00"),
            F.decode(content, "UTF-16LE"),
        )
        .when(F.is_valid_utf8(raw_text), raw_text)
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def _script_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _without_comment(token: Column) -> Column:
    return (
        F.when(
            token.startswith("/*"),
            F.when(token.endswith("*/") & (F.length(token) > 3), " ").otherwise(""),
        )
        .when(token.startswith("--"), F.when(token.endswith("\n"), "\n").otherwise(""))
        .otherwise(token)
    )


def strip_comments(text: Column) -> Column:
    """Block comments to a blank, line comments to a line end; literals stay."""
    return F.array_join(F.transform(_script_tokens(text), _without_comment), "")


def masked_script(text: Column) -> Column:
    """``strip_comments`` with steering characters inside literals swapped out."""
    return F.array_join(
        F.transform(
            _script_tokens(text),
            lambda t: F.when(t.startswith("'"), F.translate(t, _STEERING, _PRIVATE)).otherwise(
                _without_comment(t)
            ),
        ),
        "",
    )


def unmasked(text: Column) -> Column:
    for private, steering in zip(_PRIVATE, _STEERING):  # a search for bytes, where ``translate`` looks up every character
        text = F.replace(text, F.lit(private), F.lit(steering))
    return text


def batch_separators(text: Column) -> Column:
    """A line holding only GO ends a statement."""
    return F.regexp_replace(text, r"(?imd)^[ \t]*GO[ \t]*$", ";")


def statements_of(masked: Column) -> Column:
    """Array of the non-empty statements of a masked script."""
    pieces = F.split(masked, ";", -1)
    trimmed = F.transform(pieces, lambda s: F.trim(s, F.lit(_WHITE)))
    return F.filter(trimmed, lambda s: s != "")


def without_literals(masked: Column) -> Column:
    """One-line text in which every literal is empty, for matching keywords."""
    bare = F.regexp_replace(masked, r"'[^']*+(?:'|\z)", "''")

    def one_line(text: Column) -> Column:
        ascii_only = F.octet_length(text) == F.length(text)  # Unicode's classes are matched several times as slowly
        return F.when(ascii_only, F.regexp_replace(text, r"\s++", " ")).otherwise(F.regexp_replace(text, r"(?U)\s++", " "))

    return F.trim(one_line(bare))


def statement_kind(bare: Column) -> Column:
    """create / alter / other, from a statement without literals."""
    up = F.upper(bare)
    return (
        F.when(up.contains("CREATE TABLE"), "create")
        .when(
            up.contains("ALTER TABLE")
            & (
                up.contains("ADD CONSTRAINT")
                | up.contains("PRIMARY KEY")
                | up.contains("FOREIGN KEY")
            ),
            "alter",
        )
        .otherwise("other")
    )


def is_ddl(bare: Column) -> Column:
    """Statements worth parsing: CREATE TABLE, or ALTER TABLE with a key."""
    up = F.upper(bare)
    return up.contains("CREATE TABLE") | (
        up.contains("ALTER TABLE") & (up.contains("PRIMARY KEY") | up.contains("FOREIGN KEY"))
    )


def used_database(bare: Column) -> Column:
    """Name after the first USE, null when there is none."""
    return F.nullif(F.regexp_extract(bare, r"(?i)\bUSE\s+\[?(\w+)\]?", 1), F.lit(""))


def clean_name(name: Column) -> Column:
    """An identifier without quotes and without a trailing ASC / DESC."""
    # each step holds the one before once: what is matched in a list is worked out as often as it is written
    s = F.trim(F.regexp_replace(F.trim(name), r"(?i)\s+(?:ASC|DESC)\s*$", ""))
    return F.regexp_replace(s, r'(?s)^(?:\[([^\]]+)\]|"([^"]+)"|`([^`]+)`).*$', "$1$2$3")


def part(text: Column, pattern: str, group: int) -> Column:
    """A regex group, null when it is empty or the pattern does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _pieces(text: Column) -> Column:
    """Parentheses, commas, and the text between them."""
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def _deeper(piece: Column) -> Column:
    return F.when(piece == "(", 1).when(piece == ")", -1).otherwise(0)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def create_body(bare: Column) -> Column:
    """Text between the parentheses of CREATE TABLE, nested to any depth.

    A body that is never closed goes to the end of the statement; an empty one
    is null.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + _deeper(piece)  # -1 once the body is closed, and from then on
        inside = F.struct(depth.alias("depth"), (state["size"] + F.length(piece)).alias("size"))
        closed = F.struct(F.lit(-1).alias("depth"), state["size"].alias("size"))
        return F.when((state["depth"] < 0) | (depth < 0), closed).otherwise(inside)

    def inside_of(rest: Column) -> Column:
        def checked(flat: Column) -> Column:
            # what follows closes the body, ends the text, or is nested deeper than the pattern looks
            deeper = F.substr(rest, F.length(flat) + 1, F.lit(1)) == "("
            size = F.aggregate(_pieces(rest), start, step, lambda state: state["size"])
            return F.when(deeper, F.substr(rest, F.lit(1), size)).otherwise(flat)

        return _bound(F.regexp_extract(rest, _FLAT_BODY, 0), checked)

    # a dot for any character is a plain loop; a class of all characters is matched twenty times as slowly
    whole = _bound(part(bare, rf"{CREATE_TABLE}(?s:(.*+))", 3), inside_of)
    return _bound(whole, lambda body: F.when(body != "", body))


def _running(items: Column, zero: Column, kind: str, step) -> Column:
    """States of a fold after each of ``items``, a bound array.

    Lists that grow are copied, so states are gathered in parts of about the
    square root of their number, and the parts put together at the end.
    """
    size = F.size(items)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(size)).cast("int"))
    firsts = F.when(size > 0, F.sequence(F.lit(1), size, width)).otherwise(F.array().cast("array<int>"))

    def part_of(done: Column, first: Column) -> Column:
        empty = F.struct(done["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("states"))

        def one(own: Column, item: Column) -> Column:
            return _bound(
                step(own["state"], item),
                lambda state: F.struct(state.alias("state"), F.array_append(own["states"], state).alias("states")),
            )

        return _bound(
            F.aggregate(F.slice(items, first, width), empty, one),
            lambda own: F.struct(own["state"].alias("state"), F.array_append(done["parts"], own["states"]).alias("parts")),
        )

    start = F.struct(zero.cast(kind).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("parts"))
    return F.flatten(F.aggregate(firsts, start, part_of)["parts"])


def body_items(body: Column) -> Column:
    """Items of a table body, cut at commas outside parentheses.

    Groups of one or two levels stay in the pieces, so most bodies have nothing
    else to follow. Else the depth is followed over all pieces once; the commas
    of depth 0 are then swapped for a private character, and the text is split
    there.
    """

    def cut_up(pieces: Column) -> Column:
        depths = _running(pieces, F.lit(0), "int", lambda depth, piece: depth + _deeper(piece))
        marked = _bound(
            depths,
            lambda depth: F.transform(
                pieces, lambda p, i: F.when((p == ",") & (F.get(depth, i) == 0), _CUT).otherwise(p)
            ),
        )
        nested = F.array_contains(pieces, "(") | F.array_contains(pieces, ")")
        split = F.split(F.array_join(marked, ""), _CUT, -1)
        return F.when(nested, split).otherwise(F.filter(pieces, lambda p: p != ","))

    def listed(text: Column) -> Column:
        items = _bound(F.regexp_extract_all(text, F.lit(_BODY_PIECE), F.lit(0)), cut_up)
        return F.when(text.isNotNull(), F.filter(F.transform(items, lambda s: F.trim(s)), lambda s: s != ""))

    return _bound(body, listed)


_ADDS = r"(?i)^(?:WITH\s+(?:NO)?CHECK\s+)?ADD\b"
# Verbs of ALTER TABLE that end what an ADD began (fixed values).
_OTHER_VERBS = r"(?i)^(?:ALTER|CHANGE|DISABLE|DROP|ENABLE|MODIFY|REBUILD|RENAME|SET|SWITCH|(?:NO)?CHECK\s+(?:ALL|CONSTRAINT))\b"


def added_items(rest: Column) -> Column:
    """What an ALTER TABLE adds, one ``ADD ...`` per item, from the text behind the table's name.

    An ADD goes on over commas until another verb takes its place, with or
    without parentheses around what it adds.
    """
    opened = F.regexp_replace(F.trim(rest), r"(?is)^((?:WITH\s+(?:NO)?CHECK\s+)?ADD)\s*\((.*)\)\s*$", "$1 $2")

    def told(items: Column) -> Column:
        adding = _running(
            items,
            F.lit(False),
            "boolean",
            lambda before, item: F.when(item.rlike(_ADDS), True).when(item.rlike(_OTHER_VERBS), False).otherwise(before),
        )
        return _bound(
            adding,
            lambda adds: F.filter(
                F.transform(
                    items,
                    lambda item, i: F.when(
                        F.get(adds, i), F.concat(F.lit("ADD "), F.trim(F.regexp_replace(item, _ADDS, "")))
                    ),
                ),
                lambda item: item.isNotNull(),
            ),
        )

    return F.when(rest.isNotNull(), _bound(body_items(opened), told))


def column_item(item: Column) -> Column:
    """The item without a trailing ``ON [filegroup]``."""
    return F.trim(F.regexp_replace(F.trim(item), r"(?i)\s+ON\s+\[\w+\]\s*$", ""))


def is_constraint(item: Column) -> Column:
    """Whether a body item is a table constraint rather than a column."""
    return item.rlike(
        r"(?i)^(?:PRIMARY\s+KEY|FOREIGN\s+KEY|KEY\s|(?:CONSTRAINT|UNIQUE|CHECK|INDEX)\b\s*[(\w\[\"`])"
    )


_COLUMN = r'(?s)^(\[[^\]]*\]|"[^"]*"|`[^`]*`|\S+)\s*(.*)$'


def column_name(item: Column) -> Column:
    return clean_name(F.regexp_extract(item, _COLUMN, 1))


def column_rest(item: Column) -> Column:
    return F.trim(F.regexp_extract(item, _COLUMN, 2))


def base_type(rest: Column) -> Column:
    """Declared type without its size, in upper case."""
    bracketed = rest.contains("[") | rest.contains("]")
    flat = F.when(bracketed, F.translate(rest, "[]", "")).otherwise(rest)
    first = F.regexp_extract(flat, rf"(?i)^(?:(?:{_LONG_TYPES})\b|[^\s(]+)", 0)
    unquoted = F.regexp_replace(first, r'(?s)^(?:"([^"]+)"|`([^`]+)`).*$', "$1$2")
    name = F.nullif(F.upper(F.regexp_replace(unquoted, r"\s+", " ")), F.lit(""))
    return F.coalesce(name, F.lit("UNKNOWN"))


def inline_reference(rest: Column, default_schema: str) -> Column:
    """(schema, table, column) that a column's definition refers to, null where it refers to none.

    Few columns refer to others. Their names are read in a list of what was
    matched, empty for the rest, so that it costs those next to nothing and
    the code for all facts of a column stays small enough to be compiled.
    """
    refers = F.when(F.upper(rest).contains("REFERENCES"), F.regexp_extract(rest, rf"(?i){REFERENCES}", 0))
    name = lambda held, group: clean_name(F.regexp_extract(held, rf"(?i){REFERENCES}", group))
    found = F.transform(
        F.filter(F.array(refers), lambda held: held != ""),
        lambda held: F.struct(
            F.when(F.regexp_extract(held, rf"(?i){REFERENCES}", 1) == "", default_schema).otherwise(name(held, 1)).alias("schema"),
            name(held, 2).alias("table"),
            name(held, 3).alias("column"),
        ),
    )
    return F.get(found, 0)


def name_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), clean_name)


def key_parts(text: Column, in_alter: bool) -> Column:
    """Keys a constraint item of a table body or an item that an ALTER adds declares.

    Array of (kind, columns, ref_schema, ref_table, ref_columns) with one entry
    per kind found.
    """
    lead = _ADD if in_alter else ""
    none = F.lit(None).cast("string")
    no_list = F.lit(None).cast("array<string>")

    def entry(kind, columns, schema=none, table=none, targets=no_list):
        return F.when(
            columns.isNotNull(),
            F.struct(
                F.lit(kind).alias("kind"),
                name_list(columns).alias("columns"),
                schema.alias("ref_schema"),
                table.alias("ref_table"),
                targets.alias("ref_columns"),
            ),
        )

    fk = rf"(?i){lead}{FOREIGN_KEY}"
    return F.array_compact(
        F.array(
            entry("PK", part(text, rf"(?i){lead}{PRIMARY_KEY}", 1)),
            entry("UQ", part(text, rf"(?i){lead}{UNIQUE_KEY}", 1)),
            entry(
                "FK",
                part(text, fk, 1),
                clean_name(part(text, fk, 2)),
                clean_name(part(text, fk, 3)),
                name_list(part(text, fk, 4)),
            ),
        )
    )
