"""Column functions on names, literals, JSON and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of literals, by the first pattern that matches the whole token.
LITERALS = (
    ("number", "[+-]?[0-9]+([.][0-9]+)?"),
    ("email", "[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+"),
    ("url", "https?://.*"),
    ("path", "(/[A-Za-z0-9._-]+)+/?"),
    ("constant", "[A-Z][A-Z0-9_]+"),
    ("title", "[A-Z][a-z]+[.,]?"),
    ("word", "[a-z]+[.,]?"),
)


def tokens(df: DataFrame, owner: str, text: str = "text") -> DataFrame:
    """(owner, token): the words of a text between spaces and line ends."""
    return df.select(owner, F.explode(F.filter(F.split(text, "[ \t\r\n]+"), lambda x: x != "")).alias("token"))


#: Kinds of anchors with the pattern that a literal has to hold and their weight; the first that fits is a literal's kind.
#: Patterns mean the same to Spark and to SQL engines with RE2.
ANCHORS = (
    ("address", "^[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+/[^ ]*$", 2.0),
    ("sentence", "^[^ ]+ [^\n]*[.?!]$", 1.5),
    ("clause", "^[^ ]+ [^\n]*$", 1.25),
    ("name", "^[A-Z][A-Za-z]{2,}$", 0.75),
    ("word", "^[A-Za-z]{3,}$", 0.5),
)
#: The length at which an anchor counts half.
HALF_LENGTH = 12


def anchor(literal: Column) -> Column:
    """The (kind, weight) of a literal by ANCHORS; null where none fits."""
    out = F.lit(None).cast("struct<kind:string,weight:double>")
    for kind, pattern, weight in reversed(ANCHORS):
        out = F.when(literal.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))).otherwise(out)
    return out


def anchor_score(weight: Column, literal: Column, frequency: Column, owners: Column) -> Column:
    """How much a literal tells its owner apart: weight, times the log of all owners over those that have it, times a share of its length."""
    size = F.char_length(literal)
    return weight * F.log((owners + 1) / frequency) * (size / (size + HALF_LENGTH))


def literal_kind(token: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(LITERALS):
        out = F.when(token.rlike(f"^({pattern})$"), F.lit(name)).otherwise(out)
    return out


def _child(doc: Column, key: str) -> Column:
    """A member of an object or, where the document is an array, the element of that number; JSON or plain text."""
    member = F.try_element_at(F.from_json(doc, "map<string,string>"), F.lit(key))
    if not re.fullmatch("0|[1-9][0-9]*", key):
        return F.when(F.ltrim(doc).startswith("{"), member)
    element = F.get(F.from_json(doc, "array<string>"), F.lit(int(key)))
    return F.when(F.ltrim(doc).startswith("{"), member).when(F.ltrim(doc).startswith("["), element)


def pointer(json: Column, path: str) -> Column:
    """The value at a JSON pointer (``/a/b``; ~1 is a slash, ~0 a tilde), as text; null if missing or null.
    Whether a number is a key or a place hangs on what stands there, as the pointer's rules say."""
    if path and not path.startswith("/"):
        raise ValueError(f"a JSON pointer begins with a slash: {path!r}")
    for key in path.split("/")[1:]:
        json = _child(json, key.replace("~1", "/").replace("~0", "~"))
    return json


def projected(df: DataFrame, json: str, required: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """df with a column for each alias of a JSON pointer. A row without a required value ends the job with an
    error that names the alias; a missing optional one is null. Aliases that differ by case only, or that
    df has as columns, are rejected before anything runs."""
    optional = optional or {}
    names = [n.lower() for n in (*required, *optional, *df.columns)]
    if clash := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"names that collide: {', '.join(clash)}")
    doc = F.col(json)
    for alias, path in required.items():
        value = pointer(doc, path)
        df = df.withColumn(alias, F.when(value.isNull(), F.raise_error(F.lit(f"nothing at {path} for {alias}"))).otherwise(value))
    for alias, path in optional.items():
        df = df.withColumn(alias, pointer(doc, path))
    return df


def padded(number: Column, width: int) -> Column:
    """A number with zeros before it, up to a width; a longer one stays whole."""
    digits = number.cast("string")
    return F.when(F.char_length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def plain_lines(text: Column) -> Column:
    """Text with \\n alone at line ends and without terminal colour and cursor codes."""
    return F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), "\\x1B\\[[0-9;?]*[ -/]*[@-~]", "")


def legal_name(name: Column, prefix: str = "n_") -> Column:
    """A name of letters, digits and underscores that does not begin with a digit."""
    clean = F.regexp_replace(name, "[^A-Za-z0-9_]+", "_")
    return F.when(clean.rlike("^[A-Za-z_]"), clean).otherwise(F.concat(F.lit(prefix), clean))


def top_level_count(arguments: Column) -> Column:
    """How many arguments a list like ``a,f(b,c),d<e,f>`` has: commas outside of all brackets, plus one; 0 if blank.
    Brackets and commas are folded from left to right, so nesting may be of any depth; a closing bracket without an open one says nothing."""
    marks = F.split(F.regexp_replace(arguments, "[^()\\[\\]{}<>,]", ""), "")

    def step(s: Column, c: Column) -> Column:
        depth = F.when(c.isin("(", "[", "{", "<"), s["depth"] + 1).when(c.isin(")", "]", "}", ">"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), (s["n"] + F.when((c == ",") & (s["depth"] == 0), 1).otherwise(0)).alias("n"))

    n = F.aggregate(marks, F.struct(F.lit(0).alias("depth"), F.lit(1).alias("n")), step)["n"]
    return F.when(F.trim(arguments) == "", 0).otherwise(n)


#: One field descriptor: a primitive or a class, behind any number of array marks.
DESCRIPTOR = r"\[*(?:[BCDFIJSZ]|L[^;]+;)"


def parameter_types(descriptor: Column) -> Column:
    """The parameter types of a method descriptor ``(...)R``, in order; null if it isn't one."""
    whole = descriptor.rlike(rf"^\((?:{DESCRIPTOR})*\)(?:V|{DESCRIPTOR})$")
    return F.when(whole, F.regexp_extract_all(F.regexp_extract(descriptor, r"^\((.*)\)", 1), F.lit(f"({DESCRIPTOR})"), 1))


def argument_slots(descriptor: Column) -> Column:
    """Slots that the parameters take: two for each long and double, else one."""
    types = parameter_types(descriptor)
    return F.size(types) + F.size(F.filter(types, lambda t: t.isin("J", "D")))


def size_similarity(a: Column, b: Column) -> Column:
    """Smaller over larger, 1 where both are zero; six places, halves to even."""
    return F.when(F.greatest(a, b) == 0, 1.0).otherwise(F.bround(F.least(a, b) / F.greatest(a, b), 6))


def segments(url: Column) -> Column:
    """Host and path parts of a URL, without query."""
    return F.split(F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "[?#].*$", ""), "/")


def proper_prefixes(parts: Column, separator: str = "/") -> Column:
    """The joined prefixes of a list of parts that are shorter than it."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), separator))

