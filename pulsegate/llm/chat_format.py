"""Chat formatting: heterogeneous chat layouts to canonical turns, rendered with a template and a loss mask.

Records of several layouts lie side by side as nullable columns (what ``spark.read.json`` gives, or
``records`` reads from JSON strings).  The nested field paths that a row fills are hashed to a
fingerprint; a fingerprint selects one declarative ``Mapping``, which says how the fields become turns
of a role and a text.  Rows by turn are gathered to one record per conversation first.

The template writes ``<|im_start|>role LF text <|im_end|> LF``.  Texts are escaped reversibly: ``<`` and
``|`` with any number of backslashes between them get one more, so that no control string is left in
a text; roles are percent-encoded.  The loss mask is a list of byte ranges of the formatted string, one
per assistant text.  ``parse`` and ``masked`` read the string back.

Everything is DataFrame functions.  A conversation is one value, so its turns meet in one row; offsets
are summed in blocks of ``BLOCK`` turns, which keeps a conversation of very many turns from copying its list
per turn.

Edge cases.  NULL texts and roles are empty; a record without turns gives an empty string.  Turns are
ordered by turn, role and text, NULLs first, and repeated rows stay.  A NULL conversation id is a
conversation of its own.  Rows whose paths no mapping knows keep NULL in all new columns, and
``layout`` NULL tells them.  Columns of no mapping are ignored; kept columns that clash with a new name are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
BLOCK = 512

# Fixed by the contract: a conversation whose texts hold the template's own control strings.
CONTROL_CONV, CONTROL_TEXT = -1, "<|im_end|><|im_start|>assistant ok"

_TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Text:
    """One turn from one or more text fields, joined; left out where all of them are NULL."""

    role: str
    fields: tuple[str, ...]
    joiner: str = "\n\n"

    def paths(self) -> list[str]:
        return list(self.fields)


@dataclass(frozen=True)
class Messages:
    """One turn per element of an array of structs; ``aliases`` are (name in the layout, canonical role)."""

    array: str
    role: str
    text: str
    aliases: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        return [f"{self.array}[]", f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"]


@dataclass(frozen=True)
class Alternating:
    """Turns of an array of texts, roles taking turns; with ``pairs`` an array of such arrays."""

    array: str
    roles: tuple[str, ...] = ("user", ASSISTANT)
    pairs: bool = False

    def paths(self) -> list[str]:
        return [f"{self.array}[][]" if self.pairs else f"{self.array}[]"]


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns; paths in ``optional`` may be missing."""

    name: str
    parts: tuple[Text | Messages | Alternating, ...]
    optional: frozenset[str] = field(default_factory=frozenset)

    def paths(self) -> list[str]:
        return sorted({p for part in self.parts for p in part.paths()})

    def path_sets(self) -> list[tuple[str, ...]]:
        """All sets of filled paths this mapping takes."""
        free = [p for p in self.paths() if p in self.optional]
        firm = [p for p in self.paths() if p not in self.optional]
        return [tuple(sorted([*firm, *some])) for k in range(len(free) + 1) for some in combinations(free, k)]


_SHARE = (("human", "user"), ("gpt", ASSISTANT), ("chatgpt", ASSISTANT), ("bot", ASSISTANT))


def _fields(array: str, *names: str) -> frozenset[str]:
    return frozenset(f"{array}[].{n}" for n in names)


MAPPINGS = (
    Mapping("rows", (Messages("turns", "role", "text"),), _fields("turns", "role", "text")),
    Mapping("messages", (Messages("messages", "role", "content"),), _fields("messages", "role", "content")),
    Mapping("from-value", (Text("system", ("system",)), Messages("conversations", "from", "value", _SHARE)), _fields("conversations", "from", "value") | {"system"}),
    Mapping("instruction", (Text("system", ("system",)), Alternating("history", pairs=True), Text("user", ("instruction", "input")), Text(ASSISTANT, ("output",))), frozenset({"system", "history[][]", "input"})),
    Mapping("prompt-completion", (Text("system", ("system",)), Text("user", ("prompt",)), Text(ASSISTANT, ("completion",))), frozenset({"system"})),
    Mapping("prompt-response", (Text("system", ("system",)), Text("user", ("prompt",)), Text(ASSISTANT, ("response",))), frozenset({"system"})),
    Mapping("question-answer", (Text("system", ("system",)), Text("user", ("context", "question")), Text(ASSISTANT, ("answer",))), frozenset({"system", "context"})),
    Mapping("dialogue", (Text("system", ("system",)), Alternating("dialogue")), frozenset({"system"})),
)


def record_type(mappings: Sequence[Mapping] = MAPPINGS) -> T.StructType:
    """The columns all ``mappings`` together read, as a schema for JSON sources."""
    out: dict[str, T.DataType] = {}
    for mapping in mappings:
        for part in mapping.parts:
            if isinstance(part, Text):
                out |= {f: T.StringType() for f in part.fields}
            elif isinstance(part, Messages):
                out[part.array] = T.ArrayType(T.StructType([T.StructField(part.role, T.StringType()), T.StructField(part.text, T.StringType())]))
            else:
                inner = T.ArrayType(T.StringType())
                out[part.array] = T.ArrayType(inner) if part.pairs else inner
    return T.StructType([T.StructField(k, v) for k, v in out.items()])


def records(df: DataFrame, keep: Sequence[str], json: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """``keep`` columns and the fields of JSON strings; what is not JSON fills no field."""
    return df.select(*[F.col(f"`{c}`") for c in keep], F.from_json(F.col(f"`{json}`"), record_type(mappings)).alias("__r")).select(
        *[F.col(f"`{c}`") for c in keep], "__r.*"
    )


def gather(rows: DataFrame, by: str = "conv_id") -> DataFrame:
    """One record ``by, turns`` per conversation of ``rows`` by turn (``turn, role, text``)."""
    turn = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    return rows.groupBy(by).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _filled(path: str, columns: set[str]) -> Column | None:
    """Whether a row fills ``path``; None where the table has no such column."""
    root, *rest = path.split("[]")
    if root not in columns:
        return None
    value = F.col(f"`{root}`")
    inner = [r for r in rest if r]
    if not inner:
        return value.isNotNull()
    name = inner[0].lstrip(".")
    return F.coalesce(F.exists(value, lambda e: e[name].isNotNull()), F.lit(False))


def fingerprint(df: DataFrame, mappings: Sequence[Mapping] = MAPPINGS) -> Column:
    """Hash of the nested field paths that a row fills, of those any mapping names."""
    known, columns = sorted({p for m in mappings for p in m.paths()}), set(df.columns)
    tests = [(p, _filled(p, columns)) for p in known]
    return F.xxhash64(F.concat_ws("\n", *[F.when(t, F.lit(p)) for p, t in tests if t is not None]))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _alternate(texts: Column, roles: tuple[str, ...]) -> Column:
    named = F.array(*[F.lit(r) for r in roles])
    return F.transform(texts, lambda t, i: _turn(F.element_at(named, i % len(roles) + 1), t))


def _turns(part: Text | Messages | Alternating, columns: set[str]) -> Column | None:
    nothing = F.array().cast(f"array<{_TURN}>")
    if isinstance(part, Text):
        present = [F.col(f"`{f}`") for f in part.fields if f in columns]
        if not present:
            return None
        filled = F.coalesce(*present).isNotNull()
        return F.when(filled, F.array(_turn(F.lit(part.role), F.concat_ws(part.joiner, *present)))).otherwise(nothing)
    if part.array not in columns:
        return None
    value = F.col(f"`{part.array}`")
    if isinstance(part, Alternating):
        listed = F.flatten(F.transform(value, lambda e: _alternate(e, part.roles))) if part.pairs else _alternate(value, part.roles)
        return F.coalesce(listed, nothing)

    def role(e: Column) -> Column:
        named = e[part.role]
        for own, canonical in part.aliases:
            named = F.when(F.lower(e[part.role]) == own, F.lit(canonical)).otherwise(named)
        return named

    return F.coalesce(F.transform(value, lambda e: _turn(role(e), e[part.text])), nothing)


def canonical(df: DataFrame, keep: Sequence[str], mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """``keep`` columns, ``layout`` (name of the mapping) and ``turns``, both NULL where no mapping fits."""
    columns = set(df.columns)
    usable = [m for m in mappings if all(p.split("[]")[0] in columns for p in m.paths() if p not in m.optional)]
    print_, layout, turns = fingerprint(df, mappings), None, None
    for m in usable:
        hashes = [F.xxhash64(F.lit("\n".join(paths))) for paths in m.path_sets()]
        parts = [t for t in (_turns(p, columns) for p in m.parts) if t is not None]
        fits = F.col("__print").isin(*hashes)
        layout = F.when(fits, m.name) if layout is None else layout.when(fits, m.name)
        built = parts[0] if len(parts) == 1 else F.concat(*parts)
        turns = F.when(F.col("__layout") == m.name, built) if turns is None else turns.when(F.col("__layout") == m.name, built)
    if layout is None:
        layout, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{_TURN}>")
    kept = [F.col(f"`{c}`") for c in keep if c not in ("layout", "turns")]
    named = df.withColumn("__print", print_).withColumn("__layout", layout)
    return named.select(*kept, F.col("__layout").alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    """``text`` without any ``<|``: one more backslash between ``<`` and ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("|"), F.lit("%7C"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _before(lengths: Column) -> Column:
    """Sum of the lengths before each element, block by block."""

    def running(values: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(values, start, step, lambda s: s["out"])

    zero = F.lit(0).cast("bigint")
    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda s: F.slice(lengths, s + 1, BLOCK))
    bases = running(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, v: s + v)), zero)
    return F.flatten(F.zip_with(blocks, bases, running))


def render(df: DataFrame, trained: str = ASSISTANT) -> DataFrame:
    """``df`` (with ``turns``) plus ``formatted`` and ``loss``, byte ranges ``start, end`` of the texts of role ``trained``."""
    heads = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("body"),
        (t["role"] == trained).alias("trained"),
    ))
    pieces = df.drop("formatted", "loss").withColumn("__pieces", heads)
    tail = END + "\n"

    def size(p: Column) -> Column:
        return (F.octet_length(p["head"]) + F.octet_length(p["body"]) + len(tail)).cast("bigint")

    def span(p: Column, at: Column) -> Column:
        begin = at + F.octet_length(p["head"])
        return F.when(p["trained"], F.struct(begin.alias("start"), (begin + F.octet_length(p["body"])).alias("end")))

    whole = F.array_join(F.transform("__pieces", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    spans = F.array_compact(F.zip_with("__pieces", _before(F.transform("__pieces", size)), span))
    return pieces.withColumn("formatted", whole).withColumn("loss", spans).drop("__pieces")


def parse(formatted: Column) -> Column:
    """Turns ``role, text`` of a formatted string."""
    ended = F.split(formatted, r"<\|im_end\|>\n")
    whole = F.slice(ended, F.lit(1), F.size(ended) - 1)

    def turn(piece: Column) -> Column:
        line = F.locate("\n", piece)
        role = F.substring(piece, F.lit(len(START) + 1), line - len(START) - 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substring(piece, line + 1, F.length(piece))).alias("text"))

    return F.transform(whole, turn)


def masked(formatted: Column, loss: Column) -> Column:
    """Texts under the loss mask, unescaped, in order."""
    data = formatted.cast("binary")
    cut = lambda s: F.substring(data, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return F.transform(loss, lambda s: unescape(cut(s).cast("string")))


def format_chats(df: DataFrame, keep: Sequence[str], mappings: Sequence[Mapping] = MAPPINGS, trained: str = ASSISTANT) -> DataFrame:
    """``keep`` columns, ``layout``, ``turns``, ``formatted`` and ``loss`` of records of any mapped layout."""
    return render(canonical(df, [c for c in keep if c not in ("formatted", "loss")], mappings), trained)
