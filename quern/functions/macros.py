"""Macro text as a space of variants: what stands outside of macros is kept, and each macro becomes the space that its name says."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import variants
from quern.functions.variants import Space

# The names of the macros. LINESWAP and LINESWAP_TEXT take lines, all others arguments with commas between them.
NAMES = ("GENERAL", "ONCE", "RANDOMIZE", "FORCE_SAMELINE", "VAR", "LINESWAP_TEXT", "LINESWAP", "INT", "IGNORE", "PRETEND")
TOKEN = re.compile(r"PERM_\w+\(|\(,\)|[(),\n]|(?:(?!PERM_\w+\()[^(),\n])+")


@dataclass
class Argument:
    """What it is made of, and its own text."""

    parts: list[Space] = field(default_factory=list)
    raw: str = ""

    def add(self, part: Space, raw: str) -> None:
        self.parts.append(part)
        self.raw += raw

    def space(self) -> Space:
        return self.parts[0] if len(self.parts) == 1 else variants.combine(*self.parts) if self.parts else variants.text("")


@dataclass
class Frame:
    """A macro that is still open, and the brackets open in it. The outermost one has no name."""

    name: str | None
    level: int = 0
    args: list[Argument] = field(default_factory=lambda: [Argument()])

    def between(self) -> str | None:
        return None if self.name is None else "\n" if self.name.startswith("LINESWAP") else ","


def wrapped(name: str, part: Space) -> Space:
    """The part between two marker lines of this name."""
    return variants.combine(variants.text(f"\n#pragma region {name}\n"), part, variants.text(f"\n#pragma endregion {name}\n"))


def literal(part: Space) -> Space:
    """The part's text as one line that no later step reads as code; nothing if it is empty."""

    def decode(seed, chosen):
        shown = part.decode(seed, chosen)
        return F.when(shown == "", "").otherwise(F.concat(F.lit("\n#pragma literal "), F.base64(F.encode(shown, "UTF-8")), F.lit("\n")))

    return Space(part.size, decode, part.once, part.random)


def built(name: str, args: list[Argument]) -> Space:
    """The space of a macro with these arguments."""
    if name == "GENERAL":
        return variants.choice(*(a.space() for a in args))
    if name.startswith("LINESWAP"):
        return variants.orders([a.space() for a in args if a.raw.strip()])
    most = 2 if name in ("ONCE", "VAR", "INT") else None
    if most and len(args) > most or name == "INT" and len(args) != 2:
        raise ValueError(f"PERM_{name} does not take {len(args)} arguments")
    if name == "ONCE":
        return variants.once(args[0].raw.strip(), args[-1].space())
    if name == "VAR":
        key = args[0].raw.strip()
        return variants.variable(key) if len(args) == 1 else variants.set_variable(key, args[1].space())
    if name == "INT":
        return variants.integer(*(int(a.raw) for a in args))
    inner = variants.combine(*(x for k, a in enumerate(args) for x in ([variants.text(",")] if k else []) + [a.space()]))
    return literal(inner) if name == "IGNORE" else replace(wrapped(name.lower(), inner), random=True) if name == "RANDOMIZE" else wrapped(name.lower(), inner)


def parsed(source: str, auto_random: bool = False) -> Space:
    """The space of a macro text; a text without any choice has one variant. (,) in a macro stands for a comma.

    With auto_random a text of one variant, none of whose code is marked to be randomised, is marked as a whole.

    Raises ValueError for unknown names, brackets that don't match, wrong numbers of arguments, and keys of PERM_ONCE that stand
    at one place only. Names of variables are plain texts. The markers of randomised, same-line and pretended code are this
    module's own.
    """
    open_ = [Frame(None)]
    for token in TOKEN.findall(source):
        top = open_[-1]
        if token.startswith("PERM_") and token.endswith("("):
            if token[5:-1] not in NAMES:
                raise ValueError(f"unknown macro {token[:-1]}")
            open_.append(Frame(token[5:-1]))
        elif token == ")" and top.name is not None and top.level == 0:
            open_.pop()
            raw = f"PERM_{top.name}({top.between().join(a.raw for a in top.args)})"
            open_[-1].args[-1].add(built(top.name, top.args), raw)
        elif token == top.between() and top.level == 0:
            top.args.append(Argument())
        else:
            top.level += {"(": 1, ")": -1}.get(token, 0)
            top.args[-1].add(variants.text("," if token == "(,)" and top.name is not None else token), token)
    if len(open_) > 1:
        raise ValueError(f"PERM_{open_[-1].name} is not closed")
    body = open_[0].args[0].space()
    whole = variants.with_once(body) if body.once else body
    return replace(wrapped("randomize", whole), random=True) if auto_random and whole.size <= 1 and not whole.random else whole


def finished(variants_: DataFrame, key: str, text: str = "variant") -> DataFrame:
    """variants with their marker lines carried out: same-line regions on one line, pretended code dropped, literals decoded.

    A marker leaves an empty line outside of same-line regions. White space at the end becomes one line end. Regions that don't
    match are an error; a null text stays null. key must be unique: a text's lines are joined by it.
    """
    line = F.col("_line")
    order = Window.partitionBy(key).orderBy("_no")

    def depth(name: str) -> Column:
        step = F.when(F.trim(line) == f"#pragma region {name}", 1).when(F.trim(line) == f"#pragma endregion {name}", -1).otherwise(0)
        return F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))

    marker = F.trim(line).rlike("^#pragma (region|endregion|literal) ")
    own = F.when(F.trim(line).startswith("#pragma literal "), F.decode(F.unbase64(F.substring(F.trim(line), 17, 1 << 30)), "UTF-8")).when(marker | (F.col("_dropped") > 0), "").otherwise(line)
    rows = variants_.select(key, F.posexplode(F.split(text, "\n", -1)).alias("_no", "_line"))
    rows = rows.withColumn("_same", depth("force_sameline")).withColumn("_dropped", depth("pretend")).withColumn("_own", own)
    is_open = F.lag((F.col("_same") > 0) & ~F.endswith("_own", F.lit("\n"))).over(order)
    joined = F.when(F.coalesce(is_open, F.lit(False)) & (F.col("_own") != ""), F.concat(F.lit(" "), F.ltrim("_own"))).otherwise(F.col("_own"))
    piece = F.when(F.col("_same") == 0, F.concat("_own", F.lit("\n"))).otherwise(joined)
    last = F.max_by(F.struct("_same", "_dropped"), "_no")
    whole = rows.withColumn("_piece", piece).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_no", "_piece"))).alias("_all"), last.alias("_last"), F.min(F.least("_same", "_dropped")).alias("_least"))
    matched = (F.col("_last._same") == 0) & (F.col("_last._dropped") == 0) & (F.col("_least") >= 0)
    done = F.concat(F.regexp_replace(F.array_join(F.transform("_all", lambda x: x["_piece"]), ""), r"\s+\z", ""), F.lit("\n"))
    out = whole.select(key, F.when(matched, done).otherwise(F.raise_error(F.lit("regions don't match")).cast("string")).alias("_done"))
    return variants_.join(out, key, "left").withColumn(text, F.col("_done")).drop("_done")
