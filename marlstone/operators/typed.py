"""Validation of VARIANT documents: exact key sets, types as JSON has them, nested stages by path.

A specification is a tree of Obj, Arr, Bool, Int, Num, Text and OneOf; `check` gives the violations of a document as
`path: what`, in the specification's order. A boolean is no number, 1.5 no integer, and a key that lacks isn't one that is null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

STRINGS, MAP, LIST = "array<string>", "map<string,variant>", "array<variant>"
#: The counters of a usage report.
COUNTERS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")


@dataclass
class Obj:
    """Exactly these keys; `rules` are (what, holds) of the whole object, asked only where its parts are right."""

    fields: dict[str, object]
    rules: list[tuple[str, Callable[[Column], Column]]] = field(default_factory=list)


@dataclass
class Arr:
    of: object


@dataclass
class Bool:
    pass


@dataclass
class Int:
    least: int = 0


@dataclass
class Num:
    low: float = 0.0
    high: float = 1.0
    places: int = 2


@dataclass
class Text:
    filled: bool = False


@dataclass
class OneOf:
    values: tuple[str, ...]


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, DECIMAL, DOUBLE or VOID (JSON's null); null for what isn't there."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def get(v: Column, path: str, form: str) -> Column:
    return F.try_variant_get(v, path, form)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _one(wrong: Column, path: str, what: str) -> Column:
    return F.when(F.coalesce(wrong, F.lit(True)), F.array(F.lit(f"{path}: {what}"))).otherwise(F.array().cast(STRINGS))


def _unless(found: Column, more: Column) -> Column:
    return let(found, lambda own: F.when(F.size(own) > 0, own).otherwise(more))


def check(v: Column, spec: object, path: str = "$") -> Column:
    """Violations of a VARIANT value, an empty array if it has none. A null column (no document) isn't an object."""
    if isinstance(spec, Bool):
        return _one(kind(v) != "BOOLEAN", path, "not a boolean")
    if isinstance(spec, Int):
        number = get(v, "$", "bigint")
        return F.when(F.coalesce(kind(v) != "BIGINT", F.lit(True)), F.array(F.lit(f"{path}: not an integer"))).otherwise(_one(number < spec.least, path, f"below {spec.least}"))
    if isinstance(spec, Num):
        number = get(v, "$", "double")
        ranged = _one(~number.between(spec.low, spec.high), path, f"not in [{spec.low:g}, {spec.high:g}]")
        placed = _one(F.abs(number - F.bround(number, spec.places)) > 1e-9, path, f"more than {spec.places} places")
        return F.when(F.coalesce(~kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.lit(True)), F.array(F.lit(f"{path}: not a number"))).otherwise(F.concat(ranged, placed))
    if isinstance(spec, Text):
        blank = _one(F.trim(get(v, "$", "string")) == "", path, "blank") if spec.filled else F.array().cast(STRINGS)
        return F.when(F.coalesce(kind(v) != "STRING", F.lit(True)), F.array(F.lit(f"{path}: not a string"))).otherwise(blank)
    if isinstance(spec, OneOf):
        return _one((kind(v) != "STRING") | ~get(v, "$", "string").isin(*spec.values), path, "not a known value")
    if isinstance(spec, Arr):
        inside = lambda items: F.flatten(F.transform(items, lambda x: check(x, spec.of, f"{path}[]")))
        return let(get(v, "$", LIST), lambda items: F.when(items.isNull(), F.array(F.lit(f"{path}: not an array"))).otherwise(inside(items)))
    assert isinstance(spec, Obj)

    def parts(m: Column) -> Column:
        expected, keys = F.array(*map(F.lit, spec.fields)), F.map_keys(m)
        told = lambda names, what: F.transform(names, lambda k: F.concat(F.lit(f"{path}."), k, F.lit(f": {what}")))
        inner = [F.when(F.array_contains(keys, k), check(m[k], of, f"{path}.{k}")).otherwise(F.array().cast(STRINGS)) for k, of in spec.fields.items()]
        return F.concat(told(F.array_except(expected, keys), "missing"), told(F.array_sort(F.array_except(keys, expected)), "unknown"), *inner)

    # only an object is a map: its schema, which spells out all that it holds, isn't asked for
    found = let(get(v, "$", MAP), lambda m: F.when(m.isNull(), F.array(F.lit(f"{path}: not an object"))).otherwise(parts(m)))
    for what, holds in spec.rules:
        found = _unless(found, _one(~holds(v), path, what))
    return found


#: A gate's answer: one that is triggered has a reason.
GATE = Obj({"gate_keeper": Obj({"triggered": Bool(), "reason": Text()}, [("triggered without a reason", lambda v: ~get(v, "$.triggered", "boolean") | (F.trim(get(v, "$.reason", "string")) != ""))])})


def score(categories: dict[str, dict[str, tuple[str, ...]]]) -> Obj:
    """A scoring answer: for each dimension and category cases of known types, and a ratio that is 0 without cases."""
    case = lambda types: Obj({"issue_type": OneOf(types), "location": Text(True), "candidate": Text(True), "reference": Text(True), "affected_count": Int(1)})
    idle = ("a ratio without cases", lambda v: (F.size(get(v, "$.cases", LIST)) > 0) | (get(v, "$.ratio", "double") == 0))
    seen = lambda types: Obj({"cases": Arr(case(types)), "ratio": Num()}, [idle])
    return Obj({"deductions": Obj({d: Obj({c: seen(types) for c, types in own.items()}) for d, own in categories.items()}), "summary_feedback": Text()})


def complete(doc: Column, schema: str, protocol: str, scoring: Obj) -> Column:
    """Whether a result has ended: its final status and what each stage on the way must have given. Never null."""
    text = lambda path: F.coalesce(get(doc, f"$.{path}", "string"), F.lit(""))
    part = lambda path: get(doc, f"$.{path}", "variant")
    done = lambda stage: (kind(part(f"stages.{stage}")) == "OBJECT") & (text(f"stages.{stage}.status") == "complete")

    def gate(stage: str, triggered: bool) -> Column:
        output = f"stages.{stage}.output"
        return done(stage) & (F.size(check(part(output), GATE)) == 0) & (get(doc, f"$.{output}.gate_keeper.triggered", "boolean") == triggered)

    skipped = F.forall(F.map_values(get(doc, "$.stages", MAP)), lambda s: F.coalesce((kind(s) == "OBJECT") & (get(s, "$.status", "string") == "skipped"), F.lit(False)))
    ends = {
        "scored": gate("semantic_gate", False) & gate("render_gate", False) & done("scoring") & (F.size(check(part("stages.scoring.output"), scoring)) == 0),
        "semantic_gate": gate("semantic_gate", True), "render_gate": gate("semantic_gate", False) & gate("render_gate", True),
        "artifact_gate": (kind(part("artifact_gate")) == "BOOLEAN") & get(doc, "$.artifact_gate", "boolean") & skipped,
    }
    ended = F.lit(False)
    for status, holds in ends.items():
        ended = F.when(text("final_status") == status, holds).otherwise(ended)
    head = (text("schema") == schema) & (text("protocol_id") == protocol) & (text("status") == "complete") & part("score").isNull() & (kind(part("stages")) == "OBJECT")
    return F.coalesce(head & ended, F.lit(False))


def usage(doc: Column) -> dict[str, Column]:
    """Counters of a report, with uncached input and total derived; reasoning is part of the output. `error` has what is wrong, and all counters are null then.

    A counter that lacks is 0, as is every one of a null document. Whole numbers count in any spelling (5.0); booleans,
    strings, null and 1.5 don't.
    """
    value = {c: F.when(get(doc, f"$.{c}", "variant").isNull(), F.lit(0).cast("bigint")).otherwise(get(doc, f"$.{c}", "bigint")) for c in COUNTERS}
    wrong = []
    for c in COUNTERS:
        v, number = get(doc, f"$.{c}", "variant"), get(doc, f"$.{c}", "double")
        whole = kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & F.coalesce(number == F.floor(number), F.lit(False))
        wrong.append(F.when(v.isNotNull() & ~whole, F.lit(f"{c}: not an integer")).when(number < 0, F.lit(f"{c}: negative")))
    above = F.when(value["cached_input_tokens"] > value["input_tokens"], F.lit("cached_input_tokens: above input_tokens"))
    found = F.array_compact(F.array(*wrong))
    error = _unless(found, F.array_compact(F.array(above)))
    fine = F.size(error) == 0
    out = {**value, "uncached_input_tokens": value["input_tokens"] - value["cached_input_tokens"], "total_tokens": value["input_tokens"] + value["output_tokens"]}
    return {**{c: F.when(fine, v) for c, v in out.items()}, "error": F.array_join(error, ", ")}
