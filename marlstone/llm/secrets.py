"""Secret scans: every rule in one pass over a text's bytes, by one minimal deterministic automaton."""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.automaton import Dfa, Parser, backwards, compile_rules
from marlstone.llm.common import give_back, map_batches, table


@dataclass(frozen=True)
class Rule:
    """`least` is the fewest characters of group `group` (0: the match); shorter matches are used up and dropped."""

    kind: str
    pattern: str
    fold: bool = False
    group: int = 0
    least: int = 0


#: The contract's three kinds, in its order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: A heading and its key: base64, white space (escaped too), header fields and single dashes. Every prefix of a line of
#: dashes and capitals matches, so that a match goes on to the END line; without one it ends with such characters. A
#: heading inside a key that has no END line belongs to the match.
HEADING = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
PRIVATE_KEY = rf"({HEADING}(-{{0,4}}[A-Za-z0-9+/=:,\\\x09-\x0D\x20])*)+(-(-(-(-(-[A-Z ]*(-(-(-(-(-)?)?)?)?)?)?)?)?)?)?"
#: Public formats of issued credentials.
MORE = (
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]+", False, 0, 40),
    Rule("cloud", r"AIza[0-9A-Za-z_-]+", False, 0, 39),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]+", False, 0, 15),
    Rule("payment", r"[rs]k_live_[0-9A-Za-z]+", False, 0, 24),
    Rule("private_key", PRIVATE_KEY),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 40),
)
RULES = BASE + MORE


class Scanner:
    """Matches of every rule, leftmost and non-overlapping within a rule.

    The forward automaton runs once over the bytes and tells where matches of which rules end; a rule's reversed
    automaton then walks back from an end to the leftmost start behind the rule's previous match.
    """

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        nodes = [Parser(r.pattern, r.fold).parse() for r in rules]
        self.forward: Dfa = compile_rules(nodes)
        self.back = [compile_rules([backwards(n)], anywhere=False) for n in nodes]
        self.exact = [re.compile(r.pattern.encode(), re.I if r.fold else 0) for r in rules]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(rule, end) of each stretch of bytes at which the rule accepts, by end."""
        dfa = self.forward
        go, bar, width, masks = dfa.table, dfa.accept, dfa.width, dfa.masks
        found, open_ = [], 0
        s = dfa.start
        for i, c in enumerate(data.translate(dfa.classes)):
            s = go[s + c]
            if s >= bar or open_:
                now = masks[s // width] if s >= bar else 0
                if closed := open_ & ~now:
                    found += [(r, i) for r in range(len(self.rules)) if closed >> r & 1]
                open_ = now
        return found + [(r, len(data)) for r in range(len(self.rules)) if open_ >> r & 1]

    def start(self, rule: int, data: bytes, least: int, end: int) -> int:
        dfa = self.back[rule]
        s, best = dfa.start, -1
        for i in range(end - 1, least - 1, -1):
            s = dfa.table[s + dfa.classes[data[i]]]
            if s >= dfa.accept:
                best = i
            elif s == self.dead(rule):
                break
        return best

    def dead(self, rule: int) -> int:
        dfa = self.back[rule]
        if not hasattr(self, "_dead"):
            self._dead: dict[int, int] = {}
        if rule not in self._dead:
            w = dfa.width
            self._dead[rule] = next((s for s in range(0, dfa.accept, w) if set(dfa.table[s : s + w]) == {s}), -1)
        return self._dead[rule]

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, sorted; a null text has none."""
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        found, last = [], [0] * len(self.rules)
        for rule, end in self.ends(data):
            start = self.start(rule, data, last[rule], end)
            if start < 0:
                continue
            last[rule] = end
            if least := self.rules[rule].least:
                m = self.exact[rule].match(data, start, end)
                if m is None or len(m[self.rules[rule].group]) < least:
                    continue
            found.append((start, rule, end))
        found.sort()
        if len(data) != len(text):
            at = points(data, [x for s, _, e in found for x in (s, e)])
            found = [(at[s], r, at[e]) for s, r, e in found]
        return found


@lru_cache(maxsize=4)
def scanner_for(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once a driver; a task gets the transition arrays, not the rules."""
    return Scanner(rules)


@lru_cache(maxsize=4)
def shipped(rules: tuple[Rule, ...]):
    """A function that gives a task its scanner; what travels, and all that the driver keeps, is an array of machine integers."""
    made = Scanner(rules)
    parts = (made.rules, made.back, array("i", made.forward.table), Dfa(**{**made.forward.__dict__, "table": []}))
    del made
    gc.collect()
    give_back()

    def open_() -> Scanner:
        out = Scanner.__new__(Scanner)
        out.rules, out.back, flat, out.forward = parts
        out.forward.table = flat.tolist()
        out.exact = [re.compile(r.pattern.encode(), re.I if r.fold else 0) for r in out.rules]
        return out

    return open_


def points(data: bytes, offsets: list[int]) -> dict[int, int]:
    """Byte offsets as code points."""
    out, at, n = {}, 0, 0
    for x in sorted(set(offsets)):
        n += len(data[at:x].decode("utf-8", "surrogatepass"))
        at, out[x] = x, n
    return out


def joined(spans, rules) -> str:
    return ",".join(f"{rules[r].kind}:{s}:{e}" for s, r, e in spans)


def find_secrets(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: the keys, `spans` array<struct<kind,start,end>> (code points, end exclusive), sorted by start.

    A null or empty text has no spans; rows are independent, so repeated rows repeat their result and an empty
    table gives an empty one. Other columns, whatever their names, are not read.
    """
    load = shipped(rules)

    def make():
        scanner = load()

        def step(x: dict) -> dict:
            found = [[{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in scanner.spans(t)] for t in x["__text"]]
            return {**{k: x[k] for k in keys}, "spans": found}

        return step

    schema = ", ".join([*[f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys], "spans array<struct<kind:string,start:bigint,end:bigint>>"])
    return map_batches(docs.select(*keys, F.col(text).alias("__text")), make, schema)


def mask_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns with every secret of `text` replaced by `[kind]`; overlapping spans become one.

    A null text stays null.
    """
    load, names = shipped(rules), docs.columns

    def clean(scanner: Scanner, t: str | None) -> str | None:
        spans = scanner.spans(t)
        if not spans:
            return t
        out, at = [], 0
        for s, r, e in spans:
            if s >= at:
                out += [t[at:s], f"[{rules[r].kind}]"]
            at = max(at, e)
        return "".join([*out, t[at:]])

    def make():
        scanner = load()
        return lambda x: {n: [clean(scanner, t) for t in x[n]] if n == text else x[n] for n in names}

    return map_batches(docs, make, docs.schema)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest over every document: counts of the base kinds, their hash, and all spans."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    return digest(found)


def digest(found: DataFrame) -> DataFrame:
    def line(x):
        return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))

    base = F.filter("spans", lambda x: x["kind"].isin(*[r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(r.kind) for r in BASE],
        F.sha2(F.concat_ws(",", F.transform(base, line)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", line)).alias("spans"),
    )


def brute_force(text: str | None) -> tuple:
    """The contract's base digest by plain regular expressions; for tests."""
    text, spans = text or "", []
    for i, (kind, pattern, least) in enumerate((("assign", BASE[0].pattern, 8), ("access", BASE[1].pattern, 16), ("hex", "[0-9a-f]+", 32))):
        for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                spans.append((m.start(), i, kind, m.end()))
    spans.sort()
    said = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
    return (*[sum(x[2] == k for x in spans) for k in ("assign", "access", "hex")], hashlib.sha256(said.encode()).hexdigest())
