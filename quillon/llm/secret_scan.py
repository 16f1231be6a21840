"""Secret scans: fixed patterns, and lexed assignments to sensitive names.

Base spans come from three patterns over the whole text. The lexer then reads source
and configuration syntax into pairs of a name and a literal:

* `name = x`, `name := x`, `name => x`, `name += x`, `"name": x`, `map["name"] = x`, `name[8] = x`;
* with a type, `name: str = "x"`, `let name: string = "x"`, `var name string = "x"`;
* `#define NAME x`.

A literal is quoted by `"`, `'`, a backtick or three quotes, also with a prefix as in f"x" or
@"x", on the same line or after a bracket on a later one. Literals joined by an operator (also
across lines) or standing side by side are one value; a name in it that stands for a constant
gives that constant's value, others nothing. Names given to other names propagate constants in
reading order. A value without quotes that names no known constant, as in .env, YAML,
properties and INI files, is a literal up to white space or a comma, less the closing marks at
its end; calls, subscripts, dotted names and values that open a bracket or quote are code. A
literal's score comes from the target names it reaches (by the words in them) and from its own
shape: length, character classes, entropy; placeholders and references to variables lose.
Literals that reach LEAST add a span of kind "literal", unless a base span already covers them.

A null or empty text has no spans. Offsets are code points, ends exclusive. Spans that start at
one place are ordered as the kinds are listed. Every row is scanned on its own: repeated rows
give equal results, empty tables an empty one. scan() keeps extra columns of any name, but one
named like its output is replaced. All patterns start at the first character of a run and never
look back into it, so long texts take linear time. Joined constants share what they hold, so
no piece of one is left out. Assignments within an unquoted value are read too, however long it
is, unless it counts as a secret itself; a value within another is counted from what is kept
of the other, not read again.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import for_python, table

# Fixed values of the base patterns: kind, pattern, least length, group it holds for.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 or more
KINDS = ("assign", "access", "hex", "literal")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20

#: Text without any of these (in any case) has no base assignment.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words of a name and how strongly they mark its value as secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.8,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.5, "authorization": 0.6, "bearer": 0.6,
}
#: Words that make a secret of a following "key".
KEY_OF = {"api", "private", "secret", "access", "signing", "encryption", "master", "auth", "account"}
#: Text without any of these (in any case) has no sensitive name.
STEMS = (*SENSITIVE, "key")
#: Words after which a sensitive word names something harmless.
HARMLESS = {"count", "limit", "length", "len", "max", "min", "id", "type", "name", "url", "file", "path", "field", "expires"}
PLACEHOLDER = re.compile(r"(?i)\A(?:x{3,}|\*{3,}|change_?me|example.*|your.*|todo|none|null|true|false|\.{3,}|<.*>|\$\{?.*|%\(?.*|\{\{.*)\Z", re.ASCII)
LEAST = 1.0

NAME = r"(?<![A-Za-z0-9_.\-])[A-Za-z_][A-Za-z0-9_.\-]*+"
QUOTED = r"(?:[rRbBuUfFL]{1,2}|u8|[@$]{1,2})?+[\"'`]"
#: A type between a name and a quoted value.
TYPED = rf""":[\x20\t]*+[A-Za-z_][A-Za-z0-9_.]*+(?:\[[A-Za-z0-9_.,\x20]*+\]|<[A-Za-z0-9_.,\x20]*+>)?+
    (?:[\x20\t]*+[|?][\x20\t]*+[A-Za-z_]*+)?+[\x20\t]*+=(?=[\x20\t]*+(?:\(\s*+)?+{QUOTED})"""
PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])(?:var|const|let)[\x20\t]++([A-Za-z_][A-Za-z0-9_]*+)[\x20\t]++([A-Za-z_][A-Za-z0-9_.]*+)[\x20\t]*+=(?![=>])[\x20\t]*+
    | \#[\x20\t]*+define[\x20\t]++([A-Za-z_][A-Za-z0-9_]*+)[\x20\t]++(?=[^\x20\t\r\n])
    | ({NAME})(?:\[[0-9]*+\])?+["']?[\x20\t]*+\]?+[\x20\t]*+(?:{TYPED}|:=|=>|(\+=)|=(?!=)|:(?!:))[\x20\t]*+""",
    re.X,
)
#: The text of a literal is in the one group that takes part.
LITERAL = re.compile(
    r"""(?:[rRbBuUfFL]{1,2}|u8|[@$]{1,2})?+(?:
    \"\"\"((?:[^"\\]|\\.|"(?!""))*+)\"\"\" | \'\'\'((?:[^'\\]|\\.|'(?!''))*+)\'\'\'
    | "((?:[^"\\\n]|\\[^\n])*+)" | '((?:[^'\\\n]|\\[^\n])*+)' | `((?:[^`\\]|\\.)*+)`)""",
    re.X | re.S,
)
#: What may stand before the first literal of a value, and between two.
OPENING = re.compile(r"\((?:\s|\\\n)*+|\\\r?\n[\x20\t]*+")
JOIN = re.compile(r"(?:\s|\\\n)*+(?:\+|\.\.?|&)(?:\s|\\\n)*+")
BESIDE, BELOW = re.compile(r"[\x20\t]*+(?:\\\r?\n[\x20\t]*+)?"), re.compile(r"(?:\s|\\\n)*+")
REFERENCE = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+(?![\-(\"'`])")
BARE = re.compile(r"[^\s,]++")
#: Ends of bare values that belong to what is around them, and bare values that are code.
CLOSING = ";)]}>\"'`"
CODE = re.compile(r"[\"'`(\[{]|[A-Za-z_][A-Za-z0-9_.]*+[(\[]|[A-Za-z_]++(?:\.[A-Za-z_]++)++\Z")
#: Characters of a run without white space between two places whose counts are kept, at least.
STEP = 512
#: So much of a literal's start and its last character are held against PLACEHOLDER; what
#: they can't tell of a longer one comes from its counts.
HEAD = 64
#: What placeholders of one repeated character repeat; all others may be of any length.
REPEATED = "xX*."
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, start of the value, its end), by start, then kind as listed."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_ASSIGNED:
                found.append((m.start(), m.end(), "assign", m.start(2), m.end(2)))
    if "AKIA" in text:
        found += [(*m.span(), "access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(*m.span(), "hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def name_score(name: str) -> float:
    """How strongly a target name marks its value as secret, from 0 to 1."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    best = max(SENSITIVE.get(w, 0.0) for w in words)
    for before, word in zip(words, words[1:]):
        if word == "key" and before in KEY_OF:
            best = 1.0
    return best


class Run:
    """Characters without white space, whose ends are the bare values within it."""

    __slots__ = ("text", "stop", "places", "kept")

    def __init__(self, text: str, stop: int):
        self.text, self.stop = text, stop
        self.places, self.kept = [-stop], [Counter()]  # places are negative, so that they ascend

    def counts(self, at: int) -> Counter:
        """How often each character stands from a place to the end."""
        while True:
            # kept counts hold less than the text does, however many characters there are
            before = -self.places[-1] - max(STEP, 8 * len(self.kept[-1]))
            if before < at:
                break
            more = self.kept[-1].copy()
            more.update(self.text[before : -self.places[-1]])
            self.places.append(-before)
            self.kept.append(more)
        i = bisect.bisect_right(self.places, -at) - 1
        found = self.kept[i].copy()
        found.update(self.text[at : -self.places[i]])
        return found


class Value:
    """A literal, or several joined: what its score needs and what it was joined from."""

    __slots__ = ("counts", "n", "head", "last", "lead", "tail", "inner", "seen", "span", "parts", "reached", "run")

    def __init__(self, text: str, start: int):
        self.counts, self.n, self.head, self.last = Counter(text), len(text), text[:HEAD], text[-1:]
        core = text.strip()
        self.seen, self.inner = bool(core), " " in core
        self.lead = " " in text[: len(text) - len(text.lstrip())]
        self.tail = " " in text[len(text.rstrip()) :]
        self.span, self.parts, self.reached, self.run = (start, start + len(text), False), (), False, None

    @classmethod
    def bare(cls, run: Run, at: int) -> Value:
        """The value without quotes from a place to the run's end; it holds no white space."""
        new, stop = object.__new__(cls), run.stop
        new.counts, new.n, new.head, new.last = None, stop - at, run.text[at : min(stop, at + HEAD)], run.text[stop - 1]
        new.seen, new.inner, new.lead, new.tail = True, False, False, False
        new.span, new.parts, new.reached, new.run = (at, stop, True), (), False, run
        return new

    def tally(self) -> Counter:
        """How often each character occurs; counted when asked for without quotes."""
        return self.counts if self.run is None else self.run.counts(self.span[0])

    def __add__(self, other: Value) -> Value:
        new = object.__new__(Value)
        new.counts, new.n, new.run = self.tally() + other.tally(), self.n + other.n, None
        new.head, new.last = (self.head + other.head)[:HEAD] if self.n < HEAD else self.head, other.last or self.last
        new.seen = self.seen or other.seen
        # spaces around the whole don't count, those between its words do
        new.inner = self.inner or other.inner or (self.seen and other.seen and (self.tail or other.lead))
        new.lead = self.lead if self.seen else self.lead or other.lead
        new.tail = other.tail if other.seen else self.tail or other.tail
        new.span, new.parts, new.reached = None, (self, other), False
        return new

    def placeholder(self) -> bool:
        """Whether PLACEHOLDER fits the whole of it."""
        if self.n <= HEAD:
            return bool(PLACEHOLDER.match(self.head))
        if not PLACEHOLDER.match(self.head + self.last):
            return False
        if self.head[0] in REPEATED:
            return len({c.lower() for c in self.tally()}) == 1
        return self.run is not None or "\n" not in self.counts

    def score(self) -> float:
        """How much the literal looks like a secret, from -1 to 1."""
        if self.n < 6 or self.inner or self.placeholder():
            return -1.0
        counts = self.tally()
        kinds = {0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in counts}
        # summed exactly, so that the order in which the characters were counted is of no account
        entropy = -math.fsum(c / self.n * math.log2(c / self.n) for c in counts.values())
        return 0.1 * min(len(kinds), 3) + 0.1 * min(entropy, 5.0) + (0.2 if self.n >= 12 else 0.0)

    def reach(self) -> list[tuple[int, int, bool]]:
        """The spans of all literals in it that no call returned before."""
        found, open_ = [], [self]
        while open_:
            one = open_.pop()
            if not one.reached:
                one.reached = True
                open_ += one.parts
                if one.span:
                    found.append(one.span)
        return found


def _read(text: str, at: int, constants: dict) -> tuple[Value | None, Value | None, int]:
    """The quoted value that starts at a place, its literals before any stands beside another, and its end."""
    opening = OPENING.match(text, at)
    within = bool(opening) and opening.group()[0] == "("
    at = opening.end() if opening else at
    whole = alone = None
    beside = False
    while True:
        if literal := LITERAL.match(text, at):
            group = literal.lastindex
            part, at = Value(literal.group(group), literal.start(group)), literal.end()
        elif not beside and (reference := REFERENCE.match(text, at)):
            part, at = constants.get(reference.group()), reference.end()
        else:
            break
        if part is not None:
            whole = part if whole is None else whole + part
        if not beside:
            alone = whole
        if join := JOIN.match(text, at):
            at, beside = join.end(), False
        elif literal:
            gap = (BELOW if within else BESIDE).match(text, at)
            if not LITERAL.match(text, gap.end()):
                break
            at, beside = gap.end(), True
        else:
            break
    return whole, alone, at


def lexed_spans(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether without quotes) of literals that reach a sensitive name."""
    constants: dict[str, Value] = {}
    spans: set[tuple[int, int, bool]] = set()
    end = stop = past = 0
    run = None
    for pair in PAIR.finditer(text):
        # of `const one two =` either may be the name, by language
        names, at = [n for n in pair.group(1, 2, 3, 4) if n], pair.end()
        if pair.start() < past:
            continue
        whole, alone, _ = _read(text, at, constants)
        bare = False
        if whole is None:
            if at >= end and (m := BARE.match(text, at)):
                end = stop = m.end()
                while stop > at and text[stop - 1] in CLOSING:
                    stop -= 1
                run = Run(text, stop)
            bare = at < stop and not CODE.match(text, at, stop)
            if not bare:
                if not pair.group(5):
                    for name in names:
                        constants.pop(name, None)
                continue
            whole = alone = Value.bare(run, at)
        named = max(map(name_score, names))
        if pair.group(5) and (before := constants.get(names[0])) is not None:
            whole, alone = before + whole, before + alone
        for name in names:
            constants[name] = whole
        if named <= 0:
            continue
        for value in (whole, alone):
            if named + value.score() >= LEAST:
                spans.update(value.reach())
                past = stop if bare else past
                break
    return sorted(spans)


def find(text: str | None) -> list[dict]:
    """All spans of a text, base ones and added ones."""
    if not text:
        return []
    base = base_spans(text)
    spans = [{"kind": k, "start": a, "end": b, "from": c, "to": d} for a, b, k, c, d in base]
    low = text.lower()
    if any(s in low for s in STEMS):
        at = reach = 0
        for a, b, bare in lexed_spans(text):
            while at < len(base) and base[at][0] <= a:
                reach, at = max(reach, base[at][1]), at + 1
            # beyond a base span, a sentence's end is no part of a value without quotes
            if b > a and b > reach and not (bare and reach > a and not text[reach:b].strip(".!?:")):
                spans.append({"kind": "literal", "start": a, "end": b, "from": a, "to": b})
        spans.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
    return spans


SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType())]
        + [T.StructField(n, T.IntegerType()) for n in ("start", "end", "from", "to")]
    )
)
_SPANS = pa.list_(
    pa.struct([("kind", pa.string())] + [(n, pa.int32()) for n in ("start", "end", "from", "to")])
)


def redacted(text: str, spans: list[dict], mark: str = "[SECRET]") -> str:
    """text with the values of all spans replaced."""
    out, at = [], 0
    for a, b in sorted((s["from"], s["to"]) for s in spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, keep: list[str] | None = None, redact: bool = False, name: str = "found_spans") -> DataFrame:
    """docs (the columns of keep, all by default) with the spans under name.

    With redact, text has the values replaced instead, and n_chars follows it if present.
    """
    keep = docs.columns if keep is None else keep
    if not redact:
        keep = [c for c in keep if c.lower() != name.lower()]
    schema = T.StructType([docs.schema[c] for c in keep])
    if not redact:
        schema = schema.add(name, SPANS)
    fields = len(keep)

    def run(batches):
        for batch in batches:
            texts = batch.column(fields).to_pylist()
            found = [find(t) for t in texts]
            columns = {c: batch.column(i) for i, c in enumerate(keep)}
            if redact:
                clean = [redacted(t, s) if s else t for t, s in zip(texts, found)]
                columns["text"] = pa.array(clean, pa.string())
                if "n_chars" in columns:
                    old = columns["n_chars"].to_pylist()
                    new = [len(c) if s else n for c, s, n in zip(clean, found, old)]
                    columns["n_chars"] = pa.array(new, columns["n_chars"].type)
            else:
                columns[name] = pa.array(found, _SPANS)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return for_python(docs.select(*keep, F.col("text").alias("__qn_scanned"))).mapInArrow(run, schema)


def op7_secret_scan(spark, sf_dir):
    """Span counts and digests of every document; see the module for odd rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("found_spans")
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] != "literal")
    return scan(docs, ["doc_id"]).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, one), ",").alias("spans"),
    )
