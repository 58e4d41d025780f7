"""Secret scan: base patterns plus an assignment-aware lexer.

The lexer reads source and configuration syntax (``name = "literal"``,
``name: literal``, ``"name" => 'literal'``, ``a = b + "c"``) into name-literal pairs,
carries constants from name to name, and scores the literals that reach a name by
how sensitive that name is and how little the literal looks like a placeholder.

A constant is kept as shares of its characters and links to its parts, never as text
of its whole length, so the work is linear in a text however constants are doubled.

Scale: one narrow pass over the texts, no shuffle, nothing kept between rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

#: Kinds in the order in which equal starts are listed; ``literal`` is the method's own.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters or more
HEX = re.compile(r"[0-9a-f]{32,}")

#: The score from which a literal is reported.
REPORT = 0.5
#: How sensitive a target is that has all these words in its name.
SENSITIVE = (
    (("password",), 1.0), (("passwd",), 1.0), (("passphrase",), 1.0), (("pwd",), 0.9), (("secret",), 1.0), (("token",), 0.9), (("apikey",), 1.0), (("api", "key"), 1.0),
    (("private", "key"), 1.0), (("access", "key"), 0.9), (("signing", "key"), 0.9), (("encryption", "key"), 0.9), (("credential",), 0.9), (("credentials",), 0.9), (("bearer",), 0.8), (("auth",), 0.7), (("authorization",), 0.8), (("pin",), 0.3), (("salt",), 0.5), (("key",), 0.5),
)

#: Targets whose literals may hold blanks.
PHRASES = ("passphrase", "mnemonic")
#: A placeholder is not longer than this.
SHORT = 256
#: Lengths of values are not told apart beyond this.
LONG = 1e250

_operator = re.compile(r":=|=>|=(?!=)|:(?!//)")
# read backwards from an operator: blanks, closing quotes, the name, and what stands before it
_name_before = re.compile(r"[ \t]*[\"'`\]]*([\w$.\-]*[A-Za-z_$])(?:[ \t]+([\w$]*[A-Za-z_$])[ \t]+(?:rav|tsnoc)\b)?", re.ASCII)
_typed = re.compile(r"[ \t]*[A-Za-z_&][\w.\[\]<>?&']*(?:[ \t]*\|[ \t]*[\w.\[\]<>?&']+)*[ \t]*=(?![=>])", re.ASCII)
_part = re.compile(
    r"""[ \t]*(?:(?:[rbfuRBFU]{0,2})(?:(?P<triple>\"{3}|'{3})(?P<long>.*?)(?P=triple)|(?P<quote>["'`])(?P<text>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote))|(?P<call>[A-Za-z_$][\w$.]*)\(|(?P<name>[A-Za-z_$][\w$.]*)(?=[\s;,)\]}+#]|$)|(?P<bare>[^\s"'`,;(){}\[\]<>#]+))""",
    re.ASCII | re.DOTALL,
)
_argument = re.compile(r"""[^"'`)=:\n]*(?P<quote>["'`])(?P<text>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote)""")
_close = re.compile(r"[^)=:\n]*\)")
_plus = re.compile(r"[ \t]*(?:\+|\.\.|\.(?=[ \t]*[\"']))")
_words = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_placeholder = re.compile(r"^(?:x+|\*+|\.+|<.*>|\$\{.*\}|%.*%|\{\{.*\}\}|\[.*\])$|change.?me|your[_\- ]|(?:^|[\W_])(?:example|placeholder|dummy|sample|todo|redacted)(?:$|[\W_])|^(?:none|null|true|false|undefined)$", re.IGNORECASE)
_variable = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+")


def name_score(name: str) -> float:
    """How sensitive a target name is, from the words of its last part and its path."""
    words = {w.lower() for w in _words.findall(name)}
    return max((s for need, s in SENSITIVE if words.issuperset(need)), default=0.0)


class Value:
    """What a name holds: its distinct characters and their shares, its length, the parts it was
    made of, and its text if that is short.  ``span`` is the literal's own place.

    A value takes some hundred bytes, however long it is and however often it was doubled.
    """

    __slots__ = ("letters", "shares", "size", "text", "span", "parts")

    def __init__(self, letters: str, shares: array, size: float, text: str | None, span: tuple[int, int] | None, parts: tuple):
        self.letters, self.shares, self.size, self.text, self.span, self.parts = letters, shares, size, text, span, parts


def literal(text: str, span: tuple[int, int]) -> Value:
    counts = Counter(text)
    return Value("".join(counts), array("d", (c / len(text) for c in counts.values())), len(text), text if len(text) <= SHORT else None, span, ())


def joined(parts: list[Value]) -> Value:
    if len(parts) == 1:
        return parts[0]
    size = min(sum(p.size for p in parts), LONG)
    total = sum(p.size for p in parts) or 1
    first = parts[0]
    if all(p.letters == first.letters for p in parts):
        letters, shares = first.letters, first.shares
        if any(p.shares is not shares for p in parts):
            shares = array("d", (sum(p.shares[k] * (p.size / total) for p in parts) for k in range(len(letters))))
    else:
        mixed: dict[str, float] = {}
        for p in parts:
            for c, share in zip(p.letters, p.shares):
                mixed[c] = mixed.get(c, 0.0) + share * (p.size / total)
        letters, shares = "".join(mixed), array("d", mixed.values())
        letters = first.letters if letters == first.letters else letters
    return Value(letters, shares, size, "".join(p.text or "" for p in parts) if size <= SHORT else None, None, tuple(parts))


def literal_score(value: Value, blanks: bool = False) -> float:
    """0 to 1: long, varied literals score high; placeholders score 0, and so do those
    with white space unless ``blanks`` are allowed."""
    if value.size < 8 or (not blanks and any(c.isspace() for c in value.letters)) or (value.text is not None and _placeholder.search(value.text)):
        return 0.0
    entropy = -sum(p * math.log2(p) for p in value.shares if p > 0)
    kinds = sum(any(f(c) for c in value.letters) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value.letters)
    return min(1.0, entropy / 3.5) * (1.0 if kinds >= 2 else 0.45)


def lex(text: str) -> list[tuple[str, Value]]:
    """(target name, value) pairs in order, constants propagated.

    The target is the whole name before ``=``, ``:=``, ``:`` or ``=>`` (a type may stand
    between); its value is made of literals, known names and the literals among a
    call's arguments, joined by ``+``.  A value without any literal is its bare word.
    """
    known: dict[str, Value] = {}
    pairs = []
    done, n, back = 0, len(text), None
    for op in _operator.finditer(text):
        if op.start() < done:
            continue
        back = text[::-1] if back is None else back
        before = _name_before.match(back, n - op.start())
        if not before:
            continue
        name = (before[2] or before[1])[::-1]
        at = op.end()
        if op[0] == ":" and (typed := _typed.match(text, at)):
            at = typed.end()
        parts: list[Value] = []
        arguments: list[Value] = []
        bare, quoted = None, False
        while part := _part.match(text, at):
            at = part.end()
            if part["triple"] is not None:
                parts.append(literal(part["long"], part.span("long")))
                quoted = True
            elif part["quote"] is not None:
                parts.append(literal(part["text"], part.span("text")))
                quoted = True
            elif part["call"] is not None:
                while argument := _argument.match(text, at):
                    at = argument.end()
                    if not _variable.fullmatch(argument["text"]):
                        arguments.append(literal(argument["text"], argument.span("text")))
                if not (close := _close.match(text, at)):
                    break
                at = close.end()
            elif part["name"] is not None and part["name"] in known:
                parts.append(known[part["name"]])
                quoted = True
            elif part["name"] is None:
                if not parts and not arguments:
                    bare = literal(part["bare"], part.span("bare"))
                    done = max(done, at)
                break
            elif not parts and bare is None:
                bare = literal(part["name"], part.span("name"))
            if not (more := _plus.match(text, at)):
                break
            at = more.end()
        if quoted:
            done = max(done, at)
        value = joined(parts) if parts else bare if not arguments else None
        if value is not None:
            known[name] = value
            pairs.append((name, value))
        pairs += [(name, a) for a in arguments]
    return pairs


def _uncovered(spans: set[tuple[int, int]], base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of ``spans`` that no span of ``base`` covers, without overlaps."""
    out, at, k, reach = [], 0, 0, 0
    base = sorted(base)
    for a, b in sorted(spans):
        a = max(a, at)
        while a < b:
            while k < len(base) and base[k][0] <= a:
                reach = max(reach, base[k][1])
                k += 1
            if reach > a:
                a = min(reach, b)
                continue
            stop = min(b, base[k][0]) if k < len(base) else b
            out.append((a, stop))
            a = stop
        at = max(at, b)
    return out


def find(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, start and end of the secret itself), by start and kind.

    A literal that a base span covers in part is reported with what is left of it.
    """
    found = []
    named = "=" in text or ":" in text
    if named:
        found += [(m.start(), m.end(), "assign", m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", *m.span()) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", *m.span()) for m in HEX.finditer(text)]
    if named:
        todo = [v for name, v in lex(text) if (weight := name_score(name)) and weight * literal_score(v, any(p in name.lower() for p in PHRASES)) >= REPORT]
        own: set[tuple[int, int]] = set()
        seen: set[int] = set()
        while todo:  # every part once, however often it is used
            v = todo.pop()
            if id(v) not in seen:
                seen.add(id(v))
                todo += v.parts
                if v.span and v.span[1] > v.span[0]:
                    own.add(v.span)
        found += [(a, b, "literal", a, b) for a, b in _uncovered(own, [x[3:] for x in found])]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every secret (not the name before it) replaced by ``mark``."""
    out, at = [], -1
    for a, b in sorted(x[3:] for x in find(text)):
        if a > at:  # what touches the secret before it goes under the same mark
            out += [text[max(at, 0) : a], mark]
        at = max(at, b)
    at = max(at, 0)
    return "".join([*out, text[at:]])


_listed = lambda found: ",".join(f"{k}:{a}:{b}" for a, b, k, *_ in found)


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of every row: counts of the base kinds, digest of base spans, all spans.

    Spans are code points, end exclusive.  Null and empty texts have none (the digest
    is then that of the empty string).  Repeated rows are scanned each; an empty table
    gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [find(t) for t in batch.column("text").to_pylist()]
            count = lambda kind: pa.array([sum(x[2] == kind for x in r) for r in rows], pa.int64())
            base = [_listed(x for x in r if x[2] != "literal") for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), count("assign"), count("access"), count("hex"), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()), pa.array([_listed(r) for r in rows], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced (``n_chars`` follows); null texts stay null."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([t and redact(t) for t in batch.column("text").to_pylist()], pa.string())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", text)

    from pyspark.sql import functions as F

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
