"""Chat formatting by a compiler for a small, sandboxed template language.

A template is cut into tokens, parsed into a syntax tree, its constants folded, and compiled to Python closures. The
language has text, {{ expression }}, {% for x in y %}, {% if %} / {% elif %} / {% else %}, {% set %} and
{% generation %}, whose output is what a model is trained on. Expressions have literals, names, keys of messages by a
dot, loop.first, loop.last, loop.index0, comparisons, and, or, not, in, ~ and filters of a fixed table: no call, no
attribute of an object, no import.

A conversation is rendered as a stream of turns, so that one of any length needs little memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Marks every turn; escapes roles and texts, so that no text can hold a mark.
TEMPLATE = """{%- set open = '<|im_start' ~ '|>' -%}
{%- for message in messages -%}
{{ open }}{{ message.role | escape_line }}
{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %}<|im_end|>
{% endfor -%}"""


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """No <| is left; unescape() undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    """The same on one line."""
    return escape(text).replace("\n", "\\n")


ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(as_string(x)),
    "escape_line": lambda x: escape_line(as_string(x)),
    "trim": lambda x: as_string(x).strip(),
    "upper": lambda x: as_string(x).upper(),
    "lower": lambda x: as_string(x).lower(),
    "length": lambda x: len(x) if isinstance(x, str) else 0,
}


def as_string(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else "true" if x is True else "false" if x is False else str(x)


# The syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: str


@dataclass(frozen=True)
class Apply:
    filter: str
    to: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass
class Output:
    of: Any


@dataclass
class Assign:
    name: str
    to: Any


@dataclass
class Loop:
    name: str
    over: Any
    body: list


@dataclass
class Branch:
    cases: list[tuple[Any, list]] = field(default_factory=list)


@dataclass
class Generation:
    body: list


PART = re.compile(r"\{([{%#])(-?)(.*?)(-?)[}%#]\}", re.S)
WORD = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[~|.()=+]))""", re.S)
LITERALS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
#: Binding strength of binary operators.
STRENGTH = {"or": 1, "and": 2, "==": 4, "!=": 4, "in": 4, "~": 5, "+": 5}
OPERATE: dict[str, Callable[[Any, Any], Any]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: isinstance(b, str) and as_string(a) in b, "~": lambda a, b: as_string(a) + as_string(b), "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else as_string(a) + as_string(b)}


class Expression:
    """Parser by precedence of one expression."""

    def __init__(self, text: str):
        self.words, at = [], 0
        text = text.strip()
        while at < len(text):
            if not (m := WORD.match(text, at)):
                raise TemplateError(f"can't read {text[at:]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def next(self) -> tuple[str | None, str]:
        return self.words[self.at] if self.at < len(self.words) else (None, "")

    def take(self, value: str | None = None) -> tuple[str | None, str]:
        kind, word = self.next()
        if kind is None or value is not None and word != value:
            raise TemplateError(f"{value or 'a word'} is missing")
        self.at += 1
        return kind, word

    def all(self) -> Any:
        out = self.binary(0)
        if self.at < len(self.words):
            raise TemplateError(f"{self.next()[1]!r} is too much")
        return out

    def binary(self, least: int) -> Any:
        left = self.unary()
        while (op := self.next()[1]) in STRENGTH and self.next()[0] in ("op", "name") and STRENGTH[op] > least:
            self.take()
            left = Binary(op, left, self.binary(STRENGTH[op]))
        return left

    def unary(self) -> Any:
        if self.next() == ("name", "not"):
            self.take()
            return Not(self.binary(3))
        kind, word = self.take()
        if kind == "string":
            out: Any = Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1], flags=re.S))
        elif kind == "number":
            out = Const(int(word))
        elif kind == "name":
            out = Const(LITERALS[word]) if word in LITERALS else Name(word)
        elif word == "(":
            out = self.binary(0)
            self.take(")")
        else:
            raise TemplateError(f"{word!r} begins no expression")
        while (op := self.next()[1]) in (".", "|") and self.next()[0] == "op":
            self.take()
            kind, word = self.take()
            if kind != "name" or word.startswith("_"):
                raise TemplateError(f"{word!r} is no name")
            if op == "|" and word not in FILTERS:
                raise TemplateError(f"no filter {word!r}")
            out = Key(out, word) if op == "." else Apply(word, out)
        return out


def parse(source: str) -> list:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in PART.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        parts += [("text", text.rstrip() if m[2] else text)]
        if m[1] != "#":
            parts.append(({"{": "output", "%": "tag"}[m[1]], m[3].strip()))
        at, strip = m.end(), bool(m[4])
    parts.append(("text", source[at:].lstrip() if strip else source[at:]))
    place = 0

    def block(*ends: str) -> tuple[list, str]:
        nonlocal place
        out: list = []
        while place < len(parts):
            kind, text = parts[place]
            place += 1
            if kind == "text":
                if text:
                    out.append(Output(Const(text)))
            elif kind == "output":
                out.append(Output(Expression(text).all()))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return out, text
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.*)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"can't read {text!r}")
                    out.append(Loop(m[1], Expression(m[2]).all(), block("endfor")[0]))
                elif word == "if":
                    branch, test = Branch(), Expression(rest).all()
                    while True:
                        body, end = block("elif", "else", "endif")
                        branch.cases.append((test, body))
                        if end == "endif":
                            break
                        test = Expression(end[4:]).all() if end.startswith("elif") else Const(True)
                    out.append(branch)
                elif word == "set":
                    name, _, value = rest.partition("=")
                    if not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                        raise TemplateError(f"can't read {text!r}")
                    out.append(Assign(name.strip(), Expression(value).all()))
                elif word == "generation":
                    out.append(Generation(block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown or misplaced tag {text!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    return block()[0]


def fold(node: Any, known: dict[str, Any]) -> Any:
    """The expression with its constant parts worked out; known: names that hold constants."""
    match node:
        case Name(name) if name in known:
            return Const(known[name])
        case Key(of, key):
            return Key(fold(of, known), key)
        case Apply(name, to):
            to = fold(to, known)
            return Const(FILTERS[name](to.value)) if isinstance(to, Const) else Apply(name, to)
        case Not(of):
            of = fold(of, known)
            return Const(not of.value) if isinstance(of, Const) else Not(of)
        case Binary(op, left, right):
            left, right = fold(left, known), fold(right, known)
            if isinstance(left, Const) and op in ("and", "or"):
                return right if bool(left.value) == (op == "and") else left
            if isinstance(left, Const) and isinstance(right, Const):
                return Const(OPERATE[op](left.value, right.value))
            return Binary(op, left, right)
    return node


def assigned(nodes: list) -> dict[str, int]:
    """How often each name is set, anywhere."""
    out: dict[str, int] = {}
    for x in nodes:
        if isinstance(x, Assign):
            out[x.name] = out.get(x.name, 0) + 1
        inner = [x.body] if isinstance(x, Loop | Generation) else [b for _, b in x.cases] if isinstance(x, Branch) else []
        if isinstance(x, Loop):
            out[x.name] = out.get(x.name, 0) + 2
        for body in inner:
            for name, n in assigned(body).items():
                out[name] = out.get(name, 0) + n
    return out


def folded(nodes: list, known: dict[str, Any] | None = None, times: dict[str, int] | None = None) -> list:
    """The tree with constants folded: branches decided, texts joined, names set once to a constant replaced."""
    top = times is None
    times = assigned(nodes) if times is None else times
    known = {} if known is None else known
    out: list = []
    for x in nodes:
        if isinstance(x, Output):
            of = fold(x.of, known)
            if isinstance(of, Const):
                of = Const(as_string(of.value))
                if not of.value:
                    continue
            out.append(Output(of))
        elif isinstance(x, Assign):
            to = fold(x.to, known)
            if top and isinstance(to, Const) and times[x.name] == 1:
                known[x.name] = to.value
            else:
                out.append(Assign(x.name, to))
        elif isinstance(x, Loop):
            out.append(Loop(x.name, fold(x.over, known), folded(x.body, known, times)))
        elif isinstance(x, Generation):
            out.append(Generation(folded(x.body, known, times)))
        else:
            cases: list = []
            for test, body in x.cases:
                test = fold(test, known)
                if isinstance(test, Const) and not test.value:
                    continue
                cases.append((test, folded(body, known, times)))
                if isinstance(test, Const):
                    break
            if cases and isinstance(cases[0][0], Const):
                out += cases[0][1]
            elif cases:
                out.append(Branch(cases))
    joined: list = []
    for x in out:
        if joined and all(isinstance(y, Output) and isinstance(y.of, Const) for y in (joined[-1], x)):
            x = Output(Const(joined.pop().of.value + x.of.value))
        joined.append(x)
    return joined


# Closures

Scope = dict[str, Any]


def compiled_expression(node: Any) -> Callable[[Scope], Any]:
    match node:
        case Const(value):
            return lambda s: value
        case Name(name):
            return lambda s: s.get(name)
        case Key(of, key):
            inner = compiled_expression(of)
            return lambda s: x.get(key) if isinstance(x := inner(s), dict) else None
        case Apply(name, to):
            f, inner = FILTERS[name], compiled_expression(to)
            return lambda s: f(inner(s))
        case Not(of):
            inner = compiled_expression(of)
            return lambda s: not inner(s)
        case Binary(op, left, right):
            a, b = compiled_expression(left), compiled_expression(right)
            if op == "and":
                return lambda s: a(s) and b(s)
            if op == "or":
                return lambda s: a(s) or b(s)
            f = OPERATE[op]
            return lambda s: f(a(s), b(s))
    raise TemplateError(f"can't compile {node!r}")


def with_loop(items: Iterable) -> Iterator[tuple[Any, dict]]:
    """Each item with its loop variables; looks one item ahead, no more."""
    it = iter(items)
    item = next(it, it)
    at = 0
    while item is not it:
        after = next(it, it)
        yield item, {"first": at == 0, "last": after is it, "index0": at}
        item, at = after, at + 1


def compiled(nodes: list) -> Callable[[Scope, bool], Iterator[tuple[str, bool]]]:
    """A closure that gives the output as (text, whether it is generated), ever a part at a time."""
    steps = [compiled_node(x) for x in nodes]

    def run(scope: Scope, generated: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(scope, generated)

    return run


def compiled_node(node: Any) -> Callable[[Scope, bool], Iterator[tuple[str, bool]]]:
    if isinstance(node, Output):
        value = compiled_expression(node.of)

        def output(scope: Scope, generated: bool) -> Iterator[tuple[str, bool]]:
            yield as_string(value(scope)), generated

        return output
    if isinstance(node, Assign):
        value, name = compiled_expression(node.to), node.name

        def assign(scope: Scope, generated: bool) -> Iterator[tuple[str, bool]]:
            scope[name] = value(scope)
            return iter(())

        return assign
    if isinstance(node, Generation):
        body = compiled(node.body)
        return lambda scope, generated: body(scope, True)
    if isinstance(node, Branch):
        cases = [(compiled_expression(test), compiled(body)) for test, body in node.cases]

        def branch(scope: Scope, generated: bool) -> Iterator[tuple[str, bool]]:
            for test, body in cases:
                if test(scope):
                    return body(scope, generated)
            return iter(())

        return branch
    over, body, name = compiled_expression(node.over), compiled(node.body), node.name

    def loop(scope: Scope, generated: bool) -> Iterator[tuple[str, bool]]:
        items = over(scope)
        if items is None or isinstance(items, str | int):
            return
        outer = scope.get("loop")
        for item, now in with_loop(items):
            scope[name], scope["loop"] = item, now
            yield from body(scope, generated)
        scope["loop"] = outer

    return loop


class ChatTemplate:
    """A compiled template. parts() streams (text, generated); render() gives the whole text and the generated spans."""

    def __init__(self, source: str = TEMPLATE):
        self.tree = folded(parse(source))
        self.program = compiled(self.tree)

    def parts(self, messages: Iterable[dict]) -> Iterator[tuple[str, bool]]:
        return self.program({"messages": messages}, False)

    def render(self, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
        out, spans, at = [], [], 0
        for text, generated in self.parts(messages):
            out.append(text)
            if generated and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            at += len(text)
        return "".join(out), spans


class ReadBack:
    """Takes formatted text apart again, as it comes: feed() gives the turns (role, text) that are complete."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        while (end := self.rest.find(END + "\n")) >= 0:
            turn, self.rest = self.rest[:end], self.rest[end + len(END) + 1 :]
            if not turn.startswith(START):
                raise ValueError("a turn has no start")
            role, _, body = turn[len(START) :].partition("\n")
            yield unescape(role), unescape(body)

    def close(self) -> None:
        if self.rest:
            raise ValueError("a turn has no end")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """The turns of each conversation in one partition and in order; Spark sorts on disk what memory doesn't hold."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def turns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conv_id, its messages) of sorted batches, ever one message in memory."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield from zip(*(part.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text")), strict=True)

    it = rows()
    held = [next(it, None)]

    def messages(conv_id: int | None) -> Iterator[dict]:
        while held[0] is not None and held[0][0] == conv_id:
            _, turn, role, text = held[0]
            yield {"turn": turn, "role": role, "text": text}
            held[0] = next(it, None)

    while held[0] is not None:
        conv_id = held[0][0]
        found = messages(conv_id)
        yield conv_id, found
        for _ in found:  # what a template didn't read
            pass


#: Characters of a segment, but for the last part of the template that went into it: bounds what is held of a long run of turns.
SEGMENT_CHARS = 1 << 16
SEGMENTS = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("text", pa.string()), ("generated", pa.bool_())])


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted text of each conversation as rows (conv_id, segment, text, generated), in order within a partition.

    The segments of a conversation, joined in order, are its formatted text; generated ones are under the loss mask. A run of
    more than SEGMENT_CHARS characters is cut between parts of the template, so that a conversation of any length is never held.
    conversations has (conv_id, turn, role, text); a null role or text counts as empty. Turns are ordered by number (null
    first), then role and text; repeated rows are turns of their own. Rows with a null conv_id form one conversation. An
    empty table gives no rows. Other columns are not read.
    """
    ChatTemplate(template)  # a wrong template fails here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled_template = ChatTemplate(template)
        out: list[list] = [[], [], [], []]
        held = 0
        for conv_id, messages in turns_of(batches):
            n, joined, kind, size = 0, [], None, 0
            for text, generated in compiled_template.parts(messages):
                if kind is not None and (generated != kind or size > SEGMENT_CHARS):
                    for column, x in zip(out, (conv_id, n, "".join(joined), kind), strict=True):
                        column.append(x)
                    held += sum(map(len, joined))
                    n, joined, size = n + 1, [], 0
                joined.append(text)
                size += len(text)
                kind = generated
                if held > 1 << 22 or len(out[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, SEGMENTS, strict=True)], schema=SEGMENTS)
                    out, held = [[], [], [], []], 0
            for column, x in zip(out, (conv_id, n, "".join(joined), bool(kind)), strict=True):
                column.append(x)
            held += sum(map(len, joined))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, SEGMENTS, strict=True)], schema=SEGMENTS)

    return ordered_turns(conversations).mapInArrow(run, "conv_id long, segment long, text string, generated boolean")


def formatted_digest(segments: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from its segments.

    segments comes from format_conversations(): each conversation lies in one partition, in order. The hashes are taken
    as segments pass, in the order of the turns; a conversation is never held.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        state: list = []

        def start(conv_id: int | None) -> None:
            state[:] = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, ReadBack()]

        def end() -> None:
            if state:
                state[6].close()
                rows.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        for batch in batches:
            for conv_id, segment, text, generated in zip(*(batch.column(x).to_pylist() for x in SEGMENTS.names), strict=True):
                if segment == 0:
                    end()
                    start(conv_id)
                state[5] += len(text)
                if generated:
                    plain = unescape(text)
                    state[3] += len(plain)
                    state[4].update(plain.encode())
                for role, body in state[6].feed(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
            if len(rows) >= 1024:
                yield flush()
        end()
        if rows:
            yield flush()

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
