"""Secrets in texts: patterns, and formats inferred from the credentials they label.

Three patterns find secrets by their look: the value of an assignment to a
name such as ``password`` (``assign``), access key ids (``access``) and long runs
of lower-case hexadecimal digits (``hex``).  These base findings always stay.

What they find is also a set of credentials labelled by kind, from which formats
are learned, so that a key of the same make is found where no pattern looks, say
standing alone.  The strings of a kind form a prefix tree with counts.  A prefix
that many of them share is spelled out; in what follows it, character classes
whose characters are about equally frequent become one symbol, so that random
hexadecimal or base-62 parts do not scatter over the tree.  States of the tree
whose ends and next symbols are statistically compatible (Hoeffding's bound, down
the whole subtree) are merged, which leaves a probabilistic automaton.

Every candidate, a run of 16 or more key characters outside the base findings,
is scored by each automaton.  It is a ``format`` finding if the likeliest format
is ``MARGIN`` times likelier than ordinary long words (a Markov chain over their
characters), and a character of it not much less likely than in the least likely
string that taught the format.

The automata and the chain are fitted to all distinct credentials and candidates,
of any length.  Spark counts them: shared prefixes, characters, the transitions of
the prefix tree and pairs of characters are sums over all strings, the least likely
credential a minimum, and only such counts reach the driver.  What is bounded is
the model, not its data: a prefix is spelled out, and a branch of the tree has
states of its own, if at least one in ``SHARES`` strings of the kind takes it, and
a tree is ``LONGEST`` symbols deep.  Strings that go on from there share one more
state, which has the symbols and ends of all of them.  Up to ``SHARES`` strings,
none longer than ``LONGEST``, the tree is spelled out whole.

Scanning and scoring read whole texts; offsets are code points, ends exclusive.
Null counts as empty.  Rows are independent: repeated rows are found alike, and
other columns pass through or are not asked for.  Without credentials in the table
there are no formats and base findings alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .shared import carried, fresh, quoted
from .textbytes import pieces

KINDS = ("assign", "access", "hex", "format")
#: (pattern, group that is the credential, least length of it), in the order of KINDS; fixed by the contract.
BASE = (
    (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    (r"AKIA[A-Z0-9]+", 0, 18),
    (r"[0-9a-f]+", 0, 16),
)
#: What a text must match to hold a finding of that kind at all: looser, and quick.
_HINTS = (r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"AKIA", r"[0-9a-f]{16}")
CANDIDATE = r"[A-Za-z0-9][A-Za-z0-9+/_.=-]{14,}[A-Za-z0-9=]"
_CANDIDATE_HINT = r"[A-Za-z0-9+/_.=-]{16}"

#: A prefix or branch that fewer than one in so many strings of a kind take has no states of its own.
SHARES = 1000
#: Symbols from the root to the deepest state of a tree.
LONGEST = 128
#: Least part of the strings of a prefix, and least number, that share one longer by a character.
SHARE, LEAST = 0.2, 20
#: How many times likelier a format must be than an ordinary word.
MARGIN = 1e6
#: Nats a character may fall below the least likely string that taught the format.
SLACK = 0.1
ALPHA = 0.05

_SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())])
_FOUND = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])


def base_spans(text: str, kinds: Iterable[int] = (0, 1, 2)) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, credential) of the base findings, by start and kind."""
    out = []
    for kind in kinds:
        pattern, group, least = BASE[kind]
        # a run that is long enough is the whole run either way, and most runs of hex digits are letters of words
        found = re.finditer(r"[0-9a-f]{16,}" if kind == 2 else pattern, text)
        out += [(kind, m.start(), m.end(), m[group]) for m in found if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[1], s[0]))


def candidates(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, string) of the candidates that touch no base finding."""
    covered, out = sorted((s[1], s[2]) for s in spans), []
    at, reach = 0, -1
    for m in re.finditer(CANDIDATE, text):
        while at < len(covered) and covered[at][0] < m.end():
            reach = max(reach, covered[at][1])
            at += 1
        if reach <= m.start():
            out.append((m.start(), m.end(), m[0]))
    return out


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``base`` and ``candidates``; one pass over the texts."""
    new = ["base", "candidates"]
    kept = carried(df, [*new, text])
    piece = T.StructType([f for f in _SPAN.fields if f.name != "kind"])
    schema = T.StructType([*kept, T.StructField("base", T.ArrayType(_SPAN)), T.StructField("candidates", T.ArrayType(piece))])
    span_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    piece_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    body = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, body):
                texts = pc.fill_null(part.column(body), "")
                hints = [pc.match_substring_regex(texts, h) for h in (*_HINTS, _CANDIDATE_HINT)]
                some = pc.or_(pc.or_(hints[0], hints[1]), pc.or_(hints[2], hints[3]))
                rows = pc.indices_nonzero(some)
                told = list(zip(rows.to_pylist(), texts.take(rows).to_pylist(), *[h.take(rows).to_pylist() for h in hints], strict=True))
                base, more = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
                for i, t, *hint in told:
                    spans = base_spans(t, [k for k in range(3) if hint[k]])
                    base[i] = [dict(zip(_SPAN.names, s, strict=True)) for s in spans]
                    if hint[3]:
                        more[i] = [dict(zip(piece.names, c, strict=True)) for c in candidates(t, spans)]
                yield pa.RecordBatch.from_arrays([*part.columns[:body], pa.array(base, span_type), pa.array(more, piece_type)], names=schema.names)

    return df.select(*[quoted(f.name) for f in kept], quoted(text).alias(fresh(df, "__text"))).mapInArrow(run, schema)


# --- automata -------------------------------------------------------------------------------------------------------

_CELLS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *"+/_.=-")


def alphabet(counts: dict[str, int]) -> dict[str, str]:
    """The symbol of each character: all characters of classes that are about equally frequent, character by character."""
    cells = [(sum(counts.get(c, 0) for c in cell), cell) for cell in _CELLS]
    cells = sorted(((n, cell) for n, cell in cells if n), key=lambda x: (-x[0] / len(x[1]), x[1]))
    merged: list[tuple[int, str]] = []
    for n, cell in cells:
        if merged:
            m, group = merged[-1]
            each = (m + n) / (len(group) + len(cell))
            if all(abs(got - each * size) <= 4 * math.sqrt(each * size) for got, size in ((m, len(group)), (n, len(cell)))):
                merged[-1] = (m + n, group + cell)
                continue
        merged.append((n, cell))
    return {c: group for _, group in merged for c in group}


@dataclass
class Spelling:
    """How strings become symbols: shared prefixes letter by letter, the rest by the classes that follow the prefix."""

    prefixes: set[str]
    classes: dict[str, dict[str, str]]

    def spelled(self, s: str) -> int:
        """Characters of the longest shared prefix that a string begins with."""
        i = 0
        while i < len(s) and s[:i + 1] in self.prefixes:
            i += 1
        return i

    def symbols(self, s: str) -> list[tuple[str, str, int]]:
        """(prefix, symbol, characters it stands for) of each character; a symbol that no string had is empty."""
        i = self.spelled(s)
        known = self.classes.get(s[:i], {})
        out = [(s[:j], s[j], 1) for j in range(i)]
        return out + [(s[:i], known.get(c, ""), len(known.get(c, "")) or 1) for c in s[i:]]


def shared(counts: dict[str, int], share: float = SHARE, least: float = LEAST) -> set[str]:
    """The prefixes that many strings begin with, and a good part of those that begin with all but their last character."""
    prefixes: set[str] = set()
    for p in sorted((p for p in counts if p and counts[p] >= least), key=len):
        if (len(p) == 1 or p[:-1] in prefixes) and counts[p] >= share * counts[p[:-1]]:
            prefixes.add(p)
    return prefixes


def spelling(strings: list[str], share: float = SHARE, least: int = LEAST) -> Spelling:
    counts = defaultdict(int)
    for s in strings:
        for i in range(1, len(s) + 1):
            counts[s[:i]] += 1
    counts[""] = len(strings)
    out, tails = Spelling(shared(counts, share, least), {}), defaultdict(Counter)
    for s in strings:
        i = out.spelled(s)
        tails[s[:i]].update(s[i:])
    out.classes = {p: alphabet(t) for p, t in tails.items()}
    return out


@dataclass
class Node:
    count: int = 0
    ends: int = 0
    next: dict[tuple[str, str], int] = field(default_factory=dict)
    uses: dict[tuple[str, str], int] = field(default_factory=dict)


def prefix_tree(words: Iterable[list[tuple[str, str]]]) -> list[Node]:
    nodes = [Node()]
    for word in words:
        at = nodes[0]
        at.count += 1
        for symbol in word:
            if symbol not in at.next:
                at.next[symbol] = len(nodes)
                nodes.append(Node())
            at.uses[symbol] = at.uses.get(symbol, 0) + 1
            at = nodes[at.next[symbol]]
            at.count += 1
        at.ends += 1
    return nodes


def _differ(a: int, n: int, b: int, m: int, alpha: float) -> bool:
    return abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def _compatible(nodes: list[Node], a: int, b: int, alpha: float, rest: int | None) -> bool:
    """Whether two states end and go on alike, and so do the states they lead to, up to the one of the rest."""
    todo = [(a, b)]
    while todo:
        pair = todo.pop()
        if rest in pair:
            continue
        x, y = (nodes[i] for i in pair)
        if _differ(x.ends, x.count, y.ends, y.count, alpha):
            return False
        for symbol in x.next.keys() | y.next.keys():
            if _differ(x.uses.get(symbol, 0), x.count, y.uses.get(symbol, 0), y.count, alpha):
                return False
            if symbol in x.next and symbol in y.next and x.next[symbol] != y.next[symbol]:
                todo.append((x.next[symbol], y.next[symbol]))
    return True


def _foldable(nodes: list[Node], into: int, tree: int, kept: set[int], rest: int | None) -> bool:
    """Whether no kept state would have to go on as the rest does."""
    todo = [(into, tree)] if rest is not None else []
    while todo:
        a, b = todo.pop()
        for symbol, to in nodes[b].next.items():
            at = nodes[a].next.get(symbol, rest)
            if to == rest and at != rest and at in kept:
                return False
            if rest not in (at, to):
                todo.append((at, to))
    return True


def _fold(nodes: list[Node], into: int, tree: int, rest: int | None) -> None:
    """Add a subtree's counts to a state; where the state has no such transition the subtree stays on."""
    todo = [(into, tree)]
    while todo:
        a, b = todo.pop()
        x, y = nodes[a], nodes[b]
        x.count += y.count
        x.ends += y.ends
        for symbol, to in y.next.items():
            x.uses[symbol] = x.uses.get(symbol, 0) + y.uses[symbol]
            if symbol not in x.next:
                x.next[symbol] = to
            elif rest in (x.next[symbol], to):
                _give_up(nodes, to if to != rest else x.next[symbol], rest)
                x.next[symbol] = rest
            else:
                todo.append((x.next[symbol], to))


def _give_up(nodes: list[Node], tree: int, rest: int) -> None:
    """Add a subtree's counts to the state of the rest."""
    todo, into = [tree], nodes[rest]
    while todo:
        if (at := todo.pop()) != rest:
            into.count += nodes[at].count
            into.ends += nodes[at].ends
            for symbol, n in nodes[at].uses.items():
                into.uses[symbol], into.next[symbol] = into.uses.get(symbol, 0) + n, rest
            todo += nodes[at].next.values()


def merge_states(nodes: list[Node], alpha: float = ALPHA, rest: int | None = None) -> list[Node]:
    """The automaton that is left when compatible states are merged, in the order of the tree; state 0 begins.

    ``rest``: the state, if there is one, that strings share beyond the tree.
    """
    kept, done = [0], {0, rest}
    fringe = [(0, s) for s, to in sorted(nodes[0].next.items()) if to not in done]
    while fringe:
        # the fringe's most used state first: its statistics are the surest
        fringe.sort(key=lambda e: (-nodes[e[0]].uses[e[1]], e))
        parent, symbol = fringe.pop(0)
        blue = nodes[parent].next[symbol]
        if blue in done:
            continue
        for red in kept:
            if _compatible(nodes, red, blue, alpha, rest):
                nodes[parent].next[symbol] = red
                if _foldable(nodes, red, blue, done, rest):
                    _fold(nodes, red, blue, rest)
                    break
                nodes[parent].next[symbol] = blue
        else:
            kept.append(blue)
            done.add(blue)
        # a merge may have hung subtrees on any kept state
        fringe = [(r, s) for r in kept for s, to in nodes[r].next.items() if to not in done]
    kept += [] if rest is None else [rest]
    number = {old: new for new, old in enumerate(kept)}
    return [Node(nodes[i].count, nodes[i].ends, {s: number[t] for s, t in nodes[i].next.items()}, nodes[i].uses) for i in kept]


@dataclass
class Automaton:
    spelling: Spelling
    states: list[Node]
    #: Nats a character that a string must have at least.
    floor: float = -math.inf

    def likelihood(self, s: str) -> float:
        """Log likelihood of a string; minus infinity if the format does not allow it."""
        at, total = self.states[0], 0.0
        for prefix, symbol, size in self.spelling.symbols(s):
            used = at.uses.get((prefix, symbol), 0)
            if not symbol or not used:
                return -math.inf
            total += math.log(used / at.count / size)
            at = self.states[at.next[prefix, symbol]]
        return total + math.log(at.ends / at.count) if at.ends else -math.inf


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of a format, from distinct strings of it."""
    strings = sorted(set(strings))
    spell = spelling(strings)
    tree = prefix_tree([(p, c) for p, c, _ in spell.symbols(s)] for s in strings)
    out = Automaton(spell, merge_states(tree, alpha))
    out.floor = min((out.likelihood(s) / len(s) for s in strings), default=0.0) - SLACK
    return out


@dataclass
class Words:
    """A Markov chain over the characters of ordinary long words, with every transition seen half a time more."""

    pairs: dict[str, int]
    firsts: dict[str, int]

    def likelihood(self, s: str) -> float:
        size = len(_KEY_CHARACTERS) + 1
        return sum(math.log((self.pairs.get(a + b, 0) + 0.5) / (self.firsts.get(a, 0) + 0.5 * size)) for a, b in zip("^" + s, s + "$", strict=True))


_KEY_CHARACTERS = "".join(_CELLS)


@dataclass
class Formats:
    automata: dict[int, Automaton]
    words: Words

    def score(self, s: str) -> float:
        """Log of how many times likelier the likeliest format is than an ordinary word; minus infinity if no format fits."""
        best = -math.inf
        for automaton in self.automata.values():
            own = automaton.likelihood(s)
            if own / len(s) >= automaton.floor:
                best = max(best, own)
        return best - self.words.likelihood(s) if best > -math.inf else best


# --- counts over all strings --------------------------------------------------------------------------------------

#: Counts that a task holds before it hands them on.
_HELD = 100_000
_PRIME = (1 << 61) - 1


def _tally(strings: DataFrame, count: Callable[[int, str], Iterable[tuple]], keys: str) -> DataFrame:
    """(keys, n): how often ``count`` gives each key for the (kind, value) rows; each task sums its own first."""
    schema = T.StructType.fromDDL(f"{keys}, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [{"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()] for f in schema]
        held = Counter()

        def out() -> pa.RecordBatch:
            columns = [*zip(*held, strict=True), held.values()] if held else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        for batch in batches:
            for kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update(count(kind, value))
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        yield out()

    return strings.mapInArrow(run, schema).groupBy(*schema.names[:-1]).agg(F.sum("n").alias("n"))


def _of_kind(numbers: dict[int, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, n in numbers.items() for x in (k, float(n))]), F.col("kind"))


def _prefixes(said: DataFrame, totals: dict[int, int]) -> dict[int, set[str]]:
    """The shared prefixes of each kind; a round counts the prefixes that go on from those found before."""
    least = {k: max(LEAST, n / SHARES) for k, n in totals.items()}
    counts = {k: {"": n} for k, n in totals.items()}
    found, ends, at, step = {k: set() for k in totals}, [(k, "") for k in totals], 0, 2
    while ends:
        begins = F.concat(F.col("kind").cast("string"), F.lit(":"), F.substring("value", 1, at)).isin([f"{k}:{p}" for k, p in ends])
        longer = said.where(begins & (F.length("value") > at)).select("kind", "value", F.explode(F.sequence(F.lit(at + 1), F.least(F.length("value"), F.lit(at + step)))).alias("i"))
        for r in longer.groupBy("kind", F.expr("substring(value, 1, i)").alias("p")).agg(F.count("*").alias("n")).where(F.col("n") >= _of_kind(least)).collect():
            counts[r["kind"]][r["p"]] = r["n"]
        found = {k: shared(counts[k], least=least[k]) for k in totals}
        at, step = at + step, min(2 * step, 16)
        ends = [(k, p) for k in totals for p in found[k] if len(p) == at]
    return found


def _trees(said: DataFrame, totals: dict[int, int], spellings: dict[int, Spelling], longest: int) -> dict[int, tuple[list[Node], int | None]]:
    """The prefix tree of each kind's strings, and the number of the state of the rest if a string goes there."""
    names = {k: [(p[:-1], p[-1]) for p in sorted(s.prefixes)] + sorted({(p, c) for p, known in s.classes.items() for c in known.values()}) for k, s in spellings.items()}
    number = {k: {symbol: i for i, symbol in enumerate(of)} for k, of in names.items()}

    def spelled(kind: int, value: str) -> list[int]:
        return [number[kind][p, c] for p, c, _ in spellings[kind].symbols(value)]

    def along(at: int, symbol: int) -> int:  # a state bears the hash of its path
        return (at * 0x9E3779B97F4A7C1 + symbol + 1) % _PRIME

    def paths(kind: int, value: str) -> Iterator[tuple]:
        at = 1
        for symbol in spelled(kind, value)[:longest]:
            yield kind, at, symbol
            at = along(at, symbol)

    taken = _tally(said, paths, "kind int, at long, symbol int").where(F.col("n") >= _of_kind({k: n / SHARES for k, n in totals.items()}))
    tree = {(r["kind"], r["at"], r["symbol"]): r["n"] for r in taken.collect()}
    steps = frozenset(tree)

    def leaves(kind: int, value: str) -> Iterator[tuple]:
        """What the tree does not say: where strings end (-1), where they leave it, and how they go on (at -1)."""
        at = 1
        for symbol in spelled(kind, value):
            if at >= 0 and (kind, at, symbol) in steps:
                at = along(at, symbol)
            else:
                yield kind, at, symbol
                at = -1
        yield kind, at, -1

    others, down, out = defaultdict(list), defaultdict(list), {}
    for r in _tally(said, leaves, "kind int, at long, symbol int").collect():
        others[r["kind"], r["at"]].append((r["symbol"], r["n"]))
    for (k, at, symbol), n in sorted(tree.items()):
        down[k, at].append((symbol, n))
    for k, total in totals.items():
        nodes, places, rest = [Node(total)], [1], None
        if (k, -1) in others:
            nodes, places, rest = [*nodes, Node(sum(n for _, n in others[k, -1]))], [1, -1], 1
        for i, at in enumerate(places):  # which grow as states are found
            for symbol, n in down.get((k, at), ()):
                nodes[i].next[names[k][symbol]], nodes[i].uses[names[k][symbol]] = len(nodes), n
                nodes.append(Node(n))
                places.append(along(at, symbol))
            for symbol, n in others.get((k, at), ()):
                if symbol < 0:
                    nodes[i].ends = n
                else:
                    nodes[i].next[names[k][symbol]], nodes[i].uses[names[k][symbol]] = rest, n
        out[k] = nodes, rest
    return out


def train(scanned: DataFrame, longest: int = LONGEST, alpha: float = ALPHA) -> Formats:
    """Formats of all credentials in a scanned table, held against all its other candidates."""
    said = cut_lineage(scanned.select(F.explode("base").alias("s")).select("s.kind", "s.value").distinct())
    totals = {r["kind"]: r["n"] for r in said.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").collect()}
    if not totals:
        return Formats({}, Words({}, {}))
    plain = {k: Spelling(p, {}) for k, p in _prefixes(said, totals).items()}

    def tails(kind: int, value: str) -> Iterable[tuple]:
        i = plain[kind].spelled(value)
        return ((kind, value[:i], c) for c in value[i:])

    counts = {k: defaultdict(dict) for k in totals}
    for r in _tally(said, tails, "kind int, prefix string, c string").collect():
        counts[r["kind"]][r["prefix"]][r["c"]] = r["n"]
    spellings = {k: Spelling(s.prefixes, {p: alphabet(n) for p, n in counts[k].items()}) for k, s in plain.items()}
    automata = {k: Automaton(spellings[k], merge_states(nodes, alpha, rest)) for k, (nodes, rest) in _trees(said, totals, spellings, longest).items()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            strings = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([automata[k].likelihood(s) / len(s) for k, s in strings], pa.float64())], names=["kind", "each"])

    floors = {r["kind"]: r["least"] - SLACK for r in said.mapInArrow(each, "kind int, each double").groupBy("kind").agg(F.min("each").alias("least")).collect()}
    fitted = {k: Automaton(a.spelling, a.states, floors[k]) for k, a in automata.items()}

    def pairs(_: int, value: str) -> Iterable[tuple]:
        # a string that a format allows may be a credential that no pattern found: it is no ordinary word
        if any(a.likelihood(value) / len(value) >= a.floor for a in fitted.values()):
            return ()
        return ((a + b,) for a, b in zip("^" + value, value + "$", strict=True))

    free = scanned.select(F.explode("candidates.value").alias("value")).distinct().select(F.lit(0).alias("kind"), "value")
    seen = {r["pair"]: r["n"] for r in _tally(free, pairs, "pair string").collect()}
    firsts = defaultdict(int)
    for pair, n in seen.items():
        firsts[pair[0]] += n
    return Formats(fitted, Words(seen, dict(firsts)))


def find(scanned: DataFrame, formats: Formats, margin: float = MARGIN) -> DataFrame:
    """The scanned table's rows with ``spans`` (kind, start, end, score), by start and kind; base findings have no score."""
    kept = carried(scanned, ["base", "candidates", "spans"])
    schema = T.StructType([*kept, T.StructField("spans", T.ArrayType(_FOUND))])
    least, body = math.log(margin), len(kept)
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for base, more in zip(b.column(body).to_pylist(), b.column(body + 1).to_pylist(), strict=True):
                spans = [(s["start"], s["kind"], s["end"], None) for s in base]
                for c in more:
                    score = formats.score(c["value"])
                    if score >= least:
                        spans.append((c["start"], len(BASE), c["end"], score))
                out.append([{"kind": KINDS[k], "start": a, "end": e, "score": s} for a, k, e, s in sorted(spans, key=lambda s: s[:2])])
            yield pa.RecordBatch.from_arrays([*b.columns[:body], pa.array(out, kind_type)], names=schema.names)

    return scanned.select(*[quoted(f.name) for f in kept], "base", "candidates").mapInArrow(run, schema)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``spans``: scan, train on what is found, score the candidates."""
    scanned = cut_lineage(scan(df, text))
    return find(scanned, train(scanned))
