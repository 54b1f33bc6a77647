"""Secret scan: three base patterns, and probabilistic automata that find more tokens of the same formats.

The values that the base patterns find are labelled credentials. For each kind, a prefix tree of them is folded
into a probabilistic automaton: states are merged where the Hoeffding bound says that their futures may be the same
(the ALERGIA method). Symbols are character classes, so an automaton is a format. Folding forgets lengths, so their
frequencies are taken from the values before and multiply the likelihood. Every other token at least as long as the
shortest labelled value may be (LEAST) is a candidate. It is added when, for some kind, its length and its likelihood
for each symbol are like those of nearly all labelled credentials, and its likelihood in characters is well above that under the
best model of other tokens: pairs of characters, or plain numbers. How far above is chosen on other tokens that the pair
model has not seen, so that at most the share PASSING of them would be added (a few of
them may be credentials themselves). Of kinds that gain alike the first wins.

The automata are fitted on at most SAMPLE labelled values for each kind, of at most SAMPLE_CHARS characters, chosen by
hash; every whole text is scanned and every candidate scored. Null texts are empty; without labelled values nothing
is added. Rows that repeat a key are scanned each for itself; other columns are dropped.
"""

from __future__ import annotations

import math
import re
import statistics
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staywise.llm.common import in_batches, materialize, missing

KINDS = ("assign", "access", "hex")
#: Base patterns (fixed values) and the least length of the value.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Words of which an assignment must have one: looked for first, as that is fast.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{min(LEAST.values())},}}")

#: Labelled values for each kind and other tokens (expected numbers) that models are fitted on.
SAMPLE, OTHERS, SAMPLE_CHARS = 1500, 5000, 256
#: Confidence of the merge test, share of labelled values that may lie outside on each side.
ALPHA, TAIL = 0.05, 0.005
#: Nats that a value must gain over other tokens at least, and share of other tokens that may be added.
MARGIN, PASSING = 3.0, 0.01

SPAN = "struct<kind:string,start:int,stop:int,value:string>"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base matches, by start and kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text)]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    good = [x for x in found if len(x[3]) >= LEAST[x[0]]]
    return sorted(good, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Tokens that no base match touches."""
    out, at = [], 0
    for m in TOKEN.finditer(text):
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        if not any(b[1] < m.end() and m.start() < b[2] for b in base[at:]):
            out.append(("", m.start(), m.end(), m[0]))
    return out


def scan(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, base, tokens): base matches and candidates of every whole text."""
    missing(frame, key, text)
    spans = T._parse_datatype_string(f"array<{SPAN}>")
    schema = T.StructType([frame.schema[key], T.StructField("base", spans), T.StructField("tokens", spans)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "stop", "value")
        for batch in batches:
            base, tokens = [], []
            for t in batch.column(1):
                own = t.as_py() or ""
                b = base_spans(own)
                base.append([dict(zip(names, x, strict=True)) for x in b])
                tokens.append([dict(zip(names, x, strict=True)) for x in candidates(own, b)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(tokens, kind)], names=schema.names)

    return in_batches(frame).select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def _classes() -> dict[str, str]:
    """Symbol of each character: digits, hexadecimal and other letters of either case; the rest for itself."""
    out = {c: c for c in "+/_.=-"}
    for group, symbol in (("0123456789", "0"), ("abcdef", "h"), ("ghijklmnopqrstuvwxyz", "l"), ("ABCDEF", "H"), ("GHIJKLMNOPQRSTUVWXYZ", "U")):
        out |= dict.fromkeys(group, symbol)
    return out


CLASSES = _classes()
SIZES = {s: list(CLASSES.values()).count(s) for s in set(CLASSES.values())}
END = "$"


class Automaton:
    """Probabilistic automaton folded from the prefix tree of a sample of values."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.ends: list[int] = [0]
        self.counts: list[dict[str, int]] = [{}]
        self.next: list[dict[str, int]] = [{}]
        for value in values:
            self._add([CLASSES[c] for c in value])
        self._fold()
        self._keep_reached()
        cut = int(TAIL * len(values))
        scores = sorted(self.score(v) for v in values)
        # A few values do not show the whole range: it is widened by their deviation.
        spread = statistics.pstdev(scores)
        self.low, self.high = scores[cut] - spread, scores[len(scores) - 1 - cut] + spread
        # A length counts for its neighbours as well, as values of a format may differ a little.
        seen = Counter(len(v) for v in values)
        near = {n + d: 0.0 for n in seen for d in (-2, -1, 0, 1, 2)}
        for n, times in seen.items():
            for d, share in zip((-2, -1, 0, 1, 2), (0.02, 0.08, 0.8, 0.08, 0.02), strict=True):
                near[n + d] += times * share
        self.lengths = {n: math.log(x / len(values)) for n, x in near.items()}
        usual = sorted(self.lengths[len(v)] for v in values)
        self.shortest_odds = usual[cut]

    def _add(self, symbols: list[str]) -> None:
        state = 0
        for s in symbols:
            self.counts[state][s] = self.counts[state].get(s, 0) + 1
            if s not in self.next[state]:
                self.next[state][s] = len(self.ends)
                self.ends.append(0)
                self.counts.append({})
                self.next.append({})
            state = self.next[state][s]
        self.ends[state] += 1

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.counts[q].values())

    def _differ(self, n1: int, of1: int, n2: int, of2: int) -> bool:
        return abs(n1 / of1 - n2 / of2) > self.bound * (1 / math.sqrt(of1) + 1 / math.sqrt(of2))

    def _compatible(self, a: int, b: int) -> bool:
        """May the two states have the same future? Frequencies are compared all the way down."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            np_, nq = self._total(p), self._total(q)
            if not np_ or not nq:
                continue
            if self._differ(self.ends[p], np_, self.ends[q], nq):
                return False
            for s in self.counts[p].keys() | self.counts[q].keys():
                if self._differ(self.counts[p].get(s, 0), np_, self.counts[q].get(s, 0), nq):
                    return False
                if s in self.next[p] and s in self.next[q]:
                    todo.append((self.next[p][s], self.next[q][s]))
        return True

    def _merge(self, red: int, blue: int) -> None:
        """Fold the tree below blue into the automaton at red."""
        todo = [(red, blue)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            for s, n in self.counts[q].items():
                self.counts[p][s] = self.counts[p].get(s, 0) + n
                if s in self.next[p]:
                    todo.append((self.next[p][s], self.next[q][s]))
                else:
                    self.next[p][s] = self.next[q][s]

    def _fold(self) -> None:
        red, blue = [0], sorted(self.next[0].items())
        blue = [(0, s, q) for s, q in blue]
        while blue:
            parent, s, q = blue.pop(0)
            for r in red:
                if self._compatible(r, q):
                    self.next[parent][s] = r
                    self._merge(r, q)
                    break
            else:
                red.append(q)
            # Merging may have hung new trees on states that are settled.
            settled = set(red)
            blue = [(p, s, x) for p in red for s, x in sorted(self.next[p].items()) if x not in settled]

    def _keep_reached(self) -> None:
        """Log-probabilities of symbols and of the end, smoothed, for the states that are left."""
        symbols = len(SIZES) + 1
        order, seen = [0], {0: 0}
        for q in order:
            for x in self.next[q].values():
                if x not in seen:
                    seen[x] = len(order)
                    order.append(x)
        self.arcs, self.log = [], []
        for q in order:
            total = self._total(q) + 0.01 * symbols
            self.arcs.append({s: seen[x] for s, x in self.next[q].items()})
            known = {s: math.log((n + 0.01) / total) for s, n in self.counts[q].items()}
            self.log.append((known | {END: math.log((self.ends[q] + 0.01) / total)}, math.log(0.01 / total)))
        del self.ends, self.counts, self.next

    def score(self, value: str) -> float:
        """Log-likelihood of the format for each symbol; once off the automaton, a symbol is as unlikely as an unseen one."""
        state, total = 0, 0.0
        for c in value:
            s = CLASSES[c]
            known, unseen = self.log[state]
            total += known.get(s, unseen)
            state = self.arcs[state].get(s, state)
        return total / len(value)

    def fits(self, value: str) -> bool:
        """Are the length and the format like those of nearly all labelled values?"""
        odds = self.lengths.get(len(value))
        return odds is not None and odds >= self.shortest_odds - 1e-9 and self.low - 1e-9 <= self.score(value) <= self.high + 1e-9

    def likelihood(self, value: str) -> float:
        """Log-likelihood of length and characters; those of a class are equally likely."""
        return self.lengths[len(value)] + self.score(value) * len(value) - sum(math.log(SIZES[CLASSES[c]]) for c in value)


#: Characters of numbers as they are written: cards, phones, addresses, dates.
NUMERIC = "0123456789.-/=+"


class Others:
    """What tokens look like that no base pattern finds: the better of pairs of characters, smoothed, and plain numbers."""

    def __init__(self, values: list[str]):
        self.pairs: dict[str, int] = defaultdict(int)
        self.singles: dict[str, int] = defaultdict(int)
        for v in values:
            for a, b in zip("^" + v, v + "$", strict=True):
                self.pairs[a + b] += 1
                self.singles[a] += 1
        self.pairs, self.singles = dict(self.pairs), dict(self.singles)

    def likelihood(self, value: str) -> float:
        size = len(CLASSES) + 1
        paired = sum(
            math.log((self.pairs.get(a + b, 0) + 1) / (self.singles.get(a, 0) + size))
            for a, b in zip("^" + value, value + "$", strict=True)
        )
        if any(c not in NUMERIC for c in value):
            return paired
        # A number ends after any of its digits: one more symbol.
        return max(paired, -(len(value) + 1) * math.log(len(NUMERIC) + 1))


class Model:
    """Automata by kind, and what other tokens look like."""

    def __init__(self, labelled: dict[str, list[str]], others: list[str]):
        self.automata = {k: Automaton(labelled[k]) for k in KINDS if labelled.get(k)}
        # Every second token fits the model of other tokens, the rest says how far above it a value must lie.
        self.others = Others(others[::2])
        gains = sorted((g for v in others[1::2] if (g := self.gain(v)[1]) is not None), reverse=True)
        may_pass = int(PASSING * len(others[1::2]))
        # Too few tokens tell nothing: one of them may be a credential itself.
        self.margin = max([MARGIN, *gains[may_pass : may_pass + 1]]) if may_pass else MARGIN

    def gain(self, value: str) -> tuple[str | None, float | None]:
        """The kind that explains the value best, and by how much better than the other tokens do."""
        best, most = None, None
        plain = None
        for name, automaton in self.automata.items():
            if automaton.fits(value):
                plain = self.others.likelihood(value) if plain is None else plain
                more = automaton.likelihood(value) - plain
                if most is None or more > most:
                    best, most = name, more
        return best, most

    def kind(self, value: str) -> str | None:
        """The kind whose format the value has, if any."""
        best, most = self.gain(value)
        return best if most is not None and most > self.margin else None


def learn(scanned: DataFrame) -> Model:
    """Automata from a bounded sample, chosen by hash, of the distinct labelled values of each kind."""
    mark = F.pmod(F.xxhash64("kind", "value"), F.lit(1 << 30))
    every = scanned.select(F.explode(F.concat("base", "tokens")).alias("x")).select("x.kind", "x.value")
    values = materialize(every.where(F.length("value") <= SAMPLE_CHARS).distinct())
    labelled: dict[str, list[str]] = {}
    others: list[str] = []
    for kind, n in sorted(values.groupBy("kind").count().collect()):
        share = min(1.0, (SAMPLE if kind else OTHERS) / n)
        chosen = values.where((F.col("kind") == kind) & (mark < int(share * (1 << 30)))).select("value")
        own = sorted(r[0] for r in chosen.collect())
        if kind:
            labelled[kind] = own
        else:
            others = own
    return Model(labelled, others)


def find(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, base, added): base matches, and the candidates that have the format of a kind (``like_<kind>``)."""
    scanned = materialize(scan(frame, key, text))
    shared = frame.sparkSession.sparkContext.broadcast(learn(scanned))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            added = []
            for tokens in batch.column(2).to_pylist():
                mine = []
                for t in tokens:
                    if t["value"] not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[t["value"]] = model.kind(t["value"])
                    if kind := known[t["value"]]:
                        mine.append(t | {"kind": f"like_{kind}"})
                added.append(mine)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(added, batch.column(1).type)], names=[key, "base", "added"]
            )

    schema = T.StructType([scanned.schema[key], scanned.schema["base"], T.StructField("added", scanned.schema["base"].dataType)])
    return scanned.mapInArrow(run, schema)


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added of every document."""
    found = find(documents)
    order = F.array(*[F.lit(k) for k in (*KINDS, *[f"like_{k}" for k in KINDS])])

    def listed(spans):
        ranked = F.array_sort(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"),
            F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")).alias("text"),
        )))
        return F.array_join(F.transform(ranked, lambda s: s["text"]), ",")

    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
