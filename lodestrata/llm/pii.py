"""Personal data by a semi-Markov conditional random field beside fixed patterns.

The patterns give the base spans. What they miss is mostly a matter of boundaries: a phone number and an address written one after the other
are one match of too many digits, a card after a short number fails its checksum, an address spelled with "at" and "dot" is none. A
segment model decides there: a candidate is a whole span with a kind, its features are of the whole span (digits, groups, separators,
checksums, what stands on both sides), and a dynamic programme over all ways to cut a stretch of text into candidates of bounded length and
plain text takes boundaries and kinds together. Candidates lie in short stretches of digits and of addresses; between them there is one way
to cut, so stretches are decided one by one with the same result as the whole text.

The model learns by maximum likelihood from stretches with the base spans as labels, and from rewritings of these spans: other separators, two
in a row, a number before, and wrong ones (a changed checksum, a part over 255, dates, versions) as plain text.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, stored, table

KINDS = ("email", "ip", "card", "phone")
PLACE = {k: i for i, k in enumerate(KINDS)}
#: About so many different stretches with base spans, and as many without, are learned from; none of them is longer than LONGEST.
MOST, LONGEST = 1500, 160
#: A candidate has at most so many groups of digits, and so many characters.
GROUPS, CHARS = 8, 40
#: What a span's score must have over plain text's, in logs.
CAUTION = 1.0

# The base patterns. None scans a run of characters more than once or twice.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_ANY = re.compile(r"[0-9@]")

_SEP = r"[  .()\[\]/+-]"
_NUMBERS = re.compile(rf"[+(]{{0,2}}[0-9]+(?:{_SEP}{{1,4}}[0-9]+)*")
_AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|AT)\s?[\])}>]\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\s?\.\s?|\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
_AT_RE, _HOST = re.compile(_AT), re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,6}}(?![A-Za-z0-9])")
_DOT_RE = re.compile(_DOT)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind. Per kind leftmost and apart; a long run of one kind of character costs its length."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if domain and begin < at:
            found.append((begin, domain.end(), "email"))
            end = domain.end()
        else:
            end = max(end, at)  # no address holds this sign in its local part
        at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            stop = at + sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts[i : i + 4]):
                found.append((at, stop, "ip"))
            at = stop + 1
    for m in _CARD.finditer(text):
        n = m[0].replace(" ", "").replace("-", "") if len(m[0]) <= 40 else ""
        if 14 <= len(n) <= 19 and luhn(n):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], PLACE[s[2]]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], PLACE[x[2]], x[1])))


def split(said: str) -> list[tuple[int, int, str]]:
    return [(int(s), int(e), k) for k, s, e in (x.split(":") for x in said.split(",") if x)]


def addresses(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end of the local part, start of the domain, end) of what may be an address, however its signs are written."""
    last = 0
    for m in _AT_RE.finditer(text):
        begin = sign = m.start()
        while begin > max(last, sign - 65) and text[begin - 1] in _LOCAL:
            begin -= 1
        if 0 < sign - begin <= 64 and (host := _HOST.match(text, m.end())):
            last = host.end()
            yield begin, sign, m.end(), last


def stretches(text: str) -> list[tuple[int, int]]:
    """Where candidates can lie: numbers of at least four digits in all with what parts them, and addresses. Those that meet are one."""
    found = [m.span() for m in _NUMBERS.finditer(text) if m.end() - m.start() >= 4 and sum(c.isdigit() for c in m[0]) >= 4]
    found += [(s, e) for s, _, _, e in addresses(text)]
    out: list[list[int]] = []
    for s, e in sorted(found):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _side(c: str) -> str:
    """The class of a neighbouring character."""
    return "none" if not c else "space" if c.isspace() else "word" if c.isalnum() or c == "_" else c if c in ".,:;\"'()[]|=+-/@#$%&*!?" else "other"


def candidates(text: str, left: str = "", right: str = "") -> list[tuple[int, int, str, tuple[str, ...]]]:
    """(start, end, kind, features of the whole span) of every span that the model weighs. left, right: the characters around the stretch."""
    out = []

    def around(s: int, e: int) -> tuple[str, str]:
        return _side(text[s - 1] if s else left), _side(text[e] if e < len(text) else right)

    runs = [m.span() for m in re.finditer("[0-9]+", text)]
    for i, (first, _) in enumerate(runs):
        digits, groups = "", []
        for j in range(i, min(len(runs), i + GROUPS)):
            stop = runs[j][1]
            if stop - first > CHARS or j > i and runs[j][0] - runs[j - 1][1] > 4:
                break
            digits += text[runs[j][0] : stop]
            groups.append(stop - runs[j][0])
            kinds = [k for k, fits in (("ip", len(groups) == 4), ("card", 13 <= len(digits) <= 19), ("phone", 7 <= len(digits) <= 15)) if fits]
            if not kinds:
                continue
            before = text[max(0, first - 2) : first]
            for start in {first, *(first - n for n in (1, 2) if re.fullmatch(r"\+?\(?", before[-n:]) and len(before) >= n)}:
                l, r = around(start, stop)
                if l == "word" or r == "word":
                    continue
                said = text[start:stop]
                parts = re.split("[0-9]+", said)
                seps = [re.sub(r"\s", " ", p) for p in parts[1:-1]]
                common = ["bias", f"n{len(digits)}", "g" + "-".join(map(str, groups)), "seps" + "|".join(sorted(set(seps))), f"n_seps{len(set(seps))}", f"head{parts[0]}", "balanced" if said.count("(") == said.count(")") else "open", f"l{l}", f"r{r}"]
                for k in kinds:
                    own = [f"luhn{luhn(digits)}", f"long{len(digits) >= 14}"] if k == "card" else [f"octets{all(int(text[a:b]) <= 255 and b - a <= 3 for a, b in runs[i : j + 1])}", "dots" + str(all("." in s and len(s) <= 3 for s in seps))] if k == "ip" else [f"head{parts[0]}n{len(digits)}"]
                    out.append((start, stop, k, tuple(f"{k} {f}" for f in common + own)))
    for begin, sign, host, end in addresses(text):
        dots = list(_DOT_RE.finditer(text, host, end))
        name, at = text[begin:sign], text[sign:host]
        at = re.sub(r"[\s\[\](){}<>]", "", at).lower() + ("b" if re.search(r"[\[({<]", at) else " " if at[0].isspace() else "")
        for stop in sorted({d.start() for d in dots[1:]} | {end}):
            used = [d for d in dots if d.end() < stop]
            last = text[used[-1].end() : stop]
            how = "+".join(sorted({re.sub(r"\s", " ", d[0]).lower() for d in used}))
            l, r = around(begin, stop)
            f = ["bias", f"at{at}", f"dot{how}", f"both{at}|{how}", f"labels{len(used) + 1}", f"last{min(len(last), 7)}{last.isalpha()}{last.islower()}", f"name{name[-1:].isalnum()}{any(c.isdigit() for c in name)}", f"l{l}", f"r{r}"]
            out.append((begin, stop, "email", tuple(f"email {x}" for x in f)))
    return out


class Graph:
    """The ways to cut a stretch: points between 0 and m, spans (from, to, kind, features), and plain text from each point to the next."""

    def __init__(self, spans: list[tuple[int, int, str, tuple[str, ...]]], barred: list[tuple[int, int]] = ()):
        spans = [s for s in spans if not any(s[0] < e and b < s[1] for b, e in barred)]
        points = sorted({p for s in spans for p in s[:2]})
        at = {p: i for i, p in enumerate(points)}
        self.points = points
        self.spans = [(at[s], at[e], PLACE[k] + 1, f) for s, e, k, f in spans]

    def signature(self) -> tuple:
        return len(self.points), tuple(self.spans)


class Model:
    """Weights of features and of transitions between kinds (plain text is 0)."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def _edges(self, g: Graph) -> list[list[tuple[int, int, float, int]]]:
        """By end point: (from, label, score, index of the span or -1)."""
        into: list[list[tuple[int, int, float, int]]] = [[] for _ in g.points]
        w = self.weights
        for n, (s, e, y, f) in enumerate(g.spans):
            into[e].append((s, y, sum(w.get(x, 0.0) for x in f), n))
        for t in range(1, len(g.points)):
            into[t].append((t - 1, 0, 0.0, -1))
        return into

    def _step(self, a: int, b: int) -> float:
        return self.weights.get(f"{a}>{b}", 0.0) if b else 0.0

    def best(self, g: Graph, caution: float = 0.0) -> list[int]:
        """Indices of the spans on the best way; ties go to plain text, then to what ends last."""
        if not g.spans:
            return []
        into, best = self._edges(g), [{0: (0.0, None)}]
        for t in range(1, len(g.points)):
            here: dict[int, tuple] = {}
            for s, y, score, n in sorted(into[t], key=lambda x: x[3]):
                for a, (v, _) in best[s].items():
                    v += score + self._step(a, y) - (caution if n >= 0 else 0.0)
                    if y not in here or v > here[y][0]:
                        here[y] = v, (s, a, n)
            best.append(here)
        t, y, out = len(best) - 1, max(sorted(best[-1]), key=lambda y: best[-1][y][0]), []
        while best[t][y][1]:
            s, a, n = best[t][y][1]
            out += [n] if n >= 0 else []
            t, y = s, a
        return out[::-1]

    def expected(self, g: Graph) -> tuple[float, Counter]:
        """The log of the sum over all ways, and the expected number of each feature."""
        into, alpha = self._edges(g), [{0: 0.0}]
        for t in range(1, len(g.points)):
            sums = defaultdict(list)
            for s, y, score, _ in into[t]:
                sums[y] += [v + score + self._step(a, y) for a, v in alpha[s].items()]
            alpha.append({y: _log_sum(v) for y, v in sums.items()})
        total = _log_sum(alpha[-1].values())
        beta: list[dict[int, list[float]]] = [defaultdict(list) for _ in alpha]
        for y in alpha[-1]:
            beta[-1][y].append(0.0)
        out: Counter = Counter()
        for t in range(len(alpha) - 1, 0, -1):
            done = {y: _log_sum(v) for y, v in beta[t].items()}
            for s, y, score, n in into[t]:
                if y not in done:
                    continue
                for a, v in alpha[s].items():
                    way = score + self._step(a, y) + done[y]
                    beta[s][a].append(way)
                    if n >= 0:
                        p = math.exp(v + way - total)
                        out[f"{a}>{y}"] += p
                        for f in g.spans[n][3]:
                            out[f] += p
        return total, out

    @staticmethod
    def seen(g: Graph, gold: set[tuple[int, int, int]]) -> Counter:
        """The features on the way that takes the gold spans."""
        out: Counter = Counter()
        last = (0, 0)
        for s, e, y, f in sorted((x for x in g.spans if x[:3] in gold), key=lambda x: x[0]):
            out.update(f)
            out[f"{last[1] if last[0] == s else 0}>{y}"] += 1
            last = e, y
        return out


def _log_sum(values: Iterable[float]) -> float:
    values = list(values)
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def learn(examples: list[tuple[str, str, str, list[tuple[int, int, str]]]], rounds: int = 25, rate: float = 0.5, weight: float = 2e-3) -> Model:
    """Maximum likelihood of examples (text, left, right, spans) by adaptive steps. Examples that look alike to the model are one, counted by the root of their number."""
    alike: Counter = Counter()
    for text, left, right, gold in examples:
        g = Graph(candidates(text, left, right))
        at = {p: i for i, p in enumerate(g.points)}
        want = frozenset((at.get(s), at.get(e), PLACE[k] + 1) for s, e, k in gold)
        if g.spans and want <= {x[:3] for x in g.spans}:
            alike[(g.signature(), want)] += 1
    graphs = []
    for ((n, spans), want), count in sorted(alike.items(), key=repr):
        g = Graph([])
        g.points, g.spans = list(range(n)), list(spans)
        graphs.append((g, Model.seen(g, set(want)), math.sqrt(count)))
    model, past, rng = Model(), defaultdict(float), random.Random(12)
    for _ in range(rounds):
        rng.shuffle(graphs)
        for g, seen, times in graphs:
            _, expected = model.expected(g)
            for f in set(seen) | set(expected):
                step = min(times, 4.0) * (seen[f] - expected[f]) - weight * model.weights.get(f, 0.0)
                if step:
                    past[f] += step * step
                    model.weights[f] = model.weights.get(f, 0.0) + rate * step / math.sqrt(past[f] + 1e-6)
    return model


def rewritten(kind: str, said: str, rng: random.Random) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) made from a base span: other ways to write it, and wrong ones without a span."""
    whole = lambda t: (t, [(0, len(t), kind)])
    d = _digits(said)
    if kind == "email":
        name, _, domain = said.partition("@")
        at, dot = rng.choice([("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", "."), (" AT ", " DOT "), ("{at}", "(dot)"), (" @ ", " . ")])
        plain = name.strip(".") + " at " + domain.split(".")[0]
        return [whole(name + at + domain.replace(".", dot)), (plain + ". Then", []), (plain + "." + rng.choice(["The", "It", "And"]), [])]
    if kind == "ip":
        parts = said.split(".")
        wrong = [*parts]
        wrong[rng.randrange(4)] = str(rng.randint(256, 999))
        return [whole(rng.choice(["[.]", " . ", "(.)", "[.]"]).join(parts)), (".".join(wrong), []), (".".join(parts[:3]) + " " + parts[3], []), (" ".join(parts), [])]
    if kind == "card":
        other = str((int(d[-1]) + rng.randint(1, 9)) % 10)
        cut = [d[i : i + 4] for i in range(0, len(d), 4)]
        return [whole(rng.choice([".", "/", "  ", " - "]).join(cut)), (d[:-1] + other, []), (" ".join(cut)[:-1] + other, []), (f"{d[:4]} {d[4:8]}", [])]
    out = []
    if len(d) == 11:
        a, b, c = d[1:4], d[4:7], d[7:]
        out = [whole(rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"00{d[0]} {a} {b} {c}", f"+{d[0]}/{a}/{b}/{c}"])), (f"{b}-{c}", []), (d[1:], [])]
    return out


def examples(rows: list[tuple[str, str, str, str]], seed: int = 12) -> list[tuple[str, str, str, list[tuple[int, int, str]]]]:
    """What is learned from: the stretches (text, left, right, base spans) themselves, and rewritings of their spans, alone, after a number, and two in a row."""
    rng, out, alone = random.Random(seed), [], []
    for text, left, right, said in rows:
        gold = split(said)
        # what the patterns found but dropped for its length may hold spans: it says nothing of them
        unsaid = any(len(_digits(m[0])) > most for pattern, most in ((_CARD, 19), (_PHONE, 15)) for m in pattern.finditer(text))
        apart = all(a[1] <= b[0] for a, b in zip(gold, gold[1:])) and not unsaid
        if apart:
            out.append((text, left, right, gold))
        alone += [(k, text[s:e]) for s, e, k in gold if apart]
    sides = [(" ", " "), (" ", "."), (" ", ","), ("", ""), ("\n", " "), (":", ","), ("(", ")"), (" ", "\n"), (" ", "!"), (" ", "|")]
    side = lambda: rng.choice(sides)
    for k, said in alone:
        out += [(t, *side(), gold) for t, gold in rewritten(k, said, rng)]
        out.append((said, *side(), [(0, len(said), k)]))
        if k != "email":
            number = str(rng.randint(1, 9999))
            out.append((f"{number} {said}", *side(), [(len(number) + 1, len(number) + 1 + len(said), k)]))
            out.append((f"{said} {number}", *side(), [(0, len(said), k)]))
            other, more = rng.choice(alone)
            if other != "email":
                gap = rng.choice([" ", " ", "  ", " / "])
                out.append((said + gap + more, *side(), [(0, len(said), k), (len(said) + len(gap), len(said) + len(gap) + len(more), other)]))
    year, two = lambda: str(rng.randint(1900, 2099)), lambda: f"{rng.randint(1, 12):02d}"
    for _ in range(len(alone) // 4 + 1 if alone else 0):
        plain = [f"{year()}-{two()}-{two()}", f"{two()}.{two()}.{year()}", f"{two()}/{two()}/{year()}", f"{year()}-{year()}", f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}.{rng.randint(300, 9999)}", f"{rng.randint(0, 10**6)}.{rng.randint(0, 10**6)}", str(rng.randint(10**6, 10**12)), f"{year()} {year()} {year()}", f"978-{rng.randint(0, 9)}-{rng.randint(10, 99)}-{rng.randint(10**5, 10**6 - 1)}-{rng.randint(0, 9)}", f"{rng.randint(1, 99)} {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(100, 999)}", f"{year()}-{two()}-{two()} {two()} {two()}", f"{rng.randint(1, 99)}-{rng.randint(100, 999)}"]
        out += [(t, *side(), []) for t in plain]
    return out


def fit(found: DataFrame, most: int = MOST) -> Model:
    """A model from find()'s table: learned from about `most` different stretches with base spans and as many without, drawn by their hash. Without base spans nothing is learned, and nothing added."""
    rows = found.select(F.explode("stretches").alias("x")).select("x.*").where(F.length("text") <= LONGEST).select("text", "left", "right", "base").distinct()
    rows = stored(rows.withColumn("key", F.xxhash64("text", "left", "right")), "pii-stretches")
    n = {some: k for some, k in rows.groupBy(F.col("base") != "").count().collect()}
    share = lambda some: F.lit((2**63 - 1) * most // max(most, n.get(some, 0)))
    drawn = rows.where(F.shiftrightunsigned("key", 1) <= F.when(F.col("base") != "", share(True)).otherwise(share(False)))
    got = sorted((r.text, r.left, r.right, r.base) for r in drawn.collect())
    drop_stored(rows)
    return learn(examples(got)) if any(r[3] for r in got) else Model()


_STRETCH = pa.struct([("at", pa.int64()), ("text", pa.string()), ("left", pa.string()), ("right", pa.string()), ("base", pa.string())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("base", pa.string()), ("stretches", pa.list_(_STRETCH))])


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, bases, parts, held = [], [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            base = base_spans(text) if _ANY.search(text) else []
            own, b = [], 0
            for s, e in stretches(text):
                # the base spans within, or across the borders of, this stretch
                while b < len(base) and base[b][1] <= s:
                    b += 1
                inner = [x for x in _until(base, b, e)]
                own.append({"at": s, "text": text[s:e], "left": text[s - 1 : s], "right": text[e : e + 1], "base": joined([(max(x, s) - s, min(y, e) - s, k) for x, y, k in inner])})
                held += e - s
            ids.append(doc_id)
            bases.append(joined(base))
            parts.append(own)
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, bases, parts), _FOUND)], schema=_FOUND)
                ids, bases, parts, held = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, bases, parts), _FOUND)], schema=_FOUND)


def _until(base: list[tuple[int, int, str]], b: int, e: int) -> Iterator[tuple[int, int, str]]:
    while b < len(base) and base[b][0] < e:
        yield base[b]
        b += 1


def find(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): its base spans, and the stretches in which the model looks for more, each with the base spans in it. The text itself isn't needed after this."""
    return docs.select("doc_id", "text").mapInArrow(_find, "doc_id long, base string, stretches array<struct<at long, text string, left string, right string, base string>>")


def added(model: Model, stretch: dict, caution: float = CAUTION) -> list[tuple[int, int, str]]:
    """The model's spans in a stretch, none of which touches a base span."""
    g = Graph(candidates(stretch["text"], stretch["left"], stretch["right"]), [(s, e) for s, e, _ in split(stretch["base"])])
    at = stretch["at"]
    return [(at + g.points[g.spans[n][0]], at + g.points[g.spans[n][1]], KINDS[g.spans[n][2] - 1]) for n in model.best(g, caution)]


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def _decide(model: Model) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                base = split(r["base"])
                more = [x for s in r["stretches"] for x in added(model, s)] if model.weights else []
                counts = Counter(k for *_, k in base)
                out.append((r["doc_id"], *(counts[k] for k in KINDS), hashlib.sha256(r["base"].encode()).hexdigest(), joined(base + more), len(more)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    return run


def personal_data(docs: DataFrame, most: int = MOST) -> DataFrame:
    """Per row of docs (doc_id, text): the number of base spans of each kind, a digest of them, and all spans as kind:start:end (code points) by start.

    Base spans stay; the model's spans are added where none lies. Null and empty texts have none. Repeated rows, equal and null doc_ids each
    give their own row; an empty table gives none; other columns are left out. Of two ways to cut a stretch with equal scores the one
    with more plain text is taken. A long text is scanned in a time that grows with its length; a text that is one long number is one
    stretch, cut with candidates of at most CHARS characters.
    """
    found = stored(find(docs), "pii-found")
    model = fit(found, most)
    return found.mapInArrow(_decide(model), "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
