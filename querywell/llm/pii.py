"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidates of four kinds come from regexes: the strict patterns (base spans) and
looser ones (digit groups that may be phone numbers without a plus sign or with
00, card numbers grouped by other marks, IPv6 and defanged addresses, e-mail
addresses written with "at" and "dot"). Loose patterns run over the text with its
base spans masked by as many characters, so both speak of the same positions and
never overlap. Four labelers vote +1, -1 or 0 on every candidate:

* regex: the strict rule holds (ranges, lengths, Luhn digit); of loose candidates
  it says nothing but where a rule can be tried on them;
* gazetteer: top-level domains, issuer prefixes, calling codes, address blocks;
* context: words for the kind shortly before or after the candidate;
* shape: separators and grouping are those the kind is usually written with.

The votes of all candidates of all documents are counted by pattern (at most
81 patterns a kind); expectation-maximisation over those counts estimates how
reliable each labeler is and how likely each pattern is to be personal data.
A logistic span classifier is then trained to these probabilities on features
that are no votes: the pattern that found the span, its number of digits, its
separators, the word before it (hashed) and what follows it. So a span without a
word of the context lists is found where its like elsewhere has them. Base spans
always stay; the classifier adds others.

The models are fitted on the driver over these few counts; all work on rows is
native. Positions come from the gaps between matches: ``split`` and
``regexp_extract_all`` walk the same matches.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, once

KINDS = ("email", "ip", "card", "phone")
#: The four base patterns. Possessive repeats and the look-arounds only keep the
#: matcher linear and leave out matches that the rule on digits drops anyway: a
#: run that fails at its begin fails further right as well, and a chain of digits
#: or a number after a plus sign is never part of the next one.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+(?=[0-9](?:[\x20().-]*[0-9]){8})[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates that only the classifier can accept: (kind, pattern, what a text must hold to match).
LOOSE = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|(?<=\x20)at(?=\x20))\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?(?:\(dot\)|\[dot\]|(?<=\x20)dot(?=\x20))\x20?|\.)[A-Za-z0-9-]{1,63}+)++", r"\x20at\x20|\(at\)|\[at\]"),
    ("ip", r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){2,7}+(?::?[0-9A-Fa-f]{1,4})++(?![0-9A-Fa-f:])|(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9.])", r"[0-9A-Fa-f]:[0-9A-Fa-f:]|\[\.\]"),
    ("card", r"(?<![0-9./_])[0-9]{4}([./_\u00A0])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9./_])", r"[0-9][./_\u00A0][0-9]"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])|(?<![0-9+.-])00[1-9](?:[\x20().-]?[0-9]){7,13}+(?![0-9.-])", r"[0-9].[0-9]|00[1-9]"),
]
#: Gazetteers.
DOMAINS = "com org net edu gov mil int info biz io de fr es it nl be at ch uk eu us ca au jp cn in br ru pl se no dk fi pt".split()
CONTEXT = {
    "email": "e-mail email mail contact write courriel correo kontakt",
    "ip": "ip address host server addr adresse",
    "card": "card visa mastercard credit debit payment carte karte tarjeta",
    "phone": "phone tel telephone call mobile fax cell telefon telefono",
}
LABELERS = ("regex", "gazetteer", "context", "shape")
CONTEXT_CHARS, RIGHT_CHARS, ROUNDS, BLOCK, CHUNK = 32, 12, 50, 256, 2048
#: Of the classifier: buckets of digits and of words, inputs, and steps of training.
DIGITS, WORDS, TRAINING = 24, 31, 150
INPUTS = 68 + DIGITS


def _quad() -> str:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return rf"^{part}(?:\.{part}){{3}}$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn digit."""
    value = lambda c, i: (
        F.when(i % 2 == 0, c).when(c * 2 > 9, c * 2 - 9).otherwise(c * 2)
    )
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: value(F.coalesce(F.expr("0") + c.try_cast("int"), F.lit(0)), i))
    return F.aggregate(each, F.lit(0), lambda s, c: s + c) % 10 == 0


def strict(kind: str, surface: Column) -> Column:
    """The base rule that a match of the base pattern must pass."""
    if kind == "email":
        return surface.contains("@")
    if kind == "ip":
        return surface.rlike(_quad())
    n = F.length(_digits(surface))
    if kind == "card":
        return F.coalesce(F.when(n.between(12, 19) & ~surface.startswith("+"), luhn(_digits(surface))), F.lit(False))
    return surface.startswith("+") & n.between(9, 15)


def _votes(kind: str, loose: bool, surface: Column, left: Column, right: Column) -> dict[str, Column]:
    yes, no, unsure = F.lit(1), F.lit(-1), F.lit(0)
    digits, around = _digits(surface), F.concat(left, F.lit(" "), F.left(right, F.lit(RIGHT_CHARS)))
    context = around.rlike(rf"(?i)(?<![\p{{L}}])(?:{'|'.join(CONTEXT[kind].split())})(?![\p{{L}}])")
    against = "|".join(w for k in KINDS if k != kind for w in CONTEXT[k].split() if w not in CONTEXT[kind].split())
    other = around.rlike(rf"(?i)(?<![\p{{L}}])(?:{against}|version|order|invoice|isbn|section|serial|part)(?![\p{{L}}])")
    votes = {"context": F.when(context, yes).when(other, no).otherwise(unsure)}
    if not loose:
        votes["regex"] = F.when(strict(kind, surface), yes).otherwise(no)
    elif kind == "card":
        votes["regex"] = F.when(luhn(digits), yes).otherwise(no)
    elif kind == "ip":
        votes["regex"] = F.when(surface.contains(":"), unsure).when(F.replace(F.replace(surface, F.lit("["), F.lit("")), F.lit("]"), F.lit("")).rlike(_quad()), yes).otherwise(no)
    else:
        votes["regex"] = unsure
    if kind == "email":
        top = F.lower(F.regexp_extract(surface, r"([A-Za-z0-9-]+)$", 1))
        votes["gazetteer"] = F.when(top.isin(DOMAINS), yes).when(top.rlike("^[a-z]{2,}$"), no if loose else unsure).otherwise(no)
        votes["shape"] = F.when(surface.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:@|\x20?[(\[]at|\x20at\x20[^\x20]+(?:\x20dot\x20|\.)[a-z]+$)"), yes).otherwise(no)
    elif kind == "ip":
        votes["gazetteer"] = F.when(surface.rlike(r"^(?:0|127|255)\[?\."), no).when(surface.rlike(r"^(?:2[0-9A-Fa-f]{3}|[Ff][CcDdEe][0-9A-Fa-f]{2}):"), yes).when(F.lit(not loose) & strict(kind, surface), yes).otherwise(unsure)
        votes["shape"] = F.when(surface.rlike(r"^(?:[1-9][0-9]{0,2}|0)(?:\[?\.\]?(?:[1-9][0-9]{0,2}|0)){3}$|^[0-9A-Fa-f:]*(?:::|(?::[0-9A-Fa-f]{1,4}){7})[0-9A-Fa-f:]*$"), yes).otherwise(no)
    elif kind == "card":
        votes["gazetteer"] = F.when(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), yes).otherwise(no)
        votes["shape"] = F.when(surface.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([\x20./_\u00A0-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$"), yes).otherwise(no)
    else:
        votes["gazetteer"] = F.when(surface.rlike(r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), yes).otherwise(unsure)
        votes["shape"] = F.when(surface.rlike(r"^\+?[0-9]{0,3}[\x20.-]?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,5}$|^(?:\+[0-9]{0,3}[\x20.-]?)?[0-9]{2,4}([\x20.-])[0-9]{3,4}\1[0-9]{3,5}$|^00"), yes).otherwise(no)
    return votes


def _separators(surface: Column) -> Column:
    """0 none, 1 spaces, 2 dashes, 3 dots, 4 brackets, 5 others or several."""
    held = F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_replace(surface, r"[()\[\]]+", "("), F.lit(r"[^\p{L}\p{N}]"), F.lit(0))))
    one = F.array_join(held, "")
    return F.when(one == "", 0).when(one == " ", 1).when(one == "-", 2).when(one == ".", 3).when(one.contains("("), 4).otherwise(5)


def _features(pattern: int, surface: Column, left: Column, right: Column) -> dict[str, Column]:
    word = F.lower(F.regexp_extract(left, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]{0,8}$", 1))
    return {
        "pattern": F.lit(pattern),
        "digits": F.least(F.length(_digits(surface)), F.lit(DIGITS - 1)).cast("int"),
        "separators": _separators(surface).cast("int"),
        "before": F.when(word == "", WORDS).otherwise(F.pmod(F.xxhash64(word), F.lit(WORDS))).cast("int"),
        "after": F.when(right == "", 0).when(right.rlike(r"^\s"), 1).when(right.rlike(r"^[\p{L}\p{N}]"), 2).otherwise(3).cast("int"),
    }


def _in_blocks(name: str, state: Column, of: str, step) -> Column:
    """Fold a long array, a column by its name (an expression would be computed again for each block): step(state, item) -> state with ``end`` and ``out``; out is gathered a block at a time, so that
    the work stays in proportion to the items. ``of`` is the type of an item of out."""
    items = F.col(name)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.slice(items, at + 1, F.lit(BLOCK)))
    none, no_blocks = F.from_json(F.lit("[]"), f"array<{of}>"), F.from_json(F.lit("[]"), f"array<array<{of}>>")

    def block(done: Column, part: Column) -> Column:
        begin = F.struct(done["end"].alias("end"), none.alias("out"))
        return F.aggregate(part, begin, step, lambda s: F.struct(s["end"].alias("end"), F.concat(done["out"], F.array(s["out"])).alias("out")))

    found = F.aggregate(blocks, F.struct(state.alias("end"), no_blocks.alias("out")), block, lambda s: F.flatten(s["out"]))
    return F.when(F.size(items) > 0, found).otherwise(none)


def _sides(matches: str, gaps: str) -> Column:
    """array<struct<m, n, left, right>>: matches, the length of the gap before each and the near ends of the gaps around it."""
    sides = F.filter(F.arrays_zip(F.col(matches).alias("m"), F.col(gaps).alias("g"), F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))).alias("h")), lambda x: x["m"].isNotNull())
    return F.transform(sides, lambda x: F.struct(x["m"].alias("m"), F.length(x["g"]).alias("n"), F.right(x["g"], F.lit(CONTEXT_CHARS)).alias("left"), F.left(x["h"], F.lit(CONTEXT_CHARS)).alias("right")))


def _placed(sides: str) -> Column:
    """array<struct<start, end, surface, left, right>> of the matches."""
    of = "struct<start:bigint,end:bigint,surface:string,left:string,right:string>"

    def step(s: Column, x: Column) -> Column:
        begin = s["end"] + x["n"]
        end = begin + F.length(x["m"])
        return F.struct(end.alias("end"), F.concat(s["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("surface"), x["left"].alias("left"), x["right"].alias("right")))).alias("out"))

    return _in_blocks(sides, F.lit(0).cast("long"), of, step)


def _covered(spans: str) -> Column:
    """Sorted spans cut to what those before leave over: array<struct<start, end, kind, joined>>; joined if it follows one that it overlaps."""

    def step(s: Column, x: Column) -> Column:
        part = F.struct(F.greatest(x["start"], s["end"]).alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), (x["start"] < s["end"]).alias("joined"))
        return F.when(x["end"] > s["end"], F.struct(x["end"].alias("end"), F.concat(s["out"], F.array(part)).alias("out"))).otherwise(s)

    return _in_blocks(spans, F.lit(0).cast("long"), "struct<start:bigint,end:bigint,kind:int,joined:boolean>", step)


def _apart(spans: str, of: str) -> Column:
    """Of sorted spans those that begin behind the last one taken."""
    step = lambda s, x: F.when(x["start"] >= s["end"], F.struct(x["end"].alias("end"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s)
    return _in_blocks(spans, F.lit(0).cast("long"), of, step)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _rewritten(chunks: str, parts: str, fill) -> Column:
    """A text with fill(part) in place of each of the covered parts, from chunks of it, so that no place is counted from the begin."""
    held, spans = F.col(chunks), F.col(parts)

    def piece(begin: Column, n: Column) -> Column:
        first, last = F.floor(begin / CHUNK).cast("int"), F.floor((begin + n) / CHUNK).cast("int")
        near = F.concat(F.coalesce(F.get(held, first), F.lit("")), F.coalesce(F.get(held, first + 1), F.lit("")))
        some = F.when(last <= first + 1, near).otherwise(F.array_join(F.slice(held, first + 1, last - first + 1), ""))
        return F.substring(some, (begin % CHUNK + 1).cast("int"), n.cast("int"))

    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: x["end"]))
    each = F.filter(F.arrays_zip(spans.alias("x"), begins.alias("b")), lambda z: z["x"].isNotNull())
    pieces = F.transform(each, lambda z: F.concat(piece(z["b"], z["x"]["start"] - z["b"]), fill(z["x"])))
    last = F.element_at(spans, -1)["end"]
    rest = F.floor(last / CHUNK).cast("int")
    tail = F.substring(F.array_join(F.slice(held, rest + 1, F.greatest(F.size(held) - rest, F.lit(0))), ""), (last % CHUNK + 1).cast("int"), F.lit(1 << 30))
    return F.concat(F.array_join(pieces, ""), tail)


def _voted(kind: str, loose: bool, pattern: int):
    def of(x: Column) -> Column:
        surface, left, right = x["surface"], x["left"], x["right"]
        votes = _votes(kind, loose, surface, left, right)
        base = F.lit(False) if loose else strict(kind, surface)
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), base.alias("base"), *(votes[k].alias(k) for k in LABELERS), *(c.alias(n) for n, c in _features(pattern, surface, left, right).items()))

    return of


CANDIDATE = f"struct<start:bigint,kind:int,end:bigint,base:boolean,{','.join(f'{k}:int' for k in LABELERS)},pattern:int,digits:int,separators:int,before:int,after:int>"


def _candidates(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows (text, ...) -> the columns of keep, base and loose: arrays of candidates, sorted; base ones pass the strict rule.

    Each step is a column of its own behind a generator, so that no pattern runs twice on a text.
    """
    text, digit, none = F.col("text"), F.col("text").rlike("[0-9]"), F.array().cast("array<string>")
    possible = {"email": text.contains("@"), "ip": digit & text.rlike(r"[0-9]\.[0-9]"), "card": digit, "phone": digit & text.contains("+")}
    names = [*keep, "text"]
    rows = once(rows, names, **{f"m{k}": F.when(possible[kind], F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0))).otherwise(none) for k, kind in enumerate(KINDS)})
    rows = once(rows, [*names, *(f"m{k}" for k in range(4))], **{f"g{k}": F.when(F.size(f"m{k}") > 0, F.split(text, BASE[kind], -1)).otherwise(none) for k, kind in enumerate(KINDS)})
    rows = once(rows, names, **{f"s{k}": _sides(f"m{k}", f"g{k}") for k in range(4)})
    rows = once(rows, names, **{f"p{k}": _placed(f"s{k}") for k in range(4)})
    every = F.array_sort(F.concat(*(F.transform(f"p{k}", _voted(kind, False, k)) for k, kind in enumerate(KINDS))))
    rows = once(rows, names, tried=every)
    rows = once(rows, [*names, "tried"], spans=F.filter("tried", lambda x: x["base"]))
    rows = once(rows, [*names, "tried"], parts=_covered("spans"))
    rows = once(rows, [*names, "tried", "parts"], chunks=F.when(F.size("parts") > 0, _chunks(text)))
    mask = F.when(F.size("parts") > 0, _rewritten("chunks", "parts", lambda x: F.repeat(F.lit("\ufffc"), (x["end"] - x["start"]).cast("int")))).otherwise(text)
    rows = once(rows, [*keep, "tried"], masked=mask)
    masked = F.col("masked")
    rows = once(rows, [*keep, "tried", "masked"], **{f"m{k}": F.when(masked.rlike(some), F.regexp_extract_all(masked, F.lit(pattern), F.lit(0))).otherwise(none) for k, (_, pattern, some) in enumerate(LOOSE)})
    rows = once(rows, [*keep, "tried", *(f"m{k}" for k in range(len(LOOSE)))], **{f"g{k}": F.when(F.size(f"m{k}") > 0, F.split(masked, pattern, -1)).otherwise(none) for k, (_, pattern, _) in enumerate(LOOSE)})
    rows = once(rows, [*keep, "tried"], **{f"s{k}": _sides(f"m{k}", f"g{k}") for k in range(len(LOOSE))})
    rows = once(rows, [*keep, "tried"], **{f"p{k}": _placed(f"s{k}") for k in range(len(LOOSE))})
    loose = F.array_sort(F.concat(F.filter("tried", lambda x: ~x["base"]), *(F.transform(f"p{k}", _voted(kind, True, 4 + k)) for k, (kind, _, _) in enumerate(LOOSE))))
    return once(rows, keep, base=F.filter("tried", lambda x: x["base"]), loose=loose)


class SpanModel:
    """Labeler reliabilities and the span classifier of each kind."""

    def __init__(self, counts: dict[int, dict[tuple, int]]):
        """counts: of each kind, candidates by their votes."""
        self.prior: dict[int, float] = {}
        self.reliability: dict[int, list[dict[int, tuple[float, float]]]] = {}
        self.weights: dict[int, list[float]] = {}
        for kind, rows in counts.items():
            self._estimate(kind, rows)

    def _estimate(self, kind: int, rows: dict[tuple, int]) -> None:
        """EM for independent labelers; each starts as right 9 times in 10."""
        prior = 0.5
        tables = [{1: (0.7, 0.1), 0: (0.2, 0.2), -1: (0.1, 0.7)} for _ in LABELERS]
        for _ in range(ROUNDS):
            yes_n = no_n = 1.0
            sums = [{v: [0.1, 0.1] for v in (1, 0, -1)} for _ in LABELERS]
            for votes, n in sorted(rows.items()):
                p = self._posterior(prior, tables, votes)
                yes_n, no_n = yes_n + n * p, no_n + n * (1 - p)
                for s, v in zip(sums, votes):
                    s[v][0] += n * p
                    s[v][1] += n * (1 - p)
            prior = min(0.99, max(0.01, yes_n / (yes_n + no_n)))
            # A labeler's yes is never read as evidence against: classes keep their meaning.
            tables = []
            for s in sums:
                total = [sum(s[v][k] for v in s) for k in (0, 1)]
                t = {v: [s[v][0] / total[0], s[v][1] / total[1]] for v in s}
                if t[1][0] < t[1][1]:
                    t[1] = [t[1][1], t[1][1]]
                if t[-1][0] > t[-1][1]:
                    t[-1] = [t[-1][0], t[-1][0]]
                tables.append({v: tuple(x) for v, x in t.items()})
        self.prior[kind], self.reliability[kind] = prior, tables

    @staticmethod
    def _posterior(prior: float, tables, votes) -> float:
        score = log(prior / (1 - prior)) + sum(log(t[v][0] / t[v][1]) for t, v in zip(tables, votes))
        return 1 / (1 + exp(-max(-30.0, min(30.0, score))))

    @staticmethod
    def features(key: tuple) -> list[int]:
        """The places of the ones in a classifier's input: bias, pattern, digits, separators, word before, what follows."""
        pattern, digits, separators, before, after = key
        return [0, 1 + pattern, 16 + digits, 16 + DIGITS + separators, 32 + DIGITS + before, 64 + DIGITS + after]

    def train(self, counts: dict[int, dict[tuple, tuple[int, float]]]) -> None:
        """counts: of each kind and features, how many candidates and the sum of their probabilities."""
        for kind, rows in counts.items():
            data, w, square = [(self.features(key), n, p / n) for key, (n, p) in sorted(rows.items())], [0.0] * INPUTS, [1e-8] * INPUTS
            total = sum(n for _, n, _ in data)
            for _ in range(TRAINING):
                grad = [1e-4 * v for v in w]
                for x, n, y in data:
                    g = n / total * (1 / (1 + exp(-max(-30.0, min(30.0, sum(w[k] for k in x))))) - y)
                    for k in x:
                        grad[k] += g
                for k, g in enumerate(grad):
                    if g:
                        square[k] += g * g
                        w[k] -= 0.5 * g / square[k] ** 0.5
            self.weights[kind] = w

    def probability(self, x: Column) -> Column:
        """What expectation-maximisation says of a candidate's votes."""
        out = F.lit(0.0)
        for kind, prior in sorted(self.prior.items()):
            score = F.lit(log(prior / (1 - prior)))
            for labeler, table in zip(LABELERS, self.reliability[kind]):
                ratio = {v: log(t[0] / t[1]) for v, t in table.items()}
                score = score + F.when(x[labeler] == 1, ratio[1]).when(x[labeler] == 0, ratio[0]).otherwise(ratio[-1])
            out = F.when(x["kind"] == kind, 1 / (1 + F.exp(-score))).otherwise(out)
        return out

    def accepts(self, x: Column) -> Column:
        """The classifier's probability is 0.5 or more."""
        score = F.lit(-1.0)
        for kind, w in sorted(self.weights.items()):
            values = lambda a, b, w=w: F.array(*map(F.lit, w[a:b]))
            total = F.lit(w[0]) + F.get(values(1, 16), x["pattern"]) + F.get(values(16, 16 + DIGITS), x["digits"]) + F.get(values(16 + DIGITS, 32 + DIGITS), x["separators"])
            total = total + F.get(values(32 + DIGITS, 64 + DIGITS), x["before"]) + F.get(values(64 + DIGITS, INPUTS), x["after"])
            score = F.when(x["kind"] == kind, total).otherwise(score)
        return score >= 0


def fitted(found: DataFrame) -> SpanModel:
    """(base, loose) -> the models, from counts of all candidates of all documents; no candidate gives a model that adds none."""
    x = found.select(F.inline(F.concat("base", "loose")))
    features = ["pattern", "digits", "separators", "before", "after"]
    counts: dict[int, dict[tuple, int]] = {}
    for r in x.groupBy("kind", *LABELERS).count().collect():  # at most 4 x 81
        counts.setdefault(r["kind"], {})[tuple(r[k] for k in LABELERS)] = r["count"]
    model = SpanModel(counts)
    each: dict[int, dict[tuple, tuple[int, float]]] = {}
    votes = x.select("kind", *features, model.probability({c: F.col(c) for c in ("kind", *LABELERS)}).alias("p"))
    for r in votes.groupBy("kind", *features).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p")).collect():  # at most 8 x DIGITS x 6 x (WORDS + 1) x 4
        each.setdefault(r["kind"], {})[tuple(r[k] for k in features)] = (r["n"], r["p"])
    model.train(each)
    return model


def _accepted(found: DataFrame, model: SpanModel, keep: list[str]) -> DataFrame:
    """(base, loose) -> base and spans: the base spans, and these with those that the classifier adds apart from each other."""
    own = "base"
    free = F.filter("loose", lambda x: model.accepts(x))
    found = once(found, [*keep, own], free=free)
    found = once(found, [*keep, own], extra=_apart("free", CANDIDATE))
    return once(found, [*keep, own], spans=F.array_sort(F.concat(own, "extra")))


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row per row.

    The counts and the digest are of base spans; ``spans`` holds all, as
    kind:start:end in code points. Null and empty texts have none. Repeated rows
    each keep a row, other columns are ignored, an empty table gives no rows.
    """
    found = durable(_candidates(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["doc_id"]))
    found = _accepted(found, fitted(found), ["doc_id"])
    numbers = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *numbers, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def _of_kind(k: int):
    return lambda x: x["kind"] == k


def redacted(docs: DataFrame) -> DataFrame:
    """docs with all spans in ``text`` replaced by [EMAIL], [IP], [CARD] or [PHONE]; n_chars follows if present.

    Overlapping spans give one mark, of the first. Other columns, whatever their
    names, null and empty texts stay; repeated rows stay each; an empty table
    stays empty. The texts are scanned twice, for the models and for the marks:
    to keep them with their candidates in between would write the whole corpus.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    plain = F.coalesce("text", F.lit("")).alias("text")
    model = fitted(durable(_candidates(docs.select(plain), []).where((F.size("base") > 0) | (F.size("loose") > 0))))
    own = [f"c{k}" for k in range(len(docs.columns))]  # the columns by place, so that no name of theirs can clash
    at = dict(zip(docs.columns, own))
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in at.items()), plain)
    rows = _accepted(_candidates(rows, own), model, own)
    rows = once(rows, own, parts=_covered("spans"))
    rows = once(rows, [*own, "parts"], chunks=F.when(F.size("parts") > 0, _chunks(F.col(at["text"]))))
    clean = F.when(F.size("parts") > 0, _rewritten("chunks", "parts", lambda x: F.when(x["joined"], "").otherwise(names[x["kind"]]))).otherwise(F.col(at["text"]))
    rows = once(rows, own, clean=clean)
    columns = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(columns.get(c, F.col(k)).alias(c) for c, k in at.items()))
