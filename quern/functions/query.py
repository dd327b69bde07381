"""The query front end: raw text in, normalised text, trace, attributes, slots and model code out, as one column expression.

The nine steps run in this order: unicode form, separators, compound synonyms, letters from digits, look-alikes, keyboard layout,
synonyms, transliteration, words. Then attributes leave the words, stop words go, and the rest is parsed into slots. A text that is a
model code as a whole has no slots but its code.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text

# Words that name a variant of a line, and the forms of model codes.
MODIFIERS = ["pro", "max", "plus", "ultra", "mini", "fe", "lite", "air", "fold", "flip", "a"]
CODE_FORMS = [r"^SM-[A-Z][0-9]{3,4}[A-Z0-9]{0,3}$", r"^CPH[0-9]{4}$", r"^[0-9]{4,7}[A-Z]{1,4}([0-9]{1,3}[A-Z]{0,3})?$"]
CYRILLIC_WORD = "^[а-яёА-ЯЁ]+$"
LARGEST = 2**31 - 1


@dataclass(frozen=True)
class Dictionary:
    """Words of a query language. keys: characters of one keyboard layout with those at their places in the other."""

    synonyms: Mapping[str, Sequence[str]] = field(default_factory=dict)
    letters: Mapping[str, str] = field(default_factory=dict)
    keys: Mapping[str, str] = field(default_factory=dict)
    attributes: Mapping[str, Sequence[str]] = field(default_factory=dict)
    stop_words: Sequence[str] = ()

    def latin(self, word: str) -> str:
        return "".join(self.letters.get(c.lower(), c) for c in word)

    def known(self) -> list[str]:
        """All words that synonyms lead from or to."""
        return sorted({*self.synonyms, *(w for to in self.synonyms.values() for w in to)})

    def both(self, words: Sequence[str]) -> list[str]:
        """Words in lower case, as they are and transliterated."""
        low = [w.lower() for w in words]
        return sorted({*low, *map(self.latin, low)})


def chained(value: Column, steps: Sequence[Callable[[Column], Column]], finish: Callable[[list[Column]], Column]) -> Column:
    """finish of value and of what each step makes of the one before, each computed once however often it's used."""

    def bind(made: list[Column], rest: Sequence[Callable[[Column], Column]]) -> Column:
        if not rest:
            return finish(made)
        return F.get(F.transform(F.array(rest[0](made[-1])), lambda v: bind([*made, v], rest[1:])), F.lit(0))

    return F.get(F.transform(F.array(value), lambda v: bind([v], steps)), F.lit(0))


def repair_runs(c: Column) -> Column:
    """Look-alikes in each run of a-z and 0-9, whatever letters stand beside it."""
    edge = "(?<=[a-z0-9])(?=[^a-z0-9])|(?<=[^a-z0-9])(?=[a-z0-9])"
    return F.array_join(text.repair_lookalikes(F.split(c, edge)), "")


def repair_layout(words: Column, d: Dictionary) -> Column:
    """Words all in Cyrillic whose reading in the other layout is a known word."""
    known = d.known()
    if not d.keys or not known:
        return words
    read = lambda w: F.translate(F.lower(w), "".join(d.keys), "".join(d.keys.values()))
    return F.transform(words, lambda w: F.when(w.rlike(CYRILLIC_WORD) & read(w).isin(*known), read(w)).otherwise(w))


def steps(d: Dictionary) -> dict[str, Callable[[Column], Column]]:
    """The steps by name. The first takes a text that is in NFKC already."""
    joined = lambda f: lambda v: F.array_join(f(text.tokens(v)), " ")
    same = lambda v: v
    return {
        "unicode": F.lower,
        "separators": lambda v: text.collapse_spaces(text.strip_punctuation(text.unify_separators(v))),
        "compounds": (lambda v: text.expand_compounds(v, d.synonyms)) if d.synonyms else same,
        "letters and digits": text.split_letters_digits,
        "lookalikes": repair_runs,
        "keyboard": joined(lambda w: repair_layout(w, d)),
        "synonyms": joined(lambda w: text.expand_synonyms(w, d.synonyms)) if d.synonyms else same,
        "transliteration": (lambda v: text.transliterate(v, d.letters)) if d.letters else same,
        "tokens": joined(same),
    }


def _swapped(word: str) -> set[str]:
    return {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word}


def damaged_modifier(word: Column) -> Column:
    """Whether one edit (a character more, less or other, or two swapped) makes a modifier of the word; both have three characters or more."""
    out = F.lit(False)
    for m in MODIFIERS:
        if len(m) >= 3:
            out = out | (F.levenshtein(word, F.lit(m), 1) == 1) | word.isin(*sorted(_swapped(m)))
    return (F.length(word) >= 3) & out


def number(word: Column) -> Column:
    """A word of digits as an int; one past the largest int stands for that one."""
    return F.least(F.coalesce(word.try_cast("decimal(38,0)"), F.lit(LARGEST).cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("int")


def parse_slots(words: Column, d: Dictionary) -> Column:
    """struct(brand, family, generation, modifiers, unparsed, attributes) of the words of a query.

    Modifiers keep their order and repeats. The first number is the generation. A later word that is a damaged
    modifier stays unparsed, as do words that are no plain letters; neither may pass as a part of the family.
    """
    stop = d.both(d.stop_words)
    none = F.array().cast("array<string>")

    def of(found: Column) -> Column:
        rest = found["rest"]
        kept = F.filter(rest, lambda w: ~w.isin(*stop)) if stop else rest
        return F.get(F.transform(F.array(kept), lambda k: named(k, found)), F.lit(0))

    def named(kept: Column, found: Column) -> Column:
        others = F.filter(kept, lambda w: ~w.isin(*MODIFIERS))
        at = F.get(F.filter(F.transform(others, lambda w, i: F.when(w.rlike("^[0-9]+$"), i)), lambda i: i.isNotNull()), F.lit(0))
        left = F.filter(others, lambda w, i: ~i.eqNullSafe(at))
        return F.get(F.transform(F.array(F.struct(left.alias("left"), F.get(others, at).alias("number"))), lambda s: parts(s, kept, found)), F.lit(0))

    def parts(s: Column, kept: Column, found: Column) -> Column:
        plain = F.transform(s["left"], lambda w: w.rlike("^[a-z]+$"))
        first = F.array_position(plain, F.lit(True)) - 1
        odd = F.transform(s["left"], lambda w, i: ~F.get(plain, i) | ((i > first) & damaged_modifier(w)))
        return F.get(F.transform(F.array(F.struct(s["left"].alias("left"), odd.alias("odd"), s["number"].alias("number"))), lambda t: slots(t, kept, found)), F.lit(0))

    def slots(t: Column, kept: Column, found: Column) -> Column:
        names = F.filter(t["left"], lambda w, i: ~F.get(t["odd"], i))
        family = F.when(F.size(names) > 1, F.array_join(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), "-")).otherwise(F.get(names, F.lit(0)))
        return F.struct(
            F.get(names, F.lit(0)).alias("brand"),
            family.alias("family"),
            F.when(t["number"].isNotNull(), number(t["number"])).alias("generation"),
            F.filter(kept, lambda w: w.isin(*MODIFIERS)).alias("modifiers"),
            F.filter(t["left"], lambda w, i: F.get(t["odd"], i)).alias("unparsed"),
            F.struct(*[found[k].alias(k) for k in ("storage", "network", "dual_sim", "color", "year")]).alias("attributes"),
        )

    patterns = {k: d.both(v) for k, v in d.attributes.items()}
    found = text.extract_attributes(F.coalesce(words, none), patterns)
    return F.get(F.transform(F.array(found), of), F.lit(0))


def model_code(raw: Column) -> Column:
    """The trimmed text in upper case, where it has the form of a model code."""
    up = F.upper(F.trim(raw))
    match = F.lit(False)
    for form in CODE_FORMS:
        match = match | up.rlike(form)
    return F.when(match, up)


def normalised(raw: Column, d: Dictionary, codes: bool = True, slots: bool = True) -> Column:
    """struct(normalised, words, trace, code, q): q has the slots, empty where the text is a code. codes: whether to look for one. slots: whether to have q.

    trace: step, value and changed of each step. A null text counts as empty.
    """
    named = steps(d)
    given = F.coalesce(raw, F.lit(""))
    code = model_code(given) if codes else F.lit(None).cast("string")

    def finish(made: list[Column]) -> Column:
        before = [given, *made[1:-1]]
        trace = F.array(*[F.struct(F.lit(k).alias("step"), v.alias("value"), (v != b).alias("changed")) for k, v, b in zip(named, made[1:], before)])
        words = F.filter(F.split(made[-1], " "), lambda w: w != "")
        asked = F.when(code.isNull(), words).otherwise(F.array().cast("array<string>"))
        q = [parse_slots(asked, d).alias("q")] if slots else []
        return F.struct(made[-2].alias("normalised"), words.alias("words"), trace.alias("trace"), code.alias("code"), *q)

    return chained(text.nfkc(given), list(named.values()), finish)


def marketing_slots(brand: Column, name: Column, d: Dictionary) -> Column:
    """The slots of a device's brand and marketing name, which are never read as a code."""
    return normalised(F.concat_ws(" ", brand, name), d, codes=False)["q"]
